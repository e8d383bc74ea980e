import pytest
from pyspark.sql import functions as F

from veilspark.functions import crypto
from veilspark.operators.obfuscate import obfuscate
from veilspark.operators.outbound import split
from veilspark.schema import Rule, Settings

TEXTS = {
    "ssn": "SSN: 123-45-6789 appears; later 123-45-6789 again.",
    "one": "Patient: John Smith\nMr. Smith arrived early. John was seen at noon.",
    "two": "Patient: John Smith. Contact: Jane Smith. Smith called later.",
    "lab": "HIV-1 RNA 100000 copies/mL. Account No: 998877665",
    "badge": "Badge 0042 issued. Dose 500 mg administered.",
    "verb": "Patient: Will Green\nWill the patient return next week?",
    "zip": "DOB: 03/15/1985, lives in San Jose, CA 95112",
    "null": None,
    "empty": "",
    "wide": "é😀 Dr. Priya Nair signed 12345é",
    "child": "Age: 4 seen 03/15/2022",
}


def test_notes(spark):
    keys = crypto.key_table(spark, {"s": b"\x11" * 32, "t": b"\x12" * 32})
    rows = [(s, k, t, 1) for s in "st" for k, t in TEXTS.items()]
    got = {(r.session_id, r.doc_id): r for r in obfuscate(spark.createDataFrame(rows, "session_id string, doc_id string, text string, extra int"), keys).collect()}
    out = {k: got["s", k] for k in TEXTS}
    shown = {k: [(e.start, e.end, e.entity_type, e.text) for e in r.entities] for k, r in out.items()}
    assert shown["ssn"] == [(5, 16, "SSN", "123-45-6789"), (32, 43, "SSN", "123-45-6789")]
    assert out["ssn"].obfuscated_text.count("[SSN_") == 2 and len({p.token for p in out["ssn"].plan}) == 1
    assert {e.canonical for e in out["one"].entities} == {"John Smith"} and len(out["one"].entities) == 3
    assert len({e.cluster_id for e in out["two"].entities}) == 3
    assert shown["lab"] == [(40, 49, "ACCOUNT", "998877665")]
    assert shown["badge"] == [(6, 10, "GENERIC_ID", "0042")]
    assert len(shown["verb"]) == 1
    assert out["zip"].obfuscated_text.startswith("DOB: 1985, lives in [ADDRESS_") and out["zip"].obfuscated_text.endswith("], CA 951XX")
    assert out["null"].obfuscated_text is None and out["empty"].obfuscated_text == ""
    assert shown["wide"] == [(7, 17, "NAME", "Priya Nair"), (25, 30, "GENERIC_ID", "12345")]
    assert out["child"].route_to_human and out["child"].obfuscated_text == TEXTS["child"]
    assert {p.token for p in got["t", "ssn"].plan}.isdisjoint(p.token for p in out["ssn"].plan)


def test_split_keeps_tokens_whole():
    token = "[INSURANCE_ID_0123456789ab]"
    text = "word " * 50 + token + " word" * 50
    parts = split(text, 80)
    assert "".join(parts) == text and len(parts) > 1 and sum(token in p for p in parts) == 1
    assert "".join(split(token * 9, 20)) == token * 9 and all(p.count("[") == p.count("]") for p in split(token * 9, 20))


def test_encryption_binds_its_place(spark):
    row = spark.range(1).select(F.lit(b"k" * 32).alias("k"))
    sealed = row.select("k", crypto.encrypt(F.lit("é secret"), F.col("k"), F.lit("here")).alias("c"))
    r = sealed.select(crypto.decrypt(F.col("c"), F.col("k"), F.lit("here")).alias("a"), crypto.decrypt(F.col("c"), F.col("k"), F.lit("there")).alias("b")).first()
    assert (r.a, r.b) == ("é secret", None)


def test_settings_and_rules():
    assert Settings.from_env({"GEMINI_API_KEY": "x", "ANTHROPIC_API_KEY": "y"}).provider_name() == "gemini"
    assert Settings.from_env({"VEIL_PROVIDER": "mock", "GEMINI_API_KEY": "x"}).provider_name() == "mock"
    assert "(?<x>" in Rule("r", "r", "NAME", regex="(?P<x>a)").pattern()
    with pytest.raises(ValueError):
        crypto.key_table(None, {"s": b"short"})
