from pyspark.sql import functions as F

from veilspark import vocab
from veilspark.functions.text import matches
from veilspark.operators import detect
from veilspark.operators.obfuscate import with_entities
from veilspark.schema import STANDARD_RULES


def test_names_are_looked_for_once(spark):
    """Resolving names its spans several times: what makes them stands in the plan once (full names and parts)."""
    df = with_entities(spark.createDataFrame([("Patient: Anna Smith. Later Mr. Smith left.",)], "text string"))
    plan = df._jdf.queryExecution().optimizedPlan().treeString().replace("\n", "")
    assert plan.count(", propagated,") == 2
    assert [e.text for e in df.first().entities] == ["Anna Smith", "Smith"]


def test_what_a_match_begins_with_changes_no_match(spark):
    texts = [
        "Patient: Marc Smith, SSN 373-75-2373 Account No: 00032373 reach u32373@mail.example.com or (415) 555-2373; DOCKET no: 2024-0032373.",
        "ſSN: 123456789 ſex: male 12 ſep 2020, SEP. 3, 2021 1/2/2020 33/4/1999 2020-1-2 3 Mar 2001 5  aprıl 2002 may 9 2020",
        "Iİınsurance ID M1234567 İnsurance: ABC1234 ınsurance ABC123456 poKer Korean Whıte Aſian ſouth Aſian",
        "call +1 415 555 1234, 1(415)555-1234, x415.555.1234 ٤١٥-٥٥٥-١٢٣٤ 10.1.2.3 a10.1.2.3 4111-1111-1111-1111",
        "MRN: A12345 and Medical Record No 77-12345; 12 year-old, Age: 7, 44 yo, HTTP://x.org, 9 Oak Street, dob 1/2/90 Birth date: May 1, 1990 D.O.B. 1-2-1990 Dr. Who Prof Ann dea AB1234567 npi 1234567890",
    ]
    df, text = detect.with_text(spark.createDataFrame([(t,) for t in texts], "text string"))
    rules = [r for r in STANDARD_RULES if r.id in detect._BEGINS]
    both = df.select(*[matches(text.plain, r.pattern(b)).alias(f"{r.id}_{k}") for r in rules for k, b in enumerate((None, detect._BEGINS[r.id]))]).collect()
    assert not [(r.id, row) for r in rules for row in both if row[f"{r.id}_0"] != row[f"{r.id}_1"]]
    assert not [r.id for r in rules if not any(row[f"{r.id}_0"] for row in both)]


def test_numbers_that_are_kept_are_found_by_the_pattern(spark):
    text = "12345 x012 0 01 999 1234 00 a007b 12345mg 0123 mg 98765 units ١٢٣٤٥ 0١٢ ٠١٢ 5١0123 123456"
    df, columns = detect.with_text(spark.createDataFrame([(text,)], "text string"))
    units = "|".join(rf"\Q{u}\E" for u in vocab.UNITS)
    runs = matches(columns.plain, rf"(?U)(?<anc>)(?<!\d)(?<val>\d{{3,}}+)(?!\s?(?:{units})\b)")
    row = df.select(detect.number_spans(columns).alias("s"), F.filter(runs, lambda m: (F.length(m["text"]) >= 5) | m["text"].startswith("0")).alias("r")).first()
    assert [(s.start, s.end, s.text) for s in row.s] == [(r.start, r.end, r.text) for r in row.r]
    assert len(row.s) == 7
