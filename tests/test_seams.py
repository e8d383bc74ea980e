"""Parts that no query reaches: sessions, store, audit, pseudonyms, files, plans."""

import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from veilspark import queries, vocab
from veilspark.functions import crypto
from veilspark.functions.text import matches
from veilspark.operators import detect, outbound, strategies
from veilspark.operators.obfuscate import obfuscate
from veilspark.operators.restore import restore
from veilspark.plans import audit, process, vault
from veilspark.schema import STANDARD_RULES, Policy, Settings
from veilspark.sources import pages, rules, store
from veilspark.streaming.sessions import obfuscate_stream, requests, session_states

NOW = datetime.datetime(2024, 1, 1, 12)
SHORT = {"s": b"\x11" * 32}


@pytest.fixture(autouse=True)
def shared_folder(spark, tmp_path_factory):
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(f"file://{tmp_path_factory.mktemp('checkpoints')}")


def at(minutes):
    return F.lit(NOW + datetime.timedelta(minutes=minutes)).cast("timestamp")


def states(sessions):
    return {r.session_id: r.state for r in sessions.collect()}


def test_sessions(spark):
    sessions, keys = vault.create(spark, {"a": "u", "b": "u", "c": "v"}, at(0))
    again = vault.create(spark, {"a": "u"}, at(0))[1].first()
    assert keys.where("session_id = 'a'").first().k_enc != again.k_enc  # fresh roots
    assert states(vault.admitted(sessions, at(59))).keys() == {"a", "b", "c"} and not states(vault.admitted(sessions, at(60)))
    draining = vault.drain(sessions, F.col("session_id").isin("a", "b"), at(1))
    assert states(draining) == {"a": "DRAINING", "b": "DRAINING", "c": "ACTIVE"}
    asked = spark.createDataFrame([(s,) for s in "abcx"], "session_id string")
    assert sorted(r.session_id for r in vault.refused(asked, draining, at(2)).collect()) == ["a", "b", "x"]
    busy = spark.createDataFrame([("a",), ("a",), ("c",)], "session_id string")
    assert states(vault.drained(draining, busy, at(1))) == {"a": "DRAINING", "b": "DESTROYED", "c": "ACTIVE"}
    later = vault.drain(draining, F.col("session_id") == "a", at(5))  # a second drain does not begin anew
    forced = vault.drained(later, busy, at(2))
    assert states(forced) == {"a": "DESTROYED", "b": "DESTROYED", "c": "ACTIVE"}
    assert [r.session_id for r in vault.shred(keys, forced).collect()] == ["c"]
    assert states(vault.reap(sessions, at(60))) == dict.fromkeys("abc", "DESTROYED")


def test_what_is_shredded_cannot_be_read(spark):
    keys = crypto.key_table(spark, SHORT)
    docs = spark.createDataFrame([("s", "d", "Account No: 12345678")], "session_id string, doc_id string, text string")
    planned = obfuscate(docs, keys).checkpoint()
    entries = vault.entries(planned, keys).checkpoint()
    replies = planned.select("session_id", "doc_id", F.col("obfuscated_text").alias("reply"))
    assert restore(replies, vault.opened(entries, keys)).first().restored == "Account No: 12345678"
    gone = restore(replies, vault.opened(entries, keys.limit(0))).first()
    assert gone.restored == f"Account No: {vocab.REDACTED}" and gone.vault_misses == ["ACCOUNT"] and not gone.clean
    other = vault.opened(entries, crypto.key_table(spark, {"s": b"\x13" * 32}))
    assert other.count() == 0
    plan = vault.opened(entries, keys)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("aesdecrypt") + plan.count("aes_decrypt") == 1


def test_first_writer_wins(spark):
    rows = "session_id string, surface string, ciphertext binary, entity_tag string"
    have = spark.createDataFrame([("s", "x", b"1", "NAME")], rows)
    new = spark.createDataFrame([("s", "x", b"2", "NAME"), ("s", "y", b"3", "NAME"), ("t", "x", b"4", "NAME")], rows)
    assert sorted((r.session_id, r.surface, bytes(r.ciphertext)) for r in vault.upsert(have, new).collect()) == [("s", "y", b"3"), ("t", "x", b"4")]


def test_colliding_pseudonyms_keep_the_smallest(spark):
    plan = "array<struct<canonical:string,entity_type:string,vault_key:string>>"
    rows = [("s", [("Zoe", "NAME", "Anna"), ("Amy", "NAME", "Anna"), ("Bob", "NAME", "Carl")])]
    planned = spark.createDataFrame(rows, f"session_id string, plan {plan}")
    assert [tuple(r) for r in vault.collisions(planned).collect()] == [("s", "Anna", 2)]
    keys = crypto.key_table(spark, SHORT)
    back = {r.surface: r.original for r in vault.opened(vault.entries(planned, keys).checkpoint(), keys).collect()}
    assert back == {"Anna": "Amy", "Carl": "Bob"}


SHAPES = {
    "NAME": r"[A-Z][a-z]+ [A-Z][a-z]+",
    "ADDRESS": r"\d{3} [A-Z][a-z]+ [A-Z][a-z]+, [A-Z][a-z]+",
    "EMAIL": r"[a-z]+\d{6}@example\.org",
    "PHONE": r"\(\d{3}\) 555-\d{4}",
    "SSN": r"9\d{2}-\d{2}-\d{4}",
    "MRN": r"[A-Z]{2}\d{6}",
    "ACCOUNT": r"[A-Z]{2}\d{6}",
    "INSURANCE_ID": r"[A-Z]{2}\d{6}",
    "GENERIC_ID": r"[A-Z]{2}\d{6}",
    "CREDIT_CARD": r"4\d{15}",
    "IP": r"10(\.\d{1,3}){3}",
    "URL": r"https://[a-z]+\d{5}\.example\.org/",
    "LEGAL_CASE": r"[A-Z][a-z]+",
}


@pytest.mark.parametrize("kind", sorted(SHAPES))
def test_pseudonyms_by_type(spark, kind):
    digests = spark.range(300).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    fake = strategies.pseudonym(F.lit(kind), F.lit("whatever it was"), F.col("d"))
    got = [r[0] for r in digests.select(fake.alias("f")).collect()]
    assert all(re.fullmatch(SHAPES[kind], g) for g in got)
    assert got == [r[0] for r in digests.select(fake.alias("f")).collect()]
    assert len(set(got)) > (5 if kind == "LEGAL_CASE" else 150)


def test_pseudonyms_keep_gender_and_differ_from_the_value(spark):
    digests = spark.range(200).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))

    def firsts(value):
        return {r[0].split()[0] for r in digests.select(strategies.pseudonym(F.lit("NAME"), F.lit(value), F.col("d"))).collect()}

    assert firsts("john Smith") <= set(strategies.FIRST_MEN) and firsts("Jane Smith") <= set(strategies.FIRST_WOMEN)
    unknown = firsts("Zyx Smith")
    assert unknown & set(strategies.FIRST_MEN) and unknown & set(strategies.FIRST_WOMEN)
    own = digests.withColumn("v", strategies.pseudonym(F.lit("EMAIL"), F.lit("x"), F.col("d")))
    again = own.select(strategies.pseudonym(F.lit("EMAIL"), F.upper(F.concat(F.lit(" "), "v")), F.col("d")).alias("w"), "v").collect()
    assert all(r.w != r.v for r in again)


def test_longer_pseudonyms_first_and_whole_words(spark):
    rows = [("s", "d", "Anna Berger met Anna and Annabel. Berger left (Anna Berger)."), ("t", "e", "Anna Berger"), ("s", "n", None), ("s", "o", "nobody")]
    replies = spark.createDataFrame(rows, "session_id string, doc_id string, reply string")
    known = [("s", "Anna", "Eve"), ("s", "Anna Berger", "Eve $1 Stone"), ("s", "Carl", "Rex"), ("s", "[SSN_0123456789ab]", "1")]
    got = {r.doc_id: r for r in restore(replies, spark.createDataFrame(known, "session_id string, surface string, original string"), True).collect()}
    assert got["d"].restored == "Eve $1 Stone met Eve and Annabel. Berger left (Eve $1 Stone)." and got["d"].pseudonyms_restored == 3
    assert got["e"].restored == "Anna Berger" and got["e"].pseudonyms_restored == 0
    assert got["n"].restored is None and got["o"].restored == "nobody"


def test_store(spark, tmp_path):
    path, masters = f"file://{tmp_path}/store", store.master_table(spark, b"m" * 32)
    docs = spark.createDataFrame([(f"u{i % 5}", f"d{i}", f"text {i}") for i in range(20)], "user_id string, doc_id string, text string")
    store.put(docs, masters, path)
    store.put(docs.where("doc_id = 'd3'").withColumn("text", F.lit("newer")), masters, path)
    wanted = spark.createDataFrame([("u3", "d3"), ("u4", "d3"), ("u3", "d8")], "user_id string, doc_id string")
    got = {(r.user_id, r.doc_id): (r.text, r.error) for r in store.get(wanted, masters, path).collect()}
    assert got == {("u3", "d3"): ("newer", None), ("u4", "d3"): (None, "missing"), ("u3", "d8"): ("text 8", None)}
    assert {tuple(r) for r in store.exists(wanted, path).collect()} == {("u3", "d3"), ("u3", "d8")}
    wrong = store.get(wanted, store.master_table(spark, b"n" * 32), path)
    assert {r.error for r in wrong.collect()} == {"unreadable", "missing"}
    plan = store.get(wanted, masters, path)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*user_hash#\d+ IN", plan)


def test_audit_trail(spark, tmp_path):
    keys = crypto.key_table(spark, SHORT)
    docs = spark.createDataFrame([("s", "d", "Account No: 12345678, DOB: 03/15/1985")], "session_id string, doc_id string, text string")
    planned = obfuscate(docs, keys)
    audit.write(audit.events(planned, now=F.lit(1)), f"file://{tmp_path}/trail")
    replies = spark.createDataFrame([("s", "d", "see [SSN_0123456789ab]")], "session_id string, doc_id string, reply string")
    missed = restore(replies, spark.createDataFrame([], "session_id string, surface string, original string"))
    audit.write(audit.misses(missed, now=F.lit(2)), f"file://{tmp_path}/trail")
    lines = sorted((r.value for r in spark.read.text(f"file://{tmp_path}/trail").collect()))
    events = [json.loads(x) for x in lines]
    assert [list(e) for e in events] == [sorted(e) for e in events]
    assert sorted((e["action"], e["entity_type"], e["ts"]) for e in events) == [("GENERALIZE", "DOB", 1.0), ("TOKENIZE", "ACCOUNT", 1.0), ("VAULT_MISS_REDACT", "SSN", 2.0)]
    assert not any("12345678" in x or "1985" in x for x in lines)


def test_nothing_is_sent_after_a_leak(spark):
    rows = spark.createDataFrame([("John is here", ["John"])], "payload string, known_originals array<string>")
    with pytest.raises(Exception, match="nothing is sent"):
        outbound.send_or_raise(outbound.verify(rows)).collect()
    fine = spark.createDataFrame([("Johnson is here", ["John"])], "payload string, known_originals array<string>")
    assert outbound.send_or_raise(outbound.verify(fine)).first().payload == "Johnson is here"


def test_files_through_the_round_trip(spark, tmp_path):
    note = "Account No: 12345678 was opened."
    for name, content in {"a.txt": f"{note}\f second page".encode(), "b.txt": b"", "c.txt": b"\xff\xfe\x00", "d.txt": b" \f few", "e.txt": f"{note}\f\f\f".encode()}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.doc_id[-5:]: r for r in process.process_files(spark, f"file://{tmp_path}", crypto.key_table(spark, SHORT), "s", "Sum up.").collect()}
    assert got["a.txt"].pages == 2 and got["a.txt"].restored.count("12345678") == 2 and got["a.txt"].clean
    assert (got["b.txt"].error, got["c.txt"].error) == ("empty", "malformed") and not got["b.txt"].routed_to_human
    assert got["d.txt"].routed_to_human and got["e.txt"].routed_to_human and got["e.txt"].restored is None
    assert pages.form_feed_pages(b"x\fy") == ["x", "y"]


def test_a_session_of_its_own(spark):
    docs = spark.createDataFrame([("d", "Account No: 12345678")], "doc_id string, text string")
    assert process.session_of_one(docs, "Sum up.").first().tokens_restored == 2


def test_service_facts(spark):
    facts = rules.info(Settings.from_env({}))
    assert facts["status"] == "ok" and facts["provider"] == "mock" and facts["standard_rules"] == 24
    assert set(facts["entity_types"]) <= set(vocab.ENTITY_TYPES) and {"ZIP", "NAME", "SSN"} <= set(facts["entity_types"])
    assert "PERSONAL" in rules.supported_types(others=("PERSONAL",))


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sessions", [1, 500])
def test_documents_do_not_move_for_keys(spark, sessions):
    """Neither a nested loop that builds the documents, nor a product, nor an exchange by session."""
    keys = crypto.key_table(spark, {f"s{i}": bytes([i % 250 + 1]) * 32 for i in range(sessions)})
    name = F.concat(F.lit("s"), (F.col("id") % sessions).cast("string")) if sessions > 1 else F.lit("s0")
    docs = spark.range(1000).select(name.alias("session_id"), F.col("id").cast("string").alias("doc_id"), F.lit("Account No: 12345678").alias("text"))
    planned = obfuscate(docs, keys)
    entries = spark.createDataFrame([], "session_id string, surface string, ciphertext binary, entity_tag string")
    for plan in (_nodes(planned.select("obfuscated_text")), _nodes(vault.opened(entries, keys))):
        assert "CartesianProduct" not in plan and "BuildLeft" not in plan
        assert not re.search(r"hashpartitioning\(session_id", plan)


def test_large_key_tables_are_salted(spark, monkeypatch):
    keys = crypto.key_table(spark, {f"s{i}": bytes([i + 1]) * 32 for i in range(5)})
    docs = spark.range(40).select(F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("session_id"), F.col("id").cast("string").alias("doc_id"), F.lit("Account No: 12345678").alias("text"))
    few = {tuple(r) for r in obfuscate(docs, keys).select("doc_id", "obfuscated_text").collect()}
    monkeypatch.setattr(crypto, "BROADCAST_BYTES", 1024)
    out = obfuscate(docs, keys)
    assert {tuple(r) for r in out.select("doc_id", "obfuscated_text").collect()} == few and len(few) == 30
    assert "_salt" in _nodes(out.select("obfuscated_text"))


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"text": "Account No: 12345678", "doc_id": "d"}, {"text": "none here", "task": "Count."}]
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    rows = requests(spark, f"file://{tmp_path}/in")
    asked = rows.writeStream.format("memory").queryName("asked").trigger(availableNow=True).start()
    asked.awaitTermination()
    got = {r.text: r for r in spark.table("asked").collect()}
    assert got["none here"].task == "Count." and got["none here"].doc_id.startswith("req_")
    assert got["Account No: 12345678"].task.startswith("Summarize") and got["Account No: 12345678"].doc_id == "d"
    out = obfuscate_stream(rows.withColumn("session_id", F.lit("s")), crypto.key_table(spark, SHORT))
    out.writeStream.format("memory").queryName("hidden").trigger(availableNow=True).start().awaitTermination()
    assert all("12345678" not in r.obfuscated_text for r in spark.table("hidden").collect()) and spark.table("hidden").count() == 2


def test_session_stream(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    batches = [
        [("a", "12:00:00", "request"), ("b", "12:00:00", "request")],
        [("a", "12:05:00", "drain"), ("a", "12:05:01", "request"), ("b", "12:05:00", "request")],
        [("c", "12:30:00", "request")],
        [("c", "14:30:00", "request")],
        [("d", "14:31:00", "request")],
    ]
    schema = "session_id string, ts timestamp, kind string"
    for i, rows in enumerate(batches):
        path = folder / f"{i}.json"
        path.write_text("\n".join(json.dumps({"session_id": s, "ts": f"2024-01-01 {t}", "kind": k}) for s, t, k in rows))
        import os

        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}")
    seen = []
    states_of = session_states(stream, ttl_seconds=3600, late="1 minute")
    query = states_of.writeStream.outputMode("update").foreachBatch(lambda df, i: seen.extend((r.session_id, r.state, r.requests) for r in df.collect())).option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    assert ("a", "ACTIVE", 1) in seen and ("a", "DRAINING", 1) in seen and ("a", "DESTROYED", 1) in seen
    assert ("b", "ACTIVE", 2) in seen and ("b", "DESTROYED", 2) in seen
    assert seen.index(("a", "DESTROYED", 1)) <= seen.index(("b", "DESTROYED", 2))


def test_policy_defaults():
    assert Policy().routing()["AGE"] == "PRESERVE" and Policy(preserve_age=False).routing()["AGE"] == "TOKENIZE"


@pytest.fixture()
def colliding_orders(spark, tmp_path):
    """Orders whose tokens of 48 bits (accounts of the first two, addresses of the next two) or
    pseudonyms (the last four) are equal, as among the nine million of 1 GB."""
    keys = [1706426, 6097289, 3490400, 5689270, 1845274, 1845338, 8460915, 8460947]
    rows = [(k, 9, "O", 1.0, NOW, "1-URGENT") for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"file://{tmp_path}/orders.parquet")
    return tmp_path


def _as_sql(spark, folder, name):
    import duckdb
    from oracle import rows_of_duck, rows_of_spark

    db = duckdb.connect()
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/orders.parquet/*.parquet'")
    assert rows_of_spark(queries.QUERIES[name](spark, f"file://{folder}")) == rows_of_duck(db, queries.ORACLES[name])


def test_vault_keeps_both_originals_of_a_token(spark, colliding_orders):
    _as_sql(spark, colliding_orders, "vault_upsert")


@pytest.mark.parametrize("name", ["restore_round_trip", "process", "process_chunks"])
def test_a_token_of_two_documents_is_each_ones_own(spark, colliding_orders, name):
    _as_sql(spark, colliding_orders, name)


def test_a_first_and_a_second_token_of_two_documents_are_each_ones_own(spark, tmp_path):
    """The first account of one order and the second one of another share a token, as among the nine million of 1 GB."""
    rows = [(2591280, 255024), (4525129, 455503)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"file://{tmp_path}/orders.parquet")
    _as_sql(spark, tmp_path, "process_chunks")


def test_a_pseudonym_of_two_documents_is_each_ones_own(spark, colliding_orders):
    _as_sql(spark, colliding_orders, "pseudonym_round_trip")


def test_pseudonyms_of_another_document_of_the_session_are_restored(spark):
    known = spark.createDataFrame([("s", "d", "Anna", "Zoe"), ("s", "e", "Anna", "Amy"), ("s", "e", "Anna Berger", "Eve Stone"), ("s", "e", "Carl", "Rex")], "session_id string, doc_id string, surface string, original string")
    replies = spark.createDataFrame([("s", k, "Anna Berger met Anna and Annabel.") for k in "def"], "session_id string, doc_id string, reply string")
    got = {r.doc_id: (r.restored, r.pseudonyms_restored) for r in restore(replies, known, True).collect()}
    assert got == {"d": ("Eve Stone met Zoe and Annabel.", 2), "e": ("Eve Stone met Amy and Annabel.", 2), "f": ("Eve Stone met Amy and Annabel.", 2)}


def test_tokens_of_another_document_of_the_session_are_restored(spark):
    known = spark.createDataFrame([("s", "d", "[SSN_0123456789ab]", "2"), ("s", "e", "[SSN_0123456789ab]", "1"), ("s", "f", "[SSN_0123456789ab]", None)], "session_id string, doc_id string, surface string, original string")
    replies = spark.createDataFrame([("s", k, "see [SSN_0123456789ab] twice [ssn_0123456789ab]") for k in "defg"], "session_id string, doc_id string, reply string")
    got = {r.doc_id: (r.restored, r.tokens_restored, r.clean) for r in restore(replies, known).collect()}
    assert got == {"d": ("see 2 twice 2", 2, True), **{k: ("see 1 twice 1", 2, True) for k in "efg"}}


def test_hints_hide_no_match(spark, monkeypatch):
    """What a rule finds behind its hint is what it finds without."""
    import random

    draw, parts = random.Random(7), ["SSN", "Social Security No", "Acct", "Member ID", "Docket #", "PATIENT", "Referring Provider", "Dr", "D.O.B.", "Birth date", "Age", "Gender", "SEX", "MAN", "afr\u0131can american", "\u212aorean", "M\u0130ss", "non-b\u0131nary", "mrn", "DEA No: AB1234567", "NPI 1234567890"]
    parts += ["123-45-6789", "123456789", "(415) 555-0132", "415.555.0132", "4111 1111 1111 1111", "4111-1111-1111-111", "10.0.255.7", "\u0661\u0662\u0663.\u0664\u0665\u0666.\u0667\u0668\u0669\u0660", "03/15/1985", "2024-1-2", "AU\u017f. 3, 2020", "7 sept 2001", "62", "62-year-old", "9 YEAR\u017f old", "5 y.o.", "5y/o", "123456", "0123", "95112-1234", "CO", "CA", "San Jose", "Denver", ", co", ", \u0131L", "1420 Alder Street", "7 o\u0131d \u017ft", "12 King \u212areek Ct.", "u@x.org", "http://a", "500 mg", "Anna Berger", "J."]
    joins = [" ", " ", "\u00a0", "\u2003", "\n", ": ", "#", "", ", ", "-"]
    texts = ["".join(draw.choice(parts) + draw.choice(joins) for _ in range(6)) for _ in range(4000)]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text"))
    df, text = detect.with_text(rows)
    finders = {r.id: (lambda t, r=r: detect.rule_spans(t, r)) for r in STANDARD_RULES} | {"zip": detect.zip_spans, "number": detect.number_spans, "pair": detect.pair_spans}
    kept = {n: f(text) for n, f in finders.items()}
    monkeypatch.setattr(detect, "_guarded", lambda text, hint, found: found)
    told = df.select(*[F.struct((kept[n] != f(text)).alias("differs"), F.size(kept[n]).alias("n")).alias(n) for n, f in finders.items()])
    got = told.agg(*[F.struct(F.sum(F.col(f"{n}.differs").cast("int")).alias("differ"), F.sum(f"{n}.n").alias("n")).alias(n) for n in finders]).first()
    assert {n: got[n].differ for n in finders} == dict.fromkeys(finders, 0) and all(got[n].n for n in finders)


def test_a_pattern_passes_once(spark):
    plan = spark.range(1).select(matches(F.col("id").cast("string"), "(?<anc>)(?<val>q7)").alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("q7") == 1


def test_pads_are_made_once_a_document(spark):
    docs = spark.createDataFrame([("s", "d", "Account No: 12345678")], "session_id string, doc_id string, text string")
    plan = obfuscate(docs, crypto.key_table(spark, SHORT)).select("plan")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"unhex\(concat\(doc_inner#", plan) and re.search(r"unhex\(concat\(doc_outer#", plan)
