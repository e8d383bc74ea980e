"""The engine's queries over the test tables, each with the DuckDB SQL that gives the same rows.

Labelled texts are built from the columns of ``orders`` by expressions that Spark and DuckDB read
alike, so the expected values are the columns themselves.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocab
from .functions import crypto
from .functions.text import exploded, matches, plain
from .operators import detect, outbound, strategies
from .operators.names import with_clusters
from .operators.obfuscate import entity_counts, obfuscate, over_cores, with_entities
from .operators.resolve import resolve
from .operators.restore import leak_scan, restore
from .plans import audit, vault
from .plans.process import process
from .schema import SPANS, STANDARD_RULES, Policy, Rule
from .sources import pages as page_source
from .sources import rules as rule_source
from .sources import store
from .streaming.sessions import obfuscate_stream, session_windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: The root key of the queries' session: results have to repeat. Real sessions draw theirs.
_ROOT = b"\x11" * 32
SESSION = "s1"


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def keys(spark: SparkSession) -> DataFrame:
    return crypto.key_table(spark, {SESSION: _ROOT})


# --- texts that both engines build ----------------------------------------------------------


def num(expr: str, width: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {width}, '0')"


def case(expr: str, *values: str) -> str:
    return f"CASE {expr} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_LAST = case("o_custkey", "Smith", "Jones", "Garcia", "Keller", "Moreau")
_DOB = f"{num('month(o_orderdate)', 2)} || '/' || {num('day(o_orderdate)', 2)} || '/' || {num('year(o_orderdate)', 4)}"
#: Rule -> what stands before the value, the value, what follows it.
LABELLED = {
    "ssn": ("id ", f"{num('o_orderkey % 1000', 3)} || '-' || {num('o_custkey % 100', 2)} || '-' || {num('o_orderkey % 10000', 4)}", " end"),
    "ssn_labeled": ("SSN: ", num("o_orderkey", 9), " end"),
    "email": ("write to ", "'u' || CAST(o_orderkey AS STRING) || '@mail.example.com'", " now"),
    "phone": ("call ", f"'(415) 555-' || {num('o_orderkey % 10000', 4)}", "."),
    "credit_card": ("card ", f"'4111 1111 ' || {num('o_orderkey % 10000', 4)} || ' ' || {num('o_custkey % 10000', 4)}", " x"),
    "ipv4": ("host ", "'10.' || CAST(o_orderkey % 256 AS STRING) || '.' || CAST(o_custkey % 256 AS STRING) || '.7'", " up"),
    "url": ("see ", "'https://example.com/o/' || CAST(o_orderkey AS STRING)", ", there"),
    "mrn": ("MRN: ", num("o_custkey", 7), " x"),
    "dea": ("DEA No: ", f"'AB' || {num('o_orderkey', 7)}", " x"),
    "npi": ("NPI ", num("o_orderkey", 10), " x"),
    "account": ("Account No: ", num("o_orderkey", 8), " x"),
    "insurance": ("Member ID: ", f"'M' || {num('o_custkey', 8)}", " x"),
    "case_no": ("Docket No: ", f"'2024-' || {num('o_orderkey', 7)}", " x"),
    "name_labeled": ("PATIENT: ", f"'Anna ' || {_LAST}", ", seen"),
    "name_honorific": ("with ", f"'Dr. ' || {_LAST}", " today"),
    "dob": ("Date of Birth: ", _DOB, " x"),
    "date": ("on ", f"{num('year(o_orderdate)', 4)} || '-' || {num('month(o_orderdate)', 2)} || '-' || {num('day(o_orderdate)', 2)}", " it"),
    "age": ("a ", "CAST(18 + o_custkey % 60 AS STRING)", "-year-old"),
    "age_labeled": ("Age: ", "CAST(1 + o_orderkey % 99 AS STRING)", " x"),
    "sex_labeled": ("Gender: ", case("o_orderkey", "female", "male", "non-binary"), " x"),
    "sex_term": ("is a ", case("o_orderkey", "Woman", "man", "transgender"), " here"),
    "ethnicity": ("of ", case("o_custkey", "Han Chinese", "korean", "African American"), " descent"),
    "address": ("at ", f"CAST(1 + o_orderkey % 999 AS STRING) || ' Oak ' || {case('o_custkey', 'Street', 'Avenue', 'Blvd')}", " x"),
    "city_state": ("from ", case("o_custkey", "Denver", "San Jose", "Boston"), ", CO by"),
}
EXTRA = {
    "zip": ("Denver, CO ", num("o_orderkey % 100000", 5), " x", detect.zip_spans),
    "magnitude": ("Badge ", f"'0' || {num('o_orderkey', 6)}", " issued, 100000 copies/mL", detect.number_spans),
    "name_pair": ("met ", f"'Anna ' || {_LAST}", " here, Blood Pressure", detect.pair_spans),
}


def _labelled(spark: SparkSession, sf_dir: str, before: str, value: str, after: str) -> DataFrame:
    return read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"'{before}' || {value} || '{after}' AS text")


def _found(df: DataFrame, spans) -> DataFrame:
    df, text = detect.with_text(df)
    rows = exploded(df.withColumn("_s", spans(text)), "_s", "s", "doc_id")
    return rows.select("doc_id", F.col("s.start").alias("start_pos"), F.col("s.text").alias("value"))


def _register_rules() -> None:
    by_id = {r.id: r for r in STANDARD_RULES}
    for name, (before, value, after, *spans) in {**LABELLED, **EXTRA}.items():
        spans = spans[0] if spans else (lambda t, r=by_id[name]: detect.rule_spans(t, r))
        sql = f"SELECT o_orderkey AS doc_id, {len(before)} AS start_pos, {value} AS value FROM orders"
        query(sql, f"rule_{name}")(lambda spark, d, a=(before, value, after), s=spans: _found(_labelled(spark, d, *a), s))


_register_rules()


def _in_documents(rule: str) -> Query:
    by_id = {r.id: r for r in STANDARD_RULES}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = _found(read(spark, sf_dir, "documents"), lambda t: detect.rule_spans(t, by_id[rule]))
        return found.groupBy("value").agg(F.count(F.lit(1)).alias("n"))

    return run


def _extracted(pattern: str, group: int = 1) -> str:
    found = f"unnest(regexp_extract_all(text, '{pattern}', {group}))"
    return f"SELECT rtrim(v, E' \\t\\n.,;:') AS value, count(*) AS n FROM (SELECT {found} AS v FROM documents) GROUP BY 1 HAVING rtrim(v, E' \\t\\n.,;:') <> ''"


# RE2 knows no Unicode word boundaries: they are spelt out as characters before and after.
_EDGE = r"(?:^|[^\p{L}\p{N}_])"
query(_extracted(_EDGE + r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"), "detect_email")(_in_documents("email"))
query(_extracted(_EDGE + rf"((?:{vocab.OCTET}\.){{3}}{vocab.OCTET})"), "detect_ipv4")(_in_documents("ipv4"))
query(_extracted(r"((?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4})"), "detect_phone")(_in_documents("phone"))
# here the edge may not eat the blank that ends the number before, so \\b serves, on a text in which all
# letters and numbers of other scripts are an x and all else outside ASCII a full stop
_CARD = _extracted(r"\b(?:\d[ -]?){15,16}\b", 0).replace("FROM documents", "FROM (SELECT regexp_replace(regexp_replace(regexp_replace(text, '[\\p{No}\\p{Nl}]', 'x', 'g'), '[\\p{L}]', 'x', 'g'), '[^\\x00-\\x7F]', '.', 'g') AS text FROM documents)")
query(_CARD, "detect_card")(_in_documents("credit_card"))


@query("SELECT doc_id, count(*) AS n, sum(length(v)) AS chars FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS v FROM documents) WHERE length(v) >= 5 OR (v LIKE '0%' AND length(v) >= 3) GROUP BY doc_id")
def magnitude_spans(spark, sf_dir):
    """Bare numbers in documents; none of them has a unit behind it."""
    found = _found(read(spark, sf_dir, "documents"), detect.number_spans)
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


# --- resolution ------------------------------------------------------------------------------

_SPAN_COLUMNS = "l_orderkey, CAST((l_partkey * 7) % 60 AS INT) AS a, CAST((l_partkey * 7) % 60 + 1 + l_suppkey % 9 AS INT) AS b, l_discount AS c, l_linenumber AS o"


@query(f"""
WITH s AS (SELECT l_orderkey, list({{'a': a, 'b': b, 'c': c, 'o': o}} ORDER BY c DESC, b - a DESC, a, o) AS l FROM (SELECT {_SPAN_COLUMNS} FROM lineitem) GROUP BY l_orderkey),
k AS (SELECT l_orderkey, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].a < y.b AND y.a < x[1].b)) > 0 THEN acc ELSE list_concat(acc, x) END, []::STRUCT(a INT, b INT, c DOUBLE, o INT)[]) AS kept
  FROM (SELECT l_orderkey, list_transform(l, lambda z: [z]) AS l FROM s))
SELECT l_orderkey AS doc_id, CAST(len(kept) AS INT) AS n, CAST(list_sum(list_transform(kept, lambda z: z.b - z.a)) AS BIGINT) AS covered FROM k
""")
def resolve_overlaps(spark, sf_dir):
    """Disjoint spans of each order, from intervals made of its lines."""
    rows = read(spark, sf_dir, "lineitem").selectExpr(*_SPAN_COLUMNS.split(", CAST")[:1], *[f"CAST{x}" for x in _SPAN_COLUMNS.split(", l_discount")[0].split(", CAST")[1:]], "l_discount AS c", "l_linenumber AS o")
    span = F.struct(F.col("a").alias("start"), F.col("b").alias("end"), F.lit("GENERIC_ID").alias("entity_type"), F.lit("x").alias("text"), F.col("c").cast("double").alias("confidence"), F.lit("q").alias("source"), F.col("o").cast("int").alias("ord"))
    spans = rows.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(span).cast(SPANS).alias("s"))
    kept = spans.withColumn("k", resolve(F.col("s")))
    total = F.aggregate("k", F.lit(0).cast("bigint"), lambda acc, x: acc + (x["end"] - x["start"]))
    return kept.select("doc_id", F.size("k").alias("n"), total.alias("covered"))


# --- names -----------------------------------------------------------------------------------

_FIRST = case("o_orderkey", "Anna", "Marc", "Elena", "Viktor")
_NAMES = f"'Patient: ' || {_FIRST} || ' ' || {_LAST} || '. Later Mr. ' || {_LAST} || ' came; ' || {_FIRST} || ' left. PS ' || {_LAST} || 'x stays.'"


@query(f"""
WITH n AS (SELECT o_orderkey AS doc_id, {_FIRST} AS f, {_LAST} AS l FROM orders)
SELECT doc_id, 9 AS start_pos, f || ' ' || l AS value, 'name_0' AS cluster_id, f || ' ' || l AS canonical FROM n UNION ALL
SELECT doc_id, 9 + length(f || ' ' || l) + 12, l, 'name_0', f || ' ' || l FROM n UNION ALL
SELECT doc_id, 9 + length(f || ' ' || l) + 12 + length(l) + 7, f, 'name_0', f || ' ' || l FROM n
""")
def cluster_names(spark, sf_dir):
    """Mentions of one person, found by propagation and linked to the full name."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{_NAMES} AS text")
    found = exploded(with_entities(rows), "entities", "e", "doc_id").where("e.entity_type = 'NAME'")
    return found.select("doc_id", F.col("e.start").alias("start_pos"), F.col("e.text").alias("value"), F.col("e.cluster_id").alias("cluster_id"), F.col("e.canonical").alias("canonical"))


@query(f"SELECT o_orderkey AS doc_id, {_FIRST} || ' ' || {_LAST} AS canonical, 4 AS mentions FROM orders")
def canonical_topk(spark, sf_dir):
    """The canonical mention of a cluster: most words, then most characters, then the first."""
    row = "named_struct('start', {s}, 'end', {s} + 1, 'entity_type', 'NAME', 'text', {t}, 'confidence', 1D, 'source', 'q', 'ord', {s})"
    texts = [f"'Dr. ' || {_LAST}", f"{_FIRST}", f"{_FIRST} || ' ' || {_LAST}", f"{_LAST} || ' ' || {_FIRST}"]
    spans = "array(" + ", ".join(row.format(s=i, t=t) for i, t in enumerate(texts)) + ")"
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"CAST({spans} AS {SPANS.replace('start:', 'start: ')}) AS s")
    rows = exploded(with_clusters(rows, "s", "entities"), "entities", "e", "doc_id")
    return rows.groupBy("doc_id", F.col("e.canonical").alias("canonical")).agg(F.count(F.lit(1)).cast("int").alias("mentions"))


# --- routing, strategies, digests ------------------------------------------------------------


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_STRICT = Policy(preserve_sex=False, overrides={"EMAIL": "REDACT", "PHONE": "PSEUDONYMIZE"})


@query(f"SELECT * FROM (VALUES {_values(sorted((t, vocab.DATA_CLASS[t], 'REDACT' if t == 'EMAIL' else 'PSEUDONYMIZE' if t == 'PHONE' else 'GENERALIZE' if t in ('ZIP', 'DOB', 'DATE') else 'PRESERVE' if t in ('AGE', 'ETHNICITY') else 'TOKENIZE', 'REDACT') for t in vocab.ENTITY_TYPES))}) AS t(entity_type, data_class, action, unsure)")
def route_actions(spark, sf_dir):
    """Class and action of every type under a policy with overrides, and below the confidence threshold."""
    rows = strategies.data_class_table(spark).join(strategies.routing_table(spark, _STRICT).withColumnRenamed("action", "listed"), "entity_type", "left")
    kind = F.col("entity_type")
    return rows.select("entity_type", strategies.data_class(kind).alias("data_class"), strategies.action(kind, F.lit(0.9), _STRICT).alias("action"), strategies.action(kind, F.lit(0.3), _STRICT).alias("unsure"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 100 >= 90 THEN '[redacted]' WHEN o_custkey % 100 <= 5 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE strftime(o_orderdate, '%Y') END AS date_out, '[redacted]' AS short_out FROM orders")
def generalize_dates(spark, sf_dir):
    """Years of dates, by the age of the patient; two-digit years are redacted."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{_DOB} AS d", "CAST(o_custkey % 100 AS INT) AS age")
    return rows.select("doc_id", strategies.generalize_date(F.col("d"), F.col("age"), Policy()).alias("date_out"), strategies.generalize_date(F.lit("1/2/85"), F.lit(40), Policy()).alias("short_out"))


@query(f"SELECT o_orderkey AS doc_id, CASE WHEN substr({num('(o_orderkey * 37) % 100000', 5)}, 1, 3) IN ({', '.join(repr(z) for z in vocab.SMALL_ZIP3)}) THEN '000XX' ELSE substr({num('(o_orderkey * 37) % 100000', 5)}, 1, 3) || 'XX' END AS zip3 FROM orders")
def zip3(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{num('(o_orderkey * 37) % 100000', 5)} || '-1234' AS z")
    return rows.select("doc_id", strategies.generalize_zip(F.col("z")).alias("zip3"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 120 >= 90 THEN '90+' ELSE CAST(c_custkey % 120 - c_custkey % 5 AS VARCHAR) || '-' || CAST(c_custkey % 120 - c_custkey % 5 + 4 AS VARCHAR) END AS band, CASE WHEN c_custkey % 120 >= 90 THEN '90+' ELSE CAST(c_custkey % 120 AS VARCHAR) END AS exact FROM customer")
def age_band(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", "CAST(c_custkey % 120 AS STRING) AS a")
    return rows.select("c_custkey", strategies.generalize_age(F.col("a"), Policy(age_mode="band")).alias("band"), strategies.generalize_age(F.col("a"), Policy()).alias("exact"))


def _duck_hmac(inner: str, outer: str, message: str) -> str:
    return f"sha256(unhex({outer} || sha256(unhex({inner} || {message}))))"


def _duck_pad(key: str, byte: int) -> str:
    octet = f"xor(CAST('0x' || substr({key}, 2 * i + 1, 2) AS INT), {byte})"
    return f"(array_to_string(list_transform(range(0, 32), lambda i: lpad(lower(hex({octet})), 2, '0')), '') || '{f'{byte:02x}' * 32}')"


def _duck_digests(table: str, doc: str, columns: str) -> str:
    """CTE ``p`` over ``table`` with doc_inner and doc_outer."""
    inner, outer = crypto.pads(crypto.extract(crypto.hkdf(_ROOT, b"veil/token/1")))
    key = _duck_hmac(f"'{inner}'", f"'{outer}'", f"hex(encode('veil/doc/' || {doc})) || '01'")
    return f"k AS (SELECT *, {key} AS kd FROM (SELECT {columns} FROM {table})), p AS (SELECT *, {_duck_pad('kd', 0x36)} AS doc_inner, {_duck_pad('kd', 0x5C)} AS doc_outer FROM k)"


def _duck_token(tag: str, value: str) -> str:
    return f"('[{tag}_' || substr({_duck_hmac('doc_inner', 'doc_outer', f'hex(encode({value}))')}, 1, 12) || ']')"


@query(f"WITH {_duck_digests('customer', 'doc_id', 'c_custkey, c_name, CAST(c_custkey % 7 AS VARCHAR) AS doc_id')} SELECT c_custkey, {_duck_hmac('doc_inner', 'doc_outer', 'hex(encode(c_name))')} AS digest, {_duck_token('NAME', 'c_name')} AS token FROM p")
def hmac_digest(spark, sf_dir):
    """Digests and tokens under the keys of documents."""
    rows = read(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "CAST(c_custkey % 7 AS STRING) AS doc_id", f"'{SESSION}' AS session_id")
    keyed = crypto.with_document_pads(crypto.with_keys(rows, keys(spark), "prk_inner", "prk_outer"))
    digest = crypto.digest(F.col("c_name"))
    return keyed.select("c_custkey", digest.alias("digest"), crypto.token(F.lit("NAME"), digest).alias("token"))


@query("SELECT CAST(count(*) AS INT) AS values_n, CAST(count(DISTINCT c_custkey) AS INT) AS per_document, 0 AS shared, 0 AS across FROM customer")
def tokens_deterministic(spark, sf_dir):
    """The tokens of all customers' numbers in two documents and two sessions: one for each value in
    each, and none that two share."""
    two = crypto.key_table(spark, {SESSION: _ROOT, "s2": b"\x12" * 32})
    places = [("a", SESSION), ("b", SESSION), ("c", "s2")]
    made = None
    for name, session in places:
        rows = read(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS STRING) AS v", f"'{session}' AS session_id").withColumn("doc_id", F.lit("b" if name == "b" else "a"))
        keyed = crypto.with_document_pads(crypto.with_keys(rows, two, "prk_inner", "prk_outer", spread="v"))
        one = keyed.select("v", crypto.token(F.lit("SSN"), crypto.digest(F.col("v"))).alias(f"t_{name}"))
        made = one if made is None else made.join(one, "v")
    same = lambda x, y: F.sum((F.col(x) == F.col(y)).cast("int")).cast("int")
    return made.agg(F.count(F.lit(1)).cast("int").alias("values_n"), F.countDistinct("t_a").cast("int").alias("per_document"), same("t_a", "t_b").alias("shared"), same("t_a", "t_c").alias("across"))


# --- the outbound core -----------------------------------------------------------------------

_ACCOUNT, _EMAIL, _BADGE = LABELLED["account"][1], LABELLED["email"][1], EXTRA["magnitude"][1]
_NOTE = f"'Account No: ' || {_ACCOUNT} || ' Email: ' || {_EMAIL} || ' DOB: ' || {_DOB} || ' from Denver, CO 80203 with badge ' || {_BADGE} || ' and ' || {_EMAIL} || ' again'"
_NOTE_COLUMNS = f"o_orderkey, CAST(o_orderkey AS VARCHAR) AS doc_id, {_ACCOUNT} AS acc, {_EMAIL} AS mail, {_BADGE} AS badge, strftime(o_orderdate, '%Y') AS y"
_OUT = f"'Account No: ' || {_duck_token('ACCOUNT', 'acc')} || ' Email: ' || {_duck_token('EMAIL', 'mail')} || ' DOB: ' || y || ' from ' || {_duck_token('ADDRESS', chr(39) + 'Denver' + chr(39))} || ', CO 802XX with badge ' || {_duck_token('GENERIC_ID', 'badge')} || ' and ' || {_duck_token('EMAIL', 'mail')} || ' again'"


def notes(spark: SparkSession, sf_dir: str, text: str = _NOTE) -> DataFrame:
    return over_cores(read(spark, sf_dir, "orders").selectExpr(f"'{SESSION}' AS session_id", "CAST(o_orderkey AS STRING) AS doc_id", f"{text} AS text"))


@query(f"WITH {_duck_digests('orders', 'doc_id', _NOTE_COLUMNS)} SELECT doc_id, {_OUT} AS obfuscated_text, 6 AS known FROM p", "obfuscate")
def obfuscate_notes(spark, sf_dir):
    """Notes with tokens, years and ZIP prefixes in the place of their values."""
    out = obfuscate(notes(spark, sf_dir), keys(spark))
    return out.select("doc_id", "obfuscated_text", F.size("known_originals").alias("known"))


@query(f"WITH {_duck_digests('orders', 'doc_id', _NOTE_COLUMNS)} SELECT doc_id, {_OUT} AS obfuscated_text, false AS route_to_human, 7 AS entities FROM p")
def obfuscate_streaming(spark, sf_dir):
    """The same plan over a stream: notes arrive as files and leave as a table."""
    import uuid

    folder = _folder(spark, "stream")
    notes(spark, sf_dir).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("session_id string, doc_id string, text string").parquet(f"{folder}/in")
    out = obfuscate_stream(stream, keys(spark)).drop("session_id")
    writer = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{uuid.uuid4().hex}").trigger(availableNow=True)
    writer.start(f"{folder}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def _checkpoints(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(_folder(spark, "checkpoints"))


@query("SELECT 'ACCOUNT' AS entity_type, count(*) AS n FROM orders UNION ALL SELECT 'ADDRESS', count(*) FROM orders UNION ALL SELECT 'DOB', count(*) FROM orders UNION ALL SELECT 'EMAIL', 2 * count(*) FROM orders UNION ALL SELECT 'GENERIC_ID', count(*) FROM orders UNION ALL SELECT 'ZIP', count(*) FROM orders", "entity_counts")
def entity_count_query(spark, sf_dir):
    return entity_counts(with_entities(notes(spark, sf_dir)).withColumn("g", F.lit(1)), ["g"]).drop("g")


@query()
def obfuscate_documents(spark, sf_dir):
    """All documents through the outbound core."""
    rows = over_cores(read(spark, sf_dir, "documents").select(F.lit(SESSION).alias("session_id"), F.col("doc_id").cast("string").alias("doc_id"), "text"))
    out = obfuscate(rows, keys(spark))
    return out.select("doc_id", "obfuscated_text", F.size("entities").alias("entities"), F.size("known_originals").alias("known"))


@query()
def leak_check(spark, sf_dir):
    """Known originals that obfuscated documents still hold, tokens aside: a value that is found by its
    surroundings in one place may stand without them in another. The gate blocks such documents."""
    rows = over_cores(read(spark, sf_dir, "documents").select(F.lit(SESSION).alias("session_id"), F.col("doc_id").cast("string").alias("doc_id"), "text"))
    out = obfuscate(rows, keys(spark))
    bare = F.regexp_replace("obfuscated_text", vocab.TOKEN, " ")
    return out.select(F.size(outbound.leaks(bare, F.col("known_originals"))).alias("l")).agg(F.coalesce(F.sum(F.when(F.col("l") > 0, F.col("l")).otherwise(0)), F.lit(0)).cast("int").alias("leaks"), F.count(F.lit(1)).alias("documents"))


@query(f"SELECT o_orderkey AS doc_id, o_orderkey % 3 = 0 AS blocked, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS scanned FROM orders")
def verify_gate(spark, sf_dir):
    """Payloads that hold an original are blocked; an original inside a longer word is none."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"CASE WHEN o_orderkey % 3 = 0 THEN {_EMAIL} || ' and Johnson' ELSE 'Johnson of [EMAIL_0123456789ab]' END AS payload", f"array('John', {_EMAIL}) AS known_originals", f"{_EMAIL} AS text")
    scanned = F.size(leak_scan(F.col("text"), F.col("payload"), (r"[a-z0-9]+@[a-z.]+",)))
    return outbound.verify(rows).select("doc_id", "blocked", scanned.alias("scanned"))


@query("SELECT doc_id, sha256(text) AS joined, true AS fits FROM documents WHERE text IS NOT NULL")
def chunk_documents(spark, sf_dir):
    """Texts in chunks of 500 characters, joined again."""
    rows = read(spark, sf_dir, "documents").where("text is not null").withColumn("c", outbound.chunks(F.col("text"), 500))
    return rows.select("doc_id", F.sha2(F.array_join("c", "").cast("binary"), 256).alias("joined"), F.forall("c", lambda x: (F.char_length(x) <= 500) & (x != "")).alias("fits"))


_TOK = "'[SSN_' || substr(md5(CAST(o_orderkey AS STRING)), 1, 12) || ']'"
_TOK2 = "'[INSURANCE_ID_' || substr(md5(CAST(o_custkey AS STRING)), 1, 12) || ']'"


@query(f"SELECT o_orderkey AS doc_id, '[mock summary] Reviewed the de-identified record for ' || {_TOK} || '. The task was: Sum up. All placeholder tokens are preserved verbatim for restoration: ' || {_TOK} || ' ' || {_TOK2} || '.' AS reply FROM orders")
def mock_reply(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"{_TOK} || ' a ' || {_TOK2} || ' b ' || {_TOK} AS t")
    return rows.select("doc_id", outbound.mock_reply(F.lit(""), outbound.context(F.col("t")), F.lit(" Sum up. ")).alias("reply"))


# --- vault, restore, process -----------------------------------------------------------------

_PLAIN_NOTE = f"'Account No: ' || {_ACCOUNT} || ' Email: ' || {_EMAIL} || ' with badge ' || {_BADGE} || ' of (' || {_LAST} || ')'"


def _planned(spark: SparkSession, sf_dir: str, text: str = _PLAIN_NOTE, policy: Policy | None = None) -> DataFrame:
    _checkpoints(spark)
    return obfuscate(notes(spark, sf_dir, text), keys(spark), policy).checkpoint()


@query(f"SELECT '{SESSION}' AS session_id, 'ACCOUNT' AS entity_tag, {_ACCOUNT} AS original FROM orders UNION ALL SELECT '{SESSION}', 'EMAIL', {_EMAIL} FROM orders UNION ALL SELECT '{SESSION}', 'GENERIC_ID', {_BADGE} FROM orders")
def vault_upsert(spark, sf_dir):
    """The vault after two writes of the same entries, opened."""
    planned = _planned(spark, sf_dir)
    first = vault.entries(planned, keys(spark)).checkpoint()
    second = vault.upsert(first, vault.entries(planned, keys(spark)).checkpoint())
    return vault.opened(first.union(second), keys(spark)).select("session_id", "entity_tag", "original")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, {_PLAIN_NOTE} AS restored, 3 AS tokens_restored, true AS clean FROM orders")
def restore_round_trip(spark, sf_dir):
    """Obfuscated notes, with tokens in lower case, restored to what they were."""
    planned = _planned(spark, sf_dir)
    entries = vault.entries(planned, keys(spark)).checkpoint()
    lower = F.regexp_replace(F.col("obfuscated_text"), r"\[ACCOUNT_", "[account_")
    replies = planned.select("session_id", "doc_id", lower.alias("reply"))
    return restore(replies, vault.opened(entries, keys(spark))).select("doc_id", "restored", "tokens_restored", "clean")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'see [redacted]' AS restored, 'SSN' AS missed, false AS clean FROM orders")
def vault_misses(spark, sf_dir):
    """Tokens that the vault of the session does not have."""
    replies = read(spark, sf_dir, "orders").selectExpr(f"'{SESSION}' AS session_id", "CAST(o_orderkey AS STRING) AS doc_id", f"'see ' || {_TOK} AS reply")
    other = spark.createDataFrame([("s2", "[SSN_000000000000]", "x")], "session_id string, surface string, original string")
    return restore(replies, other).select("doc_id", "restored", F.array_join("vault_misses", ",").alias("missed"), "clean")


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, {_PLAIN_NOTE} AS restored, true AS changed FROM orders", "pseudonym_round_trip")
def pseudonym_round_trip(spark, sf_dir):
    """Pseudonyms in the place of e-mail addresses, restored; sessions of eight documents each, so a
    reply meets pseudonyms of others."""
    policy = Policy(overrides={"EMAIL": "PSEUDONYMIZE"})
    few = over_cores(read(spark, sf_dir, "orders").selectExpr("'s' || CAST(o_orderkey % 32 AS STRING) || '-' || CAST(FLOOR(o_orderkey / 256) AS STRING) AS session_id", "CAST(o_orderkey AS STRING) AS doc_id", f"{_PLAIN_NOTE} AS text", f"{_EMAIL} AS mail"))
    _checkpoints(spark)
    inner = keys(spark).withColumnRenamed("session_id", "_s")
    each = few.select("session_id").distinct().join(F.broadcast(inner), F.lit(SESSION) == F.col("_s")).drop("_s").checkpoint()  # one key for all sessions of the test
    planned = obfuscate(few, each, policy).checkpoint()
    entries = vault.entries(planned, each).checkpoint()
    back = restore(planned.select("session_id", "doc_id", F.col("obfuscated_text").alias("reply"), "mail", "obfuscated_text"), vault.opened(entries, each), True)
    return back.select("doc_id", "restored", (~F.contains("obfuscated_text", F.col("mail"))).alias("changed"))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, o_custkey % 10 <= 5 AS routed_to_human, CASE WHEN o_custkey % 10 > 5 THEN 2 END AS tokens_restored, CASE WHEN o_custkey % 10 > 5 THEN true END AS clean, CASE WHEN o_custkey % 10 > 5 THEN '[mock summary] Reviewed the de-identified record for ' || {_ACCOUNT} || '. The task was: Sum up. All placeholder tokens are preserved verbatim for restoration: ' || {_ACCOUNT} || '.' END AS restored FROM orders", "process")
def process_notes(spark, sf_dir):
    """The round trip; documents of young children are for a human and never sent."""
    _checkpoints(spark)
    text = f"'Age: ' || CAST(o_custkey % 10 AS STRING) || ' Account No: ' || {_ACCOUNT}"
    return process(notes(spark, sf_dir, text), keys(spark), "Sum up.").select("doc_id", "routed_to_human", "tokens_restored", "clean", "restored")


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 100 AS INT) END AS age FROM orders")
def first_age_window(spark, sf_dir):
    """The first age of a document, as a window over its spans."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", "CASE WHEN o_custkey % 4 = 0 THEN 'none' ELSE 'Age: ' || CAST(o_custkey % 100 AS STRING) || ' then age: 44' END AS text")
    found = detect.with_spans(rows).select("doc_id", F.explode_outer("spans").alias("s"))
    ages = found.where("s.entity_type = 'AGE'").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("s.start"))).where("k = 1")
    return rows.select("doc_id").join(ages.select("doc_id", F.regexp_extract("s.text", r"\d{1,3}", 0).cast("int").alias("age")), "doc_id", "left")


@query("SELECT page_id, length(trim(coalesce(html, ''), E' \\t\\n\\r')) < 20 AS quarantined FROM pages UNION ALL SELECT -page_id - 1, true FROM pages")
def page_quarantine(spark, sf_dir):
    """Pages without enough text are for a human."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    blank = rows.select((-F.col("page_id") - 1).alias("page_id"), F.lit(" \n few ").alias("text"))
    return page_source.quarantine(rows.union(blank)).select("page_id", "quarantined")


@query("SELECT o_orderkey AS doc_id, 'u' || CAST(o_custkey % 20 AS VARCHAR) AS user_id, " + f"{_ACCOUNT} AS text, NULL AS error FROM orders UNION ALL SELECT -1, 'u0', NULL, 'missing'")
def store_round_trip(spark, sf_dir):
    """Documents written to the encrypted store and read back, and one that is not there."""
    path, masters = _folder(spark, "store"), store.master_table(spark, bytes(range(32)))
    docs = read(spark, sf_dir, "orders").selectExpr("'u' || CAST(o_custkey % 20 AS STRING) AS user_id", "CAST(o_orderkey AS STRING) AS doc_id", f"{_ACCOUNT} AS text")
    store.put(docs, masters, path)
    missing = spark.createDataFrame([("u0", "-1")], "user_id string, doc_id string")
    got = store.get(docs.select("user_id", "doc_id").union(missing), masters, path)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "user_id", "text", "error")


@query("SELECT c AS data_class, t AS entity_type, a AS action, CAST(k * (SELECT count(*) FROM orders) AS BIGINT) AS n FROM (VALUES ('FINANCIAL', 'ACCOUNT', 'TOKENIZE', 1), ('FINANCIAL', 'ACCOUNT', NULL, 1), ('FINANCIAL', NULL, NULL, 1), ('PII', 'ADDRESS', 'TOKENIZE', 1), ('PII', 'ADDRESS', NULL, 1), ('PII', 'DOB', 'GENERALIZE', 1), ('PII', 'DOB', NULL, 1), ('PII', 'EMAIL', 'TOKENIZE', 2), ('PII', 'EMAIL', NULL, 2), ('PII', 'GENERIC_ID', 'TOKENIZE', 1), ('PII', 'GENERIC_ID', NULL, 1), ('PII', 'ZIP', 'GENERALIZE', 1), ('PII', 'ZIP', NULL, 1), ('PII', NULL, NULL, 6), (NULL, NULL, NULL, 7)) AS v(c, t, a, k)")
def data_class_rollup(spark, sf_dir):
    """Audit events by class, type and action, with subtotals."""
    return audit.summary(audit.events(obfuscate(notes(spark, sf_dir), keys(spark))))


def _duck_event(kind: str, act: str, rule: str, value: str, has_token: bool) -> str:
    digest = _duck_hmac("doc_inner", "doc_outer", f"hex(encode({value}))")
    token = f"'\"' || {_duck_token(kind, value)} || '\"'" if has_token else "'null'"
    head = f'{{"action":"{act}","entity_type":"{kind}","policy_version":"v1","ref":"'
    return f"SELECT '{head}' || substr({digest}, 1, 8) || '\",\"rule\":\"{rule}\",\"session_id\":\"{SESSION}\",\"token\":' || {token} || ',\"ts\":0.0}}' AS value FROM p"


_EVENTS = [("ACCOUNT", "TOKENIZE", "rule:account", "acc", True), ("EMAIL", "TOKENIZE", "rule:email", "mail", True), ("EMAIL", "TOKENIZE", "rule:email", "mail", True), ("DOB", "GENERALIZE", "rule:dob", "dob", False), ("ADDRESS", "TOKENIZE", "rule:city_state", "'Denver'", True), ("ZIP", "GENERALIZE", "magnitude", "'80203'", False), ("GENERIC_ID", "TOKENIZE", "magnitude", "badge", True)]


@query(f"WITH {_duck_digests('orders', 'doc_id', _NOTE_COLUMNS + f', {_DOB} AS dob')} " + " UNION ALL ".join(_duck_event(*e) for e in _EVENTS))
def audit_events(spark, sf_dir):
    """All events as JSON lines, as they are appended to the trail: types, actions and tokens, and no
    original."""
    return audit.json_lines(audit.events(obfuscate(notes(spark, sf_dir), keys(spark)), now=F.lit(0)))


_FIRST_ACCOUNT, _SECOND_ACCOUNT = _ACCOUNT, f"'X' || {num('o_custkey', 7)}"


def _mocked(account: str) -> str:
    return f"'[mock summary] Reviewed the de-identified record for ' || {account} || '. The task was: Sum up. All placeholder tokens are preserved verbatim for restoration: ' || {account} || '.'"


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 4 AS tokens_restored, true AS clean, {_mocked(_FIRST_ACCOUNT)} || chr(10) || {_mocked(_SECOND_ACCOUNT)} AS restored FROM orders")
def process_chunks(spark, sf_dir):
    """The round trip of notes that are sent in two chunks each; replies come back in their order."""
    _checkpoints(spark)
    text = f"'Account No: ' || {_FIRST_ACCOUNT} || ' is open and in use. Account No: ' || {_SECOND_ACCOUNT} || ' is closed for good.'"
    return process(notes(spark, sf_dir, text), keys(spark), "Sum up.", limit=60).select("doc_id", "tokens_restored", "clean", "restored")


_HIDDEN = {"ssn": LABELLED["ssn"][1], "account": _ACCOUNT, "email": _EMAIL, "phone": LABELLED["phone"][1], "card": LABELLED["credit_card"][1], "case": LABELLED["case_no"][1], "name": f"{_FIRST} || ' ' || {_LAST}"}
_KEPT = ("HIV-1 RNA 100000 copies/mL", "blood pressure 120/80 mmHg", "dose 500 mg")
_FULL_NOTE = " || ' ' || ".join(["'Patient: '", f"{_HIDDEN['name']} || ', SSN'", _HIDDEN["ssn"], "'Account No: '", _HIDDEN["account"], "'reach'", _HIDDEN["email"], "'or'", f"{_HIDDEN['phone']} || ', card'", f"{_HIDDEN['card']} || '; Docket No:'", f"{_HIDDEN['case']} || '.'", *[f"'{k};'" for k in _KEPT], f"'Later Mr. ' || {_LAST} || ' left.'"])


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 0 AS leaks, {len(_KEPT)} AS kept, false AS blocked FROM orders")
def leak_notes(spark, sf_dir):
    """Notes with a list of what must be hidden and of what must stay: nothing of the first is left,
    all of the second is."""
    rows = read(spark, sf_dir, "orders").selectExpr(f"'{SESSION}' AS session_id", "CAST(o_orderkey AS STRING) AS doc_id", f"{_FULL_NOTE} AS text", f"array({', '.join([*_HIDDEN.values(), _LAST])}) AS hidden")
    out = obfuscate(over_cores(rows), keys(spark))
    # named inside one array: in the filter's lambda the tokens would be taken out anew for each value
    bare = F.array(F.regexp_replace("obfuscated_text", vocab.TOKEN, " "))
    left = F.get(F.transform(bare, lambda b: F.size(F.filter("hidden", lambda h: F.contains(b, h)))), F.lit(0))
    kept = sum(F.contains("obfuscated_text", F.lit(k)).cast("int") for k in _KEPT)
    gate = outbound.verify(out.withColumn("payload", outbound.payload(F.lit(outbound.SYSTEM), outbound.context(F.col("obfuscated_text")), F.lit("Sum up."))))
    return gate.select("doc_id", left.alias("leaks"), kept.alias("kept"), "blocked")


# --- rules, sessions -------------------------------------------------------------------------

_CUSTOM = {"rules": [
    {"id": "project", "entity_type": "GENERIC_ID", "regex": r"PRJ-\d{4}", "confidence": 0.99},
    {"id": "bad", "regex": "("}, {"name": "no id"}, {"id": "odd", "entity_type": "NOPE", "regex": "ODD[0-9]+"},
    {"id": "loose"}, {"id": "nested", "regex": "(a|b)+c"}, {"id": "off", "regex": "zzz", "enabled": False},
]}


def _custom(spark: SparkSession) -> list[Rule]:
    path = _folder(spark, "rules")
    spark.createDataFrame([(json.dumps(_CUSTOM),)], "value string").coalesce(1).write.text(path)
    return rule_source.load(spark, path)


@query("SELECT * FROM (VALUES ('project', 'GENERIC_ID', 0.99, true), ('odd', 'GENERIC_ID', 0.8, true), ('off', 'GENERIC_ID', 0.8, false)) AS t(id, entity_type, confidence, enabled)".replace("0.99", "CAST(0.99 AS DOUBLE)").replace(" 0.8,", " CAST(0.8 AS DOUBLE),"))
def rules_custom(spark, sf_dir):
    """Custom rules from JSON: those that cannot be used are left out."""
    return rule_source.table(spark, _custom(spark)).where("source = 'custom'").select("id", "entity_type", "confidence", "enabled")


_LISTED = [*[(r.id, r.name, r.entity_type, "standard", None, None) for r in STANDARD_RULES], ("project", "project", "GENERIC_ID", "custom", r"PRJ-\d{4}", True), ("odd", "odd", "GENERIC_ID", "custom", "ODD[0-9]+", True), ("off", "off", "GENERIC_ID", "custom", "zzz", False)]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" for x in r) + ")" for r in _LISTED) + ") AS t(id, name, entity_type, source, regex, enabled)")
def rules_list(spark, sf_dir):
    """The report of rules: custom ones whole, standard ones by id, name and type."""
    return rule_source.listing(rule_source.table(spark, _custom(spark))).select("id", "name", "entity_type", "source", "regex", "enabled")


@query(f"SELECT o_orderkey AS doc_id, 4 AS start_pos, 'PRJ-' || {num('o_orderkey % 10000', 4)} AS value, 'rule:project' AS source FROM orders")
def custom_rules(spark, sf_dir):
    """A custom rule's spans among those of the standard rules."""
    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"'Ref PRJ-' || {num('o_orderkey % 10000', 4)} || ' filed.' AS text")
    found = exploded(with_entities(rows, detect.native(_custom(spark))), "entities", "e", "doc_id")
    return found.select("doc_id", F.col("e.start").alias("start_pos"), F.col("e.text").alias("value"), F.col("e.source").alias("source"))


@query("WITH n AS (SELECT max(ts) AS t FROM events), s AS (SELECT user_id, min(ts) + INTERVAL 20 DAY AS e FROM events GROUP BY user_id) SELECT CASE WHEN e <= t THEN 'DESTROYED' ELSE 'ACTIVE' END AS state, count(*) AS n FROM s, n GROUP BY 1")
def session_expiry(spark, sf_dir):
    """Sessions whose time to live is over at the last event are destroyed."""
    events = read(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    rows = events.groupBy(F.col("user_id").cast("string").alias("session_id")).agg(F.min("ts").alias("created_at"))
    sessions = rows.withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 20 DAYS")).withColumn("state", F.lit("ACTIVE"))
    return vault.reap(sessions, now).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH n AS (SELECT max(ts) AS t FROM events), s AS (SELECT user_id, min(ts) + INTERVAL 20 DAY AS e FROM events GROUP BY user_id),
r AS (SELECT user_id, CASE WHEN e <= t THEN 'DESTROYED' WHEN user_id % 5 = 0 THEN CASE WHEN user_id % 2 = 0 AND user_id % 3 <> 0 THEN 'DRAINING' ELSE 'DESTROYED' END ELSE 'ACTIVE' END AS state FROM s, n)
SELECT r.state, count(DISTINCT r.user_id) AS sessions, CAST(count(*) FILTER (r.state <> 'ACTIVE') AS BIGINT) AS refused FROM r JOIN events USING (user_id) GROUP BY r.state
""")
def session_lifecycle(spark, sf_dir):
    """Sessions that expire, drain while requests are open, and go after the timeout; requests of all but
    the active ones are refused."""
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), "user_id", "ts")
    now = F.lit(events.agg(F.max("ts")).first()[0])
    rows = events.groupBy("session_id", "user_id").agg(F.min("ts").alias("created_at"))
    sessions = rows.withColumn("expires_at", F.col("created_at") + F.expr("INTERVAL 20 DAYS")).withColumn("state", F.lit("ACTIVE"))
    sessions = vault.reap(sessions, now)
    begun = F.when(F.col("user_id") % 3 == 0, now - F.expr("INTERVAL 1 MINUTE")).otherwise(now)
    sessions = vault.drain(sessions, F.col("user_id") % 5 == 0, begun)
    busy = events.where("user_id % 2 = 0").select("session_id")
    sessions = vault.drained(sessions, busy, now)
    refused = vault.refused(events.select("session_id", "ts"), sessions, now).groupBy("session_id").agg(F.count(F.lit(1)).alias("refused"))
    told = sessions.join(refused, "session_id", "left").groupBy("state")
    return told.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum("refused"), F.lit(0)).alias("refused"))


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e)
SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM g GROUP BY user_id, k
""", "session_windows")
def session_window_query(spark, sf_dir):
    """Sessions of activity with gaps of six hours."""
    return session_windows(read(spark, sf_dir, "events"), "6 hours")


@query(f"SELECT o_orderkey AS doc_id, 1 AS tokens, 0 AS after FROM orders")
def token_residue(spark, sf_dir):
    """Tokens with underscores in their tags are seen and redacted by the guard."""
    from .operators.restore import guard

    rows = read(spark, sf_dir, "orders").selectExpr("o_orderkey AS doc_id", f"'a ' || {_TOK2} AS t")
    _, safe = guard(F.col("t"))
    count = lambda c: F.size(matches(plain(c), f"(?<anc>)(?<val>{vocab.TOKEN})"))
    return rows.select("doc_id", count(F.col("t")).alias("tokens"), count(safe).alias("after"))
