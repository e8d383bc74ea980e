"""The outbound core: detect, resolve, propagate, cluster, route, replace. All of it is row-local
expressions and a join with the sessions' keys, broadcast as long as they are small: documents are
not shuffled, and batch and stream do not differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions import crypto
from ..functions.text import exploded, splice
from ..schema import Policy
from .detect import Detector, native, with_text, without_text
from .names import needles, propagate, with_clusters
from .resolve import resolve, without_labels
from .strategies import REVERSIBLE, STRATEGIES, Strategy, action

PLAN = (
    "array<struct<start:int,end:int,replacement:string,entity_type:string,action:string,original:string,"
    "canonical:string,vault_key:string,token:string,ref:string,source:string>>"
)


def over_cores(scan: DataFrame) -> DataFrame:
    """A table just read, dealt to all cores if it has fewer parts than there are: detection costs far
    more than the deal. Large tables have more parts and stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def with_entities(df: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``df`` (text) with ``entities``: disjoint spans with clusters, sorted by start."""
    df, text = with_text(df)
    df = df.withColumn("_spans", (detector or native())(text)).withColumn("_kept", without_labels(resolve(F.col("_spans"))))
    full, parts = needles(F.col("_kept"))
    df = df.withColumn("_full", full).withColumn("_parts", parts)
    # a column of its own: resolving names it several times, and each mention would look for all names again
    df = df.withColumn("_all", propagate(text.plain, F.col("_kept"), F.col("_full"), F.col("_parts"))).withColumn("_disjoint", resolve(F.col("_all")))
    return without_text(with_clusters(df, "_disjoint", "entities")).drop("_spans", "_kept", "_full", "_parts", "_all", "_disjoint")


def patient_age(entities: Column) -> Column:
    """The number in the first AGE span that has one."""
    ages = F.filter(F.transform(F.filter(entities, lambda e: e["entity_type"] == "AGE"), lambda e: F.regexp_extract(e["text"], r"\d{1,3}", 0)), lambda a: a != "")
    return F.get(ages, F.lit(0)).cast("int")


def _with_plan(df: DataFrame, policy: Policy, strategies: dict[str, Strategy]) -> DataFrame:
    def route(e: Column) -> Column:
        canonical = F.coalesce(e["canonical"], e["text"])
        return F.struct(e.alias("e"), action(e["entity_type"], e["confidence"], policy).alias("todo"), canonical.alias("canonical"))

    def digested(x: Column) -> Column:
        return F.struct(x["e"].alias("e"), x["todo"].alias("todo"), x["canonical"].alias("canonical"), crypto.digest(x["canonical"]).alias("digest"))

    def replaced(x: Column) -> Column:
        out = F.lit(vocab.REDACTED)
        for name, strategy in strategies.items():
            out = F.when(x["todo"] == name, strategy(x["e"]["entity_type"], x["canonical"], x["digest"], F.col("patient_age"), policy)).otherwise(out)
        return F.struct(x.alias("x"), out.alias("out"))

    def planned(p: Column) -> Column:
        x, todo = p["x"], p["x"]["todo"]
        return F.struct(
            x["e"]["start"].alias("start"),
            x["e"]["end"].alias("end"),
            p["out"].alias("replacement"),
            x["e"]["entity_type"].alias("entity_type"),
            todo.alias("action"),
            x["e"]["text"].alias("original"),
            x["canonical"].alias("canonical"),
            F.when(todo.isin(list(REVERSIBLE)), p["out"]).alias("vault_key"),
            F.when(todo == "TOKENIZE", p["out"]).alias("token"),
            F.when(todo.isin(list(strategies)), F.substring(x["digest"], 1, 8)).alias("ref"),
            x["e"]["source"].alias("source"),
        )

    df = df.withColumn("_routed", F.filter(F.transform("entities", route), lambda x: x["todo"] != "PRESERVE"))
    df = df.withColumn("_digested", F.transform("_routed", digested)).withColumn("_replaced", F.transform("_digested", replaced))
    return df.withColumn("plan", F.transform("_replaced", planned).cast(PLAN)).drop("_routed", "_digested", "_replaced")


def obfuscate(df: DataFrame, keys: DataFrame, policy: Policy | None = None, detector: Detector | None = None, strategies: dict[str, Strategy] | None = None) -> DataFrame:
    """Documents (session_id, doc_id, text, ...) with entities, patient_age, route_to_human, plan,
    obfuscated_text, known_originals, used_pseudonyms, input_tokens (token-shaped strings that the
    text already holds).

    ``keys`` is a table of :func:`~veilspark.functions.crypto.key_table`; documents of sessions without a
    key drop out. A null text gives a null result without entities.
    """
    policy = policy or Policy()
    out = with_entities(df, detector)
    out = out.withColumn("patient_age", patient_age(F.col("entities")))
    out = out.withColumn("route_to_human", F.coalesce(F.col("patient_age") <= policy.pediatric_age, F.lit(False)))
    out = crypto.with_document_pads(crypto.with_keys(out, keys, "prk_inner", "prk_outer"))
    out = _with_plan(out, policy, strategies or STRATEGIES).drop("prk_inner", "prk_outer", "doc_inner", "doc_outer")
    hidden = F.array_distinct(F.flatten(F.transform(F.col("plan"), lambda p: F.array(p["original"], p["canonical"]))))
    return out.select(
        "*",
        splice(F.col("text"), F.col("plan")).alias("obfuscated_text"),
        hidden.alias("known_originals"),
        F.exists("plan", lambda p: p["action"] == "PSEUDONYMIZE").alias("used_pseudonyms"),
        F.coalesce(F.regexp_count("text", F.lit(vocab.TOKEN)), F.lit(0)).alias("input_tokens"),
    )


def entity_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Entities of each type per group of documents, sorted by group and type."""
    rows = exploded(df, "entities", "e", *by)
    return rows.groupBy(*by, F.col("e.entity_type").alias("entity_type")).agg(F.count(F.lit(1)).alias("n")).orderBy(*by, "entity_type")
