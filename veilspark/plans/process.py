"""The round trip: obfuscate, verify, ask, restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detect import Detector
from ..operators.obfuscate import obfuscate
from ..operators.outbound import Provider, exchange, mock_reply, rejoin
from ..operators.restore import restore
from ..schema import Policy
from ..sources import pages
from .vault import entries, opened


def process(docs: DataFrame, keys: DataFrame, task: str, policy: Policy | None = None, detector: Detector | None = None, provider: Provider = mock_reply, limit: int = 12_000) -> DataFrame:
    """Documents (session_id, doc_id, text) with restored (null if blocked or for a human),
    routed_to_human, blocked, tokens_restored, pseudonyms_restored, vault_misses, clean.

    What is planned is checkpointed once: encryption draws random nonces, and nothing after it may
    see another draw. Documents for a human are split off before anything is sent.
    """
    planned = obfuscate(docs, keys, policy, detector).checkpoint()
    vault = entries(planned, keys).checkpoint()
    sent = planned.where("not route_to_human and obfuscated_text is not null")
    replies = rejoin(exchange(sent, F.lit(task), provider, limit))
    use_fakes = any(a == "PSEUDONYMIZE" for a in (policy or Policy()).routing().values())
    back = restore(replies.where("not blocked"), opened(vault, keys), use_fakes)
    told = back.select("session_id", "doc_id", "restored", "tokens_restored", "pseudonyms_restored", "vault_misses", "clean")
    out = planned.select("session_id", "doc_id", F.col("route_to_human").alias("routed_to_human"), F.size("known_originals").alias("known_originals"))
    out = out.join(replies.select("session_id", "doc_id", "blocked"), ["session_id", "doc_id"], "left")
    return out.withColumn("blocked", F.coalesce("blocked", F.lit(False))).join(told, ["session_id", "doc_id"], "left")


def process_files(spark: SparkSession, path: str, keys: DataFrame, session: str, task: str, policy: Policy | None = None, extract=pages.form_feed_pages, **options) -> DataFrame:
    """:func:`process` of the files under ``path``, all in one session: a row for each file, its path as
    doc_id, with the number of pages and error (``empty``, ``malformed``). Files without enough
    readable text are for a human, and nothing of them is sent."""
    files = pages.quarantine(pages.read(spark, path, extract), policy, pages="pages").checkpoint()
    files = files.select(F.lit(session).alias("session_id"), F.col("path").alias("doc_id"), "text", F.size("pages").alias("pages"), "error", "quarantined")
    told = process(files.where("not quarantined and error is null"), keys, task, policy, **options)
    out = files.select("session_id", "doc_id", "pages", "error", "quarantined").join(told, ["session_id", "doc_id"], "left")
    human = F.coalesce("routed_to_human", F.col("quarantined") & F.col("error").isNull())
    return out.withColumn("routed_to_human", human).drop("quarantined")


def session_of_one(docs: DataFrame, task: str, user: str = "api-user", **options) -> DataFrame:
    """:func:`process` of documents (doc_id, text) in a session of their own: made for them, and gone
    with its keys when they are through, so no token of the result can be undone later."""
    from .vault import create

    _, keys = create(docs.sparkSession, {(session := new_id("sess_")): user})
    return process(docs.withColumn("session_id", F.lit(session)), keys, task, **options).checkpoint()


def new_id(prefix: str) -> str:
    """A random id, drawn on the driver."""
    import secrets

    return prefix + secrets.token_hex(6)
