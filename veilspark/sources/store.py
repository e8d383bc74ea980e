"""The encrypted document store: a Parquet table partitioned by the user's hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crypto

_ZERO = crypto.pads(bytes(32))


def master_table(spark: SparkSession, master: bytes, version: int = 1) -> DataFrame:
    """The master key as a row: (key_version, m_inner, m_outer), the pads of its extract."""
    if len(master) < 32:
        raise ValueError("a master key has at least 32 bytes")
    return spark.createDataFrame([(version, *crypto.pads(crypto.extract(master)))], "key_version int, m_inner string, m_outer string")


def user_hash(user: Column) -> Column:
    return F.substring(F.sha2(user, 256), 1, 16)


def doc_hash(user: Column, doc: Column) -> Column:
    return F.sha2(F.concat(user, F.lit("\u0000"), doc), 256)


def _info(label: str, value: Column) -> Column:
    return F.concat(F.hex(F.concat(F.lit(label), value).cast("binary")), F.lit("01"))


def _with_key(df: DataFrame, masters: DataFrame) -> DataFrame:
    """``df`` (user_id, doc_id, key_version) with ``_key``: master -> user's key -> document's key."""
    out = crypto.with_keys(df, masters, "m_inner", "m_outer", on="key_version").withColumn("_kek", crypto.hmac_hex(F.col("m_inner"), F.col("m_outer"), _info("veil/store/kek/", F.col("user_id"))))
    out = out.withColumn("_prk", crypto.hmac_hex(F.lit(_ZERO[0]), F.lit(_ZERO[1]), F.col("_kek")))
    pads = out.withColumn("_in", crypto.pad_of(F.col("_prk"), 0x36)).withColumn("_out", crypto.pad_of(F.col("_prk"), 0x5C))
    keyed = pads.withColumn("_key", F.unhex(crypto.hmac_hex(F.col("_in"), F.col("_out"), _info("veil/store/dek/", F.col("doc_id")))))
    return keyed.drop("m_inner", "m_outer", "_kek", "_prk", "_in", "_out")


def _aad() -> Column:
    return F.concat_ws("\u0000", "user_id", "doc_id", F.col("key_version").cast("string"))


def put(docs: DataFrame, masters: DataFrame, path: str, version: int = 1) -> None:
    """Encrypt documents (user_id, doc_id, text) and append them; of several puts of a document the
    newest is read."""
    rows = _with_key(docs.select("user_id", "doc_id", "text").withColumn("key_version", F.lit(version)), masters)
    rows = rows.select("user_id", "doc_id", "key_version", F.current_timestamp().alias("stored_at"), crypto.encrypt(F.col("text"), F.col("_key"), _aad()).alias("blob"))
    sealed = rows.select(user_hash(F.col("user_id")).alias("user_hash"), doc_hash(F.col("user_id"), F.col("doc_id")).alias("doc_hash"), "key_version", "stored_at", "blob")
    sealed.write.mode("append").partitionBy("user_hash").parquet(path)


def _newest(table: DataFrame) -> DataFrame:
    best = F.max(F.struct("stored_at", "key_version", "blob")).alias("b")
    return table.groupBy("user_hash", "doc_hash").agg(best).select("user_hash", "doc_hash", "b.key_version", "b.blob")


_USERS = 1000  # users whose partitions are named in the plan


def _of_users(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The partitions of the users of ``asked``, if they are few; the join prunes the rest."""
    users = [r.user_hash for r in asked.select("user_hash").distinct().limit(_USERS + 1).collect()]
    return table.where(F.col("user_hash").isin(users)) if len(users) <= _USERS else table


def get(wanted: DataFrame, masters: DataFrame, path: str) -> DataFrame:
    """``wanted`` (user_id, doc_id) with text and error: ``missing`` or ``unreadable`` (wrong key or
    slot, or changed bytes) where there is no text. Only the users' partitions are read."""
    asked = wanted.select("user_id", "doc_id", user_hash(F.col("user_id")).alias("user_hash"), doc_hash(F.col("user_id"), F.col("doc_id")).alias("doc_hash"))
    table = wanted.sparkSession.read.schema("doc_hash string, key_version int, stored_at timestamp, blob binary, user_hash string").parquet(path)
    found = asked.join(_newest(_of_users(table, asked)), ["user_hash", "doc_hash"], "left")
    keyed = _with_key(found.withColumn("key_version", F.coalesce("key_version", F.lit(1))), masters)
    text = crypto.decrypt(F.col("blob"), F.col("_key"), _aad())
    return keyed.withColumn("text", text).select("user_id", "doc_id", "text", F.when(F.col("blob").isNull(), "missing").when(F.col("text").isNull(), "unreadable").alias("error"))


def exists(wanted: DataFrame, path: str) -> DataFrame:
    """The rows of ``wanted`` (user_id, doc_id) that are stored."""
    asked = wanted.withColumn("user_hash", user_hash(F.col("user_id"))).withColumn("doc_hash", doc_hash(F.col("user_id"), F.col("doc_id")))
    table = wanted.sparkSession.read.schema("doc_hash string, user_hash string").parquet(path)
    return asked.join(_of_users(table, asked), ["user_hash", "doc_hash"], "left_semi").select(*wanted.columns)
