"""Key derivation, digests and encryption as columns (SHA-2 and AES-GCM of Spark).

Key material reaches a plan only through the rows of a key table, never as a literal.
"""

from __future__ import annotations

import hashlib
import hmac

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 64
#: Tables of keys are broadcast up to this size.
BROADCAST_BYTES = 64 << 20
_ROW_BYTES = 512  # a key row: an id, a key, two pads in hex
_SALTS = 32
KEYS = "session_id string, k_enc binary, prk_inner string, prk_outer string"


def hkdf(key: bytes, info: bytes) -> bytes:
    """HKDF-SHA256 without salt, 32 bytes."""
    return expand(extract(key), info)


def extract(key: bytes) -> bytes:
    return hmac.new(bytes(32), key, hashlib.sha256).digest()


def expand(prk: bytes, info: bytes) -> bytes:
    return hmac.new(prk, info + b"\x01", hashlib.sha256).digest()


def pads(key: bytes) -> tuple[str, str]:
    """The inner and outer pads of HMAC for a key, in hex."""
    key = key.ljust(BLOCK, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def key_table(spark: SparkSession, roots: dict[str, bytes]) -> DataFrame:
    """The key rows of sessions with the given root keys (32 bytes at least)."""
    rows = []
    for session, root in roots.items():
        if len(root) < 32:
            raise ValueError("a root key has at least 32 bytes")
        inner, outer = pads(extract(hkdf(root, b"veil/token/1")))
        rows.append((session, bytearray(hkdf(root, b"veil/vault/1")), inner, outer))
    return spark.createDataFrame(rows, KEYS)


def with_keys(df: DataFrame, keys: DataFrame, *columns: str, on: str = "session_id", spread: str = "doc_id") -> DataFrame:
    """``df`` with ``columns`` of the key row of its ``on``; rows without a key row drop out.

    The key rows are counted first. Up to BROADCAST_BYTES they are broadcast, so ``df`` is neither
    shuffled nor sent. Beyond, both sides are joined by key and salt (the hash of the column
    ``spread``), so one session's rows are many tasks.
    """
    small = keys.select(on, *columns)
    if small.limit(BROADCAST_BYTES // _ROW_BYTES + 1).count() <= BROADCAST_BYTES // _ROW_BYTES:
        return df.join(F.broadcast(small), on)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(_SALTS)).cast("int")).join(salted, [on, "_salt"]).drop("_salt")


def hmac_hex(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC-SHA256 in hex, of a message in hex, under a key given by its pads in hex."""
    return F.sha2(F.unhex(F.concat(outer, F.sha2(F.unhex(F.concat(inner, message)), 256))), 256)


def pad_of(key: Column, byte: int) -> Column:
    """A pad of HMAC for a key of 32 bytes in hex."""
    eight = int.from_bytes(bytes([byte]) * 8, "big")  # bytes of a pad are below 128
    part = lambda i: F.conv(F.substring(key, 16 * i + 1, 16), 16, -10).cast("long").bitwiseXOR(F.lit(eight))
    return F.concat(*[F.lpad(F.lower(F.hex(part(i))), 16, "0") for i in range(4)], F.lit(f"{byte:02x}" * (BLOCK - 32)))


def with_document_pads(df: DataFrame) -> DataFrame:
    """``df`` (doc_id, prk_inner, prk_outer) with doc_inner and doc_outer, the pads of the document's
    own key: tokens of one value differ between documents."""
    info = F.concat(F.hex(F.concat(F.lit("veil/doc/"), F.col("doc_id").cast("string")).cast("binary")), F.lit("01"))
    keyed = df.withColumn("_k", hmac_hex(F.col("prk_inner"), F.col("prk_outer"), info))
    return keyed.withColumn("doc_inner", pad_of(F.col("_k"), 0x36)).withColumn("doc_outer", pad_of(F.col("_k"), 0x5C)).drop("_k")


def digest(value: Column) -> Column:
    """The token digest of a value in a row with document pads."""
    inner, outer = F.col("doc_inner"), F.col("doc_outer")
    # each pad is named twice, or the optimizer puts its making inside the lambda over a row's values
    return F.when(inner.isNotNull() & outer.isNotNull(), hmac_hex(inner, outer, F.hex(value.cast("binary"))))


def token(tag: Column, digest_hex: Column) -> Column:
    return F.concat(F.lit("["), tag, F.lit("_"), F.substring(digest_hex, 1, 12), F.lit("]"))


def encrypt(value: Column, key: Column, aad: Column) -> Column:
    """AES-256-GCM with a random nonce in front. Two evaluations differ: keep the result."""
    return F.aes_encrypt(value.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b"").cast("binary"), aad.cast("binary"))


def decrypt(blob: Column, key: Column, aad: Column) -> Column:
    """The text, or null if key, aad or blob are not those of the encryption."""
    return F.try_aes_decrypt(blob, key, F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary")).cast("string")
