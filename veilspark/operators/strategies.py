"""Policy and strategies: what a span's value is replaced by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import crypto
from ..schema import Policy

FIRST_MEN = ["Adam", "Boris", "Carl", "Dario", "Edgar", "Felix", "Georg", "Henry", "Ivan", "Jonas", "Karim", "Leon", "Marco", "Nils", "Oscar", "Pavel", "John", "Robert", "James", "David"]
FIRST_WOMEN = ["Anna", "Bella", "Clara", "Diana", "Elena", "Freya", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nadia", "Olga", "Paula", "Jane", "Sarah", "Emily", "Susan"]
LAST = ["Abbott", "Berger", "Castel", "Dorsey", "Ellery", "Foster", "Garner", "Hobart", "Ingram", "Jarvis", "Keller", "Lawson", "Marlow", "Norden", "Osborn", "Porter", "Quimby", "Ransom", "Sutton", "Thorne", "Ulrich", "Vernon", "Walden", "Yates"]
STREETS = ["Alder Street", "Birch Avenue", "Cedar Road", "Dogwood Lane", "Elm Drive", "Fir Court", "Grove Way", "Hazel Place"]
CITIES = ["Ashford", "Brookton", "Clearview", "Dunmore", "Eastvale", "Fairmont", "Glenwood", "Hillcrest"]
WORDS = ["Amber", "Basalt", "Cobalt", "Drift", "Ember", "Fjord", "Garnet", "Harbor"]
_REROLL = 0xA5A5A5


def lookup(table: dict[str, str], key: Column, default: str) -> Column:
    """A constant table as a column expression."""
    entries = [F.lit(x) for kv in sorted(table.items()) for x in kv]
    return F.coalesce(F.create_map(*entries)[key], F.lit(default)) if entries else F.lit(default)


def data_class(entity_type: Column) -> Column:
    return lookup(vocab.DATA_CLASS, entity_type, "PII")


def action(entity_type: Column, confidence: Column, policy: Policy) -> Column:
    """The action of a span: what isn't sure enough is redacted, whatever the routing says."""
    return F.when(confidence < policy.confidence_threshold, "REDACT").otherwise(lookup(policy.routing(), entity_type, "TOKENIZE"))


def data_class_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(vocab.DATA_CLASS.items()), "entity_type string, data_class string")


def routing_table(spark: SparkSession, policy: Policy) -> DataFrame:
    return spark.createDataFrame(sorted(policy.routing().items()), "entity_type string, action string")


def generalize_date(value: Column, age: Column, policy: Policy) -> Column:
    """The year; nothing for the elderly, the date itself for young children."""
    year = F.regexp_extract(value, f"(?U){vocab.YEAR}", 1)
    plain = F.when(year != "", year).otherwise(vocab.REDACTED)
    return F.when(age >= policy.elderly_age, vocab.REDACTED).when(age <= policy.pediatric_age, value).otherwise(plain)


def generalize_age(value: Column, policy: Policy) -> Column:
    """90+ for the elderly, a band of five years in band mode, else the number."""
    age = F.expr("try_cast(null as int)") if value is None else F.try_to_number(F.nullif(F.regexp_extract(value, r"\d{1,3}", 0), F.lit("")), F.lit("999")).cast("int")
    low = (F.floor(age / 5) * 5).cast("int")
    kept = F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string")) if policy.age_mode == "band" else age.cast("string")
    return F.when(age.isNull(), vocab.REDACTED).when(age >= policy.elderly_age, f"{policy.elderly_age}+").otherwise(kept)


def generalize_zip(value: Column) -> Column:
    """The first three digits; zeros where few people live."""
    prefix = F.substring(F.regexp_extract(value, r"\d{5}", 0), 1, 3)
    return F.when(prefix == "", vocab.REDACTED).when(prefix.isin(vocab.SMALL_ZIP3), "000XX").otherwise(F.concat(prefix, F.lit("XX")))


def generalize(entity_type: Column, value: Column, age: Column, policy: Policy) -> Column:
    return (
        F.when(entity_type.isin("DATE", "DOB"), generalize_date(value, age, policy))
        .when(entity_type == "AGE", generalize_age(value, policy))
        .when(entity_type == "ZIP", generalize_zip(value))
        .otherwise(vocab.REDACTED)
    )


def _pick(items: list[str], seed: Column, shift: int) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in items]), (F.pmod(F.shiftright(seed, shift), F.lit(len(items))) + 1).cast("int"))


def _digits(seed: Column, shift: int, n: int) -> Column:
    return F.lpad(F.pmod(F.shiftright(seed, shift), F.lit(10**n)).cast("string"), n, "0")


def _invent(entity_type: Column, value: Column, seed: Column) -> Column:
    first = F.lower(F.regexp_extract(value, r"(?U)^\s*(\S+)", 1))
    men, women = ([n.lower() for n in x] for x in (FIRST_MEN, FIRST_WOMEN))
    given = F.when(first.isin(men) & ~first.isin(women), _pick(FIRST_MEN, seed, 0)).when(first.isin(women) & ~first.isin(men), _pick(FIRST_WOMEN, seed, 0)).otherwise(_pick(FIRST_MEN + FIRST_WOMEN, seed, 0))
    last, lit = _pick(LAST, seed, 12), F.lit
    letters = [chr(65 + i) for i in range(26)]
    return (
        F.when(entity_type == "NAME", F.concat_ws(" ", given, last))
        .when(entity_type == "ADDRESS", F.concat(_digits(seed, 3, 3), lit(" "), _pick(STREETS, seed, 20), lit(", "), _pick(CITIES, seed, 28)))
        .when(entity_type == "EMAIL", F.concat(F.lower(last), _digits(seed, 7, 6), lit("@example.org")))
        .when(entity_type == "PHONE", F.concat(lit("("), _digits(seed, 5, 3), lit(") 555-"), _digits(seed, 21, 4)))
        .when(entity_type == "SSN", F.concat(lit("9"), _digits(seed, 5, 2), lit("-"), _digits(seed, 15, 2), lit("-"), _digits(seed, 25, 4)))
        .when(entity_type.isin("MRN", "ACCOUNT", "ACCOUNT_FINANCIAL", "INSURANCE_ID", "GENERIC_ID"), F.concat(_pick(letters, seed, 2), _pick(letters, seed, 9), _digits(seed, 16, 6)))
        .when(entity_type == "CREDIT_CARD", F.concat(lit("4"), _digits(seed, 1, 8), _digits(seed, 20, 7)))
        .when(entity_type == "IP", F.concat_ws(".", lit("10"), *[F.pmod(F.shiftright(seed, k), lit(256)).cast("string") for k in (4, 13, 22)]))
        .when(entity_type == "URL", F.concat(lit("https://"), F.lower(_pick(WORDS, seed, 6)), _digits(seed, 11, 5), lit(".example.org/")))
        .otherwise(_pick(WORDS, seed, 6))
    )


def pseudonym(entity_type: Column, value: Column, digest: Column) -> Column:
    """An invented value of the same kind that follows from the digest; rolled again once if it is
    the value itself."""
    seed = F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")
    fake = _invent(entity_type, value, seed)
    return F.when(F.lower(F.trim(fake)) == F.lower(F.trim(value)), _invent(entity_type, value, seed.bitwiseXOR(F.lit(_REROLL)))).otherwise(fake)


#: A strategy gives the replacement from (type, canonical value, digest, age, policy); the two that
#: can be undone leave a vault entry.
Strategy = Callable[[Column, Column, Column, Column, Policy], Column]
STRATEGIES: dict[str, Strategy] = {
    "TOKENIZE": lambda kind, value, digest, age, policy: crypto.token(kind, digest),
    "PSEUDONYMIZE": lambda kind, value, digest, age, policy: pseudonym(kind, value, digest),
    "GENERALIZE": lambda kind, value, digest, age, policy: generalize(kind, value, age, policy),
}
REVERSIBLE = ("TOKENIZE", "PSEUDONYMIZE")
