"""Custom detection rules from JSON."""

from __future__ import annotations

import logging
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..schema import RULE, STANDARD_RULES, Rule, Settings, rule_rows

log = logging.getLogger(__name__)
_ROW = "id string, name string, entity_type string, regex string, preceding string, succeeding string, action string, enabled boolean, priority int, confidence double, ignore_case boolean"
#: A repeat without bound of a group that itself repeats or branches: such patterns can overflow the
#: stack of Java's matcher or take exponential time.
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*(?:\||[+*]|\{\d+,\})(?:[^()\\]|\\.)*\)(?:[+*]|\{\d+,\})")


def load(spark: SparkSession, path: str) -> list[Rule]:
    """The rules of a JSON file, a list or {"rules": [...]}; a file that cannot be read gives none.

    Skipped with a warning: rows without id, with a pattern that Python or Java cannot compile, with
    nested repeats, or with neither a value nor a boundary (each single character would match).
    Unknown types become GENERIC_ID.
    """
    try:
        whole = spark.read.text(path, wholetext=True)
        listed = F.regexp_like("value", F.lit(r"^\s*\["))
        body = F.when(listed, F.concat(F.lit('{"rules":'), F.col("value"), F.lit("}"))).otherwise(F.col("value"))
        rows = whole.select(F.explode(F.from_json(body, f"rules array<struct<{_ROW.replace(' string', ':string').replace(' boolean', ':boolean').replace(' int', ':int').replace(' double', ':double')}>>")["rules"]).alias("r")).select("r.*").collect()
    except Exception as e:  # noqa: BLE001 - the reader's errors have many types; the service goes on
        log.warning("custom rules %s cannot be read: %s", path, type(e).__name__)
        return []
    out = []
    for r in rows:
        if not r.id:
            log.warning("custom rule without id skipped")
        elif bad := next((p for p in (r.preceding, r.regex, r.succeeding) if p is not None and not usable(spark, p)), None):
            log.warning("custom rule %s skipped: pattern %r", r.id, bad)
        elif not r.regex and not r.succeeding:
            log.warning("custom rule %s skipped: neither value nor boundary", r.id)
        else:
            given = {k: v for k, v in r.asDict().items() if v is not None}
            given["entity_type"] = r.entity_type if r.entity_type in vocab.ENTITY_TYPES else "GENERIC_ID"
            out.append(Rule(**{"name": r.id, "confidence": 0.8, **given, "source": "custom"}))
    return out


def usable(spark: SparkSession, pattern: str) -> bool:
    """Whether both engines compile a pattern and no unbounded repeat nests in it."""
    try:
        re.compile(pattern)
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(re.sub(r"\(\?P<", "(?<", pattern))
    except Exception:  # noqa: BLE001 - re.error, or Java's error through the gateway
        return False
    return not _NESTED.search(pattern)


def table(spark: SparkSession, custom: list[Rule] = ()) -> DataFrame:
    """All rules as rows: standard, then custom."""
    return spark.createDataFrame(rule_rows(STANDARD_RULES), RULE).unionByName(spark.createDataFrame(rule_rows(list(custom)), RULE))


def supported_types(custom: list[Rule] = (), others: tuple[str, ...] = ()) -> list[str]:
    """All entity types that the rules, the passes beside them and other detectors may find, sorted."""
    return sorted({r.entity_type for r in (*STANDARD_RULES, *custom)} | {"ZIP", "GENERIC_ID", "NAME"} | set(others))


def info(settings: Settings, custom: list[Rule] = ()) -> dict:
    """What a health check shows: no key, no text."""
    from .. import __version__

    return {"status": "ok", "version": __version__, "detector": "native", "provider": settings.provider_name(), "custom_rules": len(custom), "standard_rules": len(STANDARD_RULES), "entity_types": supported_types(custom)}


def listing(rules: DataFrame) -> DataFrame:
    """Rules as a report shows them: custom ones whole, standard ones by id, name and type."""
    custom = F.col("source") == "custom"
    return rules.select("id", "name", "entity_type", "source", *[F.when(custom, F.col(c)).alias(c) for c in ("regex", "preceding", "succeeding", "action", "enabled", "priority", "confidence", "ignore_case")])
