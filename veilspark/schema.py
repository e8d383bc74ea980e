"""Types of the rows: spans, rules, policies."""

from __future__ import annotations

import os
import re
from dataclasses import asdict, dataclass, field, fields

from pyspark.sql import types as T

from . import vocab

#: A detected span: half-open code-point offsets into the text. ``ord`` is the order of emission.
SPAN = "struct<start:int,end:int,entity_type:string,text:string,confidence:double,source:string,ord:int>"
SPANS = f"array<{SPAN}>"
DOCUMENT = T.StructType().add("session_id", "string").add("doc_id", "string").add("user_id", "string").add("text", "string")
VAULT = T.StructType().add("session_id", "string").add("doc_id", "string").add("surface", "string").add("ciphertext", "binary").add("entity_tag", "string")


@dataclass(frozen=True)
class Rule:
    """A detection rule as a row: an optional label before the value, the value's pattern, an
    optional boundary after it. ``action`` and ``priority`` are kept and listed, nothing more."""

    id: str
    name: str
    entity_type: str
    preceding: str | None = None
    regex: str | None = None
    succeeding: str | None = None
    priority: int = 50
    confidence: float = 0.85
    ignore_case: bool = True
    action: str = "scrub"
    enabled: bool = True
    source: str = "standard"

    def value(self) -> str:
        """The value's pattern; without one, the shortest text of a line up to what follows."""
        if self.regex and self.regex.startswith("TERMS:"):
            terms = sorted(getattr(vocab, self.regex[6:]), key=len, reverse=True)
            return r"\b(?:" + "|".join(map(re.escape, terms)) + r")\b"
        return self.regex or r"[^\n,;]+?"

    def pattern(self, begins: str | None = None) -> str:
        """The rule as one Java pattern with the groups ``anc`` (label) and ``val`` (value). ``begins`` is what each
        match begins with; it changes the time, not the matches."""
        ahead = f"(?={begins})" if begins else ""
        label = f"(?iu:{self.preceding})" if self.preceding else ""
        after = f"(?iu:(?={self.succeeding}))" if self.succeeding else ""
        value = f"(?iu:{self.value()})" if self.ignore_case else self.value()
        return re.sub(r"\(\?P<", "(?<", f"(?U){ahead}(?<anc>{label})(?<val>{value}){after}")


RULE = T.StructType([T.StructField(f.name, {"str": T.StringType(), "str | None": T.StringType(), "int": T.IntegerType(), "float": T.DoubleType(), "bool": T.BooleanType()}[f.type]) for f in fields(Rule)])
STANDARD_RULES = [Rule(*row) for row in vocab.STANDARD_RULES]


def rule_rows(rules: list[Rule]) -> list[tuple]:
    return [tuple(asdict(r).values()) for r in rules]


@dataclass(frozen=True)
class Policy:
    """What is done with each type of entity, and the thresholds.

    ``safe_harbor_age`` generalises ages of the elderly, which the default routing preserves.
    ``multi_record_strict`` is carried for reports only. ``quarantine_threshold`` is the share of
    unreadable pages beyond which a document goes to a human.
    """

    preserve_ethnicity: bool = True
    preserve_sex: bool = True
    preserve_age: bool = True
    age_mode: str = "exact"  # exact | band | token
    multi_record_strict: bool = False
    quarantine_threshold: float = 0.05
    confidence_threshold: float = 0.5
    pediatric_age: int = 5
    elderly_age: int = 90
    version: str = "v1"
    overrides: dict[str, str] = field(default_factory=dict)
    safe_harbor_age: bool = False

    def routing(self) -> dict[str, str]:
        """Entity type -> action, for all types."""
        table = {t: vocab.ROUTING.get(t, "TOKENIZE") for t in vocab.ENTITY_TYPES}
        if self.safe_harbor_age:
            table["AGE"] = "GENERALIZE"
        for kind, kept in (("ETHNICITY", self.preserve_ethnicity), ("SEX", self.preserve_sex), ("AGE", self.preserve_age)):
            if not kept:
                table[kind] = "TOKENIZE"
        return table | self.overrides


@dataclass(frozen=True)
class Settings:
    """Secrets and run-time settings; they live on the driver and never enter a plan as literals."""

    master_key: bytes
    provider: str = "auto"
    gemini_key: str | None = None
    anthropic_key: str | None = None
    store_root: str = "store_data"
    session_ttl: int = 3600
    custom_rules: str | None = None

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        key = env.get("VEIL_MASTER_KEY")
        return cls(
            bytes.fromhex(key) if key else os.urandom(32),
            env.get("VEIL_PROVIDER", "auto"),
            env.get("GEMINI_API_KEY") or env.get("GOOGLE_API_KEY"),
            env.get("ANTHROPIC_API_KEY"),
            env.get("VEIL_STORE_ROOT", "store_data"),
            int(env.get("VEIL_SESSION_TTL", "3600")),
            env.get("VEIL_CUSTOM_RULES"),
        )

    def provider_name(self) -> str:
        """An explicit choice, else the one whose key is there, else the mock."""
        if self.provider.lower() in ("mock", "gemini", "anthropic"):
            return self.provider.lower()
        return "gemini" if self.gemini_key else "anthropic" if self.anthropic_key else "mock"
