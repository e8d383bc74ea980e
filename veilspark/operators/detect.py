"""Detection: rules, bare numbers, ZIP codes and pairs of capitalised words, as spans."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import matches, plain, words
from ..schema import SPANS, STANDARD_RULES, Rule

_TRIM = " \t\n.,;:"
_RANK = 1_000_000  # places for the matches of one rule in ``ord``
_DIGIT = r"\p{Nd}"
_S = r"(?U:\s)"
_MONTH = "[jfmasond][aepuco][nbrylgptvc]"  # the first letters of one, or nearly
#: What a text must hold for a standard rule to match at all: a pattern in the lower-case text, or else
#: one of some strings in it. A search for these is far cheaper than the rule's pattern, whose
#: letters are of any case and any script.
_HINTS: dict[str, str | tuple[str, ...]] = {
    "ssn": r"\p{Nd}-\p{Nd}{2}-\p{Nd}",
    "ssn_labeled": ("ssn", "social security"),
    "email": ("@",),
    "phone": rf"\p{{Nd}}(?:[-.]|{_S})\p{{Nd}}{{4}}",
    "credit_card": r"(?:\p{Nd}[ -]?){14}\p{Nd}",
    "ipv4": r"\p{Nd}\.\p{Nd}{1,3}\.\p{Nd}",
    "url": ("http",),
    "mrn": ("mrn", "medical record"),
    "dea": ("dea",),
    "npi": ("npi",),
    "account": ("account", "acct"),
    "insurance": ("member", "policy", "insurance", "subscriber"),
    "case_no": ("case", "docket"),
    "name_labeled": rf"(?:name|patient|provider|physician|attending|guardian|client|plaintiff|defendant|contact|referring){_S}*[:#]",
    "name_honorific": ("dr", "mr", "ms", "miss", "prof", "rev"),
    "dob": ("dob", "d.o.b.", "birth"),
    "date": rf"\p{{Nd}}[/-]\p{{Nd}}|{_MONTH}[a-z]*\.?{_S}+\p{{Nd}}|\p{{Nd}}{_S}+{_MONTH}",
    "age": rf"\p{{Nd}}(?:-|{_S})*y(?:ear|o|/o|\.o\.)",
    "age_labeled": rf"age{_S}*[:#]",
    "sex_labeled": ("sex", "gender"),
    "sex_term": ("male", "man", "transgender", "binary"),
    "ethnicity": tuple(t.lower() for t in vocab.ETHNICITY_TERMS),
    "address": rf"\p{{Nd}}{_S}+(?:[a-z][a-z.]+{_S}){{1,4}}{vocab.STREET.lower()}",
    "city_state": rf"[a-z],[ ]+(?:{'|'.join(s.lower() for s in vocab.STATES if s not in vocab.STATE_WORDS)})(?!\w)",
}

#: How a match of a standard rule begins, in any case (the letters of no other case in :data:`_ODD` included): looked for before the
#: rule's pattern, whose word boundaries and alternatives cost far more at each place.
_BEGINS = {
    "ssn": r"\p{Nd}{3}-",
    "ssn_labeled": "[sS\u017f]",
    "phone": r"[+(\p{Nd}]",
    "credit_card": r"\p{Nd}",
    "ipv4": r"\p{Nd}",
    "url": "[hH]",
    "mrn": "[mM]",
    "dea": "[dD]",
    "npi": "[nN]",
    "account": "[aA]",
    "insurance": "[mMpPiI\u0130\u0131sS\u017f]",
    "case_no": "[cCdD]",
    "name_labeled": "[pPnNaAgGcCdDeErR]",
    "name_honorific": "[DMPR]",
    "dob": "[dDbB]",
    "date": rf"\p{{Nd}}{{1,2}}[/-]\p{{Nd}}{{1,2}}[/-]|\p{{Nd}}{{4}}-\p{{Nd}}|(?:\p{{Nd}}{{1,2}}{_S}+)?[jfmasondJFMASOND\u017f][aepucoAEPUCO][nbrylgptvcNBRYLGPTVC]",
    "age": r"\p{Nd}",
    "age_labeled": "[aA]",
    "sex_labeled": "[sS\u017fgG]",
    "sex_term": "[mMfFwWtTnN]",
    "ethnicity": "[wWbBaAhHlLnNpPcCkK\u212ajJvVfFsS\u017fmM]",
    "address": r"\p{Nd}",
}
_ZIP = rf"[a-z]{{2}}{_S}+\p{{Nd}}{{5}}"
_NUMBER = r"0\p{Nd}{2}|\p{Nd}{5}"
_PAIR = rf"[a-z]{{2}}{_S}+[a-z]{{2}}"


@dataclass(frozen=True)
class Text:
    """Columns of a row's text: plain, in lower case, and whether it has a digit."""

    plain: Column
    lower: Column
    has_digit: Column


#: A detector maps a text to an array of spans.
Detector = Callable[[Text], Column]


def _guarded(text: Text, hint: str | tuple[str, ...] | None, found: Column) -> Column:
    if hint is None:
        return found
    if isinstance(hint, str):
        may = F.regexp_like(text.lower, F.lit(hint))
        may = text.has_digit & may if r"\p{Nd}" in hint else may
    else:
        may = reduce(Column.__or__, [F.contains(text.lower, F.lit(h)) for h in hint])
    return F.when(may, found).otherwise(F.array().cast(SPANS))


def _spans(found: Column, kind: str, confidence: float, source: str, rank: int) -> Column:
    return F.transform(
        found,
        lambda m, i: F.struct(
            m["start"].alias("start"),
            m["end"].alias("end"),
            F.lit(kind).alias("entity_type"),
            m["text"].alias("text"),
            F.lit(float(confidence)).alias("confidence"),
            F.lit(source).alias("source"),
            (F.lit(rank * _RANK) + i).cast("int").alias("ord"),
        ),
    ).cast(SPANS)


def rule_spans(text: Text, rule: Rule, rank: int = 0) -> Column:
    """The values that one rule finds."""
    hint, begins = (_HINTS.get(rule.id), _BEGINS.get(rule.id)) if rule.source == "standard" else (None, None)
    return _guarded(text, hint, _spans(matches(text.plain, rule.pattern(begins), _TRIM), rule.entity_type, rule.confidence, f"rule:{rule.id}", rank))


def zip_spans(text: Text, rank: int = 0) -> Column:
    """Five digits (and four more) after a state's code; the state stays outside the span."""
    pattern = r"(?U)(?=[A-Z]{2}\s)(?<anc>\b(?:" + "|".join(vocab.STATES) + r")\s+)(?<val>\d{5}(?:-\d{4})?)\b"
    return _guarded(text, _ZIP, _spans(matches(text.plain, pattern), "ZIP", 0.8, "magnitude", rank))


def number_spans(text: Text, rank: int = 0) -> Column:
    """Digit runs of five or more, or of three or more with a leading zero, unless a unit follows."""
    units = "|".join(rf"\Q{u}\E" for u in vocab.UNITS)
    pattern = rf"(?U)(?=\d)(?<anc>)(?<!\d)(?<val>0\d{{2,}}+|\d{{5,}}+)(?!\s?(?:{units})\b)"
    return _guarded(text, _NUMBER, _spans(matches(text.plain, pattern), "GENERIC_ID", 0.6, "magnitude", rank))


def pair_spans(text: Text, rank: int = 0) -> Column:
    """Two capitalised words in a row, neither of them a word of headings."""
    pattern = rf"(?U)(?=[A-Z])(?<anc>)(?<val>{vocab.NAME_PAIR})"
    stop = F.array(*[F.lit(w) for w in vocab.PAIR_WORDS])
    found = F.filter(matches(text.plain, pattern), lambda m: ~F.arrays_overlap(words(F.lower(m["text"])), stop))
    return _guarded(text, _PAIR, _spans(found, "NAME", 0.55, "heuristic:name", rank))


def native(custom: Sequence[Rule] = (), standard: Sequence[Rule] = tuple(STANDARD_RULES)) -> Detector:
    """The detector of standard and custom rules: custom rows add spans, they never take any."""
    rules = [r for r in (*standard, *custom) if r.enabled]

    def detect(text: Text) -> Column:
        found = [rule_spans(text, r, i) for i, r in enumerate(rules)]
        n = len(rules)
        return F.concat(*found, zip_spans(text, n), number_spans(text, n + 1), pair_spans(text, n + 2))

    return detect


_TEXT = ("_plain", "_lower", "_has_digit")
#: Letters outside ASCII that Java's patterns take for one of ASCII when case is ignored.
_ODD = ("\u017f\u212a\u0130\u0131", "skii")


def with_text(df: DataFrame, text: str = "text") -> tuple[DataFrame, Text]:
    """``df`` with the columns of :class:`Text` (drop them by :func:`without_text`); a null text is
    an empty one."""
    df = df.withColumn("_plain", plain(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn("_lower", F.lower(F.translate("_plain", _ODD[0], _ODD[1]))).withColumn("_has_digit", F.regexp_like("_plain", F.lit(_DIGIT)))
    return df, Text(*map(F.col, _TEXT))


def without_text(df: DataFrame) -> DataFrame:
    return df.drop(*_TEXT)


def with_spans(df: DataFrame, detector: Detector | None = None, text: str = "text", into: str = "spans") -> DataFrame:
    """``df`` with the detected spans in the order of emission; a null text has none."""
    df, columns = with_text(df, text)
    return without_text(df.withColumn(into, (detector or native())(columns)))
