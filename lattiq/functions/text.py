"""String, code and JSON expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_base(c: Column) -> Column:
    """Base code of an evidence token ``base_@_value``."""
    return F.split(c, "_@_", 2)[0]


def token_value(c: Column) -> Column:
    """Value of a token, null without one; only the first separator counts."""
    return F.try_element_at(F.split(c, "_@_", 2), F.lit(2))


def normalise_phrase(c: Column) -> Column:
    """Lower case, no bracketed parts, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[\(\[][^\)\]]*[\)\]]", " "), r"\s+", " "))


#: Suffixes in the order in which they are tried, and what takes their place (fixed values).
SUFFIXES = (("ies", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", ""))


def lemma(c: Column) -> Column:
    """Strip one English suffix, tried in fixed order, keeping a stem of at least 3 letters."""
    out = c
    for suffix, put in reversed(SUFFIXES):
        stem = F.length(c) - len(suffix) + len(put) >= 3
        fits = c.endswith(suffix) & stem & (~c.endswith("ss") if suffix == "s" else F.lit(True))
        out = F.when(fits, F.concat(F.substr(c, F.lit(1), F.length(c) - len(suffix)), F.lit(put))).otherwise(out)
    return out


def lemma_phrase(c: Column) -> Column:
    return F.concat_ws(" ", F.transform(F.split(normalise_phrase(c), " "), lemma))


def strip_plural(c: Column) -> Column:
    """Every trailing s goes."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"^(mild|moderate|severe|profound|borderline)\s+", ""), r"s+$", "")


QUALIFIERS = ("acute", "chronic", "severe", "mild", "recurrent", "primary", "secondary", "bilateral")


def candidate_phrases(c: Column, depth: int = 3) -> Column:
    """The phrase, its head before a comma, and both with leading qualifiers stripped; ordered, distinct."""
    found, pattern = [c, F.trim(F.split(c, ",")[0])], rf"^(?:{'|'.join(QUALIFIERS)})\s+"
    for _ in range(depth):
        found += [F.regexp_replace(x, pattern, "") for x in found[-2:]]
    return F.array_distinct(F.filter(F.array(*found), lambda x: F.length(x) > 0))


def phrase_parts(c: Column) -> Column:
    """Parts between commas, slashes and joining words, without brackets; the whole if none is over 2 characters."""
    bare = F.regexp_replace(F.lower(c), r"\([^)]*\)", " ")
    cut = F.split(bare, r"\s*[,;/]\s*|\s+(?:and|or|with|across|over|of the|on the|in the)\s+")
    parts = F.array_distinct(F.filter(F.transform(cut, F.trim), lambda x: F.length(x) > 2))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.trim(F.lower(c))))


#: Terms that are no findings (fixed values), and patterns of our own; both are parameters.
NOISE = (
    "history of present illness", "patient education", "differential diagnosis", "clinical features", "physical examination", "history taking",
    "past medical history", "family history", "social history", "review of systems", "vital signs", "general appearance", "no known", "none", "n/a", "unknown",
    "comparative anatomy", "comparative physiology", "male predominance", "female predominance", "clinical presentation", "clinical course", "clinical manifestation",
)
NOISE_PATTERNS = (r"^\d+$", r"^[^a-z]+$", r"\b(?:mg|ml|kg)\b", r"^(?:the|a|an)$", r"^(?:patients?|treatment|therapy|study|diagnosis|other)$", r"https?:", r"\bet al\b", r"^table\b", r"^figure\b", r"[{}<>]", r"\d{4,}")


def is_noise(c: Column, terms: Sequence[str] = NOISE, patterns: Sequence[str] = NOISE_PATTERNS) -> Column:
    """Listed, shorter than 3 or longer than 50, over 6 words, of a noise pattern, or under half letters."""
    t = F.trim(F.lower(c))
    bad = t.isin(*terms) | ~F.length(t).between(3, 50) | (F.size(F.split(t, r"\s+")) > 6)
    for p in patterns:
        bad = bad | t.rlike(p)
    return F.coalesce(bad | (F.length(F.regexp_replace(t, r"[^\p{L}]", "")) < 0.5 * F.length(t)), F.lit(True))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


def keep_finding(text: Column) -> tuple[Column, Column]:
    """(kept, reason): outcome statements, texts without a patient anchor and bare definitions go."""
    low = F.lower(text)
    outcome, anchor = low.rlike(r"\b(?:mortality|survival rate|prognosis|outcome)\b"), low.rlike(r"\b(?:patient|case|presented|reported|complain)")
    tempo = F.exists(sentences(low), lambda s: s.rlike(r"\b(?:acute|chronic|onset)\b") & s.rlike(r"\b(?:is defined as|refers to)\b") & ~s.rlike(r"\bpatient"))
    reason = F.when(outcome, "outcome").when(~anchor, "no_anchor").when(tempo, "definition").otherwise("kept")
    return reason == "kept", reason


STOP = ("with", "from", "that", "this", "have", "were", "been", "which", "their")


def grounded(value: Column, source: Column) -> Column:
    """At least half of the value's longer words, and one, occur in the source."""
    words = F.filter(F.split(F.lower(value), r"\W+"), lambda w: (F.length(w) > 3) & ~w.isin(*STOP))
    return F.size(F.filter(words, lambda w: F.instr(F.lower(source), w) > 0)) >= F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))


def salvage_json(c: Column, schema: str = "array<string>") -> Column:
    """First bracketed array of a model's answer, without its thinking and code fences; else empty."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<think>.*?</think>", ""), r"```(?:json)?", "")
    return F.coalesce(F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)(\[.*?\])", 1), F.lit("")), schema), F.from_json(F.lit("[]"), schema))


def parse_pick(c: Column) -> Column:
    """Number after PICK:, else a trailing integer, else 1."""
    first = F.nullif(F.regexp_extract(c, r"PICK:\s*(\d+)", 1), F.lit(""))
    return F.coalesce(first, F.nullif(F.regexp_extract(c, r"(\d+)\s*$", 1), F.lit("")), F.lit("1")).try_cast("int")


def parse_answer(c: Column, choices: int = 4) -> Column:
    """Letter of a multiple-choice answer: 'answer is X', else a lone letter at the end, else null."""
    last = chr(ord("A") + choices - 1)
    found = F.regexp_extract(F.upper(c), rf"ANSWER(?:\s+IS)?\s*:?\s*\(?([A-{last}])\b", 1)
    alone = F.regexp_extract(F.upper(c), rf"\b([A-{last}])\W*$", 1)
    return F.nullif(F.when(found != "", found).otherwise(alone), F.lit(""))


def severity_bucket(c: Column, zero: str | None = None) -> Column:
    x = c.try_cast("double")
    return F.when(x == 0, F.lit(zero)).when(x <= 3, "mild").when(x <= 6, "moderate").when(x.isNotNull(), "severe")


def onset_bucket(c: Column) -> Column:
    x = c.try_cast("double")
    return F.when(x >= 5, "sudden").when(x.isNotNull(), "gradual")


def is_numeric_scale(values: Column) -> Column:
    """Possible values are 0, 1, 2, ... (three at least)."""
    n = F.transform(values, lambda v: v.try_cast("int"))
    return F.coalesce((F.size(n) >= 3) & (F.array_sort(n) == F.sequence(F.lit(0), F.greatest(F.size(n), F.lit(1)) - 1)), F.lit(False))


def age_bands(age: Column) -> Column:
    """Names of all bands that hold the age; they overlap."""
    bands = (("infant", age < 2), ("child", age < 18), ("adult", age.between(18, 64)), ("elderly", age >= 65), ("very_old", age >= 80))
    return F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in bands]), lambda x: x.isNotNull())


def icd_ancestors(code: Column) -> Column:
    """The code and its prefixes of 5, 4, 3 and 1 characters, distinct, in that order."""
    return F.array_distinct(F.array(code, *[F.substring(code, 1, n) for n in (5, 4, 3, 1)]))


def icd_chain(code: Column) -> Column:
    """Code, category before the dot, chapter letter."""
    return F.array_distinct(F.array(code, F.substring_index(code, ".", 1), F.substring(code, 1, 1)))


def evidence_text(question: Column, value: Column, place: Column | None = None) -> Column:
    """Question, value unless it says nothing, and '<place> pain'."""
    said = F.when(~F.upper(value).isin("NA", "N", "NULL"), value)
    return F.concat_ws(" . ", question, said, *([F.when(place.isNotNull(), F.concat(place, F.lit(" pain")))] if place is not None else []))


def replace_all(c: Column, table: dict[str, str]) -> Column:
    """Whole-value replacement by a literal table."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c) if table else c


#: French body places and pain characters with their English names (fixed values).
BODY_FR = {"tête": "head", "ventre": "belly", "dos": "back", "poitrine": "chest", "genou": "knee", "épaule": "shoulder", "cheville": "ankle", "hanche": "hip"}
PAIN_FR = {"brûlure": "burning", "crampe": "cramp", "lancinante": "throbbing", "sourde": "dull", "aiguë": "sharp", "déchirante": "tearing"}
