"""Text normalisers and predicates as column expressions.

Regular expressions carry (?U), so that classes and word borders are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trimmed from both ends of an entity.
TRIM_CHARS = " \t\r\n,;:()[]{}<>«»\"'"
#: Genitive legal forms and their nominative.
ORG_PREFIXES = (
    ("общества с ограниченной ответственностью", "общество с ограниченной ответственностью"),
    ("акционерного общества", "акционерное общество"),
    ("публичного акционерного общества", "публичное акционерное общество"),
    ("закрытого акционерного общества", "закрытое акционерное общество"),
    ("открытого акционерного общества", "открытое акционерное общество"),
)
#: Limits of a document's text, in characters.
MAX_LENGTH, MIN_TYPED_LENGTH, CONTEXT_WINDOW = 500_000, 20, 48
TRUNCATION_NOTE = "[ВНИМАНИЕ: документ превышает 500 000 символов, обработана только первая часть]"
_LETTER_RUN = r"(?U)(?:\b[А-Яа-яA-Za-zЁё]\b(?:\s+|$)){5,}"


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def clean_entity(text: Column) -> Column:
    """Without punctuation and brackets at the ends, white space collapsed."""
    return collapse_spaces(F.btrim(F.coalesce(text, F.lit("")), F.lit(TRIM_CHARS)))


def fold_case(text: Column) -> Column:
    """Lower case for comparisons; ß as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normal_key(text: Column) -> Column:
    """Collapsed and case-folded."""
    return fold_case(collapse_spaces(text))


def placeholder_key(text: Column) -> Column:
    """What mentions of one entity have in common: the normal key, or the stripped text where that is empty."""
    return F.coalesce(F.nullif(normal_key(text), F.lit("")), strip(F.coalesce(text, F.lit(""))))


def canonical_org(text: Column) -> Column:
    """The normal key of an organisation, its legal form in the nominative."""
    key = normal_key(clean_entity(text))
    out = key
    for genitive, nominative in reversed(ORG_PREFIXES):
        out = F.when(F.startswith(key, F.lit(genitive)), F.concat(F.lit(nominative), F.substring(key, len(genitive) + 1, MAX_LENGTH))).otherwise(out)
    return out


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_text(text: Column) -> Column:
    """LF line ends, no leading byte-order mark, no white space at line ends, at most one blank line in a row, stripped."""
    out = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n"), "^\ufeff+", "")
    out = F.regexp_replace(out, r"(?U)[\s&&[^\n]]+(?=\n|\z)", "")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def typed_text_error(text: Column) -> Column:
    """Why a typed text can't be worked on (empty, too_long, too_short), or null."""
    n = F.length(normalize_text(text))
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", "empty").when(n > MAX_LENGTH, "too_long").when(n < MIN_TYPED_LENGTH, "too_short")


def limit_text(text: Column, note: str = TRUNCATION_NOTE) -> Column:
    """An extracted text, normalised; one that is too long is cut and begins with a note."""
    return bound(normalize_text(text), lambda out: limited(out, note))


def limited(out: Column, note: str = TRUNCATION_NOTE) -> Column:
    """limit_text() of a text that is normalised."""
    return F.when(F.length(out) > MAX_LENGTH, strip(F.concat(F.lit(note + "\n\n"), F.substring(out, 1, MAX_LENGTH)))).otherwise(out)


def looks_corrupted(text: Column) -> Column:
    """Many ?, replacement characters, or a run of five single letters."""
    t = strip(F.coalesce(text, F.lit("")))
    n = F.greatest(F.length(t), F.lit(1))
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    return (t != "") & ((count("?") / n > 0.12) | (count("\ufffd") / n > 0.02) | t.rlike(_LETTER_RUN))


def quality_score(text: Column) -> Column:
    """2 x letters + digits + spaces (120 at most) - 6 x bad characters - 30 x runs of single letters; null if blank."""
    return bound(strip(F.coalesce(text, F.lit(""))), _score)


def _score(t: Column) -> Column:
    count = lambda c: F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))
    hits = lambda p: F.regexp_count(t, F.lit(p))
    bad = count("?") + count("\ufffd") * 8
    score = hits(r"\p{L}") * 2 + hits(r"\p{Nd}") + F.least(count(" "), F.lit(120)) - bad * 6 - hits(_LETTER_RUN) * 30
    return F.when(t != "", score.cast("double"))


def best_text(candidates: Column) -> Column:
    """Of array<string> the text of the highest quality score, the first of equals; null if all are blank."""
    scored = F.transform(candidates, lambda t, i: F.struct(quality_score(t).alias("score"), (-i).alias("at"), t.alias("text")))
    return F.array_max(F.filter(scored, lambda s: s["score"].isNotNull()))["text"]


def context_window(text: Column, start: Column, end: Column, size: int = CONTEXT_WINDOW) -> Column:
    """The case-folded text from `size` characters before a span to `size` after it (offsets from 0)."""
    left = F.greatest(start - size, F.lit(0))
    return fold_case(F.substring(text, (left + 1).cast("int"), (end + size - left).cast("int")))


def rtf_to_text(raw: Column) -> Column:
    """RTF without groups of controls, control words and braces."""
    out = F.regexp_replace(raw, r"\{\\[^{}]*\}", " ")
    out = F.regexp_replace(out, r"\\[a-zA-Z]+\d* ?", " ")
    return F.regexp_replace(F.regexp_replace(out, r"[{}]", " "), r"(?U)\s+", " ")


def safe_filename(name: Column, default: str = "report") -> Column:
    """ASCII letters, digits and -_. only, others as _; never empty."""
    out = F.btrim(F.regexp_replace(strip(name), r"[^A-Za-z0-9\-_.]", "_"), F.lit("._"))
    return F.when(F.coalesce(out, F.lit("")) == "", default).otherwise(out)


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&#34;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def sanitize_entities(payload: Column) -> Column:
    """A JSON object of entity lists as map<string,array<string>>; single values become lists of one; null or bad JSON: empty."""
    raw = F.from_json(payload, "map<string,string>")
    lists = F.transform_values(raw, lambda _, v: F.when(F.startswith(F.ltrim(v), F.lit("[")), F.from_json(v, "array<string>")).otherwise(F.array(v)))
    return F.coalesce(lists, F.create_map().cast("map<string,array<string>>"))
