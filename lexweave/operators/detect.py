"""Detectors over a text column: fixed formats, dictionaries, providers. Each gives array<struct SPAN> of candidates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lexweave.functions import vocabulary as v
from lexweave.functions.patterns import PATTERNS, TOKEN_TYPES, PatternSpec
from lexweave.functions.phrases import Phrases, Words
from lexweave.functions.spans import column, find_spans
from lexweave.functions.text import context_window
from lexweave.session import settle

#: What a candidate holds; ordinal settles ties between candidates.
SPAN = "struct<start:int,end:int,entity_type:string,original:string,source:string,confidence:double,identity_key:string,ordinal:int>"
NO_SPANS = f"array<{SPAN}>"
#: What tasks send back of a dictionary's span; the rest is the same for all, or follows from it.
_FOUND = "array<struct<start:int,end:int,original:string>>"
#: A dictionary table of at most so many phrases (some 100 MB as a trie) is held by every task; a larger one is joined by shuffle.
MAX_BROADCAST_ROWS = 2_000_000
#: A task looks up the words of so many bytes of texts at once, which takes some 30 MB; a longer text is looked up by itself.
LETTERS_AT_ONCE = 250_000


def span(start, end, entity_type, original, source: str, confidence, ordinal, identity_key=None) -> Column:
    """A candidate."""
    lit = lambda x, kind: x if isinstance(x, Column) else F.lit(x).cast(kind)
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"), lit(entity_type, "string").alias("entity_type"), original.alias("original"),
        F.lit(source).alias("source"), lit(confidence, "double").cast("double").alias("confidence"), lit(identity_key, "string").alias("identity_key"),
        lit(ordinal, "int").cast("int").alias("ordinal"))


def regex_candidates(text: str | Column, profile: str = "rules", specs: Sequence[PatternSpec] | None = None) -> Column:
    """Matches of the profile's patterns (or of given ones); confidence 1.

    A text without digits, @ and Cyrillic letters can match none of the profile's and is left at once, and one without
    Cyrillic letters isn't searched for what has some.
    """
    every = tuple(PATTERNS[profile] if specs is None else specs)
    none = F.array().cast(NO_SPANS)

    def found(n: int) -> Column:
        spec = every[n]
        return F.transform(find_spans(text, spec.pattern), lambda s, i: span(s["start"], s["end"], spec.entity_type, s["original"], "regex", 1.0, F.lit(2_000_000 + n * 10_000) + i))

    def joined(numbers: list[int]) -> Column:
        return F.concat(*map(found, numbers)) if numbers else none

    if specs is not None:
        return joined([*range(len(every))])
    cyrillic = F.when(column(text).rlike("[А-ЯЁа-яё]"), joined([n for n, s in enumerate(every) if s.cyrillic])).otherwise(none)
    other = F.when(column(text).rlike(r"(?U)[@\d]|[А-ЯЁа-яё]"), joined([n for n, s in enumerate(every) if not s.cyrillic])).otherwise(none)
    return F.concat(other, cyrillic)


def llm_candidates(reply: Column, text: Column) -> Column:
    """Spans from a language model's reply: a JSON array, possibly fenced, of type, text, start, end.

    Unknown types, missing fields and offsets that don't hold the text said are left out; a bad reply gives none.
    """
    fenced = F.regexp_extract(reply, r"```(?:json)?\s*([\s\S]*?)```", 1)
    bare = F.regexp_extract(reply, r"\[[\s\S]*\]", 0)
    body = F.when(reply.rlike(r"```(?:json)?\s*[\s\S]*?```"), F.trim(fenced)).when(bare != "", bare).otherwise(reply)
    items = F.from_json(body, "array<struct<type:string,text:string,start:int,end:int>>")
    good = F.filter(F.coalesce(items, F.array().cast("array<struct<type:string,text:string,start:int,end:int>>")), lambda i: i["type"].isin(*TOKEN_TYPES)
                    & (i["start"] >= 0) & (i["end"] > i["start"]) & (F.substring(text, i["start"] + 1, i["end"] - i["start"]) == i["text"]))
    return F.transform(good, lambda i, n: span(i["start"], i["end"], i["type"], i["text"], "llm", 1.0, F.lit(3_000_000) + n))


def llm_degraded(reply: Column) -> Column:
    """Whether the reply is missing or no JSON array."""
    bare = F.regexp_extract(F.coalesce(reply, F.lit("")), r"\[[\s\S]*\]", 0)
    return F.from_json(bare, "array<struct<type:string>>").isNull()


_WORD = re.compile(r"\b\S+\b")


def _name_runs(text: str, known) -> list[dict]:
    """Runs of up to three neighbouring words that are names, at most two characters apart."""
    runs: list[list[tuple[str, int, int]]] = []
    before = -2
    for i, m in enumerate(_WORD.finditer(text)):
        word = m.group()
        if word[0].isupper() and word in known:
            if i != before + 1 or m.start() - runs[-1][-1][2] > 2 or len(runs[-1]) == 3:
                runs.append([])
            runs[-1].append((word, m.start(), m.end()))
            before = i
    return [_found(r[0][1], r[-1][2], "PER", " ".join(w for w, _, _ in r), 0.8, 1_500_000 + r[0][1] % 400_000) for r in runs]


def _vehicle_runs(text: str, known, near: re.Pattern, window: int) -> list[dict]:
    """Phrases of one to three words, the longest at each place, with a context word that begins within the window."""
    words = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    context, out = None, []
    for i, (_, start, _) in enumerate(words):
        if out and start < out[-1]["end"]:
            continue
        for n in (3, 2, 1):
            end = words[min(i + n, len(words)) - 1][2]
            if i + n <= len(words) and " ".join(w for w, _, _ in words[i : i + n]) in known:
                context = [m.start() for m in near.finditer(text)] if context is None else context
                at = bisect_left(context, start - window)
                if at < len(context) and context[at] <= end + window:
                    out.append(_found(start, end, "МАРКА_ТС", text[start:end], 0.9, 1_000_000 + len(out)))
                    break
    return out


def _found(start: int, end: int, entity_type: str, original: str, confidence: float, ordinal: int) -> dict:
    return {"start": start, "end": end, "entity_type": entity_type, "original": original, "source": "dict", "confidence": confidence, "identity_key": None, "ordinal": ordinal}


def _own_phrases(text: str) -> set[str]:
    """Everything in a text that a dictionary could hold: words as written, and phrases of up to three in lower case."""
    words = _WORD.findall(text)
    lower = [w.lower() for w in words]
    return {*words, *(" ".join(lower[i : i + n]) for n in (1, 2, 3) for i in range(len(lower) - n + 1))}


def _spans_of(row: np.ndarray, start: np.ndarray, end: np.ndarray, original: list[str], texts: int) -> pa.Array:
    """Lists of _FOUND, one for each text, of spans in the order of their texts (row)."""
    made = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(original, pa.string())], names=["start", "end", "original"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(texts + 1)), pa.int32()), made)


def _names_of(texts: list[str | None], gate: np.ndarray, words: Words, known: Phrases) -> pa.Array:
    """_name_runs() of all texts that pass the gate at once."""
    held = np.flatnonzero((known.found(words)[:, 0] >= 0) & words.upper() & gate[words.row])
    row, start, stop = words.row[held], words.start[held], words.stop[held]
    near = np.concatenate([[False], (row[1:] == row[:-1]) & (held[1:] == held[:-1] + 1) & (start[1:] - stop[:-1] <= 2)]) if len(held) else np.zeros(0, bool)
    begins = np.flatnonzero(~near)
    place = np.arange(len(held)) - np.repeat(begins, np.diff(np.append(begins, len(held))))
    first = np.flatnonzero(place % 3 == 0)
    after = np.append(first[1:], len(held)) if len(first) else first
    said = [texts[r][s:e] for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist())]
    original = [" ".join(said[i:j]) for i, j in zip(first.tolist(), after.tolist())]
    return _spans_of(row[first], start[first], stop[after - 1], original, len(texts))


def _vehicles_of(texts: list[str | None], gate: np.ndarray, words: Words, known: Phrases, near: re.Pattern, window: int) -> pa.Array:
    """_vehicle_runs() of all texts that pass the gate at once; context is looked for only where a phrase is."""
    found = known.found(words)
    held = np.flatnonzero((found >= 0).any(axis=1) & gate[words.row])
    row, begin = words.row[held], words.begin[held]
    # Places of context words, and all others here, count on through the texts.
    context = np.array([words.at[r] + m.start() for r in np.unique(row).tolist() for m in near.finditer(texts[r])], np.int64)
    low, high = np.searchsorted(context, np.maximum(begin - window, words.at[row])), words.at[row + 1] - 1
    end = np.full(len(held), -1, np.int64)
    for n in (1, 2, 3):
        stop = words.end[np.minimum(held + n - 1, len(words.end) - 1)]
        there = np.append(context, np.iinfo(np.int64).max)[low] <= np.minimum(stop + window, high)
        end = np.where((found[held, n - 1] >= 0) & there, stop, end)
    kept, last = [], -1
    for k, (s, e) in enumerate(zip(begin.tolist(), end.tolist())):
        if e >= 0 and s >= last:
            kept.append(k)
            last = e
    row, begin, end = row[kept], begin[kept], end[kept]
    start, stop = begin - words.at[row], end - words.at[row]
    original = [texts[r][s:e] for r, s, e in zip(row.tolist(), start.tolist(), stop.tolist())]
    return _spans_of(row, start, stop, original, len(texts))


def _portions(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most LETTERS_AT_ONCE bytes together, or of one text."""
    sizes, begin, held = pc.fill_null(pc.binary_length(text), 0).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if i > begin and held + size > LETTERS_AT_ONCE:
            yield begin, i
            begin, held = i, 0
        held += size
    yield begin, len(sizes)


def _dictionary(words, default: tuple[str, ...], lower: bool) -> Phrases | DataFrame:
    """The phrases as a trie, or those of a table that has more than MAX_BROADCAST_ROWS, as a table."""
    if not isinstance(words, DataFrame):
        return Phrases(list(words or default), lower)
    table = words.select(F.col(f"`{words.columns[0]}`").cast("string").alias("phrase")).where("phrase is not null").distinct()
    some = table.limit(MAX_BROADCAST_ROWS + 1).toArrow()["phrase"].combine_chunks()
    return Phrases(some, lower) if len(some) <= MAX_BROADCAST_ROWS else table


def _with_dictionaries(documents: DataFrame, wanted: list[tuple]) -> DataFrame:
    """documents with columns of spans: for each (name, gate, words, default phrases, lower, whole(texts, gate, words, phrases), runs(text, phrases),
    made(found, number)).

    Spans never leave their row, so equal or null ids can't mix texts up. Dictionaries of at most MAX_BROADCAST_ROWS phrases
    are tries which go to every task, and all of them read the words of a text that were cut once. Of a larger
    table each row is first joined with those phrases that its text holds.
    """
    none = F.array().cast(NO_SPANS)
    small = []
    for name, gate, words, default, lower, whole, runs, made in wanted:
        phrases = _dictionary(words, default, lower)
        if isinstance(phrases, Phrases):
            small.append((name, gate, phrases, whole, made))
        else:
            documents = _with_large_dictionary(documents, name, gate, phrases, runs)
    if not small:
        return documents
    held = documents.sparkSession.sparkContext.broadcast([phrases for _, _, phrases, *_ in small])
    wholes = [whole for *_, whole, _ in small]
    kind = pa.struct([(f"spans{k}", to_arrow_type(_parse_datatype_string(_FOUND))) for k in range(len(small))])

    def find(text: pa.Array, *gates: pa.Array) -> pa.Array:
        passed = [gate.to_numpy(zero_copy_only=False) for gate in gates]
        columns: list[list[pa.Array]] = [[] for _ in gates]
        for begin, end in _portions(text):
            texts = text.slice(begin, end - begin).to_pylist()
            cut: dict[int, Words] = {}
            for out, phrases, whole, gate in zip(columns, held.value, wholes, passed):
                if phrases.seed not in cut:
                    cut[phrases.seed] = Words(texts, phrases.seed)
                out.append(whole(texts, gate[begin:end], cut[phrases.seed], phrases))
        return pa.StructArray.from_arrays([pa.concat_arrays(c).cast(f.type) for c, f in zip(columns, kind)], fields=list(kind))

    both = "_lexweave_dictionaries"
    fields = ",".join(f"spans{k}:{_FOUND}" for k in range(len(small)))
    gates = [F.coalesce(gate, F.lit(False)) for _, gate, *_ in small]
    any_gate = reduce(lambda x, y: x | y, gates)
    found = documents.withColumn(both, F.arrow_udf(find, f"struct<{fields}>")(F.when(any_gate, F.col("text")), *gates))
    return found.withColumns({name: F.coalesce(F.transform(F.col(both)[f"spans{k}"], made), none) for k, (name, *_, made) in enumerate(small)}).drop(both)


def _with_large_dictionary(documents: DataFrame, name: str, gate: Column, table: DataFrame, runs) -> DataFrame:
    """documents with a column of spans that runs(text, phrases) finds in the row's own text, by a join of its phrases with the table's."""
    none = F.array().cast(NO_SPANS)
    text = F.when(gate, F.col("text"))
    row, own = "_lexweave_row", "_lexweave_phrases"
    numbered = settle(documents.withColumn(row, F.monotonically_increasing_id()))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = [*_own_phrases(t)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(held), pa.int64()), pa.array(held, pa.string())], names=[row, "phrase"])

    there = numbered.where(gate).select(row, "text").mapInArrow(explode, f"{row} long, phrase string").join(table, "phrase")
    own_phrases = there.groupBy(row).agg(F.collect_set("phrase").alias(own))  # no more than a text's own phrases

    @F.pandas_udf(NO_SPANS)
    def find(texts: pd.Series, held: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or h is None else runs(t, frozenset(h)) for t, h in zip(texts, held)])

    return numbered.join(own_phrases, row, "left").withColumn(name, F.coalesce(find(text, F.col(own)), none)).drop(row, own)


def _names(name: str, names, gate: str) -> tuple:
    default = (*v.GIVEN_NAMES, *v.SURNAMES, *v.patronymics(), *[s + "а" for s in v.SURNAMES if s[-2:] in ("ов", "ев", "ёв", "ин")])
    made = lambda s, i: span(s["start"], s["end"], "PER", s["original"], "dict", 0.8, s["start"] % 400_000 + 1_500_000)
    return name, F.col("text").rlike(gate), names, default, False, _names_of, _name_runs, made


def _vehicles(name: str, vehicles, context: Sequence[str], window: int) -> tuple:
    words = v.alternatives(tuple(context))
    near = re.compile(f"(?i)(?={words})")
    gate = F.regexp_like("text", F.lit("(?iu)" + words))
    return (name, gate, vehicles, v.VEHICLES, True, lambda texts, passed, cut, known: _vehicles_of(texts, passed, cut, known, near, window),
            lambda text, known: _vehicle_runs(text, known, near, window), lambda s, i: span(s["start"], s["end"], "МАРКА_ТС", s["original"], "dict", 0.9, i + 1_000_000))


def with_names(documents: DataFrame, name: str, names: DataFrame | Sequence[str] | None = None, gate: str = "[А-ЯЁ][а-яё]") -> DataFrame:
    """documents (text, ...) with a column of spans: runs of up to three neighbouring names (given, family, patronymic), as written.

    names: a table or list of names; by default a small list with patronymics formed from it. gate: a pattern that every
    text with such a name has; give another one for names in other letters. A null text has no spans.
    """
    return _with_dictionaries(documents, [_names(name, names, gate)])


def with_vehicles(documents: DataFrame, name: str, vehicles: DataFrame | Sequence[str] | None = None, context: Sequence[str] = v.VEHICLE_CONTEXT, window: int = 120) -> DataFrame:
    """documents (text, ...) with a column of spans: makes and models of one to three words, the longest at each place, near
    a word of the context.

    vehicles: a table or list of lower-case phrases. A context word counts wherever its first letter stands within the
    window, inside other words as well. A null text has no spans. Letters are lowered one by one.
    """
    return _with_dictionaries(documents, [_vehicles(name, vehicles, context, window)])


def with_both(documents: DataFrame, vehicles_name: str, names_name: str, vehicles=None, names=None) -> DataFrame:
    """with_vehicles and with_names, which read the words of a text that were cut once."""
    return _with_dictionaries(documents, [_vehicles(vehicles_name, vehicles, v.VEHICLE_CONTEXT, 120), _names(names_name, names, "[А-ЯЁ][а-яё]")])


def name_candidates(documents: DataFrame, names=None, gate: str = "[А-ЯЁ][а-яё]") -> DataFrame:
    """(doc_id, spans) of the rows in which with_names finds any."""
    return with_names(documents.select("doc_id", "text"), "spans", names, gate).where(F.size("spans") > 0).select("doc_id", "spans")


def vehicle_candidates(documents: DataFrame, vehicles=None, context: Sequence[str] = v.VEHICLE_CONTEXT, window: int = 120) -> DataFrame:
    """(doc_id, spans) of the rows in which with_vehicles finds any."""
    return with_vehicles(documents.select("doc_id", "text"), "spans", vehicles, context, window).where(F.size("spans") > 0).select("doc_id", "spans")


def near_context(text: Column, start: Column, end: Column, pattern: str) -> Column:
    """Whether the text around a span has what vocabulary.context() made a pattern of."""
    return F.regexp_like(context_window(text, start, end), F.lit(pattern))
