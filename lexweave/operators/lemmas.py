"""Lemmas of any words, learned from a table of forms: rules by word ends, as a trie of reversed endings in flat arrays.

A form and its lemma give a rule: cut so many characters, add these. One aggregation counts the rules of every ending, from what the
rule cuts to CONTEXT characters more. A word takes the rule of the longest ending that it has; an ending whose rule is that of
the next shorter one is left out. Words of a batch walk the trie side by side, each different one once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters before those that a rule cuts, which may decide between rules.
CONTEXT = 4
#: Endings that fewer different forms have teach nothing.
LEAST_FORMS = 2
#: A model is held by every task: one of more endings than this (some 100 MB) is refused.
MOST_ENDINGS = 2_000_000
_LETTERS = 0x110000


def rules_of(forms: DataFrame, least_forms: int = LEAST_FORMS) -> DataFrame:
    """(ending, cut, add) from forms (form, lemma): the rule that most forms with the ending follow, of several the one that cuts least, then adds the first text.

    Forms and lemmas count in lower case, repeated rows once; rows with a null or an empty form are left out. The empty
    ending has the rule of words that no other fits.
    """
    pairs = forms.select(F.lower("form").alias("form"), F.lower("lemma").alias("lemma")).where("form <> '' and lemma is not null").distinct()
    shared = F.expr("size(filter(sequence(1, greatest(least(length(form), length(lemma)), 1)), i -> left(form, i) = left(lemma, i) and i <= length(lemma)))")
    ruled = pairs.withColumn("shared", shared).select("form", (F.length("form") - F.col("shared")).alias("cut"), F.substring("lemma", F.col("shared") + 1, F.length("lemma")).alias("add"))
    ends = F.sequence(F.col("cut"), F.least(F.length("form"), F.col("cut") + CONTEXT))
    # The empty ending stands under all others, so a word always has one.
    ends = F.when(F.col("cut") > 0, F.concat(F.array(F.lit(0)), ends)).otherwise(ends)
    voted = ruled.select(F.explode(ends).alias("n"), "form", "cut", "add").select(F.when(F.col("n") > 0, F.right("form", F.col("n"))).otherwise("").alias("ending"), "cut", "add")
    # Only rules that an ending can follow: it has all that is cut.
    counted = voted.where(F.length("ending") >= F.col("cut")).groupBy("ending", "cut", "add").agg(F.count("*").alias("forms"))
    best = counted.groupBy("ending").agg(F.sum("forms").alias("all"), F.min(F.struct((-F.col("forms")).alias("rank"), "cut", "add")).alias("best"))
    return best.where(F.col("all") >= least_forms).select("ending", "best.cut", "best.add")


class Lemmas:
    """The trie: sorted (node, letter) keys level by level, and the rule of each node."""

    def __init__(self, rules: list[tuple[str, int, str]]) -> None:
        by_end = {end: (cut, add) for end, cut, add in rules}
        kept = {}
        for end in sorted(by_end, key=len):
            shorter = next((kept[end[k:]] for k in range(1, len(end) + 1) if end[k:] in kept), (0, ""))
            if by_end[end] != shorter or not end:
                kept[end] = by_end[end]
        self.cuts = np.array([0, *(cut for cut, _ in kept.values())], np.int64)
        self.adds = ["", *(add for _, add in kept.values())]
        ends = list(kept)
        node = np.zeros(len(ends), np.int64)
        sizes = np.array([len(e) for e in ends], np.int64)
        root = np.flatnonzero(sizes == 0)
        self.root = int(root[0]) + 1 if len(root) else 0
        self.keys, self.rules = [], []
        for depth in range(int(sizes.max(initial=0))):
            going = np.flatnonzero(sizes > depth)
            key = node[going] * _LETTERS + np.array([ord(ends[i][-1 - depth]) for i in going], np.int64)
            keys, node[going] = np.unique(key, return_inverse=True)
            rule = np.zeros(len(keys), np.int64)
            last = going[sizes[going] == depth + 1]
            rule[node[last]] = last + 1
            self.keys.append(keys)
            self.rules.append(rule)

    def __len__(self) -> int:
        return len(self.adds) - 1

    def of(self, words: list[str]) -> list[str]:
        """The lemma of each word, in lower case; an empty word stays empty."""
        lower = [w.lower() for w in words]
        sizes = np.array([len(w) for w in lower], np.int64)
        ends = np.cumsum(sizes)
        points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        rule = np.full(len(lower), self.root, np.int64)
        rule[sizes == 0] = 0
        going, node = np.arange(len(lower)), np.zeros(len(lower), np.int64)
        for depth, (keys, rules) in enumerate(zip(self.keys, self.rules)):
            some = sizes[going] > depth
            going, node = going[some], node[some]
            if not len(going):
                break
            key = node * _LETTERS + points[ends[going] - 1 - depth]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            met = keys[at] == key
            going, node = going[met], at[met]
            found = rules[node]
            # A rule can't cut more than the word.
            fits = (found > 0) & (self.cuts[found] <= sizes[going])
            rule[going[fits]] = found[fits]
        return [w[: len(w) - int(self.cuts[r])] + self.adds[r] if self.cuts[r] <= len(w) else w for w, r in zip(lower, rule)]


def learn(forms: DataFrame, least_forms: int = LEAST_FORMS) -> Lemmas:
    """The model of a table of forms (form, lemma)."""
    rules = rules_of(forms, least_forms)
    some = rules.limit(MOST_ENDINGS + 1).toArrow()
    if len(some) > MOST_ENDINGS:
        raise ValueError(f"more than {MOST_ENDINGS} endings: raise least_forms")
    return Lemmas(list(zip(*(some[c].to_pylist() for c in ("ending", "cut", "add")))))


def lemmatize(words: DataFrame, model: Lemmas, column: str = "word", name: str = "lemma") -> DataFrame:
    """words with one more column, the lemma of a column of words; null stays null."""
    held = words.sparkSession.sparkContext.broadcast(model)

    def lemma(word: pa.Array) -> pa.Array:
        coded = word.dictionary_encode()
        return pa.array(held.value.of(coded.dictionary.to_pylist()), pa.string()).take(coded.indices)

    return words.withColumn(name, F.arrow_udf(lemma, "string")(F.col(column)))


def with_lemma_set(texts: DataFrame, model: Lemmas, column: str = "text", name: str = "lemmas") -> DataFrame:
    """texts with one more column: the different lemmas of the words of a text, in order of appearance; none of a null text."""
    held = texts.sparkSession.sparkContext.broadcast(model)
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(F.col(column), F.lit("")), F.lit(r"(?U)\w+(?:-\w+)*"), F.lit(0)), F.lower))

    def lemmas(lists: pa.Array) -> pa.Array:
        coded = lists.flatten().dictionary_encode()
        of = pa.array(held.value.of(coded.dictionary.to_pylist()), pa.string()).take(coded.indices)
        return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), pa.array(np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)), pa.int32())]), of)

    return texts.withColumn(name, F.array_distinct(F.arrow_udf(lemmas, "array<string>")(words)))


# Endings of the case and number forms of regular Russian nouns and adjectives, by the ending of the lemma.
PARADIGMS = (
    ("ец", "ец ца цу цом це цы цов цам цами цах"), ("ок", "ок ка ку ком ке ки ков кам ками ках"), ("ия", "ия ии ию ией ий иям иями иях"), ("ие", "ие ия ию ием ии ий иям иями иях"),
    ("ость", "ость ости остью остей остям остями остях"), ("тель", "тель теля телю телем теле тели телей телям телями телях"), ("ый", "ый ого ому ым ом ая ой ую ое ые ых ыми"), ("ий", "ий его ему им ем ая ей ую ее ие их ими"),
    ("ка", "ка ки ке ку кой кам ками ках"), ("а", "а ы е у ой ам ами ах"), ("о", "о а у ом е ам ами ах"), ("", " а у ом е ы ов ам ами ах"),
)


def russian_forms(lemmas: tuple[str, ...]) -> list[tuple[str, str]]:
    """(form, lemma) of regular lemmas, by the first paradigm whose ending fits."""
    out = []
    for lemma in lemmas:
        end, forms = next((e, f) for e, f in PARADIGMS if lemma.endswith(e) and len(lemma) > len(e) + 1)
        out += [(lemma[: len(lemma) - len(end)] + f, lemma) for f in forms.split(" ")]
    return out
