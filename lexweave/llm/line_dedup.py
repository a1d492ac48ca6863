"""Line deduplication by an exact set-similarity join, in DataFrame functions.

A line's tokens are its distinct words in lower case. A line goes if an earlier line, by (doc_id, line number), has a
Jaccard similarity of SIMILARITY or more to it. Tokens are ordered by rarity, which hashed counters over all texts
tell; two lines of that similarity share one of their rarest tokens (prefix filter), in places that leave room for
the overlap (positional filter), and have similar lengths (length filter). A parity of 64 bits, of 128
for longer lines, bounds their difference as well. What passes is verified on the words of whole lines.

Lines of equal text are one class, represented by its earliest line, so copies never meet each other. Near copies would:
all pairs of a group of thousands. Therefore each class is first compared with the earliest classes of the same
sketches: least token hash, greatest token hash and rarest token, each with a class of sizes, as an earliest one
of another size is hardly a match. Where it is a match, the join looks only for still earlier ones, of
which a group of near copies has few. No pair of a class with its earliest match is left out by this.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, id_filter, settle

SIMILARITY = Fraction(4, 5)
#: Hashed counters of words: the table that orders tokens by rarity has so many entries, whatever the input.
COUNTERS = 1 << 17
#: Tokens are told apart by so many values; whole words are compared only where a pair is verified.
TOKENS = 1 << 31
#: Sets of at most so many tokens need no more than 64 bits of parity to tell most pairs apart.
ONE_PARITY = 40
_AT = ("doc_id", "line_no")


def _spaced(text: Column) -> Column:
    """The line with all white space as blanks; most lines have no other, which a search for each tells soonest."""
    other = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\x0b")) | F.contains(text, F.lit("\f"))
    return F.when(other, F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text)


def _words(text: str) -> Column:
    """The words in lower case, with an empty one wherever a blank stands at an end or next to another."""
    return F.split(F.lower(_spaced(F.col(text))), " ", -1)


def _hashes(text: str) -> Column:
    """The set of the words' 64-bit hashes."""
    return F.array_except(F.transform(_words(text), lambda w: F.xxhash64(w)), F.array(F.xxhash64(F.lit(""))))


def _texts(documents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """doc_id, text, base of rows that have both; and doc_id, digest, base of the texts whose ids have several rows, if there are any.

    base numbers the lines of different texts with one id on, in the order of the texts' digests, so a place (doc_id,
    line number) means one line. Ids that come more than once are found without reading texts.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    several = settle(texts.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"))
    if several.isEmpty():
        return texts.withColumn("base", F.lit(0).cast("long")), None
    before = Window.partitionBy("doc_id").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    different = texts.join(several, "doc_id", "left_semi").groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.max(F.size(F.split("text", "\n", -1))).alias("lines"))
    numbered = settle(different.select("doc_id", "digest", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("base")))
    placed = texts.withColumn("digest", F.sha2("text", 256)).join(numbered, ["doc_id", "digest"], "left")
    return placed.select("doc_id", "text", F.coalesce("base", F.lit(0)).alias("base")), numbered


def _lines(texts: DataFrame) -> DataFrame:
    """doc_id, base, line_no (from base), line."""
    lines = texts.select("doc_id", "base", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.select("doc_id", "base", (F.col("base") + F.col("at")).alias("line_no"), "line")


def _rarity(sets: DataFrame) -> Column:
    """A constant array: for each counter a number up to 127 that grows with the number of different lines' tokens that it counts."""
    tokens = sets.select(F.explode("tokens").alias("token"))
    counted = tokens.groupBy(F.col("token").bitwiseAND(F.lit(COUNTERS - 1)).alias("at")).agg(F.count("*").alias("n"))
    found = counted.toArrow()  # at most COUNTERS rows
    rare = np.zeros(COUNTERS, np.int64)
    rare[found["at"].to_numpy()] = np.minimum(np.log2(found["n"].to_numpy() + 1) * 4, 127)
    return F.from_json(F.lit(json.dumps(rare.tolist(), separators=(",", ":"))), "array<bigint>")


def _need(a: str, b: str, t: Fraction) -> str:
    """The least overlap of two sets of these sizes whose similarity is t."""
    return f"(({t.numerator} * ({a} + {b}) + {t.numerator + t.denominator - 1}) div {t.numerator + t.denominator})"


def _classes(texts: DataFrame) -> DataFrame:
    """The different lines with words: two digests, the place of the earliest occurrence, how many there are, and the line."""
    some = F.ltrim("line", F.lit(" \t\x0b\f\r")) != ""  # looks no further than the first word
    lines = _lines(texts).where(some).select(*_AT, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "line")
    found = lines.groupBy("h1", "h2").agg(F.min(F.struct(*_AT)).alias("at"), F.count("*").alias("members"), F.any_value("line").alias("line"))
    return found.select("h1", "h2", "at.*", "members", "line")


def _sets(classes: DataFrame) -> DataFrame:
    """Each class with the least and greatest hash of its token set, and 31 bits of every token's hash. Copies have been
    brought together, so each text is cut and hashed once. Two tokens of a set that share those bits both stay."""
    own = ("h1", "h2", *_AT, "members")
    lines = classes.select(*own, _hashes("line").alias("hashes"))
    return lines.select(*own, F.array_min("hashes").alias("low"), F.array_max("hashes").alias("high"),
                        F.transform("hashes", lambda h: h.bitwiseAND(F.lit(TOKENS - 1)).cast("int")).alias("tokens"))


def _described(sets: DataFrame, rare: Column, t: Fraction) -> DataFrame:
    """Each class with the size n of its token set, the least and greatest token hash, a parity of all tokens and of one half of
    them, and the tokens of its prefix, rarest first. Lambdas are interpreted, so those over all tokens are kept small."""
    key = lambda x: F.shiftleft(F.get(rare, x.bitwiseAND(F.lit(COUNTERS - 1))), 31).bitwiseOR(x)
    own = ("h1", "h2", *_AT, "members", "low", "high")
    keyed = sets.select(*own, "tokens", F.sort_array(F.transform("tokens", key)).alias("keys"))

    def parity(flips: Callable[[Column], Column]) -> Column:
        """Each token for which flips() is 1, not 0, flips the bit that its last six bits name: all that shiftleft looks at."""
        return F.aggregate("tokens", F.lit(0).cast("bigint"), lambda sofar, x: sofar.bitwiseXOR(F.call_function("shiftleft", flips(x), x)))

    size = "cast(size(tokens) as bigint)"
    half = parity(lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(1)).cast("bigint"))
    prefix = F.expr(f"slice(keys, 1, cast({size} - (({size} * {t.numerator} + {t.denominator - 1}) div {t.denominator}) + 1 as int))")
    return keyed.select(
        *own, F.expr(size).alias("n"),
        parity(lambda x: F.lit(1).cast("bigint")).alias("bits"), F.when(F.expr(f"{size} > {ONE_PARITY}"), half).alias("half_bits"),
        F.transform(prefix, lambda k: k.bitwiseAND(F.lit(TOKENS - 1)).cast("int")).alias("rare"))


def _lengths_match(a: str, b: str, t: Fraction) -> str:
    return f"least({a}.n, {b}.n) * {t.denominator} >= greatest({a}.n, {b}.n) * {t.numerator}"


def _parities_match(a: str, b: str, t: Fraction) -> str:
    """Two sets differ by at least as many tokens as their parities differ by bits: of two larger sets, those of one half of
    the tokens and of the other, which is what the half leaves of the whole; else those of all tokens."""
    most = f"{a}.n + {b}.n - 2 * {_need(f'{a}.n', f'{b}.n', t)}"
    half, whole = f"({a}.half_bits ^ {b}.half_bits)", f"({a}.bits ^ {b}.bits)"
    return f"coalesce(bit_count({half}) + bit_count({half} ^ {whole}), bit_count({whole})) <= {most}"


def _by_sketch(classes: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of a class and the earliest one with an equal sketch."""
    # Bounds of sizes lie elsewhere for each sketch, so what one of them parts, others don't.
    sized = lambda i, x: F.xxhash64(F.lit(i), x, F.floor(F.log(float(1 / t), "n") + i / 4))
    sketches = F.array(sized(0, "low"), sized(2, "high"), sized(1, F.get("rare", F.lit(0))))
    keyed = classes.select(*_AT, "n", "bits", "half_bits", F.explode(sketches).alias("sketch"))
    # Partial aggregates: of a large group one row leaves each task.
    heads = keyed.groupBy("sketch").agg(F.min(F.struct(*_AT, "n", "bits", "half_bits")).alias("head"), F.count("*").alias("members")).where("members > 1")
    heads = heads.select("sketch", "head.*")
    return keyed.alias("y").join(heads.alias("x"), F.expr(
        "y.sketch = x.sketch and (x.doc_id < y.doc_id or (x.doc_id = y.doc_id and x.line_no < y.line_no)) and "
        + _lengths_match("x", "y", t) + " and " + _parities_match("x", "y", t))
    ).selectExpr("y.doc_id", "y.line_no", "x.doc_id as x_doc_id", "x.line_no as x_line_no").distinct()


def _by_prefix(classes: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of a class and one before its limit that share a token of their prefixes and pass all filters.

    At the first token that two sets share, the overlap is at most one plus the shorter rest; a pair that matches passes there.
    """
    postings = classes.select(*_AT, "x_doc_id", "x_line_no", "n", "bits", "half_bits", F.posexplode("rare").alias("pos", "token"))
    # A class's own limit never lies behind it, so the second line only says to Spark that both sides are one shuffle.
    return postings.alias("y").join(postings.alias("x"), F.expr(
        "y.token = x.token and (x.doc_id < y.x_doc_id or (x.doc_id = y.x_doc_id and x.line_no < y.x_line_no))"
        " and (x.x_doc_id < y.x_doc_id or (x.x_doc_id = y.x_doc_id and x.x_line_no < y.x_line_no))"
        f" and {_lengths_match('x', 'y', t)} and least(x.n - x.pos, y.n - y.pos) >= {_need('x.n', 'y.n', t)} and {_parities_match('x', 'y', t)}")
    ).selectExpr("y.doc_id", "y.line_no", "x.doc_id as x_doc_id", "x.line_no as x_line_no").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, t: Fraction, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For each line of `pairs` the earliest partner with a similarity of t or more, from whole word sets: x_doc_id, x_line_no,
    similarity. The lines' texts are read again, once; only the sets of listed lines are moved, and kept as both sides of a pair need them."""
    listed = pairs.select(*_AT).union(pairs.select("x_doc_id", "x_line_no")).distinct()
    sets = keep(_lines(texts).where(id_filter(listed, *_AT)).join(listed, [*_AT], "left_semi").select(*_AT, _hashes("line").alias("a")))
    both = pairs.join(sets.toDF("x_doc_id", "x_line_no", "b"), ["x_doc_id", "x_line_no"]).join(sets, [*_AT])
    # A generator between, as a filter on the counts would otherwise count once more by itself.
    counts = F.struct(F.size(F.array_intersect("a", "b")).alias("shared"), (F.size("a") + F.size("b")).alias("sizes"))
    matches = both.select(*_AT, "x_doc_id", "x_line_no", F.inline(F.array(counts))).where(f"shared * {t.denominator} >= (sizes - shared) * {t.numerator}")
    return matches.groupBy(*_AT).agg(F.min(F.struct("x_doc_id", "x_line_no", (F.col("shared") / (F.col("sizes") - F.col("shared"))).alias("similarity"))).alias("x")).select(*_AT, "x.*")


def _limited(classes: DataFrame, found: DataFrame) -> DataFrame:
    """Classes with the place before which a match is still to be found: that of the match found, or the class's own."""
    may = id_filter(found, *_AT)
    own = classes.where(~may).select("*", F.col("doc_id").alias("x_doc_id"), F.col("line_no").alias("x_line_no"))
    met = classes.where(may).join(found.drop("similarity"), [*_AT], "left").select(
        *classes.columns, F.coalesce("x_doc_id", "doc_id").alias("x_doc_id"), F.coalesce("x_line_no", "line_no").alias("x_line_no"))
    return own.union(met)


def repeated_lines(documents: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """One row a line that goes: doc_id, line_no (from 0), kept_doc_id, kept_line_no, similarity.

    kept_...: the earliest line that is similar enough; it may have gone for a still earlier one. Lines without words
    (blank ones) are never repeats. Null texts have no lines; rows without an id are left out; rows of equal id and text
    count as one; different texts of one id have their lines numbered on, in the order of the texts' digests. An empty
    table gives an empty one. Lines are split at \\n; a line of any length is taken whole. Columns beside doc_id and
    text play no part.
    """
    found = _repeated(_texts(documents)[0], similarity)
    return found.select("doc_id", *(F.col(c).cast("int").alias(c) if c.endswith("line_no") else c for c in ("line_no", "kept_doc_id", "kept_line_no", "similarity")))


def _repeated(texts: DataFrame, t: Fraction) -> DataFrame:
    """repeated_lines() of numbered texts, with each line's base."""
    scratch = Scratch(texts.sparkSession)
    sets = scratch.keep(_sets(_classes(texts)), "sets")
    classes = scratch.keep(_described(sets, _rarity(sets), t), "classes")
    scratch.drop("sets")
    early = scratch.keep(_verified(scratch.keep(_by_sketch(classes, t), "sketch"), texts, t, lambda x: scratch.keep(x, "early_sets")), "early")
    pairs = scratch.keep(_by_prefix(_limited(classes.select(*_AT, "n", "bits", "half_bits", "rare"), early), t), "prefix")
    later = scratch.keep(_verified(pairs, texts, t, lambda x: scratch.keep(x, "later_sets")), "later")
    near = early.union(later).groupBy(*_AT).agg(F.min(F.struct("x_doc_id", "x_line_no", "similarity")).alias("near"))
    # Only classes that lose a line; the filter spares moving most other lines.
    known = classes.select("h1", "h2", *_AT, "members").join(near, [*_AT], "left").where("members > 1 or near is not null")
    known = scratch.keep(known.select("h1", "h2", F.struct(*_AT).alias("first"), "near"), "known")
    for name in ("sketch", "early", "early_sets", "prefix", "later", "later_sets", "classes"):
        scratch.drop(name)
    lines = _lines(texts).select(F.struct(*_AT).alias("at"), "base", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).where(id_filter(known, "h1", "h2"))
    gone = lines.join(known, ["h1", "h2"]).where("at <> first or near is not null")
    kept = F.coalesce(F.col("near"), F.struct(F.col("first.doc_id").alias("x_doc_id"), F.col("first.line_no").alias("x_line_no"), F.lit(1.0).alias("similarity")))
    return gone.select("at.*", "base", kept["x_doc_id"].alias("kept_doc_id"), kept["x_line_no"].alias("kept_line_no"), kept["similarity"].alias("similarity")).distinct()


def dedup_lines(documents: DataFrame, similarity: Fraction = SIMILARITY) -> DataFrame:
    """The documents without their repeated lines; other columns as they are.

    A document that lost all its lines with words goes; one that had none stays, as do rows without an id or a text.
    Rows of equal id and text are cut alike; of different texts with one id each loses its own lines.
    """
    own = {c: f"_lexweave_{c}" for c in ("id", "gone", "text", "digest")}  # names that no table has
    texts, numbered = _texts(documents)
    gone = _repeated(texts, similarity).groupBy("doc_id", "base").agg(F.collect_set((F.col("line_no") - F.col("base")).cast("int")).alias(own["gone"]))
    same = F.col("doc_id").cast("long") == F.col(own["id"])
    if numbered is None:
        gone = gone.select(F.col("doc_id").alias(own["id"]), own["gone"])
    else:
        gone = gone.join(numbered, ["doc_id", "base"], "left").select(F.col("doc_id").alias(own["id"]), F.col("digest").alias(own["digest"]), own["gone"])
        same &= F.col(own["digest"]).isNull() | (F.col(own["digest"]) == F.sha2(F.col("text").cast("string"), 256))
    joined = documents.join(gone, same, "left")
    # The numbers of the lines that stay, found by hashing, then the lines themselves.
    lines = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(own["gone"]))
    left = F.element_at(F.transform(F.array(F.struct(lines.alias("lines"), stay.alias("stay"))), lambda z: F.transform(z["stay"], lambda i: F.get(z["lines"], i))), 1)
    cut = joined.withColumn(own["text"], F.when(F.col(own["gone"]).isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    empty = F.col(own["gone"]).isNotNull() & ~F.col(own["text"]).rlike(r"\S")
    return cut.where(~F.coalesce(empty, F.lit(False))).select(*[F.col(own["text"]).alias("text") if c == "text" else F.col(c) for c in documents.columns])
