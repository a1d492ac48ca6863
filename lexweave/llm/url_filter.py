"""URL filter by a Bloom filter cascade, in DataFrame functions only.

A cascade encodes a set of listed keys over a known universe of keys: level 0 is a
Bloom filter of the listed keys, level 1 one of those unlisted keys of the universe
that level 0 wrongly holds, level 2 one of the listed keys that level 1 wrongly
holds, and so on until no key is left over. Walking the levels then answers
membership exactly for every key of the universe, without a join: the filters are
constants of the plan.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, settle

#: (verdict, host, path): the most specific rule that fits decides.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hosts that are blocked where no rule fits.
LISTED_HOSTS = ("spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org")

HASHES = 3
BITS_PER_KEY = 10
#: A filter is a constant that every task gets: 2**24 bits are 2 MB. A level of more keys has several, chosen by the key's hash,
MAX_BITS = 1 << 24
#: but no more than so many, 128 MB: some hundred million keys.
MOST_FILTERS = 64


#: A level: for each of its filters the number of bits, and the bits as 64-bit words.
Level = tuple[tuple[int, tuple[int, ...]], ...]


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether the key, of the universe, is listed."""
        answer = F.lit(len(self.levels) % 2 == 1)  # it is in all levels: the last one is right about it
        for level in reversed(range(len(self.levels))):
            held = _held(key, level, self.levels[level])
            answer = F.when(~held, F.lit(level % 2 == 1)).otherwise(answer)
        return answer


def _part(key: Column, filters: int) -> Column:
    """Which of a level's filters the key is in."""
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(filters))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + i)), F.lit(bits)) for i in range(HASHES)]


def _held(key: Column, level: int, filters: Level) -> Column:
    def one(bits: int, words: Sequence[int]) -> Column:
        # A JSON constant: Catalyst folds it into one array once, whatever its length.
        array = F.from_json(F.lit(json.dumps(list(words))), "array<bigint>")
        tests = [
            F.get(array, F.shiftright(p, 6).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), p.bitwiseAND(F.lit(63)).cast("int"))) != 0
            for p in _positions(key, level, bits)
        ]
        return reduce(lambda x, y: x & y, tests)

    out = one(*filters[0])
    for n, f in enumerate(filters[1:], 1):
        out = F.when(_part(key, len(filters)) == n, one(*f)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _level(keys: DataFrame, level: int, others: int) -> Level | None:
    """The filters of the keys, of which some of `others` unlisted keys will be held wrongly: hardly more than there are keys."""
    n = keys.count()
    if not n:
        return None
    # With three hashes a filter of m bits holds (3n / m) ** 3 of the others.
    wanted = max(64, n * BITS_PER_KEY, HASHES * n * ceil((others / n) ** (1 / HASHES)))
    filters = -(-wanted // MAX_BITS)
    if filters > MOST_FILTERS:
        raise ValueError(f"{n} keys need {filters} filters at level {level}, more than every task can hold")
    bits = 64 * ceil(wanted / filters / 64)
    part = _part(F.col("key"), filters) if filters > 1 else F.lit(0).cast("bigint")
    at = keys.select(part.alias("part"), F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("p"))
    set_bits = (
        at.groupBy("part", F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))).alias("b"))
        .toArrow()  # at most MOST_FILTERS * MAX_BITS / 64 rows
    )
    words = np.zeros((filters, bits // 64), np.int64)
    words[set_bits["part"].to_numpy(), set_bits["w"].to_numpy()] = set_bits["b"].to_numpy()
    return tuple((bits, tuple(own)) for own in words.tolist())


def build_cascade(universe: DataFrame, listed: str, max_levels: int = 40) -> Cascade:
    """A cascade over `universe` (key, distinct; the boolean column `listed`: is it listed?).

    Universe and lists are only ever reduced, by filters; no two tables are joined. A first level too small for the
    universe would hold a share of it wrongly, however large that is; its size therefore goes by both.
    """
    levels: list[Level] = []
    inside, outside = universe.where(F.col(listed)), universe.where(~F.col(listed))
    while len(levels) < max_levels:
        made = _level(inside, len(levels), outside.count())
        if made is None:
            return Cascade(tuple(levels))
        levels.append(made)
        held = _held(F.col("key"), len(levels) - 1, made)
        inside, outside = outside.where(held), inside
    raise RuntimeError("the cascade did not end; give more bits a key")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? or # or the end, A-Z lower-cased; path: then up to ? or # or the end."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def rule_keys(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Every key a rule could have that fits the URL: host suffixes of at most the rules' number of
    labels, with path prefixes of the lengths that the rules have. array<struct<size, labels, key>>."""
    labels = max((r[1].count(".") + 1 for r in rules), default=1)
    lengths = sorted({len(r[2]) for r in rules})
    parts = F.split(host, r"\.", -1)
    suffixes = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.lit(labels)),
            lambda n: F.when(n <= F.size(parts), F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")),
        ),
        lambda s: s.isNotNull(),
    )
    return F.flatten(
        F.transform(
            suffixes,
            lambda s: F.filter(
                F.array(*[
                    F.when(
                        F.length(path) >= n,
                        F.struct((F.length(s) + F.lit(n)).alias("size"), F.length(s).alias("labels"), F.concat(s, F.substring(path, 1, n)).alias("key")),
                    )
                    for n in lengths
                ]),
                lambda k: k.isNotNull(),
            ),
        )
    )


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    listed_hosts: Sequence[str] | DataFrame = LISTED_HOSTS,
) -> DataFrame:
    """The pages with host, path, rule and verdict added; columns of the same names are replaced.

    The longest rule that fits decides; where none fits, a host in `listed_hosts`
    (a list, or a DataFrame with a column host) is blocked and any other allowed.
    A null URL or one without :// has an empty host and path, so no rule fits it and
    it is allowed. Repeated rows and ties give equal results; an empty table an empty one.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url))
    parsed = pages.withColumns({"host": host, "path": path})
    keys = parsed.select(
        F.explode(F.concat(
            F.transform(rule_keys(F.col("host"), F.col("path"), rules), lambda k: k["key"]),
            F.array(F.concat(F.lit("="), F.col("host"))),
        )).alias("key")
    ).select("key", F.lit(False).alias("allow"), F.lit(False).alias("block"), F.lit(False).alias("host"))
    if isinstance(listed_hosts, DataFrame):
        hosts = listed_hosts.select(F.concat(F.lit("="), ascii_lower(F.col("host"))).alias("key"))
    else:
        hosts = spark.createDataFrame([(f"={h.lower()}",) for h in listed_hosts], "key string")
    listed = spark.createDataFrame(
        [(h + p, v == "allow", v == "block", False) for v, h, p in rules], "key string, allow boolean, block boolean, host boolean"
    ).union(hosts.select("key", F.lit(False), F.lit(False), F.lit(True)))
    # The complete key universe of the corpus; equal keys meet in partial aggregates first.
    universe = settle(
        keys.union(listed).where(F.col("key").isNotNull()).groupBy("key").agg(*[F.max(c).alias(c) for c in ("allow", "block", "host")])
    )
    cascades = {c: build_cascade(universe, c) for c in ("allow", "block", "host")}
    fits = F.filter(
        F.transform(
            rule_keys(F.col("host"), F.col("path"), rules),
            lambda k: F.struct(
                k["size"].alias("size"), k["labels"].alias("labels"), k["key"].alias("key"),
                F.when(cascades["allow"].contains(k["key"]), "allow").when(cascades["block"].contains(k["key"]), "block").alias("verdict"),
            ),
        ),
        lambda k: k["verdict"].isNotNull(),
    )
    best = F.array_max(F.col("_fits"))
    listed_host = cascades["host"].contains(F.concat(F.lit("="), F.col("host")))
    return (
        parsed.withColumn("_fits", fits)
        .withColumns({
            "rule": best["key"],
            "verdict": F.coalesce(best["verdict"], F.when(listed_host, "block").otherwise("allow")),
        })
        .drop("_fits")
    )
