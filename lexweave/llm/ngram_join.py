"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 80 % or more.

The count-vector method hashes shingles into GROUPS groups and takes a document's group counts as a point; the
sum of two points' coordinate minima bounds their overlap from above, and an R-tree over points bounds whole
boxes at once. Points of long texts all lie in the middle of that space, so one tree over a corpus prunes next
to nothing (the README has figures). The tree therefore stands inside cells: a cell holds the documents that
have a certain shingle among their rarest ones, and by the prefix principle every pair that links meets in some
cell. What is exact stays exact: a pair is given up only if a bound rules it out.

1. Shingles are counted over all documents in a fixed table of hashed counters, which orders them by rarity.
2. Documents of equal sets are one class, named by a 64-bit digest of the set; copies are looked up once a task.
3. In each cell the members are paired with one of them, drawn by a hash; pairs that the bound allows are verified and
   joined into components. The pairs of a large group of near copies thus grow with its members, not with their square.
4. Cells whose members are in different components still are searched by an R-tree each, in blocks of a bounded
   size, for pairs across components; those are verified as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, id_filter, settle
from .counters import count_items, rarity, rarity_keys
from .textblocks import mix, shingle_sets, slices

GROUPS = 256
#: Entries of an R-tree's leaf, and of a block of a cell.
LEAF, BLOCK = 16, 2048
#: Tiles of at most so many members are compared row by row.
SMALL = 200
#: A pair links if 100 * intersection >= PERCENT * union.
PERCENT = 80


def least_overlap(a, b, percent: int = PERCENT):
    """The least overlap of two sets of these sizes that links: ceil(p * (a + b) / (100 + p))."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_sizes(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """How many of a set's rarest members must be looked up so that it meets every partner that is shorter
    (or as long), and every partner that is longer (or as long)."""
    shortest = -(-percent * n // 100)
    return n - least_overlap(n, shortest, percent) + 1, n - least_overlap(n, n, percent) + 1


def _shingles(texts: pa.Array) -> np.ndarray:
    sets = shingle_sets(texts)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def _point(shingles: np.ndarray) -> bytes:
    """A set's group counts, a byte each; four bytes each for a set so large that a byte doesn't hold one."""
    counts = np.bincount((shingles >> np.uint64(33)) % np.uint64(GROUPS), minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def _unpacked(points: list[bytes]) -> np.ndarray:
    """Points as rows of numbers: of bytes, unless one of them needs more."""
    if all(len(x) == GROUPS for x in points):
        return np.frombuffer(b"".join(points), np.uint8).reshape(-1, GROUPS)
    return np.stack([np.frombuffer(x, np.uint8 if len(x) == GROUPS else np.uint32) for x in points]).astype(np.uint32)


def _bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The summed coordinate minima of points, row by row."""
    return np.minimum(x, y).sum(-1, dtype=np.int64)


def set_digest(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set, that names its class."""
    zero = np.zeros(1, np.uint64)[0]
    mixed = mix(shingles ^ np.uint64(0x9E3779B97F4A7C15))
    both = mix(np.array([shingles.sum(dtype=np.uint64) ^ np.uint64(len(shingles)), np.bitwise_xor.reduce(mixed, initial=zero)], np.uint64))
    return int((both[0] ^ (both[1] * np.uint64(3))).astype(np.int64))


def _describe(texts: DataFrame, counters: np.ndarray, percent: int) -> DataFrame:
    """doc_id, n, the set's digest; and, once in a task for each digest, its point and its rarest shingles, with how
    many of those meet longer partners. Copies in one task thus are looked up once."""
    held = texts.sparkSession.sparkContext.broadcast(rarity(counters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_of = held.value
        seen: set[int] = set()  # a number for each text of the task
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                digests = [set_digest(s) for s in sets]
                rare, short, points = [], [], []
                for s, d in zip(sets, digests):
                    if not len(s) or d in seen:
                        rare.append(None), short.append(None), points.append(None)
                        continue
                    seen.add(d)
                    ahead, behind = prefix_sizes(len(s), percent)
                    # Rarity first, then the hash; 56 bits of a shingle's hash name it here, all 64 in verification.
                    keys = rarity_keys(s, rare_of)
                    if len(keys) > ahead:
                        keys = np.partition(keys, ahead - 1)[:ahead]
                    rare.append(np.sort(keys).view(np.int64)), short.append(behind), points.append(_point(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.int64()),
                     pa.array(points, pa.binary()), pa.array(rare, pa.list_(pa.int64())), pa.array(short, pa.int32())],
                    names=["doc_id", "n", "set", "point", "rare", "short"])

    return texts.mapInArrow(run, "doc_id long, n long, set long, point binary, rare array<bigint>, short int")


def _shared_cells(postings: DataFrame, percent: int) -> DataFrame:
    """(cell, id, n, at, head, head_n, head_at): the members of cells with two or more, each with the cell's head.

    postings: cell, id, n, at (twice the shingle's place among the rarest, from 1, plus 1 if longer partners are met there). Cells are streamed in sorted order; of each only
    the head and the row before are held.
    """
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: np.ndarray | None = None  # the last row so far, not yet given out: cell, id, n, at
        head: tuple | None = None  # the open cell's first row

        def give(rows: np.ndarray, last: bool) -> tuple[pa.RecordBatch | None, np.ndarray | None]:
            nonlocal head
            if not len(rows):
                return None, None
            first = np.ones(len(rows), bool)
            first[1:] = rows[1:, 0] != rows[:-1, 0]
            goes_on = head is not None and rows[0, 0] == head[0]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
            heads = rows[lead]
            if goes_on:
                heads[lead == 0] = head
            alone = first.copy()
            alone[0] = not goes_on
            many = np.ones(len(rows), bool)
            many[:-1] = ~(alone[:-1] & first[1:])
            many[-1] = not alone[-1]
            keep = None
            if not last:  # whether the last row is alone shows with the next batch
                keep, rows, heads, many, tail = rows[-1:], rows[:-1], heads[:-1], many[:-1], tuple(heads[-1])
                head = tail if not alone[-1] else None
            out = np.flatnonzero(many)
            cols = [rows[out, 0], rows[out, 1], rows[out, 2], rows[out, 3], heads[out, 1], heads[out, 2], heads[out, 3]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["cell", "id", "n", "at", "head", "head_n", "head_at"]), keep

        for batch in batches:
            rows = np.stack([batch.column(c).cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("cell", "id", "n", "at")], 1)
            if carry is not None:
                rows = np.concatenate([carry, rows])
            again = np.zeros(len(rows), bool)  # a class that several tasks have looked up
            again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(1)
            made, carry = give(rows[~again], False)
            if made is not None:
                yield made
        if carry is not None:
            made, _ = give(carry, True)
            if made is not None:
                yield made

    # The head is drawn by a hash of cell and member, so a member that is in many cells meets as many different heads.
    dealt = postings.repartition(parts, "cell").sortWithinPartitions("cell", F.xxhash64("cell", "id"), "id")
    return dealt.mapInArrow(run, "cell long, id long, n long, at long, head long, head_n long, head_at long")


class RTree:
    """A packed R-tree over points: leaves of LEAF neighbours, boxes of their coordinates' maxima and sizes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray) -> None:
        order = np.lexsort((points.argmax(1), sizes))  # size first, as the overlap asked for depends on it
        self.order = order
        self.points, self.sizes = points[order], sizes[order]
        begins = np.arange(0, len(order), LEAF)
        self.levels = [(np.maximum.reduceat(self.points, begins), np.minimum.reduceat(self.sizes, begins), np.maximum.reduceat(self.sizes, begins))]
        while len(self.levels[-1][0]) > LEAF:
            begins = np.arange(0, len(self.levels[-1][0]), LEAF)
            top, low, high = self.levels[-1]
            self.levels.append((np.maximum.reduceat(top, begins), np.minimum.reduceat(low, begins), np.maximum.reduceat(high, begins)))

    def search(self, point: np.ndarray, size: int, percent: int = PERCENT) -> np.ndarray:
        """The entries whose bound allows a link with the point: sum of minima >= the overlap asked for."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            top, low, high = self.levels[depth]
            fits = (100 * high[at] >= percent * size) & (100 * size >= percent * low[at])
            fits &= _bound(top[at], point) >= least_overlap(size, low[at], percent)
            at = at[fits]
            width = len(self.levels[depth - 1][0]) if depth else len(self.order)
            at = (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            at = at[at < width]
        own = (100 * self.sizes[at] >= percent * size) & (100 * size >= percent * self.sizes[at])
        own &= _bound(self.points[at], point) >= least_overlap(size, self.sizes[at], percent)
        return self.order[at[own]]


def _may_link(n, at, part, i, j, percent: int) -> np.ndarray:
    """Of pairs (i, j) of one cell those in different components whose lengths and places allow a link.

    If the cell's shingle is the first that two sets share, what stands before it isn't shared: the overlap is at most one
    plus the shorter rest. A pair that links passes in the cell of its first shared shingle.
    """
    ni, nj, pi, pj = n[i], n[j], at[i] >> 1, at[j] >> 1
    meets = np.where(ni < nj, at[i] & 1, np.where(nj < ni, at[j] & 1, 1)) == 1
    small, large = np.minimum(ni, nj), np.maximum(ni, nj)
    return meets & (part[i] != part[j]) & (100 * small >= percent * large) & (1 + np.minimum(ni - pi, nj - pj) >= least_overlap(ni, nj, percent))


def _cross_pairs(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that the bounds allow, from tiles (cell, one, two, chunk, id, n, at, component, point).

    A tile is a block of a cell against another, or against itself. Tiles are streamed in sorted order; small ones are
    compared row by row, large ones through an R-tree of their second block.
    """
    parts = int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(table: pa.Table) -> pa.RecordBatch:
            cell, one, two, chunk, ids, n, at, part = (table.column(c).to_numpy() for c in ("cell", "one", "two", "chunk", "id", "n", "at", "component"))
            points = _unpacked(table.column("point").to_pylist())
            new = np.ones(len(cell), bool)
            new[1:] = (cell[1:] != cell[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])
            begins = np.flatnonzero(new)
            left, right = [], []
            for a, b in zip(begins, np.append(begins[1:], len(cell))):
                if b - a <= SMALL:
                    i, j = np.triu_indices(b - a, 1)
                    i, j = i + a, j + a
                    if one[a] != two[a]:
                        across = chunk[i] != chunk[j]
                        i, j = i[across], j[across]
                    ok = _may_link(n, at, part, i, j, percent)
                    left.append(i[ok]), right.append(j[ok])
                    continue
                first, second = a + np.flatnonzero(chunk[a:b] == one[a]), a + np.flatnonzero(chunk[a:b] == two[a])
                if len(first) and len(second):
                    tree = RTree(points[second], n[second])
                    for i in first:
                        j = second[tree.search(points[i], n[i], percent)]
                        if one[a] == two[a]:
                            j = j[j > i]
                        i = np.full(len(j), i)
                        ok = _may_link(n, at, part, i, j, percent)
                        left.append(i[ok]), right.append(j[ok])
            i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            # The same pair meets in many cells; its bound is worked out once.
            low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            _, once = np.unique(np.stack([low, high], 1), axis=0, return_index=True)
            i, j, low, high = i[once], j[once], low[once], high[once]
            ok = [_bound(points[i[k : k + 20_000]], points[j[k : k + 20_000]]) >= least_overlap(n[i[k : k + 20_000]], n[j[k : k + 20_000]], percent) for k in range(0, len(i), 20_000)]
            ok = np.concatenate(ok) if ok else np.zeros(0, bool)
            return pa.RecordBatch.from_arrays([pa.array(low[ok]), pa.array(high[ok])], names=["a", "b"])

        carry: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if carry is not None:
                table = pa.concat_tables([carry, table])
            key = [table.column(c).to_numpy() for c in ("cell", "one", "two")]
            end = len(key[0])
            while end and all(k[end - 1] == k[-1] for k in key):  # the last tile may go on in the next batch
                end -= 1
            if end:
                yield pairs_of(table.slice(0, end).combine_chunks())
            carry = table.slice(end).combine_chunks()
        if carry is not None and len(carry):
            yield pairs_of(carry)

    keys = ("cell", "one", "two")
    dealt = tiles.select("cell", "one", "two", "chunk", "id", "n", "at", "component", "point").repartition(parts, *keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(run, "a long, b long")


def _allowed(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b, na, nb) whose summed coordinate minima allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_unpacked(batch.column(c).to_pylist()) for c in ("pa", "pb"))
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            yield batch.select(["a", "b"]).filter(pa.array(_bound(x, y) >= least_overlap(na, nb, percent), pa.bool_()))

    joined = pairs.join(points.select(F.col("id").alias("a"), F.col("point").alias("pa")), "a").join(points.select(F.col("id").alias("b"), F.col("point").alias("pb")), "b")
    return joined.select("a", "b", "na", "nb", "pa", "pb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles as bytes) of the classes in `wanted` (id, doc_id: a document of the class)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])

    wanted = settle(wanted)
    held = texts.where(id_filter(wanted, "doc_id")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return held.mapInArrow(run, "id long, shingles binary").join(wanted.select("id"), "id", "left_semi").dropDuplicates(["id"])


def jaccard_components(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id, text).

    Words are runs without white space, A-Z lower-cased; a set holds the distinct five-word shingles, of fewer words the
    whole sequence. Texts without words and null texts have an empty set and link with nothing. component_id: the
    smallest doc_id reachable by links, itself included. Repeated rows link as copies do; each row is
    returned. Null ids are components of their own (null). Other columns are left out; an empty table gives an empty one.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = settle(_describe(texts, count_items(texts, _shingles), percent))
    some = base.where("n > 0 and doc_id is not null")
    classes = settle(some.groupBy(F.col("set").alias("id")).agg(F.min("doc_id").alias("doc_id")))
    postings = base.where("rare is not null").select(F.col("set").alias("id"), "n", "short", F.posexplode("rare").alias("at", "cell")).select("cell", "id", "n", ((F.col("at") + 1) * 2 + (F.col("at") < F.col("short")).cast("int")).cast("long").alias("at"))
    cells = settle(_shared_cells(postings, percent))
    looked_up = base.where("point is not null").select(F.col("set").alias("id"), "point").dropDuplicates(["id"])
    points = settle(looked_up.join(cells.select("id").distinct(), "id", "left_semi"))
    # Every member with its cell's head.
    rest = F.least(F.col("n") - F.shiftright("at", 1), F.col("head_n") - F.shiftright("head_at", 1)) + 1
    needed = F.ceil((F.col("n") + F.col("head_n")) * percent / (100 + percent))
    near = cells.where((F.col("id") != F.col("head")) & (100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n")) & (rest >= needed))
    swap = F.col("id") < F.col("head")
    star = near.select(*[F.when(swap, x).otherwise(y).alias(c) for c, x, y in (
        ("a", F.col("id"), F.col("head")), ("b", F.col("head"), F.col("id")), ("na", F.col("n"), F.col("head_n")), ("nb", F.col("head_n"), F.col("n")))]).distinct()
    star = settle(_allowed(star, points, percent))
    of_pairs = lambda pairs: pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct().join(classes, "id")
    first_sets = settle(_sets_of(texts, of_pairs(star)))
    links = settle(_verified(star, first_sets, percent))
    joined = connected_components(links)
    # Cells that hold several components; cells of equal members are searched once.
    placed = cells.join(joined.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    # (the first of them in the order of rarity, where the places of a pair that links allow it).
    mark = F.xxhash64("id")
    open_cells = (
        placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum(mark.cast("decimal(38,0)")).alias("m1"), F.bit_xor(mark).alias("m2"), F.count("*").alias("members"))
        .where("low < high").groupBy("m1", "m2", "members").agg(F.min("cell").alias("cell"))
        .select("cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    )
    tiles = (
        placed.select("cell", "id", "n", "at", "component").join(open_cells, "cell").join(points, "id")
        .withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")})
    )
    across = _cross_pairs(tiles, percent).distinct()
    across = settle(across.join(star, ["a", "b"], "left_anti"))
    if not across.isEmpty():
        more_sets = settle(_sets_of(texts, of_pairs(across)))
        found = settle(_verified(across, more_sets, percent))
        if not found.isEmpty():
            joined = connected_components(links.union(found))
    # Components of classes are named by their least digest; of documents by their least id.
    named = settle(classes.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", "doc_id", F.coalesce("component", "id").alias("component")))
    least = settle(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    known = settle(named.join(least, "component").select(F.col("id").alias("set"), "component_id"))
    rows = base.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set")).alias("set")).join(known, "set", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
