"""Near-duplicate embeddings by a pivot-permutation index.

Every vector is described by its nearest pivots, nearest first. An inverted list for each
(label, pivot) holds the vectors that have the pivot among theirs; two vectors of a list are
candidates if they share enough pivots, and candidates are verified by their cosine in double precision.

Equal vectors of a label collapse into one entry with a count first. A list is worked on in blocks of at most BLOCK
entries, block against block, so a list of any length is spread over tasks; a pair counts in the list of its first
shared pivot only, and only counts and a spanning forest leave a block, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, settle

THRESHOLD = 0.93
#: Pivots that describe a vector, and how many two vectors must share.
NEAREST, SHARED = 10, 2
#: Pivots drawn: about the root of the number of vectors, within these bounds; at most 4 MB for 64 dimensions.
LEAST_PIVOTS, MOST_PIVOTS = 64, 8192
BLOCK = 1024
SEED = 11


def usable(embedding):
    """Not null, not zero, all components finite."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embedding.isNotNull() & ~bad & F.exists(embedding, lambda v: v != 0)


def draw_pivots(entries: DataFrame, n: int, seed: int = SEED) -> np.ndarray:
    """Unit vectors of a seeded sample of entries of the most frequent dimension: about sqrt(n) of them."""
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, ceil(sqrt(n))))
    rows = entries.orderBy(F.xxhash64(F.lit(seed), "least"), "least", "digest").select("embedding").limit(count).collect()
    vectors = [np.array(r[0], np.float64) for r in rows]
    size = max((len(v) for v in vectors), key=[len(v) for v in vectors].count, default=0)
    vectors = [v for v in vectors if len(v) == size]
    return np.stack([v / np.linalg.norm(v) for v in vectors]) if vectors else np.zeros((0, 0))


def _unit(rows) -> np.ndarray:
    x = np.array([np.asarray(v, np.float64) for v in rows])
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def describe(entries: DataFrame, pivots: np.ndarray, nearest: int = NEAREST) -> DataFrame:
    """Entries with `near`: the numbers of their nearest pivots, nearest first, ties by number."""
    k = min(nearest, len(pivots))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            near = []
            for v in pdf["embedding"]:
                near.append(np.asarray(v, np.float64))
            fits = np.array([len(v) == pivots.shape[1] for v in near], bool)
            out: list = [np.arange(k, dtype=np.int32)] * len(pdf)  # other dimensions: all in the first lists
            if fits.any():
                x = _unit([v for v, f in zip(near, fits) if f])
                order = np.argsort(-np.round(x @ pivots.T, 12), axis=1, kind="stable")[:, :k].astype(np.int32)
                for i, row in zip(np.flatnonzero(fits), order):
                    out[i] = row
            yield pdf.assign(near=out)

    return entries.mapInPandas(run, T.StructType([*entries.schema.fields, T.StructField("near", T.ArrayType(T.IntegerType()))]))


def _tile(pdf: pd.DataFrame, threshold: float, shared: int) -> pd.DataFrame:
    """Counts of links and a spanning forest of one block against another (or itself) of one list."""
    pivot, one, two = int(pdf["pivot"].iloc[0]), int(pdf["one"].iloc[0]), int(pdf["two"].iloc[0])
    pdf = pdf.sort_values("entry").reset_index(drop=True)
    sizes = pdf["embedding"].map(len).to_numpy()
    entry, count, chunk = pdf["entry"].to_numpy(), pdf["copies"].to_numpy(np.float64), pdf["chunk"].to_numpy()
    links, edges = np.zeros(len(pdf)), []
    parent = np.arange(len(pdf))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for p, q in zip(a, b):
            p, q = find(p), find(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
                edges.append((entry[p], entry[q]))

    near = np.stack(pdf["near"].to_numpy())
    local, codes = np.unique(near, return_inverse=True)
    has = np.zeros((len(pdf), len(local)), np.float32)
    has[np.arange(len(pdf))[:, None], codes.reshape(near.shape)] = 1
    before = has[:, local < pivot]
    for size in np.unique(sizes):
        own = np.flatnonzero(sizes == size)
        left, right = own[chunk[own] == one], own[chunk[own] == two]
        if not len(left) or not len(right):
            continue
        x, y = _unit(pdf["embedding"].iloc[left]), _unit(pdf["embedding"].iloc[right])
        for at in range(0, len(left), 256):
            rows = left[at : at + 256]
            want = (has[rows] @ has[right].T >= shared - 0.5) & (before[rows] @ before[right].T < 0.5)
            want &= (rows[:, None] < right[None]) if one == two else True
            want &= x[at : at + 256] @ y.T >= threshold
            i, j = np.nonzero(want)
            a, b = rows[i], right[j]
            np.add.at(links, a, count[b])
            np.add.at(links, b, count[a])
            # A pair for each row and column first; then those pairs that still join two trees.
            some = np.unique(np.concatenate([np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1]])).astype(np.int64)
            join(a[some], b[some])
            root = np.array([find(i) for i in range(len(parent))])
            apart = root[a] != root[b]
            join(a[apart], b[apart])
    some = np.flatnonzero(links)
    return pd.DataFrame({
        "a": np.concatenate([entry[some], [e[0] for e in edges]]).astype(np.int64),
        "b": np.concatenate([np.full(len(some), -1), [e[1] for e in edges]]).astype(np.int64),
        "links": np.concatenate([links[some], np.zeros(len(edges))]).astype(np.int64),
        "edge": np.concatenate([np.zeros(len(some), bool), np.ones(len(edges), bool)]),
    })


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """Per row of `vectors` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared if their labels are equal and not null. Null or zero vectors and those with a null or
    non-finite component link with nothing; so do vectors of different dimensions with each other. Repeated rows of one vec_id are
    vectors of their own: equal ones link as copies do, different ones as their cosine says. Other columns are left out; an empty table gives an empty one.
    """
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    good = base.where(usable(F.col("embedding")) & F.col("label").isNotNull())
    # Copies collapse in a partial aggregate by a digest of label and components.
    digest = F.sha2(F.to_json(F.struct("label", "embedding")), 256)
    keyed = good.withColumn("digest", digest)
    classes = keyed.groupBy("digest").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    # Numbered, as different vectors may share a vec_id; the numbers that are written stay.
    entries = settle(classes.withColumn("entry", F.monotonically_increasing_id()).select("digest", "entry", "least", "copies", "label", "embedding"))
    pivots = draw_pivots(entries, entries.count())
    if not len(pivots):
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    described = describe(entries.drop("digest", "least"), pivots, nearest)
    listed = settle(described.select("entry", "copies", "label", "embedding", "near", F.explode("near").alias("pivot")))
    blocks = listed.groupBy("label", "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    # An entry of block c meets all blocks: c is the first of the pair, or the second.
    chunk = F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")
    tiles = (
        listed.join(blocks, ["label", "pivot"]).withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")})
    )
    found = settle(tiles.groupBy("label", "pivot", "one", "two").applyInPandas(lambda pdf: _tile(pdf, threshold, shared), "a long, b long, links long, edge boolean"))
    counts = found.where("not edge").groupBy(F.col("a").alias("entry")).agg(F.sum("links").alias("links"))
    components = connected_components(found.where("edge").select("a", "b"))
    placed = (
        entries.select("digest", "entry", "least", "copies").join(counts, "entry", "left")
        .join(components.withColumnRenamed("node", "entry"), "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    )
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    known = placed.join(named, "component").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = keyed.select("vec_id", "digest").join(known, "digest").select("vec_id", "n_links", "component_id")
    alone = base.where(~(F.coalesce(usable(F.col("embedding")), F.lit(False)) & F.col("label").isNotNull())).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
