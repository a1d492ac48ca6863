"""Mixing sources to target weights by hierarchical budgeting.

The token budget flows down a tree of domain, language and source. At each node it is shared among the
children by weight; a child whose subtree can't fill its share gives the rest to its siblings, by weight, and
only what all siblings together can't take goes back to the ancestors. A leaf then takes its budget as whole
seeded epochs (orders of its documents) and the token prefix of a last one.

Everything is DataFrame work: token counts are aggregated first, the tree has a row a leaf, and a prefix
is found through per-slice sums of the shuffled order, so no leaf is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle

LEVELS = ("domain", "lang", "source")
#: Bytes of text that count as one token.
TOKEN_BYTES = 4
#: Documents that a slice of a leaf's shuffled order has on average.
SLICE = 100
#: A table of leaves of so many rows is broadcast (some 10 MB); a larger one is joined by shuffle.
MAX_BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class MixPlan:
    """Weights by level and name (others have `other`), the share of all tokens to take, the greatest
    number of times a document may be taken, and the seed of the orders."""

    weights: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    other: float = 1.0
    budget_share: float = 0.5
    max_epochs: int = 2
    seed: int = 7

    def weight(self, level: str) -> Column:
        out = F.lit(float(self.other))
        for name, w in sorted(self.weights.get(level, {}).items()):
            out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
        return out


#: Production parameters of the query op4.
PLAN = MixPlan(
    weights={"domain": {"hub": 2.0, "even": 2.0, "odd": 1.0}, "lang": {"en": 6.0, "de": 2.0, "fr": 1.0, "es": 1.0}},
    budget_share=0.6,
)


def tokens_of(text: Column) -> Column:
    """Estimated tokens of a text: its UTF-8 bytes by four, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / TOKEN_BYTES).cast("long")


def domain_of(source: Column) -> Column:
    """The domain of a source: hub for src0, even or odd by the number's last digit for other numbered ones."""
    return (
        F.when(source == "src0", "hub").when(source.rlike("[02468]$"), "even").when(source.rlike("[13579]$"), "odd").otherwise("other")
    )


def share_out(children: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds `budget` to children (parents..., name, weight, capacity, given): the parent's tokens `given`,
    shared by weight, none above its capacity, the rest among the siblings that have room.

    Children fill in the order of capacity by weight: those that fill up come first, all others get the same
    rate. A child of weight 0 gets nothing.
    """
    ratio = F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(0.0))
    order = W.partitionBy(*parents).orderBy("ratio", name)
    ahead = order.rowsBetween(W.unboundedPreceding, -1)
    left = W.partitionBy(*parents).orderBy("ratio", name).rowsBetween(W.currentRow, W.unboundedFollowing)
    filled = (
        children.withColumn("ratio", ratio)
        .withColumns({"full": F.coalesce(F.sum(F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0.0)).over(ahead), F.lit(0.0)), "open": F.sum("weight").over(left)})
        # The rate at which this child and all after it are served if those before it are full.
        .withColumn("rate", F.when(F.col("open") > 0, F.greatest(F.lit(0.0), F.col("given") - F.col("full")) / F.col("open")))
        .withColumn("served", F.when(F.col("rate") < F.col("ratio"), F.col("rate")))
        # The first child that isn't filled sets the rate for all after it.
        .withColumn("set", F.first("served", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    )
    budget = F.when(F.col("weight") <= 0, 0.0).when(F.col("set").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.col("set") * F.col("weight")))
    return filled.withColumn("budget", budget).drop("ratio", "full", "open", "rate", "served", "set", "given")


def leaf_budgets(leaves: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """leaves (domain, lang, source, docs, available tokens) with their budget in tokens.

    The table of leaves grows with the number of distinct sources only.
    """
    available = leaves.agg(F.sum("available")).first()[0] or 0
    at = leaves.withColumn("capacity", F.col("available").cast("double") * plan.max_epochs)
    roots = at.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumns({
        "weight": plan.weight("domain"), "given": F.lit(float(available) * plan.budget_share), "all": F.lit(0)})
    domains = share_out(roots, ["all"], "domain").select("domain", F.col("budget").alias("given"))
    by_lang = at.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("weight", plan.weight("lang"))
    langs = share_out(by_lang.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("given"))
    by_source = at.withColumn("weight", plan.weight("source")).join(langs, ["domain", "lang"])
    return share_out(by_source, ["domain", "lang"], "source").select(
        *LEVELS, "docs", "available", F.floor(F.round("budget", 3)).cast("long").alias("budget"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows, which are counted; else joined as Spark sees fit."""
    return F.broadcast(df) if df.count() <= MAX_BROADCAST_ROWS else df


def mix(documents: DataFrame, plan: MixPlan = PLAN) -> DataFrame:
    """What the mixture takes: the documents' rows with domain, epoch, tokens and taken (tokens of the prefix) added.

    `documents` has doc_id, text, lang, source and any other columns (those named domain, epoch, tokens or taken are
    replaced). In each epoch a leaf's documents stand in the order of md5(seed:epoch:doc_id), then doc_id and tokens;
    the last epoch ends where the budget is reached, and the document there is taken in part: `taken` of its tokens. A null
    lang or source is the name "". Empty texts have no tokens: they come along where a prefix passes them; a
    leaf without any tokens gives nothing. Repeated rows are documents of their own. An empty table gives an empty one.
    """
    # The input's columns go by numbers meanwhile, so that none of them can clash with a name used here.
    kept = [c for c in documents.columns if c not in ("domain", "epoch", "tokens", "taken")]
    named = documents.select(
        *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(kept)], "doc_id",
        F.coalesce("lang", F.lit("")).alias("_l"), F.coalesce("source", F.lit("")).alias("_s"), tokens_of(F.col("text")).alias("tokens"),
    ).withColumn("domain", domain_of(F.col("_s")))
    leaves = settle(
        named.groupBy("domain", F.col("_l").alias("lang"), F.col("_s").alias("source"))
        .agg(F.count("*").alias("docs"), F.sum("tokens").alias("available"))
    )
    epoch = F.explode(F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("available")).cast("int")))
    runs = settle(
        leaf_budgets(leaves, plan).where("budget > 0")
        .select("domain", F.col("lang").alias("_l"), F.col("source").alias("_s"), "available", "budget",
                F.greatest(F.lit(1), F.floor(F.col("docs") / SLICE)).cast("long").alias("slices"), epoch.alias("epoch"))
        .withColumn("wanted", F.least(F.col("available"), F.col("budget") - F.col("epoch") * F.col("available")))
        .select("domain", "_l", "_s", "slices", "epoch", "wanted")
    )
    leaf = ["domain", "_l", "_s"]

    def placed(rows: DataFrame, of: DataFrame) -> DataFrame:
        order = F.md5(F.concat_ws(":", F.lit(str(plan.seed)), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
        return rows.join(_small(of), leaf).withColumn("_order", order).withColumn(
            "_slice", F.floor(F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") * F.col("slices") / F.lit(1 << 32)).cast("long"))

    # Tokens of each slice of each epoch's order; the slice in which the budget is reached; what lies before it.
    slices = placed(named.select(*leaf, "doc_id", "tokens"), runs).groupBy(*leaf, "epoch", "slices", "wanted", "_slice").agg(F.sum("tokens").alias("here"))
    up_to = F.sum("here").over(W.partitionBy(*leaf, "epoch").orderBy("_slice"))
    borders = settle(
        slices.withColumn("to", up_to).where(F.col("to") >= F.col("wanted")).groupBy(*leaf, "epoch", "slices", "wanted")
        .agg(F.min(F.struct("_slice", (F.col("to") - F.col("here")).alias("before"))).alias("b"))
        .select(*leaf, "epoch", "slices", "wanted", F.col("b._slice").alias("border"), F.col("b.before").alias("before"))
    )
    reached = placed(named, borders).where(F.col("_slice") <= F.col("border"))
    whole = reached.where(F.col("_slice") < F.col("border")).withColumn("taken", F.col("tokens"))
    sofar = F.coalesce(F.sum("tokens").over(
        W.partitionBy(*leaf, "epoch").orderBy("_order", "doc_id", "tokens").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    last = reached.where(F.col("_slice") == F.col("border")).withColumn("_sofar", sofar).where(F.col("_sofar") < F.col("wanted")).withColumn(
        "taken", F.least(F.col("tokens"), F.col("wanted") - F.col("_sofar"))).drop("_sofar")
    return whole.union(last).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(kept)], "domain", "epoch", "tokens", "taken")


def cut_to(text, tokens):
    """The longest beginning of a text that has no more than so many tokens; a character is never split."""
    bytes_ = (tokens * TOKEN_BYTES).cast("int")
    # Characters of the first bytes; one that the border splits may count as up to three.
    most = F.length(F.make_valid_utf8(F.substring(text.cast("binary"), F.lit(1), bytes_).cast("string")))
    begun = [F.left(text, most - k) for k in range(4)]
    fits = [F.when(F.octet_length(t) <= bytes_, t) for t in begun]
    return F.when(F.octet_length(text) <= bytes_, text).otherwise(F.coalesce(*fits, F.left(text, F.lit(0))))
