"""Cascades of several filters a level, and of a size that the universe asks for."""

import pytest
from pyspark.sql import functions as F

from lexweave.llm import url_filter


def universe(spark, n, every):
    return spark.range(n).select(F.concat(F.lit("=host"), "id", F.lit(".example")).alias("key"), (F.col("id") % every == 0).alias("listed")).repartition(5)


@pytest.mark.parametrize("most", [64, 256, 1 << 24])
def test_any_size_of_filter_answers_exactly(spark, monkeypatch, most):
    """However small a filter may be, a level of many keys has several, chosen by the key's hash."""
    monkeypatch.setattr(url_filter, "MAX_BITS", most)
    keys = universe(spark, 600, 12)
    cascade = url_filter.build_cascade(keys, "listed")
    assert (len(cascade.levels[0]) > 1) == (most < 1 << 24)
    assert keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_first_level_grows_with_the_universe(spark):
    """Few listed keys among very many others: what the first level holds wrongly is no more than a few times what is listed."""
    keys = universe(spark, 60_000, 20_000)
    cascade = url_filter.build_cascade(keys, "listed")
    held = keys.where(~F.col("listed") & url_filter._held(F.col("key"), 0, cascade.levels[0])).count()
    assert held <= 12 and keys.where(cascade.contains(F.col("key")) != F.col("listed")).count() == 0


def test_too_many_keys_for_every_task(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BITS", 64)
    monkeypatch.setattr(url_filter, "MOST_FILTERS", 3)
    with pytest.raises(ValueError, match="more than every task can hold"):
        url_filter.build_cascade(universe(spark, 500, 2), "listed")


def test_urls_with_small_filters(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://Host{i}.example/x?y") for i in range(200)] + [(None, None)], "page_id long, url string")
    listed = [f"host{i}.example" for i in range(0, 200, 3)]
    monkeypatch.setattr(url_filter, "MAX_BITS", 128)
    out = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, listed_hosts=listed).collect()}
    assert out == {i: "block" if i % 3 == 0 else "allow" for i in range(200)} | {None: "allow"}
