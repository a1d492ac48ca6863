"""Code pages: texts of one half of the rows teach, those of the other half come back from every page."""

import random

import pytest
from pyspark.sql import functions as F

from lexweave.functions import charset
from lexweave.functions import vocabulary as v
from lexweave.sources import documents as docs

CYRILLIC = ("cp1251", "cp866", "koi8-r", "mac_cyrillic")
WORDS = " ".join((*v.GIVEN_NAMES, *v.SURNAMES, *v.VEHICLE_CONTEXT, *v.STREETS, "Суд установил что истец просит взыскать задолженность по договору поставки с ответчика")).split()


def sentences(n, seed):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 12))) + "." for _ in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return charset.learn(spark.createDataFrame([(t,) for t in sentences(400, 1)] + [(None,), ("",)], "text string").repartition(4))


def test_every_page_comes_back(spark, model):
    rows = [(i, page, text, bytearray(text.encode(page))) for i, (text, page) in enumerate((t, p) for t in sentences(150, 2) for p in ("utf-8", *CYRILLIC))]
    out = charset.with_charset(spark.createDataFrame(rows, "n int, page string, want string, content binary").repartition(3), model).collect()
    wrong = [(r["page"], r["charset"], r["want"]) for r in out if r["text"] != r["want"]]
    assert len(wrong) <= len(rows) // 100, wrong[:5]


def test_odd_files(spark, model):
    assert model.of(b"plain") == "utf-8" and model.of(b"") == "utf-8"
    assert model.of(bytes(range(256))) in charset.PAGES + ("latin-1",)
    assert charset.Charsets(("ascii",), model.scores[:1]).of(b"\xe9") == "latin-1"
    df = spark.createDataFrame([(None, 1), (bytearray("Суд установил ".encode("koi8-r")) * 100_000, 2)], "content binary, n int")
    got = {r["n"]: (r["charset"], r["text"]) for r in charset.with_charset(df, model).collect()}
    assert got == {1: (None, None), 2: ("koi8-r", "Суд установил " * 100_000)}


def test_partitions_do_not_matter(spark, model):
    again = charset.learn(spark.createDataFrame([(t,) for t in sentences(400, 1)], "text string").repartition(1))
    assert (again.scores == model.scores).all()


def test_a_folder_as_a_stream(spark, tmp_path):
    """Files that arrive are read as those that are there: text, errors, paths."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("Привет".encode("cp1251"))
    (tmp_path / "in" / "b.exe").write_bytes(b"MZ")

    def run():
        running = docs.extract(docs.stream_files(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert running.awaitTermination(120) and running.exception() is None
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).withColumn("path", F.element_at(F.split("path", "/"), -1)).collect())

    assert run() == [("a.txt", "Привет", None), ("b.exe", None, "unsupported")]
    (tmp_path / "in" / "c.rtf").write_bytes(rb"{\rtf1\ansi\ansicpg1251 \'c4\'e0}")
    assert run()[2] == ("c.rtf", "Да", None)
    there = docs.extract(docs.read_files(spark, str(tmp_path / "in"))).withColumn("path", F.element_at(F.split("path", "/"), -1))
    assert sorted(map(tuple, there.collect())) == run()
