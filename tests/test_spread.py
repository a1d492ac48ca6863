"""Rows of small files are dealt out to many tasks where work on each is costly."""

import os
import random
import re
import textwrap

import pytest

import __spark_entry__ as entry
from lexweave.functions import pdf
from lexweave.sources import exports

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["pdf_contracts", "exported_reports", "person_decisions", "ru_fixture_anonymize"])
def test_customers_are_dealt_out(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().toString()
    assert "Repartition 16, true" in plan or "RoundRobinPartitioning(16)" in plan


def test_plain_values_are_those_read_step_by_step(monkeypatch):
    rng = random.Random(3)
    parts = [b"1", b"-2.50", b"+.5", b"7 0 R", b"7 0 Rx", b"12x", b"1.2.3", b"--1", b"/F1", b"/A#20B", b"/", b"<4a4B5>", b"<4 a>", b"<>", b"<< /K 5 0 R >>", b"[1 2]", b"(a(b)\\))", b"true", b"null", b"Tj", b"T*", b"'", b'"', b"*", b"%c\n", b"beginbfchar", b"<0001> <0416>", b"<0002><0431>", b"endbfchar", b"]", b">>"]
    streams = [b"".join(rng.choice(parts) + rng.choice([b" ", b"\n", b" ", b""]) for _ in range(rng.randrange(30))) for _ in range(2000)]

    def read(body, refs):
        parser, out = pdf.Parser(body, refs=refs), []
        while (parser.blank() or True) and parser.at < len(body):
            value = parser.value()
            out.append((type(value), value))
        return out

    def font(body):
        made = object.__new__(pdf._Font)
        made.map = {}
        made._read(body)
        return made.map

    quick = [(read(s, True), read(s, False), font(s)) for s in streams]
    monkeypatch.setattr(pdf, "_PLAIN", re.compile(rb"(?!)"))
    monkeypatch.setattr(pdf, "_CHARS", re.compile(rb"(?!)"))
    for s, want in zip(streams, quick):
        assert (read(s, True), read(s, False), font(s)) == want, s


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_reports_are_written_and_read_once(spark):
    plan = entry.queries()["exported_reports"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow run") == 1 and plan.count("ArrowEvalPython [run(") == 3


def test_short_lines_are_cut_as_textwrap_does():
    rng = random.Random(8)
    for _ in range(3000):
        line = "".join(rng.choice("ab —  \t,.") * rng.randrange(1, 3) for _ in range(rng.randrange(90)))
        assert exports._wrapped(line) == (textwrap.wrap(line, exports.LINE_CHARS) or [""]), line
