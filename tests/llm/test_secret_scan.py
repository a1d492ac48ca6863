"""Secret scans against Python's own expressions, and the automaton's parts."""

import hashlib
import random
import re

import numpy as np
import pytest

from lexweave.llm import automaton, secret_scan
from lexweave.llm.automaton import Anchored, Automaton, Rule

KEY = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: kind, expression with the measured part as its group, least length of it
PLAIN = [
    ("assign", KEY + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8), ("access", "(AKIA[A-Z0-9]+)", 16), ("hex", "([0-9a-f]+)", 32),
    ("github", "gh[pousr]_([A-Za-z0-9]+)", 36), ("slack", "xox[abprs]-([A-Za-z0-9-]+)", 10), ("google", "AIza([A-Za-z0-9_-]+)", 35),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.([A-Za-z0-9_-]+)", 10),
]


def brute(text):
    found = []
    for k, (kind, expression, least) in enumerate(PLAIN):
        found += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(expression, text or "") if len(m.group(1)) >= least]
    return [s for *_, s in sorted(found)]


def hard_texts():
    rng = random.Random(4)
    parts = [
        "password", "PassWD", "secret", "token", "api_key", "APIKEY", "passw", "tok", ": ", "=", " = ", "'", '"', "==", ":=", "abc", "abcdefgh1", "xyz.12-/+", "AKIA", "AKIAABCDEFGHIJKL", "AKI", "0123456789abcdef", "deadbeef" * 4,
        "f" * 31, "f" * 40, " ", "\n", "é", "漢字", "😀", "ghp_", "a1B2" * 9, "xoxb-", "12345-67890", "AIza", "x_-9" * 9, "eyJ", "eyJhbGci.eyJzdWIi.", ".", "ſecret=abcdefgh", "token=secret:abcdefgh", "_",
    ]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    return texts + ["", None, "a", "f" * 5000, "token=" + "a" * 70_000, ("secret = 'hunter2hunter2' " * 3000), "token=abcdefgh"]


def test_against_plain_expressions(spark):
    texts = hard_texts()
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(7, "token=abcdefgh", "y", 0), (None, "AKIAABCDEFGHIJKL1", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind long").repartition(4)
    found = secret_scan.scan_digests(secret_scan.scan(df)).collect()
    want = []
    for i, t, *_ in rows:
        spans = brute(t)
        base = [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")]
        want.append((i, *(sum(s.startswith(k + ":") for s in spans) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(base).encode()).hexdigest(), ",".join(spans)))
    order = lambda r: (r[0] is None, r[0] or 0, r[5])
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)
    assert secret_scan.scan(df.limit(0)).count() == 0


def test_lanes_do_not_matter():
    """However the bytes are cut into lanes, also through long matches, the same ends are found."""
    data = np.frombuffer("\xff".join(t or "" for t in hard_texts()[-60:]).encode("latin-1", "replace") + b"\xff", np.uint8)
    machine = automaton.compiled(secret_scan.RULES)
    want = machine.ends(data, lanes=1)
    for lanes, lane in ((2, 1), (7, 1), (64, 16), (4096, 3)):
        got = machine.ends(data, lanes, lane)
        assert all(np.array_equal(a, b) for a, b in zip(want, got))


def test_equal_states_are_merged():
    machine = Automaton((Rule("a", "x(ab|cb)", "d+", 1),))
    assert len(machine.ended) < machine.subsets
    data = np.frombuffer(b"xabdd xcbd x\xff", np.uint8)
    assert machine.ends(data)[0].tolist() == [5, 10]


def test_rules_that_cannot_be_followed():
    with pytest.raises(ValueError, match="run on"):
        Automaton((Rule("a", "", "ab(cd)?", 1),))
    with pytest.raises(ValueError, match="ends first"):
        Automaton((Rule("a", "", "(abcd+|bc+)", 1),))


def test_anchored():
    forth, back = Anchored("a(b|c)+d?"), Anchored("a(b|c)+d?", backwards=True)
    assert forth.longest(b"xabcbdz", 1, 7) == 6 and forth.longest(b"xabcbdz", 0, 7) == 0
    assert back.longest(b"xabcbdz", 6, 0) == 1 and back.longest(b"abab", 4, 0) == 2
