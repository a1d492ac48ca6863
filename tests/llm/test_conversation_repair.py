"""Conversation repair against an enumeration of all edits, odd rows included."""

import hashlib
import random
import re
import zlib
from itertools import product

from lexweave.llm import conversation_repair as cr

TURNS = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(signature):
    """Every way to keep, rerole or delete each row, with up to two rows inserted at each place."""
    found = []
    inserts = [""] + ["u", "a", "uu", "ua", "au", "aa"]
    for gaps in product(inserts, repeat=len(signature) + 1):
        if sum(map(len, gaps)) > 3:
            continue
        for edits in product("KUAD", repeat=len(signature)):  # U and A rerole
            roles, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * sum(map(len, gaps))
            for letter, edit, gap in zip(signature, edits, gaps[1:]):
                if letter == "x" and edit != "D":
                    break
                roles += {"K": letter.lower(), "U": "u", "A": "a", "D": ""}[edit] + gap
                audit += ("R" if edit in "UA" else edit) + "I" * len(gap)
                cost += {"K": 0, "U": 2, "A": 2, "D": 3}[edit] + (edit != "D" and letter.isupper())
            else:
                if GRAMMAR.fullmatch(roles):
                    found.append((cost, audit))
    return min(found)


def test_solve_against_all_edits():
    every = ["".join(p) for n in range(4) for p in product("suaoxSUAO", repeat=n)]
    rng = random.Random(5)
    chosen = [s for s in every if len(s) < 3] + rng.sample([s for s in every if len(s) == 3], 60)
    solved = cr.solve(chosen)
    for s in chosen:
        assert solved[s] == cheapest(s), s


def test_shared_prefixes_are_solved_once(monkeypatch):
    steps = []
    real = cr._next_layer
    monkeypatch.setattr(cr, "_next_layer", lambda layer, letter: (steps.append(letter), real(layer, letter))[1])
    signatures = ["uaua", "uau", "ua", "uaux", "sua", "uaua", ""]
    cr.solve(signatures)
    assert len(steps) == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


def test_long_signature():
    signature = "uaUxAo" * 20_000
    cost, audit = cr.solve([signature])[signature]
    assert len(audit.replace("I", "")) == len(signature) and cost > 0
    roles = [p["role"] or {"u": "user", "a": "assistant"}[signature[p["row"]].lower()] for p in cr.picks(signature, audit)]
    assert roles == ["user", "assistant"] * (len(roles) // 2)


def brute(rows):
    """The contract, row by row."""
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 4:
            role = "user"
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, counts, signature = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, ""
        for _, role, text in own:
            shown = text.strip(" \t\n\x0b\f\r")
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = cheapest(signature) if len(signature) < 4 else cr.solve([signature])[signature]
        lines, rest = [], list(own)
        for edit in audit:
            said = len(lines) - (bool(lines) and lines[0].startswith("s"))
            role = "assistant" if said % 2 else "user"
            if edit == "I":
                lines.append(f"{role}:")
            else:
                _, own_role, text = rest.pop(0)
                if edit != "D":
                    lines.append(f"{role if edit == 'R' else own_role}:{text}")
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def test_against_brute_force(spark):
    rng = random.Random(2)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "u"], ["Yes.", "No", "Why?", "", None, " \n\t", "😀 done!\n", "a.b", "x" * 50_000 + "."]
    rows = [(rng.choice([*range(120), None]), rng.choice([0, 1, 2, 5, None]), rng.choice(roles), rng.choice(texts)) for _ in range(400)]
    rows += [(500, t, "assistant" if t % 2 else "user", f"Turn {t}.") for t in range(300)] + [(600, 1, "user", "Same.")] * 5
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS rows", "'x' AS cost", "2 AS fault", "3 AS how").repartition(3)
    found = cr.repair_digests(cr.repair_conversations(cr.damage(df)))
    got = {r[0]: tuple(r)[1:] for r in found.collect()}
    assert got == brute(rows)
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    one = cr.repair_digests(cr.repair_conversations(cr.damage(spark.createDataFrame([(dropped, 0, "user", "Gone.")], TURNS)))).first()
    assert tuple(one) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert cr.repair_conversations(cr.damage(df.limit(0))).count() == 0


def test_rows_are_shuffled_once(spark):
    df = spark.createDataFrame([(1, 1, "user", "a.")], TURNS)
    plan = cr.repair_digests(cr.repair_conversations(cr.damage(df)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
