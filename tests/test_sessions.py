"""Review sessions: tables by windows, streams by timers, both against the plain rule."""

import random

import pytest

from lexweave.streaming.jobs import session_states

OPERATIONS = "session_id string, seq long, op string, at double, data string"


def plain(rows, ttl):
    held, out = {}, []
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in (r[1], r[2], r[3] or 0.0, r[4]))
    for sid, seq, op, at, data in sorted(rows, key=key):
        at = at or 0.0
        if sid in held and at > held[sid][1]:
            del held[sid]
        if op == "create":
            held[sid] = (data, at + ttl)
        elif op == "update" and sid in held:
            held[sid] = (data, held[sid][1])
        out.append((sid, seq, op, sid in held, held[sid][0] if sid in held and op != "delete" else None))
        if op == "delete":
            held.pop(sid, None)
    return sorted(out, key=str)


def operations(seed=3, n=400):
    rng = random.Random(seed)
    rows, clock = [], 0.0
    for seq in range(n):
        clock += rng.choice([0.0, 1.0, 7.5, 30.0])
        rows.append((rng.choice(["a", "b", "c", None]), seq, rng.choice(["create", "get", "get", "update", "delete", "other"]), clock, rng.choice(["x", "y", None])))
    return rows


def test_table_against_the_plain_rule(spark):
    rows = operations() + [("d", 1, "create", 100.0, "x"), ("d", 2, "get", 300.0, None), ("d", 3, "get", 5.0, None), ("e", None, None, None, None), ("e", 1, "create", None, "q"), ("e", 2, "get", None, None)]
    df = spark.createDataFrame(rows, OPERATIONS).selectExpr("*", "1 AS life", "true AS ok").repartition(3)
    out = session_states(df, ttl=60.0)
    assert sorted(map(tuple, out.collect()), key=str) == plain(rows, 60.0)
    assert session_states(df.limit(0)).count() == 0
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stream(spark, tmp_path):
    """Feeds batches of operations to one stream, one micro-batch each, and gives what came out so far and what is held."""
    chosen = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(chosen)

    def feed(*batches, ttl=60.0, late="0 seconds"):
        for rows in batches:
            rows = [(sid, seq, op, 1e9 + at, data) for sid, seq, op, at, data in rows]
            spark.createDataFrame(rows, OPERATIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            source = spark.readStream.schema(OPERATIONS).parquet(f"{tmp_path}/in")
            running = session_states(source, ttl, late).writeStream.format("parquet").option("path", f"{tmp_path}/out").option(
                "checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
            assert running.awaitTermination(120) and running.exception() is None
        out = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()), key=str)
        held = spark.read.format("statestore").option("stateVarName", "session").load(f"{tmp_path}/checkpoint")
        return out, sorted(r["key"]["session_id"] for r in held.collect())

    yield feed
    spark.conf.set(chosen, before)


def test_stream_forgets_a_session_nobody_asks_for(stream):
    """The clock of the stream moves on by other sessions' operations; the timer then removes the state."""
    _, held = stream([("a", 1, "create", 0.0, "x"), ("b", 1, "create", 5.0, "y")])
    assert held == ["a", "b"]
    _, held = stream([("b", 2, "update", 59.5, "z")])  # the watermark is still behind both
    assert held == ["a", "b"]
    _, held = stream([("c", 1, "get", 61.0, None)])
    assert held == ["b"]  # a ended at 60
    out, held = stream([("b", 3, "get", 65.0, None), ("d", 1, "create", 200.0, "q")], [("d", 2, "delete", 201.0, None)], [("c", 2, "get", 202.0, None)])
    assert held == [] and ("b", 3, "get", True, "z") in out and ("d", 2, "delete", True, None) in out


def test_stream_gives_what_the_table_gives(stream):
    rows = operations(9, 90)
    out, _ = stream(rows[:30], rows[30:60], rows[60:], late="1 hour")
    assert out == plain(rows, 60.0)


def test_a_new_session_has_its_own_timer(stream):
    out, held = stream([("a", 1, "create", 0.0, "x")], [("a", 2, "create", 50.0, "y")], [("z", 1, "get", 70.0, None)], [("z", 2, "get", 71.0, None)])
    assert held == ["a"]  # the first creation's end has passed, the second's hasn't
    out, held = stream([("a", 3, "get", 110.0, None), ("z", 3, "get", 120.0, None)], [("z", 4, "get", 121.0, None)])
    assert ("a", 3, "get", True, "y") in out and held == []
