"""Repairing the structure of conversations: dynamic programming over tries of signatures.

A conversation's rows are marked with faults and written as a signature, one letter a row. The cheapest edits that make
the roles `(s?(ua)+)?` depend on the signature alone. The signatures of a batch are sorted and inserted into a prefix
trie; each node's layer (the best cost for each place in the grammar) is computed once from its parent's, so shared
prefixes cost nothing, and a node where signatures end gives their answer.

Rows, faults, texts and digests are column expressions; Python sees signatures only. Rows are shuffled once, by
conversation; the same signature may belong to any number of conversations without a join or a shuffle by it.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits; an undeleted truncated row costs 1 more.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: A row's first fault. Those from DUPLICATE on must be deleted.
FAULTS = ("none", "truncated", "duplicate", "blank")

# Places in the grammar: nothing said yet, after the system's, a user's, an assistant's row.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The place after 0, 1 or 2 inserted rows; three are never cheaper than one.
_INSERTED = ((_START, _USER, _ASSISTANT), (_SYSTEM, _USER, _ASSISTANT), (_USER, _ASSISTANT, _USER), (_ASSISTANT, _USER, _ASSISTANT))

# A layer has (cost above the layer's least, rank) for each place, or None where it can't be reached. The rank orders the
# edits that lead there as strings. Edits up to a row end with that row's letter, so none begins with another, and what
# follows can't change their order.
_ROOT = ((0, 0), None, None, None)


def _after(place: int, letter: str) -> Iterable[tuple[str, int, int]]:
    """What can be done with a row at that place: edit, cost, next place."""
    yield "D", DELETE, place
    if letter == "x":
        return
    more, role = (TRUNCATED if letter.isupper() else 0), letter.lower()
    wanted = _ASSISTANT if place == _USER else _USER
    if role == "s" and place == _START:
        yield "K", KEEP + more, _SYSTEM
    elif role == " ua"[wanted - 1]:
        yield "K", KEEP + more, wanted
    yield "R", REROLE + more, wanted


@lru_cache(1 << 16)
def _next_layer(layer: tuple, letter: str) -> tuple[int, tuple, tuple]:
    """The layer after one more row: cost added to the least, the layer, and for each place where it came from and by which edits."""
    best: dict[int, tuple[int, int, str, int]] = {}
    for place, found in enumerate(layer):
        if found is None:
            continue
        for n, at in enumerate(_INSERTED[place]):
            for edit, cost, to in _after(at, letter):
                offer = (found[0] + n * INSERT + cost, found[1], "I" * n + edit, place)
                if to not in best or offer < best[to]:
                    best[to] = offer
    least = min(cost for cost, *_ in best.values())
    order = {to: rank for rank, to in enumerate(sorted(best, key=lambda to: best[to][1:3]))}
    return (
        least,
        tuple((best[to][0] - least, order[to]) if to in best else None for to in range(4)),
        tuple((best[to][3], best[to][2]) if to in best else None for to in range(4)),
    )


def _last(layer: tuple) -> tuple[int, int, str]:
    """Of a layer after the last row: cost above its least, the best place, and the rows inserted at the end."""
    needed = {_START: 0, _SYSTEM: 2, _USER: 1, _ASSISTANT: 0}
    cost, _, n, place = min((found[0] + needed[p] * INSERT, found[1], needed[p], p) for p, found in enumerate(layer) if found)
    return cost, place, "I" * n


def solve(signatures: Iterable[str]) -> dict[str, tuple[int, str]]:
    """For each different signature the least cost and the ASCII-least edits of that cost.

    Sorted signatures walk their trie depth first: `path` holds the nodes from the root to the last signature's end,
    and each new one keeps those nodes that it shares.
    """
    out: dict[str, tuple[int, str]] = {}
    path = [(_ROOT, 0, None)]
    before = ""
    for signature in sorted(set(signatures)):
        shared = next((i for i, (x, y) in enumerate(zip(before, signature)) if x != y), min(len(before), len(signature)))
        del path[shared + 1 :]
        for letter in signature[shared:]:
            added, layer, back = _next_layer(path[-1][0], letter)
            path.append((layer, path[-1][1] + added, back))
        cost, place, end = _last(path[-1][0])
        edits = [end]
        for _, _, back in reversed(path[1:]):
            place, edit = back[place]
            edits.append(edit)
        out[signature] = path[-1][1] + cost, "".join(reversed(edits))
        before = signature
    return out


def picks(signature: str, audit: str) -> list[dict]:
    """The repaired rows: the row that is kept, or none, and the role given to it, or none where it keeps its own."""
    out, row, said = [], -1, 0
    for edit in audit:
        row += edit != "I"
        if edit == "D":
            continue
        given = None if edit == "K" else "assistant" if said % 2 else "user"
        out.append({"row": None if edit == "I" else row, "role": given})
        said += not (edit == "K" and signature[row] in "sS")
    return out


_REPAIR = "cost bigint, audit string, picks array<struct<row:int,role:string>>"


def _repairs(signatures: pa.Array) -> pa.Array:
    coded = signatures.dictionary_encode()
    different = coded.dictionary.to_pylist()
    solved = solve(different)
    kind = pa.struct([("cost", pa.int64()), ("audit", pa.string()), ("picks", pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())])))])
    answers = [{"cost": solved[s][0], "audit": solved[s][1], "picks": picks(s, solved[s][1])} for s in different]
    return pa.array(answers, kind).take(coded.indices)


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present of rows after seeded faults; nulls of the last two become one space.

    crc32 of `conv_id:turn` (nulls one space) modulo 20: 0 drops the row (present is false), 1 empties its text, 2 takes
    its full stops, exclamation and question marks, 3 repeats it, 4 makes its role user.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    marked = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), how.alias("how"))
    changed = marked.select(
        "conv_id", "turn",
        F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("how") != 0).alias("present"),
        F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    )
    return changed.drop("copy")


_SPACE = " \t\n\x0b\f\r"


def _fault(text: Column, place: Column) -> Column:
    shown = F.rtrim(text, F.lit(_SPACE))
    return F.when(shown == "", 3).when(place > 1, 2).when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    `turns` has conv_id, turn, role, text and present; rows that aren't present only make their conv_id appear, other
    columns are left out. rows: array<struct<turn, role, text, fault>> as marked; repaired: array<struct<role, text>>.

    Rows stand by turn (nulls first), then role, then text; equal rows are repeats, the later ones duplicates. Null roles
    and texts count as one space, so such a text is blank; null conv_ids are one conversation. An empty table gives an
    empty one; a conversation without rows has zeros and an empty audit. Like every row of its output, a conversation
    has to fit into a task's memory.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    clean = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), F.coalesce("present", F.lit(True)).alias("present"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("turn"))
    # The windows' partitions and the groups are within those of the conversations, which are shuffled once.
    marked = clean.repartition("conv_id").withColumn("fault", _fault(F.col("text"), seen))
    row = F.when(F.col("present"), F.struct("turn", "role", "text", "fault"))
    one = marked.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))

    initial = lambda r: F.left(r["role"], F.lit(1))
    letter = lambda r: F.when(r["fault"] >= 2, "x").otherwise(
        F.when(initial(r).isin("s", "u", "a"), F.when(r["fault"] == 1, F.upper(initial(r))).otherwise(initial(r))).otherwise(F.when(r["fault"] == 1, "O").otherwise("o")))
    signed = one.withColumn("signature", F.array_join(F.transform("rows", letter), ""))
    fixed = signed.withColumn("fix", F.arrow_udf(_repairs, _REPAIR)("signature"))

    pairs = F.greatest(F.size("rows") - 1, F.lit(0))
    beside = F.zip_with(F.slice("rows", 1, pairs), F.slice("rows", 2, pairs), lambda x, y: F.concat(initial(x), initial(y)))
    numbers = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.when(F.size(numbers) > 0, F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))).otherwise(0)
    count = lambda fault: F.size(F.filter("rows", lambda r: r["fault"] == fault)).cast("long")
    repaired = F.transform("fix.picks", lambda p: F.struct(
        F.coalesce(p["role"], F.get("rows", p["row"])["role"]).alias("role"), F.coalesce(F.get("rows", p["row"])["text"], F.lit("")).alias("text")))
    return fixed.select(
        "conv_id", "rows", gaps.cast("long").alias("gaps"), count(3).alias("blank"), count(2).alias("duplicate"), count(1).alias("truncated"),
        F.size(F.filter(beside, lambda p: ~p.isin("su", "ua", "au"))).cast("long").alias("illegal"),
        F.col("fix.cost").alias("cost"), F.col("fix.audit").alias("audit"), repaired.alias("repaired"),
    )


def repair_digests(repaired: DataFrame) -> DataFrame:
    """Counts of faults, cost and edits, and a digest of what repair_conversations() made."""
    text = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    return repaired.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(text, 256).alias("repaired_sha256"))
