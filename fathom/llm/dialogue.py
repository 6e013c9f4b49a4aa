"""Repair of conversation structure: the cheapest edits after which roles alternate as they should.

A conversation is a row of turns; nodes are (turns read, role state), arcs are edits with small
integer costs. Dial's bucket queue gives the distance of every node to the end; from the start, tight
arcs are walked, the least letter first, which yields the cheapest edits that are least in ASCII.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks
as pieces. What a piece does to distances is a 4 x 4 matrix; only the first and the last conversation
of a partition can be pieces, so the driver chains at most two matrices a partition, and the pieces
are then walked apart from each other.
"""

from __future__ import annotations

import hashlib
import uuid
from io import StringIO
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import cut, partitions, remove, shared_dir

#: Costs of edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. The role that may be put next, and where each role leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What is still to pay at a conversation's end: insertions that complete a pair.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
_SPACE = "\\x20\\x09-\\x0D"


# ---------------------------------------------------------------- shortest paths over the turns of one piece

def distances(turns: list[tuple[str, int]], goal) -> list[int]:
    """Distance of each node 4 * i + state to the end of the piece, where goal has what each state still costs.

    turns are (role initial, truncated) of the rows that may stay. Arcs are followed backwards; costs are
    at most DELETE or REROLE + TRUNCATED, so a ring of so many buckets (and the spread of goal) is enough.
    """
    n = len(turns)
    out = [FAR] * (4 * n + 4)
    low = min(goal)
    seeds = [(g - low, 4 * n + q) for q, g in enumerate(goal) if g < FAR]
    ring = max(DELETE, REROLE + TRUNCATED, INSERT, max((g for g, _ in seeds), default=0)) + 1
    buckets: list[list[int]] = [[] for _ in range(ring)]
    for g, node in seeds:
        out[node] = g
        buckets[g].append(node)
    now, waiting = 0, len(seeds)
    while waiting:
        bucket = buckets[now % ring]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if out[node] != now:
                continue
            i, q = divmod(node, 4)
            before = []
            if i < n:  # insertions before a turn; those after the last one are in goal
                before += [(4 * i + p, INSERT) for p in range(4) if NEXT[p] == q]
            if i:
                initial, cut_off = turns[i - 1]
                before.append((node - 4, DELETE))
                for p in range(4):
                    if KEEPS[p].get(initial) == q:
                        before.append((4 * i - 4 + p, TRUNCATED * cut_off))
                    if NEXT[p] == q:
                        before.append((4 * i - 4 + p, REROLE + TRUNCATED * cut_off))
            for other, cost in before:
                if now + cost < out[other]:
                    out[other] = now + cost
                    buckets[(now + cost) % ring].append(other)
                    waiting += 1
        now += 1
    return [x if x == FAR else x + low for x in out]


def walk(turns: list[tuple[str, int]], far: list[int], state: int) -> tuple[list[tuple[str, int, list[int]]], int]:
    """For each turn (edit D, K or R, state after it, states of insertions before it), and the state at the piece's end."""
    edits, inserted, i = [], [], 0
    while i < len(turns):
        initial, cut_off = turns[i]
        here = far[4 * i + state]
        if far[4 * i + 4 + state] + DELETE == here:
            edits.append(("D", state, inserted))
        elif far[4 * i + NEXT[state]] + INSERT == here:
            state = NEXT[state]
            inserted = [*inserted, state]
            continue
        else:
            to = KEEPS[state].get(initial)
            kept = to is not None and far[4 * i + 4 + to] + TRUNCATED * cut_off == here
            state = to if kept else NEXT[state]
            edits.append(("K" if kept else "R", state, inserted))
        inserted, i = [], i + 1
    return edits, state


def ending(state: int) -> list[int]:
    """States of the insertions that complete a conversation."""
    return {SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT]}.get(state, [])


# ---------------------------------------------------------------- rows with their faults

def damaged(conversations: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """(conv_id, turn, role, text, times): rows after damage by crc32(`conv_id:turn`) % 20; nulls count as one space there,
    and become one in role and text."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), space), F.coalesce(F.col(turn_col).cast("string"), space))
    rows = conversations.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("times"))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text) with times, hash, initial, and what their first copy is: blank, again (seen in
    an earlier turn) or truncated.

    Equal rows are counted before they are shuffled, so a row that is repeated without end is one row here; all its copies but the
    first are duplicates. The first turn of a text is an aggregate that is joined back, so a text that prevails is not one task's.
    """
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times"))
    rows = rows.withColumn("hash", F.sha2("text", 256)).withColumn("place", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn")))
    first = rows.groupBy("conv_id", "role", "hash").agg(F.min("place").alias("first")).select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), "first")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("hash") == F.col("h"))).drop("c", "r", "h")
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    again = ~blank & (F.col("first") != F.col("place"))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    truncated = ~blank & ~again & ~last.isin(".", "!", "?")
    return rows.select("conv_id", "turn", "role", "text", "times", "hash", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), again.alias("again"), truncated.cast("int").alias("truncated"))


# ---------------------------------------------------------------- pieces, chained by the driver

_FLAGS = ["part", "conv_id", "initial", "blank", "again", "truncated"]


def _conversations(batches, columns: list[str]):
    """(part, conv_id, rows) of one partition, whose rows are sorted, one conversation after the other."""
    rows = (r for b in batches for r in b.select(columns).to_pylist())
    for key, group in groupby(rows, key=lambda r: r["conv_id"]):
        group = list(group)
        yield group[0]["part"], key, group


def _turns(rows) -> list[tuple[str, int]]:
    return [(r["initial"], r["truncated"]) for r in rows if not (r["blank"] or r["again"])]


def _matrices(batches):
    """The first and the last conversation of a partition, with the distance from each state at the begin to each at the end."""
    first = last = None
    for found in _conversations(batches, _FLAGS):
        last = found
        first = first or found
    for part, key, rows in ([first] if first is last else [first, last]) if first else ():
        turns = _turns(rows)
        to = [distances(turns, [0 if p == q else FAR for p in range(4)])[:4] for q in range(4)]
        row = {"part": part, "conv_id": key, "matrix": [to[q][p] for p in range(4) for q in range(4)]}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("matrix", pa.list_(pa.int64()))]))


def _exits(goals):
    """For pieces: the state at the end for each state at the begin."""

    def run(batches):
        for part, key, rows in _conversations(batches, _FLAGS):
            if (part, key) in goals.value:
                turns = _turns(rows)
                far = distances(turns, goals.value[part, key])
                row = {"part": part, "conv_id": key, "exits": [walk(turns, far, q)[1] for q in range(4)]}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("part", pa.int32()), ("conv_id", pa.int64()), ("exits", pa.list_(pa.int32()))]))

    return run


def _plan(rows: DataFrame) -> dict:
    """(part, conv_id) of each piece of a conversation in several partitions: (what states cost after it, state before it, whether it is the last)."""
    found = rows.select(*_FLAGS).mapInArrow(_matrices, "part int, conv_id long, matrix array<long>").collect()  # at most two rows a partition
    chains: dict = {}
    for r in sorted(found, key=lambda r: r.part):
        chains.setdefault(r.conv_id, []).append(r)
    chains, goals = {key: x for key, x in chains.items() if len(x) > 1}, {}
    for key, pieces in chains.items():
        goal = END
        for r in reversed(pieces):
            goals[r.part, key] = goal
            goal = tuple(min(r.matrix[4 * p + q] + goal[q] for q in range(4)) for p in range(4))
            goal = tuple(g - min(goal) for g in goal)  # only differences decide
    if not goals:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(goals)
    exits = {(r.part, r.conv_id): r.exits for r in rows.select(*_FLAGS).mapInArrow(_exits(shared), "part int, conv_id long, exits array<int>").collect()}
    plan = {}
    for key, pieces in chains.items():
        state = START
        for r in pieces:
            plan[r.part, key] = (goals[r.part, key], state, r is pieces[-1])
            state = exits[r.part, key][state]
    return plan


_EDITED = "conv_id long, seq long, turn long, times long, initial string, blank boolean, again boolean, truncated int, edits string, repaired array<struct<role: string, text: string>>"


def _edit(plan):
    schema = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("times", pa.int64()), ("initial", pa.string()), ("blank", pa.bool_()), ("again", pa.bool_()), ("truncated", pa.int32()),
        ("edits", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])
    empty = lambda states: [{"role": ROLES[s], "text": ""} for s in states]

    def run(batches):
        for part, key, rows in _conversations(batches, [*_FLAGS, "seq", "turn", "role", "text", "times"]):
            goal, state, ends = plan.value.get((part, key), (END, START, True))
            turns = _turns(rows)
            edits, state = walk(turns, distances(turns, goal), state)
            edits = iter(edits)
            for r in rows:
                if r["blank"] or r["again"]:
                    r |= {"edits": "D" * r["times"], "repaired": []}
                    continue
                letter, to, inserted = next(edits)
                stays = [] if letter == "D" else [{"role": r["role"] if letter == "K" else ROLES[to], "text": r["text"]}]
                r |= {"edits": "I" * len(inserted) + letter + "D" * (r["times"] - 1), "repaired": empty(inserted) + stays}
            if ends:
                rows[-1]["edits"] += "I" * len(ending(state))
                rows[-1]["repaired"] = rows[-1]["repaired"] + empty(ending(state))
            for a in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_pylist([{n: r[n] for n in schema.names} for r in rows[a : a + 1024]], schema=schema)

    return run


def repair(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, times) with their faults, their edits and what is left of them.

    One row for each distinct one: conv_id, seq (the order of the whole table by conversation, turn with nulls first, role,
    hash of the text), turn, times, initial, blank, again, truncated, edits (letters of the insertions before it, of its own edit
    and of its further copies, which are duplicates, and at a conversation's end of insertions after it) and
    repaired, the (role, text) that stand there then. Null ids are one conversation. No conversation is gathered: a task
    holds the rows of one conversation that lie in its range.
    """
    spark = rows.sparkSession
    folder = f"{shared_dir(spark)}/dialogue-{uuid.uuid4().hex}"
    judged(rows).write.parquet(folder)
    faults = spark.read.parquet(folder)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    ranged = faults.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    ranged = cut(ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()).drop("hash"))
    remove(spark, folder)
    plan = spark.sparkContext.broadcast(_plan(ranged))
    return ranged.mapInArrow(_edit(plan), _EDITED)


# ---------------------------------------------------------------- what the contract asks of each conversation

_DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {"su", "ua", "au"}


def _digest(batches):
    """A row for each conversation of a sorted partition, read as a stream: only numbers, the audit and the state of a hash are held."""
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    types = [pa.int64()] * 7 + [pa.string()] * 2
    rows = (r for b in batches for a in range(0, len(b), 256) for r in b.slice(a, 256).to_pylist())
    for key, group in groupby(rows, key=lambda r: r["conv_id"]):
        blank = again = cut_off = illegal = cost = distinct = 0
        low = high = before = None
        audit, sha, first = StringIO(), hashlib.sha256(), True
        for r in group:
            n = r["times"]
            blank += n if r["blank"] else 0
            again += 0 if r["blank"] else n - 1 + r["again"]
            cut_off += r["truncated"]
            illegal += (n - 1) + (before is not None and before + r["initial"] not in LEGAL)
            before = r["initial"]
            if r["turn"] is not None:
                distinct += r["turn"] != high  # turns ascend
                low, high = r["turn"] if low is None else low, r["turn"]
            told = r["edits"]
            audit.write(told)
            cost += DELETE * told.count("D") + INSERT * told.count("I") + REROLE * told.count("R") + TRUNCATED * (r["truncated"] and ("K" in told or "R" in told))
            for x in r["repaired"]:
                sha.update((("" if first else "\n") + f"{x['role']}:{x['text']}").encode())
                first = False
        gaps = 0 if low is None else min(high - low + 1 - distinct, (1 << 63) - 1)
        values = [key, gaps, blank, again, cut_off, illegal, cost, audit.getvalue(), sha.hexdigest()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


def digests(conversations: DataFrame, repaired: DataFrame, id_col="conv_id") -> DataFrame:
    """One row for each id of conversations: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, from what repair gives.

    A SHA-256 is one after another by nature: a conversation's rows pass through one task, as a stream that holds none of
    them. Conversations without rows have zeros, an empty audit and the hash of the empty string. Null ids are one conversation. No
    rows give no rows.
    """
    told = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_digest, _DIGEST).withColumnRenamed("conv_id", "c")
    ids = conversations.select(F.col(id_col).cast("long").alias("conv_id")).distinct()
    rows = ids.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return rows.select("conv_id", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
