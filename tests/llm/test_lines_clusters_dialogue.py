import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import dialogue, exponion, linededup

# ---------------------------------------------------------------- lines

A, B = "A line of more than twenty points", "another line of more than twenty"
LINES = [
    (1, f"{A}\nshort\n{A.lower()}  "), (2, f"x\n\t{A.upper()}\n\n"), (3, f"{A}\n{B}"), (4, B), (4, f"{B}\nend"), (None, f"{A}\n{B}"), (None, B),
    (5, None), (6, ""), (7, "\n"), (8, f"{A}\nlast"), (9, "é" * 19), (10, "é" * 19), (11, "é" * 19), (12, "É" * 20), (13, "É" * 20), (14, "é" * 20), (15, "É" * 20 + "\x0b"),
    (16, "\n".join(f"line number {i} of a very long text" for i in range(30_000))), (8, f"{A}\nlast"),
]


def _brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(linededup.SPACE))
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            held.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stays = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or doc == max(d for d in held[key(x)] if d is not None)]
        out.append((doc, "\n".join(stays), len(lines), len(lines) - len(stays)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [1, 500_000])  # all repeated lines join by hash, or all are broadcast
def test_lines(spark, most):
    docs = spark.createDataFrame(LINES, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("h1", F.lit(1))
    found = linededup.drop_repeated_lines(docs, most=most).collect()
    assert sorted(map(tuple, found), key=repr) == _brute_lines(LINES)
    assert linededup.drop_repeated_lines(docs.limit(0), most=most).count() == 0


# ---------------------------------------------------------------- clusters

def _lloyd(points, centroids, rounds):
    for r in range(rounds + 1):
        d = ((points[:, None].astype(object) - centroids[None].astype(object)) ** 2).sum(2)
        owner = d.argmin(1)
        if r < rounds:
            centroids = np.array([[int(x) // int((owner == j).sum()) for x in points[owner == j].sum(0)] if (owner == j).any() else centroids[j] for j in range(len(centroids))])
    return owner, d.min(1), centroids


def test_rounds_against_brute_force():
    rng = np.random.default_rng(5)
    middles = rng.integers(-2000, 2000, (40, 8))
    points = middles[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 8))
    grid = np.array(list(itertools.product(range(-2, 3), repeat=3)))  # nothing but ties
    big = rng.integers(-exponion.BOUND + 1, exponion.BOUND, (300, 64))
    for data, k in ((points, 40), (grid, 9), (np.repeat(grid[:4], 5, 0), 7), (big, 8), (points, 1)):
        start = data[:k]
        owner = upper = lower = before = None
        centroids, work = start, 0
        for r in range(9):
            owner, upper, lower, n = exponion.Centroids(centroids, before).assign(data, owner, upper, lower)
            work += n
            if r < 8:
                before, centroids = centroids, np.array([data[owner == j].sum(0) // (owner == j).sum() if (owner == j).any() else centroids[j] for j in range(k)])
        brute, distance, ends = _lloyd(data, start, 8)
        assert (owner == brute).all() and (centroids == ends).all() and (((data - centroids[owner]) ** 2).sum(1) == distance).all()
        if data is points and k > 1:
            assert work < len(data) * k * 9 / 4  # the bounds and the balls decide


def test_clusters_of_hostile_rows(spark):
    rng = np.random.default_rng(3)
    good = [(i % 50, (rng.normal(size=64) * 0.2 + (i % 3)).tolist()) for i in range(200)] + [(None, [0.25] * 64), (None, [0.25] * 64)]
    bad = [(1, None), (2, [0.5] * 63), (3, [0.5] * 63 + [None]), (4, [float("nan")] + [0.0] * 63), (5, [float("inf")] + [0.0] * 63), (6, [1e30] + [0.0] * 63), (7, [])]
    rows = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("cluster", F.lit(1)).withColumn("ids", F.lit("clash"))
    found, centroids = exponion.cluster(rows)
    points = np.floor(np.array([x for _, x in good], np.float32).astype(float) * 1024).astype(np.int64)
    digest = lambda i: "~" if i is None else hashlib.sha256(f"3:{i}".encode()).hexdigest()
    first = sorted(range(len(good)), key=lambda n: (digest(good[n][0]), points[n].tolist()))[:8]
    owner, distance, ends = _lloyd(points, points[first], 10)
    assert (centroids == ends).all()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, int(o), int(d)) for (i, _), o, d in zip(good, owner, distance, strict=True)), key=repr)
    told = exponion.described(spark, found, centroids).collect()
    assert {r.inertia for r in told} == {int(distance.sum())} and all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, ends[r.cluster].tolist())).encode()).hexdigest() for r in told)
    few, few_centroids = exponion.cluster(spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64)], "vec_id long, embedding array<float>"))
    assert sorted(map(tuple, few.collect())) == [(1, 0, 0), (1, 0, 0)] and len(few_centroids) == 2
    assert exponion.cluster(rows.limit(0))[0].count() == 0


# ---------------------------------------------------------------- conversations

def _brute_edits(rows):
    """(cost, audit, texts) least of all ways, by a table of (rows read, state): an order of its own, forwards."""
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}
    def inserted(table):
        table = dict(table)
        for _ in range(3):
            for q, (cost, audit, out) in list(table.items()):
                to = follow[q]
                table[to] = min(table.get(to, (10**9,)), (cost + 3, audit + "I", (*out, f"{name[to]}:")))
        return table
    for role, text, dead, cut_off in rows:
        now = {}
        for q, (cost, audit, out) in inserted(best).items():
            ways = [(q, (cost + 4, audit + "D", out))]
            if not dead:
                to = follow[q]
                ways.append((to, (cost + 3 + 3 * cut_off, audit + "R", (*out, f"{name[to]}:{text}"))))
                if role[:1] == to or (q == "" and role[:1] == "s"):
                    ways.append((role[:1], (cost + 3 * cut_off, audit + "K", (*out, f"{role}:{text}"))))
            for to, way in ways:
                now[to] = min(now.get(to, (10**9,)), way)
        best = now
    return min(x for q, x in inserted(best).items() if q in ("", "a"))


def _brute_digest(rows):
    seen, judged, blank, again, cut_off = set(), [], 0, 0, 0
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kind = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        blank, again, cut_off = blank + (kind == "b"), again + (kind == "d"), cut_off + (kind == "t")
        judged.append((role, text, kind in ("b", "d"), kind == "t"))
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = _brute_edits(judged)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    return gaps, blank, again, cut_off, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def _brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = role or (" " if role is None else role), text or (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        now = by.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            now += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: _brute_digest(sorted(now, key=order)) for conv, now in by.items()}


def test_paths_against_all_ways():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), f"t{i}", False, rng.random() < 0.3) for i in range(rng.randrange(9))]
        turns = [(r[0][:1], int(r[3])) for r in rows]
        edits, state = dialogue.walk(turns, dialogue.distances(turns, dialogue.END), dialogue.START)
        audit = "".join("I" * len(i) + e for e, _, i in edits) + "I" * len(dialogue.ending(state))
        assert (dialogue.distances(turns, dialogue.END)[0], audit) == _brute_edits(rows)[:2]


def test_conversations(spark):
    rng = random.Random(4)
    roles, ends = ["user", "assistant", "system", "tool", None, "", "user"], [".", "!", "?", "", "  ", ".\n"]
    rows = [(c, t, rng.choice(roles), rng.choice(["", " ", None, f"words {rng.randrange(40)}{rng.choice(ends)}", "same."])) for c in range(40) for t in range(rng.randrange(1, 9))]
    # conversations that reach over many partitions: one with an id, one without; rows without turns, repeated rows and ties
    rows += [(100, t, rng.choice(roles), f"long {rng.randrange(150)}{rng.choice(ends)}") for t in range(400)]
    rows += [(None, rng.choice([None, t]), ["user", "assistant"][t % 2], f"no id {t}.") for t in range(300)]
    rows += [(7, 3, "user", "the same row.")] * 50 + [(8, 1, "user", f"tie {i}.") for i in range(20)] + [(9, 0, "user", "very long " * 50_000 + ".")]
    rows += [(1000 + i, 0, "user", "alone.") for i in range(60)]  # of some the only row is dropped
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash")).withColumn("times", F.lit(9))
    repaired = dialogue.repair(dialogue.damaged(table))
    spread = {r.conv_id: r.n for r in repaired.groupBy("conv_id").agg(F.countDistinct(F.shiftright("seq", 33)).alias("n")).collect()}
    assert spread[100] > 1 and spread[None] > 1  # their paths are put together from pieces
    found = dialogue.digests(table, repaired).collect()
    assert {r.conv_id: tuple(r)[1:] for r in found} == _brute(rows) and len(found) == len(_brute(rows))
    assert dialogue.digests(table.limit(0), dialogue.repair(dialogue.damaged(table.limit(0)))).count() == 0
