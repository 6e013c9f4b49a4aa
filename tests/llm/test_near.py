"""Near-duplicates and near vectors against brute force, with ids that repeat, and SQL for such tables."""

import collections
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import bagminhash, queries, rangejoin


def bag(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return collections.Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)) if words)


def brute_classes(rows, least=0.8):
    """Smallest id reachable from each row."""
    bags = [bag(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, (_, s) in enumerate(rows):
        for j, (_, t) in enumerate(rows[:i]):
            near = sum((bags[i] & bags[j]).values()) >= least * sum((bags[i] | bags[j]).values()) if bags[i] and bags[j] else s is not None and s == t and not bags[i] and not bags[j]
            if near and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least_id = {}
    for (doc, _), x in zip(rows, label, strict=True):
        least_id[x] = min((y for y in (least_id.get(x), doc) if y is not None), default=None)
    return [least_id[x] for x in label]


def texts():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(6):
        text = [f"w{rng.integers(900)}" for _ in range(120)]
        for _ in range(12):  # chains of small edits, so that components hold pairs that are no links
            text = list(text)
            text[rng.integers(120)] = f"e{rng.integers(9999)}"
            rows.append((len(rows) % 50, " ".join(text)))  # ids 0 to 21 stand on two different texts
    base = " ".join(f"b{i}" for i in range(60))
    rows += [(100, base + " more"), (101, base), (101, "a wholly other text of its own kind"), (102, "a wholly other text of its own kind"), (102, "a wholly other text of its own kind")]
    rows += [(200, "a b " * 60), (201, "a b " * 70), (202, ""), (203, ""), (None, base), (None, "no id has this text at all"), (204, None), (205, None), (206, "x"), (207, "...")]
    return rows


@pytest.mark.parametrize(("part", "broadcast"), [(bagminhash.PART, bagminhash.BROADCAST_IDS), (3, 0)])
def test_near_duplicates_of_repeated_ids(spark, part, broadcast):
    rows = texts()
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("t", F.lit(0))
    found = collections.Counter((r.doc_id, r.class_id, r.kept) for r in bagminhash.near_duplicates(table, part=part, broadcast=broadcast).collect())
    want = collections.Counter((d, c, d == c) for (d, _), c in zip(rows, brute_classes(rows), strict=True))
    assert found == want


def test_sql_of_near_duplicates_knows_repeated_ids():
    rows = [r for r in texts() if r[0] is not None]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    found = collections.Counter(con.execute(queries.oracle_sql()["op2_bagminhash"]).fetchall())
    assert found == collections.Counter((d, c, d == c) for (d, _), c in zip(rows, brute_classes(rows), strict=True))


def test_one_row_of_each_class_stays(spark):
    rows = texts()
    table = spark.createDataFrame([(d, t, f"s{i}") for i, (d, t) in enumerate(rows)], "doc_id long, text string, source string")
    kept = [(r.doc_id, r.text) for r in bagminhash.without_near_duplicates(table).collect()]
    # texts without an id have no class id of their own here: count classes by row
    label = brute_classes([(i, t) for i, (_, t) in enumerate(rows)])
    by_text = {rows[i]: label[i] for i in range(len(rows))}
    assert sorted(by_text[x] for x in kept) == sorted(set(label))
    assert (101, "a wholly other text of its own kind") in kept and (100, rows[72][1]) in kept


def test_a_large_mixed_bucket(spark):
    """Many near copies and a stray chain that meets them at one end only, in parts far smaller than the bucket."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        text = list(base)
        text[rng.integers(400)] = f"x{i}"
        rows.append((i, " ".join(text)))
    far = [*base[:330], *(f"y{i}" for i in range(70))]
    rows += [(1000 + i, " ".join([*far[:-1], f"z{i}"])) for i in range(40)]
    found = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), part=16).collect()}
    assert [found[d] for d, _ in rows] == brute_classes(rows)


def brute_vectors(rows, least=0.9):
    fine = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None for i, v in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if ok else None for (_, v), ok in zip(rows, fine, strict=True)]
    near = [[i != j and fine[i] and fine[j] and len(unit[i]) == len(unit[j]) and (bool(unit[i] @ unit[j] >= least) or rows[i][1] == rows[j][1]) for j in range(len(rows))] for i in range(len(rows))]
    label = [i for i, _ in rows]
    for _ in rows:
        label = [min([label[i]] + [label[j] for j in range(len(rows)) if near[i][j]]) if label[i] is not None else None for i in range(len(rows))]
    return collections.Counter((i, sum(n), c, i == c or i is None) for (i, _), n, c in zip(rows, near, label, strict=True))


def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(25, 16))
    x = (base[rng.integers(25, size=160)] + rng.normal(size=(160, 16)) * 0.22).astype(np.float32)
    x[7] = x[8]
    rows = [(i % 120, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [None] + [1.0] * 15), (1003, [float("nan")] * 16), (1004, [1.0, 2.0]), (1005, []), (None, x[3].tolist()), (1006, [2.0, 4.0])]
    return rows


@pytest.mark.parametrize(("pivots", "size"), [(None, 50), (20, 7), (1, 1000)])
def test_near_vectors_of_repeated_ids(spark, pivots, size):
    rows = vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit("clash")).withColumn("d", F.lit(0))
    found = collections.Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in rangejoin.near_vectors(table, pivots=pivots, slice_size=size).collect())
    assert found == brute_vectors(rows)
    assert rangejoin.near_vectors(table.limit(0)).count() == 0


def test_near_vectors_each_have_their_own_links(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (4, [1.0, 0.02])]
    found = sorted((r.vec_id, r.n_links) for r in rangejoin.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert found == [(1, 1), (1, 2), (2, 2), (3, 1), (4, 2)]


def test_the_triangle_inequality_spares_most_cells_of_clustered_vectors():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(40, 64))
    x = rangejoin._unit(centre[rng.integers(40, size=4000)] + rng.normal(size=(4000, 64)) * 0.15)
    p = rangejoin.farthest_first(x[:640], 40)
    d = rangejoin._chord(x, p)
    home = d.argmin(1)
    low, high = (np.stack([f(d[home == j], 0) for j in range(40)]) for f in (np.min, np.max))
    eps = np.sqrt(0.2)
    near = rangejoin.visits(d, home, low, high, eps)
    assert near.mean() < 0.1
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    assert near[i, home[j]].all() and near[j, home[i]].all()
