import pytest
from pyspark.sql import functions as F

from fathom.operators import digests
from fathom.sources import versions


def diff(left, right):
    key = lambda k: (k is None, k or 0)
    out = {}
    for k in sorted({r[0] for r in left + right}, key=key):
        a, b = (sorted(map(repr, (r for r in side if r[0] == k))) for side in (left, right))
        if a != b:
            out[k] = "missing_left" if not a else "missing_right" if not b else "changed"
    return out


@pytest.mark.parametrize("leaf_rows", [(2, 2), (2, 500)])
def test_trees_find_all_differences_of_hostile_tables(spark, tmp_path, leaf_rows):
    left = [(i, f"t{i}", None if i % 7 else "x") for i in range(600)] + [(None, "a", "b"), (5, "t5", None), (5, "twin", ""), (9, "same", "n"), (9, "same", "n")]
    right = [r for r in left if r[0] not in (17, 33)] + [(1000, "new", None), (9, "same", "n")]
    right = [(k, "other" if k in (40, 41) else t, "" if k == 50 else m) for k, t, m in right]
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    schema = "id long, node string, `a` string"
    for rows, folder, n in ((left, a, leaf_rows[0]), (right, b, leaf_rows[1])):
        digests.write(spark.createDataFrame(rows, schema), "id", folder, n)
    want = diff(left, right)
    assert len(want) == 7
    assert {r.id: r.state for r in digests.changed(spark, a, b, "id").collect()} == want
    assert {r.id: r.state for r in digests.changed(spark, b, a, "id").collect()} == diff(right, left)
    if leaf_rows == (2, 2):
        found = digests.difference(spark, a, b)
        assert found.nodes.count() <= 7 and found.left.count() + found.right.count() < 60
        assert digests.difference(spark, a, a).left.count() == 0 == digests.changed(spark, a, a, "id").count()
        # a null becomes a text, the null key's row goes: a new version is compared
        digests.write(spark.createDataFrame([r for r in right if r[0] is not None], schema).select("a", "node", "id"), "id", b, 2)
        assert {r.id: r.state for r in digests.changed(spark, a, b, "id").collect()} == {**want, None: "missing_right"}


def test_empty_tables_and_tables_without_digests(spark, tmp_path):
    none = spark.createDataFrame([], "id long, t string")
    a, b, c = (f"file://{tmp_path}/{x}" for x in "abc")
    digests.write(none, "id", a), digests.write(spark.createDataFrame([(1, "x"), (1, "x")], none.schema), "id", b)
    assert digests.changed(spark, a, a, "id").count() == 0
    assert [tuple(r) for r in digests.changed(spark, a, b, "id").collect()] == [(1, "missing_left")]
    versions.publish(spark, c, {"rows": none})
    with pytest.raises(ValueError, match="without digests"):
        digests.difference(spark, a, c)
