"""Layers of a hub: what a change writes, what readers see, merges, removal, and embedding that goes on after a failure."""

import json
import pathlib

import pytest

from fathom import hub as hubs
from fathom.sources import layers, versions
from tests.test_hub import batch

SOURCE = ("a", "A", "local", True)


def _hub(spark, tmp_path, **more):
    home = hubs.Hub(spark, f"file://{tmp_path}/h", **more)
    home.upsert_sources(spark.createDataFrame([SOURCE], hubs.SOURCES))
    return home


def _bytes(tmp_path):
    return sum(p.stat().st_size for p in pathlib.Path(f"{tmp_path}/h").rglob("*.parquet"))


def _told(home):
    """All that a search can see, but not when it was written."""
    return {name: sorted(map(repr, home.table(name).drop("part", "bucket").collect())) for name in ("documents", "chunks", "postings", "tokens", "corpus")}


def test_changes_equal_a_rebuilt_hub_and_write_only_what_they_hold(spark, tmp_path):
    home = _hub(spark, tmp_path, buckets=4, fan=3)
    texts = {str(i): f"word{i % 7} common text of {i} " + "filler " * 300 for i in range(150)}
    put = lambda ids: home.ingest(batch(spark, *({"external_id": i, "body": texts[i]} for i in ids)))
    put(texts)
    first, count = _bytes(tmp_path), lambda: len(home.pin().snapshot.layers)
    reader = home.pin()
    before = sorted(map(repr, reader.table("postings").collect()))
    texts |= {"3": "word3 anew", "200": "another common one"}
    put(["3", "200"])
    assert count() == 2 and _bytes(tmp_path) - first < first / 2  # a folder of each bucket costs its footers; rows are few
    assert home.pin().snapshot.rows("documents", home.pin().snapshot.layers[1:]).count() == 2
    # a pinned reader sees its version still; a search of it leaves out what has changed meanwhile
    assert sorted(map(repr, reader.table("postings").collect())) == before
    assert home.search("word3", view=reader, limit=50)[0].count() == home.search("word3", limit=50)[0].count() - 1  # the new text of 3 isn't in that version
    home.delete(home.table("documents").where("external_id in ('5', '6')"))
    for gone in ("5", "6"):
        del texts[gone]
    texts["5"] = "it comes back"
    put(["5"])
    assert count() <= 3  # merged by size
    other = hubs.Hub(spark, f"file://{tmp_path}/h", buckets=64)  # what the manifest says counts
    assert other.search("common", limit=500)[0].count() == sum("common" in x for x in texts.values())
    fresh = _hub(spark, tmp_path / "again", buckets=4)
    fresh.ingest(batch(spark, *({"external_id": i, "body": x} for i, x in texts.items())))
    assert _told(home) == _told(fresh)
    home.compact()
    assert count() == 1 and "gone" not in home.pin().snapshot.layers[0]["tables"] and _told(home) == _told(fresh)
    folders = len(list(pathlib.Path(f"{tmp_path}/h").glob("data-*")))
    assert home.clean() > 0 and len(list(pathlib.Path(f"{tmp_path}/h").glob("data-*"))) < folders and _told(home) == _told(fresh)
    # a passage that another index has found is compared with what the hub holds
    row = home.table("chunks").where("text like 'word3%'").first()
    found = lambda text: home.answered(spark.createDataFrame([(row.chunk, row.doc_id, text, 1.0)], "chunk string, doc_id string, text string, score double"))
    assert found(row.text)[0].first().id == row.doc_id
    with pytest.raises(hubs.Stale):
        found("an older text")


def test_size_classes():
    some = [{"size": n} for n in (5000, 3, 900, 2, 1, 3)]
    assert layers.due(some) == [1, 3, 4, 5] and layers.due(some[:5]) == []
    assert layers.due([{"size": 20}] * 4 + [{"size": 1}] * 4) == [4, 5, 6, 7]


def test_versions_appear_whole_or_not(spark, tmp_path):
    folder = f"file://{tmp_path}/v"
    versions.add(spark, folder, 1, {"x": 1})
    with pytest.raises(versions.Conflict):
        versions.add(spark, folder, 1, {"x": 2})
    assert versions.latest(spark, folder) == (1, {"x": 1}) and [p.name for p in (tmp_path / "v").iterdir() if not p.name.startswith(".")] == ["000000000001.json"]
    (tmp_path / "v" / "_0.tmp").write_text("{")  # what a writer left that failed
    versions.add(spark, folder, 2, {"x": 3})
    assert versions.latest(spark, folder) == (2, {"x": 3})


def test_embedding_goes_on_where_it_failed(spark, tmp_path):
    home = _hub(spark, tmp_path)
    home.ingest(batch(spark, *({"external_id": str(i), "body": f"text number {i}"} for i in range(20))))

    def failing(texts):
        if any("number 7" in t for t in texts):
            raise RuntimeError("no")
        return [[float(len(t)), 1.0] for t in texts]

    with pytest.raises(hubs.Incomplete) as told:
        home.embed(failing, "m", unit=8)
    assert (told.value.done, told.value.failed) == (19, 1) and home.table("vectors").count() == 19

    def second(texts):
        if texts != ["text number 7"]:
            raise AssertionError(texts)
        return [[1.0, 2.0]]

    assert home.embed(second, "m") == 1 and home.table("vectors").count() == 20 and home.embed(lambda texts: 1 / 0, "m") == 0
    home.ingest(batch(spark, {"external_id": "7", "body": "changed"}))
    assert home.table("vectors").count() == 19 and home.coverage("m").first().pending == 1


def test_dates_of_file_names(spark):
    from pyspark.sql import functions as F

    from fathom.functions.text import filename_date

    names = {
        "Call_2026-08-12_English.pdf": "2026-08-12", "Report_20_Aug_2026.pdf": "2026-08-20", "x2026_08-12y": "2026-08-12", "1 aug 2026": "2026-08-01", "2026-08-12 and 12-AUG-2026": "2026-08-12", "2026-99-40 2026-01-02": "2026-01-02",
        **dict.fromkeys(["Report 2026 08 12", "a--2026--08--12", "v(2026)-08-12", "2026-08-12 2026-08-13", "12026-08-12", "2026-08-123", "2026-02-30", "3 foo 2026", "1999-01-01", ""]),
    }
    rows = spark.createDataFrame([(n,) for n in [*names, None]], "n string").select("n", filename_date(F.col("n")).cast("string").alias("d")).collect()
    assert {r.n: r.d for r in rows} == names | {None: None}


def test_alias_files(tmp_path):
    from fathom.plans import planner

    path = tmp_path / "aliases.json"
    assert planner.load_aliases(str(path)) == ()
    def load(told):
        path.write_text(told if isinstance(told, str) else json.dumps(told), encoding="utf-8-sig")
        return planner.load_aliases(str(path))
    assert load({"entities": [[" Nova ", "NV", "Nova"], ["NV", "Other"]]}) == (("Nova", "NV"), ("NV", "Other")) and load({"entities": []}) == ()
    for bad in ("{", [], {"entities": [["ab", "cd"]], "more": 1}, {"entities": [["ab", "cd"], ["CD", "AB"]]}, {"entities": [["ab", "ab"]]}, {"entities": [["ab", "c"]]}, {"entities": [["ab", "x" * 81]]}, {"entities": [["ab", 1]]}, {"entities": "ab"}, {"entities": [["ab", "cd"]] * 101}):
        with pytest.raises(ValueError):
            load(bad)
