import json

import pytest
from pyspark.sql import functions as F

from fathom.sources import archive, versions


def run(spark, folder, store, **more):
    counts, errors = archive.import_files(spark, f"file://{folder}", store, **more)
    return counts, errors


def test_files_are_imported_once_by_content(spark, tmp_path):
    folder, store = tmp_path / "in", f"file://{tmp_path}/store"
    (folder / "sub").mkdir(parents=True)
    (folder / "a.txt").write_text("one text")
    (folder / "b.txt").write_text("one text\r\n")
    (folder / "sub" / "copy.txt").write_text("one text")
    (folder / "c.json").write_text(json.dumps([{"title": "x", "body": "two", "published_at": "2026-03-01"}, {"title": "y", "body": "three", "published_at": "2026-05-01"}, {"title": "z", "body": "two"}]))
    (folder / "bad.json").write_text('[{"title": "x", "body": "two"}, {"title": 1}]')
    (folder / "skip.bin").write_bytes(b"\0")
    counts, errors = run(spark, folder, store)
    assert counts == {"files_seen": 5, "files_unchanged": 0, "new_documents": 3, "new_sources": 6, "duplicate_documents": 3, "errors": 1}
    assert [(r.path.rpartition("/")[2], r.error) for r in errors.collect()] == [("bad.json", "bad_record")]
    assert archive.table(spark, store, "originals").count() == 3  # equal bytes once
    assert sorted(r.body for r in archive.table(spark, store, "documents").collect()) == ["one text", "three", "two"]

    again, _ = run(spark, folder, store)
    assert again == {"files_seen": 5, "files_unchanged": 4, "new_documents": 0, "new_sources": 0, "duplicate_documents": 0, "errors": 1} and versions.latest(spark, store)[0] == 1

    (folder / "a.txt").write_text("another text")
    more, _ = run(spark, folder, store)
    assert more == {"files_seen": 5, "files_unchanged": 3, "new_documents": 1, "new_sources": 1, "duplicate_documents": 0, "errors": 1}
    assert archive.table(spark, store, "files").where(F.col("path").endswith("/a.txt")).count() == 1

    other, _ = run(spark, folder, store, reader="2")
    assert (other["files_unchanged"], other["new_documents"], other["duplicate_documents"]) == (0, 4, 2)
    assert archive.table(spark, store, "originals").count() == 4

    dated = lambda **w: archive.published(spark, store, **w).count()
    assert dated() == 8 and dated(since="2026-01-01") == 4 and dated(since="2026-03-01", until="2026-05-01") == 2 and dated(until="2026-03-01") == 0


def test_large_files_are_errors_and_an_empty_folder_is_none(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = f"file://{tmp_path}/store"
    assert run(spark, tmp_path / "in", store)[0] == {"files_seen": 0, "files_unchanged": 0, "new_documents": 0, "new_sources": 0, "errors": 0, "duplicate_documents": 0}
    assert archive.table(spark, store, "documents").count() == 0
    (tmp_path / "in" / "a.txt").write_text("x" * 100)
    counts, errors = run(spark, tmp_path / "in", store, most_bytes=50)
    assert counts["errors"] == 1 and errors.first().error == "too_large"


def test_of_two_imports_at_once_one_is_told(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("d", "x")], archive.TABLES["documents"])
    assert versions.publish(spark, store, {}, after=0, added={"documents": rows}) == 1
    with pytest.raises(versions.Conflict):
        versions.publish(spark, store, {}, after=0, added={"documents": rows})
    versions.publish(spark, store, {}, after=1, added={"documents": spark.createDataFrame([("e", "y")], archive.TABLES["documents"])})
    assert sorted(r.document for r in archive.table(spark, store, "documents").collect()) == ["d", "e"]
