import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from fathom.operators import segments

PIECES = ["ab", "c", " ", ". ", "。", "\n", "! ", "\x1c", "?　", "é𝄞"]


def cut(text, size):
    """Ends of segments, found window by window."""
    at, ends = 0, []
    while len(text) - at > size:
        held = re.match(r"(?s).*(?:[。！？\n]|[.!?]\s)", text[at : at + size])
        at += held.end() if held and held.end() >= size // 2 else size
        ends.append(at)
    return [*ends, len(text)]


def texts():
    rnd = random.Random(5)
    made = ["".join(rnd.choice([*PIECES, "x" * rnd.randint(1, 90)]) for _ in range(rnd.choice([1, 5, 50, 300, 2000]))) for _ in range(40)]
    return [(i, t) for i, t in enumerate([*made, "", None, " \n" * 300, "y" * 1001])]


def expected(size):
    out = {}
    for key, text in texts():
        ends = cut(text, size) if text else []
        out[key] = [(a, b) for a, b in zip([0, *ends], ends, strict=False) if text[a:b].strip()]
    return out


def test_segments_are_those_of_a_scan(spark):
    docs = spark.createDataFrame(texts(), "doc int, body string").withColumn("segment", F.lit("clash")).withColumn("at", F.lit(1))
    known, found = dict(texts()), {key: [] for key, _ in texts()}
    for r in segments.segments(docs, "doc", size=100).orderBy("doc", "start").collect():
        assert r.text == known[r.doc][r.start : r.end] and r.segment == hashlib.sha256(f"{r.doc}:{r.start}:{r.end}".encode()).hexdigest()[:24] and r.page is None
        found[r.doc].append((r.start, r.end))
    assert found == expected(100)


def test_segments_stay_in_pages(spark):
    body = "a" * 150 + "\n\n" + "b" * 30
    docs = spark.createDataFrame([(1, body, [(7, 0, 150), (9, 152, 182)]), (2, body, []), (3, body, None)], "doc int, body string, pages array<struct<page:int,start:int,end:int>>")
    found = [(r.doc, r.page, r.start, r.end) for r in segments.segments(docs, "doc", pages="pages", size=100).orderBy("doc", "start").collect()]
    assert found == [(1, 7, 0, 100), (1, 7, 100, 150), (1, 9, 152, 182)] + [(d, None, a, b) for d in (2, 3) for a, b in ((0, 100), (100, 182))]


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_chunks_are_packed_as_by_hand(spark, overlap):
    docs = spark.createDataFrame(texts(), "doc int, body string")
    found = {}
    for r in segments.packed(segments.segments(docs, "doc", size=100), "doc", size=420, overlap=overlap).orderBy("doc", "position").collect():
        found.setdefault(r.doc, []).append((r.start, r.end, len(r.segments)))
        assert r.chunk == hashlib.sha256(":".join(r.segments).encode()).hexdigest()
    for key, spans in expected(100).items():
        chunks, first = [], 0
        while spans and first < len(spans):
            last, room = first, 420
            while last < len(spans) and spans[last][1] - spans[last][0] <= room:
                room -= spans[last][1] - spans[last][0]
                last += 1
            chunks.append((spans[first][0], spans[last - 1][1], last - first))
            first = len(spans) if last == len(spans) else max(first + 1, last - overlap)
        assert found.get(key, []) == chunks


def test_a_segment_over_a_chunk_is_an_error_and_nothing_gives_nothing(spark):
    docs = spark.createDataFrame(texts(), "doc int, body string")
    with pytest.raises(Exception, match="longer than a chunk"):
        segments.packed(segments.segments(docs, "doc", size=100), "doc", size=50).collect()
    none = segments.segments(docs.limit(0), "doc")
    assert none.count() == 0 and segments.packed(none, "doc").count() == 0


def test_a_document_of_very_many_segments_is_packed_in_one_pass(spark):
    n, rnd = 200_000, random.Random(3)
    lengths = [rnd.randint(1, 9) for _ in range(n)]
    of = F.element_at(F.lit(lengths[:1000]), (F.col("id") % 1000 + 1).cast("int"))
    rows = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(7)).alias("doc"), F.col("id").cast("string").alias("segment"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"), F.repeat(F.lit("x"), of).alias("text"))
    found = {}
    for r in segments.packed(rows, "doc", size=40, overlap=1).select("doc", "position", "start", "end").orderBy("doc", "position").collect():
        found.setdefault(r.doc, []).append((r.position, r.start, r.end))
    for key, ids in ((7, range(0, n, 2)), (None, range(1, n, 2))):  # rows without a document are one
        chunks, first = [], 0
        while first < len(ids):
            last, room = first, 40
            while last < len(ids) and lengths[ids[last] % 1000] <= room:
                room -= lengths[ids[last] % 1000]
                last += 1
            chunks.append((len(chunks), ids[first], ids[last - 1] + 1))
            first = len(ids) if last == len(ids) else max(first + 1, last - 1)
        assert found[key] == chunks
