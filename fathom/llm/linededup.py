"""Line deduplication: lines that many documents share stay in one of them.

Lines are exploded with their positions, normalised and hashed; a grouped aggregation counts the
distinct documents of each hash; lines of hashes over the threshold are dropped, and documents put
together again by position. Only hashes are shuffled for the counts, each document's once; texts move
once, to the positions that they lose.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import MOST_BROADCAST, cut

#: Least code points of a key that counts, and the documents from which it is a repeated one.
LEAST, DOCUMENTS = 20, 3
#: fixed value: what is stripped at both ends of a line
SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """A line as it is compared: stripped of SPACE at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACE)), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, t, at, h1, h2): the lines that count, by two independent 64-bit hashes of their keys."""
    rows = docs.select("id", "t", F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).select("id", "t", "at", line_key(F.col("line")).alias("key"))
    return rows.where(F.length("key") >= least).select("id", "t", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))


def repeated_lines(lines: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(h1, h2, n, keeper): keys of at least so many distinct documents, how many, and the largest id among them.

    Pairs of key and document are made distinct first, by both, so a line that a third of all documents
    hold is counted in many tasks, and each sends one row for it."""
    pairs = lines.select(*_KEY, "id").distinct()
    return pairs.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= documents)


def _lost(lines: DataFrame, repeated: DataFrame, most: int) -> DataFrame:
    """(id, t, lost): positions of lines to drop in each text of an id.

    Keys that hold over 1 / most of all lines are fewer than `most` and broadcast; no other key is hot, and these join
    by hash."""
    total = max(1, lines.count())
    hot = F.broadcast(repeated.where(F.col("n") * most > total).select(*_KEY, "keeper"))
    cold = repeated.where(F.col("n") * most <= total).select(*_KEY, "keeper")
    found = lines.join(hot, _KEY).unionByName(lines.join(hot.select(*_KEY), _KEY, "left_anti").join(cold, _KEY))
    # rows that repeat an id and a text name the same positions, and a set holds each once
    return found.where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("id", "t").agg(F.collect_set("at").alias("lost"))


def _reassemble(batches):
    for batch in batches:
        texts, counts, dropped = [], [], []
        for text, lost in zip(batch.column("text").to_pylist(), batch.column("lost").to_pylist(), strict=True):
            lines, gone = text.split("\n"), set(lost or ())
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in gone) if gone else text)
            counts.append(len(lines))
            dropped.append(len(gone))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])


def drop_repeated_lines(docs: DataFrame, id_col="doc_id", text_col="text", least: int = LEAST, documents: int = DOCUMENTS, most: int = MOST_BROADCAST) -> DataFrame:
    """One row per document: doc_id, text (the lines that stay, joined by newlines), n_lines (before), n_dropped.

    A line's key is what line_key makes of it. Keys of at least `least` code points that at least `documents`
    documents hold lose all their lines, but in the document of the largest id, which keeps all of its own. Rows of one
    id are one document; rows without an id are together one, below every id. A null or empty text is one empty line.
    Lines that a document repeats count once. Each row is returned, repeated ones too; no rows give no rows; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).withColumn("t", F.xxhash64("text"))
    lines = cut(_lines(docs, least))
    lost = _lost(lines, cut(repeated_lines(lines, documents)), most).select(F.col("id").alias("i"), F.col("t").alias("u"), "lost")
    rows = docs.join(lost, F.col("id").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left").select("id", "text", "lost")
    return rows.mapInArrow(_reassemble, "doc_id long, text string, n_lines long, n_dropped long")
