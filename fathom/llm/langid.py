"""Language identification by Bayesian fusion of evidence.

log P(l | all) ~ log P(l | host) + log P(declared | l) + log P(suffix | l) + text evidence, where
text evidence is the log-likelihood of hashed character trigrams over three, as each character has a
part in three of them. Trigram counts, the confusion of declared and found
languages, the languages of address suffixes and the host priors are all grouped aggregates over
every row; a host's prior is smoothed towards its suffix's, and that towards the whole corpus's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.shared import byte_class, cut, text_slices, without

LANGUAGES = ("en", "de", "fr", "es")
_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_BITS = 16
BUCKETS = 1 << _BITS
#: Part of a trigram's log-likelihood that is evidence of its own.
INDEPENDENT = 1 / 3
#: Strength of a suffix's and the corpus's prior, in documents.
HOST_STRENGTH, SUFFIX_STRENGTH = 5.0, 20.0
#: Least posterior, and least mean log-likelihood gain of the best language over chance bytes, of an accepted text.
CONFIDENCE, GAIN = 0.5, 0.5


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    """The last label of a host with at least two; else the empty string."""
    return F.regexp_extract(host, "\\.([^.]+)$", 1)


def markup_language(html: Column) -> Column:
    """The language that a page's html element declares, in lower case; empty if none."""
    return F.lower(F.regexp_extract(html, "(?is)<html[^>]*?\\blang\\s*=\\s*[\"']?([A-Za-z]{2,3})", 1))


def _trigrams(data: np.ndarray, offsets: np.ndarray):
    """(row, bucket) of each byte trigram inside a text, letters folded and other ASCII bytes as one space."""
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 32
    table[:0x41], table[0x5B:0x61], table[0x7B:0x80] = 32, 32, 32
    d = table[data]
    # two separators in a row say nothing
    keep = np.ones(len(d), bool)
    keep[1:] = ~((d[1:] == 32) & (d[:-1] == 32))
    starts = offsets[:-1][offsets[:-1] < len(d)]
    keep[starts] = True
    at = np.concatenate(([0], np.cumsum(keep)))[offsets]
    d = d[keep].astype(np.uint32)
    if len(d) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = ((d[:-2] * 0x01000193 ^ d[1:-1]) * 0x01000193 ^ d[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - _BITS)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = row[:-2] == row[2:]
    return row[:-2][inside], code[inside].astype(np.int64)


def _counted(languages):
    def run(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            declared = np.array([languages.index(x) if x in languages else -1 for x in batch.column("declared").to_pylist()])
            for a, b, data, offsets in text_slices(batch.column("text")):
                row, code = _trigrams(data, offsets)
                lang = declared[a:b][row]
                total += np.bincount((lang * BUCKETS + code)[lang >= 0], minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[lang, bucket])], ["lang", "bucket", "n"])

    return run


def text_model(docs: DataFrame, languages=LANGUAGES, text_col="text", label_col="lang") -> np.ndarray:
    """Smoothed log P(trigram | language) (languages x BUCKETS), counted over all labelled rows."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.lower(F.col(label_col)).alias("declared")).where(F.col("declared").isin(*languages))
    counts = rows.mapInArrow(_counted(list(languages)), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((len(languages), BUCKETS), 0.5)
    table[counts["lang"], counts["bucket"]] += counts["n"]
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _likelihoods(model):
    def run(batches):
        table = np.ascontiguousarray(model.value.T)
        for batch in batches:
            parts, sizes, letters = [], [], []
            for a, b, data, offsets in text_slices(batch.column("text")):
                row, code = _trigrams(data, offsets)
                n = np.bincount(row, minlength=b - a)
                sums = np.stack([np.bincount(row, table[code, k], b - a) for k in range(table.shape[1])], 1)
                parts.append(sums / np.maximum(n, 1)[:, None])
                sizes.append(n)
                letters.append(np.diff(np.concatenate(([0], np.cumsum(_LETTERS[data], dtype=np.int64)))[offsets]) > 0)
            if parts:
                means, n = np.concatenate(parts), np.concatenate(sizes)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * table.shape[1], pa.int32()), pa.array(means.reshape(-1)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "row_key", "declared", "host")), pa.array(n, pa.int64()), pa.array(np.concatenate(letters)), values], ["id", "row_key", "declared", "host", "n_trigrams", "letters", "means"])

    return run


def row_key(text: Column, declared: Column, host: Column) -> Column:
    """With the id, what tells rows apart whose evidence differs."""
    return F.xxhash64(text.isNull(), text, declared, host)


def address(url: Column | None, host: Column | None) -> Column:
    """The host of an address, else the name that stands for one, else an empty string."""
    found = host_of(url) if url is not None else host if host is not None else F.lit(None)
    return F.coalesce(found.cast("string"), F.lit(""))


def identify(docs: DataFrame, id_col="doc_id", text_col="text", declared: Column | str | None = "lang", url: Column | str | None = None, host: Column | str | None = None, languages=LANGUAGES, model: np.ndarray | None = None) -> DataFrame:
    """One row per document: doc_id, language, posterior, text_language, gain, n_trigrams, accepted, row_key.

    declared is the language that markup or metadata states, url an address (its host and suffix
    count), host a name where there is no address. The text model is trained on the declared
    languages unless it is given. A null or undeclared language, address or host is no evidence; a
    text too short for a trigram, or null, is judged by the rest. Accepted are texts with a letter, a
    posterior of at least CONFIDENCE and, if they have trigrams, a likelihood above chance by GAIN. Ties go to the
    language named first. Rows that repeat an id, or have none, are each returned and count singly; no rows give
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    as_column = lambda x: F.col(x) if isinstance(x, str) else x
    said_ = F.lower(as_column(declared).cast("string")) if declared is not None else F.lit(None).cast("string")
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), said_.alias("declared"), address(as_column(url), as_column(host)).alias("host"))
    docs = docs.withColumn("row_key", row_key(F.col("text"), F.col("declared"), F.col("host")))
    if model is None:
        model = text_model(docs, languages, "text", "declared")
    k = len(languages)
    likely = docs.mapInArrow(_likelihoods(spark.sparkContext.broadcast(model)), "id long, row_key long, declared string, host string, n_trigrams long, letters boolean, means array<double>")
    likely = cut(
        likely.withColumn("declared", F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise("")).withColumn("suffix", suffix_of(F.col("host")))
        .withColumn("text_language", F.when(F.col("n_trigrams") > 0, F.element_at(F.array(*map(F.lit, languages)), F.array_position("means", F.array_max("means")).cast("int"))))
    )
    count = [F.sum((F.col("text_language") == x).cast("long")).alias(x) for x in languages]
    sure = likely.where("text_language is not null")
    whole = sure.agg(*(F.coalesce(c, F.lit(0)).alias(x) for c, x in zip(count, languages, strict=True))).first()
    n = np.array([whole[x] for x in languages], float)
    prior = (n + 1) / (n.sum() + k)
    # declared languages are few and named; the evidence of a declaration is its column of the confusion
    confusion = {r.declared: np.array([r[x] for x in languages], float) for r in sure.groupBy("declared").agg(*count).collect()}
    said = {d: np.log((confusion.get(d, np.zeros(k)) + 1) / (n + k + 1)) for d in languages}
    # suffixes and hosts are as many as they are: both stay tables, joined by key
    smooth = lambda base, strength: [((F.col(x) + strength * p) / (sum((F.col(y) for y in languages), F.lit(0)) + strength)).alias(f"{x}_p") for x, p in zip(languages, base, strict=True)]
    suffixes = sure.groupBy("suffix").agg(*count).select("suffix", *smooth([float(p) for p in prior], SUFFIX_STRENGTH))
    hosts = sure.groupBy("host", "suffix").agg(*count).join(suffixes, "suffix")
    log_host = F.array(*(F.log((F.col(x) + HOST_STRENGTH * F.col(f"{x}_p")) / (sum((F.col(y) for y in languages), F.lit(0)) + HOST_STRENGTH)) for x in languages))
    log_suffix = F.array(*(F.when(F.col("suffix") == "", 0.0).otherwise(F.log(F.col(f"{x}_p") / float(p))) for x, p in zip(languages, prior, strict=True)))
    salts = F.array(*map(F.lit, range(16)))
    hosts = cut(hosts.select("host", log_host.alias("of_host"), log_suffix.alias("of_suffix")).withColumn("salt", F.explode(salts)))
    likely = likely.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).join(hosts, ["host", "salt"], "left")
    none = F.array(*(F.lit(float(np.log(p))) for p in prior))
    declared_table = F.create_map(*(x for d in languages for x in (F.lit(d), F.array(*map(lambda v: F.lit(float(v)), said[d])))))
    zero = F.array(*[F.lit(0.0)] * k)
    weight = F.col("n_trigrams") * F.lit(INDEPENDENT)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = add(add(F.coalesce("of_host", none), F.coalesce("of_suffix", zero)), add(F.coalesce(declared_table[F.col("declared")], zero), F.transform("means", lambda m: m * weight)))
    scored = likely.withColumn("total", total).withColumn("top", F.array_max("total"))
    scored = scored.withColumn("language", F.element_at(F.array(*map(F.lit, languages)), F.array_position("total", F.col("top")).cast("int")))
    scored = scored.withColumn("posterior", 1 / F.aggregate("total", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    scored = scored.withColumn("gain", F.array_max("means") + F.lit(float(np.log(BUCKETS))))
    ok = F.col("letters") & (F.col("posterior") >= CONFIDENCE) & ((F.col("n_trigrams") == 0) | (F.col("gain") >= GAIN))
    return scored.select(F.col("id").alias("doc_id"), "language", "posterior", "text_language", "gain", "n_trigrams", F.coalesce(ok, F.lit(False)).alias("accepted"), "row_key")


def accepted(docs: DataFrame, id_col="doc_id", text_col="text", declared="lang", host="source", **more) -> DataFrame:
    """The rows of docs that identify accepts, with all columns as they are."""
    found = identify(docs, id_col, text_col, declared=declared, host=host, **more)
    gone = cut(found.where(~F.col("accepted")).select(F.col("doc_id").alias("__a"), F.col("row_key").alias("__b")).distinct())
    key = row_key(F.col(text_col).cast("string"), F.lower(F.col(declared).cast("string")), address(None, F.col(host)))
    rows = docs.withColumn("__i", F.col(id_col).cast("long")).withColumn("__k", key)
    return without(rows, gone, F.col("__i").eqNullSafe(F.col("__a")) & (F.col("__k") == F.col("__b"))).select(*docs.columns)
