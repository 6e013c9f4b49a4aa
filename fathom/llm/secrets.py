"""Secret scans: fixed patterns, and character Markov models that find random strings without one.

Markov models over the characters of a token, first-order ones for kinds of random strings and
second-order ones for kinds of ordinary strings (words and identifiers, sequences and rulers, numbers), are
trained from labelled samples by grouped counts. A token is a secret if its log-likelihood under the
likeliest random model exceeds that under the likeliest ordinary one by a margin. Each pair of characters
counts once a token, so what a token repeats is no further evidence; the total counts, not its mean, so short
tokens must look the more random.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import itertools
import math
import os
import random
import re
import string
import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
#: Longest runs of these characters are the same as all runs, then dropped where too short.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

#: Characters and least length of what the models judge.
ALPHABET, LEAST = string.ascii_letters + string.digits + "+/_=-", 10
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Log-likelihood ratio (natural logarithm, of the whole token) from which a token counts as random.
MARGIN = 20.0
#: Labels of ordinary strings; all others are kinds of random strings.
ORDINARIES = ORDINARY, SEQUENCE, NUMBER = ("ordinary", "sequence", "number")
#: Weight of the first-order model where a second-order one has seen little.
BACK = 5.0
#: Labelled ordinary words: the vocabulary of a public tokenizer, most frequent first. Read by the driver alone.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SAMPLES = 60_000
#: Rows whose words are learned as ordinary ones (about), and the most such words.
ROWS, WORDS_OF = 5_000, 20_000
#: How much a row of a first-order model leans on the frequencies of single characters.
LEAN = 30.0

# the labelled samples: kinds of random strings by their alphabets, and words that ordinary strings are made of
RANDOM_KINDS = {
    "base62": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/", "base64url": string.ascii_letters + string.digits + "-_", "base36": string.ascii_lowercase + string.digits,
    "base32": string.ascii_uppercase + string.digits, "hex": "0123456789abcdef", "letters": string.ascii_letters, "lower": string.ascii_lowercase, "upper": string.ascii_uppercase,
}
WORDS = (
    "get set is add new max key id url name type value data file path user list item map node text line page size count index start end first next open close read write load send "
    "create update delete insert select order group filter sort find parse format encode hash token session request response client server config option default message error debug "
    "the and that with from this which not are for have will of to in on by be or an as at all would their about been more some them only could time these "
    "ver ung heit keit lich schaft und der die das mit sich auf eine auch sein haben durch gegen zwischen bezug ganz einzeln beispiel "
    "le les des une dans pour que qui avec pas plus sont elle nous tout mais aussi mieux vieux cheveux oiseau maison voix jamais beaucoup premier avait "
    "los las para con del como este mucho donde trabajo tion ment ness able ing er est ous "
    "http www com org html xhtml xml dtd w3c utf svg src lib bin usr local python java test main web api v2 version january february november december 2024 100"
).split()


def vocabulary_words(path: str = VOCABULARY) -> list[str]:
    """WORDS, and words of a vocabulary file in its order; without the file WORDS alone, with which ordinary strings are known worse."""
    if not os.path.exists(path):
        warnings.warn(f"no vocabulary at {path}: ordinary strings are learned from {len(WORDS)} words", stacklevel=2)
        return WORDS
    with open(path) as lines:
        words = (base64.b64decode(x.split()[0]).decode("utf-8", "ignore").strip() for x in lines)
        return WORDS + [w for w in words if re.fullmatch("[A-Za-z][A-Za-z0-9]{1,23}", w)]


def words_of(docs: DataFrame, text_col: str = "text", rows: int = ROWS, most: int = WORDS_OF) -> list[str]:
    """Plain words (lower case, capitalised or upper case) that stand in at least two texts of about `rows` rows, chosen by hash of the text:
    the most frequent ones, at most `most`. What a mixed-case token is, no document says."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    every = max(1, docs.count() // rows)
    some = docs.select(text.alias("text"), F.xxhash64(text).alias("h")).where(F.pmod("h", F.lit(every)) == 0)
    words = some.select("h", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9+/_=-])([A-Z]?[a-z]{1,19}|[A-Z]{2,20})(?![A-Za-z0-9+/_=-])"), F.lit(1)))).alias("word"))
    counted = words.distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    least, total = 2, 0
    for r in sorted(counted.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.n):  # at most `rows` different counts
        total += r.words
        if total > most:
            least = r.n + 1
            break
    return [r.word for r in sorted(counted.where(F.col("n") >= least).collect(), key=lambda r: (-r.n, r.word))]


def sample_strings(words: list[str], own: list[str] = (), n: int = SAMPLES) -> list[tuple[str, str]]:
    """Labelled samples (text, label): n ordinary strings of one to five words, half of them of the corpus's own ones if there are any (a word's
    share falls with its place), joined in the ways of identifiers, paths, compounds and assignments, some with a number or a
    ruler; a third as many random strings of 8 to 64 characters over the kinds; sequences and repeats of alphabets;
    numbers. They depend on nothing but the arguments."""
    rng, samples = random.Random(20), []
    lists = [(x, list(itertools.accumulate(1 / (rank + 300) for rank in range(len(x))))) for x in (words, own) if x]
    ruler = lambda: rng.choice("-=_/+") * rng.randrange(2, 30) if rng.random() < 0.5 else "".join(rng.choice("-=_/+") * rng.randrange(1, 3) for _ in range(2))
    cases = (str.lower, str.upper, str.capitalize, lambda w: w.upper()[:3])
    for _ in range(n):
        known, shares = rng.choice(lists)
        some = [known[bisect.bisect(shares, rng.random() * shares[-1])] for _ in range(1 + rng.randrange(5))]
        low, style = [w.lower() for w in some], rng.randrange(11)
        capital = [w.capitalize() for w in some]
        text = (
            "_".join(low) if style == 0 else "-".join(some) if style == 1 else "/".join(some) if style == 2 else "".join(capital) if style == 3 else low[0] + "".join(capital[1:]) if style == 4
            else "_".join(some).upper() if style == 5 else "".join(low).capitalize() if style == 6 else "".join(low) if style == 7 else f"{low[0]}={'_'.join(low)}" if style == 8 else f"__{'_'.join(low)}__" if style == 9
            else rng.choice(("/", "//", "-", "_")).join(rng.choice(cases)(w) for w in some)
        )
        text += str(rng.randrange(10 ** rng.randrange(1, 5))) if rng.random() < 0.25 else ""
        text = (ruler() if rng.random() < 0.1 else "") + text + (ruler() if rng.random() < 0.1 else "")
        at = rng.randrange(1, 6)
        samples.append((text[:at] + str(rng.randrange(100)) + rng.choice(["_", "-", "", "/"]) + text[at:] if rng.random() < 0.1 else text, ORDINARY))
    kinds = list(RANDOM_KINDS)
    for i in range(n // 3):
        kind = kinds[i % len(kinds)]
        samples.append(("".join(rng.choice(RANDOM_KINDS[kind]) for _ in range(rng.randrange(8, 65))), kind))
    rows = (string.ascii_lowercase, string.ascii_uppercase, string.digits, string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/", string.ascii_lowercase + string.ascii_uppercase + string.digits + "-_")
    for row in rows:
        for _ in range(n // 300):
            at = rng.randrange(len(row))
            samples.append(((row * 3)[at : at + rng.randrange(4, 60)], SEQUENCE))
    samples += [(c * 40, SEQUENCE) for c in ALPHABET] * 20
    for _ in range(n // 20):
        parts = [str(rng.randrange(10 ** rng.randrange(1, 17))) for _ in range(rng.randrange(1, 6))]
        samples.append((rng.choice("_-/+") .join(parts) + (f"e{rng.choice('+-')}{rng.randrange(30)}" if rng.random() < 0.3 else ""), NUMBER))
    return samples


class Markov:
    """Log-likelihoods of tokens, from counts of (two or three characters, label): first-order models of random kinds, second-order ones,
    eased by their first-order ones, of ordinary kinds."""

    def __init__(self, counts: dict[tuple[str, str], int], smooth: float = 0.5, lean: float = LEAN, back: float = BACK):
        labels = {label for _, label in counts}
        self.labels, place, size = sorted(labels - set(ORDINARIES)), {c: i for i, c in enumerate(ALPHABET)}, len(ALPHABET)
        self.ordinary = [x for x in ORDINARIES if x in labels] or [ORDINARY]
        pairs = {label: np.zeros((size, size)) for label in [*self.labels, *self.ordinary]}
        triples = {label: np.zeros((size, size, size), np.float32) for label in self.ordinary}
        for (gram, label), n in counts.items():
            at = tuple(place[c] for c in gram)
            if len(at) == 2:
                pairs[label][at] += n
            elif label in triples:
                triples[label][at] += n
        single = {label: (t.sum(0) + smooth) / (t.sum() + smooth * size) for label, t in pairs.items()}
        shares = {label: (t + lean * single[label][None]) / (t.sum(1, keepdims=True) + lean) for label, t in pairs.items()}
        #: log P by code: of random kinds (kind, before, next), of ordinary ones (kind, two before, before, next); a token's second character has no two before.
        self.random = np.log(np.stack([shares[x] for x in self.labels])) if self.labels else np.zeros((0, size, size))
        self.second = np.log(np.stack([shares[x] for x in self.ordinary]))
        self.later = np.log(np.stack([(t + back * shares[x][None]) / (t.sum(2, keepdims=True) + back) for x, t in triples.items()])).astype(np.float32)
        self.codes = np.zeros(128, np.int64)
        self.codes[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(size)

    def score(self, tokens: list[str]) -> np.ndarray:
        """Log-likelihood ratio of each token of at least two characters of ALPHABET: the likeliest random model over the likeliest ordinary
        one, over the token's distinct pairs, each where it first stands."""
        if not tokens or not self.labels:
            return np.full(len(tokens), -np.inf)
        data = self.codes[np.frombuffer("".join(tokens).encode(), np.uint8)]
        size = np.array([len(t) for t in tokens])
        begin, owner = np.cumsum(size) - size, np.repeat(np.arange(len(tokens)), size)
        inside = np.ones(len(data), bool)
        inside[begin] = False
        at = np.flatnonzero(inside)
        n = len(ALPHABET)
        _, first = np.unique((owner[at] * n + data[at - 1]) * n + data[at], return_index=True)
        at = at[np.sort(first)]
        b, c, early = data[at - 1], data[at], at - 1 == begin[owner[at]]
        a = data[np.where(early, at - 1, at - 2)]
        starts = np.searchsorted(owner[at], np.arange(len(tokens)))  # each token has a pair
        likely = np.stack([np.add.reduceat(r[b, c], starts) for r in self.random]).max(0)
        plain = np.stack([np.add.reduceat(np.where(early, s[b, c], t[a, b, c]), starts) for s, t in zip(self.second, self.later, strict=True)]).max(0)
        return likely - plain


def train(samples: DataFrame, text_col: str = "text", label_col: str = "label") -> Markov:
    """Counts two and three characters in a row of labelled strings by grouped aggregation: at most 67 * 67 counts for each label, and
    67 ** 3 for each of ORDINARIES.

    These are labels of what is no secret, every other one that of a kind of random string. Rows with a null, and
    characters in a row with others than ALPHABET, don't count.
    """
    text = F.col(text_col).cast("string")
    rows = samples.where((F.length(text) > 1) & F.col(label_col).isNotNull()).select(text.alias("text"), F.col(label_col).cast("string").alias("label"))
    of = lambda k: F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, F.lit(k)))
    three = F.when(F.col("label").isin(*ORDINARIES), of(3)).otherwise(F.array().cast("array<string>"))
    grams = rows.select("label", F.explode(F.concat(of(2), F.filter(three, lambda x: F.length(x) == 3))).alias("gram")).where(F.col("gram").rlike("^[A-Za-z0-9+/_=-]{2,3}$"))
    return Markov({(r.gram, r.label): r["count"] for r in grams.groupBy("gram", "label").count().collect()})


def default_model(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> Markov:
    """A model of ordinary strings as a vocabulary and the documents themselves have them, and of random ones."""
    samples = sample_strings(vocabulary_words(vocabulary), words_of(docs, text_col))
    return train(docs.sparkSession.createDataFrame(samples, "text string, label string"))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; kind is an index into KINDS; offsets are code points."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _uncovered(start: int, end: int, base):
    """The pieces of a token that no base span covers."""
    for a, _, b in base:
        if b <= start or a >= end:
            continue
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def spans(texts: list[str], model: Markov | None, margin: float = MARGIN) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: base ones, and what the models find in tokens, or in pieces of them that base spans leave."""
    out = [base_spans(t) for t in texts]
    if model is not None:
        spots, tokens = [], []
        for row, (text, base) in enumerate(zip(texts, out, strict=True)):
            for m in TOKEN.finditer(text):
                for a, b in _uncovered(*m.span(), base) if base else (m.span(),):
                    if b - a >= LEAST:
                        spots.append((row, a, b))
                        tokens.append(text[a:b])
        for (row, a, b), ratio in zip(spots, model.score(tokens).tolist(), strict=True):
            if ratio >= margin:
                out[row].append((a, 3, b))
    return [sorted(x) for x in out]


def _told(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def _texts(column, size: int = 64):
    """Strings of a column, null as empty, a few at a time."""
    for a in range(0, len(column), size):
        yield a, [t or "" for t in column.slice(a, size).to_pylist()]


def _scan(model, margin):
    def run(batches):
        for batch in batches:
            out = [x for _, texts in _texts(batch.column("text")) for x in spans(texts, model.value, margin)]
            base = [[s for s in x if s[1] < 3] for x in out]
            counts = [pa.array([sum(s[1] == k for s in x) for x in out], pa.int64()) for k in range(4)]
            sha = pa.array([hashlib.sha256(_told(x).encode()).hexdigest() for x in base])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *counts[:3], sha, pa.array(map(_told, out), pa.string()), counts[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])
        pa.default_memory_pool().release_unused()

    return run


def find_secrets(docs: DataFrame, model: Markov | None = None, id_col="doc_id", text_col="text", margin: float = MARGIN) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    spans lists kind:start:end of all secrets by start; base_sha256 is the digest of those of the
    fixed patterns. What a fixed pattern covers is not judged again. A null text counts as
    empty and has none; whole texts are searched; rows that repeat an id, or have none, are each
    returned; no rows give no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model(docs, text_col))  # under a million numbers
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_scan(shared, margin), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def without_secrets(docs: DataFrame, model: Markov | None = None, text_col="text", margin: float = MARGIN) -> DataFrame:
    """The rows of docs whose text holds no secret, with all columns as they are; a null text holds none."""
    shared = docs.sparkSession.sparkContext.broadcast(model or default_model(docs, text_col))

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            clean = [not x for _, texts in _texts(column) for x in spans(texts, shared.value, margin)]
            yield batch.filter(pa.array(clean, pa.bool_()))
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, docs.schema)
