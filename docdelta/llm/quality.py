"""A quality classifier over random-indexing word vectors.

Every word stands for two tokens: its letters in lower case, hashed to one of CORES rows, and its
shape (`X!!` for `WORDS!!`), hashed to one of SHAPES rows. Random indexing gives every token a fixed
index vector with a few entries of +1 or -1, and adds to a token's context vector the index vectors
of the words around each of its occurrences, over all documents. The table of context vectors has a
fixed size, about 1 MB, whatever the input.

A document is the mean of its tokens' context vectors and of its shapes' index vectors, with its
length, its share of different words and its words' length. A network of two layers in numpy, fitted
on at most `most_labels` labelled rows (those of least hash of doc_id), gives a logit; a temperature
fitted on a fifth of them that the network hasn't seen calibrates the probability.

Null and empty texts are documents without words and get a score like any other. Rows with equal ids
are separate rows. Null labels, labels of unknown documents and repeated labels beyond the largest
are left out; without labels of both kinds every score is the labels' share of 1, or 0.5 without
any. An empty table gives no rows.
"""

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docdelta.llm.common import bounded_batches, by_batch, crc_mod, give_back, id_and_text, stored, table

CORES, SHAPES, DIMS, AROUND, NONZERO = 8192, 512, 32, 2, 2
TOKENS = CORES + SHAPES
FEATURES = 3 * DIMS + 4
#: Labelled rows that the network is fitted on, at most.
MOST_LABELS = 20_000
ACCEPT = 0.3
#: Bytes that a worker's known words may take, kept from task to task; a word takes its length and WORD_BYTES.
CACHE_BYTES, WORD_BYTES = 96 << 20, 160
#: Characters of text whose words' contexts are held at once, if no single text is longer.
PIECE = 1_000_000
#: Slices of the table of sums; tables of as many tasks are added up by one group.
SLICES, FAN_IN = 16, 16
_RNG = np.random.default_rng(20240607)
_PLACES = _RNG.integers(0, DIMS, (TOKENS, NONZERO))
_SIGNS = _RNG.choice([-1, 1], (TOKENS, NONZERO))
_INDEX = np.zeros((TOKENS, DIMS), np.float32)
for _k in range(NONZERO):
    np.add.at(_INDEX, (np.arange(TOKENS), _PLACES[:, _k]), _SIGNS[:, _k])

_RUNS = (re.compile(r"[^\W\d_a-z]*[A-ZÀ-ÖØ-Þ]+[^\W\d_a-z]*"), re.compile(r"[^\W\d_X]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    """Runs of capitals to X, of other letters to x, of digits to 9; other characters stay, 6 in all."""
    return _RUNS[2].sub("9", _RUNS[1].sub("x", _RUNS[0].sub("X", word)))[:6]


_MARKS = b".,;:!?"


def token(word: bytes) -> int:
    """core * SHAPES + shape of a word. Plain letters, with or without marks at the end, need no patterns."""
    head = word.rstrip(_MARKS)
    if head.isalpha():  # of bytes: letters A-Z alone
        if head.islower():
            plain = b"x"
        elif head[1:].islower():
            plain = b"Xx"
        else:
            plain = shape(head.decode()).encode()
        return zlib.crc32(head.lower()) % CORES * SHAPES + zlib.crc32((plain + word[len(head) :])[:6]) % SHAPES
    text = word.decode()
    letters = text.isalpha()
    core = (text if letters else "".join(filter(str.isalpha, text))).lower()
    form = "x" if letters and text.islower() else shape(text)
    return zlib.crc32(core.encode()) % CORES * SHAPES + zlib.crc32(form.encode()) % SHAPES


class _Tokens(dict):
    """word -> token, for words of at most `most` bytes in all.

    When half of them are new, the half before leaves; a word that is met again moves on to the new half.
    """

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.held, self.old = most, 0, {}

    def __missing__(self, word: bytes) -> int:
        size = len(word) + WORD_BYTES
        if self.held + size > self.most // 2:
            self.old = dict(self)
            self.clear()
            self.held = 0
        out = self.old.get(word)
        if out is None:
            out = token(word)
        self.held += size
        self[word] = out
        return out

    def within(self, most: int) -> None:
        if most < self.most:
            self.clear()
            self.old, self.held = {}, 0
        self.most = most


_tokens = _Tokens()


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' letters and shapes in the table of vectors."""
    words = (text or "").encode().split()
    ids = np.fromiter(map(_tokens.__getitem__, words), np.int64, len(words))
    return ids // SHAPES, CORES + ids % SHAPES


# ---- word vectors


def context_sums(texts: list[str | None]) -> np.ndarray:
    """For each token, the sum of the index vectors of the words within AROUND of its occurrences."""
    out = np.zeros((TOKENS, DIMS), np.int64)
    found = [tokens(t) for t in texts]
    if not any(len(c) for c, _ in found):
        return out
    # A gap between documents, so that no word is near one of another; its vector is the last one, of zeros.
    gap = np.full(AROUND, TOKENS)
    cores, shapes = (np.concatenate([x for pair in found for x in (pair[i], gap)]) for i in (0, 1))
    index = np.vstack([_INDEX, np.zeros(DIMS)]).astype(np.int8)
    both = index[cores] + index[shapes]
    near = np.zeros_like(both)  # of small numbers: 2 * AROUND words of two tokens of NONZERO entries
    for step in range(1, AROUND + 1):
        near[:-step] += both[step:]
        near[step:] += both[:-step]
    for d in range(DIMS):
        add = np.ascontiguousarray(near[:, d])
        for mine in (cores, shapes):
            out[:, d] += np.bincount(mine, add, TOKENS + 1)[:TOKENS].astype(np.int64)  # whole numbers far below 2^53
    return out


SUMS = "part int, source bigint, sums binary"


def word_vectors(docs: DataFrame, cache_bytes: int = CACHE_BYTES) -> np.ndarray:
    """Unit context vectors of all tokens, from all documents.

    Each task makes one table of sums, in slices; they are added up FAN_IN at a time, so that no
    group holds more of them, however many tasks there are.
    """

    def run(batches):
        _tokens.within(cache_bytes)
        sums = np.zeros((TOKENS, DIMS), np.int64)
        for batch in batches:
            texts, held, size = batch.column("text").to_pylist(), [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size > PIECE:
                    sums += context_sums(held)
                    held, size = [], 0
            sums += context_sums(held)
        give_back()
        source = TaskContext.get().partitionId()
        pieces = np.array_split(sums, SLICES)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(SLICES), pa.int32()), "source": pa.array([source] * SLICES, pa.int64()), "sums": pa.array([x.tobytes() for x in pieces], pa.binary())})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["sums"])
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "source": pdf["source"].iloc[:1] // FAN_IN, "sums": [total.tobytes()]})

    tables = stored(docs.select("text").mapInArrow(run, SUMS), "word-sums", "zstd")
    last = tables.agg(F.max("source")).first()[0]
    while last:  # until one table is left of each slice
        tables = stored(tables.groupBy("part", F.floor(F.col("source") / FAN_IN).alias("next")).applyInPandas(add, SUMS), "word-sums", "zstd")
        last //= FAN_IN
    rows = tables.select("part", "sums").collect()  # SLICES rows, whatever the input
    sums = np.concatenate([np.frombuffer(r.sums, np.int64) for r in sorted(rows)] or [np.zeros(TOKENS * DIMS, np.int64)]).reshape(TOKENS, DIMS).astype(np.float64)
    # The common direction says nothing of a token; it goes before lengths are made equal.
    sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    sums -= sums.mean(axis=0)
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(text: str | None, vectors: np.ndarray) -> np.ndarray:
    """The document's features."""
    cores, shapes = tokens(text)
    n = len(cores)
    if not n:
        return np.zeros(FEATURES, np.float32)
    uc, nc = np.unique(cores, return_counts=True)
    ns = np.bincount(shapes - CORES, minlength=SHAPES)
    us = np.flatnonzero(ns)
    ns, us = ns[us], us + CORES
    return np.concatenate([nc @ vectors[uc] / n, ns @ vectors[us] / n, ns @ _INDEX[us] / n, [np.log1p(n), len(uc) / n, len(text) / n / 10, nc.max() / n]]).astype(np.float32)


# ---- network


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit(x: np.ndarray, y: np.ndarray, fresh: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the logistic loss over the rows that aren't fresh; then the temperature on those that are."""
    share = float(y.mean()) if len(y) else 0.5
    if len(y) < 2 or share in (0.0, 1.0):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Network(np.zeros(FEATURES), np.ones(FEATURES), np.zeros((FEATURES, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    if fresh.all() or not fresh.any():
        fresh = np.zeros(len(y), bool)
    a, b = x[~fresh].astype(np.float64), y[~fresh].astype(np.float64)
    rng = np.random.default_rng(seed)
    net = Network(a.mean(axis=0), a.std(axis=0) + 1e-3, rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), 0.0)
    a = (a - net.mean) / net.scale
    p = [net.w1, net.b1, net.w2, np.array([float(np.log(share / (1 - share)))])]
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        order = rng.permutation(len(b))
        for i in range(0, len(b), 256):
            rows = order[i : i + 256]
            h = np.tanh(a[rows] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - b[rows]) / len(rows)
            d = g[:, None] * p[2] * (1 - h * h)
            t += 1
            for q, grad, mm, vv in zip(p, (a[rows].T @ d + decay * p[0], d.sum(axis=0), h.T @ g + decay * p[2], g.sum(keepdims=True)), m, v, strict=True):
                mm += 0.1 * (grad - mm)
                vv += 0.001 * (grad * grad - vv)
                q -= rate * (1 - epoch / epochs) * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
    net.b2 = float(p[3][0])
    if fresh.any():
        z, w = net.logits(x[fresh]), y[fresh]
        net.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=lambda k: _loss(z / k, w))
    return net


# ---- Spark


def _features(docs: DataFrame, shared) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("x", pa.binary())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column("doc_id"), "x": [pooled(t, shared.value).tobytes() for t in batch.column("text").to_pylist()]}

    return docs.mapInArrow(by_batch(run, schema), "doc_id bigint, x binary")


def train(docs: DataFrame, labels: DataFrame, vectors, most_labels: int = MOST_LABELS) -> Network:
    """docs: (doc_id, text); labels: (doc_id, label), each 0 or 1; vectors: broadcast word vectors."""
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    # At most most_labels rows of two numbers.
    rows = docs.join(F.broadcast(some.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    rows = _features(rows, vectors).join(F.broadcast(some), "doc_id").withColumn("fresh", F.pmod(F.xxhash64(F.lit("fresh"), "doc_id"), F.lit(5)) == 0).collect()
    rows.sort(key=lambda r: r.doc_id)  # here, since a sort in Spark would have features made twice
    x = np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, FEATURES)
    return fit(x, np.array([r.label for r in rows], float), np.array([r.fresh for r in rows], bool))


def quality_scores(docs: DataFrame, labels: DataFrame, most_labels: int = MOST_LABELS, folds: int = 5, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_text: bool = False, cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted. Labels of held-out documents (fold 0 of `folds`) are never learned.

    keep_text adds the row's struct of all input columns as `row`. Workers keep known words of at most
    cache_bytes for their next task.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = id_and_text(docs, id_col, text_col)
    vectors = spark.sparkContext.broadcast(word_vectors(rows, cache_bytes))
    learn = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("label")).where(crc_mod(F.col("doc_id"), folds) != 0)
    net = spark.sparkContext.broadcast(train(rows, learn, vectors, most_labels))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        _tokens.within(cache_bytes)
        for text in texts:
            x = np.array([pooled(t, vectors.value) for t in text], np.float32).reshape(-1, FEATURES)
            yield pd.Series(net.value.scores(x))
        give_back()

    every = docs.select(docs[id_col].cast("long").alias("doc_id"), score(docs[text_col].cast("string")).alias("score"), *([F.struct("*").alias("row")] if keep_text else []))
    held = F.coalesce(crc_mod(F.col("doc_id"), folds) == 0, F.lit(False))
    return every.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"), *(["row"] if keep_text else []))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
