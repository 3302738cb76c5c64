"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Statistics of whole texts (vectorised, one pass) are put through variance-steadying transforms. Class
means and covariances are summed in Spark over all labelled training rows (each partition returns one
small matrix per class), shrunk towards their diagonal and a sphere, and factored once (Cholesky). The
difference of the Mahalanobis log densities, put on a log scale, is calibrated by a logistic curve that
is fitted to its histogram over the training rows; that gives the score.

Defined results: null text counts as empty and is scored like any other. Labels that are null, or not
0 or 1, are ignored; repeated label rows count as often as they stand. If a class has fewer than two
training rows, every score is the share of 1 among them (0.5 if there are none). Repeated document
rows are scored each; a null id is never labelled and hashes as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import fold_bucket, read, written

FEATURES = [
    "log_words", "word_length", "upper", "digit", "symbol", "exclaim", "pipe", "newline", "wide",
    "tripled", "distinct", "top_word", "distinct_pairs", "bare_words", "repeated_lines", "long_words", "stops", "upper_words",
]
#: Weights of the diagonal and of the sphere in the shrunk covariances.
DIAGONAL, SPHERE = 0.2, 0.02
KEEP_AT = 0.3


def _classes() -> np.ndarray:
    b = np.arange(256)
    upper, lower, digit = (b >= 65) & (b <= 90), (b >= 97) & (b <= 122), (b >= 48) & (b <= 57)
    blank = ~K.SPACE_WORD
    symbol = (b < 128) & ~upper & ~lower & ~digit & ~blank & ~np.isin(b, [44, 46, 39, 45])
    return np.stack([upper, digit, symbol, b == 33, b == 124, b == 10, b >= 128, np.isin(b, [33, 46, 63])])


CLASSES = _classes()


def _per_doc(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (total[off[1:]] - total[off[:-1]]).astype(float)


def _runs_of(owner: np.ndarray, value: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: distinct values and the count of its most frequent one."""
    order = np.lexsort((value, owner))
    o, v = owner[order], value[order]
    if not len(o):
        return np.zeros(docs), np.zeros(docs)
    at = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])]))
    size = np.diff(np.append(at, len(o)))
    top = np.zeros(docs)
    np.maximum.at(top, o[at], size)
    return np.bincount(o[at], minlength=docs).astype(float), top


def document_features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    docs = len(off) - 1
    n_bytes = np.maximum(np.diff(off), 1).astype(float)
    starts, ends, begin = K.word_bounds(buf, off, K.SPACE_WORD)
    hashes = K.hash_spans(buf, starts, ends)
    n_words = np.diff(begin).astype(float)
    some = np.maximum(n_words, 1)
    owner = np.repeat(np.arange(docs), np.diff(begin))
    length = (ends - starts).astype(float)
    share = {k: _per_doc(CLASSES[i][buf], off) / n_bytes for i, k in enumerate(["upper", "digit", "symbol", "exclaim", "pipe", "newline", "wide", "stop"])}
    tripled = np.zeros(len(buf), bool)
    if len(buf) > 2:
        tripled[2:] = (buf[2:] == buf[1:-1]) & (buf[2:] == buf[:-2]) & (buf[2:] != 32)
    letters = np.concatenate([[0], np.cumsum(K.LETTER_WORD[buf])])
    uppers = np.concatenate([[0], np.cumsum(CLASSES[0][buf])])
    bare = letters[ends] == letters[starts]
    shout = (uppers[ends] - uppers[starts] >= 2) & (2 * (uppers[ends] - uppers[starts]) > ends - starts)
    distinct, top = _runs_of(owner, hashes, docs)
    inner = np.ones(len(hashes), bool)
    inner[begin[1:][np.diff(begin) > 0] - 1] = False
    first = np.flatnonzero(inner)
    pairs, _ = _runs_of(owner[first], K.roll(hashes, 2)[first] if len(first) else np.zeros(0, K.U64), docs)
    line_starts, line_ends, line_begin = K.word_bounds(buf, off, np.arange(256) != 10)
    lines = np.diff(line_begin).astype(float)
    same, _ = _runs_of(np.repeat(np.arange(docs), np.diff(line_begin)), K.hash_spans(buf, line_starts, line_ends), docs)
    by_doc = lambda x: np.bincount(owner, x, docs) / some
    root = lambda x: np.arcsin(np.sqrt(np.clip(x, 0, 1)))
    columns = [
        np.log1p(n_words), np.log1p(by_doc(length)), root(share["upper"]), root(share["digit"]), root(share["symbol"]), root(share["exclaim"]), root(share["pipe"]),
        root(share["newline"]), root(share["wide"]), root(_per_doc(tripled, off) / n_bytes), np.log1p(distinct) / np.log1p(some), root(top / some),
        root(pairs / np.maximum(n_words - 1, 1)), root(by_doc(bare)), root(1 - same / np.maximum(lines, 1)), root(by_doc(length > 24)), root(share["stop"]), root(by_doc(shout)),
    ]
    return np.stack(columns, 1)


def _list_array(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _features(doc_id: str, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buf, off in K.chunks(batches, text):
            yield pa.RecordBatch.from_arrays([table[doc_id].combine_chunks().cast(pa.int64()), _list_array(document_features(buf, off))], names=["doc_id", "x"])

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per class of the partition: rows, sums and sums of products."""
    d = len(FEATURES)
    held = {0: [0, np.zeros(d), np.zeros((d, d))], 1: [0, np.zeros(d), np.zeros((d, d))]}
    for b in batches:
        x, y = _matrix(b.column("x"), d), b.column("y").to_numpy(zero_copy_only=False)
        for k, s in held.items():
            own = x[y == k]
            s[0] += len(own)
            s[1] += own.sum(0)
            s[2] += own.T @ own
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([held[k][0] for k in (0, 1)], pa.int64()), _list_array(np.stack([held[k][1] for k in (0, 1)])), _list_array(np.stack([held[k][2].ravel() for k in (0, 1)]))], names=["y", "n", "s", "p"])


class Discriminant:
    """Class means with the inverse Cholesky factors of their shrunk covariances."""

    def __init__(self, stats: dict[int, tuple[int, np.ndarray, np.ndarray]], diagonal: float = DIAGONAL, sphere: float = SPHERE):
        n = {k: stats[k][0] for k in (0, 1)}
        total = sum(n.values())
        self.prior, self.parts = n[1] / total if total else 0.5, None
        if min(n.values()) < 2:
            return
        mean = {k: stats[k][1] / n[k] for k in n}
        cov = {k: (stats[k][2] - n[k] * np.outer(mean[k], mean[k])) / (n[k] - 1) for k in n}
        pooled = sum(n[k] * cov[k] for k in n) / total + self.prior * (1 - self.prior) * np.outer(mean[1] - mean[0], mean[1] - mean[0])
        self.scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        self.parts = {}
        for k in n:
            s = cov[k] / np.outer(self.scale, self.scale)
            s = (1 - diagonal - sphere) * s + diagonal * np.diag(np.diag(s)) + sphere * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.parts[k] = mean[k], np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + np.log(n[k] / total)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density of class 1 less that of class 0, on a signed log scale."""
        if self.parts is None:
            return np.zeros(len(x))
        log = {}
        for k, (mean, inverse, constant) in self.parts.items():
            z = ((x - mean) / self.scale) @ inverse.T
            log[k] = constant - 0.5 * (z * z).sum(1)
        return np.sign(log[1] - log[0]) * np.log1p(np.abs(log[1] - log[0]))

    def calibrate(self, histogram: list[tuple[float, int, int]]):
        """Fit the logistic curve to (difference, y, rows) by a few ridge-steadied Newton steps."""
        self.curve = np.array([0.0, 0.0 if not 0 < self.prior < 1 else np.log(self.prior / (1 - self.prior))])
        if self.parts is None or not histogram:
            return
        t, y, n = (np.array(c, float) for c in zip(*histogram, strict=True))
        design = np.stack([t, np.ones(len(t))], 1)
        self.curve[0] = 1.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(design @ self.curve, -30, 30)))
            step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-2]), design.T @ (n * (y - p)) - 1e-2 * self.curve)
            self.curve += np.clip(step, -1, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.parts is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] * self.difference(x) + self.curve[1], -500, 500)))


def _score(model, what: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(getattr(model.value, what)(_matrix(b.column("x"), len(FEATURES))))], names=["doc_id", "score"])

    return run


def _bins(model):
    """Rows of the partition by difference, in steps of 1/20, and class: a few hundred at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            t = np.round(model.value.difference(_matrix(b.column("x"), len(FEATURES))) * 20) / 20
            for key in zip(t.tolist(), b.column("y").to_pylist(), strict=True):
                held[key] = held.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.float64()), pa.array([k[1] for k in held], pa.int32()), pa.array(list(held.values()), pa.int64())], names=["t", "y", "n"])

    return run


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """``labels``: doc_id, y."""
    d = len(FEATURES)
    stats = {k: [0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
    for r in features.join(labels, "doc_id").select("x", F.col("y").cast("int").alias("y")).mapInArrow(_sums, "y int, n bigint, s array<double>, p array<double>").toLocalIterator():
        s = stats[r["y"]]
        s[0] += r["n"]
        s[1] += np.array(r["s"])
        s[2] += np.array(r["p"]).reshape(d, d)
    model = Discriminant({k: tuple(v) for k, v in stats.items()})
    sent = features.sparkSession.sparkContext.broadcast(model)
    bins = features.join(labels, "doc_id").select("doc_id", "x", "y").mapInArrow(_bins(sent), "t double, y int, n bigint").groupBy("t", "y").agg(F.sum("n").alias("n")).orderBy("t", "y")
    model.calibrate([tuple(r) for r in bins.toLocalIterator()])
    return model


def quality_scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of fold 0 never train."""
    features = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_features("doc_id", "text"), "doc_id bigint, x array<double>"))
    held = fold_bucket(F.col("doc_id"), folds) == 0
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    model = docs.sparkSession.sparkContext.broadcast(fit(features, known))
    scored = features.mapInArrow(_score(model, "score"), "doc_id bigint, score double")
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op2_quality": op2_quality}
ORACLE = {}
