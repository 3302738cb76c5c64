"""Toxicity by weak supervision.

1. *Lexicon.* From a bounded sample of labelled training rows (``FIT_ROWS``) the words and word
   beginnings far more frequent in toxic texts are learned.
2. *Voters.* Twelve voters look at the hits of every text: strong words, word and prefix patterns,
   parts of the lexicon, density, variety, neighbouring hits. Each votes toxic or not.
3. *Label model.* The vote patterns of ALL documents are counted (at most 2^12 of them); expectation
   maximisation over the counts estimates every voter's accuracy in both classes, and voters that
   agree more than their accuracies explain (correlations) share their weight.
4. *Classifier.* A linear (logistic) model is trained on the posterior labels, over the votes and
   counts, and scores every document.

Defined results: null text counts as empty, and has no hits. Labels that are null, or not 0 or 1, are
ignored; without toxic training rows the lexicon is empty and all scores are alike and below 0.5.
Repeated document rows are scored each; the classifier sees one row of an id (the least votes and counts).
A null id is never labelled and hashes as the empty text. Other columns are not carried, whatever their
names (``remove_toxic`` keeps them all); very long texts are read whole, an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import fold_bucket, read, written

#: Labelled rows that the lexicon and the linear classifier are fitted on, about.
FIT_ROWS = 40_000
#: Toxic rows with an entry, log odds, and log-likelihood ratio against chance (2 ln 1/p, about) that it needs:
#: the best of three settings on rows of crc32 fold 1, which trains otherwise, fitted without that fold.
LEAST_ROWS, LEAST_ODDS, LEAST_RATIO = 3, 3.5, 16.0
PREFIXES = (4, 5, 6)
VOTERS = ["strong", "two_words", "prefix4", "prefix5", "two_prefixes", "part0", "part1", "part2", "dense", "varied", "close", "heavy"]
CUT = 0.5


def entries(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each word (whole, then prefixes), its kind, its text and place among that text's words."""
    starts, ends, begin = K.word_bounds(buf, off, K.LETTER_WORD)
    owner = np.repeat(np.arange(len(off) - 1), np.diff(begin))
    place = np.arange(len(starts)) - begin[:-1][owner]
    keys, kinds, owners, places = [K.hash_spans(buf, starts, ends)], [np.zeros(len(starts), np.int8)], [owner], [place]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        keys.append(K.hash_spans(buf, starts[long], starts[long] + n) ^ K.U64(0x1234567 * n))
        kinds.append(np.full(len(long), n, np.int8))
        owners.append(owner[long])
        places.append(place[long])
    return tuple(np.concatenate(x) for x in (keys, kinds, owners, places)) + (np.diff(begin),)


def _signature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest 5-word shingle hash of each text: copies and near copies mostly share it."""
    for table, buf, off in K.chunks(batches, "text"):
        tokens, begin = K.shingle_sets(*K.words(buf, off, K.SPACE_WORD), 5)
        least = [int(tokens[b]) if e > b else 0 for b, e in zip(begin[:-1], begin[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), table["y"].combine_chunks(), pa.array(np.array(least, np.uint64).view(np.int64))], names=["doc_id", "y", "sig"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of either class with each key, summed over the partition."""
    held: list[np.ndarray] = []
    limit = 600_000

    def summed():
        both = np.concatenate(held) if held else np.zeros((0, 4), np.int64)
        order = np.argsort(both[:, 0], kind="stable")
        both = both[order]
        at = np.flatnonzero(np.concatenate([[True], both[1:, 0] != both[:-1, 0]])) if len(both) else np.zeros(0, int)
        return np.column_stack([both[at, 0], both[at, 1], np.add.reduceat(both[:, 2], at), np.add.reduceat(both[:, 3], at)]) if len(at) else both

    for table, buf, off in K.chunks(batches, "text"):
        keys, kinds, owner, _, _ = entries(buf, off)
        y = table["y"].to_numpy()[owner]
        order = np.lexsort((owner, keys))
        keys, kinds, owner, y = keys[order], kinds[order], owner[order], y[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
        held.append(np.column_stack([keys[new].view(np.int64), kinds[new], y[new] == 0, y[new] == 1]).astype(np.int64))
        if sum(map(len, held)) > limit:
            held = [summed()]
            limit = max(limit, 2 * len(held[0]))
    rows = summed()
    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], names=["key", "kind", "c0", "c1"])


class Lexicon:
    def __init__(self, rows: list[tuple[int, int, float]]):
        rows = sorted(rows)
        self.keys = np.array([r[0] for r in rows], np.int64)
        self.kinds = np.array([r[1] for r in rows], np.int8)
        self.odds = np.array([r[2] for r in rows], float)

    def measure(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Votes (texts x voters) and the counts that the classifier sees beside them."""
        docs = len(off) - 1
        keys, kinds, owner, place, n_words = entries(buf, off)
        if len(self.keys):
            slot = np.minimum(np.searchsorted(self.keys, keys.view(np.int64)), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[slot] == keys.view(np.int64))
        else:
            slot, hit = np.zeros(len(keys), int), np.zeros(0, int)
        slot, kind, owner, place = slot[hit], kinds[hit], owner[hit], place[hit]
        odds = self.odds[slot] if len(hit) else np.zeros(0)
        count = lambda mask: np.bincount(owner[mask], minlength=docs)
        # one hit for each word, its strongest
        order = np.lexsort((-odds, place, owner))
        o, p = owner[order], place[order]
        lead = np.ones(len(o), bool)
        lead[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1])
        o, p, w, s = o[lead], p[lead], odds[order][lead], slot[order][lead]
        hits = np.bincount(o, minlength=docs)
        weight = np.bincount(o, w, docs)
        different = np.unique(o.astype(np.int64) * (len(self.keys) + 1) + s)
        varied = np.bincount(different // (len(self.keys) + 1), minlength=docs)
        near = np.zeros(len(o), bool)
        near[1:] = (o[1:] == o[:-1]) & (p[1:] - p[:-1] <= 12)
        close = np.bincount(o[near], minlength=docs)
        prefixes = count(kind > 0)
        votes = np.stack([
            count((kind == 0) & (odds >= LEAST_ODDS + 1.5)) > 0, count(kind == 0) > 1, count(kind == PREFIXES[0]) > 0, count(kind == PREFIXES[1]) > 0, prefixes > 1,
            *(np.bincount(o[s % 3 == k], minlength=docs) > 0 for k in range(3)), hits * 150 >= np.maximum(n_words, 1), varied > 1, close > 0, weight >= 12,
        ], 1)
        votes[:, 8] &= hits > 0
        counts = np.stack([np.log1p(hits), np.log1p(varied), np.log1p(weight), np.log1p(prefixes), np.log1p(1000 * hits / np.maximum(n_words, 50)), np.log1p(close)], 1)
        return votes, counts


COUNTS = 6


def _measure(lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buf, off in K.chunks(batches, "text"):
            votes, counts = lexicon.value.measure(buf, off)
            mask = (votes << np.arange(len(VOTERS))).sum(1).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, counts.size + 1, COUNTS, dtype=np.int32)), pa.array(counts.ravel()))
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().cast(pa.int64()), pa.array(mask), flat], names=["doc_id", "votes", "counts"])

    return run


def spread(mask: np.ndarray) -> np.ndarray:
    return ((mask[:, None] >> np.arange(len(VOTERS))) & 1).astype(float)


class LabelModel:
    """Two hidden classes; each voter's rate in either; weights shared among correlated voters."""

    def __init__(self, patterns: np.ndarray, rows: np.ndarray, rounds: int = 60):
        v, n = spread(patterns), rows.astype(float)
        m = v.shape[1]
        self.weight = np.ones(m)
        post = np.clip(v.mean(1), 0.02, 0.98) ** 1.0
        post = np.where(v.sum(1) >= m / 2, post, post * 0.3)
        for step in range(rounds):
            self.share = np.clip((n * post).sum() / max(n.sum(), 1), 1e-4, 0.5)
            self.rate = np.stack([np.clip(((n * q) @ v + 0.5 * q0) / ((n * q).sum() + 1), 1e-4, 1 - 1e-4) for q, q0 in ((1 - post, 0.1), (post, 1.5))])
            if step % 5 == 4:  # agreement beyond what the classes explain
                cov = np.zeros((m, m))
                for q, r in ((1 - post, self.rate[0]), (post, self.rate[1])):
                    d = v - r
                    cov += (d * (n * q)[:, None]).T @ d
                scale = np.sqrt(np.maximum(np.diag(cov), 1e-9))
                self.correlation = cov / np.outer(scale, scale)
                self.weight = 1 / np.maximum(1, np.abs(self.correlation).sum(1) / 2)
            post = self.posterior(patterns)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        v = spread(patterns)
        log = [np.log(s) + (v * np.log(r) + (1 - v) * np.log(1 - r)) @ self.weight for s, r in ((1 - self.share, self.rate[0]), (self.share, self.rate[1]))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def design(mask: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate([spread(mask), counts, np.ones((len(mask), 1))], 1)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    w[-1] = -1.0
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - penalty * w
        w = w + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad), -2, 2)
    return w


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = design(b.column("votes").to_numpy(zero_copy_only=False), b.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, COUNTS))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(x @ weights.value, -500, 500))))], names=["doc_id", "score"])

    return run


def _measured(docs: DataFrame, labels: DataFrame, folds: int, fit_rows: int):
    """Votes and counts of every document, the weights of the linear classifier, and the lexicon (sent)."""
    spark = docs.sparkSession
    held = lambda: fold_bucket(F.col("doc_id"), folds) == 0
    known = labels.where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held())
    n = known.count()
    share = min(1.0, fit_rows / max(n, 1))
    # a bounded number of ids: small enough to be sent to every task whatever the corpus
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)
    sample = written(known.where(drawn).groupBy("doc_id").agg(F.max("y").alias("y")))
    known_texts = lambda ids: docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("y").cast("int").alias("y"))
    # a group of copies speaks once: else every word of a copied toxic text would look toxic
    signed = known_texts(sample).mapInArrow(_signature, "doc_id bigint, y int, sig bigint")
    sample = written(signed.groupBy("sig", "y").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "y"))
    texts = known_texts(sample)
    size = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = size.get(0, 0), size.get(1, 0)
    odds = F.log((F.col("c1") + 0.5) / (n1 + 1)) - F.log((F.col("c0") + 0.5) / (n0 + 1))
    both, chance = F.col("c0") + F.col("c1"), n1 / max(n0 + n1, 1)
    side = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * max(p, 1e-9)))).otherwise(0.0)
    ratio = 2 * (side("c1", chance) + side("c0", 1 - chance))
    counted = texts.mapInArrow(_count, "key bigint, kind bigint, c0 bigint, c1 bigint").groupBy("key", "kind")
    counted = counted.agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).where(F.col("c1") >= LEAST_ROWS)
    best = counted.select("key", "kind", odds.alias("odds"), ratio.alias("ratio"))
    best = best.where((F.col("odds") >= LEAST_ODDS) & (F.col("ratio") >= LEAST_RATIO)).select("key", "kind", "odds")
    lexicon = spark.sparkContext.broadcast(Lexicon([tuple(r) for r in best.collect()] if n1 else []))
    measured = written(docs.mapInArrow(_measure(lexicon), "doc_id bigint, votes int, counts array<double>"))
    patterns = measured.groupBy("votes").count().orderBy("votes").collect()
    mask = np.array([r["votes"] for r in patterns], np.int64)
    model = LabelModel(mask, np.array([r["count"] for r in patterns], np.int64))
    # a row for each id of the bounded sample, whatever the number of rows that carry it
    fitted = measured.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.struct("votes", "counts")).alias("m"))
    fitted = fitted.orderBy("doc_id").select("m.votes", "m.counts").toArrow()
    weights = np.zeros(len(VOTERS) + COUNTS + 1)
    weights[-1] = -1.0
    if fitted.num_rows and n1:
        votes = fitted["votes"].to_numpy()
        weights = fit_linear(design(votes, np.stack(fitted["counts"].to_numpy())), model.posterior(votes))
    return measured, weights, lexicon


def toxicity_scores(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of fold 0 never train."""
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    measured, weights, _ = _measured(docs, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")), folds, fit_rows)
    scored = measured.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(weights)), "doc_id bigint, score double")
    return scored.select("doc_id", (fold_bucket(F.col("doc_id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def _clean(lexicon, weights, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buf, off in K.chunks(batches, text):
            votes, counts = lexicon.value.measure(buf, off)
            x = design((votes << np.arange(len(VOTERS))).sum(1), counts)
            yield from table.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ weights.value, -500, 500))) < CUT)).to_batches()

    return run


def remove_toxic(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns; rows are judged where they lie."""
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    _, weights, lexicon = _measured(own, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")), folds, fit_rows)
    return docs.mapInArrow(_clean(lexicon, docs.sparkSession.sparkContext.broadcast(weights), text), docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE = {}
