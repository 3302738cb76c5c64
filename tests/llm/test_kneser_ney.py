"""The language model against counts in plain Python."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import kneser_ney as M
from tests.llm import tables


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def runs(t):
    """Each token with the two before it; None, 0 before the first."""
    return zip([None, 0, *t], [0, *t], t)  # noqa: B905


class Plain:
    def __init__(self, texts):
        train = [tokens(t) for t in texts]
        self.c = collections.Counter(w for t in train for w in t)
        every = collections.Counter(r for t in train for r in runs(t))
        self.run = {r: n for r, n in every.items() if r[0] is not None}
        self.pair = collections.Counter()
        for (u, v, w), n in every.items():
            self.pair[v, w] += n if u is None else 1
        self.cont = collections.Counter(w for _, w in self.pair)
        self.context = collections.defaultdict(lambda: [0, 0, 0, 0])
        for counts in (self.run, self.pair):
            for (*v, _), n in counts.items():
                self.context[tuple(v)][0] += n
                self.context[tuple(v)][min(n, 3)] += 1
        of = lambda counts: [sum(n == k for n in counts.values()) for k in (1, 2, 3, 4)]
        self.high, self.middle, self.low = (M.discounts(of(x)) for x in (self.run, self.pair, self.cont))
        self.all = sum(self.cont.values())
        self.spare = sum(self.low[min(n, 3)] for n in self.cont.values()) / self.all if self.all else 1.0

    def p(self, u, v, w):
        a = self.cont[w]
        out = (a - self.low[min(a, 3)] if a else 0) / max(self.all, 1) + self.spare / (len(self.c) + 1)
        for context, n, d in (((v,), self.pair.get((v, w), 0), self.middle), ((u, v), self.run.get((u, v, w), 0), self.high)):
            if context in self.context:
                total, *k = self.context[context]
                out = (n - d[min(n, 3)] if n else 0) / total + sum(x * y for x, y in zip(d[1:], k)) / total * out
        return out

    def score(self, t):
        return sum(math.log10(self.p(*r)) for r in runs(t))


def run(spark, rows):
    docs = tables.frame(spark, rows).select("doc_id", (M.fold_bucket(F.col("doc_id"), 7) == 2).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return docs, M.train(docs.where(~F.col("held_out")).select("text"))


@pytest.mark.parametrize("flush", [3_000_000, 300])
def test_equals_plain_counts(spark, monkeypatch, flush):
    monkeypatch.setattr(M, "FLUSH_TOKENS", flush)
    rows = tables.documents() + [(100 + i, tables.prose(30 + i, i, 60), "", "", 0) for i in range(40)]
    docs, model = run(spark, rows)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    plain = Plain([r[1] for r in rows if not held(r[0])])
    texts = collections.defaultdict(list)
    for r in rows:
        texts[r[0]].append(tokens(r[1]))
    got = M.score(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id) and r.train_tokens == sum(plain.c.values())
        fits = []
        for t in texts[r.doc_id]:
            base = sum(math.log10((plain.c[w] + 1) / (r.train_tokens + len(plain.c) + 1)) for w in t)
            score = plain.score(t)
            fits.append((r.n_tokens, r.n_known) == (len(t), sum(plain.c[w] > 0 for w in t)) and abs(base - r.base_score) < 1e-6 * (1 + abs(base)) and abs(score - r.score) < 1e-6 * (1 + abs(score)))
        assert any(fits), r


def test_probabilities_sum_to_one():
    texts = [tables.prose(60, i, 25) for i in range(8)]
    plain = Plain(texts)
    for u, v in [(None, 0), (0, "w3"), ("w3", "w7"), ("never", "w7"), ("w7", "never"), *(r[:2] for r in list(plain.run)[:20])]:
        assert abs(sum(plain.p(u, v, w) for w in plain.c) + plain.p(u, v, "unseen") - 1) < 1e-9


def test_frequent_contexts_are_dealt_by_pair(spark):
    rows = [(i, "the " + " the ".join(f"x{i}y{k}" for k in range(40)), "", "", 0) for i in range(50)]
    docs, model = run(spark, rows)
    assert len(model.hot.words) and np.array([1, 2, 3, 1]) @ model.hot_words.max(1) > 1000
    plain = Plain([r[1] for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2])
    for r in M.score(docs, model).collect():
        t = tokens(rows[r.doc_id][1])
        assert abs(r.score - plain.score(t)) < 1e-6


def test_empty_table_and_no_training_rows(spark):
    docs, model = run(spark, [])
    assert M.score(docs, model).count() == 0
    only = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    docs, model = run(spark, [(only, "a b", "", "", 0)])
    r = M.score(docs, model).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)


def test_discounts_stay_in_range():
    for n in ([0, 0, 0, 0], [5, 1, 1, 0], [100, 40, 20, 10], [1, 50, 1, 50]):
        d = M.discounts(n)
        assert d[0] == 0 and all(0 < x < k for k, x in enumerate(d[1:], 1)) and isinstance(d, np.ndarray)
