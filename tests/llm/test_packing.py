"""Best-fit packing: against a plain search over all open bins, and its guarantees."""

import random
import re
from collections import defaultdict

import pytest

from tessera.llm import packing as P
from tests.llm import tables


def plain(doc, length, source, cluster, capacity):
    """Best fit by looking at every open bin: residual of the bin chosen for each piece, in order."""
    pieces = [(min(capacity, n - at), row, k) for row, n in enumerate(length) for k, at in enumerate(range(0, n, capacity))]
    pieces.sort(key=lambda p: (-p[0], str(cluster[p[1]]), str(doc[p[1]]), p[1], p[2]))
    bins, chosen = [], []
    for n, row, _ in pieces:
        s, c = source[row], cluster[row]
        fit = [b for b in bins if b[0] >= n and (s is None or s not in b[1]) and (c is None or c not in b[2])]
        best = min((b[0] for b in fit), default=None)
        chosen.append(best)
        b = next((b for b in fit if b[0] == best), None)
        if b is None:
            b = [capacity, set(), set()]
            bins.append(b)
        b[0] -= n
        b[1].add(s)
        b[2].add(c)
    return pieces, chosen, len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_every_piece_takes_the_tightest_compatible_bin(seed):
    """Ties between bins of one residual may fall either way, so each step is checked on its own state."""
    rng = random.Random(seed)
    n, capacity = 200, 40
    length = [rng.choice([0, 3, 7, 11, 19, 40, 55, 90]) for _ in range(n)]
    source = [rng.choice(["hot", "hot", "a", "b", "c", "d", None]) for _ in range(n)]
    cluster = [rng.choice([None, 1, 2, 3, *range(100, 160)]) for _ in range(n)]
    bins = {}
    for row, _, size, b, offset in P.pack_shard(list(range(n)), length, source, cluster, capacity):
        s, c = source[row], cluster[row]
        fit = [x for x in bins.values() if x[0] >= size and (s is None or s not in x[1]) and (c is None or c not in x[2])]
        tightest = min((x[0] for x in fit), default=capacity)
        assert (bins[b][0] if b in bins else capacity) == tightest and (b in bins) == bool(fit)
        x = bins.setdefault(b, [capacity, set(), set()])
        assert offset == capacity - x[0]
        x[0] -= size
        x[1].add(s)
        x[2].add(c)
    assert sum(capacity - x[0] for x in bins.values()) == sum(length)
    assert abs(len(bins) - plain(list(range(n)), length, source, cluster, capacity)[2]) <= 0.05 * len(bins) + 2


def test_whole_table(spark):
    rng = random.Random(3)
    rows = [(i, tables.prose(rng.randrange(1, 300), i % 40), "en", f"s{rng.randrange(4)}", 0) for i in range(500)]
    got = P.pack(tables.frame(spark, rows), capacity=128, shard_rows=120).collect()
    bins, of = defaultdict(list), {r[0]: r for r in rows}
    for r in got:
        bins[r.bin_id].append(r)
    for held in bins.values():
        assert sum(r.n_tokens for r in held) <= 128
        assert len({of[r.doc_id][3] for r in held}) == len(held)
        spans = sorted((r.bin_offset, r.bin_offset + r.n_tokens) for r in held)
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    total = defaultdict(int)
    for r in got:
        total[r.doc_id] += r.n_tokens
    assert total == {r[0]: len(r[1].split()) for r in rows}


def test_awkward_rows_and_empty_table(spark):
    got = P.pack(tables.frame(spark, clash=True), capacity=2048).collect()
    assert sum(r.n_tokens for r in got) == sum(len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for _, t, *_ in tables.documents())
    assert {r.doc_id for r in got if r.bin_id is None} >= {4, 5, 9}
    assert P.pack(tables.frame(spark, [])).count() == 0


def test_rows_repeated_without_an_id_share_no_shard(spark):
    """60,000 rows alike in all that is packed: dealt evenly, not to one shard."""
    same = spark.range(60_000).selectExpr("cast(null as bigint) doc_id", "5L n_tokens", "'hot' source", "cast(null as bigint) cluster")
    other = spark.range(3_000).selectExpr("id doc_id", "7L n_tokens", "'a' source", "id cluster")
    sizes = [r["count"] for r in P.dealt(same.union(other), 7_000).groupBy("shard").count().collect()]
    assert len(sizes) == 9 and max(sizes) < 1.1 * 63_000 / 9


def test_the_query_packs_every_shard_by_best_fit(spark):
    """The registered query's rows, shard by shard, are those of the step-by-step search over plain bins."""
    from tests.llm.test_jaccard_join import brute_force

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    group = brute_force((r.doc_id, r.text) for r in docs)
    of = {r.doc_id: r for r in docs}
    got = P.op4_pack(spark, "/root/testdata/sf0.001").collect()
    assert len({r.bin_id.split(":")[0] for r in got if r.bin_id}) == 1
    bins = {}
    order = lambda r: (-r.n_tokens, int(r.bin_id.split(":")[1]), r.bin_offset)
    for r in sorted((r for r in got if r.bin_id), key=order):
        held = bins.setdefault(r.bin_id, [0, set(), set()])
        assert r.n_tokens <= P.CAPACITY - held[0] or r.bin_offset < held[0]
        s, c = of[r.doc_id].source, group[r.doc_id][1]
        assert s is None or s not in held[1]
        assert c not in held[2]
        held[0] += r.n_tokens
        held[1].add(s)
        held[2].add(c)
    assert all(h[0] <= P.CAPACITY for h in bins.values())
    doc = [r.doc_id for r in docs]
    source, cluster = [r.source for r in docs], [group[d][1] for d in doc]
    length = [len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in docs]
    assert abs(len(bins) - plain(doc, length, source, cluster, P.CAPACITY)[2]) <= 0.05 * len(bins) + 2
