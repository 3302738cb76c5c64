"""The similarity join against the comparison of all pairs."""

import random
import re

from tessera.llm import jaccard_join as J
from tests.llm import tables


def brute_force(rows, width=5, at_least=75, per=100):
    """doc_id -> (size, component) by comparing all pairs of distinct sets: for small tables in tests."""
    sets = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[doc] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    holders: dict = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)
    pairs: dict = {}
    for who in holders.values():
        for i, a in enumerate(who):
            for b in who[i + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        if per * n >= at_least * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def result(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10_000)}"
    return words


def clustered(seed, groups=12, size=9):
    """Groups of near copies at all distances, chains among them, and passages that many groups share."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows, k = [], 0
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.randrange(20, 90))]
        if g % 2:
            at = rng.randrange(len(base))
            base[at:at] = passage
        words = base
        for _ in range(rng.randrange(1, size)):
            k += 1
            rows.append((k, " ".join(words), "", "", 0))
            words = edited(rng, rng.choice([base, words]), rng.randrange(0, 3))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force_on_clusters(spark):
    for seed in range(3):
        rows = clustered(seed)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicate_components(tables.frame(spark, rows)).collect()}
        assert got == brute_force((r[0], r[1]) for r in rows)


def test_large_groups_of_near_and_exact_copies(spark):
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(edited(rng, base, i % 3)), "", "", 0) for i in range(1, 200)]
    rows += [(1000 + i, tables.prose(40, 77), "", "", 0) for i in range(150)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicate_components(tables.frame(spark, rows)).collect()}
    assert got == brute_force((r[0], r[1]) for r in rows)


def test_short_texts_and_other_thresholds(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["a", "b", "c"]) for _ in range(rng.randrange(0, 9))), "", "", 0) for i in range(80)]
    for at_least, width in ((75, 5), (50, 2), (90, 1)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicate_components(tables.frame(spark, rows), at_least=at_least, width=width).collect()}
        assert got == brute_force(((r[0], r[1]) for r in rows), width, at_least)


def test_awkward_rows(spark):
    got = result(J.near_duplicate_components(tables.frame(spark, clash=True)))
    assert len(got) == len(tables.documents())
    by = {d: c for d, _, c in got if d >= 0}
    assert by[1] == by[2] == by[3] == 1  # one changed word of 80 leaves 71 of 81 shingles
    assert by[6] == by[7] == 6
    assert [c for d, n, c in got if d == 4] == [4] and [c for d, n, c in got if d == 5] == [5]
    assert [c for d, _, c in got if d == 10] == [10, 10]


def test_empty_table(spark):
    assert J.near_duplicate_components(tables.frame(spark, [])).count() == 0
    assert J.remove_near_duplicates(tables.frame(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = clustered(4)
    brute = brute_force((r[0], r[1]) for r in rows)
    kept = sorted(r.doc_id for r in J.remove_near_duplicates(tables.frame(spark, rows)).collect())
    assert kept == sorted({c for _, c in brute.values()})
    awkward = J.remove_near_duplicates(tables.frame(spark, clash=True))
    assert awkward.columns == tables.frame(spark, clash=True).columns
    assert sum(r.doc_id == 10 for r in awkward.collect()) == 1


def test_hot_shingles_in_parts(spark, monkeypatch):
    """Every shingle of many sets counts as hot: parts, pairs of parts and witnesses give the same links."""
    monkeypatch.setattr(J, "HOT_SETS", 6)
    monkeypatch.setattr(J, "FLUSH_TOKENS", 400)
    for seed in (0, 7):
        rows = clustered(seed, 14, 30)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicate_components(tables.frame(spark, rows)).collect()}
        assert got == brute_force((r[0], r[1]) for r in rows)


def test_no_bucket_holds_a_hot_shingle(spark, monkeypatch):
    """A third of all sets share their shingles: neither the screen's buckets nor the lists grow with them."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(J, "HOT_SETS", 100)
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 60, np.uint64)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 10, np.uint64)]) if k % 3 == 0 else rng.integers(0, 1 << 63, 70, np.uint64)) for k in range(3000)]
    fp, tokens, counts = np.arange(3000), np.concatenate(sets), np.array([len(x) for x in sets])
    dealer = J.Dealer(16, J.LOCAL)
    dealer.add(fp, tokens, counts)
    table = pa.Table.from_batches(list(dealer.flush()))
    sizes = np.array([len(x) // 4 for x in table["low"].to_pylist()])
    assert sizes.sum() < len(tokens) - 1000 * 60 + 100 and sizes.max() < 1.3 * sizes.mean()
    found = J._add_shared(J._count_shared(1)(table)).to_pandas().set_index("fp").shared
    assert sorted(found.index) == list(range(0, 3000, 3)) and set(found) == {60}
    df = spark.createDataFrame([(int(f), x.tobytes()) for f, x in zip(fp, sets)], "fp bigint, tokens binary").repartition(3)
    token, _ = J.hot_tokens(df, len(tokens))
    assert set(token.tolist()) == set(shared.tolist())
    names = np.sort(J._named(token, 16))
    hot = spark.sparkContext.broadcast((names, np.full(len(names), 8)))
    # the lists know tokens by their names in the index
    named = [(int(f), J._named(x, 16).tobytes()) for f, x in zip(fp, sets)]
    lists = spark.createDataFrame(named, "fp bigint, tokens binary").selectExpr("fp", "70L n", "0D central", "tokens", "tokens prefix", "fp label", "fp pivot")
    dealt = lists.mapInArrow(J._deal_prefixes(64, hot, 0), "bucket int, entries binary").selectExpr("bucket", "length(entries) size")
    per = [r[0] for r in dealt.groupBy("bucket").sum("size").select("sum(size)").collect()]
    assert max(per) < 1.6 * sum(per) / len(per)
