"""Suffix-array decontamination against a brute-force search for windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import decontaminate as D
from tests.llm import tables

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def brute(text, items, window=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for i, t in items:
        w = WORD.findall(lower(t))
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if k else ():
            for at in range(len(words) - k + 1):
                if words[at : at + k] == w[a : a + k]:
                    hit.update(range(at, at + k))
                    found.add(i)
    return len(words), len(hit), {str(i) for i in found if i is not None}


ITEMS = [(1, tables.prose(25, 1)), (2, "one TWO"), (3, None), (None, tables.prose(12, 3)), (4, ""), (5, "... !"), (6, tables.prose(14, 2)), (6, tables.prose(11, 4))]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 60}, {"shard_bytes": 200}])
def test_equals_brute_force(spark, options):
    docs = tables.frame(spark)
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = D.find_contamination(docs, bench, **options).collect()
    assert len(got) == len(tables.documents())
    for r in got:
        n, hit, items = brute(r.text, ITEMS)
        assert (r.n_words, r.n_hit, set(r["items"])) == (n, hit, items), r.doc_id
        assert r.contaminated == (hit > 0)


def test_random_texts_over_a_tiny_alphabet(spark):
    """Many repeats: deep ties in the suffix arrays."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))), "", "", 0) for i in range(60)]
    items = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 18)))) for i in range(12)]
    got = D.find_contamination(tables.frame(spark, rows), spark.createDataFrame(items, "item_id bigint, text string"), window=6).collect()
    for r in got:
        assert (r.n_words, r.n_hit, set(r["items"])) == brute(r.text, items, 6)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    tokens = np.append(rng.integers(1, 4, 300), 0)
    order = D.suffix_array(tokens, 400)
    suffixes = [tuple(tokens[i:]) for i in order]
    assert suffixes == sorted(suffixes)


def test_longest_match_and_its_place(spark):
    text = "x y " + tables.prose(25, 1) + " tail"
    got = D.find_contamination(tables.frame(spark, [(1, text, "", "", 0)]), spark.createDataFrame(ITEMS, "item_id bigint, text string")).first()
    assert (got.longest_words, got.longest_start, got.longest_item) == (25, 2, "1")
    assert [(s.start, s.end) for s in got.hit_spans] == [(2, 27)]


def test_empty_tables_and_clashing_columns(spark):
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert D.find_contamination(tables.frame(spark, []), bench).count() == 0
    assert D.find_contamination(tables.frame(spark), none).where("contaminated").count() == 0
    clash = tables.frame(spark, clash=True)
    kept = D.remove_contaminated(clash, bench)
    assert kept.columns == clash.columns
    assert {r.n_words for r in kept.collect()} == {"clash"}


def test_query_digest(spark):
    got = D.op1_decontaminate(spark, "/root/testdata/sf0.001").collect()
    assert {r.items_sha256 for r in got if r.n_items == 0} == {hashlib.sha256(b"").hexdigest()}
    assert any(r.contaminated for r in got) or all(r.n_hit == 0 for r in got)
