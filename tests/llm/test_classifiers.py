"""Quality and toxicity: held-out accuracy, folds, awkward rows."""

import random
import zlib

import pytest

from tessera.llm import quality as Q
from tessera.llm import toxicity as X
from tests.llm import tables

INSULTS = ["blurgh", "snorf", "grackle"]


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 160))]
        toxic, junk = i % 7 == 0, i % 5 == 1
        if toxic:
            for _ in range(rng.randrange(2, 7)):
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
        text = " ".join(f"{w.upper()}!!" for w in words) if junk else ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not junk), int(toxic)))
    return rows, labels


@pytest.mark.parametrize(("scores", "column"), [(Q.quality_scores, 1), (X.toxicity_scores, 2)])
def test_held_out_accuracy(spark, scores, column):
    rows, labels = corpus()
    got = {r.doc_id: r for r in scores(tables.frame(spark, rows), tables.labels(spark, labels)).collect()}
    held = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == {r[0] for r in held}
    assert sum(got[r[0]].predicted == r[column] for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("scores", [Q.quality_scores, X.toxicity_scores])
def test_labels_of_the_held_out_fold_do_not_matter(spark, scores):
    rows, labels = corpus(300)
    flipped = [(d, 1 - q, 1 - t) if zlib.crc32(str(d).encode()) % 5 == 0 else (d, q, t) for d, q, t in labels]
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in scores(tables.frame(spark, rows), tables.labels(spark, x)).collect()) for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("scores", [Q.quality_scores, X.toxicity_scores])
@pytest.mark.parametrize("labels", ["none", "one class", "usual"])
def test_awkward_rows(spark, scores, labels):
    known = {"none": [], "one class": [(i, 1, 0) for i in range(1, 9)], "usual": [(i, i % 2, i % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (2, 7, 7), (1, 1, 1)]}[labels]
    got = scores(tables.frame(spark, clash=True), tables.labels(spark, known)).collect()
    assert len(got) == len(tables.documents())
    assert all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)


@pytest.mark.parametrize("scores", [Q.quality_scores, X.toxicity_scores])
def test_empty_table(spark, scores):
    assert scores(tables.frame(spark, []), tables.labels(spark, [(1, 1, 0)])).count() == 0


def test_copies_of_one_toxic_text_do_not_make_its_words_toxic(spark):
    rows, labels = corpus(600)
    quirk = "zanzibar " + rows[7][1]  # toxic, by 7
    rows += [(5000 + i, quirk, "en", "s", 1) for i in range(60)] + [(7000, "zanzibar " + rows[3][1], "en", "s", 1)]
    labels += [(5000 + i, 1, 1) for i in range(60)]
    got = {r.doc_id: r.predicted for r in X.toxicity_scores(tables.frame(spark, rows), tables.labels(spark, labels)).collect()}
    assert got[5001] == 1 and got[7000] == 0


def test_label_model_finds_accuracies_and_correlations():
    import numpy as np

    rng = np.random.default_rng(1)
    y = rng.random(20000) < 0.2
    votes = np.stack([np.where(rng.random(20000) < (0.9 if k < 9 else 0.7), y, rng.random(20000) < 0.05) for k in range(12)], 1).astype(bool)
    votes[:, 11] = votes[:, 10]  # two voters that are one
    mask, rows = np.unique((votes << np.arange(12)).sum(1), return_counts=True)
    model = X.LabelModel(mask, rows)
    assert abs(model.share - 0.2) < 0.03
    assert model.rate[1][0] > model.rate[1][10] > model.rate[0][10]
    assert model.correlation[10, 11] > 0.9 and model.weight[11] < 1
    assert ((model.posterior((votes << np.arange(12)).sum(1)) > 0.5) == y).mean() > 0.98


def test_remove_toxic_keeps_columns_and_clean_rows(spark):
    rows, labels = corpus(400)
    df = tables.frame(spark, rows, clash=True)
    kept = X.remove_toxic(df, tables.labels(spark, labels))
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & {r[0] for r in labels if not r[2]}) == sum(not r[2] for r in labels)
    assert len(ids & {r[0] for r in labels if r[2]}) <= 3
