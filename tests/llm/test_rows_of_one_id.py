"""Rows that share an id are decided each by its own text."""

from tessera.llm import jaccard_join as J
from tests.llm import tables


def test_unlinked_texts_of_one_id_stay(spark):
    a, b, other = tables.prose(60, 1), tables.prose(60, 2), tables.prose(60, 3)
    near = " ".join(w if k != 30 else "changed" for k, w in enumerate(tables.prose(100, 4).split()))
    rows = [(7, a, "en", "s", 1), (7, b, "en", "s", 1), (7, a, "en", "s", 1), (3, other, "en", "s", 1), (7, other, "en", "s", 1), (9, b, "en", "s", 1), (5, tables.prose(100, 4), "en", "s", 1), (6, near, "en", "s", 1), (6, tables.prose(40, 8), "en", "s", 1), (None, a, "en", "s", 1), (11, "", "en", "s", 1), (11, None, "en", "s", 1)]
    got = sorted(((r.doc_id or 0, r.text or "") for r in J.remove_near_duplicates(tables.frame(spark, rows)).collect()))
    assert got == sorted([(7, a), (7, b), (3, other), (5, tables.prose(100, 4)), (6, tables.prose(40, 8)), (0, a), (11, "")])
