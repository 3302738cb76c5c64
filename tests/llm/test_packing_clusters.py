"""Near copies of different sources are one cluster: no bin holds two."""

from tessera.llm import packing as P
from tests.llm import tables


def test_near_copies_never_share_a_bin(spark):
    base = tables.prose(100, 1).split()
    rows = [(k, " ".join([*base[:50], f"edit{k}", *base[51:]]), "en", f"s{k}", 1) for k in range(6)]
    rows += [(10 + k, tables.prose(100, 20 + k), "en", f"t{k}", 1) for k in range(6)]
    got = [r.bin_id for r in P.pack(tables.frame(spark, rows), capacity=2048).collect() if r.doc_id < 10]
    assert len(got) == 6 and len(set(got)) == 6
