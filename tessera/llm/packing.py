"""Conflict-constrained best-fit packing of documents into fixed-size bins.

Documents (pieces of at most ``capacity`` tokens) are dealt by hash to shards of about ``SHARD_ROWS``
rows, so that a hot source or a large duplicate cluster is spread over all shards (rows that are repeated
very often are dealt by their place as well); each shard is packed by itself, longest pieces first. Open bins are ordered by residual. A bin carries a bitmap of the sources
and one of the duplicate clusters in it; a piece takes the tightest bin that fits and holds neither its
source nor its cluster. The successor search starts at the piece's length and goes on to the next larger
residual until such a bin is found; if none is, a bin is opened. Bins of equal residual and source bitmap
form one entry of the search, so a hot source is passed by in one step; bins that already hold the
cluster now being placed are set aside until its run of equal pieces ends.

Duplicate clusters are the components of near-duplicate texts (``jaccard_join``: 5-word shingles, Jaccard
from 0.75 on), joined row by row through the fingerprint of the text's shingles.

Defined results: null or empty text has no tokens and gets bin null, piece 0. A null source or cluster
conflicts with nothing. Repeated rows are packed each. Other columns are not carried unless asked for.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join
from tessera.llm import kernel as K
from tessera.llm.common import read, written

CAPACITY = 2048
SHARD_ROWS = 20_000
PACKED = "doc_id bigint, piece int, n_tokens bigint, bin_id string, bin_offset bigint"


class Bins:
    """Open bins of one shard by residual; each residual has groups of equal source bitmap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.groups: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.filled = 0  # bit r: a bin of residual r is open
        self.residual: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def put(self, b: int) -> None:
        r = self.residual[b]
        if r:
            self.groups[r].setdefault(self.sources[b], []).append(b)
            self.filled |= 1 << r

    def take(self, length: int, source: int, cluster: int) -> int:
        """Remove and return the tightest bin that fits and has neither bit; -1 if there is none."""
        rest = self.filled >> length << length
        while rest:
            low = rest & -rest
            r = low.bit_length() - 1
            group = self.groups[r]
            for held, bins in group.items():
                if held & source:
                    continue
                for k in range(len(bins)):
                    if not self.clusters[bins[k]] & cluster:
                        b = bins.pop(k)
                        if not bins:
                            del group[held]
                            if not group:
                                self.filled ^= low
                        return b
            rest ^= low
        return -1

    def open(self) -> int:
        self.residual.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        return len(self.residual) - 1

    def fill(self, b: int, length: int, source: int, cluster: int) -> int:
        """Where in the bin the piece begins."""
        begin = self.capacity - self.residual[b]
        self.residual[b] -= length
        self.sources[b] |= source
        self.clusters[b] |= cluster
        return begin


def bits(values: list, counts: dict) -> dict:
    """A bit for each value that stands more than once in the shard; 0 for the others, which cannot conflict."""
    several = sorted((v for v in set(values) if v is not None and counts.get(v, 0) > 1), key=str)
    return {v: 1 << k for k, v in enumerate(several)}


def pack_shard(doc: list, length: list[int], source: list, cluster: list, capacity: int) -> list[tuple]:
    """(row, piece, tokens, bin, offset) of every piece of the shard's rows."""
    pieces = []
    for row, n in enumerate(length):
        for k, at in enumerate(range(0, n, capacity)):
            pieces.append((min(capacity, n - at), row, k))
    counts_s: dict = {}
    counts_c: dict = {}
    for _, row, _ in pieces:
        counts_s[source[row]] = counts_s.get(source[row], 0) + 1
        counts_c[cluster[row]] = counts_c.get(cluster[row], 0) + 1
    s_bit, c_bit = bits(source, counts_s), bits(cluster, counts_c)
    pieces.sort(key=lambda p: (-p[0], str(cluster[p[1]]), str(doc[p[1]]), p[1], p[2]))
    bins, out, aside, run = Bins(capacity), [], [], None
    for n, row, k in pieces:
        s, c = s_bit.get(source[row], 0), c_bit.get(cluster[row], 0)
        if (n, c) != run:
            for b in aside:
                bins.put(b)
            aside, run = [], (n, c)
        b = -1 if n == capacity else bins.take(n, s, c)
        if b < 0:
            b = bins.open()
        out.append((row, k, n, b, bins.fill(b, n, s, c)))
        if c:
            aside.append(b)
        else:
            bins.put(b)
    return out


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select([]).slice(0, 0)
        K.release()
        shard = table["shard"][0].as_py()
        cols = [table[c].to_pylist() for c in ("doc_id", "n_tokens", "source", "cluster")]
        packed = pack_shard(*cols, capacity)
        return pa.table(
            {
                "doc_id": pa.array([cols[0][p[0]] for p in packed], pa.int64()),
                "piece": pa.array([p[1] for p in packed], pa.int32()),
                "n_tokens": pa.array([p[2] for p in packed], pa.int64()),
                "bin_id": pa.array([f"{shard}:{p[3]}" for p in packed], pa.string()),
                "bin_offset": pa.array([p[4] for p in packed], pa.int64()),
            }
        )

    return run


def sized_and_clustered(docs: DataFrame, doc_id: str, text: str, length: Column | None, source: str) -> DataFrame:
    """doc_id, n_tokens, source and cluster of each row, the texts read by the join alone."""
    carry = {"__source": F.col(source)}
    if length is not None:
        carry["__length"] = length
    rows, classes, _ = jaccard_join.jaccard_join(docs, doc_id=doc_id, text=text, carry=carry)
    # a set alone in its component is its own cluster, so only the others' components are joined
    linked = classes.where("fp <> component").select("fp", F.col("component").alias("linked"))
    linked = written(linked)
    few = linked.count() * jaccard_join.CLASS_BYTES <= jaccard_join.BROADCAST_BYTES
    rows = rows.join(F.broadcast(linked) if few else linked, "fp", "left")
    cluster = F.when(F.col("n_shingles") > 0, F.coalesce("linked", "fp")).alias("cluster")
    tokens = F.col("n_words" if length is None else "__length").alias("n_tokens")
    return rows.select("doc_id", tokens, F.col("__source").alias("source"), cluster)


def dealt(sized: DataFrame, shard_rows: int) -> DataFrame:
    """Rows with their shard: by what they hold, and those repeated very often by their place too."""
    shards = -(-sized.count() // shard_rows) or 1
    key = F.xxhash64("doc_id", "source", "n_tokens", "cluster")
    sized = sized.withColumn("key", key)
    often = written(sized.groupBy("key").count().where(F.col("count") > max(1, shard_rows // 20)).select("key"))
    place = F.monotonically_increasing_id()
    if not often.isEmpty():
        few = often.count() * jaccard_join.CLASS_BYTES <= jaccard_join.BROADCAST_BYTES
        marked = F.broadcast(often.withColumn("often", F.lit(True))) if few else often.withColumn("often", F.lit(True))
        sized = sized.withColumn("place", place).join(marked, "key", "left")
        sized = sized.withColumn("key", F.when(F.col("often"), F.xxhash64("key", "place")).otherwise(F.col("key")))
    return sized.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    n_tokens: Column | None = None,
    text: str = "text",
    source: str = "source",
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """A row for each piece of a document: PACKED. Rows without tokens have bin null.

    Tokens are words between white space unless ``n_tokens`` tells their number; clusters are those of near
    duplicates unless ``cluster`` names them.
    """
    length = None if n_tokens is None else F.coalesce(n_tokens, F.lit(0)).cast("bigint")
    if cluster is None:
        sized = sized_and_clustered(docs, doc_id, text, length, source)
    else:
        words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
        tokens = (words if length is None else length).alias("n_tokens")
        sized = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), tokens, F.col(source).alias("source"), cluster.alias("cluster"))
    sized = written(sized)
    packed = dealt(sized.where("n_tokens > 0"), shard_rows).groupBy("shard").applyInArrow(_pack(capacity), PACKED)
    nowhere = F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("bigint").alias("bin_offset")
    empty = sized.where("n_tokens = 0").select("doc_id", F.lit(0).alias("piece"), "n_tokens", *nowhere)
    return packed.unionByName(empty)


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


QUERIES = {"op4_pack": op4_pack}
ORACLE = {}
