"""Benchmark decontamination by suffix arrays of the training text.

Each task sorts the word suffixes of one shard of documents (prefix doubling up to the longest
benchmark item), then looks up every suffix of every benchmark item by binary search in all shards.
A suffix's search narrows its range word by word, so it also yields the longest verbatim match and
where it lies. No document is shuffled: all that moves is the benchmark, sent in blocks of a bounded
size (``block_bytes``); more blocks mean more passes over a shard's text, never a larger broadcast.

Defined results: null or wordless documents have no words and no hits. Null or wordless items have
no windows. An item without an id marks words but is not counted in ``n_items``. Repeated rows are
judged each by itself. Other columns are carried along when asked for (``keep``); result columns
replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel as K
from tessera.llm.common import arrow_type, read

WINDOW = 10
#: Bytes of documents in one suffix array (a longer single text makes one by itself).
SHARD_BYTES = 6 << 20
#: Bytes of benchmark text sent at once.
BLOCK_BYTES = 32 << 20

RESULT = {
    "n_words": "bigint",
    "hit_spans": "array<struct<start:bigint,end:bigint>>",
    "items": "array<string>",
    "longest_words": "bigint",
    "longest_start": "bigint",
    "longest_item": "string",
}


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` tokens (small ints; 0 ends a text and is smaller than all)."""
    n = len(tokens)
    pad = np.concatenate([tokens, np.zeros(3, tokens.dtype)]).astype(np.int64)
    width = int(tokens.max(initial=0)).bit_length() or 1
    have = 3 if 3 * width <= 63 else 2 if 2 * width <= 63 else 1
    key = pad[:n].copy()
    for k in range(1, have):
        key <<= width
        key |= pad[k : k + n]
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while have < depth:
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        at = order[slots]
        after = rank[np.minimum(at + have, n)] + 1
        again = np.argsort((rank[at] << 32) | after)
        at, after = at[again], after[again]
        order[slots] = at
        same = np.zeros(len(slots), bool)
        same[1:] = (rank[at[1:]] == rank[at[:-1]]) & (after[1:] == after[:-1])
        new[slots] = ~same
        rank[at] = np.maximum.accumulate(np.where(same, 0, slots))
        have *= 2
    return order


class Benchmark:
    """Word hashes of a block of items, one row per suffix to be searched."""

    def __init__(self, ids: list, texts: list, window: int):
        buf, off = K.text_buffer(pa.array(texts, pa.large_string()))
        self.hashes, begin = K.words(buf, off, K.ALNUM_WORD)
        self.ids = [None if i is None else str(i) for i in ids]
        self.item = np.repeat(np.arange(len(ids)), np.diff(begin))
        self.end = begin[1:][self.item]
        self.window = np.minimum(window, np.diff(begin))[self.item]
        self.longest = int(np.diff(begin).max(initial=0))


def search(tokens: np.ndarray, order: np.ndarray, wanted: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, ...]:
    """Of each benchmark suffix: the slots where its window occurs, its longest match, and one place of that."""
    n, m = len(order), len(wanted)
    padded = np.concatenate([tokens, np.zeros(bench.longest + 1, tokens.dtype)])
    low, high = np.zeros(m, np.int64), np.full(m, n, np.int64)
    window_low, window_high = np.zeros(m, np.int64), np.zeros(m, np.int64)
    longest, place = np.zeros(m, np.int64), np.zeros(m, np.int64)
    active, depth = np.arange(m), 0
    while len(active):
        at = active + depth
        live = at < bench.end[active]
        live[live] = wanted[at[live]] > 0
        active = active[live]
        if not len(active):
            break
        want = wanted[active + depth]
        edges = []
        for side in (0, 1):
            a, b = low[active].copy(), high[active].copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                seen = padded[order[np.minimum(mid, n - 1)] + depth]
                right = open_ & ((seen < want) if side == 0 else (seen <= want))
                a = np.where(right, mid + 1, a)
                b = np.where(open_ & ~right, mid, b)
            edges.append(a)
        found = edges[0] < edges[1]
        active, lo, hi = active[found], edges[0][found], edges[1][found]
        low[active], high[active] = lo, hi
        depth += 1
        longest[active], place[active] = depth, order[lo]
        full = bench.window[active] == depth
        window_low[active[full]], window_high[active[full]] = lo[full], hi[full]
    return window_low, window_high, longest, place


def shard_hits(buf: np.ndarray, off: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, ...]:
    """Of each text: its words, hit words, hit (text, item) pairs and longest match with its place and item."""
    hashes, begin = K.words(buf, off, K.ALNUM_WORD)
    docs = len(off) - 1
    counts = np.diff(begin)
    known, ids = np.unique(hashes, return_inverse=True)
    # one 0 after each text: no match runs on into the next
    starts = begin[:-1] + np.arange(docs)
    tokens = np.zeros(len(hashes) + docs, np.int64)
    tokens[np.arange(len(hashes)) + np.repeat(np.arange(docs), counts)] = ids + 1
    hit = np.zeros(len(tokens) + 1, np.int64)
    pairs = np.zeros((0, 2), np.int64)
    best, best_at, best_item = np.zeros(docs, np.int64), np.full(docs, -1), np.full(docs, -1)
    if len(hashes) and len(bench.hashes):
        slot = np.minimum(np.searchsorted(known, bench.hashes), len(known) - 1)
        wanted = np.where(known[slot] == bench.hashes, slot + 1, 0)
        order = suffix_array(tokens, bench.longest)
        lo, hi, longest, place = search(tokens, order, wanted, bench)
        sizes = hi - lo
        where = np.repeat(lo - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        at, suffix = order[where], np.repeat(np.arange(len(sizes)), sizes)
        np.add.at(hit, at, 1)
        np.add.at(hit, at + bench.window[suffix], -1)
        pairs = np.unique(np.stack([np.searchsorted(starts, at, "right") - 1, bench.item[suffix]], 1), axis=0)
        # a place of the longest match is reported once for each suffix; of a window, for each document
        at, suffix = np.concatenate([at, place[longest > 0]]), np.concatenate([suffix, np.flatnonzero(longest > 0)])
        doc = np.searchsorted(starts, at, "right") - 1
        length = np.where(np.arange(len(at)) < len(where), _match_lengths(tokens, at, wanted, suffix, bench), longest[suffix])
        rank = np.lexsort((at, -length, doc))
        first = rank[np.concatenate([[True], doc[rank[1:]] != doc[rank[:-1]]])] if len(rank) else rank
        best[doc[first]], best_at[doc[first]], best_item[doc[first]] = length[first], at[first] - starts[doc[first]], bench.item[suffix[first]]
    covered = np.cumsum(hit[:-1]) > 0
    return counts, starts, covered, pairs, best, best_at, best_item


def _match_lengths(tokens: np.ndarray, at: np.ndarray, wanted: np.ndarray, suffix: np.ndarray, bench: Benchmark) -> np.ndarray:
    """How many words agree from each place on, given that the window does."""
    length = bench.window[suffix].copy()
    run = np.arange(len(at))
    while len(run):
        s, p = suffix[run] + length[run], at[run] + length[run]
        ok = (s < bench.end[suffix[run]]) & (p < len(tokens))
        run, s, p = run[ok], s[ok], p[ok]
        same = (tokens[p] == wanted[s]) & (wanted[s] > 0)
        run = run[same]
        length[run] += 1
    return length


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _matcher(block, window: int, text: str, keep: list[str], schema: pa.Schema, shard_bytes: int, chained: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(*block.value, window)
        for table, buf, off in K.chunks(batches, text, shard_bytes):
            counts, starts, covered, pairs, best, best_at, best_item = shard_hits(buf, off, bench)
            docs = len(counts)
            spans: list[list[tuple[int, int]]] = [[] for _ in range(docs)]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
            for a, b in zip(edge[::2], edge[1::2], strict=True):
                d = int(np.searchsorted(starts, a, "right")) - 1
                spans[d].append((int(a - starts[d]), int(b - starts[d])))
            items: list[set] = [set() for _ in range(docs)]
            for d, i in pairs.tolist():
                items[d].add(bench.ids[i])
            longest = [(int(n), int(p), bench.ids[i] if i >= 0 else None) for n, p, i in zip(best, best_at, best_item, strict=True)]
            if chained:
                for d in range(docs):
                    if before := table["hit_spans"][d].as_py():
                        spans[d] = _merge(spans[d] + [(x["start"], x["end"]) for x in before])
                    items[d].update(table["items"][d].as_py())
                    if (old := table["longest_words"][d].as_py()) >= longest[d][0]:
                        longest[d] = (old, table["longest_start"][d].as_py(), table["longest_item"][d].as_py())
            result = {
                "n_words": counts,
                "hit_spans": [[{"start": a, "end": b} for a, b in s] for s in spans],
                "items": [sorted(x for x in s if x is not None) for s in items],
                "longest_words": [x[0] for x in longest],
                "longest_start": [x[1] for x in longest],
                "longest_item": [x[2] for x in longest],
            }
            yield pa.RecordBatch.from_arrays([_plain(table[f.name], f.type) if f.name in keep else pa.array(result[f.name], f.type) for f in schema], schema=schema)

    return run


def _plain(column: pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    column = column.combine_chunks()
    return column.cast(kind) if column.type != kind else column


def benchmark_blocks(spark: SparkSession, bench: DataFrame, item_id: str, text: str, block_bytes: int) -> list[tuple[list, list]]:
    """The benchmark's items in blocks of about ``block_bytes`` each, one at a time on the driver."""
    rows = bench.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(n)) == k)
        got = part.toArrow()
        yield got["i"].to_pylist(), got["t"].to_pylist()


def find_contamination(docs: DataFrame, bench: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document with the word spans that a benchmark window covers, the items found and the longest verbatim match.

    ``keep`` names the columns carried along (default: all). Spans are half open, in words.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULT]
    docs = docs.select(*dict.fromkeys([*keep, text]))
    blocks = [spark.sparkContext.broadcast(b) for b in benchmark_blocks(spark, bench, item_id, item_text, block_bytes)]
    out = docs
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        held = keep if last else list(dict.fromkeys([*keep, text]))
        schema = T.StructType([*(docs.schema[c] for c in held), *T._parse_datatype_string(",".join(f"{n} {t}" for n, t in RESULT.items())).fields])
        out = out.mapInArrow(_matcher(block, window, text, held, arrow_type(schema), shard_bytes, k > 0), schema)
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return out.withColumns({"n_hit": n_hit, "contaminated": n_hit > 0})


def remove_contaminated(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The documents without a benchmark window, with their own columns."""
    columns = docs.columns
    renamed = {c: f"__kept_{c}" for c in columns if c in {*RESULT, "n_hit", "contaminated"}}
    found = find_contamination(docs.withColumnsRenamed(renamed), bench, **options)
    return found.where(~F.col("contaminated")).select(*(F.col(renamed.get(c, c)).alias(c) for c in columns))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    joined = F.array_join("items", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), "contaminated")


ORACLE = {
    "op1_decontaminate": r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
bw as (select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') g from (select item_id, w, least(10, len(w)) k, unnest(range(1, len(w) - least(10, len(w)) + 2)) i from b where len(w) > 0)),
ks as (select distinct k from bw),
dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') g from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) i from d, ks)),
m as (select doc_id, item_id, i, dw.k from dw join bw on dw.k = bw.k and dw.g = bw.g),
h as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + k)) p from m) group by doc_id),
it as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) l from (select distinct doc_id, cast(item_id as varchar) s from m) group by doc_id)
select d.doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(l, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join h using (doc_id) left join it using (doc_id)""",
}
QUERIES = {"op1_decontaminate": op1_decontaminate}
