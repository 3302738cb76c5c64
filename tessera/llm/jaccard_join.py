"""Exact n-gram Jaccard join by set-relation skipping, and the components of its links.

A document's set is its distinct word shingles. Only distinct sets are joined; copies of a set share
its row. The steps, none of which emits all pairs of a group or gathers a group in one task:

1. *Screen.* Half of all shingles (by hash) are dealt to buckets by hash. A set that has more shingles
   nobody shares than threshold allows to miss cannot link and leaves; no set that can link does. A task
   counts the shingles that several of its own sets have where it reads them, and deals one witness of each.
   Of the sets left, one text each is read again, known by its hash.
2. *Index.* Of the sets left, each shingle's frequency is counted, and each set's prefix (rarest first)
   is put into index lists whose entries hold size and position. Shingles of very many sets (counted in
   the tasks first; fewer than HOT_SHARE) are never dealt: their frequency goes to the tasks. Their index
   lists are cut into salted parts, and in the rest every pair of parts is a task's work.
3. *Stars.* In each list the most central set serves as pivot; every other set checks one pivot, the
   one it shares most lists with. Sets linked to one pivot are one class, whatever their number.
4. *Rest.* Lists are cut into blocks of equal size and position; pairs of blocks whose position bound
   cannot reach the threshold are skipped whole, as are pairs of one class. The answers of a set are
   derived from those of its pivot: Jaccard distance is a metric, so a pair is accepted or refused
   without looking at it when the pivots' distance decides. Only what is left is verified.

Defined results: null or wordless text has an empty set, which links with nothing. Null ids take no
part in ``component_id`` unless a component has no other (then null; alone or empty: its own id).
Repeated rows each get a row. Other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import kernel as K
from tessera.llm.common import id_filter, in_filter, maybe_in, read, written

WIDTH = 5
#: Link when PER * intersection >= AT_LEAST * union.
AT_LEAST, PER = 75, 100
#: Shingles in one bucket of the screen or the index.
BUCKET_TOKENS = 1_000_000
#: Sets in one group whose counts a task adds up.
GROUP_SETS = 50_000
#: Entries held by a task before it deals them out.
FLUSH_TOKENS = 750_000
#: A task counts a shingle that this many of the sets it holds have, instead of dealing each.
LOCAL = 4
#: A shingle of more sets than this, and than this share of all entries, is hot.
HOT_SETS, HOT_SHARE = 20_000, 200_000
#: Stands for a set in the buckets, and for "several sets have this shingle".
WITNESS = np.int64(-(1 << 63))
MAX_BUCKETS = 1 << 24
STAR_ROUNDS = 2
#: Classes of several sets are sent to all tasks while they take no more than this; bytes of one.
BROADCAST_BYTES, CLASS_BYTES = 8 << 20, 64
LOW48 = K.U64((1 << 48) - 1)


def needed(a, b, at_least: int = AT_LEAST, per: int = PER):
    """Smallest intersection with which sets of these sizes link."""
    return -(-at_least * (a + b) // (at_least + per))


def fingerprints(tokens: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each (sorted, distinct) set, whatever the order."""
    total = np.concatenate([[K.U64(0)], np.cumsum(K.mix(tokens ^ K.U64(0xA5A5A5A5A5A5A5A5)))])
    size = np.diff(begin).astype(K.U64)
    return K.mix((total[begin[1:]] - total[begin[:-1]]) ^ (size * K.U64(0x9E3779B97F4A7C15))).view(np.int64)


def _sets(batches, text: str, width: int):
    for table, buf, off in K.chunks(batches, text):
        tokens, begin = K.shingle_sets(*K.words(buf, off, K.SPACE_WORD), width)
        yield table, tokens, begin, fingerprints(tokens, begin)


def _sampled(tokens: np.ndarray) -> np.ndarray:
    return (tokens & K.U64(1)) == 0


SIZED = "doc_id bigint, n bigint, half bigint, fp bigint, n_words bigint"


def _measure(text: str, doc_id: str, width: int, carry: list[str]):
    """Size, sampled size, fingerprint and words of each text's set, and the columns to carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, buf, off in K.chunks(batches, text):
            hashes, first = K.words(buf, off, K.SPACE_WORD)
            tokens, begin = K.shingle_sets(hashes, first, width)
            half = np.concatenate([[0], np.cumsum(_sampled(tokens))])[begin]
            own = [pa.array(x) for x in (np.diff(begin), np.diff(half), fingerprints(tokens, begin), np.diff(first).astype(np.int64))]
            kept = [table[c].combine_chunks() for c in carry]
            names = ["doc_id", "n", "half", "fp", "n_words", *carry]
            yield pa.RecordBatch.from_arrays([table[doc_id].combine_chunks().cast(pa.int64()), *own, *kept], names=names)

    return run


def fingerprinted(docs: DataFrame, text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with ``__fp``, the fingerprint of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, _, fp in _sets(batches, text, width):
            yield from table.append_column("__fp", pa.array(fp)).combine_chunks().to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__fp", T.LongType())]))


def _bucket(tokens: np.ndarray, buckets: int) -> np.ndarray:
    return ((tokens >> K.U64(40)).astype(np.int64) * buckets) >> 24


class Dealer:
    """Entries gathered by set and dealt to buckets: a row per bucket with sets, counts and packed tokens."""

    NAMES = ["bucket", "fp", "counts", "low", "high", "known"]
    SCHEMA = "bucket int, fp binary, counts binary, low binary, high binary, known binary"

    def __init__(self, buckets: int, local: int = 0):
        self.buckets, self.local, self.held, self.size = buckets, local, [], 0
        self.sets: set[int] = set()

    def add(self, fp: np.ndarray, tokens: np.ndarray, counts: np.ndarray):
        self.held.append((fp, tokens, counts))
        self.size += len(tokens) + len(fp)
        if self.local:
            self.sets.update(fp.tolist())

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        fp, tokens, counts = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        self.sets.clear()
        owner = np.repeat(np.arange(len(fp), dtype=np.int32), counts)
        known = np.zeros(0, np.dtype([("fp", "i8"), ("n", "i4")]))
        if self.local:  # the sets held are distinct, and so are the tokens of each
            order = np.argsort(tokens).astype(np.int32)
            at = _runs(tokens[order])
            often = np.flatnonzero(np.diff(at) >= self.local)
            hot = np.zeros(len(tokens), bool)
            hot[order] = np.repeat(np.diff(at) >= self.local, np.diff(at))
            n = np.bincount(owner[hot], minlength=len(fp))
            known = np.zeros(np.count_nonzero(n), known.dtype)
            known["fp"], known["n"] = fp[n > 0], n[n > 0]
            seen = tokens[order[at[often]]]
            fp = np.append(fp, WITNESS)
            tokens = np.concatenate([tokens[~hot], seen])
            owner = np.concatenate([owner[~hot], np.full(len(seen), len(fp) - 1, np.int32)])
            del order, at, hot, seen
        bucket = _bucket(tokens, self.buckets)
        order = np.argsort(bucket.astype(np.uint16 if self.buckets <= 1 << 16 else np.int32), kind="stable")
        bucket, owner, tokens = bucket[order], owner[order], tokens[order]
        edges = _runs(bucket)
        share = -(-len(known) // max(1, len(edges) - 1))
        rows: list[list] = [[] for _ in self.NAMES]
        for k, (b, e) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            who = owner[b:e]
            at = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            t = tokens[b:e] & LOW48
            packed = (
                int(bucket[b]),
                fp[who[at]].tobytes(),
                np.diff(np.append(at, e - b)).astype(np.uint32).tobytes(),
                (t & K.U64(0xFFFFFFFF)).astype(np.uint32).tobytes(),
                (t >> K.U64(32)).astype(np.uint16).tobytes(),
                known[k * share : (k + 1) * share].tobytes(),
            )
            for column, v in zip(rows, packed, strict=True):
                column.append(v)
        columns = [pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])]
        yield pa.RecordBatch.from_arrays(columns, names=self.NAMES)


def _undeal(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a bucket: set and token."""
    def of(name, kind):
        return np.frombuffer(b"".join(table[name].to_pylist()), kind)

    counts = of("counts", np.uint32).astype(np.int64)
    token = of("low", np.uint32).astype(np.uint64) | (of("high", np.uint16).astype(np.uint64) << K.U64(32))
    return np.repeat(of("fp", np.int64), counts), token


def _deal_sample(text: str, width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets, LOCAL)
        for _, tokens, begin, fp in _sets(batches, text, width):
            first = np.zeros(len(fp), bool)
            first[np.unique(fp, return_index=True)[1]] = True
            first &= np.array([f not in dealer.sets for f in fp.tolist()], bool)
            keep = _sampled(tokens) & np.repeat(first, np.diff(begin))
            counts = np.diff(np.concatenate([[0], np.cumsum(keep)])[begin])
            dealer.add(fp[counts > 0], tokens[keep], counts[counts > 0])
            if dealer.size >= FLUSH_TOKENS:
                yield from dealer.flush()
        yield from dealer.flush()

    return run


def _runs(token: np.ndarray) -> np.ndarray:
    """Where each run of equal (sorted) tokens begins, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])), len(token)) if len(token) else np.zeros(1, np.int64)


def _shared_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket: distinct (token, set) entries whose token several sets have, and how many have it."""
    fp, token = _undeal(table)
    order = np.argsort(token)
    fp, token = fp[order], token[order]
    at = _runs(token)
    length = np.diff(at)
    several = np.zeros(len(length), bool)
    if len(length):
        least = np.minimum.reduceat(fp, at[:-1])
        several = (least == WITNESS) | (least != np.maximum.reduceat(fp, at[:-1]))
    keep = np.repeat(several, length) & (fp != WITNESS)
    fp, token = fp[keep], token[keep]
    order = np.lexsort((fp, token))
    fp, token = fp[order], token[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (token[1:] != token[:-1])
    fp, token = fp[new], token[new]
    return fp, token, np.repeat(np.diff(_runs(token)), np.diff(_runs(token)))


COUNTED = "grp int, fp binary, shared binary"


def _count_shared(groups: int):
    """How many of each set's tokens are shared: those of the bucket, and those its tasks have counted.

    A row per group of sets. A set that several tasks hold is counted by each: never too little, so none
    that can link is lost.
    """

    def run(table: pa.Table) -> pa.Table:
        K.release()
        who, n = np.unique(_shared_entries(table)[0], return_counts=True)
        known = np.frombuffer(b"".join(table["known"].to_pylist()), np.dtype([("fp", "i8"), ("n", "i4")]))
        fp, n = np.concatenate([who, known["fp"]]), np.concatenate([n, known["n"]]).astype(np.int64)
        group = _group(fp, groups)
        order = np.argsort(group, kind="stable")
        at = _runs(group[order])
        grp = pa.array(group[order][at[:-1]].astype(np.int32))
        return pa.table({"grp": grp, "fp": _blobs(fp[order], at), "shared": _blobs(n[order], at)})

    return run


def _add_shared(table: pa.Table) -> pa.Table:
    """The sum of each set's counts, of one group of sets."""
    fp, n = (np.frombuffer(b"".join(table[c].to_pylist()), np.int64) for c in ("fp", "shared"))
    who, at = np.unique(fp, return_inverse=True)
    return pa.table({"fp": who, "shared": np.bincount(at, n, len(who)).astype(np.int64)})


def _read_sets(text: str, text_hash: str, width: int, bits):
    """The sets of the texts whose hash may be among those asked for (bits), once a task."""

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes = b.column(text_hash).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(maybe_in(np.frombuffer(bits.value, np.uint8), hashes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, tokens, begin, fp in _sets(asked(batches), text, width):
            out = []
            for d in range(len(fp)):
                if begin[d + 1] > begin[d] and int(fp[d]) not in seen:
                    seen.add(int(fp[d]))
                    out.append((int(fp[d]), tokens[begin[d] : begin[d + 1]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["fp", "tokens"])

    return run


def _binary_lists(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    buf, off = K.text_buffer(column)
    return np.frombuffer(buf.tobytes(), kind), off // np.dtype(kind).itemsize


def _held_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """fp, tokens and counts of written sets, in pieces of about FLUSH_TOKENS."""
    held, size = [], 0
    for b in batches:
        tokens, off = _binary_lists(b.column("tokens"), np.uint64)
        held.append((b.column("fp").to_numpy(zero_copy_only=False), tokens, np.diff(off)))
        size += len(tokens)
        if size >= FLUSH_TOKENS:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
        held = []
    K.release()


def _count_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens that several of the sets held together have, with their number there."""
    for _, tokens, _ in _held_sets(batches):
        tokens = np.sort(tokens)
        at = _runs(tokens)
        n = np.diff(at)
        often = n >= LOCAL
        columns = [pa.array(tokens[at[:-1][often]].view(np.int64)), pa.array(n[often].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=["token", "df"])


def hot_tokens(sets: DataFrame, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens (sorted) of more sets than HOT_SETS and than this share of all entries, and about how many sets.

    They are fewer than HOT_SHARE. One that tasks see less than LOCAL times in each piece is missed, and then
    has less than LOCAL of every FLUSH_TOKENS entries.
    """
    found = sets.mapInArrow(_count_often, "token bigint, df bigint").groupBy("token").agg(F.sum("df").alias("df"))
    found = found.where(F.col("df") > max(HOT_SETS, entries // HOT_SHARE)).toArrow()
    token, df = (found[c].to_numpy() for c in ("token", "df"))
    order = np.argsort(token.view(np.uint64))
    return token.view(np.uint64)[order], df[order].astype(np.int64)


def _among(tokens: np.ndarray, sorted_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are among the sorted ones, and where."""
    if not len(sorted_tokens):
        return np.zeros(len(tokens), bool), np.zeros(len(tokens), np.int64)
    at = np.minimum(np.searchsorted(sorted_tokens, tokens), len(sorted_tokens) - 1)
    return sorted_tokens[at] == tokens, at


def _named(tokens: np.ndarray, buckets: int) -> np.ndarray:
    """The index's name of a token: what is left of it in its bucket, and the bucket."""
    return (tokens & LOW48) ^ (_bucket(tokens, buckets).astype(np.uint64) * K.U64(0x9E3779B97F4A7C15))


def _deal_sets(buckets: int, hot):
    """Entries of the sets, but those of hot tokens, dealt by token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = Dealer(buckets)
        for fp, tokens, counts in _held_sets(batches):
            usual = ~_among(tokens, hot.value[0])[0]
            owner = np.repeat(np.arange(len(fp)), counts)[usual]
            n = np.bincount(owner, minlength=len(fp))
            dealer.add(fp[n > 0], tokens[usual], n[n > 0])
            yield from dealer.flush()

    return run


def _hot_entries(buckets: int, hot):
    """The sets' entries of hot tokens, in the form in which the buckets send theirs to the groups of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fp, tokens, counts in _held_sets(batches):
            mine, at = _among(tokens, hot.value[0])
            entry = np.repeat(fp, counts)[mine]
            yield from _by_group(entry, _named(tokens[mine], buckets), hot.value[1][at[mine]], entry, buckets).to_batches()

    return run


def _blobs(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """values cut at ``at`` (begin of each piece, and the end) as a binary column."""
    ends = pa.array((at * values.dtype.itemsize).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, ends.buffers()[1], pa.py_buffer(values.tobytes())])


def _by_group(fp: np.ndarray, token: np.ndarray, df: np.ndarray, entries: np.ndarray, groups: int) -> pa.Table:
    """Shared tokens with their frequencies, packed by group of sets.

    Every set also has its number of ``entries``, shared or not: over all buckets they add up to its size.
    """
    order = np.lexsort((fp, _group(fp, groups)))
    fp, token, df = fp[order], token[order], df[order].astype(np.int64)
    all_fp, counted = np.unique(entries, return_counts=True)
    own = np.argsort(_group(all_fp, groups), kind="stable")
    all_fp, counted = all_fp[own], counted[own].astype(np.int32)
    every = np.unique(_group(all_fp, groups))

    def ends(x: np.ndarray) -> np.ndarray:
        return np.append(np.searchsorted(_group(x, groups), every), len(x))

    return pa.table(
        {
            "grp": every.astype(np.int32),
            "sets": _blobs(all_fp, ends(all_fp)),
            "counts": _blobs(counted, ends(all_fp)),
            "fp": _blobs(fp, ends(fp)),
            "tokens": _blobs(token, ends(fp)),
            "dfs": _blobs(np.minimum(df, (1 << 31) - 1).astype(np.int32), ends(fp)),
        }
    )


def _frequencies(groups: int):
    """A bucket's shared tokens, named, and their frequencies, packed by group of sets."""

    def run(table: pa.Table) -> pa.Table:
        K.release()
        bucket = table["bucket"][0].as_py() if table.num_rows else 0
        fp, token, df = _shared_entries(table)
        name = token ^ np.full(1, bucket, np.uint64) * K.U64(0x9E3779B97F4A7C15)
        return _by_group(fp, name, df, _undeal(table)[0], groups)

    return run


def _group(fp: np.ndarray, groups: int) -> np.ndarray:
    return (fp.view(np.uint64) % K.U64(groups)).astype(np.int64)


PACKED = "grp int, sets binary, counts binary, fp binary, tokens binary, dfs binary"
SETS = "fp bigint, n bigint, central double, tokens binary, prefix binary"


def _assemble(at_least: int, per: int):
    """The sets of a group that share enough: all their shared tokens, and the prefix, rarest first."""
    def run(table: pa.Table) -> pa.Table:
        K.release()
        of = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
        sets, where = np.unique(of("sets", np.int64), return_inverse=True)
        n = np.bincount(where, of("counts", np.int32), len(sets)).astype(np.int64)
        fp, token, df = of("fp", np.int64), of("tokens", np.uint64), of("dfs", np.int32)
        who = np.searchsorted(sets, fp)
        shared = np.bincount(who, minlength=len(sets))
        least = -(-at_least * n // per)
        keep = shared >= np.maximum(least, 1)
        mine = keep[who]
        who, token, df = who[mine], token[mine], df[mine]
        kept = np.flatnonzero(keep)
        central = np.bincount(who, np.log(df), len(sets))[kept] / n[kept]
        by_value = np.lexsort((token, who))
        at = np.append(0, np.cumsum(shared[kept]))
        by_df = np.lexsort((token, df, who))
        rank = np.arange(len(who)) - np.repeat(at[:-1], shared[kept])
        length = np.maximum(0, (shared - least + 1)[kept])
        first = by_df[rank < np.repeat(length, shared[kept])]
        return pa.table({"fp": sets[kept], "n": n[kept], "central": central, "tokens": _blobs(token[by_value], at), "prefix": _blobs(token[first], np.append(0, np.cumsum(np.minimum(length, shared[kept]))))})

    return run


ENTRY = np.dtype([("token", "u8"), ("fp", "i8"), ("label", "i8"), ("pivot", "i8"), ("n", "i4"), ("pos", "i4"), ("central", "f4"), ("pad", "i4")])


def _prefix_entries(b: pa.RecordBatch) -> np.ndarray:
    """Index entries of each set's prefix."""
    prefix, off = _binary_lists(b.column("prefix"), np.uint64)
    own = np.diff(K.text_buffer(b.column("tokens"))[1]) // 8
    owner = np.repeat(np.arange(b.num_rows), np.diff(off))
    e = np.zeros(len(prefix), ENTRY)
    n = b.column("n").to_numpy(zero_copy_only=False)
    e["token"], e["n"] = prefix, n[owner]
    for c in ("fp", "label", "pivot", "central"):
        e[c] = b.column(c).to_numpy(zero_copy_only=False)[owner]
    e["pos"] = np.arange(len(prefix)) - off[:-1][owner] + (n - own)[owner]
    return e


def _dealt(e: np.ndarray, salt: np.ndarray, buckets: int) -> pa.RecordBatch:
    bucket = (K.mix(e["token"] + salt.astype(np.uint64) * K.U64(0xD6E8FEB86659FD93)) % K.U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    e, bucket = e[order], bucket[order]
    at = _runs(bucket)
    packed = [e[x:y].tobytes() for x, y in zip(at[:-1], at[1:], strict=True)]
    columns = [pa.array(bucket[at[:-1]].astype(np.int32)), pa.array(packed, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "entries"])


def _deal_prefixes(buckets: int, hot, nth: int):
    """Index entries dealt by token; those of a hot token by a salt too, another one in each round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = hot.value
        for b in batches:
            e = _prefix_entries(b)
            mine, at = _among(e["token"], names)
            salt = np.zeros(len(e), np.int64)
            own = K.mix(e["fp"][mine].view(np.uint64) + K.U64(nth)) % parts[at[mine]].astype(np.uint64)
            salt[mine] = own.astype(np.int64)
            yield _dealt(e, salt, buckets)

    return run


def _label_range(hot):
    """Smallest and largest class among the entries of each hot token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _ = hot.value
        low, high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
        for b in batches:
            e = _prefix_entries(b)
            mine, at = _among(e["token"], names)
            np.minimum.at(low, at[mine], e["label"][mine])
            np.maximum.at(high, at[mine], e["label"][mine])
        met = np.flatnonzero(low <= high)
        columns = [pa.array(x) for x in (met.astype(np.int32), low[met], high[met])]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "low", "high"])

    return run


def _deal_pairs_of_parts(buckets: int, hot, mixed):
    """Index entries dealt by token; those of hot tokens with several classes to every pair of parts of theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, parts = hot.value
        for b in batches:
            e = _prefix_entries(b)
            mine, at = _among(e["token"], names)
            yield _dealt(e[~mine], np.zeros(np.count_nonzero(~mine), np.int64), buckets)
            keep = np.flatnonzero(mine)[mixed.value[at[mine]]] if len(names) else np.zeros(0, np.int64)
            if len(keep):
                many = parts[at[keep]]
                part = (K.mix(e["fp"][keep].view(np.uint64)) % many.astype(np.uint64)).astype(np.int64)
                entry = np.repeat(np.arange(len(keep)), many)
                other = np.arange(len(entry)) - np.repeat(np.cumsum(many) - many, many)
                x, y = np.minimum(part[entry], other), np.maximum(part[entry], other)
                for k in range(0, len(entry), FLUSH_TOKENS):
                    cut = slice(k, k + FLUSH_TOKENS)
                    yield _dealt(e[keep[entry[cut]]], 1 + x[cut] * many[entry[cut]] + y[cut], buckets)

    return run


def _reach(a: np.ndarray, b: np.ndarray, at_least: int, per: int) -> np.ndarray:
    """Whether a pair that meets first at these positions can still link."""
    need = needed(a["n"].astype(np.int64), b["n"].astype(np.int64), at_least, per)
    small, large = np.minimum(a["n"], b["n"]).astype(np.int64), np.maximum(a["n"], b["n"]).astype(np.int64)
    return (per * small >= at_least * large) & (np.minimum(a["n"] - a["pos"], b["n"] - b["pos"]) >= need)


def _list_entries(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index lists with more than one class: entries by (token, least central first), and each list's begin."""
    e = np.frombuffer(b"".join(table["entries"].to_pylist()), ENTRY)
    e = e[np.lexsort((e["fp"], -e["central"], e["token"]))]
    at = _runs(e["token"])
    if not len(e):
        return e, at
    several = np.minimum.reduceat(e["label"], at[:-1]) != np.maximum.reduceat(e["label"], at[:-1])
    e = e[np.repeat(several, np.diff(at))]
    return e, _runs(e["token"])


def _stars(nth: int, at_least: int, per: int):
    """In each list, the pair of every entry with the list's nth most central set, if of another class."""
    def run(table: pa.Table) -> pa.Table:
        K.release()
        e, at = _list_entries(table)
        size = np.diff(at)
        pivot = np.repeat(at[:-1] + np.minimum(nth, size - 1), size)
        p = e[pivot]
        ok = (e["label"] != p["label"]) & _reach(e, p, at_least, per)
        x, y = e["fp"][ok], p["fp"][ok]
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        new = np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]) if len(x) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        return pa.table({"a": x[first], "b": y[first], "lists": np.diff(np.append(first, len(x))).astype(np.int64)})

    return run


def _rest(at_least: int, per: int):
    """All pairs of different classes left in a bucket's lists, skipping pairs of blocks by position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        K.release()
        e, _ = _list_entries(pa.Table.from_batches(list(batches)))
        e = e[np.lexsort((e["label"], e["pos"], e["n"], e["token"]))]
        cut = np.ones(len(e), bool)
        cut[1:] = np.any([e[c][1:] != e[c][:-1] for c in ("token", "n", "pos", "label")], axis=0)
        block = np.append(np.flatnonzero(cut), len(e))
        head = e[block[:-1]]
        lists = _runs(head["token"])
        end = np.repeat(lists[1:], np.diff(lists))
        at, step = 0, 2_000_000
        found: list[np.ndarray] = []

        def out():
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(4)], names=["a", "b", "p", "q"])

        while at < len(head):
            width = np.cumsum(end[at:] - np.arange(at, len(head)))
            stop = at + max(1, int(np.searchsorted(width, step, "right")))
            mine = np.arange(at, stop)
            count = end[mine] - mine - 1
            i = np.repeat(mine, count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            ok = (head["label"][i] != head["label"][j]) & _reach(head[i], head[j], at_least, per)
            i, j = i[ok], j[ok]
            left, right = block[i + 1] - block[i], block[j + 1] - block[j]
            k = 0
            while k < len(i):
                total = np.cumsum(left[k:] * right[k:])
                m = k + max(1, int(np.searchsorted(total, step, "right")))
                n = (left * right)[k:m]
                row = np.repeat(np.arange(k, m), n)
                seq = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                x, y = e[block[i[row]] + seq // right[row]], e[block[j[row]] + seq % right[row]]
                swap = x["fp"] > y["fp"]
                found.append(np.unique(np.stack([np.where(swap, y[c], x[c]) if first else np.where(swap, x[c], y[c]) for c, first in (("fp", True), ("fp", False), ("pivot", True), ("pivot", False))], 1), axis=0))
                if sum(map(len, found)) > step:
                    yield out()
                k = m
            at = stop
        yield out()

    return run


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, lo = _binary_lists(b.column("ta"), np.uint64)
        right, ro = _binary_lists(b.column("tb"), np.uint64)
        common = np.zeros(b.num_rows, np.int64)
        for k in range(b.num_rows):
            x, y = left[lo[k] : lo[k + 1]], right[ro[k] : ro[k + 1]]
            if len(x) > len(y):
                x, y = y, x
            if len(y):
                at = np.searchsorted(y, x)
                common[k] = np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common), b.column("na"), b.column("nb")], names=["a", "b", "common", "na", "nb"])


def verified(pairs: DataFrame, sets: DataFrame, at_least: int, per: int) -> DataFrame:
    """The pairs (a, b) with their intersection, Jaccard distance and whether they link."""
    of = lambda s: sets.select(F.col("fp").alias(s), F.col("tokens").alias(f"t{s}"), F.col("n").alias(f"n{s}"))
    got = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").mapInArrow(_intersect, "a bigint, b bigint, common bigint, na bigint, nb bigint")
    union = F.col("na") + F.col("nb") - F.col("common")
    return got.select("a", "b", (1 - F.col("common") / union).alias("dist"), (F.col("common") * per >= union * at_least).alias("link"))


def few_files(df: DataFrame, entries: int) -> DataFrame:
    """``df`` in no more tasks than this many entries need, but one for each core: each task writes a file."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-entries // BUCKET_TOKENS)))


def components(edges: DataFrame) -> DataFrame:
    """Each node of the edges (a, b) with the smallest node it can reach: (node, label).

    Labels spread to neighbours and are then followed once (pointer jumping), until nothing changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    size = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
    labels = written(few_files(labels, size))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        moved = step.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("label"))
        moved = written(few_files(moved, size))
        labels = moved.select("node", "label")
        if moved.where("old <> label").isEmpty():
            return labels


def jaccard_join(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    at_least: int = AT_LEAST,
    per: int = PER,
    carry: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links).

    documents: doc_id, n_shingles, fp (the set), n_words, and the columns of ``carry`` under their names.
    classes: fp, component (a set's fp). links: the verified or derived pairs (a, b) of sets that connect
    the classes.
    """
    spark = docs.sparkSession
    carried = [column.alias(name) for name, column in (carry or {}).items()]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("__text_hash"), *carried)
    fields = [f for f in docs.schema.fields if f.name in ("__text_hash", *(carry or {}))]
    schema = T.StructType([*T._parse_datatype_string(SIZED).fields, *fields])
    sized = written(docs.mapInArrow(_measure("text", "doc_id", width, [f.name for f in fields]), schema))
    docs = docs.select("text", "__text_hash")
    # one text stands for each set
    distinct = sized.where("n > 0").groupBy("fp").agg(F.first("n").alias("n"), F.first("half").alias("half"), F.min("__text_hash").alias("text_hash"))
    total, rows = sized.agg(F.coalesce(F.sum("half"), F.lit(0)), F.count("*")).first()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # 1. screen
    buckets = min(MAX_BUCKETS, max(2 * least, -(-total // BUCKET_TOKENS)))
    dealt = docs.select("text").mapInArrow(_deal_sample("text", width, buckets), Dealer.SCHEMA)
    shared = dealt.groupBy("bucket").applyInArrow(_count_shared(max(least, -(-rows // GROUP_SETS))), COUNTED)
    shared = shared.groupBy("grp").applyInArrow(_add_shared, "fp bigint, shared bigint")
    missing = F.col("half") - F.coalesce("shared", F.lit(0))
    left = distinct.join(shared, "fp", "left").where(missing <= F.col("n") - F.ceil(F.col("n") * at_least / per))
    left = written(few_files(left.select("fp", "n", "text_hash"), total))
    bits = spark.sparkContext.broadcast(id_filter(left.select("text_hash")).tobytes())
    sets = docs.mapInArrow(_read_sets("text", "__text_hash", width, bits), "fp bigint, tokens binary")
    sets = written(few_files(sets.groupBy("fp").agg(F.first("tokens").alias("tokens")).join(left.select("fp", "n"), "fp"), total))
    # 2. index
    tokens = sets.agg(F.sum("n")).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(least, -(-tokens // BUCKET_TOKENS)))
    token, df = hot_tokens(sets, tokens)
    hot = spark.sparkContext.broadcast((token, df))
    packed = sets.mapInArrow(_deal_sets(buckets, hot), Dealer.SCHEMA).groupBy("bucket").applyInArrow(_frequencies(buckets), PACKED)
    if len(token):
        packed = packed.union(sets.mapInArrow(_hot_entries(buckets, hot), PACKED))
    sets = written(few_files(packed.groupBy("grp").applyInArrow(_assemble(at_least, per), SETS), tokens))
    name = _named(token, buckets)
    order = np.argsort(name)
    hot = spark.sparkContext.broadcast((name[order], -(-df[order] // HOT_SETS) + 1))
    # 3. stars
    classes = sets.select("fp", F.col("fp").alias("label"), F.col("fp").alias("pivot"), F.lit(0.0).alias("near"))
    links = None
    entries = "bucket int, entries binary"
    for nth in range(STAR_ROUNDS):
        lists = sets.join(classes, "fp").mapInArrow(_deal_prefixes(buckets, hot, nth), entries).groupBy("bucket")
        star = lists.applyInArrow(_stars(nth, at_least, per), "a bigint, b bigint, lists bigint")
        star = star.groupBy("a", "b").agg(F.sum("lists").alias("lists"))
        star = star.groupBy("a").agg(F.max_by("b", F.struct("lists", "b")).alias("b"))
        checked = written(few_files(verified(star, sets, at_least, per).where("link"), tokens))
        links = checked if links is None else links.union(checked)
        reached = components(links)
        near = links.groupBy(F.col("a").alias("fp")).agg(F.min_by(F.struct("b", "dist"), F.struct("dist", "b")).alias("x"))
        classes = sets.select("fp").join(reached.withColumnRenamed("node", "fp"), "fp", "left").join(near, "fp", "left")
        label, pivot = F.coalesce("label", "fp").alias("label"), F.coalesce("x.b", "fp").alias("pivot")
        classes = classes.select("fp", label, pivot, F.coalesce("x.dist", F.lit(0.0)).alias("near"))
        classes = written(few_files(classes, tokens))
    # 4. the rest
    prefixes = sets.join(classes, "fp")
    mixed = np.zeros(len(token), bool)
    if len(token):
        ranges = prefixes.mapInArrow(_label_range(hot), "at int, low bigint, high bigint")
        ranges = ranges.groupBy("at").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
        mixed[[r["at"] for r in ranges.collect()]] = True
    mixed = spark.sparkContext.broadcast(mixed)
    lists = prefixes.mapInArrow(_deal_pairs_of_parts(buckets, hot, mixed), entries).groupBy("bucket")
    rest = written(lists.applyInArrow(_rest(at_least, per), "a bigint, b bigint, p bigint, q bigint").distinct())
    if not rest.isEmpty():
        limit, slack = 1 - at_least / per, 1e-9
        near = classes.select("fp", "near")
        ordered = rest.select("*", F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"))
        pivots = ordered.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct()
        between = written(verified(pivots, sets, at_least, per))
        known = (
            ordered.join(between.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("dist").alias("pq")), ["u", "v"], "left")
            .join(near.select(F.col("fp").alias("a"), F.col("near").alias("ap")), "a")
            .join(near.select(F.col("fp").alias("b"), F.col("near").alias("bq")), "b")
            .withColumns({"pq": F.coalesce("pq", F.lit(0.0)), "arms": F.col("ap") + F.col("bq")})
        )
        surely, never = F.col("pq") + F.col("arms") <= limit - slack, F.col("pq") - F.col("arms") > limit + slack
        derived = F.when(surely, 1).when(never, -1).otherwise(0).alias("derived")
        known = written(known.select("a", "b", derived))
        derived = known.where("derived = 1").select("a", "b", F.lit(limit).alias("dist"), F.lit(True).alias("link"))
        checked = verified(known.where("derived = 0"), sets, at_least, per).where("link")
        links = written(links.union(between.where("link")).union(derived).union(checked))
        reached = components(links)
        classes = sets.select("fp").join(reached.withColumnRenamed("node", "fp"), "fp", "left")
        classes = written(few_files(classes.select("fp", F.coalesce("label", "fp").alias("label")), tokens))
    documents = sized.select("doc_id", F.col("n").alias("n_shingles"), "fp", "n_words", *(carry or {}))
    return documents, classes.select("fp", F.col("label").alias("component")), links.select("a", "b")


def near_duplicate_components(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    documents, classes, _ = jaccard_join(docs, **options)
    of_set = documents.where("n_shingles > 0").groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # most classes are one set; the others' smallest ids go to all tasks if they are few, else AQE splits a large class
    smallest = written(of_set.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("sets")).where("sets > 1").select("component", "component_id"))
    few = smallest.count() * CLASS_BYTES <= BROADCAST_BYTES
    known = of_set.join(F.broadcast(smallest) if few else smallest, "component", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    known = written(known)  # so that the join below has plain exchanges on both sides, which AQE can split
    return documents.join(known, "fp", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def remove_near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, **options) -> DataFrame:
    """The documents without those that links join to one of a smaller id, with all their columns.

    Decided per row, by id and set: of a group's rows those of its smallest id stay, with that id's
    smallest fingerprint; one row of an id and set stays. Rows of one id whose texts are not linked are
    decided each by itself. Rows without an id stay; empty texts of one id are repeats.
    """
    documents, classes, _ = jaccard_join(docs, doc_id=doc_id, text=text, width=width, **options)
    rows = written(documents.where("doc_id is not null").groupBy("doc_id", "fp").agg(F.first("n_shingles").alias("n"), F.count("*").alias("copies")))
    held = rows.where("n > 0").join(classes, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # the smallest (id, fp) of each set first, so that a large class is not gathered row by row
    best = held.groupBy("component", "fp").agg(F.min("doc_id").alias("doc_id")).groupBy("component").agg(F.min(F.struct("doc_id", "fp")).alias("b")).select("b.doc_id", "b.fp")
    gone = written(rows.where("n > 0").select("doc_id", "fp").join(best, ["doc_id", "fp"], "left_anti"))
    flag = in_filter(docs, doc_id, gone.select("doc_id").union(rows.where("copies > 1").select("doc_id")))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("fp").alias("__gone"))
    rest = fingerprinted(docs.where(flag), text, width)
    rest = rest.join(gone, (F.col(doc_id).cast("bigint") == F.col("__id")) & (F.col("__fp") == F.col("__gone")), "left_anti")
    return docs.where(~flag).union(rest.dropDuplicates([doc_id, "__fp"]).drop("__fp"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_components(read(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = {
    "op3_jaccard_join": r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) i from d where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 75 * (a.n + b.n - c)),
e as (select x, y from l union select y, x from l),
r(a, b) as (select x, x from e union select r.a, e.y from r join e on r.b = e.x)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(m.c, d.doc_id) component_id from d left join n using (doc_id) left join (select a doc_id, min(b) c from r group by a) m using (doc_id)"""
}
QUERIES = {"op3_jaccard_join": op3_jaccard_join}

