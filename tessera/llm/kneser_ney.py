"""Interpolated modified Kneser-Ney language model of order 3, counted in Spark and memory-mapped by workers.

Counting takes two shuffles. Tasks turn the training texts into (u, v, w) runs of three tokens, sum them
locally and deal them to buckets by the middle word v: a bucket then holds whole counts of its runs, the
whole contexts (u, v), the numbers of distinct u before (v, w), and v as a context. Words and ends that
have more than a share of all tokens as v (``hot``) are dealt by (u, v), and pairs (u, v) beyond that share
by the whole run; what is split so is summed afterwards, by w or by Spark. The second shuffle deals the
distinct (v, w) on to the buckets of w, for the lowest level. A text's first token has only START before
it; (START, w) counts its occurrences.

The model is a folder of files below the shared folder, two for each bucket: tables of sorted 48-bit hashes
with counts. Contexts seen once are not stored: the level below knows that they were seen. The folder grows
with the corpus and is never sent or loaded whole: workers map the files and look sorted batches up.
Discounts come from the counts of counts of each level.

Defined results: null or wordless text is one end token. Words are told apart by 48 bits of their hash
(about one in 10^7 of 10^8 words meets another), runs while counting by 64 bits and in a bucket's table by
48 (a run never seen is taken for one of a million in its table once in 10^8 look-ups). Repeated rows count
and are scored each; a null id hashes as the empty text; other columns, whatever their names, are not read;
a very long text is one chunk of its own. With no training row, the model is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import kernel as K
from tessera.llm.common import fold_bucket, read, shared_folder, written
from tessera.llm.shared_io import local_path, open_file, write_file

BITS48 = K.U64((1 << 48) - 1)
#: The end of a text, what stands before its first word, and before that.
END, START, NONE = K.U64(0x0E0D0E0D0E0D), K.U64(0x571A27571A27), K.U64(0x4E07E4E07E4E)
#: Tokens that a task sums before dealing them out, and tokens of a bucket.
FLUSH_TOKENS, BUCKET_TOKENS = 1_500_000, 1_000_000
#: Words with a fourth of a bucket's share of all tokens are split, down to this share.
LEAST_SHARE = 1 / 50_000
#: Bytes of text that frequent words are counted in at once, and the share of its tokens that counts.
FREQUENT_BYTES, FREQUENT_SHARE = 8 << 20, 1 / 125_000
#: The most frequent words are dealt as two bytes; the last code says that the hash itself follows.
CODES = (1 << 16) - 1
FOLDS, HELD = 7, 2


def tokens_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, each ending in END, and where each text's begin."""
    hashes, begin = K.words(buf, off, K.SPACE_WORD)
    docs = len(off) - 1
    at = begin + np.arange(docs + 1)
    out = np.full(len(hashes) + docs, END, K.U64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(begin))] = hashes & BITS48
    return out, at


def before(tokens: np.ndarray, at: np.ndarray, start, none) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each: (none, start) before a text's first, (start, first) before its second."""
    v, u = np.empty_like(tokens), np.empty_like(tokens)
    v[1:] = tokens[:-1]
    v[at[:-1]] = start
    u[1:] = v[:-1]
    u[at[:-1]] = none
    return u, v


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return K.mix(K.mix(context ^ K.U64(0x51ED270B7A14C2B5)) + word * K.U64(0xD1342543DE82EF95))


def bucket_of(value: np.ndarray, buckets: int) -> np.ndarray:
    return ((K.mix(value ^ K.U64(0x2545F4914F6CDD1D)) >> K.U64(32)) * K.U64(buckets) >> K.U64(32)).astype(np.int64)


def slots(names: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are among the sorted names, and where."""
    if not len(names):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(names, values), len(names) - 1)
    return names[at] == values, at


class Hot:
    """What is dealt in parts (sorted words and keys of pairs), and the words that have a code."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, coded: np.ndarray):
        self.words, self.pairs, self.coded = words, pairs, coded  # coded: by falling frequency
        self.order = np.argsort(coded)

    def codes(self, words: np.ndarray) -> np.ndarray:
        found, at = slots(self.coded[self.order], words)
        out = np.full(len(words), CODES, np.uint16)
        out[found] = self.order[at[found]]
        return out

    def context_bucket(self, v: np.ndarray, pair: np.ndarray, buckets: int) -> np.ndarray:
        """Where a context (u, v) is kept, unless it is itself hot."""
        out = bucket_of(v, buckets)
        often = slots(self.words, v)[0]
        out[often] = bucket_of(pair[often], buckets)
        return out

    def run_bucket(self, v: np.ndarray, pair: np.ndarray, run: np.ndarray, buckets: int) -> np.ndarray:
        out = self.context_bucket(v, pair, buckets)
        often = slots(self.words, v)[0] & slots(self.pairs, pair)[0]
        out[often] = bucket_of(run[often], buckets)
        return out


def _summed(key: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, a row that has each, and the columns added up by key."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], order[at], *(np.add.reduceat(c[order], at) if len(at) else c for c in columns)


def _groups(ordered: np.ndarray) -> Iterator[tuple[int, int]]:
    """From where to where each value stands."""
    if len(ordered):
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        yield from zip(begin.tolist(), [*begin[1:].tolist(), len(ordered)], strict=True)


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (kind 0) and pairs (1) that a chunk's tokens often have as context, and the number of tokens (2)."""
    words, pairs, total = [], [], 0
    for _, buf, off in K.chunks(batches, "text", FREQUENT_BYTES):
        tokens, at = tokens_of(buf, off)
        u, v = before(tokens, at, START, NONE)
        total += len(tokens)
        least = max(FREQUENT_SHARE * len(tokens), 2)
        name, count = np.unique(v, return_counts=True)
        name, count = name[count >= least], count[count >= least]
        words.append((name, count))
        often = slots(name[count >= LEAST_SHARE * len(tokens)], v)[0]
        name, count = np.unique(pair_key(u[often], v[often]), return_counts=True)
        keep = count >= max(LEAST_SHARE * len(tokens), 2)
        pairs.append((name[keep], count[keep]))
    for kind, held in ((0, words), (1, pairs)):
        if held:
            name, _, count = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(name), kind, np.int32)), pa.array(name.view(np.int64)), pa.array(count)], names=["kind", "name", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["kind", "name", "n"])


def _bytes(ids: np.ndarray) -> np.ndarray:
    """48-bit ids as six bytes each."""
    return np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _pack(*streams: np.ndarray) -> bytes:
    """Arrays of numbers, compressed; two-byte ones with their low bytes first."""
    parts = [np.ascontiguousarray(s.view(np.uint8).reshape(-1, s.itemsize).T if s.ndim == 1 else s).tobytes() for s in streams]
    head = np.array([len(parts), *map(len, parts)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *parts]))


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays again; kind 'id' for six bytes an id."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    sizes = np.frombuffer(raw, np.uint32, len(kinds) + 1)[1:]
    at, out = 4 * (len(kinds) + 1), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        part = np.frombuffer(raw, np.uint8, size, at)
        if kind == "id":
            wide = np.zeros((size // 6, 8), np.uint8)
            wide[:, :6] = part.reshape(-1, 6)
            out.append(wide.view("<u8").ravel())
        else:
            width = np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(part.reshape(width, -1).T).view(kind).ravel())
        at += size
    return out


def _short(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as a byte each; those from 255 on follow by themselves."""
    return np.minimum(count, 255).astype(np.uint8), count[count >= 255].astype(np.uint64)


def _long(short: np.ndarray, rest: np.ndarray) -> np.ndarray:
    out = short.astype(np.int64)
    out[short == 255] = rest
    return out


#: Of u, v, w: codes, hashes of those without. Lengths of the runs of v and of (u, v); counts.
RUN_KINDS = ("u2", "id", "u2", "id", "u2", "id", "u1", "u8", "u1", "u8", "u1", "u8")


def _pack_runs(u, v, w, count, names, codes) -> bytes:
    """Summed runs in order of (v, u), as ids into names."""
    new_v = np.concatenate([[True], v[1:] != v[:-1]])
    new_u = new_v | np.concatenate([[True], u[1:] != u[:-1]])
    at_u, at_v = np.flatnonzero(new_u), np.flatnonzero(new_v)
    per_v = np.diff(np.append(np.flatnonzero(new_v[at_u]), len(at_u)))
    per_u = np.diff(np.append(at_u, len(u)))
    out = []
    for ids in (u[at_u], v[at_v], w):
        code = codes[ids]
        out += [code, _bytes(names[ids[code == CODES]])]
    return _pack(*out, *_short(per_v), *_short(per_u), *_short(count))


def _unpack_runs(data: bytes, coded: np.ndarray) -> tuple[np.ndarray, ...]:
    got = _unpack(data, *RUN_KINDS)
    words = []
    for code, rest in zip(got[:6:2], got[1:6:2], strict=True):
        word = np.empty(len(code), K.U64)
        known = code != CODES
        word[known] = coded[code[known]]
        word[~known] = rest
        words.append(word)
    per_v, per_u, count = (_long(*got[k : k + 2]) for k in (6, 8, 10))
    u, v, w = words
    return np.repeat(u, per_u), np.repeat(np.repeat(v, per_v), per_u), w, count


RUNS = "bucket int, data binary"


def _deal_runs(sent, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot: Hot = sent.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            tokens = np.concatenate([t for t, _ in held])
            at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in held]))])
            held.clear()
            names, w = np.unique(tokens, return_inverse=True)
            codes = hot.codes(names)
            order = np.argsort(codes, kind="stable")  # frequent words have small ids
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            names, codes = np.append(names[order], [START, NONE]), np.append(codes[order], hot.codes(np.array([START, NONE])))
            w = place[w]
            u, v = before(w, at, len(names) - 2, len(names) - 1)
            del tokens, place
            bits = len(names).bit_length()
            if 3 * bits <= 63:
                packed, count = np.unique(v << 2 * bits | u << bits | w, return_counts=True)
                u, v, w = packed >> bits & (1 << bits) - 1, packed >> 2 * bits, packed & (1 << bits) - 1
                del packed
            else:
                order = np.lexsort((w, u, v))
                u, v, w = u[order], v[order], w[order]
                new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
                count = np.diff(np.append(new, len(u)))
                u, v, w = u[new], v[new], w[new]
            pair = pair_key(names[u], names[v])
            bucket = hot.run_bucket(names[v], pair, pair_key(pair, names[w]), buckets)
            del pair
            order = np.argsort(bucket, kind="stable")
            u, v, w, count, bucket = (x[order] for x in (u, v, w, count, bucket))
            parts = list(_groups(bucket))
            data = [_pack_runs(u[b:e], v[b:e], w[b:e], count[b:e], names, codes) for b, e in parts]
            return pa.RecordBatch.from_arrays([pa.array([bucket[b] for b, _ in parts], pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

        for _, buf, off in K.chunks(batches, "text"):
            held.append(tokens_of(buf, off))
            size += len(held[-1][0])
            if size >= FLUSH_TOKENS:
                yield flush()
                size = 0
        if held:
            yield flush()
        K.release()

    return run


class Table:
    """Sorted 48-bit keys, each with some counts: a byte a count, and whole the rows with one beyond a byte."""

    def __init__(self, high, low, small, big):
        self.high, self.low, self.small, self.big = high, low, small, big

    @staticmethod
    def parts(key: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
        values = np.stack([np.asarray(c, np.int64) for c in columns])
        large = np.flatnonzero((values >= 255).any(0))
        return [
            (key >> K.U64(16)).astype(np.uint32),
            (key & K.U64(0xFFFF)).astype(np.uint16),
            np.minimum(values, 255).astype(np.uint8),
            np.concatenate([large[None], values[:, large]]).astype(np.int64),
        ]

    def get(self, key: np.ndarray) -> np.ndarray:
        """The counts of each (sorted) key, a row per count; zeros where it isn't there."""
        high, low = (key >> K.U64(16)).astype(np.uint32), (key & K.U64(0xFFFF)).astype(np.uint16)
        slot = np.searchsorted(self.high, high)
        place = np.full(len(key), -1)
        todo = np.arange(len(key))
        while len(todo):  # keys alike in their high part are few
            todo = todo[slot[todo] < len(self.high)]
            todo = todo[self.high[slot[todo]] == high[todo]]
            hit = self.low[slot[todo]] == low[todo]
            place[todo[hit]] = slot[todo[hit]]
            todo = todo[~hit]
            slot[todo] += 1
        out = np.zeros((len(self.small), len(key)), np.int64)
        found = np.flatnonzero(place >= 0)
        out[:, found] = self.small[:, place[found]]
        large = found[(out[:, found] == 255).any(0)]
        if len(large):
            out[:, large] = self.big[1:, np.searchsorted(self.big[0], place[large])]
        return out


def save_tables(path: str, tables: list[list[np.ndarray]]) -> None:
    """One file: the sizes of every table, then its parts, each from a multiple of eight bytes on."""
    from pyspark import TaskContext

    head = np.array([(len(p[0]), len(p[2]), p[3].shape[1]) for p in tables], np.int64)
    pieces = [head.tobytes()]
    for table in tables:
        for part in table:
            raw = part.tobytes()
            pieces += [raw, bytes(-len(raw) % 8)]
    write_file(path, b"".join(pieces), str(TaskContext.get().taskAttemptId()))


def open_tables(path: str, n: int) -> list[Table]:
    """The tables of a file, mapped where it is mounted; empty ones where there is none."""
    try:
        here = local_path(path)
        raw = np.memmap(here, np.uint8, "r") if here else np.frombuffer(open_file(path).getbuffer(), np.uint8)
    except FileNotFoundError:
        return []
    at, out = 24 * n, []
    for rows, columns, large in raw[:at].view(np.int64).reshape(n, 3).tolist():
        parts = []
        for kind, shape in ((np.uint32, (rows,)), (np.uint16, (rows,)), (np.uint8, (columns, rows)), (np.int64, (columns + 1, large))):
            size = int(np.prod(shape)) * np.dtype(kind).itemsize
            parts.append(raw[at : at + size].view(kind).reshape(shape))
            at += size + -size % 8
        out.append(Table(*parts))
    return out


def _counts_of_counts(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def _by_context(context: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with their numbers of words counted 1, 2 and more, and their total beyond 1, 2 and 3 of those."""
    name, _, n1, n2, n3, total = _summed(context, *((x).astype(np.int64) for x in (count == 1, count == 2, count > 2)), count)
    return name, np.stack([n1, n2, n3, total - n1 - 2 * n2 - 3 * n3])


#: Statistics that Spark sums: counts of counts of runs, pairs and words; hot words and hot pairs as contexts.
RUN_COUNTS, PAIR_COUNTS, WORD_COUNTS, HOT_WORD, HOT_PAIR = range(1, 6)
NUMBERS = 8


def _stat(kind: int, numbers, name: int = 0) -> np.ndarray:
    return np.array([kind, name, *numbers, *[0] * (NUMBERS - len(numbers))], np.int64)


def _hot_stats(kind: int, name: np.ndarray, stats: np.ndarray) -> list[np.ndarray]:
    return [_stat(kind, s, n) for n, s in zip(name.view(np.int64).tolist(), stats.T.tolist(), strict=True)]


#: kind 0: words dealt on; 1: pairs of hot words dealt on; 2: statistics.
LOWER = "kind int, bucket int, data binary"
WORD_KINDS, PAIR_KINDS = ("id", "u1", "u8", "u1", "u8"), ("id", "id", "u1", "u8", "u1", "u8")


def _lower_rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)], names=["kind", "bucket", "data"])


def _dealt(kind: int, to: np.ndarray, ids: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """A row for each bucket that gets something."""
    order = np.argsort(to, kind="stable")
    to, ids, counts = to[order], [x[order] for x in ids], [x[order] for x in counts]
    for b, e in _groups(to):
        yield kind, int(to[b]), _pack(*(_bytes(x[b:e]) for x in ids), *(s for c in counts for s in _short(c[b:e])))


def _write_runs(folder: str, sent, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _lower_rows([])
        hot: Hot = sent.value
        bucket = table["bucket"][0].as_py()
        u, v, w, count = (np.concatenate(x) for x in zip(*(_unpack_runs(d.as_py(), hot.coded) for d in table["data"]), strict=True))
        pair = pair_key(u, v)
        run_key, first, count = _summed(pair_key(pair, w), count)
        v, w, pair = v[first], w[first], pair[first]
        del u, first
        later = v != START
        name, stats = _by_context(pair[later], count[later])
        often = slots(hot.pairs, name)[0]
        numbers = [_stat(RUN_COUNTS, _counts_of_counts(count[later])), *_hot_stats(HOT_PAIR, name[often], stats[:, often])]
        kept = ~often & ((stats * [[1], [2], [3], [1]]).sum(0) > 1)
        tables = [Table.parts(run_key[later] >> K.U64(16), count[later]), Table.parts(name[kept] >> K.U64(16), *stats[:, kept])]
        del run_key, pair, name, stats
        key, first, types, raw = _summed(pair_key(v, w), np.where(later, 1, count), count)
        v, w = v[first], w[first]
        often = slots(hot.words, v)[0]
        rows = list(_dealt(1, bucket_of(w[often], buckets), [v[often], w[often]], [types[often], raw[often]]))
        key, v, w, types, raw = (x[~often] for x in (key, v, w, types, raw))
        numbers.append(_stat(PAIR_COUNTS, _counts_of_counts(types)))
        name, stats = _by_context(v, types)
        kept = (stats * [[1], [2], [3], [1]]).sum(0) > 1
        tables += [Table.parts(key >> K.U64(16), types), Table.parts(name[kept], *stats[:, kept])]
        save_tables(f"{folder}/runs-{bucket:07d}", tables)
        word, _, cont, raw = _summed(w, np.ones(len(w), np.int64), raw)
        rows += _dealt(0, bucket_of(word, buckets), [word], [cont, raw])
        return _lower_rows([*rows, (2, bucket, np.stack(numbers).tobytes())])

    return run


#: Per row: a statistic's kind, the context that it is about, its numbers.
STATS = "kind bigint, name bigint, " + ", ".join(f"n{k} bigint" for k in range(NUMBERS))


def _write_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
        numbers = [np.frombuffer(d, np.int64).reshape(-1, NUMBERS + 2) for k, d in zip(kinds, data, strict=True) if k == 2]

        def of(kind: int, ids: int, layout: tuple[str, ...]) -> list[np.ndarray]:
            got = [_unpack(d, *layout) for k, d in zip(kinds, data, strict=True) if k == kind]
            got = [[*g[:ids], _long(*g[ids : ids + 2]), _long(*g[ids + 2 :])] for g in got]
            return [np.concatenate(x) for x in zip(*got, strict=True)] or [np.zeros(0, K.U64)] * ids + [np.zeros(0, np.int64)] * 2

        if 0 in kinds or 1 in kinds:
            bucket = table["bucket"][0].as_py()
            v, w, types, raw = of(1, 2, PAIR_KINDS)
            key, first, types, raw = _summed(pair_key(v, w), types, raw)
            v, w = v[first], w[first]
            numbers.append(_stat(PAIR_COUNTS, _counts_of_counts(types))[None])
            numbers += [s[None] for s in _hot_stats(HOT_WORD, *_by_context(v, types))]
            word, cont, often = of(0, 1, WORD_KINDS)
            word, _, cont, raw = _summed(np.append(word, w), np.append(cont, np.ones(len(w), np.int64)), np.append(often, raw))
            save_tables(f"{folder}/words-{bucket:07d}", [Table.parts(key >> K.U64(16), types), Table.parts(word, cont, raw)])
            numbers.append(_stat(WORD_COUNTS, [*_counts_of_counts(cont), len(word), int(cont.sum()), int(raw.sum()), int((cont > 2).sum())])[None])
        rows = np.concatenate(numbers) if numbers else np.zeros((0, NUMBERS + 2), np.int64)
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in rows.T], names=["kind", "name", *(f"n{k}" for k in range(NUMBERS))])

    return run


def discounts(n: list[int]) -> np.ndarray:
    """D1, D2, D3+ from the numbers of entries counted 1, 2, 3 and 4 times; index by min(count, 3)."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


def less(count: np.ndarray, discount: np.ndarray) -> np.ndarray:
    return np.where(count > 0, count - discount[np.minimum(count, 3)], 0)


class Model:
    """The small part of a model (sent to tasks) and, in a task, its mapped tables."""

    #: Files mapped at once.
    MAPPED = 8192

    def __init__(self, folder: str, buckets: int, hot: Hot, rows: list):
        self.folder, self.buckets, self.hot = folder, buckets, Hot(hot.words, hot.pairs, np.zeros(0, K.U64))
        sums, words = {k: np.zeros(4, np.int64) for k in (RUN_COUNTS, PAIR_COUNTS)}, np.zeros(NUMBERS, np.int64)
        self.hot_words, self.hot_pairs = np.zeros((4, len(hot.words)), np.int64), np.zeros((4, len(hot.pairs)), np.int64)
        for kind, name, *numbers in rows:
            if kind == WORD_COUNTS:
                words += numbers
            elif kind in sums:
                sums[kind] += numbers[:4]
            else:
                names, stats = (hot.words, self.hot_words) if kind == HOT_WORD else (hot.pairs, self.hot_pairs)
                stats[:, np.searchsorted(names, np.int64(name).view(K.U64))] += numbers[:4]
        self.high, self.middle, self.low = discounts(sums[RUN_COUNTS].tolist()), discounts(sums[PAIR_COUNTS].tolist()), discounts(words[:4].tolist())
        self.vocabulary, self.continuations, self.train_tokens = (int(x) for x in words[4:7])
        self.spare = float((self.low[1:] * [words[0], words[1], words[7]]).sum() / max(self.continuations, 1))
        self.maps: dict = {}

    def __getstate__(self):
        return {**self.__dict__, "maps": {}}

    def tables(self, file: str, bucket: int) -> list[Table]:
        key = file, bucket
        if key not in self.maps:
            while len(self.maps) >= self.MAPPED:
                self.maps.pop(next(iter(self.maps)))
            self.maps[key] = open_tables(f"{self.folder}/{file}-{bucket:07d}", 4 if file == "runs" else 2)
        return self.maps[key]

    def find(self, file: str, which: int, columns: int, bucket: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The counts of keys, each in its bucket's table."""
        out = np.zeros((columns, len(key)), np.int64)
        order = np.argsort(bucket.astype(K.U64) << K.U64(48) | key) if self.buckets < 1 << 16 else np.lexsort((key, bucket))
        bucket, key = bucket[order], key[order]
        for b, e in _groups(bucket):
            if tables := self.tables(file, int(bucket[b])):
                out[:, order[b:e]] = tables[which].get(key[b:e])
        return out

    def weights(self, stats: np.ndarray, seen: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Totals of contexts and what they leave to the level below; seen but not stored: one word, once."""
        total = np.array([1, 2, 3, 1]) @ stats
        left = np.where(total > 0, discount[1:] @ stats[:3] / np.maximum(total, 1), np.where(seen, discount[1], 1.0))
        return np.maximum(total, 1), left

    def log10(self, tokens: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each token after those before it in its text, and its training count."""
        word, where = np.unique(tokens, return_inverse=True)
        cont, raw = self.find("words", 1, 2, bucket_of(word, self.buckets), word)
        low = less(cont, self.low) / max(self.continuations, 1) + (self.spare if self.continuations else 1.0) / (self.vocabulary + 1)

        u, v = before(tokens, at, START, NONE)
        _, after = before(where, at, len(word), 0)  # the word before, as a slot
        context = np.append(word, START)
        stats = self.find("runs", 3, 4, bucket_of(context, self.buckets), context)
        often, slot = slots(self.hot.words, context)
        stats[:, often] = self.hot_words[:, slot[often]]
        total, left = self.weights(stats, np.append(raw > 0, self.train_tokens > 0), self.middle)
        key = pair_key(v, tokens) >> K.U64(16)
        often = often[after]
        types = np.zeros(len(tokens), np.int64)
        types[~often] = self.find("runs", 2, 1, bucket_of(v[~often], self.buckets), key[~often])[0]
        types[often] = self.find("words", 0, 1, bucket_of(tokens[often], self.buckets), key[often])[0]
        middle = less(types, self.middle) / total[after] + left[after] * low[where]

        later = np.ones(len(tokens), bool)
        later[at[:-1]] = False
        seen = np.concatenate([[False], types[:-1] > 0])[later]  # (u, v) was looked up one token before
        pair = pair_key(u[later], v[later])
        run = pair_key(pair, tokens[later])
        stats = self.find("runs", 1, 4, self.hot.context_bucket(v[later], pair, self.buckets), pair >> K.U64(16))
        often, slot = slots(self.hot.pairs, pair)
        stats[:, often] = self.hot_pairs[:, slot[often]]
        total, left = self.weights(stats, seen, self.high)
        count = self.find("runs", 0, 1, self.hot.run_bucket(v[later], pair, run, self.buckets), run >> K.U64(16))[0]
        middle[later] = less(count, self.high) / total + left * middle[later]
        return np.log10(middle), raw[where]


def _hot(texts: DataFrame, buckets: int) -> Hot:
    """Bounded by LEAST_SHARE and CODES: at most so many words and pairs can have such a share of all tokens."""
    counted = written(texts.mapInArrow(_frequent, "kind int, name bigint, n bigint").groupBy("kind", "name").agg(F.sum("n").alias("n")))
    ranked = [counted.where(F.col("kind") == kind).orderBy(F.desc("n"), "name").limit(most) for kind, most in ((0, CODES), (1, int(1 / LEAST_SHARE)), (2, 1))]
    rows = ranked[0].unionByName(ranked[1]).unionByName(ranked[2]).collect()
    total = sum(r["n"] for r in rows if r["kind"] == 2)
    least = max(1 / (4 * buckets), LEAST_SHARE) * total
    of = lambda kind, n: np.array([r["name"] for r in rows if r["kind"] == kind and r["n"] >= n], np.int64).view(K.U64)
    return Hot(np.sort(of(0, least)), np.sort(of(1, least)), of(0, 0))


def train(texts: DataFrame) -> Model:
    """Fit on a table with the one column text; the tables go to the shared folder."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (6 * BUCKET_TOKENS)))
    hot = _hot(texts, buckets)
    sent = spark.sparkContext.broadcast(hot)
    folder = f"{shared_folder(spark)}/kneser_ney"
    lower = texts.mapInArrow(_deal_runs(sent, buckets), RUNS).groupBy("bucket").applyInArrow(_write_runs(folder, sent, buckets), LOWER)
    stats = lower.groupBy("bucket").applyInArrow(_write_words(folder), STATS)
    rows = stats.groupBy("kind", "name").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(NUMBERS))).collect()
    return Model(folder, buckets, hot, [tuple(r) for r in rows])


SCORED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for table, buf, off in K.chunks(batches, "text"):
            tokens, at = tokens_of(buf, off)
            log, count = m.log10(tokens, at)
            base = np.log10((count + 1) / (m.train_tokens + 1 * (m.vocabulary + 1)))
            total = lambda x: np.add.reduceat(x, at[:-1])
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), table["held_out"].combine_chunks(), pa.array(np.diff(at)), pa.array(total((count > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(log))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCORED, for a table of doc_id, held_out, text. Perplexity is 10 ** (-score / n_tokens)."""
    return docs.select("doc_id", "held_out", "text").mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), SCORED).withColumn("train_tokens", F.lit(model.train_tokens).cast("bigint"))


def op6_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", (fold_bucket(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    model = train(docs.where(~F.col("held_out")).select("text"))
    rounded = [F.round(c, 6).alias(c) for c in ("base_score", "score")]  # sums of logarithms: alike in any order to six places
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", *rounded)


QUERIES = {"op6_kneser_ney": op6_kneser_ney}
_discount = lambda src: f"""select 1 - 2 * y * n2 / n1 e1, 2 - 3 * y * n3 / n2 e2, 3 - 4 * y * n4 / n3 e3 from (select *, n1 / (n1 + 2 * n2) y from
  (select count(*) filter (n = 1)::double n1, count(*) filter (n = 2)::double n2, count(*) filter (n = 3)::double n3, count(*) filter (n = 4)::double n4 from {src}))"""  # noqa: E731
_clip = lambda src: f"select least(greatest(e1, 0.05), 0.95) d1, least(greatest(e2, 0.05), 1.95) d2, least(greatest(e3, 0.05), 2.95) d3 from ({_discount(src)})"
#: crc32 in SQL: eight table steps a byte, the table itself from the polynomial.
_CRC = """crc_t as (with recursive t(i, k, c) as (select i::bigint, 0, i::bigint from range(256) x(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from t where k < 8) select list(c order by i) tab from t where k = 8),
crc as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(coalesce(doc_id::varchar, ''), ''), lambda ch: ascii(ch)::bigint)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) crc from (select distinct doc_id from documents), crc_t)"""
ORACLE = {
    "op6_kneser_ney": rf"""
with {_CRC},
d as (select doc_id, crc % 7 = 2 held_out, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) w from documents join crc using (doc_id)),
t as (select doc_id, held_out, i, case when i > 2 then w[i - 2] else chr(9) end u, case when i = 1 then chr(9) else w[i - 1] end v, w[i] w from (select *, unnest(range(1, len(w) + 1)) i from d)),
a as (select u, v, w, count(*) n from t where not held_out and i > 1 group by u, v, w),
b as (select v, w, case v when chr(9) then sum(n) else count(*) end n, sum(n)::bigint raw from (select u, v, w, n from a union all select null, v, w, count(*) from t where not held_out and i = 1 group by v, w) group by v, w),
u as (select w, count(*) n, sum(raw)::bigint raw from b group by w),
x as (select u, v, sum(n)::double tot3, count(*) filter (n = 1) j1, count(*) filter (n = 2) j2, count(*) filter (n > 2) j3 from a group by u, v),
c as (select v, sum(n)::double tot, count(*) filter (n = 1) k1, count(*) filter (n = 2) k2, count(*) filter (n > 2) k3 from b group by v),
g as (select sum(raw)::double big_n, count(*)::double big_v, sum(n)::double a, count(*) filter (n = 1) m1, count(*) filter (n = 2) m2, count(*) filter (n > 2) m3 from u),
top as (select d1 e1, d2 e2, d3 e3 from ({_clip("a")})), hi as ({_clip("b")}), lo as (select d1 f1, d2 f2, d3 f3 from ({_clip("u")})),
s as (select t.*, coalesce(u.raw, 0) raw, (case when u.n is null then 0 else u.n - case u.n when 1 then f1 when 2 then f2 else f3 end end) / g.a + (f1 * m1 + f2 * m2 + f3 * m3) / g.a / (big_v + 1) low,
  case when b.n is null then 0 else b.n - case b.n when 1 then d1 when 2 then d2 else d3 end end num, coalesce(tot, 1) tot, case when c.v is null then 1 else (d1 * k1 + d2 * k2 + d3 * k3) / tot end gam,
  case when a.n is null then 0 else a.n - case a.n when 1 then e1 when 2 then e2 else e3 end end num3, coalesce(tot3, 1) tot3, case when x.v is null then 1 else (e1 * j1 + e2 * j2 + e3 * j3) / tot3 end gam3, big_n, big_v
  from t left join u on u.w = t.w left join b on b.v = t.v and b.w = t.w left join c on c.v = t.v left join x on t.i > 1 and x.u = t.u and x.v = t.v left join a on t.i > 1 and a.u = t.u and a.v = t.v and a.w = t.w, g, top, hi, lo)
select doc_id, held_out, count(*) n_tokens, count(*) filter (raw > 0) n_known, any_value(big_n)::bigint train_tokens, round(sum(log10((raw + 1) / (big_n + big_v + 1))), 6) base_score, round(sum(log10(num3 / tot3 + gam3 * (num / tot + gam * low))), 6) score from s group by doc_id, held_out"""
}
