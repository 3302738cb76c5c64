"""The join's readings of the texts: words hashed by word, and only the sets that may link read again."""

import types

import numpy as np
import pyarrow as pa

from tessera.llm import common
from tessera.llm import jaccard_join as J
from tessera.llm import kernel as K
from tests.llm import tables
from tests.llm.test_jaccard_join import brute_force


def hashed(texts):
    buf, off = K.text_buffer(pa.array(texts, pa.binary()))
    return K.words(buf, off, K.SPACE_WORD)[0].tolist()


def test_word_hashes_tell_words_apart_wherever_they_stand(monkeypatch):
    """Lengths around the eight bytes of a step and the limit of short words; zero bytes, case, place and cut."""
    rng = np.random.default_rng(1)
    letters = np.frombuffer(b"abYZ\x00\xff@[{", np.uint8)
    made = [bytes(rng.choice(letters, n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 63, 64, 65, 72, 73, 500) for _ in range(40)]
    made += [b"a", b"a\x00", b"a" * 8, b"a" * 8 + b"\x00", b"a" * 16, b"a" * 64, b"a" * 64 + b"\x00"]
    together = hashed([b" ".join(made)])
    assert together == hashed(made) == [h for w in made for h in hashed([b"x " + w])[1:]]
    assert together == hashed([w.upper() for w in made])
    lower = [w.lower() for w in made]
    assert len(set(together)) == len(set(lower)) == len(set(zip(lower, together, strict=True)))
    monkeypatch.setattr(K, "CHUNK_BYTES", 100)
    assert together == hashed([b" ".join(made)])


def test_words_are_not_hashed_byte_by_byte(monkeypatch):
    spans = []
    plain = K._hash_piece
    monkeypatch.setattr(K, "_hash_piece", lambda buf, starts, ends: spans.append(len(buf)) or plain(buf, starts, ends))
    hashed([b"short words " * 1000, b"x" * 70])
    assert spans == [70]


def test_only_texts_asked_for_are_hashed_again(monkeypatch):
    texts = [tables.prose(50, k) for k in range(40)]
    hashes = np.arange(40, dtype=np.int64) * 1_000_003
    bits = np.zeros(1 << 13, np.uint8)
    slot = common._bit(hashes[[3, 17]], 8 * len(bits))
    np.bitwise_or.at(bits, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
    read = []
    plain = K.words
    monkeypatch.setattr(K, "words", lambda buf, off, word: read.append(len(off) - 1) or plain(buf, off, word))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 10]), pa.array(hashes[k : k + 10])], names=["text", "__text_hash"]) for k in range(0, 40, 10)]
    run = J._read_sets("text", "__text_hash", 5, types.SimpleNamespace(value=bits.tobytes()))
    got = [r for b in run(iter(batches)) for r in b.to_pylist()]
    assert sum(read) == len(got) == 2
    assert [len(r["tokens"]) // 8 for r in got] == [46, 46]


def test_one_text_stands_for_all_that_have_its_set(spark):
    """Texts of one set differ in case and blanks; near copies of it must still find it."""
    rows = []
    for k in range(12):
        base = tables.prose(60, k).split()
        near = [*base[:30], "changed", *base[31:]]
        rows += [(10 * k + j, glue.join(w), "en", "s", 0) for j, (w, glue) in enumerate([(base, " "), (base, "  "), (base, "\n"), (near, " "), (near, "\t")])]
        rows.append((10 * k + 5, " ".join(base).upper(), "en", "s", 0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicate_components(tables.frame(spark, rows)).collect()}
    assert got == brute_force((r[0], r[1]) for r in rows)
    assert got[5][1] == got[4][1] == 0
