"""Word hashes do not depend on where a buffer is cut."""

import numpy as np

from tessera.llm import kernel as K


def test_hashes_by_piece_equal_hashes_at_once():
    rng = np.random.default_rng(0)
    buf = rng.choice(np.frombuffer(b"abcDEF  \n", np.uint8), 4_000_000)
    buf[1_000_000:3_500_000] = 97  # one word longer than a piece
    starts, ends, _ = K.word_bounds(buf, np.array([0, 10, 10, 2_000_000, len(buf)]), K.SPACE_WORD)
    assert (K.hash_spans(buf, starts, ends) == K._hash_piece(buf, starts, ends)).all()
    assert len(K.hash_spans(buf, starts[:0], ends[:0])) == 0
