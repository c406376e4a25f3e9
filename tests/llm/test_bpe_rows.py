"""Long pieces as one-row matrices, against merging one pair at a time and against the library."""

import base64
import os
import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from razonete.llm import bpe_matrix


def by_single_merges(ranks, piece):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        i = min(pairs)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("shuffled", [False, True])
def test_rounds_equal_single_merges(tmp_path, shuffled):
    """Small vocabularies of three letters; with shuffled ranks a merge can make a pair of a lower rank."""
    rng = random.Random(5)
    for v in range(20):
        extra = {bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 5))) for _ in range(rng.choice([5, 20, 40]))}
        tokens = [bytes([b]) for b in range(256)] + sorted(extra, key=lambda _: rng.random())
        order = list(range(len(tokens)))
        if shuffled:
            rng.shuffle(order)
        ranks = dict(zip(tokens, order))
        path = os.path.join(tmp_path, f"{v}.tiktoken")
        with open(path, "wb") as f:
            f.write(b"\n".join(base64.b64encode(t) + b" %d" % r for t, r in ranks.items()))
        enc = bpe_matrix.BpeEncoder(path, r"(?s).+")
        for k in range(50):
            piece = b"a" * rng.randint(2, 40) if k % 5 == 0 else bytes(rng.choice(b"abc") for _ in range(rng.randint(2, 60)))
            want = by_single_merges(ranks, piece)
            assert np.frombuffer(enc._merge_row(piece), "<u4").tolist() == want
            assert np.frombuffer(enc._merge_matrix([piece], 64)[0], "<u4").tolist() == want


def test_pieces_of_a_megabyte():
    enc = bpe_matrix.BpeEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = random.Random(7)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    for text in ("a" * 1_000_000, letters, " " * 100_000 + "x", "=" * 5_000 + letters[:3_000], "日本語" * 2_000):
        ids, count = enc.encode_batch(pa.array([text], "large_string"))
        assert ids.tolist() == lib.encode_ordinary(text) and count.tolist() == [len(ids)]
        assert enc.decode(ids) == text.encode()
