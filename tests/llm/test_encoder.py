"""The packing stage's encoder: what a worker holds between texts, and that what it holds changes no ids."""

import random
import tracemalloc

import numpy as np
import pytest

from millrace.llm import packing, transducer
from millrace.llm.queries import tokenizer_path

PATH = tokenizer_path()


def _texts(words, seed):
    rng = random.Random(seed)
    letters = "abcdefghiklmnoprstuvé日"
    return [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 9))) for _ in range(200)) for _ in range(words // 200)]


def _same(encoder, texts):
    want = [x.ids for x in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
    return [ids.tolist() for ids in encoder.encode(texts)] == want


def test_known_spellings_take_little_memory():
    texts, encoder = _texts(150_000, 1), packing.Encoder(PATH)
    list(encoder.encode(texts[:1]))  # tables of fixed size
    tracemalloc.start()
    for k in range(0, len(texts), 100):
        for _ in encoder.encode(texts[k : k + 100]):
            pass
    held, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    spellings = len(set("".join(" " + t + "\n" for t in texts).split()))
    assert spellings > 80_000
    assert held < 100 * spellings, held / spellings  # with room to grow in; as objects 152
    assert most < held + 40_000_000


def test_known_spellings_change_no_ids(monkeypatch):
    encoder, texts = packing.Encoder(PATH), _texts(20_000, 2)
    assert _same(encoder, texts) and _same(encoder, texts[::-1]) and _same(encoder, _texts(20_000, 3) + texts)
    assert (np.diff(encoder.hash.astype(object)) > 0).all() and len(encoder.hash) == len(encoder.number) == encoder.ids.count
    n = encoder.ids.count
    assert _same(encoder, texts) and encoder.ids.count == n
    monkeypatch.setattr(packing, "_POOL_MOST", 500)
    monkeypatch.setattr(packing, "_AT_ONCE", 7)
    assert all(_same(encoder, texts[k : k + 2]) for k in range(0, 40, 2)) and encoder.ids.count <= 500
    monkeypatch.setattr(packing, "_BYTES_MOST", 1000)
    assert _same(encoder, [*texts[:2], "x" * 5000]) and encoder.ids.count == 0


@pytest.mark.parametrize("alike", [1, 3])
def test_spellings_of_one_hash_are_told_apart(monkeypatch, alike):
    """With all bytes alike to the hash, it tells spellings by their lengths alone."""
    power, inverse, noise = transducer._powers(1 << 20)
    monkeypatch.setattr(transducer, "_powers", lambda n: (power[:n], inverse[:n], noise // np.uint64(alike) * np.uint64(0) + np.uint64(alike)))
    encoder = packing.Encoder(PATH)
    assert all(_same(encoder, [t]) for t in ("ab cd ab", "cd ab ef", "ef gh", "", "ab é gh i j k"))
    assert len(encoder.hash) == len(set(encoder.hash.tolist()))
