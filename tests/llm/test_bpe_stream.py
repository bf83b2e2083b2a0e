"""The streaming encoder against the library, the lookahead against brute force, and decoding byte by byte."""
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from noticeflow.llm import bpe_stream as B

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    with open(PATH, "rb") as f:
        return B.Merges(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def odd_texts():
    r = random.Random(11)
    signs = [chr(c) for c in (32, 32, 9, 10, 13, 0x85, 0xA0, 0x3000, 0x1C, 0x200B, *range(33, 127), 0xE9, 0x4E2D, 0x1F600, 0x661)]
    parts = ["'re", "'s", " ", "  ", "abc", "1", "<|endoftext|>", "<|endof", "\n", "the", "'r", "e", "ll", "'l", "l", "　"]
    out = ["", " ", "a ", "a  b", "it's  I'LL", "\n \n", "<|endoftext|> x", "a<|endoftext|>", "<|endoftext|><|endoftext|"]
    out += ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(600)]
    return out + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(600)]


def long_texts():
    r = random.Random(12)
    return ["x" * 3000 + " y z", " " * 3000 + "x", "\n" * 2500, "\n" * 500 + " " + "é" * 1500, "!?" * 1500, "0123" * 700, "the" * 900,
            "".join(r.choice("abcdethin") for _ in range(4000))]


@pytest.mark.parametrize("chunk, block, texts", [(B.CHUNK, B.BLOCK, odd_texts() + long_texts()), (7, 300, odd_texts()), (500, 200, long_texts())])
def test_ids_equal_the_library(merges, library, chunk, block, texts):
    encoder = B.Encoder(merges, chunk, block)
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:80]
        assert B.decode(merges, ids, 8) == library.decode(want, skip_special_tokens=False) == text


def test_what_has_left_is_never_changed_by_what_follows(merges):
    """Tokens that end before the lookahead are the same for every one of many continuations."""
    r = random.Random(13)
    words = [t for t in merges.bytes_of.values() if t.isalpha()]
    for _ in range(20):
        start = b"".join(r.choice(words) for _ in range(150))
        way = B.Transducer(merges, 64)
        left = way.feed(start)
        assert left
        for _ in range(10):
            whole = merges.merge(start + b"".join(r.choice(words) for _ in range(r.randrange(60))))
            assert whole[:len(left)] == left


def test_the_lookahead_of_a_small_list(tmp_path):
    """a+b, ab+c, x+abc: c can reach back over ab, then over x; a lookahead of three bytes, and two would not do."""
    import json
    letters = B.byte_letters()
    merges = [["a", "b"], ["ab", "c"], ["x", "abc"]]
    vocab = {c: i for i, c in enumerate([*letters, "ab", "abc", "xabc"])}
    cut = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": cut, "normalizer": None,
            "post_processor": None, "added_tokens": []}
    small = B.Merges(json.dumps(spec).encode())
    assert small.lookahead == 3
    assert small.merge(b"xab")[:1] != small.merge(b"xabc")[:1]
    spec["model"]["merges"] = merges[::-1]
    with pytest.raises(ValueError, match="no earlier merge"):
        B.Merges(json.dumps(spec).encode())
    with pytest.raises(ValueError, match="normalizer"):
        B.Merges(json.dumps({**spec, "normalizer": {"type": "Lowercase"}}).encode())


def test_a_long_piece_holds_little(merges):
    way, most = B.Transducer(merges), 0
    ids = []
    for _ in range(200):
        ids += way.feed(b"thing" * 100)
        most = max(most, len(way.held))
    assert most < B.BLOCK + merges.lookahead + 1000
    assert ids + way.finish() == merges.merge(b"thing" * 20_000)


def test_broken_bytes_decode_as_in_the_library(merges, library):
    r = random.Random(14)
    for ids in ([255 - i for i in range(100)], [r.randrange(256) for _ in range(3000)], [r.randrange(50257) for _ in range(3000)]):
        assert B.decode(merges, B.raw(ids), 4) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, make, edge_rows, library):
    got = B.stream_documents(spark, make(edge_rows), PATH)
    want = Counter((r[0], np.array(library.encode(r[1] or "", add_special_tokens=False).ids, "<u4").tobytes(), r[1] or "") for r in edge_rows)
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in got.collect()) == want
    assert B.stream_documents(spark, make([]), PATH).count() == 0
