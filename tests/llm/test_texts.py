"""Quality, fingerprints, languages and tokens against brute force, exact round trips and held-out accuracy."""
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from noticeflow.llm import bpe
from noticeflow.llm.language import UNDETERMINED, identify, profiles
from noticeflow.llm.quality import quality, text_view
from noticeflow.llm.winnowing import edit_likeness, fingerprints

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.parse_ranks(bpe.read_ranks(RANKS)), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.vocabulary.ranks, special_tokens={})


def odd_texts():
    r = random.Random(4)
    signs = [chr(c) for c in (32, 32, 9, 10, 13, 0x85, 0xA0, 0x3000, 0x1C, 0x200B, *range(33, 127), 0xE9, 0x4E2D, 0x1F600, 0x661)]
    out = ["", " ", "  ", " a", "a ", "a  b", "it's  I'LL", "\n \n", "<|endoftext|> x", "aaaa" * 600, "the" * 500 + " ", "x" * 3000 + " y z"]
    return out + ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(1500)]


def test_tokens_equal_the_library(encoder, reference):
    texts = odd_texts()
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), text
        assert encoder.decode(ids) == text.encode()


def test_cutting_at_spaces_first_changes_nothing(encoder):
    whole = bpe.Encoder(encoder.vocabulary.ranks, public_tokenizers.PATTERN, words=False)
    texts = odd_texts()
    assert encoder.encode(texts) == whole.encode(texts)


def test_a_long_piece_is_the_same_by_heap_and_by_matrix(encoder):
    r = random.Random(5)
    for piece in (b"a" * 1000, bytes(r.choice(b"abcde") for _ in range(900)), "né".encode() * 300):
        assert encoder.vocabulary.merge_long(piece) == encoder.vocabulary.merge_matrix([piece])[0]


def test_encoded_rows(spark, make, edge_rows, reference):
    got = bpe.encode_documents(spark, make(edge_rows), RANKS, public_tokenizers.PATTERN)
    want = Counter((r[0], np.array(reference.encode_ordinary(r[1] or ""), "<u4").tobytes(), (r[1] or "").encode()) for r in edge_rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect()) == want
    assert bpe.encode_documents(spark, make([]), RANKS, public_tokenizers.PATTERN).count() == 0
    digest = bpe.token_digests(got, ["doc_id"]).filter("doc_id = 4").first()
    assert (digest.n_tokens, digest.decoded_sha256) == (1, hashlib.sha256(b"one").hexdigest())


def winnow_brute(text, k=5, w=16):
    """Places of the picked runs, given each run's hash by the engine."""
    words = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text) if x]
    return words, max(0, len(words) - k + 1)


def test_winnowing_picks_the_rightmost_minimum_of_each_window(spark, make):
    texts = {1: " ".join("ab"[i % 2] for i in range(80)), 2: " ".join(str(i * i % 97) for i in range(120)), 3: "a b c", 4: ""}
    got = {r.doc_id: r.grams for r in fingerprints(make(list(texts.items()))).collect()}
    for doc in (1, 2):
        words, n = winnow_brute(texts[doc])
        runs = spark.createDataFrame([(i, *words[i:i + 5]) for i in range(n)], "i int, a string, b string, c string, d string, e string")
        hashes = [r[0] & 0xFFFFFFFF for r in runs.orderBy("i").select(F.xxhash64(*[F.xxhash64(c) for c in "abcde"])).collect()]
        want = sorted({max((j for j in range(s, s + 16) if hashes[j] == min(hashes[s:s + 16]))) for s in range(n - 15)})
        assert [(g.hash, g.position) for g in got[doc]] == [(hashes[j], j) for j in want]
    assert len(got[3]) == 1 and got[4] == []


def test_edited_texts_and_neighbours(make, edge_rows):
    rows = [r for r in edge_rows if r[0] is not None]
    got = {r.doc_id: r for r in edit_likeness(make(rows), carry=["doc_id", "fingerprint"]).collect()}
    texts = {r[0]: r[1] or "" for r in rows}
    ids = sorted(texts)
    for a, b in zip(ids, ids[1:] + ids[:1]):
        cut = len(texts[a]) // 4
        edited = texts[a][:len(texts[a]) - cut] + texts[b][:cut]
        assert (got[a].n_chars, got[a].edited_sha256) == (len(texts[a]), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
    assert got[7].fingerprint == got[8].fingerprint and got[7].near_next == 1.0
    assert got[1].fingerprint == "" and got[1].near_next == 1.0 and got[11].near_next < 0.1 and got[11].near_edited > 0.3


def test_edits_of_rows_without_ids_and_small_tables(make, edge_rows):
    assert edit_likeness(make(edge_rows)).count() == len(edge_rows)
    assert edit_likeness(make([])).count() == 0
    one = edit_likeness(make([(1, "abcdefgh")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and one.near_next == 1.0


def test_languages(spark, make):
    r = random.Random(6)
    vocabulary = {"aa": ["the", "and", "with", "house", "thing"], "bb": ["über", "und", "nicht", "schön", "haus"], "cc": ["où", "être", "les", "dans", "eau"]}
    rows = [(i, " ".join(r.choice(vocabulary[x]) for _ in range(12)), None, x) for i, x in enumerate(list(vocabulary) * 20)]
    learned = profiles(make([*rows, (900, None, None, "aa"), (901, "12 34", None, "bb"), (902, "unlabelled", None, None)]))
    assert sorted(learned) == ["aa", "bb", "cc"]
    tests = [*[(500 + i, " ".join(r.choice(v) for _ in range(8)), None, None) for i, v in enumerate(vocabulary.values())],
             (600, None), (601, ""), (602, "12, 3!"), (603, "haus " * 50_000)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in identify(spark, make(tests), learned).collect()}
    assert [got[500 + i][0] for i in range(3)] == ["aa", "bb", "cc"] and all(0 <= s <= 1 for _, s in got.values())
    assert [got[i] for i in (600, 601, 602)] == [(UNDETERMINED, 0.0)] * 3 and got[603][0] == "bb"
    assert identify(spark, make([]), learned).count() == 0
    assert [x.lang_pred for x in identify(spark, make(tests[:1]), {}).collect()] == [UNDETERMINED]


def test_quality_learns_and_keeps_clean_documents(spark, make):
    r = random.Random(8)

    def clean():
        return " ".join(r.choice(["tree", "river", "stone", "walks", "under", "green"]) + r.choice(["", "s", ","]) for _ in range(60)) + "."

    def junk():
        return " ".join(r.choice(["BUY!!", "WIN$$", "x###", "0%%"]) for _ in range(60))

    rows = [(i, junk() if i % 4 == 0 else clean(), "s", "en") for i in range(240)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(160)] + [(None, 1, 0), (5000, 0, 0), (7, None, 0)],
                                   "doc_id long, quality int, toxic int")
    extra = [(900, None, None), (901, "", "s"), (None, clean(), None)]
    got = quality(spark, make(rows + extra), labels)
    kept = {x.doc_id: x.kept for x in got.collect()}
    assert all(kept[i] == (i % 4 != 0) for i in range(160, 240)) and not kept[900] and not kept[901] and kept[None]
    assert quality(spark, make([]), labels).count() == 0
    unlearned = {x.doc_id: x.score for x in quality(spark, make(extra), labels.filter("false")).collect()}
    assert unlearned == {900: 0.0, 901: 0.0, None: 1.0}


def test_text_view_of_a_repeated_word():
    at, value, dense = text_view("again " * 50)
    assert len(at) == 2 and np.allclose(value, 1) and dense[1] == 1.0


def test_short_and_unspaced_texts_keep_what_their_edit_leaves(make):
    r = random.Random(11)
    texts = [" ".join(f"{r.choice('abcdefgh')}{r.randrange(10_000):04}" for _ in range(n)) for n in range(6, 50)]
    texts += ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n)) for n in (40, 60, 200)] + ["x1y2z" * 40]
    got = edit_likeness(make(list(enumerate(texts)))).collect()
    assert [x.doc_id for x in got if x.near_edited == 0] == []
    assert all(x.near_edited < 1 for x in got if x.doc_id < 13)
