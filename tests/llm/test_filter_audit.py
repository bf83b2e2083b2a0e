"""The byte pass against plain Python, and the audit against every order applied document by document."""
import random
from collections import Counter
from itertools import permutations

import pytest

from noticeflow.llm import filter_audit as A


def plain(data: bytes) -> list[int]:
    words, text = data.split(), data.decode()
    return [len(words), len(set(words)), sum(65 <= b < 91 for b in data), len(text), sum(b in b"#$%&*|" for b in data)]


def odd_texts():
    r = random.Random(13)
    sizes = (1, 2, 7, 8, 9, 16, 63, 64, 65, 100)
    out = [b"", b" ", b"a", b"\x0b a\x0c", ("é" * 50 + " " + "é" * 50 + " " + "é" * 49 + "e").encode(), "É𝄞 #ß#".encode(), b"\0 \0\0 \0"]
    out += [b" ".join(bytes(r.choice(b"ab") for _ in range(r.choice(sizes))) for _ in range(r.randrange(60))) for _ in range(200)]
    return out + [b"x" * 9000 + b" y " + b"x" * 9000 + b" " + b"x" * 8999 + b"z"]


@pytest.mark.parametrize("at_once", [1, 37, 1 << 20])
def test_measures_equal_plain_python(monkeypatch, at_once):
    monkeypatch.setattr(A, "AT_ONCE", at_once)
    texts = odd_texts() if at_once > 1 else odd_texts()[:30]
    assert A.measure(texts).T.tolist() == [plain(t) for t in texts]


def test_spans_of_one_hash_are_still_told_apart(monkeypatch):
    import numpy as np
    monkeypatch.setattr(A.Spans, "_hashes", lambda self, owner, start, size: np.zeros(len(start), np.uint64))
    texts = odd_texts()[:40]
    assert A.measure(texts).T.tolist() == [plain(t) for t in texts]


def by_hand(rows, labels):
    """The contract, order by order and document by document."""
    good = {i for i, q, t in labels if q == 1 and i is not None}
    toxic = {i for i, q, t in labels if t == 1 and i is not None}
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    fails, out = [], Counter()
    for i, text, source in rows:
        w, d, c, n, s = plain((text or "").encode())
        copy = i is not None and first[text or ""] < i
        fails.append({x for x, bad in zip("ABCDE", (w < 200, 100 * d < 50 * w, 100 * c > 2 * n, s > 0, copy)) if bad})
    alone = Counter()
    for order in map("".join, permutations("ABCDE")):
        for (i, _, source), bad in zip(rows, fails):
            gone = False
            for step, x in enumerate(order, 1):
                at = (source or "", order, step)
                hit = x in bad
                alone[source or "", x] += hit and not gone
                for k, v in enumerate((not gone and not hit, hit and not gone, hit and gone, bad == {x},
                                       hit and not gone and i in good, hit and not gone and i in toxic)):
                    out[at, k] += v
                gone = gone or hit
    return {(*at, *(out[at, k] for k in range(6)), alone[at[0], at[1][at[2] - 1]]) for at, _ in out}


def test_audit_equals_every_order_by_hand(spark, make, edge_rows):
    r = random.Random(14)
    rows = [*edge_rows, (20, "A# " * 300, "a"), (21, " ".join(map(str, range(300))), "a"), (22, " ".join(map(str, range(300))), None),
            (23, " ".join(map(str, range(300))), ""), (20, "A# " * 300, "a")]
    labels = [(r.choice([None, *range(1, 25)]), r.choice([0, 1, None]), r.choice([0, 1, None]), "x") for _ in range(30)]
    got = A.filter_audit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"))
    assert {tuple(x) for x in got.collect()} == by_hand([x[:3] for x in rows], [x[:3] for x in labels])
    assert got.columns[:3] == ["part", "filter_order", "step"]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(make([]), none).count() == 0
    assert {x.good_lost + x.toxic_lost for x in A.filter_audit(make(rows[:3]), none).collect()} == {0}


def test_other_filters_and_carried_columns(spark, make):
    got = A.filter_audit(make([(1, "a b", "s"), (2, "a b #", "s")]), spark.createDataFrame([], "doc_id long, quality int, toxic int"),
                         {"X": "symbols > 0", "Y": "words < 3"})
    assert {(x.filter_order, x.step, x.kept, x.removed, x.shapley) for x in got.collect()} == {
        ("XY", 1, 1, 1, 2), ("XY", 2, 0, 1, 2), ("YX", 1, 1, 1, 2), ("YX", 2, 0, 1, 2)}
    measured = A.measures(make([(1, None, "s")]))
    assert measured.count() == 1 and measured.first().words == 0 and "_row" in measured.columns
    with pytest.raises(ValueError, match="six"):
        A.filter_audit(make([]), make([]), dict.fromkeys("ABCDEFG", "copy"))
