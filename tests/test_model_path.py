"""Long texts through a stub of a model: spans at chunk borders, scores, and one model a worker."""
import random

from pyspark.sql import functions as F

from noticeflow.operators import model_path as P


def scorer_of(path=None):
    def make():
        if path:
            with open(path, "a") as f:
                f.write("x")

        def score(texts):
            out = []
            for text in texts:
                tokens, i = [], 0
                while i < len(text):
                    kind = {"n": "private_person", "s": "secret", "w": "secret"}.get(text[i])
                    first = i == 0 or text[i - 1] != text[i]
                    tokens.append((i, i + 1, f"{'B' if first else 'I'}-{kind}" if kind else "O", 0.1 if text[i] == "w" else 0.8))
                    i += 1
                out.append(tokens)
            return out
        return score
    return make


def runs(text, letters):
    out, i = set(), 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] == text[i]:
            j += 1
        if text[i] in letters:
            out.add((text[i], i, j))
        i = j
    return out


def test_spans_at_every_border(spark, tmp_path):
    r = random.Random(3)
    texts = ["", "n", "." * 2000, "." * 595 + "n" * 10 + ".", "." * 495 + "s" * 10 + ".", "." * 500 + "n" * 100 + "s" * 30, "s" * 3000,
             "." * 550 + "n" * 700 + ".", "w" * 50 + "n"]
    texts += ["".join(r.choice("nsw....") * r.randrange(1, 60) for _ in range(100)) for _ in range(20)]
    log = str(tmp_path / "made")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, None)], "k int, body string").repartition(40)
    got = {x.k: {({"private_person": "n", "secret": "s"}[s.label], s.start, s.end) for s in x.found}
           for x in P.strong_spans(df, scorer_of(log), "k", "body", name=log).collect()}
    for i, text in enumerate(texts):
        assert got.get(i, set()) == runs(text, "ns"), i
    assert 999 not in got
    P.strong_spans(df, scorer_of(log), "k", "body", name=log).count()
    assert len(open(log).read()) <= 8    # one for each worker process, not one for each of its tasks


def test_masking_long_texts_with_the_model(spark):
    text = "." * 590 + "nnnnnnnnnn" + "x" * 300 + " a@b.co " + "n" * 4
    df = spark.createDataFrame([(1, text), (2, "zero"), (3, None)], "k int, body string")
    got = {r.k: r for r in P.mask_strong(df, scorer_of(), "k", "body", rules=["email"]).collect()}
    assert got[1].masked == "." * 590 + "[이름1]" + "x" * 300 + " [이메일1] [이름2]"
    assert got[2].masked == "zero" and got[3].masked is None and "_found" not in got[1].asDict()


def test_decoding_and_reconciling(spark):
    tokens = [(0, 1, "I-a", 0.5), (1, 2, "I-a", 0.7), (2, 2, "I-a", 0.9), (2, 3, "I-a", 0.9), (3, 4, "S-a", 0.9), (4, 5, "I-b", 0.9), (5, 6, "O", 1.0), (6, 7, "I-b", 0.2)]
    df = spark.createDataFrame([(tokens,), ([],)], f"t array<{P.TOKEN}>")
    got = [[(s.label, s.start, s.end, round(s.score, 6)) for s in r.f] for r in df.select(F.expr(P.decoded("t")).alias("f")).collect()]
    assert got == [[("a", 0, 2, 0.6), ("a", 2, 3, 0.9), ("a", 3, 4, 0.9), ("b", 4, 5, 0.9), ("b", 6, 7, 0.2)], []]
    spans = [("a", 10, 20, 0.5), ("b", 12, 14, 0.9), ("a", 15, 30, 0.4), ("a", 30, 31, 0.4), ("a", 10, 20, 0.5)]
    df = spark.createDataFrame([(spans,)], f"s array<{P.FOUND}>")
    got = [(s.label, s.start, s.end) for s in df.select(F.expr(P.reconciled("s")).alias("f")).first().f]
    assert got == [("a", 10, 30), ("a", 30, 31), ("b", 12, 14)]
