"""The choice among overlapping spans against a plain greedy one."""
import random

from pyspark.sql import functions as F

from noticeflow.functions import spans as S

SPAN = "array<struct<start:int,end:int,label:string,rule:string,prio:int,ord:int,confidence:double>>"


def plain(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (-s[4], s[0] - s[1], s[0], s[5], s[1], s[2], s[3])):
        if all(s[0] >= k[1] or k[0] >= s[1] for k in kept):
            kept.append(s)
    return sorted((k[0], k[1], k[2]) for k in kept)


def test_choice_is_greedy(spark):
    r = random.Random(9)
    rows = []
    for n in (0, 1, 2, 3, 10, 80, 300):
        for _ in range(6):
            starts = [r.randrange(3 * n + 1) for _ in range(n)]
            rows.append([(a, a + r.randrange(1, 8), r.choice("xy"), "r", r.randrange(3), i, None) for i, a in enumerate(starts)])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, s {SPAN}")
    got = {x.i: [(k.start, k.end, k.label) for k in x.c] for x in df.select("i", F.expr(S.choose("s")).alias("c")).collect()}
    assert [got[i] for i in range(len(rows))] == [plain(x) for x in rows]


def test_a_long_chain(spark):
    chain = [(10 * i, 10 * i + 15, "x", "r", i % 7, i, None) for i in range(5000)]
    got = spark.createDataFrame([(chain,)], f"s {SPAN}").select(F.expr(S.choose("s")).alias("c")).first().c
    assert [(k.start, k.end, k.label) for k in got] == plain_chain(chain)


def plain_chain(spans):
    """Greedy choice where a span touches only the two beside it."""
    taken = set()
    for i in sorted(range(len(spans)), key=lambda i: (-spans[i][4], spans[i][0] - spans[i][1], spans[i][0])):
        if i - 1 not in taken and i + 1 not in taken:
            taken.add(i)
    return [(spans[i][0], spans[i][1], spans[i][2]) for i in sorted(taken)]
