"""The trie against a plain one, with small shards, bands and queues, so that every level of the processing is used."""
import hashlib
import random
import zlib

import pytest

from noticeflow.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv string, n int, _at int, xa int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "d", "c", 1, 2, None) for r in rows], SCHEMA)


def in_order(rows):
    out = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None),
                                         key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    """(conv_id, depth, parent, n_convs, n_children, n_leaves, saved, ends) of each node, bottom up."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        if not children.setdefault(node, 0):
            leaves[node] = 1
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    ends = {n: ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(n)) for n, m in members.items()}
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
             hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()}


def conversations(seed, n, longest=12, kinds=2):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "bot"][:kinds]), r.choice(["é", "bb", "ccc"][:kinds])) for c in range(n) for t in range(r.randrange(1, longest))]


EDGE = [(None, 1, "user", "x"), (3, None, None, None), (3, 1, "", ""), (3, 1, "", ""), (-7, 1, "user", "a"), (-5, 1, "user", "b"), (-5, 2, None, "c"),
        (7, 2, "bot", "x" * 100_000), (7, 1, "user", "y"), (12, 0, "user", "y")]


def test_rebuilt_conversations(spark):
    rows = [*EDGE, *[(100 + c, *x) for c, *x in conversations(1, 60)], *[(1000 + c, t, "u", "x") for c in range(30) for t in range(9)]]
    got = P.prefix_trie(table(spark, rows), shared=True).collect()
    want = plain(rebuild(in_order(rows)))
    assert len(got) == len(want) and {tuple(x) for x in got} == want


@pytest.mark.parametrize("shard, band, in_memory", [(P.SHARD, P.BAND, P.IN_MEMORY), (20, 3, 5), (0, 1, 1)])
def test_shards_and_bands_change_nothing(spark, shard, band, in_memory):
    long = [(500, t, "user", "é") for t in range(40)] + [(501, t, "user", "é" if t < 35 else "z") for t in range(38)]
    rows = [*EDGE, *long, *conversations(2, 80, kinds=3)]
    turns = P.ordered_turns(table(spark, rows))
    got = P.trie(turns, turns.groupBy("conv").agg(P.F.count("*").alias("length")), shard, band, in_memory).collect()
    want = plain(in_order(rows))
    assert len(got) == len(want) and {tuple(x) for x in got} == want


def test_many_end_at_one_prefix(spark, monkeypatch):
    monkeypatch.setattr(P, "ENDS", 7)
    rows = [(c, 1, "user", "x") for c in range(100)]
    assert {tuple(x) for x in P.prefix_trie(table(spark, rows)).collect()} == plain(in_order(rows))


def test_empty_tables_and_conversations_without_turns(spark):
    assert P.prefix_trie(table(spark, [])).count() == 0
    assert P.prefix_trie(table(spark, [(None, 1, "a", "b")]), shared=True).count() == 0
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    got = P.prefix_trie(table(spark, [(c, 1, "a", "b")]), shared=True).collect()
    assert {tuple(x) for x in got} == plain({c: []})


def test_the_queue_gives_messages_in_order_over_its_runs():
    r = random.Random(3)
    queue, messages = P.SpillingQueue(4), []
    for _ in range(300):
        messages.append((r.randrange(5), r.randrange(3), 0, r.randrange(9), 1, 1))
        queue.push(messages[-1])
    assert len(queue.runs) > 50
    for key in sorted({m[:3] for m in messages}):
        assert sorted(queue.take(key)) == sorted(m for m in messages if m[:3] == key)
