"""Exact, substring and SimHash deduplication against brute force."""
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from corpus_pipeline import near_stage
from noticeflow.llm.common import sifted
from noticeflow.llm.components import components
from noticeflow.llm.exact_dedup import exact_dedup
from noticeflow.llm.near_copies import near_components
from noticeflow.llm.simhash import fingerprint, grid_keys, near_links, simhash_components, spanning_links
from noticeflow.llm.substring_dedup import BLOCK, Block, substring_dedup


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(2 + r.randrange(5))) + str(r.randrange(400)) for _ in range(n))




def exact_brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    out = Counter()
    for text, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for k, r in enumerate(sorted(members, key=lambda r: r is not best)):
            out[(r[0], best[0], len(members), k == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("max_words", [1 << 22, 1])
def test_exact_equals_brute_force_with_any_filter(spark, make, edge_rows, max_words):
    rows = [*edge_rows, *[(100 + i, "a copy of which there are many", "hot") for i in range(300)]]
    got = exact_dedup(make(rows), max_words=max_words)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == exact_brute(rows)
    assert "lang" in got.columns and got.columns.count("kept") == 1 and dict(got.dtypes)["kept"] == "boolean"


def test_empty_tables(spark, make):
    none = make([])
    assert exact_dedup(none).count() == 0
    assert substring_dedup(none).count() == 0
    assert simhash_components(none).count() == 0


def substring_brute(texts, length):
    at = Counter(t[p:p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if at[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, bytes(c for c, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("few", [16_384, 1])
def test_substrings_equal_brute_force(make, edge_rows, monkeypatch, few):
    monkeypatch.setattr("noticeflow.llm.substring_dedup.FEW", few)
    shared, edge = words(20, 60), words(21, 40)
    rows = [r for r in edge_rows if r[1] is None or len(r[1]) < 6000]
    rows += [(50 + i, words(30 + i, 20 + i) + shared[i * 7:] + words(60 + i, 30)) for i in range(12)]
    rows += [(80, edge[:199]), (81, "q" + edge[:199]), (82, edge[:200]), (83, "z" + edge[:200] + "é"), (84, "ab" * 300),
             (85, words(7, 50) + shared + words(8, 5) + shared)]
    want = Counter(zip([r[0] for r in rows], substring_brute([(r[1] or "").encode() for r in rows], 200)))
    got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_text))) for r in substring_dedup(make(rows)).collect())
    assert got == want


def test_long_texts_are_cut_into_overlapping_blocks(make):
    passage = words(90, 50)
    random.seed(3)
    filler = "".join(random.choice("abcdefghijklmnop ") for _ in range(BLOCK + 500))
    rows = [(1, filler[:BLOCK - 100] + passage + filler[BLOCK - 100:]), (2, "xyz " + passage + " uvw"), (3, passage[:150])]
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in substring_dedup(make(rows)).collect()}
    size = len(passage.encode())
    assert got == {1: (size, 1), 2: (size, 1), 3: (0, 0)}


def test_equal_windows_pick_the_same_place():
    common = words(5, 70).encode()
    a, b = Block([words(6, 40).encode() + common], 200), Block([b"short", common + words(7, 40).encode()], 200)
    assert set(a.gram.tolist()) & set(b.gram.tolist())


def fp_brute(text, k=3):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64(" ".join(ws[i:i + k]).encode(), seed=42).intdigest() for i in range(max(1, len(ws) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(values, most=3):
    """Smallest index of each value's component."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(make, edge_rows):
    base = words(40, 900)
    near = [(200 + i, base.replace(base.split()[17 * i], "changed", 1)) for i in range(25)]
    rows = [*edge_rows, *near, (300, base), (301, base)]
    fps = [fp_brute(r[1]) for r in rows]
    assert [fingerprint(r[1], 3) for r in rows] == fps
    roots = classes(fps)
    least = {c: min((rows[i][0] for i in range(len(rows)) if roots[i] == c and rows[i][0] is not None), default=None) for c in set(roots)}
    want = Counter((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, roots))
    got = simhash_components(make(rows), carry=["doc_id", "fingerprint", "_row"])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()) == want


@pytest.mark.parametrize("blocks", [5, 6])
def test_links_join_all_that_are_near(spark, blocks):
    r = random.Random(blocks)
    values = {0, (1 << 64) - 1}
    for _ in range(40):
        at = r.getrandbits(64)
        for _ in range(8):
            values.add(at)
            for b in r.sample(range(64), r.choice([1, 2, 3, 3, 4])):
                at ^= 1 << b
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = near_links(spark.createDataFrame([(v,) for v in signed], "_fp long"), blocks=blocks).collect()
    place = {v: i for i, v in enumerate(signed)}
    got = {(place[x.u], place[x.v]) for x in links}
    assert all(bin(values[a] ^ values[b]).count("1") <= 3 for a, b in got)
    joined = {x.u: x.v for x in components(spark.createDataFrame([(a, b) for a, b in got], "u long, v long")).collect()}
    assert [joined.get(i, i) for i in range(len(values))] == classes(values)


def test_a_dense_group_gives_a_tree():
    values = np.array([1 << i for i in range(60)], np.uint64)
    assert len(spanning_links(values, 3)) == 59
    assert len(grid_keys(6)[0]) == 20


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (600, 700), (700, 600)]
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 700: 600}


def near_brute(texts):
    """Smallest index of each text's component of near copies."""
    def shingles(text):
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))}
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root


@pytest.mark.parametrize("common", [2, 1000])
@pytest.mark.parametrize("rounds", [(), (1, 4)])
def test_near_copies_equal_brute_force(spark, monkeypatch, common, rounds):
    monkeypatch.setattr("noticeflow.llm.near_copies.COMMON", common)
    monkeypatch.setattr("noticeflow.llm.near_copies.ROUNDS", rounds)
    r = random.Random(17)
    texts = [None, "", " \t\n", "one", "ONE", "one two three four", "one two three  FOUR", "é x"]
    line = words(70, 30)
    for i in range(14):
        base = words(100 + i, r.choice([9, 30, 120])).split()
        texts.append(" ".join(base))
        for n in range(8):
            at, other = r.sample(range(len(base)), min(len(base), 1 + n % 5)), base[:]
            for a in at:
                other[a] = f"w{n}"
            texts.append(" ".join(other) + (" " + line if n == 7 else ""))
    texts += [line + " " + words(300 + i, 5 + i) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, line + " repeated"), (901, line + " repeated")]
    df = spark.createDataFrame([(k - 500, t) for k, t in rows], "_key long, _text string")
    df = df.union(spark.createDataFrame([(400, line + " repeated")], "_key long, _text string"))
    got = {x.u: x.v for x in near_components(df).collect()}
    want = near_brute([t for _, t in rows])
    assert len(set(want)) < len(want) - 30
    assert [got.get(k - 500, k - 500) for k, _ in rows] == [rows[w][0] - 500 for w in want]


def test_a_large_group_of_near_copies_makes_few_candidates(spark, monkeypatch):
    """Texts that share a long passage and are too far apart cost a candidate each, not one for every two of them."""
    from noticeflow.llm import near_copies
    compared, whole = [], near_copies._near
    monkeypatch.setattr(near_copies, "_near", lambda pairs, *rest: (compared.append(pairs.count()), whole(pairs, *rest))[1])
    passage = " ".join(f"p{i}" for i in range(100))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(13))) for i in range(80)]
    rows += [(200 + i, passage + " " + " ".join(f"v{i}x{j}" for j in range(9))) for i in range(3)]
    got = {x.u: x.v for x in near_components(spark.createDataFrame(rows, "_key long, _text string")).collect()}
    want = near_brute([t for _, t in rows])
    assert {k: rows[w][0] for (k, _), w in zip(rows, want) if rows[w][0] != k} == got and got
    assert sum(compared) <= 2 * len(rows)


def test_texts_that_have_no_near_copy_are_not_shuffled(spark):
    """Where the keys of the groups were too many to be broadcast, all texts went through the shuffle four times."""
    rows = [(i, words(5000 + i, 1500) + f" own{i}") for i in range(150)]
    rows = [(k, " ".join(f"{w}{k}" for w in t.split())) for k, t in rows]
    rows += [(1000 + k, t + " end") for k, t in rows[:3]]
    df = spark.createDataFrame(rows, "_key long, _text string").repartition(8).cache()
    df.count()
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        got = {x.u: x.v for x in near_components(df).collect()}
        shuffled, before = written() - before, written()
        stay = {x.doc_id for x in near_stage(spark, df.selectExpr("_key AS doc_id", "_text AS text"), "").collect()}
        shuffled = max(shuffled, written() - before)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        df.unpersist()
    assert got == {1000: 0, 1001: 1, 1002: 2} and stay == set(range(150))
    assert shuffled < 1.4 * 8 * sum(len(t.split()) - 4 for _, t in rows)


def test_sifted_keeps_every_row_that_has_a_partner(spark):
    rows = spark.range(20000).selectExpr("unhex(md5(string(id))) AS _key", "id")
    got = {r.id for r in sifted(rows, rows.filter("id % 100 = 7"), "_key").collect()}
    assert {i for i in range(20000) if i % 100 == 7} <= got and len(got) < 400
    assert not sifted(rows, rows.filter("id < 0"), "_key").collect()
