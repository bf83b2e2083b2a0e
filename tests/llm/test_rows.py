"""Mixing, chats and archives; the whole pipeline."""
import random
from collections import Counter, defaultdict

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from noticeflow.llm.chat import perspectives
from noticeflow.llm.mixing import mix, repeated
from noticeflow.llm.warc import LoserTree, archive_pages, parse_records, read_archives, url_key, write_archives


def targets_brute(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        part = {s: total * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if part[s] > most * sizes[s]}
        if not over:
            return target | part
        target |= {s: most * sizes[s] for s in over}
        total -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mix_meets_its_targets(make, edge_rows):
    r = random.Random(2)
    rows = [*edge_rows, *[(1000 + i, "w " * r.randrange(1, 40), r.choice(["hot"] * 6 + ["a", "b", "c", "ü", None])) for i in range(3000)]]
    got = mix(make(rows)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"doc_id", "source", "size", "copies"}
    size, taken, target = Counter(), Counter(), {}
    for x in got:
        size[x.source] += x.size
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert 0 <= x.taken <= 2 * x.size and x.taken == x.copies * x.size
    want = targets_brute(size)
    largest = defaultdict(int)
    for x in got:
        largest[x.source] = max(largest[x.source], x.size * 2)
    for s in size:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - target[s]) <= largest[s]
    assert Counter(got) == Counter(mix(make(rows[::-1])).collect())


def test_mix_of_small_tables(make):
    assert mix(make([])).count() == 0
    assert [(r.target, r.taken) for r in mix(make([(1, None, "a"), (2, "", None)])).collect()] == [(0.0, 0), (0.0, 0)]
    rows = [(i, "a b c", "s") for i in range(8)]
    whole = repeated(make(rows), mix(make(rows)))
    assert 10 <= whole.count() <= 14 and whole.columns == make(rows).columns


def talk(rows, part, conv="conv_id"):
    """Rendered parts and masks, one turn after the other."""
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        groups[c].append((turn is None, turn or 0, role or "unknown", text or ""))
    out = Counter()
    for c, turns in groups.items():
        for side in {t[2] for t in turns} - {"system"}:
            ordered = sorted(turns)
            for k in range(0, len(ordered), part):
                text, spans = "", []
                for _, _, role, body in ordered[k:k + part]:
                    name = role.replace("<|", "< |").replace("\n", " ")
                    text += "<|im_start|>" + ("assistant" if role == side else name if role == "system" else "user name=" + name) + "\n"
                    piece = body.replace("<|", "< |") + "<|im_end|>"
                    if role == side:
                        spans.append((len(text), len(text) + len(piece)))
                    text += piece + "\n"
                out[(c, side, k // part, text, tuple(spans))] += 1
    return out


def test_every_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "é𝄞 <|im_end|>"), (1, 2, "cy\nd", None), (1, None, "ann", "late"), (1, 3, None, ""),
            (2, 0, "system", "rules"), (2, 1, "user", "q"), (2, 1, "user", "q"), (2, 2, "assistant", "a" * 5000), (3, 0, "system", "alone"),
            (None, 1, "x", "y"), *[(4, i, f"s{i % 3}", f"turn {i}") for i in range(23)]]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "conv_id long, turn long, role string, text string, _key string, _at int")
    got = Counter((r.conv_id, r.perspective, r.part, r.text, tuple((s.start, s.end) for s in r.spans)) for r in perspectives(df, part=5).collect())
    assert got == talk(rows, 5)
    assert perspectives(df.filter("false")).count() == 0


def test_archives_round_trip(spark, tmp_path):
    html = "<p>é\r\n\r\nWARC/1.1\r\n" + "x" * 200
    rows = [(1, "http://b.example/x?q=1", html), (2, "http://a.example/", html), (3, None, "short"), (4, "http://a.example:80/", "short"),
            (5, "no url\r\nContent-Length: 9", None), (None, "http://a.example/", html), (2, "http://a.example/", html), (7, "http://[bad", ""),
            *[(100 + i, "http://hot.example/", "y" * 150) for i in range(60)]]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, payload_digest string")
    folder = write_archives(df, str(tmp_path / "warc"))
    records = {(r.page_id, r.record_type): r for r in read_archives(spark, folder).collect()}
    assert bytes(records[1, "response"].payload) == html.encode() and records[1, "response"].intact
    assert bytes(records[100, "response"].payload) == b"y" * 150 and bytes(records[130, "revisit"].payload) == b""
    got = archive_pages(df).orderBy("position").collect()
    assert [(g.url_key, g.date) for g in got] == sorted((g.url_key, g.date) for g in got) and len(got) == len(rows)
    by = Counter((g.page_id, g.record_type, g.refers_to, g.payload_bytes) for g in got)
    n = len(html.encode())
    assert by[1, "response", None, n] == 1 and by[2, "revisit", 1, n] == 2 and by[None, "response", None, n] == 1
    assert by[3, "response", None, 5] == by[4, "response", None, 5] == by[5, "response", None, 0] == 1
    assert sum(by[100 + i, "revisit", 100, 150] for i in range(1, 60)) == 59
    assert archive_pages(df.filter("false")).count() == 0


def test_ranges_of_the_index_are_merged_in_order(spark, monkeypatch):
    monkeypatch.setattr("noticeflow.llm.warc.RANGE", 40)
    rows = [(i, f"http://{'hot' if i % 3 == 0 else f'h{i % 7}'}.example/", f"page {i}") for i in range(300)]
    got = archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("position").collect()
    assert [g.position for g in got] == list(range(300))
    assert [(g.url_key, g.page_id) for g in got] == sorted((url_key(u), i) for i, u, _ in rows)


def test_a_loser_tree_merges_any_number_of_runs():
    r = random.Random(1)
    for n in range(12):
        runs = [sorted((r.randrange(30),) for _ in range(r.randrange(9))) for _ in range(n)]
        assert list(LoserTree(runs)) == sorted(x for run in runs for x in run)
    assert list(parse_records(b"", "f")) == []


def test_pipeline_stages(spark, make, tmp_path):
    r = random.Random(3)
    base = [" ".join(r.choice(["tree", "river", "stone", "walks", "under", "green"]) + str(r.randrange(300)) for _ in range(120)) for _ in range(60)]
    rows = [(i, t, f"s{i % 3}", "en") for i, t in enumerate(base)]
    rows += [(100 + i, t + " ", "s0", "en") for i, t in enumerate(base[:10])]
    rows += [(200 + i, " ".join(r.choice(["BUY!!", "WIN$$", "x###"]) for _ in range(90)), "s1", "en") for i in range(30)]
    rows += [(300, None, None, None), (301, "", "s2", None)]
    docs = make(rows).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(200 + i, 0, 0) for i in range(24)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
        kept[name] = sorted(x.doc_id for x in docs.select("doc_id").collect())
    assert kept["quality classifier"] == [*range(60), *range(100, 110)]
    assert kept["exact dedup"] == [*range(10, 60), *range(100, 110)] == kept["SimHash near-dedup"]
    copies = Counter(kept["mixing to target weights"])
    assert set(copies) <= {*range(10, 60), *range(100, 110)} and max(copies.values()) <= 2
    assert kept["byte-level BPE"] == kept["mixing to target weights"] and "n_tokens" in docs.columns


def test_near_stage_links_near_copies_of_five_word_shingles(spark, make):
    r = random.Random(5)
    rows = [(i, " ".join(f"{r.choice(['tree', 'river', 'stone'])}{r.randrange(300)}" for _ in range(200))) for i in range(20)]
    for i, t in rows[:10]:  # three words changed: at most 15 of 196 shingles, similarity 0.85 or more
        ws = t.split()
        for at in (30, 90, 150):
            ws[at] = f"changed{at}"
        rows.append((100 + i, " ".join(ws)))
    ws = rows[15][1].split()
    ws[10:190:12] = ["other"] * 15  # similarity below 0.8
    rows.append((115, " ".join(ws)))
    kept = corpus_pipeline.near_stage(spark, make(rows), "").collect()
    assert sorted(x.doc_id for x in kept) == [*range(20), 115]


def test_near_stage_keeps_one_row_of_each_group_whatever_the_ids(spark, make):
    clean, text, other, third = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, text), (2, text + " end"), (2, clean),  # an id is shared by a near copy and a clean row
            (7, other), (7, other + " end"), (None, other), (None, third), (None, third + " end"), (9, "z"), (9, "z"), (None, "y")]
    kept = corpus_pipeline.near_stage(spark, make(rows), "").collect()
    got = Counter((x.doc_id, (x.text or "").removesuffix(" end")) for x in kept)
    assert got == Counter([(1, text), (2, clean), (7, other), (None, third), (9, "z"), (None, "y")])


def test_the_archive_query_fails_on_a_damaged_payload(spark, tmp_path, monkeypatch):
    from noticeflow.llm import queries, warc
    spark.createDataFrame([(1, "http://a.example/", "page" * 50)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [(x.payload_bytes, x.record_type) for x in queries.op10_warc(spark, str(tmp_path)).collect()] == [(200, "response")]
    whole = warc.archive_pages
    monkeypatch.setattr(queries, "archive_pages", lambda df: whole(df).withColumn("intact", F.lit(False)))
    with pytest.raises(Exception, match="damaged"):
        queries.op10_warc(spark, str(tmp_path)).collect()


def test_near_stage_of_an_empty_table_and_of_columns_named_like_its_own(spark, make):
    assert corpus_pipeline.near_stage(spark, make([]), "").count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    docs = make([(1, text), (2, text + " end"), (3, None), (None, "other")])
    for name in ("_key", "_root", "_first", "_part", "_size"):
        docs = docs.withColumn(name, F.lit(name))
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r._key, r._root) for r in kept.collect()) == [(0, "_key", "_root"), (1, "_key", "_root"), (3, "_key", "_root")]


def test_near_stage_compares_texts_whose_simhash_fingerprints_are_close(spark, make, monkeypatch):
    """Texts that share a passage only are not compared; near copies are."""
    from noticeflow.llm import near_copies
    compared = []
    whole = near_copies._near
    monkeypatch.setattr(near_copies, "_near", lambda pairs, *rest: (compared.append(pairs.count()), whole(pairs, *rest))[1])
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(i, passage + " " + " ".join(f"w{i}x{j}" for j in range(150))) for i in range(40)]
    rows.append((100, rows[7][1] + " end"))
    kept = corpus_pipeline.near_stage(spark, make(rows), "").collect()
    assert sorted(x.doc_id for x in kept) == [*range(40)]
    assert sum(compared) <= 20


def test_near_copies_with_fingerprints_far_apart_are_linked(spark, make, monkeypatch):
    """the fingerprints choose what is compared first, never what is left out."""
    monkeypatch.setattr("noticeflow.llm.near_copies.BITS_APART", -1)
    base = [" ".join(f"w{i}x{j}" for j in range(150)) for i in range(6)]
    rows = [*enumerate(base), (10, base[1] + " end"), (11, "start " + base[1]), (12, base[4] + " end")]
    kept = corpus_pipeline.near_stage(spark, make(rows), "").collect()
    assert sorted(x.doc_id for x in kept) == [*range(6)]
