"""One query for each operator on its whole table, with its result as SQL where SQL can say it."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from noticeflow.llm.bpe import encode_documents, token_digests
from noticeflow.llm.bpe_stream import stream_documents
from noticeflow.llm.chat import perspectives
from noticeflow.llm.exact_dedup import exact_dedup
from noticeflow.llm.filter_audit import filter_audit
from noticeflow.llm.language import identify, profiles
from noticeflow.llm.mixing import mix
from noticeflow.llm.prefix_trie import prefix_trie
from noticeflow.llm.quality import quality
from noticeflow.llm.simhash import simhash_components
from noticeflow.llm.substring_dedup import substring_dedup
from noticeflow.llm.warc import archive_pages
from noticeflow.llm.winnowing import edit_likeness

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), carry=["doc_id"])


ORACLES["op1_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)"""


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), carry=["doc_id"])


@query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))


@query
def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = perspectives(table(spark, sf_dir, "conversations"))
    return sides.select("conv_id", "perspective", "part", "n_turns", "text", F.expr(
        "array_join(transform(spans, s -> concat(s.start, '-', s.end)), ',')").alias("mask"))


ORACLES["op7_chat"] = """
WITH t AS (SELECT conv_id, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS body,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'),
                                     coalesce(text, '')) - 1 AS pos FROM conversations),
     p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
     r AS (SELECT t.conv_id, perspective, pos // 256 AS part, pos, role = perspective AS mine, body || '<|im_end|>' AS tail,
                  '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                      ELSE 'user name=' || replace(replace(role, '<|', '< |'), chr(10), ' ') END || chr(10) AS head
           FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
     o AS (SELECT *, sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY pos)
                  - length(tail) - 1 AS s FROM r)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || tail || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(CASE WHEN mine THEN s || '-' || (s + length(tail)) END, ',' ORDER BY pos), '') AS mask
FROM o GROUP BY conv_id, perspective, part"""


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"))
    learned = profiles(docs.filter("not held_out"))
    return identify(spark, docs, learned, carry=["doc_id", "held_out"])


@query
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(encode_documents(spark, table(spark, sf_dir, "documents"),
                                          public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                          carry=["doc_id"]), ["doc_id"])


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = archive_pages(table(spark, sf_dir, "pages"))
    sound = F.when(F.col("intact"), F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a payload was damaged")).cast("long"))
    return read.select("page_id", sound.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLES["op10_warc"] = """
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
     d AS (SELECT page_id, cast(strlen(p) AS BIGINT) AS payload_bytes, sha256(p) AS payload_digest FROM t),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to FROM f"""


@query
def op11_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(stream_documents(spark, table(spark, sf_dir, "documents"),
                                          public_tokenizers.path("byte_bpe_50k.json"), carry=["doc_id"]), ["doc_id"])


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), shared=True)


ORACLES["op12_prefix_trie"] = """
WITH RECURSIVE t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
                     FROM conversations WHERE conv_id IS NOT NULL),
     own AS (SELECT c, count(*) AS n FROM t GROUP BY c),
     crc AS (SELECT c, c::VARCHAR AS s, 0 AS k, 4294967295::UBIGINT AS x FROM own
             UNION ALL
             SELECT c, s, k + 1, xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT)
             FROM (SELECT *, CASE WHEN k % 8 = 0 THEN xor(x, ascii(substr(s, k // 8 + 1, 1))::UBIGINT) ELSE x END AS y FROM crc)
             WHERE k < 8 * length(s)),
     h AS (SELECT own.c, n, own.c - own.c % 5 AS base, (xor(x, 4294967295::UBIGINT) % 9)::BIGINT AS h FROM own JOIN crc ON own.c = crc.c
           WHERE k = 8 * length(s)),
     v AS (SELECT h.c, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS m, least(h.h, coalesce(b.n, 0)) + greatest(h.n - h.h, 0) AS length
           FROM h LEFT JOIN own b ON h.base = b.c),
     r AS (SELECT v.c, t.i, role, body FROM t JOIN v ON t.c = v.base WHERE t.i <= v.h
           UNION ALL SELECT v.c, t.i - v.h + v.m, role, body FROM t JOIN v ON t.c = v.c WHERE t.i > v.h),
     q AS (SELECT c, i AS depth, strlen(body) AS bytes,
                  sha256(string_agg(sha256(role) || sha256(body), '' ORDER BY i) OVER (PARTITION BY c ORDER BY i)) AS key FROM r
           UNION ALL SELECT c, 0, 0, '' FROM v),
     p AS (SELECT q.*, lag(key) OVER (PARTITION BY q.c ORDER BY depth) AS parent, depth = length AS ends FROM q JOIN v ON q.c = v.c),
     g AS (SELECT depth, key, min(parent) AS parent, min(c) AS conv_id, count(*) AS n, max(bytes) AS bytes,
                  string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends) AS ids FROM p GROUP BY depth, key),
     k AS (SELECT g.*, (SELECT count(*) FROM g x WHERE x.depth = g.depth + 1 AND x.parent = g.key) AS children FROM g),
     s AS (SELECT p.depth, p.key, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * k.bytes) AS saved
           FROM k JOIN p ON p.c = k.conv_id AND p.depth <= k.depth GROUP BY p.depth, p.key)
SELECT k.conv_id, k.depth, o.conv_id AS parent_conv_id, k.n AS n_convs, k.children AS n_children, s.leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(k.ids, '')) AS ends_sha256
FROM k JOIN s ON k.depth = s.depth AND k.key = s.key LEFT JOIN g o ON o.depth = k.depth - 1 AND o.key = k.parent"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
     w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
     l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
           FROM labels GROUP BY doc_id),
     f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
                  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
                  || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
                  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END
                  || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                  || CASE WHEN first_id < w.doc_id THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
     g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
     x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
     o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e
           WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
     s AS (SELECT part, filter_order, step, n, good, toxic, contains(fails, substr(filter_order, step, 1)) AS own,
                  len(fails) = 1 AND fails = substr(filter_order, step, 1) AS lone, len(fails) AS k,
                  regexp_matches(fails, '[' || CASE WHEN step = 1 THEN 'Z' ELSE substr(filter_order, 1, step - 1) END || ']') AS gone
           FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step))
SELECT part, filter_order, step::INTEGER AS step, sum(CASE WHEN NOT own AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN own AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN own AND gone THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN lone THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN own AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN own AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost, sum(CASE WHEN own THEN n * 120 // k ELSE 0 END)::BIGINT AS shapley
FROM s GROUP BY part, filter_order, step"""
