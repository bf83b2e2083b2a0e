"""Personal data: every rule on constructed texts, and the operators on the documents.

A constructed text is built from a customer's key by the same SQL on both sides; the expected spans and the masked
text follow from its parts, so the SQL does not have to know the rules.
"""
from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow.operators import pii_detect as D
from noticeflow.operators import pii_mask as M
from noticeflow.operators.model_path import mask_strong
from noticeflow.plans.paths import privacy_report
from noticeflow.plans.spread import spread
from noticeflow.queries import query, table

K4 = "lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')"
K4B = "lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0')"
K3 = "lpad(CAST(c_custkey * 3 % 1000 AS STRING), 3, '0')"
D2 = "CAST(c_custkey % 30 + 1 AS STRING)"
ONE6 = "CAST(c_custkey % 6 + 1 AS STRING)"
# 12 digits of a resident number and the check digit behind them
_RRN12 = ["9", "0", "0", "1", "0", "1", "1", "(c_custkey // 10000 % 10)", "(c_custkey // 1000 % 10)",
          "(c_custkey // 100 % 10)", "(c_custkey // 10 % 10)", "(c_custkey % 10)"]
_RRN_SUM = " + ".join(f"{d} * {w}" for d, w in zip(_RRN12, (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)))
_RRN_CHECK = f"((11 - ({_RRN_SUM}) % 11) % 10)"
_RRN_BODY = "'900101-1' || lpad(CAST(c_custkey % 100000 AS STRING), 5, '0')"
_PERSON = "substring('김이박최정강조윤장임', CAST(c_custkey % 10 + 1 AS INT), 1) || substring('가나다라마바사아자차', CAST(c_custkey // 10 % 10 + 1 AS INT), 1) || '훈'"


def _spark(sql: str) -> str:
    return sql.replace(" // ", " div ")


def rule_query(name: str, parts: list, when: str = "TRUE"):
    """``parts``: text SQL, or (label, rule, value SQL, token).  Rows failing ``when`` expect the text untouched."""
    text = " || ".join(p if isinstance(p, str) else p[2] for p in parts)
    masked = " || ".join(p if isinstance(p, str) else f"'{p[3]}'" for p in parts)
    selects = []
    for i, p in enumerate(parts):
        if isinstance(p, str):
            continue
        before = " || ".join(["''", *(b if isinstance(b, str) else b[2] for b in parts[:i])])
        selects.append(f"SELECT c_custkey, {masked} AS masked, '{p[0]}' AS label, '{p[1]}' AS rule, "
                       f"CAST(length({before}) AS INT) AS span_start, {p[2]} AS value, '{p[3]}' AS token FROM customer "
                       f"WHERE {when}")
    if when != "TRUE":
        selects.append(f"SELECT c_custkey, {text}, '', '', -1, '', '' FROM customer WHERE NOT ({when})")

    @query(name, " UNION ALL ".join(selects))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = spread(table(spark, sf, "customer")).selectExpr("c_custkey", f"{_spark(text)} AS text")
        return M.mask(rows).selectExpr(
            "c_custkey", "masked", "explode_outer(spans) AS s").selectExpr(
            "c_custkey", "masked", "coalesce(s.label, '') AS label", "coalesce(s.rule, '') AS rule",
            "coalesce(s.start, -1) AS span_start", "coalesce(s.value, '') AS value", "coalesce(s.token, '') AS token")
    return run


rule_query("rule_mobile", ["'번호 '", ("phone", "mobile", f"'010-' || {K4} || '-' || {K4B}", "[전화1]"), "' 로 '"])
rule_query("rule_landline", ["'tel '", ("phone", "landline", f"'0' || CAST(31 + c_custkey % 5 AS STRING) || '.' || {K3} || '.' || {K4}",
                                        "[전화1]"), "' ok'"])
rule_query("rule_local_phone", ["'ext '", ("phone", "local_phone", f"{K3} || '-' || {K4}", "[전화1]"), "' ok'"])
rule_query("rule_email", ["'mail '", ("email", "email", "'u' || CAST(c_custkey AS STRING) || '@school.kr'", "[이메일1]"), "', ok'"])
rule_query("rule_document_code", ["'doc '", ("document_id", "document_code", f"'ab' || {K4} || {K4B}", "[문서번호1]"), "' ok'"])
rule_query("rule_account_id", ["'id '", ("document_id", "document_code", f"'K' || {K4} || {K4B} || '7'", "[문서번호1]"), "' ok'"])
rule_query("rule_licence_like", ["'no '", ("document_id", "licence_like", f"'AB-CDE-' || {K4}", "[문서번호1]"), "' ok'"])
rule_query("rule_ipv4", ["'host '", ("ip", "ipv4", "'10.' || CAST(c_custkey % 256 AS STRING) || '.0.' || CAST(c_custkey % 200 AS STRING)",
                                     "[IP1]"), "' up'"])
rule_query("rule_resident_number", [
    "'주민번호 '", ("id", "rrn", f"{_RRN_BODY} || CAST(({_RRN_CHECK} + CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END) % 10 AS STRING)",
                "[주민번호1]"), "' 끝'"], when="c_custkey % 3 <> 0")
rule_query("rule_number_triple", ["'x '", ("student_number", "triple", f"{ONE6} || '-' || {D2} || ' - ' || {D2}", "[학번1]"), "' y'"])
rule_query("rule_grade_class", ["'올해 2학년 '", ("klass", "grade_class", f"{D2} || '반'", "[반1]"), "' 소식'"])
rule_query("rule_compact_class", ["'x '", ("klass", "compact_class", f"{ONE6} || '-' || {D2} || '반'", "[반1]"), "' 소식'"])
rule_query("rule_explicit_number", ["'학생번호: '", ("student_number", "explicit_number", f"{D2} || '번'", "[학번1]"), "' 끝'"])
rule_query("rule_number_unit", [
    "CASE WHEN c_custkey % 4 = 0 THEN '문제 풀이 학생 좌석 ' ELSE '출석 좌석 ' END",
    ("student_number", "number_unit", f"{D2} || '번'", "[학번1]"), "' 확인'"], when="c_custkey % 4 <> 0")
rule_query("rule_compact", [
    "CASE WHEN c_custkey % 4 = 0 THEN '명렬 수업 ' ELSE '명렬 ' END", ("klass", "compact", f"{ONE6} || '-' || {D2}", "[반1]"),
    "' 확인'"], when="c_custkey % 4 <> 0")
rule_query("rule_five_digit", [
    "CASE WHEN c_custkey % 4 = 0 THEN '우편 ' ELSE '명렬 ' END", ("student_number", "five_digit", f"{ONE6} || {K4}", "[학번1]"),
    "' 확인'"], when="c_custkey % 4 <> 0")
rule_query("rule_roster", [
    "'학번' || chr(10) || '이름' || chr(10) || '전화번호' || chr(10)", ("student_number", "roster_id", f"'2' || {K4}", "[학번1]"),
    "chr(10)", ("person", "roster_name", _PERSON, "[이름1]"), "chr(10)",
    ("phone", "roster_phone", f"'010-' || {K4} || '-' || {K4B}", "[전화1]"), "chr(10)"])
rule_query("rule_secret", ["'비밀번호: '", ("secret", "secret", f"'pw!' || {K4}", "[비밀값1]"), "', 끝'"])
rule_query("rule_birth", ["'생년월일: '", ("birth", "birth", f"'2001.' || CAST(c_custkey % 12 + 1 AS STRING) || '.' || {D2}", "[생년월일1]"),
                          "' 끝'"])
rule_query("rule_labeled_id", ["'접수번호 '", ("document_id", "labeled_id", f"'zz-' || {K4}", "[문서번호1]"), "' 끝'"])
rule_query("rule_address", ["'위치 '", ("address", "address_line", f"'부산광역시 영도구 태종로 ' || {D2}", "[주소1]"), "' 옆'"])
rule_query("rule_private_url", [
    "'see '", ("url", "private_url", "CASE WHEN c_custkey % 2 = 0 THEN 'https://ex.org/a?token=z' || CAST(c_custkey AS STRING) "
               "ELSE 'https://ex.org/a?page=z' || CAST(c_custkey AS STRING) END", "[개인링크1]"), "' end'"], when="c_custkey % 2 = 0")
rule_query("rule_name_before_role", [
    "'오늘 '", ("person", "name_before_role", f"CASE WHEN c_custkey % 5 = 0 THEN '체육' ELSE {_PERSON} END", "[이름1]"),
    "' 선생님께 드림'"], when="c_custkey % 5 <> 0")
rule_query("rule_name_after_role", [
    "'담임 '", ("person", "name_after_role", f"CASE WHEN c_custkey % 5 = 0 THEN '회의' ELSE {_PERSON} END", "[이름1]"), "', 끝'"],
    when="c_custkey % 5 <> 0")
rule_query("rule_name_before_contact", [
    "'x '", ("person", "name_before_contact", _PERSON, "[이름1]"), "' '",
    ("email", "email", "'u' || CAST(c_custkey AS STRING) || '@school.kr'", "[이메일1]"), "' y'"])
rule_query("rule_labeled_name", ["'성명: '", ("person", "labeled_name", "'쀍' || substring('라마바', CAST(c_custkey % 3 + 1 AS INT), 1)",
                                            "[이름1]"), "', 끝'"])
rule_query("rule_self_name", ["'저('", ("person", "self_name", "'쀍' || substring('라마바', CAST(c_custkey % 3 + 1 AS INT), 1)", "[이름1]"),
                              "')가 담당합니다'"])
rule_query("overlap_choice", [
    "'주민 '", ("id", "rrn", f"{_RRN_BODY} || CAST({_RRN_CHECK} AS STRING)", "[주민번호1]"), "' 번호 '",
    ("phone", "mobile", f"'010-' || {K4} || '-' || {K4B}", "[전화1]"), "' 접수번호 '",
    ("document_id", "document_code", f"'ab' || {K4} || {K4B}", "[문서번호1]"), "' 끝'"])


# ---------------------------------------------------------------- token numbers and restore

@query("token_assignment", f"""
SELECT c_custkey, '[이메일1] ' || CASE WHEN c_custkey % 2 = 0 THEN '[이메일1]' ELSE '[이메일2]' END || ' [IP1] [이메일1]' AS masked,
       'a@x.org' AS first_value,
       CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'b' || c_custkey || '@x.org' END AS second_value, 4 AS n_spans
FROM customer
""")
def token_assignment(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", "concat('a@x.org ', if(c_custkey % 2 = 0, 'a', concat('b', c_custkey)), '@x.org 10.0.0.1 a@x.org') AS text")
    return M.mask(rows).selectExpr(
        "c_custkey", "masked", "element_at(mapping, '[이메일1]') AS first_value",
        "coalesce(try_element_at(mapping, '[이메일2]'), '') AS second_value", "size(spans) AS n_spans")


@query("restore_tokens", """
SELECT c_custkey, '김[이름2]님 ' || c_custkey || ' [이름9] [이름' AS restored FROM customer
""")
def restore_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", "'[이름1]님 [전화1] [이름9] [이름' AS text",
        "map('[이름1]', '김[이름2]', '[이름2]', '틀림', '[전화1]', string(c_custkey)) AS mapping")
    return rows.selectExpr("c_custkey", f"{M.restore_text('text', 'mapping')} AS restored")


@query("label_summary", """
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '이메일 2, IP 1' ELSE 'IP 1, 이메일 1' END AS summary FROM customer
""")
def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", "if(c_custkey % 2 = 0, 'a@x.org 10.0.0.1 b@x.org', '10.0.0.1 b@x.org') AS text")
    return M.mask(rows).selectExpr("c_custkey", f"{M.summary('spans')} AS summary")


# ---------------------------------------------------------------- documents

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?:^|[^0-9.])((?:{_OCTET}\.){{3}}{_OCTET})(?:$|[^0-9.])"
_SEP = r"[-.\s_]"
PHONE = (rf"(?:^|[^0-9._-])(01[016789]{_SEP}?[0-9]{{3,4}}{_SEP}?[0-9]{{4}}|0(?:2|[3-6][1-5]){_SEP}?[0-9]{{3,4}}{_SEP}?[0-9]{{4}}"
         rf"|[0-9]{{3,4}}{_SEP}[0-9]{{4}})(?:$|[^0-9])")
LOCAL = rf"(?:^|[^0-9._-])([0-9]{{3,4}}{_SEP}[0-9]{{4}})(?:$|[^0-9])"
_FOUND = f"""
found AS (SELECT doc_id, lang, 'email' AS label, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents
          UNION ALL SELECT doc_id, lang, 'ip', unnest(regexp_extract_all(text, '{IP}', 1)) FROM documents
          UNION ALL SELECT doc_id, lang, 'phone', unnest(regexp_extract_all(text, '{PHONE}', 1)) FROM documents)
"""
RULES = ("mobile", "landline", "local_phone", "email", "ipv4")


@query("privacy_report", f"""
WITH {_FOUND}
SELECT lang, label, count(*) AS n_spans, count(DISTINCT doc_id) AS n_documents, 0 AS n_not_restored
FROM found GROUP BY lang, label
""")
def privacy(spark: SparkSession, sf: str) -> DataFrame:
    return privacy_report(table(spark, sf, "documents"))


def _spans_query(name: str, rule: str, pattern: str, group: str) -> None:
    @query(name, f"SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}'{group})) AS value FROM documents")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return M.mask(table(spark, sf, "documents"), rules=[rule]).selectExpr("doc_id", "inline(spans)").select(
            "doc_id", "value")


_spans_query("documents_emails", "email", EMAIL, "")
_spans_query("documents_addresses", "ipv4", IP, ", 1")
_spans_query("documents_local_phones", "local_phone", LOCAL, ", 1")


@query("structured_detection", f"WITH {_FOUND} SELECT doc_id, label, count(*) AS n FROM found GROUP BY doc_id, label")
def structured_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Detected (not yet resolved) spans by label; a mobile number is also detected as other phone forms."""
    found = D.detect(table(spark, sf, "documents"), families=("structured",))
    return found.selectExpr("doc_id", "inline(detections)").groupBy("doc_id", "label").agg(
        F.countDistinct("start").alias("n"))


_EACH_RULE = {
    "mobile": ("phone", rf"(?:^|[^0-9._-])(01[016789]{_SEP}?[0-9]{{3,4}}{_SEP}?[0-9]{{4}})(?:$|[^0-9])", ", 1"),
    "landline": ("phone", rf"(?:^|[^0-9._-])(0(?:2|[3-6][1-5]){_SEP}?[0-9]{{3,4}}{_SEP}?[0-9]{{4}})(?:$|[^0-9])", ", 1"),
    "local_phone": ("phone", LOCAL, ", 1"), "email": ("email", EMAIL, ""), "ipv4": ("ip", IP, ", 1"),
    "document_code": ("document_id", "(?:^|[^A-Za-z0-9])([A-Za-z]{1,2}[0-9]{8,10})(?:$|[^0-9])", ", 1"),
    "private_url": ("url", r"https?://[^\s<>\"]*(?:token|auth|key|password|invite|signature)=[^\s<>\"]*", ""),
}


@query("all_rules_counts", "SELECT lang, rule, label, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT lang, '{r}' AS rule, '{label}' AS label, unnest(regexp_extract_all(text, '{p}'{g})) AS v FROM documents"
    for r, (label, p, g) in _EACH_RULE.items()) + ") GROUP BY ALL")
def all_rules_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Detections of every rule over the whole documents, by language and rule."""
    found = D.detect(table(spark, sf, "documents")).selectExpr("lang", "inline(detections)")
    return found.groupBy("lang", "rule", "label").agg(F.count("*").alias("n"))


@query("class_number_detection", """
SELECT c_custkey, '3-2' AS compact, '12번' AS unit, '20315' AS five FROM customer WHERE c_custkey % 2 = 0
""")
def class_number_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Context windows: the same numbers count only next to class words (34 characters to either side)."""
    far = "repeat('가나 ', 20)"
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", f"concat(if(c_custkey % 2 = 0, '명렬 3-2 출석 12번 좌석 20315', "
                     f"concat('명렬 ', {far}, '3-2 그리고 12번 또 20315 ', {far}, '좌석')), ' 끝') AS text")
    found = D.detect(rows, families=("class",)).selectExpr("c_custkey", "text", "inline(detections)").selectExpr(
        "c_custkey", "rule", "substring(text, start + 1, end - start) AS value")
    wide = found.groupBy("c_custkey").pivot("rule", ["compact", "number_unit", "five_digit"]).agg(F.first("value"))
    return wide.selectExpr("c_custkey", "compact", "number_unit AS unit", "five_digit AS five")


@query("masked_documents", f"""
WITH hit AS (SELECT doc_id, unnest(l) AS value, generate_subscripts(l, 1) AS i
             FROM (SELECT doc_id, regexp_extract_all(text, '{EMAIL}') AS l FROM documents)),
     first_use AS (SELECT doc_id, value, min(i) AS i FROM hit GROUP BY doc_id, value)
SELECT doc_id, value, '[이메일' || row_number() OVER (PARTITION BY doc_id ORDER BY i) || ']' AS token FROM first_use
""")
def masked_documents(spark: SparkSession, sf: str) -> DataFrame:
    return M.mask(table(spark, sf, "documents"), rules=["email"]).selectExpr("doc_id", "explode(mapping) AS (token, value)")


@query("restored_documents", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def restored_documents(spark: SparkSession, sf: str) -> DataFrame:
    masked = M.mask(table(spark, sf, "documents"))
    return masked.selectExpr("doc_id", f"md5({M.restore_text('masked', 'mapping')}) AS text_md5")


@query("label_totals", f"WITH {_FOUND} SELECT label, count(*) AS n FROM found GROUP BY label")
def label_totals(spark: SparkSession, sf: str) -> DataFrame:
    masked = M.mask(table(spark, sf, "documents"))
    return masked.selectExpr("inline(spans)").groupBy("label").agg(F.count("*").alias("n"))


@query("round_trip_audit", f"""
WITH {_FOUND}, n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id)
SELECT lang, sum(coalesce(n, 0)) AS n_masked, sum(CAST(doc_id % 10 = 0 AND coalesce(n, 0) > 0 AND doc_id IN (
       SELECT doc_id FROM found WHERE label = 'email') AS INTEGER)) AS n_bad
FROM documents LEFT JOIN n USING (doc_id) GROUP BY lang
""")
def round_trip_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth text already holds '[이메일1]', so it cannot restore exactly once an e-mail is masked."""
    texts = table(spark, sf, "documents").selectExpr("lang", "if(doc_id % 10 = 0, concat('[이메일1] ', text), text) AS text")
    checked = M.audit(M.mask(texts))
    return checked.groupBy("lang").agg(F.sum("n_masked").alias("n_masked"),
                                       F.expr("count_if(NOT round_trip)").alias("n_bad"))


# ---------------------------------------------------------------- model spans

@query("text_chunks", """
WITH c AS (SELECT doc_id, text, unnest(generate_series(0, greatest(CAST(ceil((length(text) - 600) / 500.0) AS BIGINT), 0))) AS chunk
           FROM documents)
SELECT doc_id, chunk, chunk * 500 AS chunk_start, md5(substring(text, chunk * 500 + 1, 600)) AS chunk_md5 FROM c
WHERE trim(substring(text, chunk * 500 + 1, 600), ' ' || chr(9) || chr(10) || chr(13)) <> ''
""")
def text_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return D.chunk_text(table(spark, sf, "documents").select("doc_id", "text")).selectExpr(
        "doc_id", "chunk", "chunk_start", "md5(chunk_text) AS chunk_md5")


@query("token_decoding", """
WITH t AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id AS i,
                  CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'B-private_person' WHEN 'error' THEN 'I-private_person'
                       WHEN 'signup' THEN 'I-private_date' ELSE 'S-private_date' END AS label,
                  event_id * 10 AS a, event_id * 10 + CASE WHEN event_id % 17 = 0 THEN 0 ELSE 8 END AS b,
                  (event_id % 100) / 100.0 AS score FROM events),
     m AS (SELECT *, label = 'O' OR a = b AS gap, split_part(label, '-', 1) AS prefix, split_part(label, '-', 2) AS cat FROM t),
     l AS (SELECT *, lag(gap, 1, TRUE) OVER w AS after_gap, lag(cat) OVER w AS before FROM m
           WINDOW w AS (PARTITION BY user_id, day ORDER BY i)),
     g AS (SELECT *, sum(CAST(NOT gap AND (prefix IN ('B', 'S') OR after_gap OR before <> cat) AS INTEGER))
                     OVER (PARTITION BY user_id, day ORDER BY i) AS span FROM l)
SELECT user_id, strftime(day, '%Y-%m-%d') AS day, min(cat) AS label, min(a) AS span_start, max(b) AS span_end,
       round(avg(score), 6) AS score
FROM g WHERE NOT gap GROUP BY user_id, day, span HAVING avg(score) >= 0.35
""")
def token_decoding(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "events").selectExpr(
        "user_id", "to_date(ts) AS day", "event_id AS i", "event_id * 10 AS char_start",
        "event_id * 10 + if(event_id % 17 = 0, 0, 8) AS char_end",
        "CASE event_type WHEN 'view' THEN 'O' WHEN 'click' THEN 'B-private_person' WHEN 'error' THEN 'I-private_person' "
        "WHEN 'signup' THEN 'I-private_date' ELSE 'S-private_date' END AS label", "(event_id % 100) / 100.0D AS score")
    return D.decode_tokens(tokens, ["user_id", "day"]).selectExpr(
        "user_id", "string(day) AS day", "label", "start AS span_start", "end AS span_end", "round(score, 6) AS score")


@query("span_trimming", """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '김민수' WHEN 1 THEN '박서연' WHEN 2 THEN '3월 ' || (c_custkey % 28 + 1) || '일'
                  ELSE 'x' || c_custkey END AS value, CASE WHEN c_custkey % 4 = 3 THEN 2 ELSE 0 END AS lead
FROM customer
""")
def span_trimming(spark: SparkSession, sf: str) -> DataFrame:
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", "CASE c_custkey % 4 WHEN 0 THEN '김민수님께' WHEN 1 THEN '박서연(' "
                     "WHEN 2 THEN concat('3월 ', c_custkey % 28 + 1, '일까지 ') ELSE concat(' (x', c_custkey, ').') END AS value",
        "CASE WHEN c_custkey % 4 < 2 THEN 'private_person' WHEN c_custkey % 4 = 2 THEN 'private_date' ELSE 'other' END AS label")
    return rows.selectExpr("c_custkey", f"inline(array({D.trim_span('label', 'value')}))").select("c_custkey", "value", "lead")


@query("model_span_gates", """
SELECT c_custkey, 'person' AS label, '김민수' AS value FROM customer
UNION ALL SELECT c_custkey, 'birth', '1985년 3월 12일' FROM customer WHERE c_custkey % 2 = 0
""")
def model_span_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Model spans: a meeting date stays, a date behind a birth word is masked, unknown labels are dropped."""
    rows = spread(table(spark, sf, "customer")).selectExpr(
        "c_custkey", "concat('김민수 선생님, 회의는 1999년 9월 3일. ', if(c_custkey % 2 = 0, '생년월일은 ', '다음 모임은 '), "
                     "'1985년 3월 12일.') AS text")
    found = ("array(named_struct('label', 'private_person', 'start', 0, 'end', 3, 'score', 0.9D), "
             "named_struct('label', 'private_date', 'start', instr(text, '1999') - 1, 'end', instr(text, '1999') + 10, 'score', 0.9D), "
             "named_struct('label', 'private_date', 'start', instr(text, '1985') - 1, 'end', instr(text, '1985') + 11, 'score', 0.9D), "
             "named_struct('label', 'colour', 'start', 4, 'end', 6, 'score', 0.9D))")
    rows = rows.select("*", F.expr(found).alias("found"))
    return rows.selectExpr("c_custkey", "text", f"inline({D.model_spans('text', 'found')})").selectExpr(
        "c_custkey", "label", "substring(text, start + 1, end - start) AS value")


def _address_scorer():
    """A stub of a model: pieces of what looks like an address, as far as the text it gets shows it."""
    import re
    found = re.compile(EMAIL)

    def score(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
        out = []
        for text in texts:
            tokens = []
            for m in found.finditer(text):
                tokens += [(i, min(i + 5, m.end()), "B-private_email" if i == m.start() else "I-private_email", 0.9)
                           for i in range(m.start(), m.end(), 5)]
            out.append(tokens)
        return out
    return score


@query("strong_masking", f"SELECT doc_id, ltrim(unnest(regexp_extract_all(text, '{EMAIL}')), '.') AS value FROM documents")
def strong_masking(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of whole texts, token scores, spans and masking; what two chunks share or cut is masked once."""
    found = mask_strong(table(spark, sf, "documents").select("doc_id", "text"), _address_scorer, "doc_id", name="addresses", families=())
    return found.selectExpr("doc_id", "inline(spans)").select("doc_id", "value")
