import pytest
from pyspark.sql import functions as F

from noticeflow.operators import pii_detect as D
from noticeflow.operators import pii_mask as M

MEMO = ("창고 열쇠는 오세훈 과장님께. 연락처 010-9876-5432 또는 depot.desk@freight.example, 팩스 없음.\n"
        "비밀번호: q9!zx77 재발급. 다시 오세훈 과장님께 확인.")
CASES = {
    MEMO: "창고 열쇠는 [이름1] 과장님께. 연락처 [전화1] 또는 [이메일1], 팩스 없음.\n비밀번호: [비밀값1] 재발급. 다시 [이름1] 과장님께 확인.",
    "a@b.example, c@d.example, a@b.example": "[이메일1], [이메일2], [이메일1]",
    "010-2000-3000/010-2000-3000": "[전화1]/[전화1]",
    "번호 없이 물류 일정만 적은 줄": "번호 없이 물류 일정만 적은 줄",
    "5-3 문제와 2교시": "5-3 문제와 2교시",
    "": "",
    "끝 표시 ﷐﷑ 사이 x@y.example": "끝 표시 ﷐﷑ 사이 [이메일1]",
    "😀 m@n.example 😀 m@n.example": "😀 [이메일1] 😀 [이메일1]",
}


def resident_number(head: str) -> str:
    """Thirteen digits with the right check digit, from the first twelve."""
    weights = [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]
    return head + str((11 - sum(int(d) * w for d, w in zip(head, weights)) % 11) % 10)


def masked(spark, texts, **which):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return M.audit(M.mask(df, **which)).orderBy("id").collect()


def test_masking_and_round_trip(spark):
    for row, (text, want) in zip(masked(spark, CASES), CASES.items()):
        assert row.masked == want
        assert row.round_trip
        places = [(s.start, s.end) for s in row.spans]
        assert places == sorted(places) and all(a[1] <= b[0] for a, b in zip(places, places[1:]))
        assert all(text[s.start:s.end] == s.value for s in row.spans)


def test_resident_numbers_need_their_check_digit(spark):
    good = resident_number("851117204613")
    bad = good[:-1] + str((int(good[-1]) + 1) % 10)
    rows = masked(spark, [f"번호 {n[:6]}-{n[6:]} 끝" for n in (good, bad)])
    assert rows[0].masked == "번호 [주민번호1] 끝" and rows[1].n_masked == 0


@pytest.mark.parametrize("text", ["부서 회식 안내", "회의 자료 제출", "예산 담당 회의", "문서 번호 2024-118", "연락처 010-7777-8888"])
def test_common_words_are_no_names(spark, text):
    assert "[이름" not in masked(spark, [text])[0].masked


def test_long_text_with_many_spans_is_cut_exactly(spark):
    text = " ".join(f"u{i % 700}@x{i}.example 김😀 10.0.{i % 200}.1" for i in range(3000))
    row = masked(spark, [text])[0]
    assert row.n_masked == 6000 and row.round_trip
    assert len(row.mapping) == 3200


def test_restore_leaves_unknown_tokens_and_values_alone(spark):
    df = spark.createDataFrame([("[이메일2]와 [전화1], [이메일9]", {"[이메일2]": "x[전화1]", "[전화1]": "119"}), (None, None)],
                               "text string, mapping map<string,string>")
    got = [r[0] for r in df.selectExpr(M.restore_text("text", "mapping")).collect()]
    assert got == ["x[전화1]와 119, [이메일9]", None]


def test_text_holding_a_token_shows_as_not_restored(spark):
    row = masked(spark, ["[전화1] 010-5555-6666"])[0]
    assert row.n_masked == 1 and not row.round_trip


def test_no_python_in_masking_plans(spark):
    plan = M.audit(M.mask(spark.createDataFrame([("x",)], "text string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert plan.count("Generate") == 1


def test_model_spans_join_rule_spans(spark):
    df = spark.createDataFrame([("Mira q@z.example",)], "text string").withColumn("found", F.expr(
        "array(named_struct('label', 'private_person', 'start', 0, 'end', 4, 'score', 0.5D), "
        "named_struct('label', 'private_email', 'start', 5, 'end', 8, 'score', 0.9D))"))
    assert M.mask(df, extra_spans=D.model_spans("text", "found")).first().masked == "[이름1] [이메일1]"


@pytest.mark.parametrize("n", [0, 1, 600, 601, 1100, 1101, 3333])
def test_chunks_overlap_and_cover(spark, n):
    text = ("é𝄞x" * n)[:n]
    got = [(r.chunk_start, r.chunk_text) for r in D.chunk_text(spark.createDataFrame([(text,)], "text string")).orderBy("chunk").collect()]
    assert all(text[a:a + len(t)] == t for a, t in got) and [a for a, _ in got] == [500 * i for i in range(len(got))]
    assert (not n and not got) or (got[-1][0] + len(got[-1][1]) == n and all(len(t) == 600 for _, t in got[:-1]))


def test_the_older_gates_of_a_model(spark):
    """A birth date counts near a birth word on either side; a public link and a date taken for a number do not."""
    def found(text, label, value):
        at = text.index(value)
        df = spark.createDataFrame([(text,)], "text string").withColumn("found", F.expr(
            f"array(named_struct('label', '{label}', 'start', {at}, 'end', {at + len(value)}, 'score', 0.5D))"))
        return len(df.selectExpr(f"{D.model_spans('text', 'found', strong=False)} AS s").first().s)

    assert found("생년월일 1985-11-17", "private_date", "1985-11-17") == 1
    assert found("납품 1985-11-17", "private_date", "1985-11-17") == 0
    assert found("see https://freight.example/list", "private_url", "https://freight.example/list") == 0
    assert found("call Mira now", "private_person", "Mira") == 1 and found("call Mira now", "no_such_label", "Mira") == 0
