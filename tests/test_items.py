import json
from datetime import date, datetime

import pytest

from noticeflow.functions.dates import parse_date, parse_time
from noticeflow.operators import inputs, quotes, timetable
from noticeflow.operators import responses as R
from noticeflow.operators.items import SERVICE_LIMITS
from noticeflow.plans import paths

DAY = date(2024, 2, 27)
REF = "date'2024-02-27'"


@pytest.mark.parametrize("s,want", [("2024-12-31", date(2024, 12, 31)), ("2023.2.5", date(2023, 2, 5)), ("2/29", date(2024, 2, 29)),
                                    ("2025년 11월 1일", date(2025, 11, 1)), ("2/27", DAY), ("2023-02-29", None), ("13/1", None),
                                    ("4/31", None), ("", None), ("추후 공지", None)])
def test_dates(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").selectExpr(parse_date("s", REF)).first()[0] == want


@pytest.mark.parametrize("s,want", [("00:00", 0), ("23:59", 1439), ("오후 12시", 720), ("오후 11시", 1380), ("7시 5분", 425), ("24:00", None),
                                    ("12:60", None), ("", None), ("점심", None)])
def test_times(spark, s, want):
    assert spark.createDataFrame([(s,)], "s string").selectExpr(parse_time("s")).first()[0] == want


def parse(spark, *raws, **options):
    df = spark.createDataFrame([(i, r, "meeting-log.txt", DAY) for i, r in enumerate(raws)],
                               "input_id int, raw string, source string, reference_date date")
    return R.parse_responses(df, **options).orderBy("input_id").collect()


def test_repeats_are_dropped_and_undated_events_counted(spark):
    depot = {"title": "Depot opening", "date": "2024-03-04", "time": "07:45", "kind": "event", "location": "Yard 3"}
    ledger = {"title": "Ledger upload", "date": "3/1", "kind": "task"}
    raw = json.dumps({"items": [depot, {"title": "Someday", "kind": "event"}, ledger, depot, {"title": "Nowhere", "kind": "event"}, ledger]})
    row = parse(spark, raw)[0]
    assert [(i.title, i.kind, i.all_day, i.start) for i in row["items"]] == [
        ("Ledger upload", "task", True, datetime(2024, 3, 1)), ("Depot opening", "event", False, datetime(2024, 3, 4, 7, 45))]
    assert row.skipped == 2 and row.warnings == ["날짜를 확정할 수 없는 항목 2개를 제외했습니다."]


def test_an_end_counts_only_after_the_start(spark):
    raw = json.dumps([{"title": "night shift", "date": "2024-05-01", "time": "22:00", "end_date": "2024-05-02", "end_time": "06:00"},
                      {"title": "backwards", "date": "2024-05-02", "time": "06:00", "end_date": "2024-05-01", "end_time": "22:00"},
                      {"title": "leap", "date": "2/29", "end_date": "3/1"}])
    ends = {i.title: i.end for i in parse(spark, raw)[0]["items"]}
    assert ends == {"night shift": datetime(2024, 5, 2, 6), "backwards": None, "leap": datetime(2024, 3, 1)}


def test_without_a_role_no_scope_is_judged(spark):
    raw = json.dumps({"scope": "irrelevant", "scope_reason": "for drivers", "items": [{"title": "Tyre change", "date": "3/8"}]})
    free, judged, kept = (parse(spark, raw, **o)[0] for o in (
        {}, {"persona": "'accountant'"}, {"persona": "'accountant'", "skip_irrelevant": "false"}))
    assert (free.scope, len(free["items"]), len(judged["items"]), len(kept["items"])) == ("relevant", 1, 0, 1)
    assert "for drivers" in judged.warnings[-1]


def test_the_day_of_the_cut_off_is_not_past(spark):
    days = ["2024-03-03", "2024-03-04", None]
    raw = json.dumps({"items": [{"title": f"job {i}", "date": d, "kind": "task"} for i, d in enumerate(days)]})
    row = parse(spark, raw, drop_before="date'2024-03-04'")[0]
    assert sorted(i.title for i in row["items"]) == ["job 1", "job 2"] and row.n_past == 1
    assert row.warnings == ["03/04 이전의 지나간 항목 1개를 제외했습니다: job 0"]


def test_plans_of_responses_have_no_shuffle(spark):
    df = spark.createDataFrame([(1, "{}", "s", DAY)], "input_id int, raw string, source string, reference_date date")
    plan = R.explode_items(R.parse_responses(df), "input_id")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_message_layout_and_the_length_of_the_history(spark):
    body = "new: send the crate numbers\n\n----- 원본 메시지 -----\n" + "crate list 4711 " * 400
    df = spark.createDataFrame([(1, "Lee", "re", body, datetime(2024, 2, 27, 9))],
                               "key bigint, sender string, title string, body string, received timestamp_ntz")
    cut, none, whole = (inputs.messages_to_inputs(df, n).first().text for n in (150, 0, None))
    assert cut.index("[최근 내용]") < cut.index("[이전 대화") and cut.endswith("…(이하 생략)") and cut.count("4711") < 12
    assert "4711" not in none and "[최근 내용]" in none
    assert whole.count("4711") == 400 and not whole.endswith("…(이하 생략)")


def test_quote_signs_need_a_majority(spark):
    bodies = ["top\n> one", "top\n> one\nmine\nmine again", "> all\n> quoted", " ", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    got = [(r.recent, r.older) for r in quotes.split_quotes(df).orderBy("id").collect()]
    assert got[1] == (bodies[1], "") and got[3:] == [("", ""), ("", "")]
    assert got[2] == (bodies[2], "")


def test_a_later_first_lesson_shifts_the_morning_only(spark):
    periods = "array('09:10','09:50','10:35','11:20','13:10','13:55','14:40')"
    row = spark.range(1).selectExpr(f"inline(array({timetable.cascade('0', periods, '40', '5', chr(39) + 'x' + chr(39), chr(39) + 'x' + chr(39))}))").first()
    assert row.periods == ["09:10", "09:55", "10:40", "11:25", "13:10", "13:55", "14:40"]


def test_an_item_in_the_tail_of_a_long_text_is_kept(spark):
    text = "filler words " * 4000 + "inspection on 2024-03-09"
    rows = spark.createDataFrame([("a", "text", text, "long.txt", DAY)], "input_id string, kind string, text string, source_label string, reference_date date")
    whole, cut = paths.build_requests(rows), paths.build_requests(rows, max_chars=40_000)
    assert whole.first().prompt.count("inspection on 2024-03-09") == 1 and whole.first().warnings == []
    assert "inspection" not in cut.first().prompt and len(cut.first().warnings) == 1


def test_long_titles_stay_apart_unless_a_limit_is_given(spark):
    raw = json.dumps([{"title": "t" * 250 + end, "date": "3/4", "kind": "task"} for end in "ab"])
    assert len(parse(spark, raw)[0]["items"]) == 2
    assert len(parse(spark, raw, limits=SERVICE_LIMITS)[0]["items"]) == 1


@pytest.mark.parametrize("auto,lunch", [("true", ("12:05", "13:10")), ("false", ("12:00", "12:50"))])
def test_the_whole_day_is_refilled_and_lunch_follows_only_if_wanted(spark, auto, lunch):
    periods = "array('09:10','x','','11:00','13:10','13:00','')"
    row = spark.range(1).selectExpr(f"inline(array({timetable.cascade_all(periods, '40', '5', repr('12:00'), repr('12:50'), auto)}))").first()
    assert row.periods == ["09:10", "09:55", "10:40", "11:25", "13:10", "13:55", "14:40"]
    assert (row.lunch_start, row.lunch_end) == lunch
