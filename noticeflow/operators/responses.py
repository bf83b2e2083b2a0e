"""Model responses to schedule items: lenient JSON, row validation, scope, warnings.

Everything is local to the row of one input, on VARIANT values and arrays, so it runs the same in a batch and in a
stream and needs no shuffle; :func:`explode_items` makes item rows at the end.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import all_of, any_of, collapse_spaces, fn, is_blank, let, once, q, rlike, rx, strip
from noticeflow.operators.inputs import excerpt
from noticeflow.operators.items import ITEM, ITEM_FIELDS, RAW_FIELDS, cut, is_past, normalize
from noticeflow.operators.pii_mask import restore_text

# ---- fixed values
REQUEST_CUE = (
    r"(해\s*주세요|해주세요|주시기\s*바랍니다|바랍니다|부탁|요망|제출|회신|확인\s*바|알려\s*주|작성해|참석\s*여부|협조|신청해|보내\s*주"
    r"|제출해|입력해|등록해)")
ROW_KEYS = ("items", "schedules", "events")
SCOPES = ("relevant", "irrelevant", "ambiguous")
NO_REASON = "(이유 없음)"
DEFAULT_CONFIDENCE = 0.8


# ---------------------------------------------------------------- JSON

def _parse(text: str) -> str:
    """The text as one JSON value or null.

    The parser stops after the first value, so the text is parsed inside brackets, where anything behind that value
    is an error, and must end as it begins.
    """
    whole = any_of(all_of(f"startswith({text}, '{{')", f"endswith({text}, '}}')"),
                   all_of(f"startswith({text}, '[')", f"endswith({text}, ']')"),
                   f"NOT {rlike(text, r'^[{\[]')}")

    def single(v: str) -> str:
        return let(f"try_variant_get({v}, '$', 'array<variant>')", lambda a: f"if(size({a}) = 1, {a}[0], null)")

    return f"if({whole}, {let(f'try_parse_json(concat({q(chr(91))}, {text}, {q(chr(93))}))', single)}, null)"


def extract_json(text: str) -> str:
    """First of: the whole text, each fenced block, first '{' to last '}', first '[' to last ']' that is JSON."""
    fence = rx(r"```(?:json)?\s*(.*?)```", "s")

    def between(a: str, b: str) -> str:
        first, last = f"instr({text}, '{a}')", f"(length({text}) - instr(reverse({text}), '{b}') + 1)"
        held = all_of(f"{first} > 0", f"contains({text}, '{b}')", f"{last} > {first}")
        return f"if({held}, {let(f'substring({text}, {first}, {last} - {first} + 1)', _parse)}, null)"

    fenced = (f"get(filter(transform(regexp_extract_all({text}, {q(fence)}, 1), "
              f"{fn(lambda b: let(strip(b), _parse))}), {fn(lambda v: v + ' IS NOT NULL')}), 0)")
    return (f"coalesce({let(strip(text), _parse)}, {fenced}, "
            f"{between('{', '}')}, {between('[', ']')})")


def _kind(v: str) -> str:
    return f"schema_of_variant({v})"


def _rows(data: str) -> str:
    """array<variant> of candidate rows in parsed JSON; members of a row value that is no list count as bad rows."""
    bad = "parse_json('null')"

    def as_rows(v: str, t: str) -> str:
        return (f"CASE WHEN {t} LIKE 'ARRAY%' THEN try_variant_get({v}, '$', 'array<variant>') "
                f"WHEN {t} LIKE 'OBJECT%' THEN array_repeat({bad}, "
                f"size(map_keys(try_variant_get({v}, '$', 'map<string,variant>')))) "
                f"WHEN {t} = 'STRING' THEN array_repeat({bad}, length(try_variant_get({v}, '$', 'string'))) END")

    def listed(key: str) -> str:
        rows = let(f"try_variant_get({data}, '$.{key}', 'variant')", lambda v: let(_kind(v), lambda t: as_rows(v, t)))
        return let(rows, lambda r: f"if(size({r}) > 0, {r}, null)")

    bare = any_of(*[f"try_variant_get({data}, '$.{k}', 'variant') IS NOT NULL" for k in ("title", "date")])
    none = "cast(array() as array<variant>)"
    return let(_kind(data), lambda t: (
        f"CASE WHEN {t} LIKE 'OBJECT%' THEN coalesce({', '.join(listed(k) for k in ROW_KEYS)}, "
        f"if({bare}, array({data}), {none})) "
        f"WHEN {t} LIKE 'ARRAY%' THEN try_variant_get({data}, '$', 'array<variant>') ELSE {none} END"))


def _raw(row: str, limits: dict[str, int]) -> str:
    """Raw item struct of a row, null when the row does not fit: no object, no title, or a wrong type."""
    def field(name: str) -> tuple[str, str]:
        t = _kind(f"try_variant_get({row}, '$.{name}', 'variant')")
        return f"coalesce({t} IN ('STRING', 'VOID'), true)", f"try_variant_get({row}, '$.{name}', 'string')"

    texts = {name: field(name) for name in RAW_FIELDS if name not in ("title", "confidence")}
    conf = f"try_variant_get({row}, '$.confidence', 'variant')"
    conf_kind = _kind(conf)
    conf_string = f"try_variant_get({row}, '$.confidence', 'string')"
    conf_text = f"try_cast({strip(conf_string)} as double)"
    conf_value = (f"CASE WHEN {conf} IS NULL OR {conf_kind} = 'VOID' THEN {DEFAULT_CONFIDENCE}D "
                  f"WHEN {conf_kind} = 'BOOLEAN' THEN double(try_variant_get({row}, '$.confidence', 'boolean')) "
                  f"ELSE {conf_text} END")
    title_kind = _kind(f"try_variant_get({row}, '$.title', 'variant')")
    title_text = f"try_variant_get({row}, '$.title', 'string')"
    title = cut(collapse_spaces(title_text), limits.get("title"))

    def build(tc: str) -> str:
        ok = all_of(f"{_kind(row)} LIKE 'OBJECT%'", f"{title_kind} = 'STRING'", f"{tc}.t <> ''",
                    *[good for good, _ in texts.values()], f"{tc}.c IS NOT NULL")
        kind = f"if(try_variant_get({row}, '$.kind', 'variant') IS NULL, 'event', {texts['kind'][1]})"
        fields = [f"'title', {tc}.t"] + [f"'{n}', {kind if n == 'kind' else v}" for n, (_, v) in texts.items()]
        return f"if({ok}, named_struct({', '.join(fields)}, 'confidence', {tc}.c), null)"

    return let(f"named_struct('t', {title}, 'c', {conf_value})", build)


# ---------------------------------------------------------------- items of one response

def _distinct_sorted(items: str) -> str:
    """First of equal (title, start, kind, undated), dated ones first, then by start; ties keep their order."""
    sep = q(chr(1))
    key = fn(lambda i: f"concat_ws({sep}, {i}.title, {i}.start, {i}.kind, {i}.undated)")

    def first(keys: str) -> str:
        pick = fn(lambda k: f"element_at({items}, int(array_position({keys}, {k})))")
        ordered = fn(lambda i, n: f"named_struct('u', {i}.undated, 's', {i}.start, 'n', {n}, 'item', {i})", "i", "n")
        return (f"transform(array_sort(transform(transform(array_distinct({keys}), {pick}), {ordered})), "
                f"{fn(lambda x: x + '.item')})")

    return let(f"transform({items}, {key})", first)


def items_of(data: str, ref: str, source: str, limits: dict[str, int] | None = None) -> str:
    """struct<items: array, skipped: int> of parsed JSON."""
    limits = limits or {}
    each = fn(lambda row: let(_raw(row, limits), lambda raw: f"if({raw} IS NULL, null, {normalize(raw, ref, source, limits)})"))

    def split(made: str) -> str:
        good = let(f"array_compact({made})", _distinct_sorted)
        bad = f"size({made}) - size(array_compact({made}))"
        return f"named_struct('items', {good}, 'skipped', {bad})"

    none = f"named_struct('items', cast(array() as array<{ITEM}>), 'skipped', 0)"
    made = let(f"transform({_rows(data)}, {each})", split)
    return f"if({data} IS NULL, {none}, {made})"


def _scope(data: str, most: int | None = None) -> str:
    """struct<scope, reason>; anything but the three values counts as relevant."""
    def text(key: str) -> str:
        return strip(f"coalesce(try_variant_get({data}, '$.{key}', 'string'), '')")

    names = ", ".join(q(s) for s in SCOPES)
    return let(f"lower({text('scope')})", lambda s: (
        f"named_struct('scope', if({s} IN ({names}), {s}, 'relevant'), "
        f"'reason', {cut(text('scope_reason'), most)})"))


def parse_responses(responses: DataFrame, raw: str = "raw", ref: str = "reference_date", source: str = "source", *,
                    drop_before: str = "cast(null as date)", persona: str = "''", skip_irrelevant: str = "true",
                    mapping: str = "cast(null as map<string,string>)", text: str = "''", n_images: str = "0",
                    source_chars: int | None = None, limits: dict[str, int] | None = None) -> DataFrame:
    """One row per response: ``error``, ``items``, ``skipped``, ``n_past``, ``scope``, ``scope_reason``, ``warnings``.

    Order of work: items, past items out, tokens restored, excerpt attached, scope applied.  All options are SQL
    expressions over the input row; scope only counts when a persona is given.  ``limits`` (such as ``SERVICE_LIMITS``) cuts
    titles, categories, places, notes and reasons; nothing is cut without it.
    """
    df = once(responses, f"named_struct('_data', {let(f'coalesce({raw}, {q(str())})', extract_json)})")
    df = once(df, items_of("_data", ref, source, limits), _scope("_data", (limits or {}).get("reason")))

    past = f"filter(items, {fn(lambda i: is_past(i, drop_before))})"
    titles = f"array_join(transform(slice(_past, 1, 3), {fn(lambda i: f'substring({i}.title, 1, 20)')}), ', ')"
    df = once(df, f"named_struct('_past', {past})")
    restored = fn(lambda i: _rebuild(i, mapping, excerpt(text, source_chars, n_images)))
    kept = f"transform(filter(items, {fn(lambda i: f'NOT {is_past(i, drop_before)}')}), {restored})"
    judged = f"NOT {is_blank(persona)}"
    df = once(df, f"named_struct('_kept', {kept}, '_scope', if({judged}, scope, 'relevant'), "
                  f"'_reason', if({judged}, reason, ''))")
    dropped = f"_scope = 'irrelevant' AND {skip_irrelevant} AND size(_kept) > 0"
    reason = f"if(_reason = '', '{NO_REASON}', _reason)"
    warnings = [
        "if(skipped > 0, concat('날짜를 확정할 수 없는 항목 ', skipped, '개를 제외했습니다.'), null)",
        f"if(size(_past) > 0, concat(date_format({drop_before}, 'MM/dd'), ' 이전의 지나간 항목 ', size(_past), "
        f"'개를 제외했습니다: ', {titles}), null)",
        f"if({dropped}, concat('내 업무와 무관한 내용으로 판단해 ', size(_kept), '개 항목을 등록하지 않습니다: ', {reason}), null)",
        f"if(_scope = 'ambiguous' AND size(_kept) > 0, concat('내 업무와 관련 있는지 불확실합니다: ', {reason}), null)",
    ]
    keep = [F.col(c) for c in responses.columns]
    return df.select(
        *keep, F.expr("if(_data IS NULL, '모델 응답을 해석할 수 없습니다', null)").alias("error"),
        F.expr(f"if({dropped}, cast(array() as array<{ITEM}>), _kept)").alias("items"), "skipped",
        F.size("_past").alias("n_past"), F.col("_scope").alias("scope"), F.col("_reason").alias("scope_reason"),
        F.expr(f"array_compact(array({', '.join(warnings)}))").alias("warnings"))


def _rebuild(item: str, mapping: str, source_text: str) -> str:
    """Item with its tokens restored in title, notes and place, and the source excerpt attached."""
    def value(name: str) -> str:
        if name == "title":
            return f"coalesce(nullif({restore_text(f'{item}.title', mapping)}, ''), {item}.title)"
        if name in ("notes", "location"):
            return restore_text(f"{item}.{name}", mapping)
        return source_text if name == "source_text" else f"{item}.{name}"

    return f"cast(named_struct({', '.join(f'{q(n)}, {value(n)}' for n in ITEM_FIELDS)}) as {ITEM})"


def explode_items(parsed: DataFrame, *keys: str) -> DataFrame:
    """Item rows with ``item_no`` (1-based)."""
    return parsed.select(*keys, F.posexplode("items").alias("_pos", "_item")).select(
        *keys, (F.col("_pos") + 1).alias("item_no"), "_item.*")


def mask_warning(spans: str, summary: str, n_images: str = "0") -> str:
    """array<string> of what masking did to the request."""
    return (f"array_compact(array(if(size({spans}) > 0, concat('🔒 개인정보 ', size({spans}), '곳을 가리고 AI에 보냈어요 (', "
            f"{summary}, ')'), null), if({n_images} > 0, '이미지 속 개인정보는 가릴 수 없어 그대로 전송됩니다.', null)))")


def has_request(text: str) -> str:
    return rlike(text, rx(REQUEST_CUE))


def retry_candidates(inputs: DataFrame, items: DataFrame, text: str = "text", key: str = "input_id") -> DataFrame:
    """Inputs without any item whose text asks for something."""
    return inputs.filter(has_request(text)).join(items.select(key).distinct(), key, "left_anti")


def no_items_note(kind: str, label: str, scope: str, reason: str, n_past: str) -> str:
    """One line for an input that gave no items: irrelevant, only past items, or none."""
    name = (f"CASE {kind} WHEN 'text' THEN '붙여넣은 텍스트' WHEN 'image' THEN '붙여넣은 이미지' "
            f"WHEN 'coolm' THEN concat('쿨메신저 쪽지(', replace({label}, '쿨메신저: ', ''), ')') "
            f"WHEN 'inbox_task' THEN concat('인박스 항목(', replace({label}, '인박스: ', ''), ')') ELSE {label} END")
    return let(name, lambda n: (
        f"CASE WHEN {scope} = 'irrelevant' THEN concat({n}, '은(는) 내 업무와 무관해 보여 넘겼어요 — ', "
        f"if(coalesce({reason}, '') = '', '역할 기준', {reason})) "
        f"WHEN {n_past} > 0 THEN concat({n}, '에는 이미 지난 일정만 있네요') ELSE concat({n}, '에 일정이 없네요') END"))
