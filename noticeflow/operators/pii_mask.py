"""Reversible masking: numbered tokens, mapping, restore, counts and the round-trip audit."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions import spans as S
from noticeflow.functions.text import cut, fn, let, once, pieces, q, strip
from noticeflow.operators import pii_rules as R
from noticeflow.operators.pii_detect import FAMILIES, rule_spans

TOKEN = r"\[(?:" + "|".join(R.PREFIXES.values()) + r")\p{Nd}+\]"
MASKED_SPAN = ("struct<start:int,end:int,label:string,rule:string,prio:int,confidence:double,value:string,"
               "token:string>")
MASKED = f"struct<masked:string,mapping:map<string,string>,spans:array<{MASKED_SPAN}>>"
_PREFIX_MAP = f"map({', '.join(q(v) for kv in R.PREFIXES.items() for v in kv)})"


def prefix_of(label: str) -> str:
    return f"coalesce(element_at({_PREFIX_MAP}, {label}), '정보')"


def mask_text(text: str, detections: str) -> str:
    """struct<masked, mapping, spans>: overlaps resolved, equal (label, stripped value) gets the same token."""
    untouched = (f"cast(named_struct('masked', {text}, 'mapping', cast(map() as map<string,string>), "
                 f"'spans', {S.empty(f'array<{MASKED_SPAN}>')}) as {MASKED})")

    def numbering(spans: str, values: str) -> str:
        """array<struct<token, first>> by place: numbers run per label over distinct stripped values in text order.

        Equal values are found by sorting, and the numbers by sorting their first places, so the cost stays near linear.
        """
        entry = fn(lambda v, i: f"struct({spans}[{i}].label AS l, {strip(v)} AS v, {i} AS i)", "v", "i")

        def first_places(rows: str) -> str:
            def step(acc: str, x: str) -> str:
                f = f"if({acc}.l <=> {x}.l AND {acc}.v <=> {x}.v, {acc}.f, {x}.i)"
                return let(f, lambda at: (f"named_struct('l', {x}.l, 'v', {x}.v, 'f', {at}, 'out', array_append({acc}.out, "
                                          f"struct({x}.l AS l, {at} AS f, {x}.i AS i)))"))
            state = {"l": "cast(null as string)", "v": "cast(null as string)", "f": "-1"}
            return S.fold(rows, state, "array<struct<l:string,f:int,i:int>>", step)

        def numbers(rows: str) -> str:
            def step(acc: str, x: str) -> str:
                n = f"if({acc}.l <=> {x}.l, if({acc}.f = {x}.f, {acc}.n, {acc}.n + 1), 1)"
                return let(n, lambda at: (
                    f"named_struct('l', {x}.l, 'f', {x}.f, 'n', {at}, 'out', array_append({acc}.out, struct({x}.i AS i, "
                    f"concat('[', {prefix_of(x + '.l')}, {at}, ']') AS token, {x}.f = {x}.i AS first)))"))
            state = {"l": "cast(null as string)", "f": "-1", "n": "0"}
            return S.fold(rows, state, "array<struct<i:int,token:string,first:boolean>>", step)

        places = let(f"array_sort(transform({values}, {entry}))", first_places)
        return f"array_sort({let(f'array_sort({places})', numbers)})"

    def assemble(spans: str, parts: str, values: str, tokens: str) -> str:
        end_before = lambda i: f"if({i} = 0, 0, get({spans}, {i} - 1).end)"
        pieces_out = fn(lambda s, i: f"concat({cut(parts, end_before(i), s + '.start')}, {tokens}[{i}].token)", "s", "i")
        tail = cut(parts, f"element_at({spans}, -1).end", f"length({text})")
        first_use = (f"transform(filter({tokens}, {fn(lambda t: t + '.first')}), "
                     f"{fn(lambda t: f'struct({t}.token, {values}[{t}.i])')})")
        span_out = fn(lambda s, i: (
            f"named_struct('start', {s}.start, 'end', {s}.end, 'label', {s}.label, 'rule', {s}.rule, 'prio', {s}.prio,"
            f" 'confidence', {s}.confidence, 'value', {values}[{i}], 'token', {tokens}[{i}].token)"), "s", "i")
        return (f"cast(named_struct('masked', concat(array_join(transform({spans}, {pieces_out}), ''), {tail}), "
                f"'mapping', map_from_entries({first_use}), 'spans', transform({spans}, {span_out})) as {MASKED})")

    def numbered(spans: str, parts: str) -> str:
        values = f"transform({spans}, {fn(lambda s: cut(parts, s + '.start', s + '.end'))})"
        return let(values, lambda vs: let(numbering(spans, vs), lambda ts: assemble(spans, parts, vs, ts)))

    return let(S.choose(detections), lambda spans: (
        f"if(size({spans}) = 0, {untouched}, {let(pieces(text), lambda parts: numbered(spans, parts))})"))


def mask(df: DataFrame, text: str = "text", families=FAMILIES, rules=None,
         extra_spans: str | None = None) -> DataFrame:
    """Add ``masked``, ``mapping`` (token -> value) and ``spans``.

    ``extra_spans`` joins model detections to the rule detections.
    """
    found = rule_spans(text, families, rules)
    if extra_spans is not None:
        found = f"concat({found}, {extra_spans})"
    return once(df, mask_text(text, found))


def restore_text(text: str, mapping: str) -> str:
    """Replace known tokens by their value in one pass; unknown tokens and inserted values are left alone."""
    def rebuild(tokens: str) -> str:
        join = fn(lambda g, t: f"concat({g}, coalesce(element_at({mapping}, {t}), {t}, ''))", "g", "t")
        return (f"if(size({tokens}) = 0, {text}, array_join(zip_with(split({text}, {q(TOKEN)}, -1), {tokens}, {join}), "
                f"''))")

    return (f"if(contains({text}, '[') AND {mapping} IS NOT NULL, "
            f"{let(f'regexp_extract_all({text}, {q(TOKEN)}, 0)', rebuild)}, {text})")


def label_counts(spans: str) -> str:
    """array<struct<label,n>> in first-seen order."""
    def count(labels: str) -> str:
        each = fn(lambda label: f"named_struct('label', {label}, 'n', size(filter({labels}, "
                                f"{fn(lambda x: f'{x} = {label}')})))")
        return f"transform(array_distinct({labels}), {each})"
    return let(f"transform({spans}, {fn(lambda s: s + '.label')})", count)


def summary(spans: str) -> str:
    """'이름 2, 전화 1' in first-seen order."""
    each = fn(lambda c: f"concat({prefix_of(c + '.label')}, ' ', {c}.n)")
    return f"array_join(transform({label_counts(spans)}, {each}), ', ')"


def audit(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_masked`` and ``round_trip`` (restoring the masked text gives the text).

    A text that already holds something shaped like a token may not restore exactly; such rows show
    ``round_trip = false`` instead of being hidden.
    """
    return df.select("*", F.size("spans").alias("n_masked"),
                     F.expr(f"{restore_text('masked', 'mapping')} <=> {text}").alias("round_trip"))
