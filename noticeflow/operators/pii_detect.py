"""Detection of personal data as arrays of spans, all in JVM expressions."""
from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.functions import spans as S
from noticeflow.functions.text import (LINE_ENDS, all_of, any_of, ascii_digits, cut, fn, is_blank, let, pieces, q,
                                       replace_all, rlike, rx, strip)
from noticeflow.operators import pii_rules as R

SPANS = f"array<{S.SPAN}>"
NO_SPANS = S.empty(SPANS)
FAMILIES = ("structured", "class", "roster", "context")


# ---------------------------------------------------------------- gates

def date_with_hour(value: str) -> str:
    return rlike(strip(value), rx(f"^(?:{R.DATE_WITH_HOUR})\\z"))


def id_checksum(value: str) -> str:
    """Weighted sum over 12 digits mod 11 must give the 13th."""
    digits = (f"transform(regexp_extract_all({ascii_digits(value)}, '[0-9]', 0), "
              f"{fn(lambda d: f'int({d})')})")
    weights = f"array({', '.join(map(str, R.ID_WEIGHTS))})"

    def check(ds: str) -> str:
        products = f"zip_with(slice({ds}, 1, 12), {weights}, {fn(lambda a, b: f'{a} * {b}', 'a', 'b')})"
        total = f"aggregate({products}, 0, {fn(lambda a, b: f'{a} + {b}', 'a', 'b')})"
        return f"(size({ds}) = 13 AND (11 - {total} % 11) % 10 = get({ds}, 12))"

    return let(digits, check)


def looks_like_name(value: str, family_name: bool) -> str:
    """No role, particle or common word; optionally begins with a family name."""
    common = rf"^(?:{'|'.join(R.NOT_A_PERSON)})\z"

    def check(root: str) -> str:
        ok = [f"NOT {rlike(value, common + '|' + '|'.join(R.NOT_IN_A_NAME))}", f"NOT {rlike(root, common)}",
              f"length({root}) >= 2"]
        if family_name:
            ok.append(rlike(root, f"^(?:{'|'.join(R.SURNAMES_2)}|[{R.SURNAMES_1}])"))
        return all_of(*ok)

    return let(replace_all(value, R.NAME_PARTICLE, ""), check)


def private_url(value: str) -> str:
    return rlike(value, f"(?iu){R.PRIVATE_URL}")


VALUE_GATES: dict[str, Callable[[str], str]] = {
    "not_date_hour": lambda v: f"NOT {date_with_hour(v)}",
    "id_checksum": id_checksum,
    "private_url": private_url,
    "family_name": lambda v: looks_like_name(v, True),
    "name": lambda v: looks_like_name(v, False),
}
# gate -> (must occur, must not occur) within the window around the value
WINDOW_GATES = {
    "number_context": (R.POSITIVE, R.NUMBER_NEGATIVE),
    "compact_context": (R.POSITIVE, R.COMPACT_NEGATIVE),
    "strong_context": (R.STRONG, None),
}


def window(parts: str, start: str, end: str, before: int, after: int, size: str) -> str:
    return cut(parts, f"greatest({start} - {before}, 0)", f"least({end} + {after}, {size})")


# ---------------------------------------------------------------- rules to spans

def _facts(text: str) -> str:
    """What a text holds at all; most texts fail most of the rules' necessary conditions here."""
    digit = rlike(text, rx(r"\d"))
    return (f"named_struct('hangul', {rlike(text, '[가-힣]')}, 'digits1', {digit}, "
            f"'digits4', if({digit}, {rlike(text, rx(chr(92) + 'd{4}'))}, false))")


def _possible(text: str, rule: R.Rule, facts: str) -> str:
    checks: list[str] = []
    if rule.hangul:
        checks.append(f"{facts}.hangul")
    if rule.digits:
        checks.append(f"{facts}.digits{rule.digits}")
    if rule.any_of:
        checks.append(any_of(*[f"contains({text}, {q(v)})" for v in rule.any_of]))
    return all_of(*checks)


def _rule_spans(text: str, rule: R.Rule, ordinal: int, facts: str) -> str:
    found = S.matches(text, rx(rule.pattern, rule.flags))
    ready = _possible(text, rule, facts)
    if rule.gate in WINDOW_GATES:
        wanted, refused = WINDOW_GATES[rule.gate]

        def fits(w: str) -> str:
            return rlike(w, wanted) if refused is None else f"({rlike(w, wanted)} AND NOT {rlike(w, refused)})"

        def in_context(ms: str) -> str:
            near = let(pieces(text), lambda parts: f"filter({ms}, " + fn(lambda m: let(
                window(parts, f"{m}.start", f"{m}.end", R.WINDOW, R.WINDOW, f"length({text})"), fits)) + ")")
            return f"if(size({ms}) = 0, {ms}, {near})"

        found = let(found, in_context)
        ready = all_of(ready, rlike(text, wanted))
    elif rule.gate:
        found = f"filter({found}, {fn(lambda m: VALUE_GATES[rule.gate](m + '.value'))})"
    to_span = fn(lambda m: S.span(f"{m}.start", f"{m}.end", q(rule.label), q(rule.name), str(rule.prio), str(ordinal)))
    return f"if({ready}, transform({found}, {to_span}), {NO_SPANS})"


def _roster_spans(text: str) -> str:
    """Three consecutive lines number / name / phone, anywhere in a text that holds the roster header."""
    gap = rx(r"(?:(?![@])\s)*").replace("@", LINE_ENDS)[4:]
    brk = f"{gap}(?:\\r\\n|[{LINE_ENDS}]){gap}"
    number, name, phone = (rx(v)[4:] for v in R.ROSTER_VALUES)
    pattern = (f"(?d)((?<![^{LINE_ENDS}]){gap})({number})({brk})({name})({brk})({phone})"
               f"({gap}(?=[{LINE_ENDS}]|\\z))")
    o, c = S.OPEN, S.CLOSE
    found = S.matches(text, pattern, f"$1{o}$2{c}$3{o}$4{c}$5{o}$6{c}$7")
    labels = f"array({', '.join(q(label) for label, _ in R.ROSTER_PARTS)})"
    rules = f"array({', '.join(q(rule) for _, rule in R.ROSTER_PARTS)})"
    to_span = fn(lambda m, i: S.span(f"{m}.start", f"{m}.end", f"{labels}[{i} % 3]", f"{rules}[{i} % 3]", "5",
                                     f"{i} % 3 + {R.ROSTER_ORD}"), "m", "i")
    return f"if({rlike(text, rx(R.ROSTER_HEADER))}, transform({found}, {to_span}), {NO_SPANS})"


def rule_spans(text: str, families: Iterable[str] = FAMILIES, rules: Iterable[str] | None = None) -> str:
    """All detections of the chosen rule families (or of the named rules only), not yet resolved."""
    families = tuple(families)
    named = None if rules is None else set(rules)

    def by_rule(x: str, facts: str) -> str:
        arrays: list[str] = []
        blocks = (("structured", R.STRUCTURED, 0), ("class", R.CLASS_NUMBERS, len(R.STRUCTURED)),
                  ("roster", (), R.ROSTER_ORD), ("context", R.CONTEXTUAL, R.ROSTER_ORD + 3))
        for family, block, first in blocks:
            if family not in families:
                continue
            if family == "roster" and (named is None or named & {r for _, r in R.ROSTER_PARTS}):
                arrays.append(f"if({facts}.hangul, {_roster_spans(x)}, {NO_SPANS})")
            arrays += [_rule_spans(x, r, first + i, facts) for i, r in enumerate(block)
                       if named is None or r.name in named]
        return f"concat({', '.join(arrays)})" if arrays else NO_SPANS

    return let(S.searchable(f"coalesce({text}, '')"), lambda x: let(_facts(x), lambda facts: by_rule(x, facts)))


def detect(df: DataFrame, text: str = "text", out: str = "detections", **which) -> DataFrame:
    """Add the unresolved detections of each row (union of the rule families)."""
    return df.withColumn(out, F.expr(rule_spans(text, **which)))


# ---------------------------------------------------------------- model spans

def chunk_text(df: DataFrame, text: str = "text", size: int = 600, overlap: int = 100,
               keep_blank: bool = False) -> DataFrame:
    """Overlapping chunks ``(chunk, chunk_start, chunk_text)`` of each row; blank chunks are left out by default.

    The text is cut once into pieces of one step; a chunk is its piece plus the head of the following ones.
    """
    step = size - overlap
    reach = -(-size // step)
    x = f"coalesce({text}, '')"
    last = f"greatest(int(ceil((length({x}) - {size}) / {step})), 0)"

    def build(ps: str) -> str:
        body = fn(lambda i: f"named_struct('chunk', {i}, 'chunk_start', {i} * {step}, 'chunk_text', "
                            f"substring(array_join(slice({ps}, {i} + 1, {reach}), ''), 1, {size}))")
        return f"transform(sequence(0, {last}), {body})"

    chunks = let(pieces(x, step), build)
    if not keep_blank:
        chunks = f"filter({chunks}, {fn(lambda c: 'NOT ' + is_blank(c + '.chunk_text'))})"
    return df.select("*", F.expr(f"inline({chunks})"))


def decode_tokens(tokens: DataFrame, keys: list[str], min_score: float = 0.35) -> DataFrame:
    """Token labels to spans.

    ``tokens``: keys, ``i``, ``char_start``, ``char_end``, ``label`` (``B-x``, ``I-x``, ``O``...), ``score``.  A span
    starts at a B/S token, at a change of category and after an O or empty token; its score is the mean of its
    tokens.  ``keys`` name one chunk, whose length bounds the window.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    marked = tokens.select("*", F.expr("char_start = char_end OR label = 'O'").alias("_gap"),
                           F.expr("substring_index(label, '-', 1)").alias("_prefix"),
                           F.expr("if(contains(label, '-'), substring(label, instr(label, '-') + 1), '')").alias("_cat"))
    marked = marked.select("*", F.lag("_gap", 1, True).over(w).alias("_after_gap"), F.lag("_cat").over(w).alias("_before"))
    opens = F.expr("int(NOT _gap AND (_prefix IN ('B', 'S') OR _after_gap OR _before != _cat))")
    return (marked.select("*", F.sum(opens).over(w).alias("_span")).filter("NOT _gap").groupBy(*keys, "_span")
            .agg(F.first("_cat").alias("label"), F.min("char_start").alias("start"), F.max("char_end").alias("end"),
                 F.avg("score").alias("score"))
            .filter(F.col("score") >= min_score).drop("_span"))


def trim_span(label: str, value: str) -> str:
    """struct<lead,value>: blanks and brackets off both ends; a date ends at its last digit or 일; a name, handle or
    address loses up to two trailing particles while two characters remain.  ``lead`` = characters cut in front."""
    chars = q(R.TRIM_CHARS)
    lead = f"length({value}) - length(trim(LEADING {chars} FROM {value}))"

    def drop_particle(v: str) -> str:
        tries = [f"WHEN endswith({v}, '{p}') AND length({v}) >= {len(p) + 2} "
                 f"THEN substring({v}, 1, length({v}) - {len(p)})" for p in R.TRAILING_PARTICLES]
        return f"CASE {' '.join(tries)} ELSE {v} END"

    def by_label(body: str) -> str:
        dated = let(f"regexp_extract({body}, {q('(?s)^(.*(?:일|[0-9]))')}, 1)", lambda d: f"if({d} = '', {body}, {d})")
        named = let(let(body, drop_particle), drop_particle)
        return (f"CASE WHEN {label} = 'private_date' THEN {dated} WHEN {label} IN ('private_person', "
                f"'personal_handle', 'private_address') THEN {named} ELSE {body} END")

    return f"named_struct('lead', {lead}, 'value', {let(f'trim(BOTH {chars} FROM {value})', by_label)})"


def model_spans(text: str, found: str, strong: bool = True) -> str:
    """Spans of a token-classification model as detections.

    ``found``: array<struct<label,start,end,score>>.  Unknown labels are dropped; a date only counts as a birth date
    next to a birth word; identifiers shaped like dates and public links are dropped.
    """
    names = f"map({', '.join(q(v) for kv in R.MODEL_LABELS.items() for v in kv)})"
    rule = "strong_model" if strong else "model"

    def convert(m: str, label: str, parts: str) -> str:
        value, size = cut(parts, f"{m}.start", f"{m}.end"), f"length({text})"
        if strong:
            near = rlike(window(parts, f"{m}.start", f"{m}.start", 20, 0, size), R.BIRTH_HINT)
            refused = f"{label} IN ('id', 'document_id') AND {date_with_hour(value)}"
        else:
            near = rlike(window(parts, f"{m}.start", f"{m}.end", 30, 30, size),
                         rx(f"(?:{R.BIRTH_BEFORE})(?:{R.BIRTH_VALUE})"))
            refused = (f"({label} IN ('id', 'document_id', 'birth') AND {date_with_hour(value)}) OR "
                       f"({label} = 'url' AND NOT {private_url(value)})")
        made = S.span(f"{m}.start", f"{m}.end", label, q(rule), "2", str(R.MODEL_ORD), f"{m}.score")
        return f"if({label} IS NULL OR ({label} = 'birth' AND NOT {near}) OR {refused}, null, {made})"

    def all_found(parts: str) -> str:
        each = fn(lambda m: let(f"element_at({names}, {m}.label)", lambda label: convert(m, label, parts)))
        return f"filter(transform({found}, {each}), {fn(lambda s: s + ' IS NOT NULL')})"

    return f"if(coalesce(size({found}), 0) <= 0, {NO_SPANS}, {let(pieces(text), all_found)})"
