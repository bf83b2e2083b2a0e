"""Match offsets without a UDF.

A pattern has three groups: what precedes the value, the value, what follows.  Replacing a match by itself with two
marks around the value and splitting on the first mark gives values and gaps in order, hence their offsets, from one
regex pass.  The marks are Unicode noncharacters; a text that holds them is searched in a copy of equal length.
"""
from __future__ import annotations

from noticeflow.functions.text import fn, let, q

OPEN, CLOSE = "\ufdd0", "\ufdd1"
MARK_VALUE = f"$1{OPEN}$2{CLOSE}$3"

MATCHES = "array<struct<start:int,end:int,value:string>>"
SPAN = "struct<start:int,end:int,label:string,rule:string,prio:int,ord:int,confidence:double>"
_RANKED = "array<struct<p:int,l:int,start:int,ord:int,end:int,label:string,rule:string,confidence:double>>"


def empty(array_type: str) -> str:
    return f"cast(array() as {array_type})"


CHUNK = 512


def fold(items: str, state: dict[str, str], out_type: str, step, finish=lambda acc: acc + ".out") -> str:
    """Fold an array with a growing result ``out`` beside the ``state``, chunk by chunk.

    An append copies the array, so one fold over n elements costs n squared.  Here a chunk grows its own result, which joins
    the whole once per chunk.  ``step(acc, item)`` gives a struct of the state and ``out``; ``items`` is evaluated often, so
    it should be bound by ``let``.
    """
    def struct_of(values: dict[str, str], out: str) -> str:
        return f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in values.items())}, 'out', {out})"

    def chunk(acc: str, c: str) -> str:
        inner = f"aggregate(slice({items}, {c} * {CHUNK} + 1, {CHUNK}), {struct_of({k: f'{acc}.{k}' for k in state}, empty(out_type))}, {fn(step, 'a', 'x')})"
        return let(inner, lambda i: struct_of({k: f"{i}.{k}" for k in state}, f"concat({acc}.out, {i}.out)"))

    return (f"aggregate(sequence(0, int((size({items}) - 1) div {CHUNK})), {struct_of(state, empty(out_type))}, "
            f"{fn(chunk, 'a', 'c')}, {fn(finish)})")


def searchable(text: str) -> str:
    """The text with the two marks, should they occur, replaced by another symbol of the same length."""
    return (f"if(contains({text}, {q(OPEN)}) OR contains({text}, {q(CLOSE)}), "
            f"translate({text}, {q(OPEN + CLOSE)}, {q(chr(0xFFFD) * 2)}), {text})")


def matches(text: str, pattern: str, marked_form: str = MARK_VALUE) -> str:
    """array<struct<start,end,value>> of the marked groups of all matches, in text order."""
    def step(acc: str, part: str) -> str:
        return let(f"substring_index({part}, {q(CLOSE)}, 1)", lambda value: (
            f"named_struct('pos', {acc}.pos + length({part}) - 1, 'out', array_append({acc}.out, named_struct("
            f"'start', {acc}.pos, 'end', {acc}.pos + length({value}), 'value', {value})))"))

    def offsets(ps: str) -> str:
        found = let(f"slice({ps}, 2, size({ps}) - 1)", lambda rest: fold(rest, {"pos": f"length({ps}[0])"}, MATCHES, step))
        return f"if(size({ps}) = 1, {empty(MATCHES)}, {found})"

    return let(f"split(regexp_replace({text}, {q(pattern)}, {q(marked_form)}), {q(OPEN)}, -1)", offsets)


def span(start: str, end: str, label: str, rule: str, prio: str, ordinal: str, confidence: str = "null") -> str:
    return (f"named_struct('start', int({start}), 'end', int({end}), 'label', {label}, 'rule', {rule}, "
            f"'prio', int({prio}), 'ord', int({ordinal}), 'confidence', double({confidence}))")


def choose(spans: str) -> str:
    """Resolve overlaps: higher priority, then longer, then earlier, then rule order; result in text order.

    The greedy choice only matters inside a run of spans that touch each other, so runs are closed as soon as the
    next span starts beyond them and each run is decided alone: cost follows the size of the runs, not of the text.
    """
    def rank(s: str) -> str:
        return (f"named_struct('p', -{s}.prio, 'l', {s}.start - {s}.end, 'start', {s}.start, 'ord', {s}.ord, "
                f"'end', {s}.end, 'label', {s}.label, 'rule', {s}.rule, 'confidence', {s}.confidence)")

    def keep(kept: str, s: str) -> str:
        clash = fn(lambda k: f"{s}.start < {k}.end AND {k}.start < {s}.end")
        return f"if(exists({kept}, {clash}), {kept}, array_append({kept}, {s}))"

    def decide(run: str) -> str:
        return f"if(size({run}) < 2, {run}, aggregate(array_sort({run}), {empty(_RANKED)}, {fn(keep, 'k', 's')}))"

    def step(acc: str, s: str) -> str:
        """Places at which a run begins: a span that starts where all before it have ended."""
        return (f"named_struct('reach', greatest({acc}.reach, {s}.end), 'at', {acc}.at + 1, "
                f"'out', if({s}.start >= {acc}.reach, array_append({acc}.out, {acc}.at), {acc}.out))")

    def runs(ordered: str, begins: str) -> str:
        end = lambda i: f"coalesce(get({begins}, {i} + 1), size({ordered}))"
        run = fn(lambda b, i: let(f"slice({ordered}, {b} + 1, {end(i)} - {b})", decide), "b", "i")
        return f"flatten(transform({begins}, {run}))"

    def resolve(found: str) -> str:
        def chosen(ordered: str) -> str:
            begins = fold(ordered, {"reach": "0", "at": "0"}, "array<int>", step)
            return let(begins, lambda at: let(f"transform({ordered}, {fn(rank)})", lambda ranked: runs(ranked, at)))

        back = fn(lambda r: span(f"{r}.start", f"{r}.end", f"{r}.label", f"{r}.rule", f"-{r}.p", f"{r}.ord",
                                 f"{r}.confidence"))
        return f"if(size({found}) < 2, {found}, array_sort(transform({let(f'array_sort({found})', chosen)}, {back})))"

    return let(spans, resolve)
