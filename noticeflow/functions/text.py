"""Text expressions with the whitespace, digit and line rules the operators share.

All helpers take and return Spark SQL expression text.  One ``F.expr`` per expression keeps plan building cheap (a
deep Column tree costs several driver round trips per node) and the expression readable in the plan.

Spark's regex engine is Java's, whose ``\\s \\d \\w`` are ASCII by default and whose ``.``/``$`` know more line
terminators than ``\\n``.  The operators define these classes over Unicode and lines by ``\\n``, so patterns are
written with the usual escapes and passed through :func:`rx`.
"""
from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CLASS = {"s": _SPACE, "d": r"\p{Nd}", "w": r"\p{L}\p{N}_"}

SPACES = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
# characters that end a line when text is split into lines
LINE_ENDS = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"

_WIDE_DIGITS = "".join(chr(0xFF10 + i) for i in range(10))


def rx(pattern: str, flags: str = "") -> str:
    """Expand ``\\s \\d \\w`` (and the negations) to Unicode classes; lines end at ``\\n`` only."""
    out: list[str] = []
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            e = pattern[i + 1]
            if e in _CLASS:
                out.append(_CLASS[e] if in_class else f"[{_CLASS[e]}]")
            elif e.lower() in _CLASS and not in_class:
                out.append(f"[^{_CLASS[e.lower()]}]")
            else:
                out.append(c + e)
            i += 2
            continue
        if c == "[":
            in_class = True
        elif c == "]":
            in_class = False
        out.append(c)
        i += 1
    return f"(?d{flags})" + "".join(out)


_names = itertools.count(1)


def q(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fresh(prefix: str = "v") -> str:
    return f"{prefix}{next(_names)}"


def fn(body: Callable[..., str], *prefixes: str) -> str:
    """Lambda text with fresh variable names."""
    names = [fresh(p) for p in (prefixes or ("v",))]
    args = names[0] if len(names) == 1 else f"({', '.join(names)})"
    return f"{args} -> {body(*names)}"


def let(value: str, body: Callable[[str], str]) -> str:
    """Evaluate ``value`` once and use it any number of times in ``body``, also inside lambdas.

    Catalyst may inline a projected column into the lambda that reads it, which would run it per element.
    """
    return f"get(transform(array({value}), {fn(body)}), 0)"


def once(df: DataFrame, *structs: str) -> DataFrame:
    """Add the fields of the structs as columns, each struct computed once per row.

    Several references to fields of a projected struct, or a filter on one, may make Catalyst repeat the whole
    expression; a generator of one row keeps it in one place.
    """
    for s in structs:
        df = df.select("*", F.expr(f"inline(array({s}))"))
    return df


def any_of(*conditions: str) -> str:
    return "(" + " OR ".join(conditions) + ")"


def all_of(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def rlike(c: str, pattern: str) -> str:
    return f"({c} RLIKE {q(pattern)})"


def replace_all(c: str, pattern: str, by: str) -> str:
    return f"regexp_replace({c}, {q(pattern)}, {q(by)})"


def strip(c: str) -> str:
    return f"trim(BOTH {q(SPACES)} FROM {c})"


def rstrip(c: str) -> str:
    return f"trim(TRAILING {q(SPACES)} FROM {c})"


def is_blank(c: str) -> str:
    """Null, empty or whitespace only."""
    return f"coalesce({strip(c)} = '', true)"


def collapse_spaces(c: str) -> str:
    return replace_all(strip(c), rx(r"\s+"), " ")


def no_spaces_lower(c: str) -> str:
    """Key for comparing list names: whitespace removed, lower case."""
    return f"lower({replace_all(c, rx(chr(92) + 's+'), '')})"


def lines(c: str) -> str:
    return f"split({c}, {q(chr(10))}, -1)"


def ascii_digits(c: str) -> str:
    return f"translate({c}, '{_WIDE_DIGITS}', '0123456789')"


def cut_label(c: str, n: int) -> str:
    """First ``n`` characters, with an ellipsis when something was cut."""
    return let(c, lambda v: f"if(length({v}) > {n}, concat(substring({v}, 1, {n}), '…'), {v})")


def tidy(c: str) -> str:
    """Drop carriage returns and blanks before a line end, keep at most one empty line, trim."""
    c = f"replace({c}, {q(chr(13))}, '')"
    c = replace_all(c, r"[ \t]+\n", "\n")
    c = replace_all(c, r"\n{3,}", "\n\n")
    return strip(c)


# ---------------------------------------------------------------- long texts

_PIECE = 1024


def pieces(c: str, size: int = _PIECE) -> str:
    """The text as an array of equal pieces, so that many cuts of a long text stay linear in its length."""
    return f"regexp_extract_all({c}, '(?s).{{1,{size}}}', 0)"


def cut(parts: str, start: str, end: str) -> str:
    """``text[start:end]`` (0-based, code points) from :func:`pieces`; offsets must lie inside the text."""
    first = f"int(({start}) div {_PIECE})"
    last = f"int((({end}) - 1) div {_PIECE})"
    joined = f"array_join(slice({parts}, {first} + 1, {last} - {first} + 1), '')"
    return (f"if(({end}) > ({start}), substring({joined}, int(({start}) - {first} * {_PIECE} + 1), "
            f"int(({end}) - ({start}))), '')")
