"""New text against quoted history in a message body, and the message layout built from both."""
from __future__ import annotations

from pyspark.sql import DataFrame

from noticeflow.functions.text import (all_of, any_of, fn, is_blank, let, lines, once, q, replace_all, rlike, rx,
                                       strip)

# ---- fixed values: how messengers and mail clients mark quoted text
FORWARD_MARK = r"^[^\n]{0,100}?(?:님이\s*보낸\s*글|보낸\s*메시지(?:\s*전달)?|메시지\s*전달)\s*>>"
QUOTE_LINE = (
    r"^\s*("
    r"-{3,}\s*(original\s*message|원본\s*메시지|원본|이전\s*(메시지|쪽지|대화))\s*-{3,}"
    r"|[-=_─━]{6,}"
    r"|on\s.+\swrote:"
    r"|\d{4}[./-]\s?\d{1,2}[./-]\s?\d{1,2}.*(님이\s*(작성|씀)|wrote|작성함?)\s*[:：]?"
    r"|(re|회신|답장|fw|fwd|전달)\s*[:：]\s*$"
    r")\s*$")
HEADER_KEY = r"^\s*(from|보낸\s*사람|발신|발신자|sent|보낸\s*날짜|날짜|date|to|받는\s*사람|수신|subject|제목)\s*[:：]"
QUOTE_SIGN = r"^\s*>"
QUOTE_SIGNS = r"^\s*(>\s?)+"
RECENT_HEAD = "[최근 내용]"
NO_RECENT = "(본문 없음 — 아래 이전 대화만 있음)"
HISTORY_HEAD = "[이전 대화 (참고용 — 최근 내용이 가리키는 것을 해석할 때만 참고, 지나간 일정은 추출하지 말 것)]"
CUT_MARK = "\n…(이하 생략)"

_SPLIT = "struct<recent:string,older:string>"


def _mark(line: str) -> str:
    return any_of(rlike(line, rx(FORWARD_MARK)), rlike(line, rx(QUOTE_LINE, "iu")))


def _header(line: str) -> str:
    return rlike(line, rx(HEADER_KEY, "iu"))


def _signed(line: str) -> str:
    return rlike(line, rx(QUOTE_SIGN))


def _first_cut(ls: str) -> str:
    """Index of the line where quoted text begins, -1 for none; one pass with running counts."""
    def count(test) -> str:
        return f"size(filter({ls}, {fn(test)}))"

    def scan(totals: str) -> str:
        def step(a: str, line: str) -> str:
            headers = (f"size(filter(slice({ls}, {a}.i + 1, 4), "
                       f"{fn(lambda x: all_of('NOT ' + is_blank(x), _header(x)))})) >= 2")
            rest, signed = f"({totals}.filled - {a}.filled)", f"({totals}.signed - {a}.signed)"
            quoted = f"{rest} > 0 AND {signed} >= greatest(2, int({rest} * 0.6D))"
            here = any_of(_mark(line), all_of(f"{a}.i > 0", _header(line), headers),
                          all_of(f"{a}.i > 0", _signed(line), quoted))
            here = all_of(f"NOT ({a}.i = 0 AND {is_blank(line)})", here)
            moved = (f"named_struct('i', {a}.i + 1, 'cut', if({here}, {a}.i, -1), "
                     f"'filled', {a}.filled + int(NOT {is_blank(line)}), 'signed', {a}.signed + int({_signed(line)}))")
            return f"if({a}.cut >= 0, {a}, {moved})"

        zero = "named_struct('i', 0, 'cut', -1, 'filled', 0, 'signed', 0)"
        return f"aggregate({ls}, {zero}, {fn(step, 'a', 'l')}, {fn(lambda a: a + '.cut')})"

    totals = (f"named_struct('filled', {count(lambda x: 'NOT ' + is_blank(x))}, 'signed', {count(_signed)})")
    return let(totals, scan)


def split_recent(body: str) -> str:
    """struct<recent, older>; ``older`` is '' when nothing is quoted, and loses its quote signs otherwise."""
    def parts(ls: str) -> str:
        def build(cut: str) -> str:
            recent = strip(f"array_join(slice({ls}, 1, {cut}), {q(chr(10))})")
            quoted = strip(f"array_join(slice({ls}, {cut} + 1, size({ls}) - {cut}), {q(chr(10))})")
            unsigned = f"transform({lines(quoted)}, {fn(lambda x: replace_all(x, rx(QUOTE_SIGNS), ''))})"
            older = strip(f"array_join({unsigned}, {q(chr(10))})")
            whole = f"named_struct('recent', {strip(body)}, 'older', '')"
            return f"if({cut} < 0, {whole}, named_struct('recent', {recent}, 'older', {older}))"
        return let(_first_cut(ls), build)

    body = f"coalesce({body}, '')"
    return f"cast({let(lines('replace(' + body + ', ' + q(chr(13)) + ', ' + q('') + ')'), parts)} as {_SPLIT})"


def split_quotes(df: DataFrame, body: str = "body") -> DataFrame:
    """Add ``recent`` and ``older``."""
    return once(df, split_recent(body))


def message_text(title: str, sender: str, received: str, recent: str, older: str,
                 history_chars: int | None = None) -> str:
    """Text handed on for a message: title, sender, time, then the new part and the quoted one.

    The quoted part is whole without ``history_chars``, cut to as many characters, or left out for 0.
    """
    nl = q("\n")
    head = [f"if({is_blank(title)}, null, concat('제목: ', {strip(title)}))",
            f"if({is_blank(sender)}, null, concat('보낸 사람: ', {strip(sender)}))",
            f"concat('받은 시각: ', date_format({received}, 'yyyy-MM-dd HH:mm'))"]
    split_form = ["''", q(RECENT_HEAD), f"if({recent} = '', {q(NO_RECENT)}, {recent})"]
    if history_chars is None:
        split_form += ["''", q(HISTORY_HEAD), older]
    elif history_chars > 0:
        cut = f"if(length({older}) > {history_chars}, {q(CUT_MARK)}, '')"
        split_form += ["''", q(HISTORY_HEAD), f"concat(substring({older}, 1, {history_chars}), {cut})"]
    return (f"if({older} <> '', concat_ws({nl}, {', '.join(head + split_form)}), "
            f"concat_ws({nl}, {', '.join(head + [q(''), recent])}))")
