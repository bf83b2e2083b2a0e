"""Message store: column contract, scans by key, receive dates, health line.

Raw columns: MessageKey, Sender, ReceiveDate ('2026/07/16 17:04:52 (목)'), Title, MessageText and, optionally,
IsUnRead and DeletedDate.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import is_blank, rlike

REQUIRED = ("MessageKey", "Sender", "ReceiveDate", "Title", "MessageText")


class SchemaContractError(ValueError):
    """A source lacks required columns."""


def require_columns(df: DataFrame, required=REQUIRED) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SchemaContractError(f"missing columns: {missing}")
    return df


def receive_date(s: str) -> str:
    """First 19 characters as timestamp_ntz, null when they are not a date and time."""
    head = f"substring({s}, 1, 19)"
    shape = rlike(head, r"^\d{4}/\d{1,2}/\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$")
    return f"if({shape}, try_cast(replace({head}, '/', '-') as timestamp_ntz), null)"


def to_messages(raw: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Typed messages; rows without a readable receive date are dropped, nulls become ''.  Columns ``carry`` stay as they are."""
    unread = "coalesce(cast(IsUnRead as boolean), false)" if "IsUnRead" in raw.columns else "false"
    return raw.selectExpr(
        "cast(MessageKey as bigint) AS key", "coalesce(Sender, '') AS sender",
        f"{receive_date('ReceiveDate')} AS received", "coalesce(Title, '') AS title",
        "coalesce(MessageText, '') AS body", f"{unread} AS is_unread", *carry).filter("received IS NOT NULL")


def _stored(raw: DataFrame) -> DataFrame:
    require_columns(raw)
    return raw.filter("DeletedDate IS NULL") if "DeletedDate" in raw.columns else raw


def messages_after(raw: DataFrame, key: int, limit: int | None = None) -> DataFrame:
    """Messages with a larger key, oldest first; without a limit the scan stays fully parallel."""
    rows = _stored(raw).filter(F.col("MessageKey") > F.lit(key))
    if limit is not None:
        rows = rows.orderBy("MessageKey").limit(limit)
    return to_messages(rows)


def latest_messages(raw: DataFrame, limit: int = 10) -> DataFrame:
    """The n newest messages by key."""
    return to_messages(_stored(raw).orderBy(F.desc("MessageKey")).limit(limit))


def latest_key(raw: DataFrame) -> DataFrame:
    """One row: the largest key, 0 when empty (deleted messages count)."""
    return require_columns(raw).agg(F.coalesce(F.max("MessageKey"), F.lit(0)).cast("bigint").alias("latest_key"))


def health(raw: DataFrame) -> DataFrame:
    """One row ``status``: largest key and the newest message, or that there is none."""
    alive = "DeletedDate IS NULL" if "DeletedDate" in raw.columns else "true"
    top = require_columns(raw).selectExpr(
        "MessageKey", f"if({alive}, MessageKey, null) AS k",
        f"struct({receive_date('ReceiveDate')} AS received, coalesce(Sender, '') AS sender, "
        "coalesce(Title, '') AS title) AS m").agg(
        F.coalesce(F.max("MessageKey"), F.lit(0)).alias("n"), F.max_by("m", "k").alias("m"))
    title = f"if({is_blank('m.title')}, '', concat(' 「', substring(m.title, 1, 20), '」'))"
    return top.selectExpr(
        "if(m.received IS NOT NULL, concat('✅ 연결 OK — 쪽지 키 최대 ', n, ', 최근: ', "
        f"date_format(m.received, 'yyyy-MM-dd HH:mm'), ' ', if(m.sender = '', '?', m.sender), {title}), "
        "concat('✅ 연결 OK — 받은 쪽지가 없습니다 (키 최대 ', n, ')')) AS status")
