"""Per-user settings from JSON text: unknown keys ignored, missing keys defaulted, corrupt text all defaults."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.functions.text import let, once

# ---- fixed values: settings and their defaults
SCHEDULE_DEFAULTS: dict[str, tuple[str, str]] = {
    "default_target": ("string", "'auto'"),
    "kind_rules": ("string", "''"),
    "category_rules": ("string", "''"),
    "mask_pii": ("boolean", "true"),
    "mask_strong": ("boolean", "false"),
    "persona": ("string", "''"),
    "skip_irrelevant": ("boolean", "true"),
    "alarm_enabled": ("boolean", "true"),
    "alarm_minutes": ("int", "30"),
    "task_alarm_as_event": ("boolean", "true"),
    "source_text_chars": ("int", "1500"),
    "calendar_id": ("string", "'primary'"),
    "tasklist_id": ("string", "''"),
    "inbox_list_name": ("string", "'인박스'"),
    "complete_inbox_after_import": ("boolean", "true"),
}
MESSAGE_DEFAULTS: dict[str, tuple[str, str]] = {
    "enabled": ("boolean", "false"),
    "poll_seconds": ("int", "30"),
    "skip_existing_on_first_run": ("boolean", "true"),
    "last_message_key": ("bigint", "0"),
    "history_chars": ("int", "1200"),
}
TIMETABLE_DEFAULTS: dict[str, tuple[str, str]] = {
    "enabled": ("boolean", "true"),
    "work_start": ("string", "'08:30'"),
    "work_end": ("string", "'16:30'"),
    "period_minutes": ("int", "45"),
    "break_minutes": ("int", "10"),
    "periods": ("array<string>", "array('09:00', '09:55', '10:50', '11:45', '13:30', '14:25', '15:20')"),
    "lunch_start": ("string", "'12:30'"),
    "lunch_end": ("string", "'13:20'"),
    "lunch_auto": ("boolean", "true"),
}


def read_settings(df: DataFrame, json: str, defaults: dict[str, tuple[str, str]] = SCHEDULE_DEFAULTS,
                  section: str | None = None) -> DataFrame:
    """Add one typed column per setting."""
    base = "$" if section is None else f"$.{section}"

    def fields(v: str) -> str:
        return "named_struct(" + ", ".join(
            f"'{k}', coalesce(try_variant_get({v}, '{base}.{k}', '{t}'), {d})" for k, (t, d) in defaults.items()) + ")"

    return once(df, let(f"try_parse_json({json})", fields))


def settings_for(rows: DataFrame, settings: DataFrame, user: str = "user_id") -> DataFrame:
    """Rows with their user's settings; users without a row get the defaults."""
    joined = rows.join(settings, user, "left")
    out = [F.coalesce(c, F.expr(SCHEDULE_DEFAULTS[c][1])).alias(c) if c in SCHEDULE_DEFAULTS and c in settings.columns
           else F.col(c) for c in joined.columns]
    return joined.select(*out)
