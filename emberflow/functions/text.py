"""Column expressions on dirty text: lenient numbers and times, digests, safe paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(c: Column) -> Column:
    """A finite double, or null for anything else: text that is no number, NaN, infinities."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def positive(c: Column) -> Column:
    x = number(c)
    return F.when(x > 0, x)


def hhmm(c: Column) -> Column:
    """``HHMM`` with leading zeros restored and a trailing ``.0`` dropped; longer text stays as it is, and so stays invalid."""
    t = F.regexp_replace(c, r"\.0$", "")
    return F.when(F.length(t) >= 4, t).otherwise(F.lpad(t, 4, "0"))


def acquired_at(day: Column, time: Column) -> Column:
    """A timestamp without zone from ``yyyy-MM-dd`` and HHMM text; null where either is invalid."""
    t = hhmm(time)
    valid = day.rlike(r"^\d{4}-\d{2}-\d{2}$") & t.rlike(r"^\d{4}$")
    whole = F.concat(day, F.lit(" "), F.substring(t, 1, 2), F.lit(":"), F.substring(t, 3, 2), F.lit(":00"))
    return F.when(valid, whole.try_cast("timestamp_ntz"))


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def short_id(prefix: str, c: Column) -> Column:
    """``prefix`` and the first 16 hexadecimal digits of the SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(c), 1, 16))


def safe_relative_path(c: Column) -> Column:
    """A relative image path without scheme, drive, parent folders, controls or further escapes; else null."""
    p = F.trim(F.regexp_replace(F.try_url_decode(c), r"\\", "/"))
    bad = p.rlike(r"^(?i)(/|[a-z][a-z0-9+.\-]*:)") | p.rlike(r"[\x00-\x1f%]") | p.rlike(r"(^|/)\.\.(/|$)") | ~p.rlike(r"(?i)\.(png|jpe?g|webp)$")
    return F.when(~bad, p)


def portable_preview(c: Column, folder: str = "sentinel") -> Column:
    """A preview's path below its last ``folder``, where that is safe; what lies elsewhere stays as it is."""
    p = F.replace(c, F.lit("\\"), F.lit("/"))
    inside = F.when(F.contains(p, F.lit(f"/{folder}/")), F.concat(F.lit(f"{folder}/"), F.substring_index(p, f"/{folder}/", -1)))
    return F.coalesce(safe_relative_path(inside), c)


def set_text(c: Column) -> Column:
    """Aggregate: the distinct values, sorted and joined by ``|``."""
    return F.concat_ws("|", F.array_sort(F.collect_set(c)))
