"""Event dates. The readers disagree on purpose, so each rule keeps its own name."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from plaintide.functions.common import WS, col, first_filled, text


def report_event_day(*cols: Column | str) -> Column:
    """First filled time as YYYY-MM-DD text; seven to nine characters give the month's first day."""
    raw = first_filled(*(cols or ("create_time", "reviewed_at", "created_at")))
    t = F.translate(raw, "/.", "--")
    return (F.when(F.length(t) >= 10, F.substring(t, 1, 10))
            .when(F.length(t) >= 7, F.concat(F.substring(t, 1, 7), F.lit("-01")))
            .otherwise(""))


def stats_day(*cols: Column | str) -> Column:
    """First usable of several values: Y-M-D with short parts, else eight leading digits."""
    def one(c) -> Column:
        s = F.translate(text(c), "/.", "--")
        rx = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
        y, m, d = (F.regexp_extract(F.substring(s, 1, 19), rx, i) for i in (1, 2, 3))
        mi, di = m.try_cast("int"), d.try_cast("int")
        parts = F.when((y != "") & mi.between(1, 12) & di.between(1, 31),
                       F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
        g = F.substring(F.regexp_replace(s, r"\D", ""), 1, 8)
        gm, gd = F.substring(g, 5, 2).try_cast("int"), F.substring(g, 7, 2).try_cast("int")
        digits = F.when((F.length(g) == 8) & gm.between(1, 12) & gd.between(1, 31),
                        F.concat_ws("-", F.substring(g, 1, 4), F.substring(g, 5, 2), F.substring(g, 7, 2)))
        return F.coalesce(parts, digits)
    return F.coalesce(*[one(c) for c in cols], F.lit(""))


def parse_time(c: Column | str) -> Column:
    """Timestamp from mixed text: slash or dash dates, short parts, optional clock after a space,
    or a bare month; text after the date is ignored; anything else is NULL."""
    s = F.regexp_replace(F.translate(text(c), "/", "-"), WS + "+", " ")
    head = F.regexp_extract(
        s, r"^(\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{1,2}(?::\d{1,2})?)?|\d{4}-\d{1,2}$)", 1)
    return F.try_to_timestamp(head, F.lit("yyyy-M[-d[ H:m[:s]]]"))


def event_time(reviewed: Column | str = "reviewed_at", created: Column | str = "create_time") -> Column:
    return F.coalesce(parse_time(reviewed), parse_time(created))


def iso_event_day(reviewed: Column | str = "reviewed_at", created: Column | str = "create_time") -> Column:
    """Date of the review time, else of creation; only ISO text parses."""
    raw = F.coalesce(F.nullif(col(reviewed), F.lit("")), col(created))
    return F.try_to_date(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(raw, 1, 10)), "yyyy-MM-dd")


def iso_day(c: Column | str) -> Column:
    raw = col(c)
    return F.try_to_date(F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(raw, 1, 10)), "yyyy-MM-dd")


def time_bucket(day: Column, grain: str) -> Column:
    """Label of the day, ISO week or month that holds ``day``."""
    if grain == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if grain == "week":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"),
                        F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if grain == "month":
        return F.date_format(day, "yyyy-MM")
    raise ValueError(f"unknown grain {grain!r}")


def region_bucket(c: Column | str = "country") -> Column:
    """``cn`` for an empty or Chinese country, ``rest`` otherwise."""
    v = text(c)
    home = (v == "") | v.contains("中国") | F.upper(v).isin("CN", "CHINA")
    return F.when(home, "cn").otherwise("rest")


def previous_window(start: Column, end: Column) -> tuple[Column, Column]:
    """The window of equal length that ends the day before ``start``."""
    days = F.greatest(F.datediff(end, start) + 1, F.lit(1))
    prev_end = F.date_sub(start, 1)
    return F.date_sub(prev_end, (days - 1).cast("int")), prev_end
