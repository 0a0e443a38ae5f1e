"""Dates written in many layouts, shelf lives and product codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyleaf import fixed_values as fv
from tallyleaf.functions.text import let


def layout_and_date(text: Column) -> Column:
    """First layout, in catalogue order, that yields a real date, as (layout, date); both null without one.

    Layouts are tried one after the other until one gives a date, and a text is parsed only for layouts whose pattern it holds. Two-digit
    years from 69 on belong to the last century.
    """
    tries = []
    for name, pattern, fmt in fv.DATE_LAYOUTS:
        written = F.regexp_extract(text, pattern, 0)
        date = F.try_to_date(written, fmt)
        if fmt.endswith("/yy"):
            date = F.add_months(date, F.when(F.right(written, F.lit(2)) >= "69", -1200).otherwise(0))
        tries.append(F.when(text.rlike(pattern), F.concat(F.lit(name + "|"), date.cast("string"))))
    hit = F.coalesce(*tries)
    return F.struct(F.split_part(hit, F.lit("|"), F.lit(1)).alias("layout"), F.split_part(hit, F.lit("|"), F.lit(2)).cast("date").alias("date"))


def parse_date(text: Column) -> Column:
    return layout_and_date(text)["date"]


def add_shelf_life(start: Column, amount: Column, unit: Column, policy: str = "day28") -> Column:
    """Expiry date. ``day28`` caps the day of a month-based life at 28; ``calendar`` uses calendar months."""
    months = F.when(unit.isin("个月", "月"), amount)
    if policy == "calendar":
        by_month = F.add_months(start, months)
        by_year = F.add_months(start, amount * 12)
    else:
        total = F.month(start) + months - 1
        by_month = F.make_date(F.year(start) + F.floor(total / 12).cast("int"), (total % 12 + 1).cast("int"), F.least(F.day(start), F.lit(28)))
        leap = (F.month(start) == 2) & (F.day(start) == 29)
        lands = F.make_date(F.year(start) + amount, F.lit(2), F.lit(1))
        stays = F.day(F.last_day(lands)) == 29
        by_year = F.make_date(F.year(start) + amount, F.month(start), F.when(leap & ~stays, F.lit(28)).otherwise(F.day(start)))
    return F.when(unit.isin("天", "日"), F.date_add(start, amount)).when(months.isNotNull(), by_month).when(unit == "年", by_year)


def compute_expiry(production: Column, shelf_life: Column, policy: str = "day28") -> Column:
    """Expiry from written production date and shelf life; null when either cannot be read."""
    parts = [F.nullif(F.regexp_extract(production, fv.WRITTEN_DATE, i), F.lit("")) for i in (1, 2, 3)]
    start = F.try_to_date(F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0")), "yyyy-MM-dd")
    amount = F.nullif(F.regexp_extract(shelf_life, fv.WRITTEN_LIFE, 1), F.lit("")).try_cast("int")
    # Both are read once: the rules name them a dozen times, each of which would search the texts again.
    read = F.struct(start.alias("start"), amount.alias("amount"), F.regexp_extract(shelf_life, fv.WRITTEN_LIFE, 2).alias("unit"))
    return let(read, lambda r: add_shelf_life(r["start"], r["amount"], r["unit"], policy))


def expiry_status(expiry: Column, asof: Column, near_days: int = 30) -> Column:
    days = F.datediff(expiry, asof)
    return F.when(expiry.isNull(), "unknown").when(days < 0, "expired").when(days <= near_days, "near_expiry").otherwise("valid")


def dates_in(text: Column) -> Column:
    """Distinct dates of a text in order; labelled dates come first."""
    def found(pattern: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.filter(F.transform(hits, lambda m: F.try_to_date(F.concat_ws(
            "-", F.regexp_extract(m, fv.DATE_PARTS, 1), F.lpad(F.regexp_extract(m, fv.DATE_PARTS, 2), 2, "0"),
            F.lpad(F.regexp_extract(m, fv.DATE_PARTS, 3), 2, "0")), "yyyy-MM-dd")), lambda x: x.isNotNull())

    return F.array_distinct(F.concat(*[found(p) for p in fv.TEXT_DATES]))


def barcode_check(code: Column) -> Column:
    """valid, bad_length, not_digits or bad_check_digit by the standard check of 8, 12 and 13 digit codes."""
    n = F.length(code)
    digits = F.transform(F.regexp_extract_all(code, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("int"))
    weighted = F.transform(F.reverse(digits), lambda c, i: c * F.when(i % 2 == 1, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda a, c: a + c)
    return (F.when(~code.rlike("^[0-9]+$"), "not_digits").when(~n.isin(8, 12, 13), "bad_length")
            .when(total % 10 != 0, "bad_check_digit").otherwise("valid"))


def batch_check(batch: Column) -> Column:
    """empty, format, dated (holds a date) or valid."""
    text = F.trim(batch)
    long_date = F.try_to_date(F.nullif(F.regexp_extract(batch, r"\d{8}", 0), F.lit("")), "yyyyMMdd")
    short_date = F.try_to_date(F.nullif(F.regexp_extract(batch, r"\d{6}", 0), F.lit("")), "yyMMdd")
    return (F.when(batch.isNull() | text.isin("", "N/A", "null"), "empty").when(~batch.rlike(fv.BATCH_FORMAT), "format")
            .when(long_date.isNotNull() | short_date.isNotNull(), "dated").otherwise("valid"))
