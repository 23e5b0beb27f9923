"""Numbers, dates and JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FACTS = "array<struct<content:string,type:string,scope:string,confidence:double>>"
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH", "yyyy-MM-dd")


def yuan_to_cents(yuan: Column) -> Column:
    """Times 100, halves rounded down (amounts of 0 or more)."""
    return F.ceil(yuan.cast("decimal(20,6)") * 100 - F.lit(0.5).cast("decimal(20,6)")).cast("long")


def cents_to_yuan(cents: Column) -> Column:
    """'12', '12.5' or '12.34': no trailing zeros."""
    s = F.format_string("%.2f", cents / 100.0)
    return F.regexp_replace(F.regexp_replace(s, r"\.00$", ""), r"(\.\d)0$", "$1")


def discount_to_percent(discount: Column) -> Column:
    """'8.5' is 85 percent, halves rounded down; null for blank."""
    return F.when(F.length(F.trim(discount)) > 0, F.ceil(F.trim(discount).cast("decimal(20,6)") * 10 - F.lit(0.5).cast("decimal(20,6)"))).cast("int")


def percent_to_discount(percent: Column) -> Column:
    """85 is '8.5': always one decimal."""
    return F.when(percent.isNotNull(), F.format_string("%.1f", percent / 10.0))


def legal_price(yuan: Column) -> Column:
    return F.coalesce(yuan_to_cents(F.nullif(F.trim(yuan), F.lit(""))) > 0, F.lit(False))


def round_half_up(value: Column, digits: int = 2) -> Column:
    scale = float(10**digits)
    return F.floor(value * scale + 0.5) / scale


def part_received(bitmap: Column, part: Column) -> Column:
    """Whether a part's bit is set: bit 7 - part % 8 of byte part / 8; parts behind the end are not."""
    byte = F.conv(F.hex(F.substring(bitmap, (part / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (F.lit(7) - part % 8).cast("int")) == 1, F.lit(False))


def parse_time(text: Column) -> Column:
    """Timestamps of 10, 13, 16 or 19 characters; null for others."""
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS))


def seconds_to_day_end(at: Column) -> Column:
    """Whole seconds to the next midnight, at least 1."""
    next_day = F.unix_micros(F.date_add(F.to_date(at), 1).cast("timestamp"))
    return F.greatest(F.floor((next_day - F.unix_micros(at.cast("timestamp"))) / 1_000_000), F.lit(1)).cast("long")


def retention_seconds(at: Column, days: int) -> Column:
    """Whole seconds to the last instant of the day `days` (at least 1) later, a day at least."""
    end = F.unix_micros(F.date_add(F.to_date(at), max(days, 1) + 1).cast("timestamp"))
    return F.greatest(F.ceil((end - F.unix_micros(at.cast("timestamp"))) / 1_000_000) - 1, F.lit(86_400)).cast("long")


def between(at: Column, first: Column, last: Column) -> Column:
    """Closed bounds; an absent time is outside."""
    return F.coalesce(at.between(first, last), F.lit(False))


def facts(text: Column, least: float = 0.65, keep: int = 5) -> Column:
    """Facts of a JSON array, fenced or not: content of 4 to 500 characters, confidence of at least `least`, the first `keep`."""
    bare = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", "")
    tidy = F.transform(
        F.from_json(bare, FACTS),
        lambda f: F.struct(
            F.trim(F.regexp_replace(f["content"], r"\s+", " ")).alias("content"),
            F.when(f["type"].isin("FACT", "PREFERENCE"), f["type"]).otherwise("FACT").alias("type"),
            F.when(f["scope"].isin("USER", "CONVERSATION"), f["scope"]).otherwise("USER").alias("scope"),
            f["confidence"].alias("confidence"),
        ),
    )
    good = F.filter(tidy, lambda f: F.length(f["content"]).between(4, 500) & (f["confidence"] >= least))
    return F.slice(good, 1, keep)


def context_trigger(window: Column, ratio: Column) -> Column:
    return F.floor(F.greatest(window, F.lit(8000)) * F.greatest(F.lit(0.1), F.least(F.lit(0.98), ratio))).cast("long")
