"""Column expressions shared by the marts, reports and jobs.  All JVM-side."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnmart import schemas


def full_name(last="last_name", first="first_name", middle="middle_name") -> Column:
    """'Last First Middle', the middle part only when present."""
    last, first, middle = (F.col(c) if isinstance(c, str) else c for c in (last, first, middle))
    return F.trim(F.concat(last, F.lit(" "), first, F.coalesce(F.concat(F.lit(" "), middle), F.lit(""))))


def short_name(last="last_name", first="first_name") -> Column:
    return F.concat(F.col(last), F.lit(" "), F.col(first))


def div_half_up(num: Column, den: Column) -> Column:
    """num / den rounded to an integer, halves away from zero; NULL when den is 0.

    Integer arithmetic end to end: a decimal quotient would be rounded once to
    its own scale and then again, which can move a half.
    """
    den = F.nullif(den, F.lit(0).cast("long"))
    magnitude = F.call_function("div", F.abs(num) * 2 + den, den * 2)
    return F.when(num < 0, -magnitude).otherwise(magnitude)


def _scaled(units: Column, places: int) -> Column:
    return (units.cast("decimal(18,0)") * F.lit(Decimal(1).scaleb(-places))).cast(f"decimal(18,{places})")


def pct1(num: Column, den: Column) -> Column:
    """num as a percentage of den, one decimal; NULL when num is NULL or den is 0/NULL."""
    return _scaled(div_half_up(num * 1000, den), 1)


def pct1_or_zero(num: Column, den: Column) -> Column:
    return F.coalesce(pct1(num, den), F.lit(Decimal("0.0")).cast("decimal(18,1)"))


def mean1(total_tenths: Column, n: Column) -> Column:
    """Mean of values given in tenths, one decimal."""
    return _scaled(div_half_up(total_tenths, n), 1)


def cents(amount: Column) -> Column:
    return (amount * 100).cast("decimal(28,0)")


def money_pct1(num: Column, den: Column) -> Column:
    """Percentage of two money columns; exact in cents, may be negative."""
    return _scaled(div_half_up(cents(num) * 1000, cents(den)), 1)


def money_mean(total: Column, n: Column) -> Column:
    return _scaled(div_half_up(cents(total), n.cast("decimal(18,0)")), 2)


def hours1(later: Column, earlier: Column) -> Column:
    """Hours between two timestamps, one decimal."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return _scaled(div_half_up(micros * 10, F.lit(3_600_000_000).cast("long")), 1)


def period_end(start: Column, subscription: Column) -> Column:
    """Last day of a paid period: a month or a year from the start, less one day."""
    months = F.when(subscription == "monthly", F.lit(1)).when(subscription == "yearly", F.lit(12))
    return F.date_sub(F.add_months(start, months), 1)


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy HH:mm")


def day(ts: Column) -> Column:
    return F.date_format(ts, "dd.MM.yyyy")


def over(a: str, b: str, sep: str = "/") -> Column:
    """'3/5' style text."""
    return F.concat(F.col(a).cast("string"), F.lit(sep), F.col(b).cast("string"))


def enum_order(col: Column, enum: str) -> Column:
    """Position of an enum value in its declaration order."""
    out = F.lit(None).cast("int")
    for i, value in reversed(list(enumerate(schemas.ENUMS[enum]))):
        out = F.when(col == value, F.lit(i)).otherwise(out)
    return out


def hash_id(*parts) -> Column:
    """Deterministic id from a natural key, so a retried write makes the same row."""
    return F.sha2(F.concat_ws("~", *[p if isinstance(p, Column) else F.col(p) for p in parts]), 256)


def zero(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(0))
