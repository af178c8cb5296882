"""Scalar functions whose warehouse semantics differ from the engine's, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units that a boundary difference counts, each with what it is counted in.
_EPOCH_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def date_diff(unit: str, start: Column, end: Column) -> Column:
    """Boundaries of the unit crossed from start to end, not whole units elapsed."""
    if unit in _EPOCH_SECONDS:
        seconds = lambda c: F.unix_seconds(F.date_trunc(unit, c).cast("timestamp"))
        return ((seconds(end) - seconds(start)) / _EPOCH_SECONDS[unit]).cast("bigint")
    if unit == "day":
        return F.datediff(end.cast("date"), start.cast("date")).cast("bigint")
    if unit == "week":
        return (F.datediff(F.date_trunc("week", end).cast("date"), F.date_trunc("week", start).cast("date")) / 7).cast("bigint")
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    if unit == "month":
        return months.cast("bigint")
    if unit == "quarter":
        return ((F.year(end) - F.year(start)) * 4 + F.quarter(end) - F.quarter(start)).cast("bigint")
    if unit == "year":
        return (F.year(end) - F.year(start)).cast("bigint")
    raise ValueError(f"unknown unit {unit}")


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """A date whose month and day may overflow in either direction."""
    return F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), month - 1), (day - 1).cast("int"))


def timestamp_from_parts(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """A timestamp without zone whose parts may overflow."""
    return date_from_parts(year, month, day).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, minute, second)


def add_months_keep_end(day: Column, months: Column) -> Column:
    """Months added; the last day of a month stays a last day."""
    moved = F.add_months(day, months)
    return F.when(day == F.last_day(day), F.last_day(moved)).otherwise(moved)


def day_of_week(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return F.dayofweek(day) - 1


def day_of_week_iso(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def div0(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, None).otherwise(b))


def strict_greatest(*columns: Column) -> Column:
    """Null if any argument is."""
    return F.when(_all_known(columns), F.greatest(*columns))


def strict_least(*columns: Column) -> Column:
    return F.when(_all_known(columns), F.least(*columns))


def _all_known(columns: tuple[Column, ...]) -> Column:
    known = F.lit(True)
    for c in columns:
        known = known & c.isNotNull()
    return known


def full_match(text: Column, pattern: str) -> Column:
    """Whether the whole text matches."""
    return text.rlike(f"^(?:{pattern})$")


def array_position0(values: Column, value: Column) -> Column:
    """The first place of a value, from 0; null if it is not there."""
    found = F.array_position(values, value)
    return F.when(found > 0, found - 1)


def array_except_multiset(a: Column, b: Column) -> Column:
    """a without as many of each value as b holds; the first copies go, the rest keep their order."""
    numbered = F.transform(a, lambda x, i: F.struct(x.alias("v"), F.size(F.filter(F.slice(a, 1, i + 1), lambda y: y == x)).alias("n")))
    left = F.filter(numbered, lambda s: s["n"] > F.size(F.filter(b, lambda y: y == s["v"])))
    return F.transform(left, lambda s: s["v"])


def object_drop_nulls(entries: Column) -> Column:
    """A map without its null values."""
    return F.map_filter(entries, lambda _, v: v.isNotNull())


def object_insert(entries: Column, key: Column, value: Column) -> Column:
    """The map with the key set to the value."""
    return F.map_concat(F.map_filter(entries, lambda k, _: k != key), F.create_map(key, value))


def object_delete(entries: Column, *keys: str) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys))


def object_pick(entries: Column, *keys: str) -> Column:
    return F.map_filter(entries, lambda k, _: k.isin(*keys))


def get_ignore_case(entries: Column, key: str) -> Column:
    """The value of a key whatever its case; an exact match comes first, then the least key."""
    exact = F.try_element_at(entries, F.lit(key))
    close = F.array_sort(F.map_keys(F.map_filter(entries, lambda k, _: F.lower(k) == key.lower())))
    return F.coalesce(exact, F.try_element_at(entries, F.try_element_at(close, F.lit(1))))


def try_to_time(text: Column) -> Column:
    """A time of day as HH:mm:ss text, or null where there is none."""
    return F.date_format(F.try_to_timestamp(F.concat(F.lit("1970-01-01 "), text)), "HH:mm:ss")


def _variant_is(value: Column, *kinds: str) -> Column:
    return F.schema_of_variant(value).rlike(f"^(?:{'|'.join(kinds)})")


def is_array(value: Column) -> Column:
    return _variant_is(value, "ARRAY")


def is_object(value: Column) -> Column:
    return _variant_is(value, "OBJECT")


def is_decimal(value: Column) -> Column:
    """A whole or fixed-point number."""
    return _variant_is(value, "BIGINT", "DECIMAL")


def is_double(value: Column) -> Column:
    """Any number."""
    return _variant_is(value, "BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def strip_null_value(value: Column) -> Column:
    """The variant, or SQL's null for a JSON null."""
    return F.when(~F.is_variant_null(value), value)
