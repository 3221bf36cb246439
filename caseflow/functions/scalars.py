"""Scalar functions: time in microseconds, granules, rule predicates, maps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_HOUR = 3_600_000_000
MICROS_DAY = 24 * MICROS_HOUR
DIVISORS_OF_DAY = [d for d in range(1, 1441) if 1440 % d == 0]
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
FIRING_NAMES = {"batch_size": "size", "batch_ready_wt": "ready_wt", "batch_max_wt": "large_wt", "daily_hour": "daily_hour", "week_day": "week_day"}


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def whole_seconds(us: Column) -> Column:
    return F.floor(us / F.lit(1_000_000)).cast("long")


def hour_of(us: Column) -> Column:
    """Hours since 1970, floored."""
    return F.floor(us / F.lit(float(MICROS_HOUR))).cast("long")


def weekday_of_hour(h: Column) -> Column:
    """Monday = 0."""
    return F.pmod(F.floor(h / 24) + 3, F.lit(7)).cast("int")


def weekday_name(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), n + 1)


def weekday_number(name: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(d.lower()) for d in WEEKDAYS]), F.lower(name)) - 1).cast("int")


def nearest_divisor(g: Column) -> Column:
    """The largest divisor of 1440 that is at most g; null below 1."""
    divisors = F.array(*[F.lit(d) for d in DIVISORS_OF_DAY])
    return F.array_max(F.filter(divisors, lambda d: d <= g))


def safe_granularity(g: Column) -> Column:
    """g where it divides a day, else the nearest divisor below."""
    return F.when(F.lit(1440) % g == 0, g).otherwise(nearest_divisor(g))


def firing_name(attribute: Column, back: bool = False) -> Column:
    """A firing rule's attribute in the simulator's spelling, or back."""
    pairs = [x for k, v in FIRING_NAMES.items() for x in ((v, k) if back else (k, v))]
    return F.element_at(F.create_map(*map(F.lit, pairs)), attribute)


def merged(left: Column, right: Column) -> Column:
    """The union of two maps; where both have a key, right wins."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_from_entries(F.concat(F.map_entries(kept), F.map_entries(right)))


def process_name(path: str) -> str:
    """A file's name without any of its suffixes."""
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.split(".", 1)[0] if not name.startswith(".") else name


def pairs_of(distribution: Column) -> Column:
    """A map as an array of (key, value)."""
    return F.map_entries(distribution)


def map_of(pairs: Column) -> Column:
    return F.map_from_entries(pairs)


def iso_millis(us: Column) -> Column:
    """ISO 8601 with milliseconds, UTC."""
    ts = F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.floor(us / 1000) / 1000).cast("decimal(18,6)"))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+00:00"))


def comparison(attribute: Column, operator: str, value) -> Column:
    """One rule `attribute operator value`; `in` takes a list of values, or an interval (low, high) of numbers."""
    if operator == "=":
        return attribute == F.lit(value)
    if operator == ">":
        return attribute > F.lit(value)
    if operator == "<":
        return attribute < F.lit(value)
    if operator == "in":
        numbers = isinstance(value, tuple) and len(value) == 2
        return (attribute > F.lit(value[0])) & (attribute < F.lit(value[1])) if numbers else attribute.isin(list(value))
    raise ValueError(f"unknown comparison {operator!r}")


def any_of_all(rules: list[list[tuple[str, str, object]]]) -> Column:
    """A predicate from an OR of ANDs of (attribute, operator, value)."""
    if not rules:
        return F.lit(False)
    ands = [reduce(lambda a, b: a & b, [comparison(F.col(a), o, v) for a, o, v in group], F.lit(True)) for group in rules]
    return reduce(lambda a, b: a | b, ands)


def interval_rules(attribute: str, low: float, high: float) -> list[tuple[str, str, float]]:
    """An interval as two rules; an open end gives none."""
    out = []
    if low > float("-inf"):
        out.append((attribute, ">", low))
    if high < float("inf"):
        out.append((attribute, "<", high))
    return out
