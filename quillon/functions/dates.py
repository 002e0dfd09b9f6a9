"""Date and time functions. Long columns are milliseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.errors import QueryError
from quillon.functions.registry import Scope, need, register


def moment(scope: Scope, name: str, options: dict | None = None) -> Column:
    """A timestamp without zone, moved from UTC to the zone in options, if any."""
    dtype, column = scope.dtype(name), scope.col(name)
    if isinstance(dtype, T.LongType):
        column = F.timestamp_millis(column)
    column = column.cast("timestamp_ntz")
    zone = (options or {}).get("timeZone")
    if zone:
        if zone is not True and not isinstance(zone, str):
            raise QueryError("timeZone must be true or a zone's name")
        column = F.convert_timezone(F.lit("UTC"), F.current_timezone() if zone is True else F.lit(zone), column)
    return column


def second_option(args: list, at: int) -> dict | None:
    options = args[at] if len(args) > at else None
    if options is not None and not isinstance(options, dict):
        raise QueryError(f"Expecting options like {{timeZone: ...}}, got {options!r}")
    return options


SPARK_UNITS = ("microsecond", "millisecond", "second", "minute", "hour", "day", "week", "month", "quarter", "year")
YEARS = {"decade": (10, 0), "century": (100, 1), "millennium": (1000, 1)}


def truncated(unit: str, at: Column) -> Column:
    if unit in SPARK_UNITS:
        return F.date_trunc(unit, at).cast("timestamp_ntz")
    if unit not in YEARS:
        raise QueryError(f"Unknown date unit {unit}")
    size, first = YEARS[unit]  # centuries and millennia begin with a year 1
    year = F.floor((F.year(at) - first) / size) * size + first
    return F.make_timestamp_ntz(year.cast("int"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


PARENT = {"month": "year", "hour": "day", "minute": "hour", "second": "minute", "millisecond": "second"}
BUCKETS = {"month": (6, 4, 2), "hour": (8, 4, 2), "minute": (30, 15, 6, 5, 4, 3, 2), "second": (30, 15, 10, 8, 6, 5, 4, 3, 2), "millisecond": (500, 250, 100, 50, 25, 10, 5, 2)}


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def bucketed(size: int, unit: str, at: Column) -> Column:
    """The start of the bucket of size units, counted from the start of the parent unit. Months count from 0."""
    start = truncated(PARENT[unit], at)
    if unit == "month":
        months = F.floor((F.month(at) - 1) / size) * size
        return start + F.make_ym_interval(F.lit(0), months.cast("int"))
    width = size * {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000}[unit]
    since = micros(at) - micros(start)
    return F.timestamp_micros(micros(start) + since - since % width).cast("timestamp_ntz")


for _unit in (*SPARK_UNITS, *YEARS):

    def _trunc(scope: Scope, args: list, unit=_unit) -> Column:
        need(args, 1, f"$date_trunc_{unit}")
        return truncated(unit, moment(scope, args[0], second_option(args, 1)))

    register(f"$date_trunc_{_unit}")(_trunc)

for _unit, _sizes in BUCKETS.items():
    for _size in _sizes:

        def _bucket(scope: Scope, args: list, unit=_unit, size=_size) -> Column:
            need(args, 1, f"$date_trunc_{size}{unit}")
            return bucketed(size, unit, moment(scope, args[0], second_option(args, 1)))

        register(f"$date_trunc_{_size}{_unit}")(_bucket)


@register("$date_trunc", single=False)
def date_trunc(scope: Scope, args: list) -> Column:
    need(args, 2, "$date_trunc")
    return truncated(args[0], moment(scope, args[1], second_option(args, 2)))


def part(unit: str, at: Column) -> Column:
    """date_part as double."""
    year, second = F.year(at), F.date_part(F.lit("second"), at).cast("double")
    made = {
        "epoch": lambda: F.unix_micros(at.cast("timestamp")) / 1e6,
        "century": lambda: F.floor((year - 1) / 100) + 1,
        "millennium": lambda: F.floor((year - 1) / 1000) + 1,
        "decade": lambda: F.floor(year / 10),
        "millisecond": lambda: second * 1000,
        "milliseconds": lambda: second * 1000,
        "microsecond": lambda: F.round(second * 1_000_000),
        "microseconds": lambda: F.round(second * 1_000_000),
        "dow": lambda: F.dayofweek(at) - 1,
        "isodow": lambda: F.weekday(at) + 1,
        "doy": lambda: F.dayofyear(at),
        "isoyear": lambda: F.date_part(F.lit("yearofweek"), at),
        "second": lambda: second,
    }
    plain = ("year", "quarter", "month", "week", "day", "hour", "minute")
    if unit in made:
        return made[unit]().cast("double")
    if unit not in plain:
        raise QueryError(f"Unknown date part {unit}")
    return F.date_part(F.lit(unit), at).cast("double")


@register("$date_part", single=False)
def date_part(scope: Scope, args: list) -> Column:
    need(args, 2, "$date_part")
    return part(args[0], moment(scope, args[1], second_option(args, 2)))


# Tokens of PostgreSQL's to_char, longest first, and how each is made here.
TOKENS = {
    "HH24": "HH", "HH12": "hh", "YYYY": "yyyy", "yyyy": "yyyy", "Month": "MMMM", "MONTH": ("upper", "MMMM"), "month": ("lower", "MMMM"), "Mon": "MMM", "MON": ("upper", "MMM"), "mon": ("lower", "MMM"),
    "Day": "EEEE", "DAY": ("upper", "EEEE"), "day": ("lower", "EEEE"), "Dy": "EEE", "DY": ("upper", "EEE"), "dy": ("lower", "EEE"), "DDD": "DDD", "DD": "dd", "ID": "isodow", "D": "dow", "HH": "hh", "MI": "mm", "SS": "ss", "MS": "SSS", "US": "SSSSSS",
    "MM": "MM", "YY": "yy", "yy": "yy", "AM": "a", "PM": "a", "am": ("lower", "a"), "pm": ("lower", "a"), "Q": "quarter", "WW": "week", "IW": "isoweek",
}


def formatted(at: Column, pattern: str) -> Column:
    parts, i, literal = [], 0, ""

    def flush() -> None:
        nonlocal literal
        if literal:
            parts.append(F.lit(literal))
        literal = ""

    while i < len(pattern):
        token = next((t for t in TOKENS if pattern.startswith(t, i)), None)
        if token is None:
            literal += pattern[i]
            i += 1
            continue
        flush()
        made = TOKENS[token]
        if isinstance(made, tuple):
            text = F.date_format(at, made[1])
            parts.append(F.lower(text) if made[0] == "lower" else F.upper(text))
        elif made in ("dow", "isodow", "quarter"):
            parts.append({"dow": F.dayofweek(at), "isodow": F.weekday(at) + 1, "quarter": F.quarter(at)}[made].cast("string"))
        elif made in ("week", "isoweek"):
            parts.append(F.lpad((F.ceil(F.dayofyear(at) / 7) if made == "week" else F.weekofyear(at)).cast("string"), 2, "0"))
        else:
            parts.append(F.date_format(at, made))
        i += len(token)
    flush()
    return F.trim(F.concat(*parts)) if parts else F.lit("")


def to_char(scope: Scope, name: str, pattern: str, options: dict | None = None) -> Column:
    return formatted(moment(scope, name, options), pattern)


# Helper names and their formats.
FORMATS = {
    "date": "YYYY-MM-DD", "datetime": "YYYY-MM-DD HH24:MI", "datetime_": "YYYY_MM_DD__HH24_MI", "timedate": "HH24:MI YYYY-MM-DD", "time": "HH24:MI", "time12": "HH:MI", "timeAM": "HH:MI AM",
    "dy": "dy", "Dy": "Dy", "day": "day", "Day": "Day", "DayNo": "DD", "DD": "DD", "dowUS": "D", "D": "D", "dow": "ID", "ID": "ID", "MonthNo": "MM", "MM": "MM",
    "mon": "mon", "Mon": "Mon", "month": "month", "Month": "Month", "year": "yyyy", "yyyy": "yyyy", "yy": "yy", "yr": "yy",
}

for _name, _pattern in FORMATS.items():

    def _format(scope: Scope, args: list, pattern=_pattern, name=_name) -> Column:
        need(args, 1, f"${name}")
        return to_char(scope, args[0], pattern, second_option(args, 1))

    register(f"${_name}")(_format)


AGE_UNITS = ("second", "minute", "hour", "day", "month", "year")


def age(later: Column, earlier: Column, unit: str | None) -> Column:
    """struct(years, months, days, seconds) from earlier to later, all of one sign, cut at unit."""
    if unit is not None and unit not in AGE_UNITS:
        raise QueryError(f"Expecting one of {', '.join(AGE_UNITS)}, got {unit!r}")
    low, high = F.least(later, earlier), F.greatest(later, earlier)
    sign = F.when(later < earlier, -1).otherwise(1)
    within = lambda at: F.struct(F.dayofmonth(at), micros(at) - micros(truncated("day", at)))
    months = ((F.year(high) - F.year(low)) * 12 + F.month(high) - F.month(low) - (within(high) < within(low)).cast("int")).cast("int")
    rest = micros(high) - micros(low + F.make_ym_interval(F.lit(0), months))
    days = F.floor(rest / 86_400_000_000)
    seconds = (rest - days * 86_400_000_000) / 1e6
    level = AGE_UNITS.index(unit) if unit else -1
    if 0 <= level <= 2:
        width = (1, 60, 3600)[level]
        seconds = F.floor(seconds / width) * width
    keep = lambda column, at: column if level <= at else F.lit(0)
    return F.struct(
        (sign * F.floor(months / 12)).cast("int").alias("years"),
        (sign * keep(months % 12, 4)).cast("int").alias("months"),
        (sign * keep(days, 3)).cast("int").alias("days"),
        (sign * keep(seconds, 2)).cast("double").alias("seconds"),
    )


def age_args(scope: Scope, args: list, name: str) -> tuple[list[Column], str | None]:
    need(args, 1, name)
    names = [a for a in args[:2] if isinstance(a, str) and a in scope.columns]
    rest = [a for a in args if a not in names and a is not None]
    if not names or len(rest) > 1:
        raise QueryError(f"Invalid arguments of {name}: {args!r}")
    return [moment(scope, n) for n in names], rest[0] if rest else None


@register("$age", single=False)
def age_between(scope: Scope, args: list) -> Column:
    at, unit = age_args(scope, args, "$age")
    return age(at[0], at[1], unit) if len(at) == 2 else age(F.current_date().cast("timestamp_ntz"), at[0], unit)


@register("$ageNow", single=False)
def age_now(scope: Scope, args: list) -> Column:
    at, unit = age_args(scope, args, "$ageNow")
    return age(at[0], at[1], unit) if len(at) == 2 else age(F.current_timestamp().cast("timestamp_ntz"), at[0], unit)


@register("$difference", single=False)
def difference(scope: Scope, args: list) -> Column:
    need(args, 2, "$difference")
    return moment(scope, args[0]) - moment(scope, args[1])
