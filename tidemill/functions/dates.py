"""Date and time functions with MySQL semantics.

TIME values can exceed a day, so they are seconds or ``[-]H:MM:SS`` text here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Day number of 1970-01-01.
EPOCH_DAY = 719528

#: MySQL format letters that have a Spark pattern.
_PATTERNS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h",
    "i": "mm", "s": "ss", "S": "ss", "f": "SSSSSS", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "p": "a", "j": "DDD",
    "T": "HH:mm:ss", "r": "hh:mm:ss a",
}


def day_number(d: Column) -> Column:
    """TO_DAYS: days since year 0."""
    return (F.datediff(d, F.lit("1970-01-01").cast("date")) + EPOCH_DAY).cast("long")


def from_days(n: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), (n - EPOCH_DAY).cast("int"))


def to_seconds(ts: Column) -> Column:
    return day_number(ts) * 86400 + second_of_day(ts)


def second_of_day(ts: Column) -> Column:
    return (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def to_months(d: Column) -> Column:
    return (F.year(d) * 12 + F.month(d)).cast("long")


def to_weeks(d: Column) -> Column:
    """Whole weeks since year 0, Sunday first."""
    return F.floor((day_number(d) - 1) / 7).cast("long")


def week(d: Column, mode: int = 0) -> Column:
    """WEEK(d, mode) for modes 0 to 7."""
    return _week(d, mode)[1]


def yearweek(d: Column, mode: int = 0) -> Column:
    year, number = _week(d, mode | 2)
    return (year * 100 + number).cast("long")


def _week(d: Column, mode: int) -> tuple[Column, Column]:
    """(year, week). Mode bit 0: Monday first; bit 1: weeks count from 1; bit 2: the first week rule.

    Without bit 2 of the pair (Sunday first) or with it (Monday first) a year's first week
    is the first one with four days or more; else the first that begins in the year.
    """
    monday, from_one = bool(mode & 1), bool(mode & 2)
    four_days = monday != bool(mode & 4)

    def start(year: Column) -> Column:
        """Day number (from the epoch) at which week 1 of a year begins."""
        first = F.make_date(year, F.lit(1), F.lit(1))
        shift = F.weekday(first) if monday else F.pmod(F.weekday(first) + 1, F.lit(7))
        day = F.datediff(first, F.lit("1970-01-01").cast("date"))
        if four_days:
            return F.when(shift <= 3, day - shift).otherwise(day + 7 - shift)
        return F.when(shift == 0, day).otherwise(day + 7 - shift)

    year = F.year(d)
    day = F.datediff(d, F.lit("1970-01-01").cast("date"))
    own, before, after = start(year), start(year - 1), start(year + 1)
    inside = (F.floor((day - own) / 7) + 1).cast("long")
    if not from_one:
        return year, F.when(day < own, F.lit(0)).otherwise(inside).cast("long")
    number = F.when(day < own, F.floor((day - before) / 7) + 1).when(day >= after, F.lit(1)).otherwise(inside)
    return F.when(day < own, year - 1).when(day >= after, year + 1).otherwise(year), number.cast("long")


def weekday(d: Column) -> Column:
    """0 is Monday."""
    return F.weekday(d).cast("long")


def dayofweek(d: Column) -> Column:
    """1 is Sunday."""
    return F.dayofweek(d).cast("long")


def dayname(d: Column) -> Column:
    return F.date_format(d, "EEEE")


def monthname(d: Column) -> Column:
    return F.date_format(d, "MMMM")


def microsecond(ts: Column) -> Column:
    return F.pmod(F.unix_micros(ts.cast("timestamp")), F.lit(1_000_000)).cast("long")


def makedate(year: Column, day: Column) -> Column:
    """Two-digit years: below 70 in this century. NULL for day 0 and less."""
    full = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.when(day > 0, F.date_add(F.make_date(full.cast("int"), F.lit(1), F.lit(1)), (day - 1).cast("int")))


def period_add(period: Column, months: Column) -> Column:
    total = _period(period) + months
    return (F.floor(total / 12) * 100 + F.pmod(total, F.lit(12)) + 1).cast("long")


def period_diff(a: Column, b: Column) -> Column:
    return (_period(a) - _period(b)).cast("long")


def _period(p: Column) -> Column:
    """Months since year 0 of YYMM or YYYYMM."""
    year = F.floor(p / 100)
    full = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return full * 12 + p % 100 - 1


def sec_to_time(seconds: Column) -> Column:
    """Text of up to 838:59:59."""
    size = F.least(F.abs(seconds.cast("long")), F.lit(838 * 3600 + 59 * 60 + 59).cast("long"))
    pad = lambda n: F.lpad(F.floor(n).cast("string"), 2, "0")
    hours = F.floor(size / 3600)
    text = F.when(hours < 100, pad(hours)).otherwise(hours.cast("string"))
    return F.concat(F.when(seconds < 0, "-").otherwise(""), text, F.lit(":"), pad(size / 60 % 60), F.lit(":"), pad(size % 60))


def time_to_sec(time: Column) -> Column:
    """Seconds of a [-]H:MM:SS text."""
    parts = F.split(F.regexp_replace(time, "^-", ""), ":")
    size = parts[0].cast("long") * 3600 + parts[1].cast("long") * 60 + F.floor(parts[2].cast("double")).cast("long")
    return F.when(time.startswith("-"), -size).otherwise(size)


def time(ts: Column) -> Column:
    """Time of day as text."""
    return F.date_format(ts, "HH:mm:ss")


def maketime(h: Column, m: Column, s: Column) -> Column:
    """NULL for minutes or seconds outside of 0 to 59."""
    fine = m.between(0, 59) & s.between(0, 59)
    return F.when(fine, sec_to_time(F.when(h < 0, h * 3600 - m * 60 - s).otherwise(h * 3600 + m * 60 + s)))


def _micros(time_text: Column) -> Column:
    """Microseconds of a [-]H:MM[:SS[.ffffff]] text."""
    parts = F.split(F.regexp_replace(time_text, "^-", ""), ":")
    seconds = F.coalesce(F.get(parts, F.lit(2)), F.lit("0")).cast("decimal(20,6)")
    size = (F.get(parts, F.lit(0)).cast("long") * 3600 + F.coalesce(F.get(parts, F.lit(1)), F.lit("0")).cast("long") * 60) * 1_000_000 + (seconds * 1_000_000).cast("long")
    return F.when(time_text.startswith("-"), -size).otherwise(size)


def addtime(ts: Column, time_text: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) + _micros(time_text))


def subtime(ts: Column, time_text: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts.cast("timestamp")) - _micros(time_text))


def timestamp(ts: Column, time_text: Column | None = None) -> Column:
    """TIMESTAMP(x) and TIMESTAMP(x, time)."""
    return ts.cast("timestamp") if time_text is None else addtime(ts, time_text)


def curtime() -> Column:
    """The time of day as text."""
    return time(F.now())


def date_add(ts: Column, n: Column | int, unit: str) -> Column:
    """``ts + INTERVAL n unit`` for simple units; month arithmetic stops at the month's end."""
    unit, n = unit.upper(), n if isinstance(n, Column) else F.lit(n)
    if unit in {"YEAR", "QUARTER", "MONTH"}:
        months = n * {"YEAR": 12, "QUARTER": 3, "MONTH": 1}[unit]
        return ts + F.make_ym_interval(F.lit(0), months.cast("int"))
    if unit in {"WEEK", "DAY"}:
        return ts + F.make_dt_interval((n * (7 if unit == "WEEK" else 1)).cast("int"))
    zero = F.lit(0)
    args = {"HOUR": (zero, n), "MINUTE": (zero, zero, n), "SECOND": (zero, zero, zero, n), "MICROSECOND": (zero, zero, zero, n / 1_000_000)}[unit]
    return ts + F.make_dt_interval(*[a.cast("int") if i < 3 else a.cast("decimal(18,6)") for i, a in enumerate(args)])


def date_sub(ts: Column, n: Column | int, unit: str) -> Column:
    return date_add(ts, -(n if isinstance(n, Column) else F.lit(n)), unit)


def composite_interval(text: str, unit: str) -> dict[str, int]:
    """Parts of a composite interval such as '1 10' DAY_HOUR; empty if it is invalid."""
    import re

    units = ["YEAR", "MONTH"] if unit == "YEAR_MONTH" else ["DAY", "HOUR", "MINUTE", "SECOND", "MICROSECOND"]
    first, _, last = unit.partition("_")
    wanted = units[units.index(first) : units.index(last) + 1]
    sign, numbers = (-1 if text.strip().startswith("-") else 1), re.findall(r"\d+", text)
    if not numbers or len(numbers) > len(wanted):
        return {}
    return {u: sign * int(n) for u, n in zip(wanted[-len(numbers) :], numbers)}


def date_add_composite(ts: Column, text: str, unit: str) -> Column:
    parts = composite_interval(text, unit)
    if not parts:
        return F.lit(None).cast("timestamp")
    for u, n in parts.items():
        ts = date_add(ts, n, u)
    return ts


def timestamp_add(unit: str, n: Column | int, ts: Column) -> Column:
    return date_add(ts, n, unit)


def timestamp_diff(unit: str, a: Column, b: Column) -> Column:
    return F.timestamp_diff(unit, a, b).cast("long")


def date_format(ts: Column, pattern: str) -> Column:
    """DATE_FORMAT: the specifiers are translated when the plan is built; NULL for an empty format."""
    if not pattern:
        return F.lit(None).cast("string")
    parts: list[Column] = []
    plain = ""
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c != "%" or i + 1 == len(pattern):
            plain += c
            i += 1
            continue
        letter = pattern[i + 1]
        i += 2
        if letter in _PATTERNS or letter in "DUuVvXxw":
            if plain:
                parts.append(F.lit(plain))
                plain = ""
            parts.append(_specifier(ts, letter))
        else:
            plain += letter
    if plain:
        parts.append(F.lit(plain))
    return F.concat(*parts)


def _specifier(ts: Column, letter: str) -> Column:
    if letter in _PATTERNS:
        return F.date_format(ts, _PATTERNS[letter])
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    if letter == "D":
        day = F.dayofmonth(ts)
        end = F.when((day >= 11) & (day <= 13), "th").when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
        return F.concat(day.cast("string"), end)
    if letter == "w":
        return (F.dayofweek(ts) - 1).cast("string")
    if letter in "Xx":
        return _week(ts, 2 if letter == "X" else 3)[0].cast("string")
    return two(week(ts, {"U": 0, "u": 1, "V": 2, "v": 3}[letter]))


def time_format(ts: Column, pattern: str) -> Column:
    return date_format(ts, pattern)


def str_to_date(text: Column, pattern: str) -> Column:
    """NULL where the text does not fit."""
    spark = "".join(_PATTERNS.get(pattern[i], pattern[i]) if i and pattern[i - 1] == "%" else "" if pattern[i] == "%" else pattern[i] for i in range(len(pattern)))
    return F.try_to_timestamp(text, F.lit(spark))


#: GET_FORMAT(kind, standard): fixed values of the SQL dialect.
FORMATS = {
    "DATE": {"USA": "%m.%d.%Y", "JIS": "%Y-%m-%d", "ISO": "%Y-%m-%d", "EUR": "%d.%m.%Y", "INTERNAL": "%Y%m%d"},
    "DATETIME": {"USA": "%Y-%m-%d %H.%i.%s", "JIS": "%Y-%m-%d %H:%i:%s", "ISO": "%Y-%m-%d %H:%i:%s", "EUR": "%Y-%m-%d %H.%i.%s", "INTERNAL": "%Y%m%d%H%i%s"},
    "TIME": {"USA": "%h:%i:%s %p", "JIS": "%H:%i:%s", "ISO": "%H:%i:%s", "EUR": "%H.%i.%s", "INTERNAL": "%H%i%s"},
}


def get_format(kind: str, standard: str) -> Column:
    return F.lit(FORMATS.get(kind.upper(), {}).get(standard.upper()))


def convert_tz(ts: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts.cast("timestamp_ntz"))


def utc_timestamp() -> Column:
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())


def utc_date() -> Column:
    return F.to_date(utc_timestamp())


def utc_time() -> Column:
    return time(utc_timestamp())


def year_of(x: Column) -> Column:
    """YEAR type: 1 to 69 are 2001 to 2069, 70 to 99 are 1970 to 1999."""
    return F.when((x >= 1) & (x <= 69), x + 2000).when((x >= 70) & (x <= 99), x + 1900).otherwise(x).cast("short")


def zero_date(text: Column) -> Column:
    """A date text; zero dates and zero months or days become NULL."""
    return F.when(~text.rlike("^0000|-00(-|$|T| )"), text.try_cast("date"))


def time_to_tso(ts: Column, zone: str | None = None) -> Column:
    """Timestamp of the transaction clock: milliseconds since 1970 above 22 bits of a counter; parts of a second are dropped."""
    text = F.substring(ts.cast("string"), 1, 19)
    at = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")) if zone is None else F.try_to_timestamp(F.concat(text, F.lit(f" {zone}")), F.lit("yyyy-MM-dd HH:mm:ss VV"))
    return F.shiftleft(F.unix_millis(at), 22)


def tso_to_time(tso: Column, zone: str | None = None) -> Column:
    """Local time of a timestamp of the transaction clock."""
    at = F.timestamp_millis(F.shiftright(tso.cast("long"), 22)).cast("timestamp_ntz")
    return at if zone is None else F.convert_timezone(F.current_timezone(), F.lit(zone), at)
