"""Dates and instants written in many ways, as columns.

One regular expression holds every format. It runs once over a value, by a single ``regexp_replace`` whose
replacement lists all named groups, and the answer is split; no format is tried after another. Ranges are checked on
integers, and days are counted from the civil calendar with integer arithmetic, so nothing depends on the session's
time zone. Only a local time without an offset asks Spark's zone rules (``to_utc_timestamp``): a local time that
occurs twice is then the earlier instant, and a skipped one is read with the offset before the change.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names and the abbreviations of zones with their offsets in minutes.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
MONTH_WORDS = (
    "jan(?:uary)?", "feb(?:ruary)?", "mar(?:ch)?", "apr(?:il)?", "may", "june?", "july?", "aug(?:ust)?", "sept?(?:ember)?", "oct(?:ober)?", "nov(?:ember)?", "dec(?:ember)?",
)
ZONE_MINUTES = {
    "UTC": 0, "GMT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330,
    "ICT": 420, "WIB": 420, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "AEST": 600, "ACDT": 630, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

BLANK = r"[\s\p{Z}\p{Cf}]"
_MON = "|".join(MONTH_WORDS)
_TIME = (
    r"(?<h{0}>\d{{1,2}}):(?<i{0}>\d{{2}})(?::(?<s{0}>\d{{2}})(?:[.,](?<f{0}>\d{{1,9}}))?)?(?:\s?(?<p{0}>[ap])\.?m\.?(?![a-z]))?"
)
#: Zone behind a time: an offset, an abbreviation, and a region in brackets.
_ZONE = r"(?:\s?(?:(?<og>[+-])(?<oh>\d{2})(?::?(?<om>\d{2}))?|(?<a>z|utc|gmt|[a-z]{2,4}t)(?![a-z])))?(?:\s?\[(?<r>[a-z_+\-0-9/]+)\])?"
_DATES = "|".join(
    (
        r"(?<y1>\d{4})([-/.])(?<m1>\d{1,2})\2(?<d1>\d{1,2})",
        r"(?<u>\d{1,2})([-/.])(?<v>\d{1,2})\6(?:(?<w>\d{4})|(?<k>\d{2}))",
        rf"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?(?<d2>\d{{1,2}})[\s-](?<b2>{_MON})\.?,?[\s-](?<y2>\d{{4}})",
        rf"(?<b3>{_MON})\.?\s(?<d3>\d{{1,2}}),?\s(?<y3>\d{{4}})",
        r"(?:ngày\s)?(?<d4>\d{1,2})\stháng\s(?<m4>\d{1,2})(?:\snăm\s|,\s|\s)(?<y4>\d{4})",
    )
)
#: A clock time in front of a numeric date.
_REAR = r"{0}\s(?:ngày\s)?(?<u9>\d{{1,2}})([-/.])(?<v9>\d{{1,2}})\k<q9>(?:(?<w9>\d{{4}})|(?<k9>\d{{2}}))"
_PACKED = r"(?<y5>\d{4})(?<m5>\d{2})(?<d5>\d{2})(?:[t\s]?(?<h5>\d{2})(?<i5>\d{2})(?<s5>\d{2})?(?:\.(?<f5>\d{1,9}))?)?"


def _pattern() -> str:
    dates = _DATES.replace(r"([-/.])(?<m1>", r"(?<q1>[-/.])(?<m1>").replace(r"\2(?<d1>", r"\k<q1>(?<d1>")
    dates = dates.replace(r"([-/.])(?<v>", r"(?<q2>[-/.])(?<v>").replace(r"\6(?<w>", r"\k<q2>(?<w>")
    rear = _REAR.format(_TIME.format(9)).replace("([-/.])(?<v9>", "(?<q9>[-/.])(?<v9>")
    whole = rf"(?:(?:{dates})(?:(?:[t\s]|,\s){_TIME.format(1)}{_ZONE})?|{rear}|{_PACKED}{_ZONE.replace('<og>', '<pg>').replace('<oh>', '<ph>').replace('<om>', '<pm>').replace('<a>', '<aa>').replace('<r>', '<rr>')}|(?<n10>\d{{10}})|(?<n13>\d{{13}})|(?<n16>\d{{16}})|(?<n5>\d{{5}})(?:\.(?<x5>\d{{1,9}}))?)"
    return rf"(?iu)^{BLANK}*+{whole}{BLANK}*$"


PATTERN = _pattern()
#: The fields of the answer, their types, and the groups of which one at most has matched.
PARTS = {
    "year": ("int", "y1", "y2", "y3", "y4", "y5", "w", "w9"),
    "short_year": ("int", "k", "k9"),
    "month": ("int", "m1", "m4", "m5"),
    "month_word": ("string", "b2", "b3"),
    "day": ("int", "d1", "d2", "d3", "d4", "d5"),
    "first": ("int", "u", "u9"),
    "second": ("int", "v", "v9"),
    "hour": ("int", "h1", "h9", "h5"),
    "minute": ("int", "i1", "i9", "i5"),
    "sec": ("int", "s1", "s9", "s5"),
    "frac": ("string", "f1", "f9", "f5"),
    "half": ("string", "p1", "p9"),
    "sign": ("string", "og", "pg"),
    "zone_hours": ("int", "oh", "ph"),
    "zone_minutes": ("int", "om", "pm"),
    "abbreviation": ("string", "a", "aa"),
    "region": ("string", "r", "rr"),
    "seconds": ("bigint", "n10"),
    "millis": ("bigint", "n13"),
    "count": ("bigint", "n16"),
    "serial": ("int", "n5"),
    "serial_part": ("string", "x5"),
}
_MARK = "\u0001"
_REPLACEMENT = _MARK + _MARK.join("".join(f"${{{g}}}" for g in groups[1:]) for groups in PARTS.values())
_SCHEMA = "lead string, " + ", ".join(f"{name} {groups[0]}" for name, groups in PARTS.items())


def with_moments(df: DataFrame, values: dict[str, str], zone: str | None = None, order: str | None = None) -> DataFrame:
    """``df`` with ``<prefix>_date`` (string) and ``<prefix>_micros`` (bigint) for each ``{prefix: column}`` of ``values``.

    ``<prefix>_date`` is the calendar date as written, ``yyyy-MM-dd``; ``<prefix>_micros`` the instant in microseconds
    since 1970. Both are null where the value is null, empty, in no known format or out of range. ``zone`` names the
    column with the zone of values that carry none (null: UTC; take it from ``source_rules``, which drops unknown ones), ``order`` the one with ``DMY`` or ``MDY``
    (null: DMY) for all-numeric dates that do not start with the year. Other columns are kept as they are.
    """
    tag = "__moment_" + "_".join(values)
    name = lambda prefix, part: f"{tag}_{prefix}_{part}"
    zone_col = F.col(f"`{zone}`") if zone else F.lit("UTC")
    order_col = F.coalesce(F.col(f"`{order}`"), F.lit("DMY")) if order else F.lit("DMY")
    steps: list[dict[str, Column]] = []
    for prefix, column in values.items():
        mine = _steps(F.col(f"`{column}`"), lambda part, prefix=prefix: name(prefix, part), zone_col, order_col)
        steps = [a | b for a, b in zip(steps, mine)] if steps else mine
    out = df
    for columns in steps:  # one projection after another, so that no expression is written out twice
        out = out.withColumns(columns)
    finals = {f"{prefix}_{kind}": F.col(name(prefix, kind)) for prefix in values for kind in ("date", "micros")}
    kept = [f"`{c}`" for c in df.columns if c not in finals]
    # behind a generator, later filters on the results stay where they are and don't repeat all the steps above
    return out.select(*kept, F.inline(F.array(F.struct(*[c.alias(k) for k, c in finals.items()]))))


def _steps(value: Column, name, zone: Column, order: Column) -> list[dict[str, Column]]:
    got = lambda part: F.col(name(part))
    at = lambda part: F.col(name("parts"))[part]
    answer = {"answer": F.regexp_replace(value, F.lit(PATTERN), F.lit(_REPLACEMENT))}
    parsed = {"parts": F.when(got("answer").startswith(_MARK), F.from_csv(got("answer"), _SCHEMA, {"sep": _MARK, "mode": "PERMISSIVE"}))}

    month_first = order == "MDY"
    numeric = at("first").isNotNull()
    word = F.array_position(F.lit(list(MONTHS)), F.lower(F.substring(at("month_word"), 1, 3))).cast("int")
    table = F.create_map(*[F.lit(x) for pair in ZONE_MINUTES.items() for x in pair])
    fields = {
        "year": F.coalesce(at("year"), at("short_year") + 2000),
        "month": F.when(numeric, F.when(month_first, at("first")).otherwise(at("second"))).otherwise(F.coalesce(at("month"), word)),
        "day": F.when(numeric, F.when(month_first, at("second")).otherwise(at("first"))).otherwise(at("day")),
        "hour": F.coalesce(at("hour"), F.lit(0)),
        "minute": F.coalesce(at("minute"), F.lit(0)),
        "sec": F.coalesce(at("sec"), F.lit(0)),
        "half": F.lower(at("half")),
        "parts": got("parts"),
    }
    year, month, day = got("year"), got("month"), got("day")
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    length = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    hour, half = got("hour"), got("half")
    # years begin in March here, so that the leap day comes last
    shifted = year - F.when(month <= 2, 1).otherwise(0)
    era = F.floor(shifted / 400)
    of_era = shifted - era * 400
    of_year = F.floor((153 * (month + F.when(month > 2, -3).otherwise(9)) + 2) / 5) + day - 1
    civil = era * 146097 + of_era * 365 + F.floor(of_era / 4) - F.floor(of_era / 100) + of_year - 719468
    in_range = (year >= 1) & month.between(1, 12) & (day >= 1) & (day <= length) & (got("minute") <= 59) & (got("sec") <= 59)
    in_range = in_range & F.when(half.isNotNull(), hour.between(1, 12)).otherwise(hour <= 23)
    counted = F.coalesce(at("serial") - 25569, F.floor(at("seconds") / 86400), F.floor(at("millis") / 86400000), F.floor(at("count") / 86400000000))
    hour24 = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    valid = {
        "days": F.when(in_range, civil).otherwise(counted).cast("bigint"),
        "seconds": F.when(at("serial_part").isNotNull(), F.round(F.concat(F.lit("0."), at("serial_part")).try_cast("double") * 86400)).otherwise(hour24 * 3600 + got("minute") * 60 + got("sec")).cast("bigint"),
        "parts": got("parts"),
    }
    west = F.when(at("sign") == "-", -1).otherwise(1)
    offset_ok = (at("zone_hours") <= 18) & (F.coalesce(at("zone_minutes"), F.lit(0)) <= 59)
    local = {
        "days": got("days"),
        "local": got("days") * F.lit(86400000000) + got("seconds") * 1000000 + F.coalesce(F.rpad(at("frac"), 6, "0").try_cast("bigint"), F.lit(0)),
        "minutes": F.when(at("sign").isNotNull(), F.when(offset_ok, west * (at("zone_hours") * 60 + F.coalesce(at("zone_minutes"), F.lit(0))))).otherwise(F.element_at(table, F.upper(at("abbreviation")))),
        "fixed": at("sign").isNotNull() | at("abbreviation").isNotNull(),
        "instant": F.coalesce(at("seconds") * 1000000, at("millis") * 1000, at("count")),
        "zone": F.when(at("region").isNotNull(), F.when(known_zone(at("region")), at("region"))).otherwise(F.coalesce(zone, F.lit("UTC"))),
    }
    by_rules = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(got("local")), got("zone")))
    last = {
        "date": F.date_from_unix_date(got("days").cast("int")).cast("string"),
        "micros": F.when(got("instant").isNotNull(), got("instant")).when(got("fixed"), got("local") - got("minutes").cast("bigint") * 60000000).otherwise(by_rules),
    }
    named = lambda columns: {name(k): v for k, v in columns.items()}
    return [named(c) for c in (answer, parsed, fields, valid, local, last)]


#: Every region that the zone rules know, in one literal, so that the plan holds no list of hundreds of values.
_ZONES = "|" + "|".join(sorted({"UTC", *(z for z in zoneinfo.available_timezones() if "/" in z)})) + "|"


def known_zone(zone: Column) -> Column:
    """Whether ``zone`` is a region that the rules know; asking for another would stop the job."""
    return F.coalesce(F.contains(F.lit(_ZONES), F.concat(F.lit("|"), zone, F.lit("|"))), F.lit(False))


def source_rules(sources: DataFrame) -> DataFrame:
    """(source_system, default_tz, date_order) of export_sources, one row per source, with unknown zones as null."""
    checked = sources.select("source_system", F.when(known_zone(F.col("default_tz")), F.col("default_tz")).alias("default_tz"), "date_order")
    return checked.dropDuplicates(["source_system"])


def instant_text(micros: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss.SSSSSSZ`` of an instant, whatever the session's time zone."""
    days = F.floor(micros / F.lit(86400000000).cast("decimal(20,0)")).cast("bigint")
    rest = micros - days * 86400000000
    second = F.floor(rest / 1000000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60))
    return F.concat(F.date_from_unix_date(days.cast("int")).cast("string"), F.lit("T"), clock, F.lit("."), F.lpad((rest % 1000000).cast("string"), 6, "0"), F.lit("Z"))
