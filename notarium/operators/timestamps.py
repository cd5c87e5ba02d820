"""Mixed timestamp notations, precisions and zones, normalised to one UTC instant.

Every notation is one alternative of a single regular expression with named
groups. One ``regexp_replace`` per value writes the groups of whichever
alternative matched into a fixed row of slots, ``split`` reads them, and
integer day arithmetic turns them into microseconds. Nothing leaves the JVM and
nothing is shuffled.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Usual offsets of zone abbreviations, in minutes.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "NPT": 345, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_MON = "|".join(MONTHS)
_ABB = "|".join(sorted(ABBREVIATIONS, key=len, reverse=True))


def _clock(n: int) -> str:
    """hour, minute, second and fraction, numbered ``n``; seconds may be missing."""
    return rf"(?<h{n}>\d{{1,2}}):(?<i{n}>\d{{2}})(?::(?<s{n}>\d{{2}})(?:[.,](?<f{n}>\d+))?)?"


def _zone(n: int) -> str:
    return rf"(?:\s*(?:(?<o{n}>[+-]\d{{2}}(?::?\d{{2}})?)(?:\[[^\]]*\])?|(?<a{n}>(?:{_ABB})\b)))?"


def _half(n: int) -> str:
    return rf"(?:\s*(?<p{n}>[ap])\.?m\.?)?"


#: notation -> (pattern, number of its groups). Year first, day first when dotted, month first when slashed.
NOTATIONS = {
    "epoch": (r"(?<e1>-?\d+)(?:\.(?<x1>\d+))?", 1),
    "compact": (r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})T(?<h2>\d{2})(?<i2>\d{2})(?:(?<s2>\d{2})(?:[.,](?<f2>\d+))?)?" + _zone(2), 2),
    "dashed": (r"(?<y3>\d{4})-(?<m3>\d{1,2})-(?<d3>\d{1,2})(?:(?:T|\s+)" + _clock(3) + _half(3) + _zone(3) + ")?", 3),
    "slashed, year first": (r"(?<y4>\d{4})/(?<m4>\d{1,2})/(?<d4>\d{1,2})(?:(?:T|\s+)" + _clock(4) + _half(4) + _zone(4) + ")?", 4),
    "dotted": (r"(?<d5>\d{1,2})\.(?<m5>\d{1,2})\.(?<y5>\d{4})(?:,?\s+" + _clock(5) + _half(5) + _zone(5) + ")?", 5),
    "slashed, month first": (r"(?<m6>\d{1,2})/(?<d6>\d{1,2})/(?<y6>\d{4})(?:,?\s+" + _clock(6) + _half(6) + _zone(6) + ")?", 6),
    "month name first": (rf"(?<n7>{_MON})[a-z]*\.?\s+(?<d7>\d{{1,2}}),?\s+(?<y7>\d{{4}})(?:,?\s+" + _clock(7) + _half(7) + _zone(7) + ")?", 7),
    "day, month name": (rf"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?(?<d8>\d{{1,2}})\s+(?<n8>{_MON})[a-z]*\.?\s+(?<y8>\d{{4}})(?:,?\s+" + _clock(8) + _half(8) + _zone(8) + ")?", 8),
}
PATTERN = r"(?i)^\s*(?:" + "|".join(p for p, _ in NOTATIONS.values()) + r")\s*$"
SLOTS = ("y", "m", "n", "d", "h", "i", "s", "f", "p", "o", "a", "e", "x")
_REPLACE = "\x01".join(["", *("".join(f"${{{s}{n}}}" for p, n in NOTATIONS.values() if f"(?<{s}{n}>" in p) for s in SLOTS)])

US_DAY = 86_400_000_000


def known_zones() -> frozenset[str]:
    """Zone names that may be handed to Spark; others count as missing."""
    return frozenset(available_timezones())


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("bigint")


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers only."""
    back = F.when(m <= 2, y - 1).otherwise(y)
    shifted = F.when(m > 2, m - 3).otherwise(m + 9)
    era = F.floor(back / 400)
    yoe = back - era * 400
    doy = F.floor((shifted * 153 + 2) / 5) + d - 1
    return (era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468).cast("bigint")


def days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def _offset_us(text: Column) -> Column:
    """Microseconds of an offset written +HH, +HHMM or +HH:MM; null if it is none."""
    digits = F.regexp_replace(text, ":", "")
    mins = F.substring(digits, 2, 2).try_cast("bigint") * 60 + F.coalesce(F.nullif(F.substring(digits, 4, 2), F.lit("")).try_cast("bigint"), F.lit(0))
    ok = text.rlike(r"^[+-]\d{2}(:?\d{2})?$") & (mins <= 18 * 60) & (F.coalesce(F.nullif(F.substring(digits, 4, 2), F.lit("")).try_cast("bigint"), F.lit(0)) < 60)
    return F.when(ok, mins * 60_000_000 * F.when(text.startswith("-"), -1).otherwise(1))


def with_instant(df: DataFrame, raw: str, zone: str, out: str = "utc_us") -> DataFrame:
    """Adds ``out``: microseconds since 1970-01-01 UTC of the text in ``raw``.

    ``zone`` names the column with the zone (IANA name or offset) of values that
    carry none themselves; null, blank or unknown zones count as UTC. Of a
    local hour shown twice the earlier instant counts; a skipped local time is
    read with the offset before the skip. Digits below a microsecond are
    dropped. Null, empty, malformed and impossible values give null. Columns of
    ``df`` keep their names, ``out`` excepted; the row count never changes.
    """
    keep = [c for c in df.columns if c != out]
    t, v = "\x02parts", "\x02v"
    own = F.col(f"`{raw}`")
    # a value that doesn't match comes back as it is, without slots
    got = df.withColumn(t, F.split(F.regexp_replace(F.when(~own.contains("\x01"), own), PATTERN, _REPLACE), "\x01"))
    part = {s: F.get(F.col(f"`{t}`"), F.lit(k + 1)) for k, s in enumerate(SLOTS)}
    month = F.coalesce(_int(part["m"]), *[F.when(F.lower(F.nullif(part["n"], F.lit(""))) == name, F.lit(k + 1)) for k, name in enumerate(MONTHS)])
    lower_half, frac = F.lower(part["p"]), F.rpad(F.substring(part["f"], 1, 6), 6, "0")
    got = got.withColumn(
        v,
        F.struct(
            _int(part["y"]).alias("y"), month.cast("bigint").alias("m"), _int(part["d"]).alias("d"),
            F.coalesce(_int(part["h"]), F.lit(0)).alias("h"), F.coalesce(_int(part["i"]), F.lit(0)).alias("i"), F.coalesce(_int(part["s"]), F.lit(0)).alias("s"),
            F.when(part["f"] != "", frac.try_cast("bigint")).otherwise(0).alias("us"), F.nullif(lower_half, F.lit("")).alias("half"),
            F.nullif(part["o"], F.lit("")).alias("offset"), F.upper(F.nullif(part["a"], F.lit(""))).alias("abb"),
            F.nullif(part["e"], F.lit("")).alias("epoch"), F.rpad(F.substring(F.coalesce(part["x"], F.lit("")), 1, 6), 6, "0").try_cast("bigint").alias("epoch_us"),
            F.nullif(F.trim(F.col(f"`{zone}`")), F.lit("")).alias("zone"),
        ),
    )
    x = {c: F.col(f"`{v}`.{c}") for c in ("y", "m", "d", "h", "i", "s", "us", "half", "offset", "abb", "epoch", "epoch_us", "zone")}
    hour = F.when(x["half"].isNull(), x["h"]).otherwise(x["h"] % 12 + F.when(x["half"] == "p", 12).otherwise(0))
    exists = x["m"].between(1, 12) & (x["d"] >= 1) & (x["d"] <= days_in_month(x["y"], x["m"])) & (x["y"] >= 1) & (x["i"] <= 59) & (x["s"] <= 59) & F.when(x["half"].isNull(), x["h"] <= 23).otherwise(x["h"].between(1, 12))
    local = F.when(exists, days_from_civil(x["y"], x["m"], x["d"]) * US_DAY + ((hour * 60 + x["i"]) * 60 + x["s"]) * 1_000_000 + x["us"])
    own = F.when(x["offset"].isNotNull(), F.coalesce(_offset_us(x["offset"]), F.lit(None).cast("bigint")))
    abb = F.create_map(*[F.lit(y) for k, m in ABBREVIATIONS.items() for y in (k, m * 60_000_000)])
    name = F.when(x["zone"].isin(*sorted(known_zones())), x["zone"])
    in_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.coalesce(name, F.lit("UTC"))))
    dated = (
        F.when(x["offset"].isNotNull(), local - own)
        .when(x["abb"].isNotNull(), local - F.element_at(abb, x["abb"]))
        .when(_offset_us(x["zone"]).isNotNull(), local - _offset_us(x["zone"]))
        .otherwise(in_zone)
    )
    n = x["epoch"].try_cast("bigint")
    size = F.abs(n)
    counted = (
        F.when(size < 100_000_000_000, n * 1_000_000 + F.when(x["epoch"].startswith("-"), -1).otherwise(1) * x["epoch_us"])
        .when(size < 100_000_000_000_000, n * 1_000)
        .when(size < 100_000_000_000_000_000, n)
        .otherwise(F.call_function("div", n - F.pmod(n, F.lit(1_000)), F.lit(1_000)))
    )
    return got.select(*[F.col(f"`{c}`") for c in keep], F.when(x["epoch"].isNotNull(), counted).otherwise(dated).cast("bigint").alias(out))


def note_dates(notes: DataFrame, fields: tuple[str, ...] = ("date", "created", "updated")) -> DataFrame:
    """(src, row_id, field, raw, zone): one row for each date value of a note's metadata; repeats of a row count once."""
    values = [F.coalesce(F.try_element_at("meta", F.lit(f)), F.array().cast("array<string>")) for f in fields]
    named = [F.arrays_zip(F.array_repeat(F.lit(f), F.size(v)).alias("field"), v.alias("raw")) for f, v in zip(fields, values, strict=True)]
    each = F.explode(F.flatten(F.array(*named)))
    zone = F.get(F.filter(F.coalesce(F.try_element_at("meta", F.lit("tz")), F.array().cast("array<string>")), lambda z: F.trim(z) != ""), F.lit(0))
    at = notes.select(F.lit("meta").alias("src"), F.col("note_id").alias("row_id"), zone.alias("zone"), each.alias("x"))
    return at.select("src", "row_id", "x.field", "x.raw", "zone")


def crawl_times(crawl: DataFrame) -> DataFrame:
    """(src, row_id, field, raw, zone) of the raw modification times of a crawl log."""
    return crawl.select(F.lit("crawl").alias("src"), F.col("crawl_id").alias("row_id"), F.lit("mtime").alias("field"), F.col("mtime_raw").alias("raw"), F.col("host_zone").alias("zone"))


def normalised(notes: DataFrame, crawl: DataFrame) -> DataFrame:
    """(src, row_id, field, raw, zone, utc_us), unreadable values with a null instant; rows that repeat a key count once."""
    both = note_dates(notes).unionByName(crawl_times(crawl))
    return with_instant(both, "raw", "zone").dropDuplicates(["src", "row_id", "field", "raw"])


def found(spark: SparkSession, root: str) -> DataFrame:
    from notarium.runtime import table

    return normalised(table(spark, root, "notes"), table(spark, root, "crawl_log")).where("utc_us is not null").select("src", "row_id", "field", "utc_us")
