"""Date parsing and formatting. Sessions run in UTC; an item's own zone travels in ``publish_zone``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: an ISO date-time that carries an offset, and maybe a zone name in brackets.
ISO_ZONED = (
    r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:\d{2})(\[[^\]]+\])?$"
)

# The date patterns a scraped page may use besides the ISO one (read at UTC in lenient mode).
LENIENT_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss",
                   "MMM d, yyyy", "MMMM d, yyyy")

# RFC 822 dates once the weekday is gone.
RFC822_FORMATS = ("d MMM yyyy HH:mm:ss [z][Z]", "d MMM yyyy HH:mm [z][Z]",
                  "d MMM yy HH:mm:ss [z][Z]", "d MMM yy HH:mm [z][Z]")


def local_time(instant: Column, zone: Column) -> Column:
    """Wall-clock time of ``instant`` in ``zone`` (as a timestamp of the UTC session)."""
    return F.from_utc_timestamp(instant, F.coalesce(zone, F.lit("UTC")))


def iso_zoned(text: Column) -> Column:
    """P11 (strict), P14: an ISO date-time with a zone; anything else is null."""
    bare = F.upper(F.regexp_replace(text, r"\[[^\]]*\]$", ""))
    # Seconds may be left out, but Spark wants them.
    bare = F.regexp_replace(bare, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2})(?=[Z+-])", "$1:00")
    return F.when(text.rlike(ISO_ZONED), F.try_to_timestamp(bare))


def iso_zone(text: Column) -> Column:
    """The zone an ISO date-time names: the bracketed one, else its offset."""
    named = F.regexp_extract(text, r"\[([^\]]+)\]$", 1)
    offset = F.upper(F.regexp_extract(text, r"([Zz]|[+-]\d{2}:\d{2})(\[[^\]]+\])?$", 1))
    return F.when(text.rlike(ISO_ZONED), F.coalesce(F.nullif(named, F.lit("")), F.nullif(offset, F.lit(""))))


def scraped_date(text: Column, lenient: bool = False) -> Column:
    """Five patterns are tried, but only the zoned one can give an instant; ``lenient`` reads the rest at UTC."""
    strict = iso_zoned(text)
    if not lenient:
        return strict
    return F.coalesce(strict, *[F.try_to_timestamp(text, F.lit(f)) for f in LENIENT_FORMATS])


def feed_date(text: Column) -> Column:
    """RFC 822 (weekday dropped: Spark cannot parse one) or zoned ISO."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3,9},?\s+", "")
    # 'UT' is an RFC 822 zone Java does not know.
    bare = F.regexp_replace(bare, r" UT$", " UTC")
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in RFC822_FORMATS], iso_zoned(F.trim(text)))


def zoned_text(instant: Column, zone: Column) -> Column:
    """``2025-05-22T05:44:39.5+02:00[Europe/Paris]``; the bracket only for named zones."""
    zone = F.coalesce(zone, F.lit("UTC"))
    local = local_time(instant, zone)
    shift = F.unix_seconds(local) - F.unix_seconds(instant)
    minutes = F.abs(shift) / 60
    offset = F.when(shift == 0, F.lit("Z")).otherwise(
        F.concat(
            F.when(shift < 0, F.lit("-")).otherwise(F.lit("+")),
            F.lpad(F.floor(minutes / 60).cast("string"), 2, "0"),
            F.lit(":"),
            F.lpad((F.floor(minutes) % 60).cast("string"), 2, "0"),
        )
    )
    fraction = F.regexp_replace(F.date_format(local, ".SSSSSS"), r"\.?0+$", "")
    region = F.when(zone.rlike(r"^([Zz]|[+-]\d{2}:\d{2})$"), F.lit("")).otherwise(
        F.concat(F.lit("["), zone, F.lit("]"))
    )
    return F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss"), fraction, offset, region)


def midnight(as_of: Column, days_back: Column | int, zone: str = "UTC") -> Column:
    """The instant at which the calendar day ``days_back`` days before ``as_of`` began in ``zone``."""
    days = F.lit(days_back) if isinstance(days_back, int) else days_back
    if zone == "UTC":
        # Days without clock changes are seconds, which cost nothing per row; a constant midnight is computed once.
        second = F.unix_seconds(as_of)
        return F.timestamp_seconds(second - F.pmod(second, F.lit(86400)) - days.cast("long") * 86400)
    day = F.date_sub(F.to_date(F.from_utc_timestamp(as_of, zone)), days)
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def run_day(as_of: Column, zone: str = "UTC") -> Column:
    return F.to_date(F.from_utc_timestamp(as_of, zone))
