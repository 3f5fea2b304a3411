"""Parsing and formatting of sizes, times, metrics and lists, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of sizes. With an i, or a bare letter, powers of 1024, else of 1000.
SIZE_UNITS = {
    "B": 1,
    "K": 1 << 10, "KIB": 1 << 10, "KB": 10**3,
    "M": 1 << 20, "MIB": 1 << 20, "MB": 10**6,
    "G": 1 << 30, "GIB": 1 << 30, "GB": 10**9,
    "T": 1 << 40, "TIB": 1 << 40, "TB": 10**12,
}
#: What a size with a suffix may have as its number, and one without.
DECIMAL, WHOLE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(E[+-]?[0-9]+)?$", r"^[+-]?[0-9]+$"


def parse_size(x: Column) -> Column:
    """Bytes of a quantity such as 1.5GiB, truncated; null where it is malformed or negative."""
    whole = F.upper(F.trim(x))
    unit = F.regexp_extract(whole, "([KMGT]IB|[KMGT]B|[KMGTB])$", 1)
    number = F.trim(F.regexp_replace(whole, "([KMGT]IB|[KMGT]B|[KMGTB])$", ""))
    factor = F.create_map(*[F.lit(v) for k, n in SIZE_UNITS.items() for v in (k, float(n))])
    scaled = F.when(number.rlike(DECIMAL), F.try_multiply(number.try_cast("double"), F.element_at(factor, unit)))
    value = F.when(unit != "", F.when(scaled >= 0, scaled.try_cast("long"))).when(number.rlike(WHOLE), number.try_cast("long"))
    return F.when(value >= 0, value)


def human_bytes(n: Column) -> Column:
    """One decimal from a GiB on, whole MiB and KiB below, else bytes; halves go to the even digit. Null stays null."""
    units = lambda bits: n / F.lit(float(1 << bits))  # noqa: E731  (by a power of two, so exact)
    whole = F.floor(units(30))
    tenths = whole * 10 + F.rint((units(30) - whole) * 10)
    return (
        F.when(n >= 1 << 30, F.format_string("%.1f GiB", tenths / 10))
        .when(n >= 1 << 20, F.format_string("%.0f MiB", F.rint(units(20))))
        .when(n >= 1 << 10, F.format_string("%.0f KiB", F.rint(units(10))))
        .when(n.isNotNull(), F.format_string("%d B", n))
    )


def short(key: Column) -> Column:
    return F.substring(key, 1, 12)


def short_commit(commit: Column) -> Column:
    return F.when(F.coalesce(commit, F.lit("")) == "", "unknown").otherwise(short(commit))


def parse_peers(x: Column) -> Column:
    """Array of (name, url) of "name=url,...", urls without trailing slashes; malformed ones have nulls, repeated names stay."""
    parts = F.filter(F.transform(F.split(x, ","), lambda p: F.trim(p)), lambda p: p != "")
    name = lambda p: F.trim(F.regexp_extract(p, "^([^=]*)=", 1))
    url = lambda p: F.regexp_replace(F.trim(F.regexp_extract(p, "^[^=]*=(.*)$", 1)), "/+$", "")
    return F.transform(parts, lambda p: F.struct(F.nullif(name(p), F.lit("")).alias("name"), F.nullif(url(p), F.lit("")).alias("url")))


def split_metric(line: Column) -> tuple[Column, Column]:
    """(name without labels, value) of an exposition line, cut at its last space; both null where it is none."""
    value = F.regexp_extract(line, r"^.* ([^ ]*)$", 1).try_cast("double")
    name = F.regexp_replace(F.regexp_extract(line, r"^(.*) [^ ]*$", 1), r"\{.*$", "")
    return F.when(value.isNotNull(), name), value


def as_long(x: Column) -> Column:
    """A number in text as a long, truncated; 0 where it is none."""
    return F.coalesce(x.try_cast("double").try_cast("long"), F.lit(0).cast("long"))


def parse_level(x: Column) -> Column:
    level = F.lower(F.trim(x))
    return F.when(level.isin("debug", "warn", "error"), level).when(level == "warning", "warn").otherwise("info")


def milliseconds(ns: Column) -> Column:
    """Nanoseconds as milliseconds, of whole microseconds."""
    return F.floor(ns / 1000).cast("double") / 1000


def rfc3339(ts: Column) -> Column:
    """To the microsecond; the session's zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def results_path(path: Column) -> Column:
    """The part of a path from its last results/ directory on, else all of it."""
    return F.coalesce(F.nullif(F.regexp_extract(path, "^.*/(results/.*)$", 1), F.lit("")), path)


def rate(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))
