"""Column functions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def csv_list(c: Column) -> Column:
    """A comma list as trimmed non-blank parts; null gives the empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def yes_no(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low == "yes", True).when(low == "no", False)


def url_slug(url: Column) -> Column:
    """Last segment of a URL's path, or null."""
    path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    return F.nullif(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1), F.lit(""))


def status_of(c: Column) -> Column:
    return F.when(c.isin("Draft", "Withdrawn"), c).otherwise(F.lit("Final"))


def shown_status(lifecycle: Column, status: Column) -> Column:
    """The status that a document's page shows: a withdrawn document's is Withdrawn, an unknown one's Final."""
    return F.when(lifecycle == "withdrawn", "Withdrawn").when(status.isin("Draft", "Final", "Withdrawn"), status).otherwise("Final")


def utc_text(at: Column) -> Column:
    """A timestamp as ISO text in UTC whatever the session's zone, with six decimals if it has a fraction."""
    micros, day = F.unix_micros(at), F.lit(86_400_000_000)
    rest = F.pmod(micros, day)
    date = F.date_add(F.lit("1970-01-01").cast("date"), ((micros - rest) / day).cast("int")).cast("string")
    part = lambda unit, of: (F.floor(rest / unit) % of).cast("int")
    clock = F.format_string("T%02d:%02d:%02d", part(3_600_000_000, 24), part(60_000_000, 60), part(1_000_000, 60))
    fraction = F.when(rest % 1_000_000 == 0, "").otherwise(F.format_string(".%06d", (rest % 1_000_000).cast("int")))
    return F.when(at.isNotNull(), F.concat(date, clock, fraction, F.lit("+00:00")))


def four_decimals(x: Column) -> Column:
    """A number's text with four decimals, rounded by its exact binary value, a tie to the even digit (as printf does)."""
    size = F.abs(x.cast("double"))
    high = size * 134217729.0 - (size * 134217729.0 - size)  # its upper half, so that both halves times 10,000 are exact
    scaled = size * 10000.0
    error = (high * 10000.0 - scaled) + (size - high) * 10000.0
    whole = F.floor(scaled)
    part = scaled - whole
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    n = whole + up.cast("long")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10000).cast("string"), F.lit("."), F.lpad((n % 10000).cast("string"), 4, "0"))


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts joined by 0x1F, nulls as empty text."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def ordered_markers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[\d+\])"), F.lit(1)))


def malformed_markers(text: Column) -> Column:
    """Bracketed parts with a digit that aren't plain markers, repeats kept."""
    found = F.regexp_extract_all(text, F.lit(r"(\[[^\]]*\d[^\]]*\])"), F.lit(1))
    return F.filter(found, lambda m: ~m.rlike(r"^\[\d+\]$"))


def all_of(column: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), column)) == 0


def any_of(column: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(column, F.array(*map(F.lit, wanted)))
