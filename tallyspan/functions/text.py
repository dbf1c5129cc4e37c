"""Cleaning and parsing of text columns, on the JVM only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = r"[\s\x{00A0}]+"


def squash(c: Column) -> Column:
    """Runs of blanks, also no-break ones, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, _BLANKS, " "))


def clean_text(c: Column) -> Column:
    """Squashed; empty text and the word NULL are null."""
    t = squash(c)
    return F.when((t == "") | (t == "NULL"), None).otherwise(t)


def optional_text(c: Column) -> Column:
    """Squashed; dashes alone mean missing."""
    t = squash(c)
    return F.when(~t.rlike("^-*$"), t)


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def strict_id(url: Column) -> Column:
    """The last segment if it is a 16-digit hexadecimal id, else null."""
    s = last_segment(url)
    return F.when(s.rlike("^[0-9a-f]{16}$"), s)


def canonical_url(url: Column, hosts: list[str]) -> Column:
    """Scheme and host unified, fragment and closing slash dropped; null for other hosts."""
    u = F.trim(url)
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?i:https?)://([^/?#]*)", 1)), r"^www\.", "")
    rest = F.regexp_extract(u, r"^(?i:https?)://[^/?#]*([^#]*)", 1)
    return F.when(host.isin(*hosts), F.concat(F.lit("http://"), host, F.regexp_replace(rest, "/+$", "")))


def article_title(href: Column) -> Column:
    """Title of a link to an article: decoded, blanks for underscores; null for other namespaces and missing pages."""
    path = F.regexp_extract(href, r"^(?:https?://[^/]+)?/wiki/([^#?]+)", 1)
    title = F.replace(F.url_decode(F.when(path != "", path)), F.lit("_"), F.lit(" "))
    return F.when(~title.rlike(r"^(File|Category|Template|Help|Special|Talk|User|Portal|Wikipedia)( talk)?:"), title)


def escape_like(c: Column) -> Column:
    for x in ("\\", "%", "_"):
        c = F.replace(c, F.lit(x), F.lit("\\" + x))
    return c


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "auto").otherwise(s)


def split_location(c: Column) -> Column:
    """struct(city, state, country) of one, two or more comma-separated parts."""
    p = F.transform(F.split(c, ","), lambda x: F.trim(x))
    n = F.size(p)
    return F.struct(
        F.when(n >= 2, F.when(n == 2, p[0]).otherwise(F.array_join(F.slice(p, F.lit(1), n - 2), ", "))).alias("city"),
        F.when(n >= 3, p[n - 2]).alias("state"),
        F.element_at(p, -1).alias("country"),
    )


def strip_markers(c: Column) -> Column:
    """Without champion marks and footnotes: ``Name (c) [4]`` gives ``Name``."""
    return squash(F.regexp_replace(c, r"\((?:c|ic)\)|\[[^\]]*\]", " "))


def note_kind(c: Column) -> Column:
    """bmf before championship before interim, else null."""
    return F.when(c.rlike(r"(?i)\bbmf\b"), "bmf").when(c.rlike(r"(?i)interim"), "interim").when(c.rlike(r"(?i)championship|title"), "championship")


def parse_int(c: Column) -> Column:
    """Blank is null; anything but digits raises."""
    t = optional_text(c)
    return F.when(t.isNull(), None).when(t.rlike(r"^[+-]?\d+$"), t.cast("long")).otherwise(F.raise_error(F.concat(F.lit("not an integer: "), t)).cast("long"))


def parse_of(c: Column) -> Column:
    """struct(landed, attempted) of ``N of M``; dashes are null and ``0 of 0`` a real zero."""
    n, m = F.regexp_extract(c, r"^\s*(\d+)\s+of\s+(\d+)\s*$", 1), F.regexp_extract(c, r"^\s*(\d+)\s+of\s+(\d+)\s*$", 2)
    return F.when(n != "", F.struct(n.cast("long").alias("landed"), m.cast("long").alias("attempted")))


def clock_seconds(c: Column) -> Column:
    """Seconds of ``m:ss``; null otherwise."""
    m, s = F.regexp_extract(c, r"^\s*(\d+):([0-5]\d)\s*$", 1), F.regexp_extract(c, r"^\s*(\d+):([0-5]\d)\s*$", 2)
    return F.when(m != "", m.cast("long") * 60 + s.cast("long"))


def height_cm(c: Column) -> Column:
    """Centimetres of ``5' 11"``, two decimals."""
    pattern = r"^\s*(\d+)'\s*(\d+)\"?\s*$"
    ft, inch = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
    return F.when(ft != "", F.round((ft.cast("int") * 12 + inch.cast("int")).cast("decimal(10,0)") * F.lit("2.54").cast("decimal(5,2)"), 2).cast("double"))


def inches_cm(c: Column) -> Column:
    inch = F.regexp_extract(c, r"^\s*(\d+(?:\.\d+)?)\"?\s*$", 1)
    return F.when(inch != "", F.round(inch.cast("decimal(10,2)") * F.lit("2.54").cast("decimal(5,2)"), 2).cast("double"))


def long_date(c: Column) -> Column:
    """``January 5, 2024``, ``Jan. 5, 2024`` or ``Sept 5, 2024`` as a date; null otherwise."""
    t = F.regexp_replace(F.regexp_replace(squash(c), r"\.", ""), r"^Sept ", "Sep ")
    return F.coalesce(F.try_to_date(t, "MMMM d, yyyy"), F.try_to_date(t, "MMM d, yyyy"))


def scheduled_rounds(c: Column) -> Column:
    """Rounds of ``3 Rnd (5-5-5)``; null otherwise."""
    n = F.regexp_extract(c, r"^\s*(\d+)\s+Rnd", 1)
    return F.when(n != "", n.cast("int"))


def tolerant_double(c: Column) -> Column:
    """A number, or null where there is none; NaN is null."""
    v = c.try_cast("double")
    return F.when(~F.isnan(v), v)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)
