"""Dates as strings of mixed precision: from names and paths, from embedded tags, bounds, and which source wins.

Dates stay strings (``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD`` or an instant): casting would change how they compare.
"""

from __future__ import annotations

import calendar
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST_YEAR, LAST_YEAR = 1800, 2100
DATE = "struct<start:string,end:string,precision:string,matched:string>"

_DAY = r"(\d{4})-(\d{2})-(\d{2})"
_TO = r"\s*-{1,2}\s*"
_START, _STOP = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
#: The shapes of dates in names.
DAY_TO_DAY = rf"{_DAY}{_TO}{_DAY}"
DAY_TO_MONTH_DAY = rf"{_DAY}{_TO}(\d{{2}})-(\d{{2}})"
DAY_TO_NUMBER = rf"{_DAY}{_TO}(\d{{1,2}})(?!\d)"
YEAR_TO_YEAR = rf"{_START}(\d{{4}}){_TO}(\d{{4}}){_STOP}"
YEAR_TO_SHORT = rf"{_START}(\d{{4}})\s*--\s*(\d{{2}}){_STOP}"
DAY = rf"{_DAY}(?!\d)"
COMPACT = r"(?:^|[_\-\s])(\d{4})(\d{2})(\d{2})(?!\d)"
MONTH = rf"{_START}(\d{{4}})-(\d{{2}})(?!-\d)"
#: Four digits behind a camera's prefix at the beginning of a name are its counter and no year.
CAMERA = r"^(?i:IMG|DSC[NF]?|IMGP|SAM|MVI|MOV|VID|WP|PANO)"
YEAR = rf"(?:^|[\s(]|(?<!{CAMERA})[_\-])(\d{{4}})(?:\s|[_\-),.]|$)"


def _in(part: Column, low: int, high: int) -> Column:
    return part.try_cast("int").between(low, high)


def _possible(*parts: Column) -> Column:
    """Whether year, month and day (as many as there are) are in range; any month may have 31 days."""
    return reduce(lambda a, b: a & b, [_in(p, *r) for p, r in zip(parts, ((FIRST_YEAR, LAST_YEAR), (1, 12), (1, 31)))])


def full_year(base: Column, short: Column) -> Column:
    """The first year from ``base`` on whose last two digits are ``short``."""
    same = base - base % 100 + short
    return F.when(same < base, same + 100).otherwise(same)


def _once(value: Column, then) -> Column:
    """``then(value)``, in which the value is computed once for a row, however often it is used and in whatever branch."""
    return F.transform(F.array(value), then)[0]


def date_in(segment: Column) -> Column:
    """struct(start, end, precision, matched) of the first date or range in a file or folder name, else null.

    Ranges go before single dates and days before months and years. Where a longer range of days matches, though it may
    have an impossible month or day, the shorter ones aren't tried. Names without four digits in a row hold no date, and a shape's
    parts are taken only where it matches.
    """
    return _once(segment, lambda s: F.when(s.rlike(r"\d{4}"), _date_in(s)))


def _date_in(segment: Column) -> Column:
    g = lambda p, i: F.regexp_extract(segment, p, i)
    found = lambda p, possible, start, end, precision: F.when(segment.rlike(p) & possible, F.struct(start.alias("start"), end.cast("string").alias("end"), F.lit(precision).alias("precision"), g(p, 0).alias("matched")))
    iso = lambda *parts: F.concat_ws("-", *parts)
    ymd = lambda p, i=1: (g(p, i), g(p, i + 1), g(p, i + 2))
    none = F.lit(None)
    longer, long = segment.rlike(DAY_TO_DAY), segment.rlike(DAY_TO_MONTH_DAY)
    until = (g(DAY_TO_MONTH_DAY, 1), g(DAY_TO_MONTH_DAY, 4), g(DAY_TO_MONTH_DAY, 5))
    last = (g(DAY_TO_NUMBER, 1), g(DAY_TO_NUMBER, 2), F.lpad(g(DAY_TO_NUMBER, 4), 2, "0"))
    y1, y2 = g(YEAR_TO_YEAR, 1), g(YEAR_TO_YEAR, 2)
    first, short = g(YEAR_TO_SHORT, 1).try_cast("int"), g(YEAR_TO_SHORT, 2).try_cast("int")
    end = full_year(first, short)
    return F.coalesce(
        found(DAY_TO_DAY, _possible(*ymd(DAY_TO_DAY)) & _possible(*ymd(DAY_TO_DAY, 4)), iso(*ymd(DAY_TO_DAY)), iso(*ymd(DAY_TO_DAY, 4)), "day"),
        found(DAY_TO_MONTH_DAY, ~longer & _possible(*ymd(DAY_TO_MONTH_DAY)) & _possible(*until), iso(*ymd(DAY_TO_MONTH_DAY)), iso(*until), "day"),
        found(DAY_TO_NUMBER, ~longer & ~long & _possible(*ymd(DAY_TO_NUMBER)) & _possible(*last), iso(*ymd(DAY_TO_NUMBER)), iso(*last), "day"),
        found(YEAR_TO_YEAR, _possible(y1) & _possible(y2) & (y2 > y1), y1, y2, "year"),
        found(YEAR_TO_SHORT, _possible(g(YEAR_TO_SHORT, 1)) & (end <= LAST_YEAR) & (end > first), g(YEAR_TO_SHORT, 1), end, "year"),
        found(DAY, _possible(*ymd(DAY)), iso(*ymd(DAY)), none, "day"),
        found(COMPACT, _possible(*ymd(COMPACT)), iso(*ymd(COMPACT)), none, "day"),
        found(MONTH, _possible(g(MONTH, 1), g(MONTH, 2)), iso(g(MONTH, 1), g(MONTH, 2)), none, "month"),
        found(YEAR, _possible(g(YEAR, 1)), g(YEAR, 1), none, "year"),
    ).cast(DATE)


def date_in_path(path: Column) -> Column:
    """struct(date, source, depth): the date in the file's name, else in the nearest folder that has one, else null.

    ``source`` is ``script_filename``, ``script_filename+folder`` (a folder has one too) or ``script_folder``; ``depth``
    counts the folders upwards from the file (0: its name). Drive letters are no folders. Each part is read once.
    """
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda s: (s != "") & ~s.rlike("^[A-Za-z]:$"))
    out = lambda date, source, depth: F.struct(date.alias("date"), source.alias("source"), depth.cast("int").alias("depth"))

    def read(parts: Column) -> Column:
        stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^/.]+$", "")
        above = F.reverse(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))))
        dated = F.filter(F.transform(above, lambda s, i: F.struct(date_in(s).alias("date"), (i + 1).alias("depth"))), lambda x: x["date"].isNotNull())
        return F.struct(date_in(stem).alias("own"), F.try_element_at(dated, F.lit(1)).alias("folder"))

    def pick(x: Column) -> Column:
        own, folder = x["own"], x["folder"]
        name_source = F.when(folder.isNotNull(), F.lit("script_filename+folder")).otherwise(F.lit("script_filename"))
        return F.when(own.isNotNull(), out(own, name_source, F.lit(0))).when(folder.isNotNull(), out(folder["date"], F.lit("script_folder"), folder["depth"]))

    return _once(parts, lambda p: F.when(F.size(p) > 0, _once(read(p), pick)))


def event_date(taken: Column, taken_precision: Column, path_date: Column, from_model: Column, created: Column) -> Column:
    """struct(start, end, precision, source) of an item's event.

    ``path_date`` is a struct like that of ``date_in``, ``from_model`` whether a language model read it. It wins over the
    embedded date only if its year is earlier (an old photo scanned later); the file's time is the last resort.
    """
    out = lambda start, end, precision, source: F.struct(start.alias("start"), end.cast("string").alias("end"), precision.alias("precision"), source.alias("source"))
    year = lambda c: F.regexp_extract(c, r"^(\d{4})", 1).try_cast("int")
    precision = F.coalesce(taken_precision, F.lit("instant"))
    embedded = out(taken, F.lit(None), precision, F.when(precision.isin("instant", "day"), F.lit("exif")).otherwise(F.lit("xmp")))

    def chosen(p: Column) -> Column:
        has_taken, has_path = F.coalesce(taken, F.lit("")) != "", F.coalesce(p["start"], F.lit("")) != ""
        path = out(p["start"], p["end"], p["precision"], F.when(from_model, F.lit("path_llm")).otherwise(F.lit("path_script")))
        earlier = F.coalesce(year(p["start"]) < year(taken), F.lit(False))
        return (
            F.when(has_path & (~has_taken | earlier), path)
            .when(has_taken, embedded)
            .when(F.coalesce(created, F.lit("")) != "", out(created, F.lit(None), F.lit("day"), F.lit("file_mtime")))
        )

    return _once(path_date, chosen)


def is_day(y: Column, m: Column, d: Column) -> Column:
    return F.try_make_timestamp(*[c.try_cast("int") for c in (y, m, d)], F.lit(0), F.lit(0), F.lit(0)).isNotNull()


def leading_date(name: Column) -> Column:
    """The date at the beginning of a file name, 1900 to 2100: a year or a month; a real day gives its month, else null."""
    whole = F.regexp_extract(name, r"^(\d{4}(?:-\d{2}(?:-\d{2})?)?)(?:[-_\s]|$)", 1)
    y, m, d = F.substring(whole, 1, 4), F.substring(whole, 6, 2), F.substring(whole, 9, 2)
    ok = _in(y, 1900, 2100)
    return (
        F.when((F.length(whole) == 4) & ok, whole)
        .when((F.length(whole) == 7) & ok & _in(m, 1, 12), whole)
        .when((F.length(whole) == 10) & ok & is_day(y, m, d), F.concat_ws("-", y, m))
    )


def tag_date(raw: Column) -> Column:
    """struct(value, precision) of an embedded date: a year or month from 1850 to 2100, a real day, or an instant, which
    becomes UTC with milliseconds; ``YYYY:MM:DD`` counts as a date with dashes. Anything else gives null."""
    t = F.trim(raw)
    out = lambda value, precision: F.struct(value.alias("value"), F.lit(precision).alias("precision"))
    y, m, d = F.substring(t, 1, 4), F.substring(t, 6, 2), F.substring(t, 9, 2)
    ok = _in(y, 1850, 2100)
    dashed = F.regexp_replace(F.regexp_replace(t, r"^(\d{4}):(\d{2}):(\d{2})", "$1-$2-$3"), r"^(\d{4}-\d{2}-\d{2})\s+", "$1T")
    instant = F.try_to_timestamp(F.when(dashed.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), dashed))
    return (
        F.when(t.rlike(r"^\d{4}$"), F.when(ok, out(t, "year")))
        .when(t.rlike(r"^\d{4}-\d{2}$"), F.when(ok & _in(m, 1, 12), out(t, "month")))
        .when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(is_day(y, m, d), out(t, "day")))
        .when(instant.isNotNull(), out(F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "instant"))
    )


def sortable(value: Column, precision: Column) -> Column:
    """The first instant of a partial date."""
    pad = F.when(precision == "year", "-01-01T00:00:00.000Z").when(precision == "month", "-01T00:00:00.000Z").when(precision == "day", "T00:00:00.000Z").otherwise("")
    return F.concat(value, pad)


def birth_date(raw: Column) -> Column:
    """A real ``YYYY-MM-DD``, trimmed; null for blanks and for anything else."""
    t = F.trim(raw)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & is_day(F.substring(t, 1, 4), F.substring(t, 6, 2), F.substring(t, 9, 2)), t)


def person_age(birth: Column, event: Column, estimated: Column) -> Column:
    """struct(years, source): whole years from birth to event, else the rounded estimate; null without either."""
    b, e = birth_date(birth), birth_date(F.substring(event, 1, 10))
    part = lambda c, a, n: F.substring(c, a, n).try_cast("int")
    years = part(e, 1, 4) - part(b, 1, 4) - (F.substring(e, 6, 5) < F.substring(b, 6, 5)).cast("int")
    guess = F.when(~F.isnan(estimated) & (F.abs(estimated) != float("inf")), F.floor(estimated + 0.5).cast("int"))
    out = lambda y, s: F.struct(y.alias("years"), F.lit(s).alias("source"))
    return F.when(e >= b, out(years, "birth_date")).when(guess.isNotNull(), out(guess, "estimated_age_years"))


def month_bound(value: str | None, end: bool, instant: bool = True) -> str | None:
    """The first or last day that a year or month stands for; an end carries the day's last instant if ``instant``."""
    t = (value or "").strip()
    m = re.fullmatch(r"(\d{4})(?:-(\d{2}))?", t)
    if not m or (m[2] and not 1 <= int(m[2]) <= 12):
        return None
    if not end:
        return f"{m[1]}-{m[2] or '01'}-01"
    month = int(m[2] or 12)
    return f"{m[1]}-{month:02d}-{calendar.monthrange(int(m[1]) or 4, month)[1]:02d}" + ("T23:59:59.999Z" if instant else "")


def day_bound(value: str | None, end: bool) -> str | None:
    """A day as it is, or the first or last day of a year or month; null for anything else."""
    t = (value or "").strip()
    return t if re.fullmatch(r"\d{4}-\d{2}-\d{2}", t) else month_bound(t, end, instant=False)


def date_label(value: Column, precision: Column) -> Column:
    """How a partial date is shown: ``2009``, ``Feb 2009`` or ``7 Feb 2009``."""
    day = F.try_to_timestamp(F.substring(sortable(value, precision), 1, 10))
    return F.when(precision == "year", F.substring(value, 1, 4)).when(precision == "month", F.date_format(day, "MMM yyyy")).otherwise(F.date_format(day, "d MMM yyyy"))
