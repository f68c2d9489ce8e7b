"""Small expressions of the catalogue: labels, ratings, ages, boxes, precedence, amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def coverage_label(done: Column, failed: Column, total: Column) -> Column:
    """``empty``, ``done``, ``not_done`` or ``partial``; failures count as processed."""
    return F.when(total == 0, "empty").when(done + failed >= total, "done").when(done + failed == 0, "not_done").otherwise("partial")


def stars_of_quality(quality: Column) -> Column:
    """1 to 5 stars of a quality of 1 to 10; values outside are clamped."""
    return F.ceil(F.greatest(F.lit(1.0), F.least(F.lit(10.0), quality.cast("double"))) / 2).cast("int")


def age_at(birth: Column, day: Column) -> Column:
    """Whole years from birth to a day (ISO dates as strings), null before the birth."""
    part = lambda c, a, n: F.substring(c, a, n).try_cast("int")
    late = F.substring(day, 6, 5) < F.substring(birth, 6, 5)
    years = part(day, 1, 4) - part(birth, 1, 4) - late.cast("int")
    return F.when(day >= birth, years)


def dates_overlap(start: Column, end: Column, first: str | None, last: str | None) -> Column:
    """Whether [start, coalesce(end, start)] meets [first, last]; strings of mixed precision compare as strings."""
    c = start.isNotNull()
    if first is not None:
        c = c & (F.coalesce(end, start) >= first)
    return c & (start <= last) if last is not None else c


def area(box: Column) -> Column:
    return F.greatest(F.lit(0.0), box["x2"] - box["x1"]) * F.greatest(F.lit(0.0), box["y2"] - box["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 if neither has an area."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def first_by_rank(candidates: Column, order: tuple[str, ...]) -> Column:
    """Of an array of structs with ``source``, the first in the order of sources that has any other field."""
    at = F.array(*[F.lit(s) for s in order])
    known = F.filter(candidates, lambda c: F.array_contains(at, c["source"]) & c["value"].isNotNull() & (F.trim(c["value"]) != ""))
    keyed = F.transform(known, lambda c: F.struct(F.array_position(at, c["source"]).alias("rank"), c.alias("item")))
    return F.try_element_at(F.array_sort(keyed), F.lit(1))["item"]


def not_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def vat_mismatch(total: Column, percent: Column, vat: Column) -> Column:
    """Whether a bill's VAT fits its percentage neither as part of the total nor on top of it.

    It fits within two cents or a ten-thousandth of the total, within 0.35 points of the percentage that it makes of the rest,
    or within a tenth of either amount. Nulls, and a total of 0, never are a mismatch.
    """
    within, above = total * percent / (100 + percent), total * percent / 100
    near = F.greatest(F.lit(0.02), F.abs(total) * 1e-4)
    rest = total - vat
    tenth = lambda a: F.abs(a - vat) / F.greatest(F.abs(a), F.abs(vat), F.lit(1e-9)) <= 0.1
    implied = (rest > near) & (F.abs(F.try_divide(100 * vat, rest) - percent) <= 0.35)
    fits = (F.abs(within - vat) <= near) | (F.abs(above - vat) <= near) | F.coalesce(implied, F.lit(False)) | tenth(within) | tenth(above)
    return F.coalesce((total != 0) & ~fits, F.lit(False))


def many_digits(amount: Column) -> Column:
    """Whether an amount has three decimal places or more."""
    return F.coalesce(F.round(amount, 2) != amount, F.lit(False))


def same_currency(c: Column, wanted: str) -> Column:
    """Whether a currency is the wanted one, letters in either case; a wanted text that isn't three letters long doesn't filter."""
    code = wanted.strip().upper()
    return F.upper(F.trim(c)) == code if len(code) == 3 else F.lit(True)


def similarity_of_distance(distance: Column) -> Column:
    """Cosine similarity of a cosine distance, -1 to 1."""
    return F.when(distance.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - distance)))
