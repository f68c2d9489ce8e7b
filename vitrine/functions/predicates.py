"""Conditions on items, as columns: smart albums, quick filters, readiness of analyses, similarity gates."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metadata as M
from . import paths as P

#: Categories that smart albums leave out unless told otherwise.
EXCLUDED = ("document*", "*screenshot*", "invoice_or_receipt", "presentation_slide", "diagram")
PLACES = ("country", "city", "area", "area2", "place", "location_name")
_json = F.get_json_object


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def like(c: Column, text: str) -> Column:
    """Whether the column contains the text, letters in either case; ``%`` and ``_`` in it are wildcards."""
    return F.coalesce(c, F.lit("")).ilike(f"%{text}%")


def place_like(text: str) -> Column:
    return any_of(*[like(F.col(c), text) for c in PLACES])


def text_like(text: str, doc: str = "ai_metadata") -> Column:
    """Title, file name, or the model's title or description in either shape."""
    paths = ("$.image_analysis.title", "$.image_analysis.description", "$.title", "$.description")
    return any_of(like(F.col("display_title"), text), like(F.col("filename"), text), *[like(_json(doc, p), text) for p in paths])


def rated(stars: Column, quality: Column, least_stars: int | None = None, stars_exact: bool = False, least_quality: float | None = None, quality_exact: bool = False, both: bool = False) -> Column:
    """Rating conditions joined by OR (``both``: AND); without any, all pass. An exact quality n means n to n + 1, at most 10."""
    found = []
    if least_stars is not None:
        s = F.coalesce(stars, F.lit(0))
        found.append(s == max(0, least_stars) if stars_exact else s >= max(0, least_stars))
    if least_quality is not None:
        q, low = F.coalesce(quality, F.lit(0.0)), max(0.0, least_quality)
        found.append(q.between(low, min(10.0, low + 1)) if quality_exact else q >= low)
    return reduce((lambda a, b: a & b) if both else (lambda a, b: a | b), found) if found else F.lit(True)


def left_out(category: Column, patterns: tuple[str, ...] = EXCLUDED) -> Column:
    """Whether a category is one of the patterns, ``*`` standing for anything; no patterns leave nothing out."""
    c = F.lower(F.coalesce(category, F.lit("")))
    words = [p.strip().lower() for p in patterns if p.strip()]
    return any_of(*[c.like(p.replace("*", "%")) if "*" in p else c == p for p in words]) if words else F.lit(False)


def taken_between(first: str | None, last: str | None) -> Column:
    at = F.coalesce("photo_taken_at", "file_created_at")
    conditions = [at >= first] * (first is not None) + [at <= last] * (last is not None)
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def ages_meet(low: float | None, high: float | None) -> Column:
    """Whether [age_min, age_max] meets [low, high]."""
    conditions = [F.col("age_max") >= low] * (low is not None) + [F.col("age_min") <= high] * (high is not None)
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def from_gps(is_gps: bool) -> Column:
    same = F.col("location_source").eqNullSafe("gps")
    return same if is_gps else ~same


def usable_face(strict: bool = False) -> Column:
    """A face whose vector can be compared: ready, or (unless strict) of unknown state."""
    ready = F.col("embedding_status") == "ready"
    return F.col("embedding").isNotNull() & (F.coalesce(ready, F.lit(False)) if strict else F.col("embedding_status").isNull() | ready)


def analysed(done: Column, failed: Column) -> Column:
    """Done, and not failed since."""
    return done.isNotNull() & (failed.isNull() | (done > failed))


def failed_since(done: Column, failed: Column) -> Column:
    return failed.isNotNull() & (done.isNull() | (failed >= done))


@dataclass(frozen=True)
class Rotation:
    """Conditions on the orientation that was detected for an item."""

    doc: str = "ai_metadata"

    def _at(self, path: str) -> Column:
        return _json(self.doc, f"$.{path}")

    @property
    def _later(self) -> Column:
        return F.coalesce(self._at("orientation_detection_error").isNull() | (self._at("orientation_detection.processed_at") > self._at("orientation_detection_error.failed_at")), F.lit(False))

    @property
    def done(self) -> Column:
        return self._at("orientation_detection").isNotNull() & self._later

    @property
    def failed(self) -> Column:
        since = self._at("orientation_detection_error.failed_at") >= self._at("orientation_detection.processed_at")
        return self._at("orientation_detection_error").isNotNull() & F.coalesce(self._at("orientation_detection").isNull() | since, F.lit(False))

    def wrong(self, least_confidence: float) -> Column:
        """A quarter turn is needed, surely enough, and nobody dismissed it."""
        turn = self._at("orientation_detection.correction_angle_clockwise").try_cast("int").isin(90, 180, 270)
        sure = self._at("orientation_detection.confidence").try_cast("double") >= least_confidence
        kept = self._at("wrong_rotation_user_dismissed.dismissed_at").isNull() & self._at("orientation_detection.user_dismissed.dismissed_at").isNull()
        return F.coalesce(turn & sure & kept & self._later, F.lit(False))


SOURCED = "array<struct<source:string,country:string,country_code:string,city:string,area:string,place_name:string>>"


def located_by_path(*fields: str, doc: str = "ai_metadata") -> Column:
    """Whether the path's reading by a model gave one of the fields (all of them by default)."""
    names = fields or ("country", "country_code", "city", "area", "place_name")
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    places = F.from_json(_json(doc, "$.locations_by_source"), SOURCED)
    return F.coalesce(F.exists(places, lambda p: (p["source"] == "path_llm") & any_of(*[~blank(p[n]) for n in names])), F.lit(False))


def needs_geocoding() -> Column:
    """GPS coordinates without a complete place from them."""
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    short = F.col("country").isNull() | F.col("area").isNull() | F.col("city").isNull()
    return has & (~F.col("location_source").eqNullSafe("gps") | short)


def needs_vector(refresh: bool = False) -> Column:
    """A face with a box and landmarks whose vector isn't ready; with ``refresh`` any such face."""
    boxed = F.col("bbox_x").isNotNull() & F.col("landmarks").isNotNull()
    return boxed if refresh else boxed & ~F.col("embedding_status").eqNullSafe("ready")


def photo_analysed(doc: str = "ai_metadata") -> Column:
    """Analysed by time, and the document shows an analysis with a method."""
    method = F.coalesce(_json(doc, "$.image_analysis.photo_analysis_method"), _json(doc, "$.photo_analysis_method"))
    return analysed(F.col("photo_done_at"), F.col("photo_failed_at")) & (F.coalesce(F.trim(method), F.lit("")) != "")


def passes_gate(image: Column, text: Column, least_image: float, least_text: float, mode: str = "hybrid") -> Column:
    """Whether a hit is similar enough: by image or text (hybrid), or by the one that the mode names."""
    real = lambda s, t: F.coalesce(~F.isnan(s) & (s >= t), F.lit(False))
    a, b = real(image, least_image), real(text, least_text)
    return {"hybrid": a | b, "vlm-only": a, "description-only": b}[mode]


# --------------------------------------------------------------------------- quick filters

#: Categories that are documents, by filter.
DOCUMENTS = {
    "invoice_or_receipt": ("invoice_or_receipt",),
    "document_id_or_passport": ("document_id_or_passport",),
    "document_other": ("document_contract", "document_other", "presentation_slide", "diagram", "screenshot"),
}


@dataclass(frozen=True)
class QuickFilter:
    """Conditions that all must hold; those left at None are off. Counts and stars are ``none``, ``eq_n`` or ``gte_n``."""

    people: str | None = None
    stars: str | None = None
    ai_stars: str | None = None
    documents: str | None = None
    category: str | None = None
    years: tuple[int | None, int | None] | None = None
    location: str | None = None

    def active(self) -> int:
        return sum(x is not None for x in (self.people, self.stars, self.ai_stars, self.documents, self.category, self.years, self.location))

    def search_range(self) -> dict[str, str]:
        """The event dates and the place as fields of a search."""
        first, last = self.years or (None, None)
        out = {"event_date_start": f"{first}-01-01" if first is not None else None, "event_date_end": f"{last}-12-31" if last is not None else None, "location_query": (self.location or "").strip() or None}
        return {k: v for k, v in out.items() if v}

    def rows(self, items: DataFrame, doc: str = "ai_metadata") -> DataFrame:
        """The items that pass; each document is read once."""
        asked = (self.people, self.ai_stars, self.documents, self.category)
        if all(x is None for x in asked):
            return items.where(self.column(doc))
        return M.read_once(items, *M.READ, doc=doc).where(self.column(doc, F.col("__read"))).drop("__read")

    def column(self, doc: str = "ai_metadata", read: Column | None = None) -> Column:
        """The condition on the columns of an item; ``read`` is a struct of ``metadata.read_once``, if there is one."""
        part = lambda n: M.READ[n](F.col(doc)) if read is None else read[n]
        kind = part("category")
        parts = []
        if self.people is not None:
            n = people_count(doc, read)
            parts += [~kind.eqNullSafe("document_id_or_passport"), _band(n, self.people, none=n == 0)]
        if self.stars is not None:
            parts.append(_band(F.when(F.col("star_rating").between(1, 5), F.floor(F.col("star_rating") + 0.5)), self.stars))
        if self.ai_stars is not None:
            parts.append(_band(F.ceil(part("quality") / 2), self.ai_stars))
        if self.documents is not None:
            names = [c for k, v in DOCUMENTS.items() if self.documents in ("all", k) for c in v]
            parts.append(kind.isin(names))
        if self.category is not None:
            parts.append(kind == self.category)
        if self.years is not None and self.years != (None, None):
            parts.append(years_meet(*self.years))
        if self.location is not None and self.location.strip():
            words = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in ("country", "city", "area", "place", "location_name")]
            parts.append(F.lower(F.concat_ws(" ", *words)).contains(self.location.strip().lower()))
        return reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(True))


def _band(n: Column, rule: str, none: Column | None = None) -> Column:
    if rule in ("none", "unrated"):
        return none if none is not None else n.isNull()
    op, k = rule.split("_")
    return n == int(k) if op == "eq" else n >= int(k)


def people_count(doc: str = "ai_metadata", read: Column | None = None) -> Column:
    """The model's number of people, else that of detected faces, else the search index's, else the number of boxes if faces
    were looked for."""
    positive = lambda c: F.when(c >= 0, c.cast("double"))
    part = lambda n: M.READ[n](F.col(doc)) if read is None else read[n]
    boxes = F.when(part("face_method").isNotNull(), part("box_count").cast("double"))
    return F.coalesce(positive(part("number_of_people")), positive(F.col("face_count")), F.floor(positive(F.col("people"))), boxes)


def years_meet(first: int | None, last: int | None) -> Column:
    """Whether the years of the event meet [first, last]; an item without a start never does."""
    year = lambda c: F.substring(F.col(c), 1, 4).try_cast("int")
    start = year("event_start")
    end = F.coalesce(year("event_end"), start)
    conditions = [start.isNotNull()] + [end >= first] * (first is not None) + [start <= last] * (last is not None)
    return reduce(lambda a, b: a & b, conditions)


def folder_covered(scopes: list[tuple[str, bool]], folder: Column) -> Column:
    """Whether one of the scopes (folder, recursive) covers the folder: then a job on it would repeat work."""
    return any_of(*[P.covered(folder, F.lit(s), F.lit(r)) for s, r in scopes]) if scopes else F.lit(False)
