"""JSON metadata of items: both shapes read alike, normalised and merged; answers of models read with care.

Version 2 has ``schema_version`` 2.0 and groups its fields; everything else counts as version 1, with flat fields.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .scalars import let

#: The top-level groups of version 2, and the flat fields of version 1.
GROUPS = ("schema_version", "metadata_version", "file_data", "people", "image_analysis", "document_data", "path_extraction", "locations_by_source")
ANALYSIS = ("photo_analysis_method", "image_category", "title", "description", "location", "date", "time", "weather", "lighting", "photo_estetic_quality")
DETECTIONS = ("face_detection_method", "image_size_for_bounding_boxes", "people_bounding_boxes")
COUNTS = ("number_of_people", "has_children", "people_detected")
FLAT = ("data_format_version", *ANALYSIS, *DETECTIONS, *COUNTS)
#: Fields of the analysis that older writers left at the top level, and their JSON types.
STRAY = {"photo_estetic_quality": (int, float), "is_low_quality": (bool,), "edit_suggestions": (object,), "quality_issues": (object,)}

_at = F.get_json_object


def is_v2(doc: Column) -> Column:
    return F.coalesce(_at(doc, "$.schema_version") == "2.0", F.lit(False))


def either(doc: Column, grouped: str, flat: str) -> Column:
    """The text at a path of version 2, or that of a field of version 1."""
    return F.when(is_v2(doc), _at(doc, f"$.{grouped}")).otherwise(_at(doc, f"$.{flat}"))


def title(doc: Column) -> Column:
    return either(doc, "image_analysis.title", "title")


def description(doc: Column) -> Column:
    return either(doc, "image_analysis.description", "description")


def category(doc: Column) -> Column:
    return either(doc, "image_analysis.image_category", "image_category")


def number_of_people(doc: Column) -> Column:
    return either(doc, "people.vlm_analysis.number_of_people", "number_of_people").try_cast("double")


def has_children(doc: Column) -> Column:
    return either(doc, "people.vlm_analysis.has_children", "has_children").try_cast("boolean")


def face_method(doc: Column) -> Column:
    return either(doc, "people.detections.face_detection_method", "face_detection_method")


def box_count(doc: Column) -> Column:
    """Number of people's boxes; 0 without a list of them."""
    return F.coalesce(F.json_array_length(either(doc, "people.detections.people_bounding_boxes", "people_bounding_boxes")), F.lit(0))


def quality(doc: Column) -> Column:
    """The aesthetic quality, 1 to 10 after clamping, wherever it was written; null without one."""
    raw = F.coalesce(_at(doc, "$.image_analysis.photo_estetic_quality"), _at(doc, "$.photo_estetic_quality")).try_cast("double")
    return F.when(raw.isNotNull() & ~F.isnan(raw), F.greatest(F.lit(1.0), F.least(F.lit(10.0), raw)))


#: What ``read_once`` can read of a document.
READ = {"category": category, "quality": quality, "number_of_people": number_of_people, "face_method": face_method, "box_count": box_count}


def read_once(items: DataFrame, *names: str, doc: str = "ai_metadata", into: str = "__read") -> DataFrame:
    """``items`` with a struct of the named parts of a document. A row of one element is generated for it, as conditions on a plain column
    would be moved below it and read the document again in each place."""
    return items.select("*", F.explode(F.array(F.struct(*[READ[n](F.col(doc)).alias(n) for n in names]))).alias(into))


def extracted_at(doc: Column) -> Column:
    return F.coalesce(_at(doc, "$.file_data.metadata_extracted_at"), _at(doc, "$.provenance.metadata_extracted_at"))


def extras(doc: Column) -> Column:
    """The other top-level fields, as a map of texts."""
    known = F.array(*[F.lit(k) for k in GROUPS])
    flat = F.array(*[F.lit(k) for k in (*GROUPS, *FLAT)])
    gone = F.array(*[F.lit(k) for k in (*STRAY, "photo_star_rating_1_5", "star_rating_1_5", "provenance")])
    every = F.from_json(doc, "map<string,string>")
    return F.map_filter(every, lambda k, v: ~F.array_contains(F.when(is_v2(doc), known).otherwise(flat), k) & ~F.array_contains(gone, k))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def texts_in(node: Column) -> Column:
    """The strings of a JSON array, or those at the numbered keys of a JSON object in the order of the numbers; trimmed,
    blanks and ``none`` left out. Null for other JSON."""
    v = F.try_parse_json(node)
    array = F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: _kind(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    entries = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    numbered = F.filter(entries, lambda e: e["key"].rlike(r"^\d+$") & (_kind(e["value"]) == "STRING"))
    keyed = F.array_sort(F.transform(numbered, lambda e: F.struct(e["key"].try_cast("long").alias("at"), F.try_variant_get(e["value"], "$", "string").alias("text"))))
    found = F.when(_kind(v).startswith("ARRAY"), array).when(_kind(v).startswith("OBJECT"), F.transform(keyed, lambda e: e["text"]))
    return F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: (t != "") & (F.lower(t) != "none"))


def quality_issues(doc: Column) -> Column:
    return texts_in(F.coalesce(_at(doc, "$.image_analysis.quality_issues"), _at(doc, "$.quality_issues")))


# --------------------------------------------------------------------------- normalising and merging, with what is unknown kept


def _object(x) -> dict:
    return x if isinstance(x, dict) else {}


def normal(doc) -> dict:
    """A metadata object in version 2; unknown fields stay, fields of the analysis move into its group."""
    doc = _object(doc)
    if doc.get("schema_version") == "2.0":
        out = {k: v for k, v in doc.items() if k != "provenance"}
        before = _object(doc.get("provenance"))
        data = dict(_object(out.get("file_data")))
        if data.get("metadata_extracted_at") is None and before:
            data["metadata_extracted_at"] = before.get("metadata_extracted_at")
        if out.get("metadata_version") is None and before:
            out["metadata_version"] = before.get("metadata_version")
        out["file_data"] = data
    elif not doc:
        return {"schema_version": "2.0"}
    else:
        own = lambda names: {k: doc.get(k) for k in names}
        out = {k: v for k, v in doc.items() if k not in FLAT}
        out |= {"schema_version": "2.0", "metadata_version": None, "file_data": {"metadata_extracted_at": None}}
        out |= {"people": {"face_count": doc.get("number_of_people"), "vlm_analysis": own(COUNTS), "detections": own(DETECTIONS)}, "image_analysis": own(ANALYSIS)}
    analysis = dict(_object(out.get("image_analysis")))
    for name, kinds in STRAY.items():
        value = out.pop(name, None)
        if name not in analysis and value is not None and isinstance(value, kinds) and (bool in kinds or not isinstance(value, bool) or object in kinds):
            analysis[name] = value
    analysis.pop("star_rating_1_5", None)
    out.pop("photo_star_rating_1_5", None)
    out.pop("star_rating_1_5", None)
    out["image_analysis"] = analysis
    return out


def merge(doc, patch) -> dict:
    """``patch`` over a metadata object: groups merge field by field (technical capture, model's view and detections one
    level deeper), everything else is replaced."""
    base, patch = normal(doc), _object(patch)
    over = lambda *path: (_object(_dig(base, path)) | _object(_dig(patch, path)))
    out = {**base, **patch, "schema_version": "2.0"}
    out["file_data"] = over("file_data")
    out["file_data"]["technical"] = over("file_data", "technical") | {"capture": over("file_data", "technical", "capture")}
    if "exif_xmp" in _object(patch.get("file_data")):
        out["file_data"]["exif_xmp"] = over("file_data", "exif_xmp")
    out["people"] = over("people")
    if "vlm_analysis" in _object(patch.get("people")):
        out["people"]["vlm_analysis"] = over("people", "vlm_analysis")
    out["people"]["detections"] = over("people", "detections")
    out["image_analysis"] = over("image_analysis")
    return out


def _dig(x, path):
    for k in path:
        x = _object(x).get(k)
    return x


def _load(text):
    try:
        return json.loads(text) if isinstance(text, str) else None
    except ValueError:
        return None


def _dump(doc) -> str:
    return json.dumps(doc, ensure_ascii=False, separators=(",", ":"))


#: Documents whose objects a task holds at once.
SLICE = 256


def _in_slices(f, *columns: pa.Array) -> pa.Array:
    """``f`` of each row: a few rows are objects at once, the others stay in Arrow."""
    rows = ((c.slice(i, SLICE).to_pylist() for c in columns) for i in range(0, len(columns[0]), SLICE))
    parts = [pa.array([f(*r) for r in zip(*some)], pa.string()) for some in rows]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def normalised(docs: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """JSON text in version 2; null, broken or other JSON becomes an empty document."""
    for s in docs:
        yield _in_slices(lambda t: _dump(normal(_load(t))), s)


@F.arrow_udf(StringType())
def merged(both: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """JSON text of a patch over a document, see ``merge``."""
    for a, b in both:
        yield _in_slices(lambda x, y: _dump(merge(_load(x), _load(y))), a, b)


# --------------------------------------------------------------------------- answers of language models


def json_part(answer: Column) -> Column:
    """The JSON in an answer: all of it if it is in braces, else a fenced block, else from the first brace to the last."""
    t = F.trim(F.regexp_replace(answer, r"^\s+|\s+$", ""))
    fenced = F.regexp_extract(t, r"(?is)```(?:json)?\s*(.*?)```", 1)
    return F.when(t.startswith("{") & t.endswith("}"), t).when(t.rlike(r"(?is)```.*?```"), F.trim(fenced)).otherwise(F.coalesce(F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit("")), t))


def _typed(v: Column, name: str, kinds: tuple[str, ...], cast: str) -> Column:
    """A field of a variant if its JSON type is one of ``kinds``, else null."""
    kind = _kind(F.try_variant_get(v, f"$.{name}", "variant"))
    ok = kind.rlike("^(" + "|".join(kinds) + ")")
    return F.when(ok, F.try_variant_get(v, f"$.{name}", cast))


NUMBER = ("BIGINT", "DOUBLE", "DECIMAL")


def _word(v: Column, name: str) -> Column:
    return F.nullif(F.trim(_typed(v, name, ("STRING",), "string")), F.lit(""))


def photo_analysis(answer: Column) -> Column:
    """struct of a photo analysis read from a model's answer, fields of a wrong JSON type null; null if the answer has no
    object or lacks category, title or description."""

    def read(v: Column) -> Column:
        ages = F.filter(F.transform(F.try_variant_get(v, "$.people", "array<variant>"), lambda p: _typed(p, "average_age", NUMBER, "double")), lambda a: a.isNotNull())
        return F.struct(
            *[_word(v, n).alias(n) for n in ("image_category", "title", "description", "location", "date", "time", "weather", "daytime")],
            _typed(v, "number_of_people", NUMBER, "double").alias("number_of_people"),
            F.coalesce(_typed(v, "has_child_or_children", ("BOOLEAN",), "boolean"), _typed(v, "has_children", ("BOOLEAN",), "boolean")).alias("has_children"),
            _typed(v, "photo_estetic_quality", NUMBER, "double").alias("photo_estetic_quality"),
            _typed(v, "is_low_quality", ("BOOLEAN",), "boolean").alias("is_low_quality"),
            F.coalesce(ages, F.array().cast("array<double>")).alias("ages"),
        )

    whole = lambda a: F.when(a["image_category"].isNotNull() & a["title"].isNotNull() & a["description"].isNotNull(), a)
    return let(let(F.try_parse_json(json_part(answer)), read), whole)


def age_range(ages: Column) -> Column:
    return F.struct(F.array_min(ages).alias("age_min"), F.array_max(ages).alias("age_max"))


def caption(analysis: Column) -> Column:
    """Title, description, location, people and ages of an analysis in one sentence-like text."""
    number = lambda n: F.when(n == F.floor(n), n.cast("long").cast("string")).otherwise(n.cast("string"))
    ages = F.array_join(F.transform(analysis["ages"], number), ", ")
    return F.concat_ws(
        ". ", analysis["title"], analysis["description"],
        F.when(analysis["location"].isNotNull(), F.concat(F.lit("Location: "), analysis["location"])),
        F.when(analysis["number_of_people"].isNotNull(), F.concat(F.lit("People detected: "), number(analysis["number_of_people"]))),
        F.when(F.size(analysis["ages"]) > 0, F.concat(F.lit("Detected ages: "), ages)),
    )


#: Keys under which models wrap the list of answers.
WRAPPERS = ("results", "files", "items", "data", "extracted", "paths", "annotations", "metadata")


def answers(answer: Column, expected: Column) -> Column:
    """The answers for a batch of ``expected`` files as an array of variants: a list, or one under a wrapper's key; a lone
    numbered answer counts if one file was asked. Null if their number isn't that of the files."""
    t = F.trim(answer)
    fenced = F.regexp_extract(t, r"(?is)^```(?:json)?\s*(.*?)```$", 1)

    def read(v: Column) -> Column:
        many = lambda path: F.when(_kind(F.try_variant_get(v, path, "variant")).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))
        shaped = F.coalesce(*[F.try_variant_get(v, f"$.{n}", "variant") for n in ("date", "location", "display_title")]).isNotNull()
        lone = F.when(_typed(v, "index", NUMBER, "double").isNotNull() & shaped & (expected == 1), F.array(v))
        return F.coalesce(many("$"), *[many(f"$.{k}") for k in WRAPPERS], lone)

    fits = lambda found: F.when(F.size(found) == expected, found).when((expected == 1) & (F.size(found) > 0), F.slice(found, 1, 1))
    return let(let(F.try_parse_json(F.when(fenced != "", F.trim(fenced)).otherwise(t)), read), fits)


def date_precision(start: Column, end: Column) -> Column:
    value = F.coalesce(F.nullif(F.trim(end), F.lit("")), F.trim(start))
    return F.when(value.rlike(r"^\d{4}$"), "year").when(value.rlike(r"^\d{4}-\d{2}$"), "month").otherwise("day")


def one_place(text: Column) -> Column:
    """A place's name, trimmed; null if blank or if it names several."""
    t = F.trim(text)
    return F.when((t != "") & ~t.rlike(r"(?i)[;,/]|(?:\s-\s)|(?:\s+and\s+)|(?:\s+or\s+)|(?:\s+&\s+)"), t)


#: Cities whose country is checked.
CITY_COUNTRY = {"paris": "france", "annecy": "france", "nice": "france", "geneva": "switzerland", "lausanne": "switzerland", "berlin": "germany", "munich": "germany"}


def consistent_place(country: Column, city: Column) -> Column:
    """struct(country, city), both null where a known city is given another country."""
    known = F.create_map(*[F.lit(x) for pair in CITY_COUNTRY.items() for x in pair])
    expected = F.try_element_at(known, F.lower(F.trim(city)))
    wrong = F.coalesce(expected != F.lower(F.trim(country)), F.lit(False))
    keep = lambda c, name: F.when(~wrong, c).alias(name)
    return F.struct(keep(country, "country"), keep(city, "city"))


def spoken_place(text: Column, countries: Column) -> Column:
    """struct(country, city, place) from a place in words ("city, country, place"): labels are stripped, empty parts left
    out. Of the first two parts the one that is a known country (lower-case names) is the country, the first if neither
    or both are; a lone part counts only if it is a country."""
    parts = F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_replace(F.trim(p), r"(?i)^(country|city|area|state|province|place)\s*:\s*", "")))
    parts = F.filter(parts, lambda p: (p != "") & ~p.rlike(r"(?i)^(null|none|unknown|n/a|na)$"))
    at = lambda i: F.try_element_at(parts, F.lit(i))
    known = lambda p: F.coalesce(F.array_contains(countries, F.lower(F.trim(p))), F.lit(False))
    swapped = known(at(2)) & ~known(at(1))
    none = F.lit(None).cast("string")
    two = F.struct(F.when(swapped, at(2)).otherwise(at(1)).alias("country"), F.when(swapped, at(1)).otherwise(at(2)).alias("city"), F.when(F.size(parts) > 2, F.array_join(F.slice(parts, 3, 1000), ", ")).alias("place"))
    one = F.struct(F.when(known(at(1)), at(1)).alias("country"), none.alias("city"), none.alias("place"))
    return F.when(F.size(parts) == 1, one).when(F.size(parts) > 1, two)


def query_analysis(answer: Column, query: Column) -> Column:
    """struct(language, translated, english, keywords) from a model's reading of a search query; null if it isn't JSON,
    repeats its instructions or isn't in Latin script. At most five keywords, from the first list that has some."""
    t = F.trim(answer)
    fenced = F.regexp_extract(t, r"(?is)^```(?:json)?\s*(.*?)```$", 1)
    v = F.try_parse_json(F.when(fenced != "", F.trim(fenced)).otherwise(t))
    text = lambda x: F.when(_kind(x) == "STRING", F.nullif(F.trim(F.try_variant_get(x, "$", "string")), F.lit("")))
    foreign = lambda s: s.rlike(r"[\x{0400}-\x{04FF}\x{0590}-\x{06FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}]")

    def read(v: Column) -> Column:
        word = lambda *names: F.coalesce(*[_word(v, n) for n in names])
        lists = F.transform(F.array(*[F.try_variant_get(v, f"$.{n}", "array<variant>") for n in ("keywords", "key_concepts", "keyConcepts")]), lambda xs: F.slice(F.filter(F.transform(xs, text), lambda x: x.isNotNull()), 1, 5))
        some = F.try_element_at(F.filter(lists, lambda xs: F.size(xs) > 0), F.lit(1))
        return F.struct(
            F.coalesce(word("original_language", "originalLanguage"), F.lit("en")).alias("language"), _typed(v, "translated", ("BOOLEAN",), "boolean").alias("translated"),
            F.coalesce(word("english_query", "englishQuery"), query).alias("english"), F.coalesce(some, F.array().cast("array<string>")).alias("keywords"), v.isNotNull().alias("read"),
        )

    def kept(a: Column) -> Column:
        low = F.lower(a["english"])
        copied = low.contains("same as input") | (low.contains("the query in english") & low.contains("already")) | low.rlike("original_language|iso 639-1|keyword1|keyword or phrase")
        good = a["read"] & ~copied & ~foreign(a["english"]) & ~F.exists(a["keywords"], foreign)
        return F.when(good, F.struct(a["language"].alias("language"), F.coalesce(a["translated"], F.lower(a["language"]) != "en").alias("translated"), a["english"].alias("english"), a["keywords"].alias("keywords")))

    return let(let(v, read), kept)


# --------------------------------------------------------------------------- edit suggestions, ratings

#: How an observed orientation is corrected (degrees clockwise).
CORRECTION = {"rotated_90_cw": 270, "rotated_180": 180, "rotated_270_cw": 90}


def rotation_angle(explicit: Column, observed: Column) -> Column:
    """90, 180 or 270 clockwise: the explicit angle (-90 is 270), else what corrects the observed orientation; else null."""
    mapped = F.try_element_at(F.create_map(*[F.lit(x) for pair in CORRECTION.items() for x in pair]), observed)
    given = explicit.try_cast("double")
    return F.coalesce(F.when(given.isin(90.0, 180.0, 270.0), given.cast("int")).when(given == -90, F.lit(270)), mapped)


def crop_box(x: Column, y: Column, width: Column, height: Column, tolerance: float = 0.02) -> Column:
    """A crop in shares of the image, clamped into it; null if a number lies further out than the tolerance or nothing is left."""
    near = lambda c: F.when(c.between(-tolerance, 1 + tolerance), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    x, y, w, h = (near(c) for c in (x, y, width, height))
    inside = (w > 0) & (h > 0) & (x + w <= 1 + tolerance) & (y + h <= 1 + tolerance)
    cw, ch = F.least(w, 1 - x), F.least(h, 1 - y)
    return F.when(inside & (cw > 0) & (ch > 0), F.struct(x.alias("x"), y.alias("y"), cw.alias("width"), ch.alias("height")))


def stars_of_percent(percent: Column) -> Column:
    """0 to 5 stars of a rating of 0 to 100."""
    return F.when(percent <= 0, 0).when(percent <= 24, 1).when(percent <= 49, 2).when(percent <= 74, 3).when(percent <= 98, 4).otherwise(5)


def star_rating(xmp: Column, exif: Column, percent: Column) -> Column:
    """Stars (-1: rejected, 0 to 5) of the first tag that has some: XMP, EXIF, percent. Tags above 5 count as percent."""
    whole = lambda n: n == F.floor(n)
    tag = lambda n: F.when(whole(n) & n.between(0, 5), n.cast("int")).when(whole(n) & (n > 5) & (n <= 100), stars_of_percent(n))
    return F.coalesce(F.when(xmp == -1, F.lit(-1)), tag(xmp), tag(exif), F.when(percent.between(0, 100), stars_of_percent(percent)))


def percent_of_stars(stars: Column) -> Column:
    """The rating in percent that stands for 1 to 5 stars, 0 without."""
    n = F.greatest(F.lit(1), F.least(F.lit(5), F.floor(stars + 0.5))).cast("int")
    return F.when(stars > 0, F.element_at(F.array(*[F.lit(p) for p in (1, 25, 50, 75, 99)]), n)).otherwise(0)


def rating_tokens(stars: Column) -> Column:
    """The words under which a rating is found by text search."""
    return F.when(stars == -1, "file_rating_rejected").when(stars == 0, "file_rating_unrated").when(stars.between(1, 5), F.concat(F.lit("file_rating_"), stars.cast("string"))).otherwise("")


def search_fields(doc: Column, location_name: Column) -> Column:
    """struct(title, description, location, category, rating) for the text index: embedded texts before the model's, the
    catalogue's place before embedded and model's place."""
    word = lambda c: F.nullif(F.trim(c), F.lit(""))
    embedded = lambda n: word(_at(doc, f"$.file_data.exif_xmp.{n}"))
    where = either(doc, "image_analysis.location", "location")
    place = word(F.concat_ws(", ", *[word(_at(where, f"$.{n}")) for n in ("place_name", "city", "country")]))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        blank(F.coalesce(embedded("title"), word(title(doc)))).alias("title"),
        blank(F.coalesce(embedded("description"), word(description(doc)))).alias("description"),
        blank(F.coalesce(word(location_name), embedded("location_text"), place)).alias("location"),
        blank(category(doc)).alias("category"),
        rating_tokens(_at(doc, "$.file_data.exif_xmp.star_rating").try_cast("int")).alias("rating"),
    )


def joined(separator: str, *parts: Column) -> Column:
    """The different non-blank parts, trimmed, in order."""
    return F.array_join(F.array_distinct(F.filter(F.array(*[F.trim(p) for p in parts]), lambda p: p != "")), separator)


def analysis_patch(analysis: Column, model: str) -> Column:
    """The JSON patch (see ``merge``) that a photo analysis writes; null without one."""
    people = F.struct(analysis["number_of_people"].cast("long").alias("number_of_people"), analysis["has_children"].alias("has_children"))
    seen = F.struct(analysis["image_category"].alias("image_category"), analysis["title"].alias("title"), analysis["description"].alias("description"), analysis["photo_estetic_quality"].alias("photo_estetic_quality"), F.lit(model).alias("photo_analysis_method"))
    return F.when(analysis.isNotNull(), F.to_json(F.struct(F.struct(people.alias("vlm_analysis")).alias("people"), seen.alias("image_analysis")), {"ignoreNullFields": "false"}))


def faces_patch(faces: Column, method: Column, width: Column, height: Column) -> Column:
    """The JSON patch that a face detection writes: the number of faces (null for none), the method and the boxes' image size."""
    size = F.struct(width.alias("width"), height.alias("height"))
    found = F.struct(method.alias("face_detection_method"), size.alias("image_size_for_bounding_boxes"))
    return F.to_json(F.struct(F.struct(F.when(faces > 0, faces).alias("face_count"), found.alias("detections")).alias("people")), {"ignoreNullFields": "false"})


def path_patch(start: Column, end: Column, country: Column, city: Column, title: Column, stem: Column, model: str, now: str) -> Column:
    """The JSON patch of what a model read in a path: date, place and title where there are any; a title only if it isn't the stem."""
    date = F.when(start.isNotNull(), F.struct(start.alias("start"), end.alias("end"), date_precision(start, end).alias("precision"), F.lit("llm_path").alias("source")))
    place = F.when(F.coalesce(country, city).isNotNull(), F.struct(country.alias("country"), city.alias("city"), F.lit("llm_path").alias("source")))
    own = F.nullif(F.trim(title), F.lit(""))
    read = F.struct(F.lit(now).alias("llm_extracted_at"), F.lit(model).alias("llm_model"), date.alias("date"), place.alias("location"), F.when(~own.eqNullSafe(F.trim(stem)), own).alias("display_title"))
    return F.to_json(F.struct(read.alias("path_extraction")))
