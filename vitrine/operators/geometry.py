"""Boxes and faces: suppression, matching, roles, orientation, turns, canonical forms, priors, points."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .store import dropped, written


def _box(prefix: str = ""):
    return F.struct(*[F.col(f"{prefix}{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])


#: Images with more boxes than this are settled by rounds over grid cells, the others within a task.
SMALL = 1000


def _large(small: int, *sides: DataFrame) -> DataFrame:
    """The images with more than ``small`` boxes on all sides together, written: counts alone are dealt by image."""
    counts = reduce(DataFrame.unionByName, [s.groupBy("image").agg(F.count("*").alias("n")) for s in sides])
    return written(counts.groupBy("image").agg(F.sum("n").alias("n")).where(F.col("n") > small).select("image"), "large-images")


def _few(boxes: DataFrame, large: DataFrame) -> DataFrame:
    return boxes.join(large, "image", "left_anti").select(*boxes.columns)


def _many(boxes: DataFrame, large: DataFrame) -> DataFrame:
    return boxes.join(large, "image", "left_semi").select(*boxes.columns)


def cells(boxes: DataFrame, threshold: float, pixel: int = 0) -> DataFrame:
    """The grid cells in which a box can meet any that overlaps it by the threshold (IoU): the columns of ``boxes`` and ``g, cx, cy, own``.

    The longest sides of two such boxes differ by at most 1 / threshold, so a box is put into the grid of its own size class (cells
    at least as long as it, at most four of them) and, as a guest, into those of the next larger classes that it may meet. Two
    boxes meet in the grid of the larger one's class, of which the larger is an own member.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    more = math.ceil(math.log(1 / threshold, 4) - 1e-12) if threshold < 1 else 0
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(0.0)) + pixel
    level = F.floor(F.log2(F.greatest(side, F.lit(2.0**-40))) / 2).cast("int")
    b = boxes.withColumn("__level", level).withColumn("g", F.explode(F.sequence(F.col("__level"), F.col("__level") + more)))
    width = F.pow(F.lit(4.0), F.col("g") + 1)
    at = lambda c: F.floor(c / width).cast("long")
    b = b.withColumn("cx", F.explode(F.sequence(at(F.col("x1")), at(F.greatest("x1", F.col("x2") + pixel)))))
    b = b.withColumn("cy", F.explode(F.sequence(at(F.col("y1")), at(F.greatest("y1", F.col("y2") + pixel)))))
    return b.withColumn("own", F.col("g") == F.col("__level")).drop("__level")


def _begins(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    out = np.ones(len(keys), bool)
    out[1:] = keys[1:] != keys[:-1]
    return out


def _taken_by_group(rows: DataFrame, key: str, order: list, take: Callable[[pd.DataFrame, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows (their places, in any order) that ``take(frame, group)`` picks from runs of equal keys, rows in the given order;
    ``group`` numbers the runs.

    Groups are dealt by key and met in sorted order, so a task holds one batch and the group that it is in. All groups of a
    batch are settled together, and no frame or array is made for each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None

        def done(frame: pd.DataFrame) -> pd.DataFrame:
            keys = frame[key].to_numpy()
            return frame.iloc[np.sort(take(frame, np.cumsum(_begins(keys)) - 1))]

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            keys = frame[key].to_numpy()
            last = len(keys) - int(np.argmax((keys != keys[-1])[::-1])) if keys[0] != keys[-1] else 0
            held = frame.iloc[last:]
            if last:
                yield done(frame.iloc[:last])
        if held is not None and len(held):
            yield done(held)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, rows.schema)


def _overlap(a: str, b: str) -> Column:
    """IoU of two boxes with a pixel added to each side."""
    c = lambda side, k: F.col(f"{side}.{k}")
    w, h = (F.greatest(F.lit(0.0), F.least(c(a, f"{k}2"), c(b, f"{k}2")) - F.greatest(c(a, f"{k}1"), c(b, f"{k}1")) + 1) for k in "xy")
    size = lambda s: (c(s, "x2") - c(s, "x1") + 1) * (c(s, "y2") - c(s, "y1") + 1)
    return w * h / (size(a) + size(b) - w * h)


def suppress_by_rounds(boxes: DataFrame, threshold: float, most_rounds: int = 200) -> DataFrame:
    """``suppress`` for images of any number of boxes: no task holds an image, and no pairs of boxes are formed but those with a box just
    taken.

    In each round, the best live box of every cell is found (a minimum, summed up in the tasks first). A box that is the best in all
    its cells beats all its live neighbours: it stays, and what it overlaps too much goes. Guests of a cell are held only
    against its own members. The best live box of an image always stays, so the rounds end.
    """
    key = F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("less"), F.col("id").alias("id"))
    place = ["image", "g", "cx", "cy"]
    live = cells(boxes.select("image", "id", *"x1 y1 x2 y2 score".split()), threshold, 1).withColumn("key", key)
    live = written(live.join(live.where("own").select(*place).distinct(), place, "left_semi").unionByName(live.where("own")).distinct(), "boxes-live")
    kept = []
    for _ in range(most_rounds):
        if live.isEmpty():
            break
        best = live.groupBy(*place).agg(F.min(F.when(F.col("own"), F.col("key"))).alias("own_best"), F.min(F.when(~F.col("own"), F.col("key"))).alias("guest_best"))
        beats = (F.col("key") <= F.coalesce("own_best", "key")) & (~F.col("own") | (F.col("key") <= F.coalesce("guest_best", "key")))
        first = live.join(best, place).groupBy("image", "id").agg(F.bool_and(beats).alias("first")).where("first").select("image", "id")
        first = written(first, "boxes-first")
        kept.append(first)
        top = live.join(first, ["image", "id"], "left_semi").alias("a")
        rest = live.join(first, ["image", "id"], "left_anti").alias("b")
        meet = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in place]
        gone = top.join(rest, meet).where((F.col("a.own") | F.col("b.own")) & (_overlap("a", "b") > threshold)).select("b.image", "b.id").distinct()
        live, old = written(rest.join(gone, ["image", "id"], "left_anti").select(*live.columns), "boxes-live"), live
        dropped(old)
    else:
        raise RuntimeError(f"boxes did not settle in {most_rounds} rounds")
    if not kept:
        return boxes.limit(0)
    return boxes.join(reduce(DataFrame.unionByName, kept), ["image", "id"], "left_semi").select(*boxes.columns)


def suppress(boxes: DataFrame, threshold: float, small: int = SMALL) -> DataFrame:
    """Boxes ``(image, id, x1, y1, x2, y2, score)`` that stay: best score first (ties to the smaller id, none last), none may overlap a kept
    one by more than the threshold (IoU with a pixel added to each side). Images with at most ``small`` boxes are settled in Arrow
    batches, image by image, the others by rounds.
    """
    large = _large(small, boxes)
    if large.isEmpty():  # the boxes aren't read once more to find that none are left
        return _suppress_in_tasks(boxes, threshold)
    return _suppress_in_tasks(_few(boxes, large), threshold).unionByName(suppress_by_rounds(_many(boxes, large), threshold))


def _suppress_in_tasks(boxes: DataFrame, threshold: float) -> DataFrame:

    def keep(frame: pd.DataFrame, image: np.ndarray) -> np.ndarray:
        x1, y1, x2, y2 = (frame[c].to_numpy() for c in ("x1", "y1", "x2", "y2"))
        size = (x2 - x1 + 1) * (y2 - y1 + 1)
        alive, out = np.arange(len(frame)), []
        while len(alive):  # the best live box of each image stays, what it overlaps too much goes
            best = _begins(image[alive])
            top, rest = alive[best][np.cumsum(best) - 1][~best], alive[~best]
            out.append(alive[best])
            w = np.maximum(0, np.minimum(x2[rest], x2[top]) - np.maximum(x1[rest], x1[top]) + 1)
            h = np.maximum(0, np.minimum(y2[rest], y2[top]) - np.maximum(y1[rest], y1[top]) + 1)
            alive = rest[~(w * h / (size[top] + size[rest] - w * h) > threshold)]
        return np.concatenate(out)

    return _taken_by_group(boxes, "image", [F.desc("score"), F.asc("id")], keep)


def match_by_rounds(pairs: DataFrame, most_rounds: int = 200) -> DataFrame:
    """``greedy_match`` over ``pairs(image, old_id, new_id, iou)`` of any number in an image: in each round, pairs that are the best of both
    their boxes are taken, and the pairs of these boxes go."""
    order = F.struct((-F.col("iou")).alias("less"), "old_id", "new_id")
    live, taken = written(pairs.withColumn("key", order), "pairs-live"), []
    for _ in range(most_rounds):
        if live.isEmpty():
            break
        best = lambda c: live.groupBy("image", c).agg(F.min("key").alias(f"best_{c}"))  # noqa: E731, B023
        now = live.join(best("old_id"), ["image", "old_id"]).join(best("new_id"), ["image", "new_id"]).where("key = best_old_id and key = best_new_id")
        now = written(now.select("image", "old_id", "new_id", "iou"), "pairs-taken")
        taken.append(now)
        rest = live.join(now.select("image", "old_id"), ["image", "old_id"], "left_anti").join(now.select("image", "new_id"), ["image", "new_id"], "left_anti")
        live, before = written(rest.select(*live.columns), "pairs-live"), live
        dropped(before)
    else:
        raise RuntimeError(f"pairs did not settle in {most_rounds} rounds")
    return reduce(DataFrame.unionByName, taken) if taken else pairs.limit(0)


def greedy_match(old: DataFrame, new: DataFrame, threshold: float, small: int = SMALL) -> DataFrame:
    """``image, old_id, new_id, iou``: one to one, the largest IoU first (ties to the smaller ids), at least the threshold, which is above 0.
    Images with at most ``small`` old and new boxes together are settled in tasks, the others by rounds over pairs that meet in
    a grid cell."""
    columns = ["image", "id", "x1", "y1", "x2", "y2"]
    old, new = old.select(*columns), new.select(*columns)
    large = _large(small, old, new)
    none = large.isEmpty()
    side = lambda df, as_: (df if none else _few(df, large)).select("image", F.col("id").alias(f"{as_}_id"), _box().alias(as_))
    near = lambda p: p.select("image", "old_id", "new_id", S.iou(F.col("old"), F.col("new")).alias("iou")).where(F.col("iou") >= threshold)
    done = _match_in_tasks(near(side(old, "old").join(side(new, "new"), "image")))  # sides that lie by image meet as they lie
    if none:
        return done
    many = _many(old, large).withColumn("is_old", F.lit(True)).unionByName(_many(new, large).withColumn("is_old", F.lit(False)))
    c = cells(many, threshold)
    place = ["image", "g", "cx", "cy"]
    there = lambda is_old, as_: c.where(F.col("is_old") == is_old).select(*place, F.col("id").alias(f"{as_}_id"), _box().alias(as_), F.col("own").alias(f"{as_}_own"))
    met = there(True, "old").join(there(False, "new"), place).where("old_own or new_own")
    return done.unionByName(match_by_rounds(near(met.dropDuplicates(["image", "old_id", "new_id"]))))


def _match_in_tasks(pairs: DataFrame) -> DataFrame:

    def take(frame: pd.DataFrame, image: np.ndarray) -> np.ndarray:
        old_ids, new_ids = frame["old_id"].to_numpy(), frame["new_id"].to_numpy()
        alive, out = np.arange(len(frame)), []
        while len(alive):  # the best live pair of each image is taken, and the pairs of its boxes go
            best = _begins(image[alive])
            top, rest = alive[best][np.cumsum(best) - 1][~best], alive[~best]
            out.append(alive[best])
            alive = rest[(old_ids[rest] != old_ids[top]) & (new_ids[rest] != new_ids[top])]
        return np.concatenate(out)

    return _taken_by_group(pairs, "image", [F.desc("iou"), F.asc("old_id"), F.asc("new_id")], take)


def roles(boxes: DataFrame, least_side: float = 0.5, least_area: float = 0.01) -> DataFrame:
    """Adds ``side_ratio``, ``area_ratio`` and ``role`` to ``boxes(image, x1, y1, x2, y2, image_width, image_height)``.

    ``main`` are faces whose short side is at least ``least_side`` of the longest short side in their image and whose area
    is at least ``least_area`` of the image's; others are ``background``. A ratio that can't be told (no side, no image
    size) is null and passes.
    """
    side = F.greatest(F.lit(0.0), F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    longest = F.max("side").over(W.partitionBy("image"))
    whole = F.when((F.col("image_width") > 0) & (F.col("image_height") > 0), F.col("image_width") * F.col("image_height"))
    out = boxes.withColumn("side", side).withColumn("side_ratio", F.when(longest > 0, F.col("side") / longest)).withColumn("area_ratio", S.area(_box()) / whole)
    passes = F.coalesce(F.col("side_ratio") >= least_side, F.lit(True)) & F.coalesce(F.col("area_ratio") >= least_area, F.lit(True))
    return out.withColumn("role", F.when(passes, "main").otherwise("background")).drop("side")


#: What corrects an orientation, in degrees clockwise.
ORIENTATIONS = {"upright": 0, "rotated_90_cw": 270, "rotated_180": 180, "rotated_270_cw": 90}


def face_vote(landmarks: Column, score: Column, least_ratio: float = 1.3) -> Column:
    """struct(orientation, confidence) of a face from its points (left eye, right eye, nose, ...), each an array (x, y);
    null if points are missing or the nose lies too much between the axes.

    The nose lies below the middle of the eyes in an upright face. Confidence grows with how clearly one axis dominates
    (full at 5 times) and with the detection's score.
    """
    at = lambda p, c: F.get(F.get(landmarks, F.lit(p)), F.lit(c))
    x, y = at(2, 0) - (at(0, 0) + at(1, 0)) / 2, at(2, 1) - (at(0, 1) + at(1, 1)) / 2
    most, least = F.greatest(F.abs(x), F.abs(y)), F.least(F.abs(x), F.abs(y))
    ratio = most / F.greatest(least, F.lit(1e-6))
    named = F.when(F.abs(y) >= F.abs(x), F.when(y > 0, "upright").otherwise("rotated_180")).otherwise(F.when(x > 0, "rotated_270_cw").otherwise("rotated_90_cw"))
    whole = (F.size(landmarks) >= 5) & x.isNotNull() & y.isNotNull()
    return F.when(whole & (most >= 1e-6) & (ratio >= least_ratio), F.struct(named.alias("orientation"), (F.least(F.lit(1.0), ratio / 5) * F.least(F.lit(1.0), score)).alias("confidence")))


def orientation(votes: DataFrame) -> DataFrame:
    """``image, orientation, angle, confidence, faces, unanimous`` of ``votes(image, orientation, confidence)``.

    The orientation with the largest sum of confidences wins, ties to the one that was seen first (the smallest ``id``, if votes have
    one) and then by name; its confidence is the mean of its votes, 0.1 more (at most 1) if several faces agree without exception.
    """
    seen = F.min("id") if "id" in votes.columns else F.lit(0)
    per = votes.groupBy("image", "orientation").agg(F.sum("confidence").alias("sum"), F.count("*").alias("n"), seen.alias("seen"))
    best = per.groupBy("image").agg(F.min(F.struct((-F.round("sum", 9)).alias("less"), "seen", "orientation", "sum", "n")).alias("b"), F.sum("n").alias("faces"))
    angle = F.create_map(*[F.lit(x) for pair in ORIENTATIONS.items() for x in pair])
    unanimous = F.col("b.n") == F.col("faces")
    boost = F.when(unanimous & (F.col("faces") > 1), 0.1).otherwise(0.0)
    return best.select("image", F.col("b.orientation").alias("orientation"), angle[F.col("b.orientation")].alias("angle"), F.least(F.lit(1.0), F.col("b.sum") / F.col("b.n") + boost).alias("confidence"), "faces", unanimous.alias("unanimous"))


def validated_turn(angle: Column, orientation_after: Column) -> Column:
    """struct(angle, source): a suggested turn, by half a turn more if faces stand on their heads after it."""
    flipped = orientation_after == "rotated_180"
    return F.struct(F.when(flipped, (angle + 180) % 360).otherwise(angle).alias("angle"), F.when(flipped, "face-corrected").otherwise("vlm").alias("source"))


def rotation_of_known_faces(found: DataFrame, least: float = 0.4) -> DataFrame:
    """``image, angle, source`` of the images whose faces settle it: of ``orientation``'s rows those of enough confidence whose faces all
    agree. The others are left to a model."""
    return found.where((F.col("confidence") >= least) & F.col("unanimous")).select("image", "angle", F.lit("face-existing").alias("source"))


def verified_rotation(suggested: DataFrame, rotated: DataFrame, flipped: DataFrame) -> DataFrame:
    """``image, angle, source`` for each of a model's ``suggested(image, angle)`` turns, checked with the faces found after it.

    ``rotated`` and ``flipped`` are ``orientation``'s rows for the image turned as suggested and by half a turn more. Faces on the turned
    image decide: the turn stays, or is half a turn more if they stand on their heads. Without any, upright faces on the flipped image
    make it that turn, if it is one (a suggestion of 180 has none). Else nothing is decided: the angle is null, the source ``vlm-fallback``.
    """
    side = lambda df, as_: df.select("image", F.col("orientation").alias(as_))
    s = suggested.select("image", F.col("angle").alias("turn")).join(side(rotated, "after"), "image", "left").join(side(flipped, "over"), "image", "left")
    checked, half = validated_turn(F.col("turn"), F.col("after")), F.pmod(F.col("turn") + 180, F.lit(360))
    upright = F.col("after").isNull() & (F.col("over") == "upright") & (half != 0)
    angle = F.when(F.col("after").isNotNull(), checked["angle"]).when(upright, half)
    source = F.when(F.col("after").isNotNull(), F.when(checked["source"] == "vlm", "face-rotated-check").otherwise("face-flipped-check")).when(upright, "face-flipped-check").otherwise("vlm-fallback")
    return s.select("image", angle.alias("angle"), source.alias("source"))


def turned_face(box: Column, points: Column, width: Column, height: Column, angle: Column) -> Column:
    """struct(box, points): a face's box (x1, y1, x2, y2) and points, in pixels counted from 0, in its image turned clockwise by 90, 180 or
    270; null points stay null."""
    x = lambda p: F.when(angle == 90, height - 1 - p[1]).when(angle == 180, width - 1 - p[0]).otherwise(p[1])
    y = lambda p: F.when(angle == 90, p[0]).when(angle == 180, height - 1 - p[1]).otherwise(width - 1 - p[0])
    a, b = F.array(box["x1"], box["y1"]), F.array(box["x2"], box["y2"])
    turned_ = F.struct(F.least(x(a), x(b)).alias("x1"), F.least(y(a), y(b)).alias("y1"), F.greatest(x(a), x(b)).alias("x2"), F.greatest(y(a), y(b)).alias("y2"))
    return F.struct(turned_.alias("box"), F.transform(points, lambda p: F.array(x(p), y(p))).alias("points"))


def composed_turn(first: Column, second: Column) -> Column:
    """Two turns clockwise as one, 0 to 270."""
    return F.pmod(first + second, F.lit(360))


def primary_turn(suggestions: Column) -> Column:
    """The angle of the surest of ``suggestions`` (array of struct(angle, confidence)), null confidences last, ties to the first."""
    keyed = F.transform(suggestions, lambda s, i: F.struct((-F.coalesce(s["confidence"], F.lit(-1.0))).alias("less"), i.alias("i"), s["angle"].alias("angle")))
    return F.array_min(F.filter(keyed, lambda k: k["angle"].isin(90, 180, 270)))["angle"]


def rescaled(box: Column, ref_width: Column, ref_height: Column, width: Column, height: Column) -> Column:
    """A box (x, y, width, height) of an image of the reference size as (x1, y1, x2, y2) in an image of another size; as
    it is where a size is unknown or both are the same."""
    known = (ref_width > 0) & (ref_height > 0) & width.isNotNull() & height.isNotNull() & ((ref_width != width) | (ref_height != height))
    sx, sy = (F.when(F.coalesce(known, F.lit(False)), a / b).otherwise(1.0) for a, b in ((width, ref_width), (height, ref_height)))
    return F.struct((box["x"] * sx).alias("x1"), (box["y"] * sy).alias("y1"), ((box["x"] + box["width"]) * sx).alias("x2"), ((box["y"] + box["height"]) * sy).alias("y2"))


def turned_size(width: Column, height: Column, angle: Column) -> Column:
    half = angle == 180
    return F.struct(F.when(half, width).otherwise(height).alias("width"), F.when(half, height).otherwise(width).alias("height"))


def turned(box: Column, width: Column, height: Column, angle: Column) -> Column:
    """A box (x, y, width, height), clamped into its image, after a quarter, half or three-quarter turn clockwise."""
    inside = lambda c, most: F.least(most, F.greatest(F.lit(0.0), c))
    x1, x2 = inside(box["x"], width), inside(box["x"] + box["width"], width)
    y1, y2 = inside(box["y"], height), inside(box["y"] + box["height"], height)
    x, y, w, h = F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1)
    out = lambda a, b, c, d: F.struct(a.alias("x"), b.alias("y"), c.alias("width"), d.alias("height"))
    return F.when(angle == 90, out(height - y - h, x, h, w)).when(angle == 180, out(width - x - w, height - y - h, w, h)).when(angle == 270, out(y, width - x - w, h, w))


def turned_points(points: Column, width: Column, height: Column, angle: Column, back: bool = False) -> Column:
    """Points (x, y) after a turn clockwise; with ``back``, points of the turned image in the original, whose size is given."""
    turn = F.pmod(-angle if back else angle, F.lit(360))
    w, h = (F.when(angle == 180, a).otherwise(b) if back else a for a, b in ((width, height), (height, width)))
    at = lambda p: (p[0], p[1])
    place = lambda p: F.when(turn == 90, F.array(h - at(p)[1], at(p)[0])).when(turn == 180, F.array(w - at(p)[0], h - at(p)[1])).when(turn == 270, F.array(at(p)[1], w - at(p)[0])).otherwise(p)
    return F.transform(points, place)


def canonical_box(box: Column) -> Column:
    """A stored box in the space of 0 to 1000: struct(x_min, y_min, x_max, y_max).

    ``box`` has x_min, y_min, x_max, y_max (that space), mp_x, mp_y, mp_width, mp_height (pixels), width, height and
    image_width, image_height, any of them null. Numbers are rounded half up and clamped; a lacking maximum follows from
    the width, and a box with a width is at least 1 wide.
    """
    iw, ih = (F.when(box[c] > 0, box[c]) for c in ("image_width", "image_height"))
    clamp = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1000.0), F.floor(c + 0.5).cast("double"))))
    pixels = iw.isNotNull() & ih.isNotNull() & box["mp_x"].isNotNull() & box["mp_y"].isNotNull()

    def edges(low: str, high: str, at: str, length: str, plain: str, size: Column):
        start = F.coalesce(clamp(box[low]), F.when(pixels, clamp(box[at] / size * 1000)))
        end = F.coalesce(clamp(box[high]), F.when(pixels, clamp((box[at] + F.coalesce(box[length], F.lit(0.0))) / size * 1000)))
        hint = F.coalesce(box[length] / size * 1000, F.when((box[plain] > 1000) & size.isNotNull(), box[plain] / size * 1000).otherwise(box[plain]))
        known = F.struct(F.coalesce(start, F.lit(0.0)).alias("first"), end.alias("end"), hint.alias("hint"))
        last = lambda k: F.when(k["end"].isNotNull(), F.greatest(k["end"], k["first"])).otherwise(clamp(k["first"] + F.coalesce(k["hint"], F.lit(0.0))))
        both = S.let(known, lambda k: F.struct(k["first"].alias("first"), last(k).alias("last"), k["hint"].alias("hint"), clamp(k["first"] + k["hint"]).alias("grown")))
        wide = lambda k: F.when((k["last"] <= k["first"]) & (k["hint"] > 0), F.when(k["grown"] > k["first"], k["grown"]).otherwise(clamp(k["first"] + 1))).otherwise(k["last"])
        return S.let(both, lambda k: F.struct(k["first"].alias("first"), wide(k).alias("last")))

    x, y = edges("x_min", "x_max", "mp_x", "mp_width", "width", iw), edges("y_min", "y_max", "mp_y", "mp_height", "height", ih)
    return F.struct(x["first"].alias("x_min"), y["first"].alias("y_min"), x["last"].alias("x_max"), y["last"].alias("y_max"))


def box_format(box: Column) -> Column:
    some = lambda *names: F.coalesce(*[box[n] for n in names]).isNotNull()
    return F.when(some("mp_x", "mp_y", "mp_width", "mp_height"), "pixel").when(some("x_min", "y_min", "x_max", "y_max"), "normalized").otherwise("unknown")


def priors(spark, width: int, height: int, sizes: list[list[int]], steps: list[int], clip: bool = False) -> DataFrame:
    """Prior boxes ``n, cx, cy, w, h`` (shares of the image) of a detector: for each step a grid, and at each place one box
    for each of its sizes. ``n`` counts them by step, row, column and size."""
    grids = spark.createDataFrame([(k, s, -(-height // s), -(-width // s), list(map(float, own))) for k, (s, own) in enumerate(zip(steps, sizes))], "k int, step int, rows int, columns int, sizes array<double>")
    cells = grids.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).select("*", F.posexplode("sizes").alias("s", "size"))
    before = {k: sum(-(-height // s) * -(-width // s) * len(own) for s, own in list(zip(steps, sizes))[:k]) for k in range(len(steps))}
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    n = offset[F.col("k")] + (F.col("i") * F.col("columns") + F.col("j")) * F.size("sizes") + F.col("s")
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) if clip else c
    return cells.select(n.alias("n"), share((F.col("j") + 0.5) * F.col("step") / width).alias("cx"), share((F.col("i") + 0.5) * F.col("step") / height).alias("cy"), share(F.col("size") / width).alias("w"), share(F.col("size") / height).alias("h"))


def decoded_box(delta: Column, v0: float = 0.1, v1: float = 0.2) -> Column:
    """struct(x1, y1, x2, y2) from a prior (columns cx, cy, w, h) and the model's four deltas."""
    cx, cy = F.col("cx") + delta[0] * v0 * F.col("w"), F.col("cy") + delta[1] * v0 * F.col("h")
    w, h = F.col("w") * F.exp(delta[2] * v1), F.col("h") * F.exp(delta[3] * v1)
    return F.struct((cx - w / 2).alias("x1"), (cy - h / 2).alias("y1"), (cx + w / 2).alias("x2"), (cy + h / 2).alias("y2"))


def decoded_points(delta: Column, v0: float = 0.1) -> Column:
    """The five points (x, y) from a prior and the model's ten deltas."""
    return F.transform(F.sequence(F.lit(0), F.lit(4)), lambda p: F.array(F.col("cx") + delta[2 * p] * v0 * F.col("w"), F.col("cy") + delta[2 * p + 1] * v0 * F.col("h")))


def passing_face(box: Column, score: Column, width: Column, height: Column, least_score: float, least_side: float) -> Column:
    """Sure enough, and the short side large enough against the image's (which passes if unknown)."""
    side = F.least(F.greatest(F.lit(0.0), box["x2"] - box["x1"]), F.greatest(F.lit(0.0), box["y2"] - box["y1"]))
    image = F.least(width, height)
    return (score >= least_score) & F.when(image > 0, side / image >= least_side).otherwise(True)


#: Where eyes, nose and mouth lie in a face's box, as shares of it.
POINTS = ((0.35, 0.38), (0.65, 0.38), (0.5, 0.55), (0.38, 0.72), (0.62, 0.72))


def points_of_box(box: Column) -> Column:
    """Five approximate points of a face of which only the box is known."""
    w, h = F.greatest(F.lit(0.0), box["x2"] - box["x1"]), F.greatest(F.lit(0.0), box["y2"] - box["y1"])
    return F.array(*[F.array(box["x1"] + a * w, box["y1"] + b * h) for a, b in POINTS])


def five_of_98(flat: Column) -> Column:
    """Five points (eyes, nose, mouth's corners, left ones first) of 98, given as 196 numbers; null if there are fewer."""
    at = lambda p: F.array(flat[2 * p], flat[2 * p + 1])
    mean = lambda a, b: F.array(*[reduce(lambda x, y: x + y, [flat[2 * p + c] for p in range(a, b + 1)]) / (b - a + 1) for c in (0, 1)])
    left_first = lambda a, b: (F.when(a[0] <= b[0], a).otherwise(b), F.when(a[0] <= b[0], b).otherwise(a))
    eyes, mouth = left_first(mean(60, 67), mean(68, 75)), left_first(at(76), at(82))
    return F.when(F.size(flat) >= 196, F.array(*eyes, at(54), *mouth))


def similarity_transform(points: DataFrame, key: str) -> DataFrame:
    """``key, a, b, tx, ty`` of the least-squares map x' = a x - b y + tx, y' = b x + a y + ty of ``points(key, x, y, u, v)``
    from (x, y) to (u, v); points in one place only are shifted. Sums are pre-aggregated."""
    names = ("x", "y", "u", "v")
    s = points.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in names], *[F.avg(F.col(p) * F.col(q)).alias(p + q) for p, q in (("x", "u"), ("y", "v"), ("x", "v"), ("y", "u"), ("x", "x"), ("y", "y"))])
    spread = lambda p, q: F.col(p + q) - F.col(p) * F.col(q)
    ss = spread("x", "x") + spread("y", "y")
    flat = F.abs(ss) < 1e-12
    s = s.withColumn("a", F.when(flat, 1.0).otherwise((spread("x", "u") + spread("y", "v")) / ss)).withColumn("b", F.when(flat, 0.0).otherwise((spread("x", "v") - spread("y", "u")) / ss))
    return s.select(key, "a", "b", (F.col("u") - F.col("a") * F.col("x") + F.col("b") * F.col("y")).alias("tx"), (F.col("v") - F.col("b") * F.col("x") - F.col("a") * F.col("y")).alias("ty"))


def age_gender(age: Column, female: Column) -> Column:
    """struct(age, gender, confidence) of a model's age and its probability of female."""
    return F.struct(F.when(age.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), age))).alias("age"), F.when(female >= 0.5, "female").when(female < 0.5, "male").alias("gender"), F.greatest(female, 1 - female).alias("confidence"))


def downscaled(width: Column, height: Column, longest: int) -> Column:
    """The size at which an image's longer side is at most ``longest``; sides are at least 1."""
    by = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    side = lambda c: F.greatest(F.lit(1), F.floor(c * by + 0.5).cast("int"))
    return F.struct(side(width).alias("width"), side(height).alias("height"))


def display_order(boxes: DataFrame) -> DataFrame:
    """Adds ``place`` (from 1): an image's boxes by area, the largest first, ties to the smaller id."""
    return boxes.withColumn("place", F.row_number().over(W.partitionBy("image").orderBy(S.area(_box()).desc(), "id")))
