"""Regions of interest: shapes to pixels, weights, outlines, region traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumentrace.functions import arrays as A
from lumentrace.model import Params
from lumentrace.plans.ranking import indexed
from lumentrace.plans.skew import join_per_key


#: Columns that say whose a region is; equal labels of different files or animals are different regions.
IDENTITY = ("animal", "file", "measu", "roi")


def _identity(df: DataFrame) -> list[str]:
    return [c for c in IDENTITY if c in df.columns]


def _truncated(c: str) -> Column:
    return F.col(c).cast("int")


def _clipped(pixels: DataFrame, nx: int, ny: int) -> DataFrame:
    return pixels.filter(F.col("x").between(0, nx - 1) & F.col("y").between(0, ny - 1))


def circle_pixels(shapes: DataFrame, nx: int, ny: int, filled: bool = False) -> DataFrame:
    """Pixels of circles ``shapes(roi, cx, cy, d)``: the outline by the midpoint rule.

    Like all shape operators it keeps the identity columns that the shapes have.

    For offset b in one octant the other offset is the largest a with
    2 b^2 + a^2 + (a - 1)^2 < 2 R^2. ``filled=True`` gives the disc inside the outline.
    """
    r = (F.col("d") / 2).cast("int")
    ids = _identity(shapes)
    octant = shapes.select(
        *ids, _truncated("cx").alias("cx"), _truncated("cy").alias("cy"), r.alias("r"),
        F.explode(F.sequence(F.lit(0), r)).alias("b"),
    )
    inner = F.col("r") * F.col("r") - F.col("b") * F.col("b") - 0.25
    a = F.when(inner >= 0, F.ceil(0.5 + F.sqrt(inner)).cast("int") - 1).otherwise(0)
    octant = octant.withColumn("a", a).filter(F.col("a") >= F.col("b"))
    a, b = F.col("a"), F.col("b")
    if filled:
        points = F.flatten(
            F.array(
                F.transform(F.sequence(-a, a), lambda k: F.struct(k.alias("dx"), b.alias("dy"))),
                F.transform(F.sequence(-a, a), lambda k: F.struct(k.alias("dx"), (-b).alias("dy"))),
                F.transform(F.sequence(-b, b), lambda k: F.struct(k.alias("dx"), a.alias("dy"))),
                F.transform(F.sequence(-b, b), lambda k: F.struct(k.alias("dx"), (-a).alias("dy"))),
            )
        )
    else:
        points = F.array(
            *[
                F.struct((p * sx).alias("dx"), (q * sy).alias("dy"))
                for p, q in ((a, b), (b, a))
                for sx in (1, -1)
                for sy in (1, -1)
            ]
        )
    spread = octant.select(*ids, "cx", "cy", F.explode(points).alias("p"))
    pixels = spread.select(*ids, (F.col("cx") + F.col("p.dx")).alias("x"), (F.col("cy") + F.col("p.dy")).alias("y"))
    return _clipped(pixels, nx, ny).distinct()


def polygon_pixels(shapes: DataFrame, nx: int, ny: int) -> DataFrame:
    """Filled polygons ``shapes(roi, vertices)``; vertices are rounded half-even.

    Inside by the even-odd rule; points on an edge belong to the polygon. Every polygon
    tests only the pixels of its own bounding box, against its own edges.
    """
    whole = F.transform(
        "vertices", lambda p: F.struct(F.bround(p["x"]).cast("int").alias("x"), F.bround(p["y"]).cast("int").alias("y"))
    )
    ids = _identity(shapes)
    rows = shapes.select(*ids, whole.alias("v"))
    after = F.concat(F.slice("v", 2, F.size("v")), F.slice("v", 1, 1))
    edges = F.zip_with("v", after, lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def span(axis: str, size: int) -> Column:
        values = F.transform("v", lambda p: p[axis])
        low = F.greatest(F.array_min(values), F.lit(0))
        high = F.least(F.array_max(values), F.lit(size - 1))
        return F.when(low <= high, F.sequence(low, high))

    box = rows.select(*ids, edges.alias("edges"), F.explode(span("x", nx)).alias("x"), span("y", ny).alias("ys"))
    box = box.select(*ids, "edges", "x", F.explode("ys").alias("y"))
    x, y = F.col("x"), F.col("y")

    def crosses(e: Column) -> Column:
        px, py, qx, qy = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        at = (qx - px) * (y - py) / F.nullif(qy - py, F.lit(0)).cast("double") + px
        return ((py > y) != (qy > y)) & (x < at)

    def on_edge(e: Column) -> Column:
        px, py, qx, qy = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        straight = (qx - px) * (y - py) == (qy - py) * (x - px)
        return straight & x.between(F.least(px, qx), F.greatest(px, qx)) & y.between(F.least(py, qy), F.greatest(py, qy))

    odd = F.size(F.filter("edges", lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return box.filter(odd | F.exists("edges", on_edge)).select(*ids, "x", "y")


def square_pixels(shapes: DataFrame, nx: int, ny: int) -> DataFrame:
    """``shapes(roi, cx, cy, half)``: centre +- half width, both ends, then y flipped."""

    def span(c: str, size: int) -> Column:
        low = F.greatest(F.col(c) - F.col("half"), F.lit(0))
        high = F.least(F.col(c) + F.col("half"), F.lit(size - 1))
        return F.when(low <= high, F.sequence(low, high))

    ids = _identity(shapes)
    box = shapes.select(*ids, F.explode(span("cx", nx)).alias("x"), span("cy", ny).alias("ys"))
    return box.select(*ids, "x", F.explode("ys").alias("y")).withColumn("y", ny - 1 - F.col("y"))


def footprint_weights(footprints: DataFrame, threshold: float = 75.0) -> DataFrame:
    """I4: ``footprints(roi, x, y, f)``: w = f / sum(f), member when w reaches the
    percentile (linear interpolation). A group holds one frame of one region."""
    f = F.nanvl("f", F.lit(None).cast("double"))
    ids = _identity(footprints)
    totals = footprints.groupBy(*ids).agg(
        F.sum(f).alias("__sum"), F.percentile(f, F.lit(threshold / 100)).alias("__p")
    )
    joined = join_per_key(footprints, totals, ids, spread=["x", "y"])
    return joined.select(
        *ids, "x", "y", (f / F.col("__sum")).alias("w"), (f >= F.col("__p")).alias("member")
    )


def labelled_pixels(image: DataFrame) -> DataFrame:
    """Members of a label image are its positive pixels."""
    return image.filter(F.col("v") > 0).select(*_identity(image), "x", "y")


def whole_frame_roi(pixels: DataFrame, label: str = "uniform") -> DataFrame:
    """One region with every pixel of every recording."""
    return pixels.select("measu", F.lit(label).alias("roi"), "x", "y")


def _roi_keys(members: DataFrame) -> list[str]:
    return _identity(members)


def weighted(members: DataFrame) -> DataFrame:
    """Equal weights that sum to 1 per region."""
    keys = _roi_keys(members)
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return join_per_key(members, sizes, keys, spread=["x", "y"]).withColumn("w", 1 / F.col("__n")).drop("__n")


def weighted_within(weights: DataFrame, area: DataFrame) -> DataFrame:
    """I8: weights inside the area, made to sum to 1 again."""
    keys = _roi_keys(weights)
    on = [c for c in ("measu", "x", "y") if c in weights.columns and c in area.columns]
    inside = weights.join(area.select(*on).distinct(), on, "left_semi")
    sums = inside.groupBy(*keys).agg(F.sum("w").alias("__s"))
    return join_per_key(inside, sums, keys, spread=["x", "y"]).withColumn("w", F.try_divide("w", "__s")).drop("__s")


def _neighbour_flags(members: DataFrame) -> DataFrame:
    """Members with the number of their four neighbours that are members too.

    One shuffle by region: a region's mask is at most one frame.
    """
    keys = _roi_keys(members)
    placed = members.repartition(*keys)

    def beside(axis: str) -> Column:
        across = "y" if axis == "x" else "x"
        line = Window.partitionBy(*keys, across).orderBy(axis)
        before = F.lag(axis).over(line) == F.col(axis) - 1
        after = F.lead(axis).over(line) == F.col(axis) + 1
        return F.coalesce(before, F.lit(False)).cast("int") + F.coalesce(after, F.lit(False)).cast("int")

    return placed.withColumn("__n", beside("x") + beside("y"))


def perimeter(members: DataFrame) -> DataFrame:
    """Members with a neighbour (or frame border) outside the region."""
    return _neighbour_flags(members).filter(F.col("__n") < 4).drop("__n")


def without_perimeter(members: DataFrame) -> DataFrame:
    """Members whose four neighbours are members."""
    return _neighbour_flags(members).filter(F.col("__n") == 4).drop("__n")


def footprint_perimeter(footprints: DataFrame, threshold: float = 75.0) -> DataFrame:
    """Boundary pixels of the thresholded footprint."""
    members = footprint_weights(footprints, threshold).filter("member")
    return perimeter(members.select(*_identity(members), "x", "y"))


def weighted_points(frames: DataFrame, *more: Column) -> DataFrame:
    """Sum of w * v per (recording, region, frame); partial sums travel, not pixels."""
    return frames.groupBy("measu", "roi", "t").agg(F.sum(F.col("w") * F.col("v")).alias("v"), *more)


def roi_trace_points(traces: DataFrame, weights: DataFrame) -> DataFrame:
    """I12, long form: sum of w * v per (recording, region, frame), combined map-side.

    A trace is unrolled where it lies, and only partial sums travel: a row per region and frame of each task. On tables
    bucketed by pixel (:mod:`lumentrace.sources.bucketed`) no trace is shuffled at all.
    """
    on = [c for c in ("measu", "x", "y") if c in weights.columns]
    joined = traces.join(weights.select(*on, "roi", "w"), on)
    return weighted_points(A.unrolled(joined.select("measu", "roi", "w", "trace"), "measu", "roi", "w"))


def roi_traces(traces: DataFrame, weights: DataFrame) -> DataFrame:
    """I12, array form: one trace per region; its length is the number of frames."""
    points = roi_trace_points(traces, weights)
    ordered = F.array_sort(F.collect_list(F.struct("t", "v")))["v"]
    return points.groupBy("measu", "roi").agg(ordered.alias("trace"))


def mask_mean(traces: DataFrame, mask: DataFrame) -> DataFrame:
    """Mean trace of a mask, long form."""
    on = [c for c in ("measu", "x", "y") if c in mask.columns]
    inside = traces.join(mask.select(*on).distinct(), on, "left_semi")
    frames = A.unrolled(inside, "measu")
    return frames.groupBy("measu", "t").agg(F.avg("v").alias("v"))


def descriptions(members: DataFrame, file: str = "", text: str = "") -> DataFrame:
    """Pixel count and text of every region."""
    keys = _roi_keys(members)
    counted = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pixels"))
    line = F.format_string(f"File: {file}; Pixels: %d; Label;%s;{text}", F.col("n_pixels"), F.col("roi"))
    return counted.withColumn("glo_info", line)


def last_definitions(shapes: DataFrame, label: str = "roi", line: str = "line_no") -> DataFrame:
    """Of equal labels of a file the last definition counts, at the place of the first."""
    keys = [label, *[c for c in _identity(shapes) if c != label]]
    others = [c for c in shapes.columns if c not in (*keys, line)]
    kept = shapes.groupBy(*keys).agg(
        F.min(line).alias(line), F.max_by(F.struct(*others), line).alias("__d")
    )
    return kept.select(*keys, line, *[F.col(f"__d.{c}").alias(c) for c in others])


def relabelled(rois: DataFrame, labels: DataFrame, order: str = "roi_idx") -> DataFrame:
    """I16: give regions the labels of a list, position by position, if counts agree;
    otherwise they are called "0", "1", ... ``labels(label_idx, label)``."""
    placed = indexed(rois, order, name="__pos")
    named = indexed(labels, "label_idx", name="__pos").select("__pos", "label")
    same = rois.agg(F.count(F.lit(1))).scalar() == labels.agg(F.count(F.lit(1))).scalar()
    label = F.when(same, F.col("label")).otherwise(F.col("__pos").cast("string"))
    return placed.join(named, "__pos", "left").withColumn("roi", label).drop("__pos", "label")


def label_inventory(image: DataFrame) -> DataFrame:
    """Pixels per label value; values with one pixel are dropped."""
    keys = [c for c in ("measu", "label") if c in image.columns]
    return image.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pixels")).filter(F.col("n_pixels") > 1)


def shifted_rois(members: DataFrame, measurements: DataFrame, nx: int, ny: int, shrink: int = 1) -> DataFrame:
    """Move regions by each recording's shift; masks roll around the frame.

    ``measurements(measu, shift_x, shift_y)``.
    """
    moves = measurements.select(
        "measu", (F.col("shift_x") / shrink).cast("int").alias("__dx"), (F.col("shift_y") / shrink).cast("int").alias("__dy")
    )
    joined = join_per_key(members, moves, ["measu"], spread=["roi", "x", "y"])
    return joined.withColumns(
        {"x": F.pmod(F.col("x") + F.col("__dx"), A.lit(nx)), "y": F.pmod(F.col("y") + F.col("__dy"), A.lit(ny))}
    ).drop("__dx", "__dy")


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that occur more than once."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


# Kind of region source by number (I20). An area image of kind 5 is read as footprints.
ROI_SOURCES = {0: "squares", 2: "label_image", 3: "text", 4: "footprint", 5: "footprint", 6: "uniform"}


def roi_pixels(params: Params, shapes: DataFrame, nx: int, ny: int) -> DataFrame:
    """Weighted region pixels of the source that ``roi_source`` selects."""
    kind = ROI_SOURCES.get(params.roi_source)
    if kind == "text":
        circles = circle_pixels(shapes.filter(F.col("kind") == "circle"), nx, ny)
        polygons = polygon_pixels(shapes.filter(F.col("kind") == "polygon"), nx, ny)
        return weighted(circles.unionByName(polygons))
    if kind == "squares":
        return weighted(square_pixels(shapes.withColumn("half", F.lit(params.roi_radius)), nx, ny))
    if kind == "footprint":
        weights = footprint_weights(shapes, params.roi_threshold)
        return weights.select(*_identity(weights), "x", "y", "w")
    if kind == "label_image":
        return weighted(labelled_pixels(shapes))
    if kind == "uniform":
        return weighted(whole_frame_roi(shapes))
    raise NotImplementedError(f"no region source {params.roi_source}")


def chosen_files(recordings: DataFrame, files: DataFrame, stems: Sequence[str], missing: str = "error") -> DataFrame:
    """The region file of every recording: (measu, file).

    ``files(file, folder, stem)``: ``folder`` is the place of the file's folder in the search order, ``stem`` its name without
    extension. ``stems`` are columns of ``recordings`` from the most special to the most general (recording, animal, ...). An
    earlier folder wins; in it, the most special stem. A recording without any file is an error (``missing="skip"`` leaves
    it out). One aggregate ranks all matches; nothing is joined level by level.
    """
    asked = recordings.select("measu", F.posexplode(F.array(*[F.col(c).cast("string") for c in stems])).alias("__level", "stem"))
    matches = join_per_key(asked, files.select("file", "folder", "stem"), ["stem"], "left", spread=["measu"])
    found = matches.groupBy("measu").agg(F.min(F.when(F.col("file").isNotNull(), F.struct("folder", "__level", "file"))).alias("best"))
    if missing == "skip":
        return found.filter("best IS NOT NULL").select("measu", "best.file")
    lost = F.raise_error(F.concat(F.lit("no region file for recording "), F.col("measu").cast("string"))).cast("string")
    return found.select("measu", F.when(F.isnull("best"), lost).otherwise(F.col("best.file")).alias("file"))


def chosen_shapes(recordings: DataFrame, files: DataFrame, shapes: DataFrame, stems: Sequence[str], missing: str = "error") -> DataFrame:
    """Shapes with a ``file`` column, for every recording those of its own file only (:func:`chosen_files`)."""
    chosen = chosen_files(recordings, files, stems, missing)
    return join_per_key(chosen, shapes, ["file"], spread=["measu"])


def area_of_rois(members: DataFrame, labels: list[str]) -> DataFrame:
    """Union of chosen regions as an area."""
    keys = [c for c in ("measu", "x", "y") if c in members.columns]
    return members.filter(F.col("roi").isin(labels)).select(*keys).distinct()
