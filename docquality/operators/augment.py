"""Plans of augmentation: which scenario and seed each variant of a document gets, and what becomes of its boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a
from ..plans.rules import PALETTES, SCENARIOS
from .ranking import rank_within

# Transforms that move pixels, and so masks and boxes too.
GEOMETRIC = ("Affine", "Perspective", "ShiftScaleRotate", "Rotate", "SafeRotate", "HorizontalFlip", "VerticalFlip", "ReplayCompose", "Compose")


def plan(documents: DataFrame, class_col: str, id_col: str, variants: int = 1, seed: int = 42, originals: bool = True) -> DataFrame:
    """One row per output: the original (variant 0, base seed) and each variant with its scenario, in turn by class."""
    base = documents.select(F.col(class_col).alias("class_name"), F.col(id_col).cast("string").alias("document_id"))
    v = base.withColumn("variant", F.explode(F.sequence(F.lit(1), F.lit(variants)))) if variants else base.limit(0).withColumn("variant", F.lit(1))
    v = rank_within(v, ["class_name"], "document_id", "variant", name="place")
    names = F.array(*map(F.lit, SCENARIOS))
    v = v.withColumn("scenario", F.get(names, (F.col("place") % len(SCENARIOS)).cast("int"))).withColumn("seed", fnv1a(F.lit(seed), F.col("class_name"), F.col("document_id"), F.col("variant"))).withColumn("is_augmented", F.lit(True)).drop("place")
    if not originals:
        return v
    o = base.withColumns({"variant": F.lit(0), "scenario": F.lit("original"), "seed": F.lit(seed).cast("long"), "is_augmented": F.lit(False)})
    return o.unionByName(v)


def output_paths(planned: DataFrame, root: str) -> DataFrame:
    """Adds the paths of the image, mask, annotations and sidecar of each output."""
    suffix = F.when(F.col("is_augmented"), F.format_string("aug%02d", F.col("variant"))).otherwise("orig")
    stem = F.concat(F.lit(root.rstrip("/") + "/"), F.col("class_name"), F.lit("/"), F.col("document_id"), F.lit("__"), suffix)
    return planned.withColumns({"image_path": F.concat(stem, F.lit(".jpg")), "mask_path": F.concat(stem, F.lit("_mask.jpg")), "annotation_path": F.concat(stem, F.lit(".txt")), "sidecar_path": F.concat(stem, F.lit(".json"))})


def summary(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("class_name", "scenario", "is_augmented").agg(F.count(F.lit(1)).alias("count")).orderBy("class_name", "scenario", "is_augmented")


def augmented_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count_if("is_augmented").alias("augmented"), F.count_if(~F.col("is_augmented")).alias("original"))


def corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    point = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
    return F.array(point(x, y), point(x + w, y), point(x + w, y + h), point(x, y + h))


def to_edges(boxes: DataFrame) -> DataFrame:
    """x, y, width, height → x_min, y_min, x_max, y_max."""
    return boxes.withColumns({"x_min": F.col("x"), "y_min": F.col("y"), "x_max": F.col("x") + F.col("width"), "y_max": F.col("y") + F.col("height")}).drop("x", "y", "width", "height")


def from_edges(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"x": F.col("x_min"), "y": F.col("y_min"), "width": F.col("x_max") - F.col("x_min"), "height": F.col("y_max") - F.col("y_min")}).drop("x_min", "y_min", "x_max", "y_max")


def affine(boxes: DataFrame, angle: Column, scale: Column, dx: Column, dy: Column, width: Column, height: Column, least: float = 2.0, stay: bool = False) -> DataFrame:
    """Boxes (x, y, width, height) after a turn by angle degrees and a scale around the centre, and a shift; clipped to the
    image, without those that are then narrower or lower than `least`, or (stay) with nulls for them."""
    cx, cy = width / 2, height / 2
    c, s = F.cos(F.radians(angle)) * scale, F.sin(F.radians(angle)) * scale
    moved = F.transform(F.col("corners"), lambda p: F.struct((cx + (p["x"] - cx) * c - (p["y"] - cy) * s + dx).alias("x"), (cy + (p["x"] - cx) * s + (p["y"] - cy) * c + dy).alias("y")))
    return _fitted(boxes, moved, width, height, least, stay)


def _fitted(boxes: DataFrame, moved: Column, width: Column, height: Column, least: float, stay: bool = False) -> DataFrame:
    """Boxes around moved corners, clipped to the image, without those that are then narrower or lower than `least`, or
    (stay) with nulls for them.

    A filter would be pushed down to the source of the boxes, and repeat what computes them for every use of a side; the
    generator holds it above."""
    x = boxes.withColumn("corners", corners(*map(F.col, ("x", "y", "width", "height")))).withColumn("corners", moved)
    within = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    xs, ys = F.transform("corners", lambda p: p["x"]), F.transform("corners", lambda p: p["y"])
    x = x.withColumns({"x0": within(F.array_min(xs), width), "x1": within(F.array_max(xs), width), "y0": within(F.array_min(ys), height), "y1": within(F.array_max(ys), height)})
    large = lambda w, h: (w >= least) & (h >= least)
    sides = {"x": F.col("x0"), "y": F.col("y0"), "width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")}
    if stay:
        ok = large(sides["width"], sides["height"])
        return x.withColumns({k: F.when(ok, v) for k, v in sides.items()}).drop("corners", "x0", "x1", "y0", "y1")
    others = [c for c in boxes.columns if c not in sides]
    x = x.select(*others, F.inline(F.array(F.struct(*[v.alias(k) for k, v in sides.items()]))))
    return x.filter(large(F.col("width"), F.col("height"))).select(boxes.columns)


def perspective(boxes: DataFrame, matrix: list[Column], width: Column, height: Column, least: float = 2.0) -> DataFrame:
    """Boxes (x, y, width, height) under a perspective, of which matrix has the nine numbers by rows."""
    a, b, c, d, e, f, g, h, i = matrix
    at = lambda p, u, v, w: u * p["x"] + v * p["y"] + w
    moved = F.transform(F.col("corners"), lambda p: F.struct((at(p, a, b, c) / at(p, g, h, i)).alias("x"), (at(p, d, e, f) / at(p, g, h, i)).alias("y")))
    return _fitted(boxes, moved, width, height, least)


def background(seed: Column, palettes: tuple = PALETTES) -> Column:
    """Three numbers of a background colour, drawn by a hash of the seed: one of the palettes, then a value in each range."""
    ranges = F.array(*[F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo, hi in p]) for p in palettes])
    chosen = F.get(ranges, F.pmod(F.xxhash64(seed, F.lit(0)), F.lit(len(palettes))).cast("int"))
    return F.transform(chosen, lambda r, k: r["lo"] + F.pmod(F.xxhash64(seed, k + 1), (r["hi"] - r["lo"] + 1).cast("long")).cast("int"))


def order_points(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: by their sums and differences."""
    pick = lambda key, last: F.element_at(F.array_sort(F.transform(points, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))), -1 if last else 1)
    total, gap = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    bare = lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))
    return F.array(bare(pick(total, False)), bare(pick(gap, False)), bare(pick(total, True)), bare(pick(gap, True)))


def target_size(points: Column) -> Column:
    """(width, height) of the rectangle that ordered points are straightened to: their longest edges, at least 1."""
    edge = lambda i, j: F.sqrt(F.pow(points[i]["x"] - points[j]["x"], 2) + F.pow(points[i]["y"] - points[j]["y"], 2))
    side = lambda a, b: F.greatest(F.lit(1), F.greatest(a, b).cast("int"))
    return F.struct(side(edge(2, 3), edge(1, 0)).alias("width"), side(edge(1, 2), edge(0, 3)).alias("height"))


def detection_size(width: Column, height: Column, most: int = 1200) -> Column:
    """(width, height, scale) for the search for contours: the longer side is `most` at most."""
    side = F.greatest(width, height)
    scale = F.when(side > most, F.lit(float(most)) / side).otherwise(1.0)
    # divided last: side * (most / side) can fall short of most
    scaled = lambda v: F.when(side > most, v.cast("double") * most / side).otherwise(v).cast("int")
    return F.struct(scaled(width).alias("width"), scaled(height).alias("height"), scale.alias("scale"))


def ocr_size(width: Column, height: Column, least: int = 1200, most: int = 2200) -> Column:
    """(width, height, scale) for recognition: the width is brought between least and most."""
    target = F.least(F.greatest(width, F.lit(least)), F.lit(most))
    scale = target.cast("double") / width
    return F.struct(target.cast("int").alias("width"), F.when(target == width, height).otherwise((height * scale).cast("int")).alias("height"), scale.alias("scale"))


def zip_boxes(boxes: Column, labels: Column) -> Column:
    """Boxes with their labels, one to one; an error if there are more of one than of the other."""
    return F.when(F.size(boxes) == F.size(labels), F.arrays_zip(boxes.alias("box"), labels.alias("label"))).otherwise(F.raise_error(F.lit("boxes and labels differ in number")))


def applied_targets(name: Column) -> Column:
    all_of = F.array(*map(F.lit, ("image", "mask", "annotations")))
    return F.when(name.isin(*GEOMETRIC), all_of).otherwise(F.array(F.lit("image")))


def applied_transforms(nested: Column, depth: int = 3) -> Column:
    """The leaves that were applied in a tree of transforms (name, applied, params, children), `depth` levels deep."""
    leaf = lambda x: F.struct(x["name"].alias("name"), x["params"].alias("params"), applied_targets(x["name"]).alias("applied_to"))
    if depth == 0:
        return F.transform(F.filter(nested, lambda x: x["applied"]), leaf)
    own = lambda x: F.when(F.coalesce(F.size(x["children"]), F.lit(0)) > 0, applied_transforms(x["children"], depth - 1)).when(x["applied"], F.array(leaf(x))).otherwise(F.array().cast("array<struct<name:string,params:string,applied_to:array<string>>>"))
    return F.flatten(F.transform(nested, own))


#: Levels of a tree of transforms that are looked through.
DEPTH = 8


def applied_in_json(tree: Column) -> Column:
    """The leaves that were applied in a tree of transforms, as JSON text (name, applied, params, children): an array of
    (name, params, applied_to), in order. Levels beyond DEPTH are an error rather than left out."""
    node = "struct<name:string,applied:boolean,params:string,children:string>"
    leaf = lambda x: F.struct(x["name"].alias("name"), x["params"].alias("params"), applied_targets(x["name"]).alias("applied_to"))
    nodes = F.coalesce(F.from_json(tree, f"array<{node}>"), F.array().cast(f"array<{node}>"))
    inner = lambda x: F.coalesce(F.from_json(x["children"], f"array<{node}>"), F.array().cast(f"array<{node}>"))
    for _ in range(DEPTH):  # a node with children makes room for them
        nodes = F.flatten(F.transform(nodes, lambda x: F.when(F.size(inner(x)) > 0, inner(x)).otherwise(F.array(x))))
    deep = F.exists(nodes, lambda x: F.size(inner(x)) > 0)
    return F.when(deep, F.raise_error(F.lit(f"transforms are nested more than {DEPTH} levels deep"))).otherwise(F.transform(F.filter(nodes, lambda x: x["applied"]), leaf))
