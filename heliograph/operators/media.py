"""Statistics of pixels, regions, samples and frames that are arrays in a column.

A picture is a row-major array of grey values (or of structs of colours) with a
known width; a sound is an array of samples. Whatever a row's own array gives
stays an expression; regions meet their neighbours by joins on pixel places.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..graph import components


def at(pixels: Column, width: int, x: Column, y: Column) -> Column:
    return F.get(pixels, (y * width + x).cast("int"))


def tiles(pixels: Column, width: int, height: int, across: int, down: int) -> Column:
    """The mean of each of across x down tiles, by rows."""
    w, h = width // across, height // down
    places = lambda t: F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: (F.floor((i % width) / w) == t % across) & (F.floor(F.floor(i / width) / h) == F.floor(t / across)))
    return F.transform(F.sequence(F.lit(0), F.lit(across * down - 1)), lambda t: F.aggregate(places(t), F.lit(0.0), lambda a, i: a + F.get(pixels, i)) / float(w * h))


def colour_moments(pixels: Column) -> Column:
    """mean, standard deviation and cube root of the third central moment, over n."""
    n = F.size(pixels).cast("double")
    mean = V.total(pixels) / n
    central = lambda k: V.total(F.transform(pixels, lambda x: F.pow(x - mean, F.lit(float(k))))) / n
    return F.struct(mean.alias("mean"), F.sqrt(central(2)).alias("deviation"), F.cbrt(central(3)).alias("skew"))


def edge_directions(pixels: Column, width: int, height: int) -> Column:
    """Which of the four differences to the right, below, and along either diagonal is strongest (1 to 4, ties to the
    first), for the pixels that have all these neighbours and any difference."""
    inner = [i for i in range(width * (height - 1)) if 0 < i % width < width - 1]
    diff = lambda i, k: F.round(F.abs(F.get(pixels, F.lit(i + k)) - F.get(pixels, F.lit(i))), 9)
    lead = F.array(*[F.array(*[diff(i, k) for k in (1, width, width + 1, width - 1)]) for i in inner])
    return F.filter(F.transform(lead, lambda v: F.when(F.array_max(v) > 0, F.array_position(v, F.array_max(v)))), lambda p: p.isNotNull())


def neighbour_levels(levels: Column, width: int, height: int, n: int) -> Column:
    """left * n + right for all horizontal neighbours of levels from 0 to n - 1."""
    return F.array(*[F.get(levels, F.lit(i)) * n + F.get(levels, F.lit(i + 1)) for i in range(width * height) if i % width < width - 1])


def cooccurrence(pairs: Column, n: int) -> Column:
    """Contrast and energy of neighbour_levels, which are best a column of their own."""
    size = F.size(pairs).cast("double")
    contrast = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + F.pow(F.floor(p / n) - p % n, F.lit(2.0))) / size
    share = lambda c: F.size(F.filter(pairs, lambda p: p == c)) / size
    return F.struct(contrast.alias("contrast"), V.total(F.transform(F.array_distinct(pairs), lambda c: share(c) * share(c))).alias("energy"))


def local_binary_patterns(pixels: Column, width: int, height: int) -> Column:
    """The codes of all inner pixels: one bit for each of eight neighbours that is as bright or brighter."""
    steps = [-width - 1, -width, -width + 1, 1, width + 1, width, width - 1, -1]
    inner = F.filter(F.sequence(F.lit(width), F.lit(width * (height - 1) - 1)), lambda i: (i % width > 0) & (i % width < width - 1))
    return F.transform(inner, lambda i: reduce(lambda a, b: a + b, [F.when(F.get(pixels, i + s) >= F.get(pixels, i), 1 << k).otherwise(0) for k, s in enumerate(steps)]))


def median_filter(pixels: Column, width: int, height: int) -> Column:
    """The median of each pixel's 3 x 3 neighbourhood; the border repeats."""
    clip = lambda c, n: F.least(F.lit(n - 1), F.greatest(F.lit(0), c))

    def middle(i: Column) -> Column:
        around = [at(pixels, width, clip(i % width + dx, width), clip(F.floor(i / width) + dy, height)) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        return F.get(F.array_sort(F.array(*around)), F.lit(4))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), middle)


def regions(pictures: DataFrame, width: int) -> DataFrame:
    """pictures (object_idx, labels: an array of class numbers by pixel) to object_idx, region, label, n, x0, y0, x1, y1:
    connected areas of one class, four neighbours each; region is the area's first pixel."""
    p = pictures.select("object_idx", F.posexplode("labels").alias("i", "label"))
    size = F.lit(1 << 24)  # pixels a picture, at most
    node = (F.col("object_idx") * size + F.col("i")).cast("long")
    p = p.select("object_idx", "i", "label", node.alias("node"))
    # A neighbour is a place in the same array, so links need no join.
    near = pictures.select("object_idx", "labels", F.posexplode("labels").alias("i", "label"))
    right = near.where((F.col("i") % width < width - 1) & (F.get("labels", F.col("i") + 1) == F.col("label"))).select(node.alias("u"), (node + 1).alias("v"))
    below = near.where(F.get("labels", F.col("i") + width) == F.col("label")).select(node.alias("u"), (node + width).alias("v"))
    root = components(right.unionByName(below))
    r = p.join(root, "node", "left").select("object_idx", "i", "label", (F.coalesce("root", "node") % size).cast("int").alias("region"))
    x, y = F.col("i") % width, F.floor(F.col("i") / width).cast("int")
    return r.groupBy("object_idx", "region", "label").agg(F.count("*").alias("n"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def without_small(found: DataFrame, least: int) -> DataFrame:
    return found.where(F.col("n") >= least)


def largest(found: DataFrame) -> DataFrame:
    """The largest region of each picture, ties to the first."""
    return found.groupBy("object_idx").agg(F.min_by(F.struct("region", "label", "n"), F.struct(-F.col("n"), "region")).alias("r")).select("object_idx", "r.*")


def average_energy(samples: Column, frame: int) -> Column:
    """The mean square of each frame of samples; a last short frame counts by its own length."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(samples), F.lit(1)), F.lit(frame))
    return F.transform(starts, lambda s: V.total(F.transform(F.slice(samples, s, frame), lambda x: x * x)) / F.size(F.slice(samples, s, frame)))


def spectrum(sounds: DataFrame, bands: int) -> DataFrame:
    """sounds (object_idx, samples) to object_idx, bands: the energy of the spectrum in equal bands, by one real Fourier transform a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column(1).to_pylist():
                e = np.abs(np.fft.rfft(s or [0.0])) ** 2
                out.append([float(x.sum()) for x in np.array_split(e, bands)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], ["object_idx", "bands"])

    return sounds.select("object_idx", F.col("samples").cast("array<double>").alias("samples")).mapInArrow(run, "object_idx long, bands array<double>")


def warped(pairs: DataFrame) -> DataFrame:
    """pairs (id, a, b: arrays of numbers) to id, distance: dynamic time warping with absolute differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                cost = np.abs(np.subtract.outer(np.array(a, float), np.array(b, float)))
                d = np.full((len(a) + 1, len(b) + 1), np.inf)
                d[0, 0] = 0
                for i in range(len(a)):
                    for j in range(len(b)):
                        d[i + 1, j + 1] = cost[i, j] + min(d[i, j], d[i, j + 1], d[i + 1, j])
                out.append(float(d[-1, -1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["id", "distance"])

    return pairs.select("id", "a", "b").mapInArrow(run, "id long, distance double")


def frame_treatment(frames: DataFrame, how: str) -> DataFrame:
    """frames (object_idx, frame, vec) to object_idx, vec: all frames concatenated, averaged, or only the first (`separate` keeps rows)."""
    if how == "separate":
        return frames
    if how == "average":
        p = frames.select("object_idx", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x")).groupBy("object_idx", "i").agg(F.avg("x").alias("x"))
        return p.groupBy("object_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    if how == "concatenate":
        return frames.groupBy("object_idx").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", "vec"))), lambda s: s["vec"])).alias("vec"))
    if how == "first":
        return frames.groupBy("object_idx").agg(F.min_by("vec", "frame").alias("vec"))
    raise ValueError(f"no treatment is named {how}")


#: Steps of a segmentation chain by name: each takes and gives (object_idx, labels).
STEPS = {
    "median": lambda df, width, height, _: df.withColumn("labels", median_filter(F.col("labels"), width, height)),
    "binarise": lambda df, width, height, arg: df.withColumn("labels", F.transform("labels", lambda x: F.when(x >= float(arg), 1).otherwise(0))),
    "crop": lambda df, width, height, arg: df.withColumn("labels", F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: F.when((i % width).between(int(arg), width - 1 - int(arg)) & F.floor(i / width).between(int(arg), height - 1 - int(arg)), F.get("labels", i)))),
}


def chain(pictures: DataFrame, spec: str, width: int, height: int) -> DataFrame:
    """Steps joined by `+`, such as `median+binarise(3)`, in order."""
    for part in spec.split("+"):
        name, _, arg = part.strip().rstrip(")").partition("(")
        if name not in STEPS:
            raise ValueError(f"no step is named {name}")
        pictures = STEPS[name](pictures, width, height, arg or "0")
    return pictures
