"""The relevance-feedback round as a sequence of stages, and the variants of its maps, weights and scores.

Tables are those of `retrieval`: bmu (feature, object_idx, x, y), seen
(object_idx, value), maps (feature, x, y, value). A round is a plan of DataFrame
steps; only counts that choose between stages are computed on the way.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.vectors import kernel
from . import hierarchy, retrieval, sets
from .models import moments_matrix


def _sides() -> tuple[Column, Column]:
    return F.greatest("value", F.lit(0.0)), F.greatest(-F.col("value"), F.lit(0.0))


def seen_counts(seen: DataFrame, bmu: DataFrame) -> DataFrame:
    """feature, positives, negatives: how many seen objects lie on each map."""
    return bmu.join(seen, "object_idx").groupBy("feature").agg(F.count_if(F.col("value") > 0).alias("positives"), F.count_if(F.col("value") < 0).alias("negatives"))


def place_separate(seen: DataFrame, bmu: DataFrame, cap: bool = False, log: bool = False) -> DataFrame:
    """feature, x, y, pos, neg: shares of all positive and negative relevance on the map.

    cap: beyond the share of one object, further ones add half as much each. log: ln(1 + share * total) / total.
    """
    pos, neg = _sides()
    s = bmu.join(seen, "object_idx")
    total = s.groupBy("feature").agg(F.sum(pos).alias("P"), F.sum(neg).alias("N"))
    u = s.groupBy("feature", "x", "y").agg(F.sum(pos).alias("pos"), F.sum(neg).alias("neg")).join(F.broadcast(total), "feature")  # a row a feature

    def share(x: str, all_: str) -> Column:
        v, t = F.coalesce(F.try_divide(F.col(x), F.col(all_)), F.lit(0.0)), F.col(all_)
        if cap:
            v = F.when(v * t > 1, (2 - 2 * F.pow(F.lit(0.5), v * t)) / t).otherwise(v)
        return F.coalesce(F.try_divide(F.log1p(v * t), t), F.lit(0.0)) if log else v

    return u.select("feature", "x", "y", share("pos", "P").alias("pos"), share("neg", "N").alias("neg"))


def grid(features: DataFrame, width: int, height: int) -> DataFrame:
    """Every unit of the map of each feature."""
    return features.select("feature").distinct().select("feature", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")).select("feature", "x", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))


def smoothed_fraction(seen: DataFrame, bmu: DataFrame, width: int, height: int, prior: float = 0.1) -> DataFrame:
    """feature, x, y, value on every unit: (positives + prior) / (all + 2 prior)."""
    pos, neg = _sides()
    u = bmu.join(seen, "object_idx").groupBy("feature", "x", "y").agg(F.sum(pos).alias("p"), F.sum(neg).alias("n"))
    g = grid(bmu, width, height).join(u, ["feature", "x", "y"], "left").fillna(0, ["p", "n"])
    return g.select("feature", "x", "y", ((F.col("p") + prior) / (F.col("p") + F.col("n") + 2 * prior)).alias("value"))


def bernoulli(seen: DataFrame, bmu: DataFrame, width: int, height: int, strength: float = 2.0, rounds: int = 30) -> DataFrame:
    """feature, x, y, value: the most probable relevance of each unit under a Beta prior whose mean is that of the unit's four
    neighbours, iterated from a half everywhere. A map is units alone, so each is solved whole."""
    pos, neg = _sides()
    u = bmu.join(seen, "object_idx").groupBy("feature", "x", "y").agg(F.sum(pos).alias("p"), F.sum(neg).alias("n"))

    def solve(m):
        import pandas as pd

        p, n = np.zeros((2, height, width))
        p[m["y"], m["x"]], n[m["y"], m["x"]] = m["p"], m["n"]
        v = np.full((height, width), 0.5)
        for _ in range(rounds):
            e = np.pad(v, 1, mode="edge")
            v = (p + strength * (e[:-2, 1:-1] + e[2:, 1:-1] + e[1:-1, :-2] + e[1:-1, 2:]) / 4) / (p + n + strength)
        y, x = np.divmod(np.arange(v.size), width)
        return pd.DataFrame({"feature": m["feature"].iloc[0], "x": x, "y": y, "value": v.ravel()})

    return u.groupBy("feature").applyInPandas(solve, "feature string, x int, y int, value double")


def entropies(maps: DataFrame, units: int) -> DataFrame:
    """feature, h: the entropy of the positive part of each map, as a share of the greatest possible one."""
    p = maps.where("value > 0").groupBy("feature").agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.log("value")).alias("vlog"))
    return p.select("feature", ((F.log("total") - F.col("vlog") / F.col("total")) / F.log(F.lit(float(units)))).alias("h"))


def excess_entropy(maps: DataFrame, units: int, positives: DataFrame, single: float) -> DataFrame:
    """feature, h: (H - e0) / (min(positives * e0, Hmax) - e0), 0 where H is e0 or less; single: e0, the entropy of one hit."""
    most = F.log(F.lit(float(units)))
    h = entropies(maps, units).join(positives.select("feature", "positives"), "feature").withColumn("H", F.col("h") * most)
    top = F.least(F.col("positives") * single, most) - single
    return h.select("feature", F.when((F.col("H") <= single) | (top <= 0), 0.0).otherwise((F.col("H") - single) / top).alias("h"))


def map_weights(maps: DataFrame, units: int, how: str = "one", least: float = 1 / 3, exponent: float = 1.0, errors: DataFrame | None = None, scale: float = 1.0) -> DataFrame:
    """feature, weight. one; entropy: (1 + (least - 1) h)^exponent; leave_worst: 0 for the flattest map, ties to the
    last by name; distance: scale / (scale + mean error), with errors (feature, error)."""
    if how == "one":
        return maps.select("feature").distinct().withColumn("weight", F.lit(1.0))
    if how == "distance":
        return errors.groupBy("feature").agg((scale / (scale + F.avg("error"))).alias("weight"))
    h = entropies(maps, units)
    if how == "entropy":
        return h.select("feature", F.pow(1 + (least - 1) * F.col("h"), F.lit(exponent)).alias("weight"))
    worst = h.agg(F.max(F.struct("h", "feature")).alias("worst"))
    return h.join(F.broadcast(worst)).select("feature", F.when(F.col("feature") == F.col("worst.feature"), 0.0).otherwise(1.0).alias("weight"))  # one row


def self_influence(seen: DataFrame, bmu: DataFrame, width: int, height: int, name: str = "triangle", radius: int = 2) -> DataFrame:
    """feature, object_idx, own: what a seen object's own hit adds to the value of its unit."""
    w = kernel(name, radius, 1.0)
    weight = F.array(*[F.lit(w[abs(d)]) for d in range(-radius, radius + 1)])

    def mass(axis: str, size: int) -> Column:
        return F.aggregate(F.sequence(F.lit(-radius), F.lit(radius)), F.lit(0.0), lambda a, k: a + F.when((F.col(axis) + k).between(0, size - 1), F.get(weight, k + radius)).otherwise(0.0))

    pos, neg = _sides()
    s = bmu.join(seen, "object_idx")
    total = s.groupBy("feature").agg(F.sum(pos).alias("P"), F.sum(neg).alias("N"))
    s = s.join(F.broadcast(total), "feature")  # a row a feature
    hit = F.coalesce(F.try_divide(pos, F.col("P")), F.lit(0.0)) - F.coalesce(F.try_divide(neg, F.col("N")), F.lit(0.0))
    return s.select("feature", "object_idx", (hit * w[0] * w[0] / mass("x", width) / mass("y", height)).alias("own"))


def add_class_model(maps: DataFrame, models: DataFrame, weight: float) -> DataFrame:
    """maps with weight times the maps of a class model (feature, x, y, value) added."""
    return maps.unionByName(models.select("feature", "x", "y", (weight * F.col("value")).alias("value"))).groupBy("feature", "x", "y").agg(F.sum("value").alias("value"))


def bottom_scores(bmu: DataFrame, maps: DataFrame, weights: DataFrame | None = None, how: str = "add", bias: float = 0.5 * 7921 / 23409) -> DataFrame:
    """object_idx, value from the objects' units on all maps, with maps (feature, x, y, value, or pos and neg for ratio).

    add: the weighted sum; mul: the product of the positive ones, 0 if any isn't; posonly: the sum of the positive ones;
    ratio: the sum of (pos + bias) / (neg + bias).
    """
    s = bmu.join(maps, ["feature", "x", "y"], "left")
    s = s.join(weights, "feature") if weights is not None else s.withColumn("weight", F.lit(1.0))
    if how == "ratio":
        v = (F.coalesce("pos", F.lit(0.0)) + bias) / (F.coalesce("neg", F.lit(0.0)) + bias)
        return s.groupBy("object_idx").agg(F.sum(F.col("weight") * v).alias("value"))
    v = F.col("weight") * F.coalesce("value", F.lit(0.0))
    if how == "mul":
        return s.groupBy("object_idx").agg(F.when(F.min(v) > 0, F.exp(F.sum(F.log(F.when(v > 0, v))))).otherwise(0.0).alias("value"))
    return s.groupBy("object_idx").agg(F.sum(F.greatest(v, F.lit(0.0)) if how == "posonly" else v).alias("value"))


def quantiser_scores(seen: DataFrame, bmu: DataFrame) -> DataFrame:
    """object_idx, value: the seen relevance in the objects' own cells, over all features; objects that share none have no row."""
    cells = bmu.join(seen, "object_idx").groupBy("feature", "x", "y").agg(F.sum("value").alias("value"))
    return bmu.join(cells, ["feature", "x", "y"]).groupBy("object_idx").agg(F.sum("value").alias("value"))


def merge_duplicates(parts: DataFrame) -> DataFrame:
    """parts (object_idx, stage, value) to object_idx, value (their sum) and by_stage, what each stage gave."""
    one = parts.groupBy("object_idx", "stage").agg(F.sum("value").alias("value"))
    return one.groupBy("object_idx").agg(F.sum("value").alias("value"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "value")))).alias("by_stage"))


def match_aspects(relevance: DataFrame, weights: dict[str, float]) -> DataFrame:
    """relevance (object_idx, aspect, value) to object_idx, value: the weighted sum over the aspects that have a weight."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    return relevance.where(F.col("aspect").isin(list(weights))).groupBy("object_idx").agg(F.sum(F.col("value") * w[F.col("aspect")]).alias("value"))


def union_aspects(parts: list[DataFrame]) -> DataFrame:
    """aspect, object_idx, v of several tables of ternary sets; or of them where an object is in more than one."""
    u = sets.union_all(parts).groupBy("aspect", "object_idx").agg(F.max("v").alias("most"), F.min("v").alias("least"))
    return u.select("aspect", "object_idx", F.when(F.col("most") > 0, F.col("most")).otherwise(F.col("least")).alias("v"))


def best_level(levels: DataFrame) -> DataFrame:
    """levels (feature, level, units, x, y, value) to feature, level: the level of least relative entropy, ties to the first."""
    p = levels.where("value > 0").groupBy("feature", "level", "units").agg(F.sum("value").alias("t"), F.sum(F.col("value") * F.log("value")).alias("vlog"))
    h = F.round((F.log("t") - F.col("vlog") / F.col("t")) / F.log(F.col("units").cast("double")), 9)
    return p.groupBy("feature").agg(F.min_by("level", F.struct(h, "level")).alias("level"))


def restrict(candidates: DataFrame, within: list[DataFrame] | None = None, without: list[DataFrame] | None = None) -> DataFrame:
    """candidates (object_idx, ..) that are in every table of `within` and in none of `without`."""
    for d in within or []:
        candidates = candidates.join(d.select("object_idx"), "object_idx", "left_semi")
    for d in without or []:
        candidates = candidates.join(d.select("object_idx"), "object_idx", "left_anti")
    return candidates


def linear_bandit(features: DataFrame, seen: DataFrame, ridge: float = 1.0, width: float = 0.5) -> DataFrame:
    """object_idx, value of unseen objects: the ridge estimate of relevance and `width` times its uncertainty.

    Sums over seen rows make a small matrix; its inverse scores every object as column arithmetic.
    """
    xy = features.join(seen, "object_idx").select(F.concat(F.col("vec").cast("array<double>"), F.array(F.col("value").cast("double"))).alias("vec"))
    _, m = moments_matrix(xy)
    inverse = np.linalg.inv(m[1:-1, 1:-1] + ridge * np.eye(len(m) - 2))
    w = inverse @ m[1:-1, -1]
    root = np.linalg.cholesky(inverse).T  # |root x|^2 is the variance
    sent = features.sparkSession.sparkContext.broadcast((w, root))

    def run(batches):
        import pyarrow as pa

        w, root = sent.value
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float)
            if len(x):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x @ w + width * np.sqrt(((x @ root.T) ** 2).sum(1)))], ["object_idx", "value"])

    rest = features.join(seen.select("object_idx"), "object_idx", "left_anti").select("object_idx", F.col("vec").cast("array<double>").alias("vec"))
    return rest.mapInArrow(run, "object_idx long, value double")


class Round:
    """One round over maps: named stages, each a method that takes the state and returns the next stage's name.

    Options: edges and relop (how relevance flows before the maps and after, as in hierarchy.expand), kernel, weights
    (as in map_weights), permap (units a map keeps), units (units kept in all), objects (objects scored on), types (a
    table of target objects), within and without (restrictions), initial (objects shown before anything is relevant).
    """

    def __init__(self, bmu: DataFrame, seen: DataFrame, width: int, height: int, n: int, **options):
        self.bmu, self.seen, self.size, self.n = bmu, seen, (width, height), n
        known = {"edges": None, "relop": "none", "converge": "none", "kernel": "triangle", "radius": 2, "weights": "one", "permap": 500, "units": None, "objects": None, "types": None, "within": [], "without": [], "initial": None}
        if set(options) - set(known):
            raise ValueError(f"unknown options {sorted(set(options) - set(known))}")
        self.__dict__ |= known | options
        self.path: list[str] = []
        self.result: DataFrame | None = None

    def run(self) -> DataFrame:
        stage = "enter"
        while stage != "ready":
            self.path.append(stage)
            stage = getattr(self, f"stage_{stage}")()
        return self.result

    def stage_enter(self) -> str:
        r = self.seen.agg(F.count_if(F.col("value") > 0).alias("p"), F.count("*").alias("n")).first()
        self.positives, self.marked = r["p"], r["n"]
        return "check_counts"

    def stage_check_counts(self) -> str:
        return "initial_set" if not self.marked and self.initial is not None else "has_positives" if self.positives else "no_positives"

    def stage_initial_set(self) -> str:
        self.scored = self.initial.select("object_idx", F.lit(0.0).alias("value"))
        return "restrict"

    def stage_no_positives(self) -> str:
        """Nothing to look for: unseen objects in a seeded order."""
        self.scored = sets.seeded(restrict(self.bmu.select("object_idx").distinct(), self._targets(), [self.seen, *self.without]), self.n).withColumn("value", F.lit(0.0))
        return "restrict"

    def stage_has_positives(self) -> str:
        return "expand"

    def stage_expand(self) -> str:
        self.relevant = self.seen if self.edges is None else hierarchy.expand(self.seen, self.edges, self.relop)
        return "run_per_map"

    def stage_run_per_map(self) -> str:
        self.maps = retrieval.convolve(retrieval.place(self.relevant, self.bmu), *self.size, self.kernel, self.radius)
        return "set_map_weights"

    def stage_set_map_weights(self) -> str:
        self.map_weight = map_weights(self.maps, self.size[0] * self.size[1], self.weights)
        return "combine_unit_lists"

    def stage_combine_unit_lists(self) -> str:
        weighted = self.maps.join(self.map_weight, "feature").withColumn("value", F.col("value") * F.col("weight")).drop("weight")
        best = retrieval.best_units(weighted, self.permap).drop("rank")
        self.best = best.orderBy(F.desc("value"), "feature", "x", "y").limit(self.units) if self.units else best
        return "extract_objects"

    def stage_extract_objects(self) -> str:
        self.scored = self.bmu.join(self.best, ["feature", "x", "y"]).groupBy("object_idx").agg(F.sum("value").alias("value"))
        return "select_objects"

    def stage_select_objects(self) -> str:
        if self.objects:
            self.scored = self.scored.orderBy(F.desc(F.round("value", 9)), "object_idx").limit(self.objects)
        return "converge"

    def stage_converge(self) -> str:
        if self.edges is not None and self.converge != "none":
            self.scored = hierarchy.expand(self.scored, self.edges, self.converge)
        return "restrict"

    def _targets(self) -> list[DataFrame]:
        return [*self.within, *([self.types] if self.types is not None else [])]

    def stage_restrict(self) -> str:
        self.scored = restrict(self.scored, self._targets(), [self.seen, *self.without])
        return "final_select"

    def stage_final_select(self) -> str:
        self.result = self.scored.orderBy(F.desc(F.round("value", 9)), "object_idx").limit(self.n)
        return "ready"


class QuantiserRound(Round):
    """Objects that share cells with seen ones; no smoothing."""

    def stage_run_per_map(self) -> str:
        self.scored = quantiser_scores(self.relevant, self.bmu)
        return "select_objects"


class RandomRound(Round):
    """Unseen objects in a seeded order, whatever was seen."""

    def stage_check_counts(self) -> str:
        return "no_positives"


ALGORITHMS: dict[str, type[Round]] = {"maps": Round, "quantiser": QuantiserRound, "random": RandomRound}


def create(spec: str, bmu: DataFrame, seen: DataFrame, width: int, height: int, n: int, **options) -> Round:
    """A round by name and arguments, such as `maps(weights=entropy,permap=20)`."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", spec)
    if not m or m[1] not in ALGORITHMS:
        raise ValueError(f"no algorithm is named {spec!r}")
    for part in filter(None, map(str.strip, (m[2] or "").split(","))):
        key, _, value = part.partition("=")
        options[key.strip()] = int(value) if value.strip().isdigit() else value.strip()
    return ALGORITHMS[m[1]](bmu, seen, width, height, n, **options)
