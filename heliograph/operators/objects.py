"""Objects: lookup, insertion, frames, duplicates, keywords, and the sets that table-level functions name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def lookup(labels: DataFrame, objects: DataFrame, gentle: bool = True) -> DataFrame:
    """labels (label) with object_idx: -1 for one that is unknown if gentle, else such rows go."""
    j = labels.join(objects.select("label", "object_idx"), "label", "left" if gentle else "inner")
    return j.select("label", F.coalesce("object_idx", F.lit(-1)).alias("object_idx"))


def by_indices(wanted: DataFrame, features: DataFrame) -> DataFrame:
    """wanted (pos, object_idx) with vec, every request once and its place kept; those without a vector go."""
    return wanted.join(features.select("object_idx", "vec"), "object_idx").select("pos", "object_idx", "vec")


def augmented(base: DataFrame, variants: dict[str, DataFrame]) -> DataFrame:
    """object_idx, variant, vec: the base feature (variant '') and its augmentations."""
    out = base.select("object_idx", F.lit("").alias("variant"), "vec")
    for name, df in variants.items():
        out = out.unionByName(df.select("object_idx", F.lit(name).alias("variant"), "vec"))
    return out


def foreign(objects: DataFrame, maps: DataFrame, database: str) -> DataFrame:
    """objects (database, object_idx, unit) of any database with the units of another one's map (database, unit, value)."""
    return objects.join(maps.where(F.col("database") == database).drop("database"), "unit")


def masters(objects: DataFrame) -> DataFrame:
    """objects (object_idx, content) with master_idx: the least object of equal content; null content is its own."""
    # Hashes are joined, not contents; the group's least is an aggregate, so a third of all rows may be copies.
    h = objects.select("object_idx", F.when(F.col("content").isNotNull(), F.sha2("content", 256)).alias("h"))
    first = h.where("h is not null").groupBy("h").agg(F.min("object_idx").alias("master_idx"))
    return h.join(first, "h", "left").select("object_idx", F.coalesce("master_idx", "object_idx").alias("master_idx"))


def only(members: DataFrame, name: str) -> DataFrame:
    """members (class, object_idx): objects of the class that are in no other one."""
    g = members.groupBy("object_idx").agg(F.count_if(F.col("class") == name).alias("own"), F.count_if(F.col("class") != name).alias("other"))
    return g.where("own > 0 and other = 0").select("object_idx")


def switch(members: DataFrame, order: list[str]) -> DataFrame:
    """object_idx, class: the first of the classes, in order, that holds the object."""
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("class"))
    return members.where(place > 0).groupBy("object_idx").agg(F.min_by("class", place).alias("class"))


def n_keys(members: DataFrame, least: int) -> DataFrame:
    """object_idx, n: objects with at least so many different classes."""
    return members.groupBy("object_idx").agg(F.count_distinct("class").alias("n")).where(F.col("n") >= least)


def head(ranked: DataFrame, name: str, n: int) -> DataFrame:
    """ranked (class, object_idx, value): the n best of a class."""
    return ranked.where(F.col("class") == name).orderBy(F.desc("value"), "object_idx").limit(n).select("object_idx")


def frames(objects: DataFrame, step: int) -> DataFrame:
    """objects (object_idx, frames) to parent_idx, label, frame: a child for every step-th frame, its label the parent's and the number."""
    f = objects.where("frames > 0").select(F.col("object_idx").alias("parent_idx"), F.explode(F.sequence(F.lit(0), F.col("frames") - 1, F.lit(step))).alias("frame"))
    return f.select("parent_idx", F.concat(F.col("parent_idx").cast("string"), F.lit(":"), F.col("frame").cast("string")).alias("label"), "frame")


def middle_frame(children: DataFrame) -> DataFrame:
    """children (parent_idx, frame) to parent_idx, frame: the one in the middle, the earlier of two."""
    w = W.partitionBy("parent_idx")
    k = children.withColumns({"k": F.row_number().over(w.orderBy("frame")), "n": F.count("*").over(w)})
    return k.where(F.col("k") == F.floor((F.col("n") + 1) / 2)).select("parent_idx", "frame")


def per_second(children: DataFrame, rate: float) -> DataFrame:
    """children (parent_idx, frame, at): the first frame of every 1/rate seconds."""
    slot = F.floor(F.col("at") * rate)
    return children.groupBy("parent_idx", slot.alias("slot")).agg(F.min_by("frame", F.struct("at", "frame")).alias("frame")).select("parent_idx", "frame")


def renamed(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """concepts (name, ..) with the name that a mapping (name, target) gives; others keep theirs."""
    return concepts.join(names, "name", "left").withColumn("name", F.coalesce("target", "name")).drop("target")


def insert(known: DataFrame, new: DataFrame) -> DataFrame:
    """new (label, content) that known (object_idx, label, digest) lacks, by label and by content, with digest and the
    next free numbers. Numbers follow label order by counts of ranges, so no task sorts all labels."""
    top = known.agg(F.coalesce(F.max("object_idx"), F.lit(-1)).alias("top")).first()["top"]
    n = new.withColumn("digest", F.md5(F.col("content").cast("binary"))).join(known.select("label"), "label", "left_anti").join(known.select("digest"), "digest", "left_anti")
    n = n.groupBy("digest").agg(F.min_by(F.struct("label", "content"), "label").alias("x")).select("x.label", "x.content", "digest")
    bucket = F.substring("digest", 1, 2)
    sizes = n.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    ahead = sizes.select("b", F.coalesce(F.sum("n").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))  # 256 rows
    n = n.withColumn("b", bucket).withColumn("k", F.row_number().over(W.partitionBy("b").orderBy("digest"))).join(ahead, "b")
    return n.select((F.lit(top) + F.col("ahead") + F.col("k")).alias("object_idx"), "label", "digest")


def filled(objects: DataFrame, features: DataFrame, dim: int) -> DataFrame:
    """object_idx, vec of all objects, zeros where a feature is missing."""
    return objects.select("object_idx").join(features, "object_idx", "left").select("object_idx", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def updated(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """fields (object_idx, fields map) with those of changes put over them."""
    both = fields.select("object_idx", F.col("fields").alias("a")).join(changes.select("object_idx", F.col("fields").alias("b")), "object_idx", "full")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    return both.select("object_idx", F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b).alias("fields"))


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """text after all rules (pattern, replacement), in order."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def purity(assigned: DataFrame) -> DataFrame:
    """assigned (unit, label) to purity: the share of objects that have the most frequent label of their unit."""
    n = assigned.groupBy("unit", "label").agg(F.count("*").alias("n")).groupBy("unit").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return n.agg((F.sum("most") / F.sum("n")).alias("purity"))


def fragmentation(assigned: DataFrame) -> DataFrame:
    """label, units, largest: over how many units a class is spread, and the share that its largest unit holds."""
    n = assigned.groupBy("label", "unit").agg(F.count("*").alias("n"))
    return n.groupBy("label").agg(F.count("*").alias("units"), (F.max("n") / F.sum("n")).alias("largest"))


def pair_distance(features: DataFrame) -> DataFrame:
    """label, n, distance: the mean squared euclidean distance of all pairs of a class, from sums, so no pairs are made."""
    x = features.select("label", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x"))
    s = x.groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    d = 2 * (F.col("n") * F.col("q") - F.col("s") * F.col("s")) / (F.col("n") * (F.col("n") - 1))
    return s.groupBy("label").agg(F.max("n").alias("n"), F.sum(d).alias("distance"))


def scatter(features: DataFrame) -> DataFrame:
    """within, between: the mean squared distance to the class mean, and of class means to the mean of all."""
    x = features.select("label", F.posexplode(F.col("vec").cast("array<double>")).alias("i", "x"))
    s = x.groupBy("label", "i").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    c = s.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("m"))
    return c.agg((F.sum(F.col("q") - F.col("m")) / F.max("n")).alias("within"), (F.sum(F.col("m") - F.col("s") * F.col("s") / F.col("n")) / F.max("n")).alias("between"))


def merged_moments(parts: DataFrame) -> DataFrame:
    """parts (group, n, sum, squares, low, high), as any number of accumulators left them, to one row a group with mean and variance."""
    g = parts.groupBy("group").agg(*[F.sum(c).alias(c) for c in ("n", "sum", "squares")], F.min("low").alias("low"), F.max("high").alias("high"))
    var = F.when(F.col("n") > 1, F.greatest(F.lit(0.0), (F.col("squares") - F.col("sum") * F.col("sum") / F.col("n")) / (F.col("n") - 1))).otherwise(0.0)
    return g.select("group", "n", (F.col("sum") / F.col("n")).alias("mean"), var.alias("variance"), "low", "high")


def chi_square(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) to statistic and freedom of the test of independence; only cell counts meet."""
    n = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    a, b = n.groupBy("a").agg(F.sum("n").alias("na")), n.groupBy("b").agg(F.sum("n").alias("nb"))
    # sum n^2 / (na nb) over the cells that occur gives the statistic: N (sum - 1).
    j = n.join(a, "a").join(b, "b").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb"))).alias("r"), F.count_distinct("a").alias("ka"), F.count_distinct("b").alias("kb"))
    return j.select((F.col("N") * (F.col("r") - 1)).alias("statistic"), ((F.col("ka") - 1) * (F.col("kb") - 1)).alias("freedom"))


def correlation_test(pairs: DataFrame) -> DataFrame:
    """pairs (group, x, y) to n, r and Student's t of r."""
    g = pairs.groupBy("group").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    return g.select("group", "n", "r", (F.col("r") * F.sqrt((F.col("n") - 2) / (1 - F.col("r") * F.col("r")))).alias("t"))


def exponential_fit(values: DataFrame) -> DataFrame:
    """values (group, value) to the rate and log-likelihood of an exponential density, by maximum likelihood."""
    g = values.groupBy("group").agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    return g.select("group", (1 / F.col("m")).alias("rate"), (-F.col("n") * (F.log("m") + 1)).alias("log_likelihood"))


def gamma_fit(values: DataFrame) -> DataFrame:
    """values (group, value > 0) to shape and scale of a gamma density, by the closed form near maximum likelihood."""
    g = values.where("value > 0").groupBy("group").agg(F.avg("value").alias("m"), F.avg(F.log("value")).alias("l"))
    s = F.log("m") - F.col("l")
    shape = (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)
    return g.select("group", shape.alias("shape"), (F.col("m") / shape).alias("scale"))
