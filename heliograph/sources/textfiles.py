"""Text formats: labels, class files, contents, feature rows and flat request records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("value")).where("value <> ''")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """`label [type+type]`: label, types."""
    p = F.split("value", r"\s+")
    return _lines(spark, path).select(F.get(p, F.lit(0)).alias("label"), F.when(F.size(p) > 1, F.split(F.get(p, F.lit(1)), r"\+")).alias("types"))


def read_class(spark: SparkSession, path: str, objects: DataFrame | None = None) -> DataFrame:
    """A label a line, or `label .. label` for all of objects (label) in that range, ends included."""
    lines = _lines(spark, path)
    one = lines.where(~F.col("value").contains(" .. ")).select(F.split("value", r"\s+")[0].alias("label"))
    if objects is None:
        return one
    r = lines.where(F.col("value").contains(" .. ")).select(F.split("value", r"\s+\.\.\s+").alias("r")).select(F.col("r")[0].alias("lo"), F.col("r")[1].alias("hi"))
    ranged = objects.join(r, F.col("label").between(F.col("lo"), F.col("hi"))).select("label")
    return one.join(objects.select("label"), "label", "left_semi").unionByName(ranged).distinct()


def read_contents(spark: SparkSession, path: str) -> DataFrame:
    """`label class,class`: label, class."""
    p = F.split("value", r"\s+", 2)
    return _lines(spark, path).select(p[0].alias("label"), F.explode(F.split(F.get(p, F.lit(1)), r"\s*,\s*")).alias("class")).where("class <> ''")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Rows of numbers and a label; the first line of the file, one number, is their dimension."""
    p = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    rows = _lines(spark, path).select(p.alias("p")).where(F.size("p") > 1)
    return rows.select(F.element_at("p", -1).alias("label"), F.transform(F.slice("p", F.lit(1), F.size("p") - 1), lambda x: x.cast("float")).alias("vec"))


def write_class(members: DataFrame, path: str) -> None:
    """members (label, value), best first; a sorted set of files, as one file would be one task."""
    members.orderBy(F.desc("value"), "label").select("label").write.text(path)


def requests(rows: DataFrame, column: str = "body") -> DataFrame:
    """Flat JSON records as rows of key and value."""
    return rows.select(*[c for c in rows.columns if c != column], F.explode(F.from_json(column, "map<string,string>")).alias("key", "value"))


def wadm(hits: DataFrame) -> DataFrame:
    """Hits (label, text, score) as one web annotation in JSON a row."""
    body = F.struct(F.lit("TextualBody").alias("type"), F.col("text").alias("value"))
    return hits.select(F.to_json(F.struct(F.lit("Annotation").alias("type"), body.alias("body"), F.col("label").alias("target"), F.col("score"))).alias("json"))


def trec_run(ranked: DataFrame, run: str) -> DataFrame:
    """Ranked (topic, label, rank, score) as lines of a run file."""
    return ranked.select(F.concat_ws(" ", "topic", F.lit("Q0"), "label", F.col("rank").cast("string"), F.format_number("score", 6), F.lit(run)).alias("line"))
