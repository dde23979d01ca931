"""Triples of subject, predicate and object: a reader of N-Triples lines, a writer, and joins of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"\S*)\s*\.\s*$'


def read(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of a text of N-Triples; other lines are comments. Brackets and quotes go, types and languages too."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^<(.*)>$", "$1"), r'^"(.*)"[^"]*$', "$1")
    t = spark.read.text(path).where(F.col("value").rlike(_LINE))
    return t.select(plain(F.regexp_extract("value", _LINE, 1)).alias("s"), F.regexp_extract("value", _LINE, 2).alias("p"), plain(F.regexp_extract("value", _LINE, 3)).alias("o"))


def lines(triples: DataFrame) -> DataFrame:
    """Triples as N-Triples lines; objects are literals."""
    quoted = F.regexp_replace(F.regexp_replace("o", r"\\", r"\\\\"), '"', r'\\"')
    return triples.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit('> "'), quoted, F.lit('" .')).alias("value"))


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """One column for each `?name` of the patterns: all ways to bind them, by equality joins on the names that patterns share."""
    found = None
    for pattern in patterns:
        t, names = triples, {}
        for column, part in zip("spo", pattern):
            if not part.startswith("?"):
                t = t.where(F.col(column) == part)
            elif part[1:] in names:
                t = t.where(F.col(column) == F.col(names[part[1:]]))
            else:
                names[part[1:]] = column
        t = t.select(*[F.col(c).alias(n) for n, c in names.items()])
        if found is None:
            found = t
            continue
        shared = [n for n in names if n in found.columns]
        if not shared:
            raise ValueError(f"{pattern} shares no name with the patterns before it")
        found = found.join(t, shared)
    return found.distinct()
