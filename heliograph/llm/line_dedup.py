"""Line dedup by distinct-site spread. DataFrame functions only.

A line is boilerplate if it stands on `min_sites` sites (sources) or more. One
aggregation of the raw lines gives each line hash a HyperLogLog sketch of its
sites and its first place; partial sketches merge by the aggregation, so a line
in a third of all documents costs one sketch a task. Only lines whose estimate
reaches the threshold, or lies near it, meet the lines again; of these, the ones
near it have their distinct sites counted exactly, and for the others the
estimate decides. A boilerplate line stays where it stands first (least doc_id,
then place) and goes everywhere else.

Defined results: null and empty texts stay as they are; lines without a word
are never removed; a null source is no site; rows that share a doc_id share
their occurrences, so a line kept in one is kept in all of them; null ids come
last and count as one id, so a line stays in them only if no other document has
it, at its least place; a table without rows gives none; a table without a
source has no sites, so nothing goes. Columns other than text (and n_chars,
where a text changes) come through untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import staged, table
from .text import columns, fresh, own, value

MIN_SITES = 3
#: Sketches of 2**LG_K registers have a relative error of 1.04 / sqrt(2**LG_K); BAND is over 6 times that.
LG_K = 10
BAND = 0.2


def _lines(docs: DataFrame) -> DataFrame:
    d = columns(docs, doc_id="long", source="string", text="string").where("text is not null")
    d = d.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    # Two hashes: 128 bits hold without collisions at any size met in practice.
    return d.select("doc_id", "source", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def spread(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2, first (no, doc_id, at), near: lines that are boilerplate, and lines near it that must be counted."""
    seen = _lines(docs).groupBy("h1", "h2").agg(F.hll_sketch_agg("source", F.lit(LG_K)).alias("sketch"), F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "at")).alias("first"))
    guess = seen.select("h1", "h2", "first", F.hll_sketch_estimate("sketch").alias("guess"))
    near = F.abs(F.col("guess") - min_sites) <= F.greatest(F.lit(min(1.0, min_sites - 0.5)), F.lit(BAND * min_sites))
    return guess.withColumn("near", near).where(F.col("near") | (F.col("guess") >= min_sites)).drop("guess")


def decisions(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, drop (places of lines to remove, in order): one row per document that loses a line."""
    marked = staged(spread(docs, min_sites), "lines-spread")
    hits = staged(_lines(docs).join(marked.hint("merge"), ["h1", "h2"]), "lines-hits")
    # Distinct (line, site) rows are made for the lines near the threshold alone, map-side first.
    exact = hits.where("near").groupBy("h1", "h2").agg(F.count_distinct("source").alias("n")).where(F.col("n") >= min_sites)
    elsewhere = ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")) | (F.col("at") != F.col("first.at"))
    hits = hits.where(elsewhere).select("doc_id", "at", "h1", "h2", "near")
    gone = hits.where("not near").select("doc_id", "at", "h1").unionByName(hits.where("near").join(exact.hint("merge"), ["h1", "h2"], "left_semi").select("doc_id", "at", "h1"))
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("at", "h1"))).alias("drop"))


def clean(docs: DataFrame, min_sites: int = MIN_SITES) -> tuple[DataFrame, str, str]:
    """docs with two columns more, and their names: the lines that go (null: none), and the text without them.

    Only places and hashes are shuffled by line; a text moves once, to meet its
    own places. That join is a merge at every size: the places grow with the
    documents, and their ids are distinct, so it has no skew.
    """
    key, drop, kept = fresh(docs, "_drop_id", "_drop", "_kept")
    d = staged(decisions(docs, min_sites), "lines-drop").select(F.col("doc_id").alias(key), F.col("drop").alias(drop))
    out = docs.join(d.hint("merge"), value(docs, "doc_id", "long").eqNullSafe(d[key]), "left")
    text = value(docs, "text", "string")
    goes = lambda x, i: F.array_contains(drop, F.struct(i.alias("at"), F.xxhash64(x).alias("h1")))
    rest = F.filter(F.split(text, "\n"), lambda x, i: ~goes(x, i))
    rest = F.when(F.col(drop).isNull() | text.isNull(), text).otherwise(F.array_join(rest, "\n"))
    return out.withColumn(kept, rest).select(*own(docs), drop, kept), drop, kept


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, drop_emptied: bool = False) -> DataFrame:
    """The rows and columns of docs; n_chars follows the text where it changes.

    drop_emptied: rows that lost lines and have no word left go. All they held
    stands elsewhere; rows without words from the start stay.
    """
    c, drop, kept = clean(docs, min_sites)
    if drop_emptied:
        c = c.where(F.col(drop).isNull() | F.col(kept).rlike(r"[^\x20\x09-\x0D]"))
    changed = {"text": F.col(kept), "n_chars": F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.length(kept))}
    return c.select(*[(changed[f.name.lower()].cast(f.dataType) if f.name.lower() in changed else F.col(f"`{f.name}`")).alias(f.name) for f in docs.schema.fields])


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    c, drop, kept = clean(docs)
    n = lambda t: F.coalesce(F.size(F.split(t, "\n")), F.lit(0))
    return c.select("doc_id", n(F.col("text")).cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_removed"), F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


SQL = rf"""
WITH p AS (
  SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, source, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM p),
g AS (
  SELECT line, min(doc_id * 1000000000 + pos) AS first_at FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  GROUP BY line HAVING count(DISTINCT source) >= {MIN_SITES}),
k AS (
  SELECT l.doc_id, count(g.line) AS gone,
         coalesce(string_agg(CASE WHEN g.line IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS kept
  FROM l LEFT JOIN g ON l.line = g.line AND l.doc_id * 1000000000 + l.pos <> g.first_at
  GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines,
       coalesce(k.gone, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
