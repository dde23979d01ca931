"""Queries of the relevance-feedback round, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _HITS_SQL, _chain, _features, _grid, _seen, query
from .functions import vectors as V
from .operators import feedback, hierarchy, retrieval, sets
from .runtime import table

_TOTALS = "t AS (SELECT feature, sum(greatest(v, 0)) AS P, sum(greatest(-v, 0)) AS N FROM m JOIN s USING (o) GROUP BY feature), u AS (SELECT feature, x, y, sum(greatest(v, 0)) AS pos, sum(greatest(-v, 0)) AS neg FROM m JOIN s USING (o) GROUP BY ALL)"


def _maps(spark, d):
    return retrieval.convolve(retrieval.place(_seen(spark, d), _grid(spark, d)), 8, 8)


@query(f"WITH {_HITS_SQL} SELECT feature, count(*) FILTER (v > 0) AS positives, count(*) FILTER (v < 0) AS negatives FROM m JOIN s USING (o) GROUP BY feature")
def seen_counts(spark, d):
    return feedback.seen_counts(_seen(spark, d), _grid(spark, d))


@query(f"WITH {_HITS_SQL}, {_TOTALS} SELECT feature, x, y, round(pos / P, 7) AS pos, round(neg / N, 7) AS neg FROM u JOIN t USING (feature)")
def maps_separate(spark, d):
    return feedback.place_separate(_seen(spark, d), _grid(spark, d)).withColumns({c: F.round(c, 7) for c in ("pos", "neg")})


@query(f"WITH {_HITS_SQL}, {_TOTALS} SELECT feature, x, y, round(CASE WHEN pos > 1 THEN (2 - 2 * pow(0.5, pos)) / P ELSE pos / P END, 7) AS pos, round(CASE WHEN neg > 1 THEN (2 - 2 * pow(0.5, neg)) / N ELSE neg / N END, 7) AS neg FROM u JOIN t USING (feature)")
def maps_capped(spark, d):
    return feedback.place_separate(_seen(spark, d), _grid(spark, d), cap=True).withColumns({c: F.round(c, 7) for c in ("pos", "neg")})


@query(f"WITH {_HITS_SQL}, {_TOTALS} SELECT feature, x, y, round(ln(1 + pos) / P, 7) AS pos, round(ln(1 + neg) / N, 7) AS neg FROM u JOIN t USING (feature)")
def maps_logarithmic(spark, d):
    return feedback.place_separate(_seen(spark, d), _grid(spark, d), log=True).withColumns({c: F.round(c, 7) for c in ("pos", "neg")})


@query(f"""WITH {_HITS_SQL}, {_TOTALS}, g AS (SELECT f.feature, a.x::INT AS x, b.y::INT AS y FROM (SELECT DISTINCT feature FROM m) f, range(8) a(x), range(8) b(y))
SELECT feature, x, y, round((coalesce(pos, 0) + 0.1) / (coalesce(pos, 0) + coalesce(neg, 0) + 0.2), 7) AS value FROM g LEFT JOIN u USING (feature, x, y)""")
def map_smoothed_fraction(spark, d):
    return feedback.smoothed_fraction(_seen(spark, d), _grid(spark, d), 8, 8).withColumn("value", F.round("value", 7))


@query()
def map_bernoulli(spark, d):
    return feedback.bernoulli(_seen(spark, d), _grid(spark, d), 8, 8).withColumn("value", F.round("value", 6))


_ENTROPY = "e AS (SELECT feature, -sum(p * ln(p)) AS H FROM (SELECT feature, value / sum(value) OVER (PARTITION BY feature) AS p FROM c WHERE value > 0) GROUP BY feature)"


@query(f"WITH {_HITS_SQL}, {_ENTROPY} SELECT feature, round(1 + (1/3::DOUBLE - 1) * H / ln(64), 7) AS weight FROM e")
def map_weights_entropy(spark, d):
    return feedback.map_weights(_maps(spark, d), 64, "entropy").withColumn("weight", F.round("weight", 7))


@query(f"WITH {_HITS_SQL}, {_ENTROPY} SELECT feature, CASE WHEN (H, feature) = (SELECT max((H, feature)) FROM e) THEN 0.0 ELSE 1.0 END::DOUBLE AS weight FROM e")
def map_weights_leave_worst(spark, d):
    return feedback.map_weights(_maps(spark, d), 64, "leave_worst")


@query("""WITH e AS (SELECT 'first' AS feature, abs(embedding[1]::DOUBLE) AS error FROM embeddings UNION ALL SELECT 'second', abs(embedding[3]::DOUBLE) FROM embeddings)
SELECT feature, round(0.1 / (0.1 + avg(error)), 7) AS weight FROM e GROUP BY feature""")
def map_weights_distance(spark, d):
    f = _features(spark, d)
    errors = f.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.abs(F.col("vec")[i].cast("double")).alias("error")) for n, i in (("first", 0), ("second", 2))])).alias("e")).select("e.*")
    return feedback.map_weights(f, 64, "distance", errors=errors, scale=0.1).withColumn("weight", F.round("weight", 7))


@query(f"""WITH {_HITS_SQL}, {_ENTROPY}, n AS (SELECT feature, count(*) FILTER (v > 0) AS n FROM m JOIN s USING (o) GROUP BY feature),
j AS (SELECT feature, H, least(n * 1.5, ln(64)) - 1.5 AS top FROM e JOIN n USING (feature))
SELECT feature, round(CASE WHEN H <= 1.5 OR top <= 0 THEN 0 ELSE (H - 1.5) / top END, 7) AS h FROM j""")
def map_entropy_excess(spark, d):
    seen, bmu = _seen(spark, d), _grid(spark, d)
    return feedback.excess_entropy(_maps(spark, d), 64, feedback.seen_counts(seen, bmu), 1.5).withColumn("h", F.round("h", 7))


@query(f"""WITH {_HITS_SQL}, {_TOTALS} SELECT feature, o AS object_idx, round((greatest(v, 0) / P - greatest(-v, 0) / N) / a.mass / b.mass, 8) AS own
FROM m JOIN s USING (o) JOIN t USING (feature) JOIN mass a ON a.t = m.x JOIN mass b ON b.t = m.y""")
def self_influence(spark, d):
    return feedback.self_influence(_seen(spark, d), _grid(spark, d), 8, 8).withColumn("own", F.round("own", 8))


@query(f"""WITH {_HITS_SQL}, q AS (SELECT feature, x, y, 0.25 * count(*) AS value FROM m JOIN embeddings ON vec_id = o WHERE label = 2 GROUP BY ALL)
SELECT feature, x::INT AS x, y::INT AS y, round(sum(value), 7) AS value FROM (SELECT feature, x, y, value FROM c UNION ALL SELECT feature, x, y, value FROM q) GROUP BY ALL""")
def class_model(spark, d):
    of = _grid(spark, d).join(_features(spark, d).where("label = 2").select("object_idx"), "object_idx")
    model = of.groupBy("feature", "x", "y").agg(F.count("*").cast("double").alias("value"))
    return feedback.add_class_model(_maps(spark, d), model, 0.25).select("feature", F.col("x").cast("int"), F.col("y").cast("int"), F.round("value", 7).alias("value"))


_BOTTOM = {
    "add": "sum(coalesce(value, 0))",
    "posonly": "sum(greatest(coalesce(value, 0), 0))",
    "mul": "CASE WHEN min(coalesce(value, 0)) > 0 THEN product(coalesce(value, 0)) ELSE 0 END",
}
for _h, _s in _BOTTOM.items():
    query(f"WITH {_HITS_SQL} SELECT m.o AS object_idx, round({_s}, 7) + 0.0 AS value FROM m LEFT JOIN c USING (feature, x, y) GROUP BY m.o", f"bottom_score_{_h}")(lambda spark, d, h=_h: feedback.bottom_scores(_grid(spark, d), _maps(spark, d), how=h).withColumn("value", F.round("value", 7) + 0.0))


@query(f"WITH {_HITS_SQL}, {_TOTALS} SELECT m.o AS object_idx, round(sum((coalesce(pos / P, 0) + 0.5 * 7921 / 23409) / (coalesce(neg / N, 0) + 0.5 * 7921 / 23409)), 6) AS value FROM m LEFT JOIN u USING (feature, x, y) LEFT JOIN t USING (feature) GROUP BY m.o")
def bottom_score_ratio(spark, d):
    maps = feedback.place_separate(_seen(spark, d), _grid(spark, d))
    return feedback.bottom_scores(_grid(spark, d), maps, how="ratio").withColumn("value", F.round("value", 6))


@query(f"WITH {_HITS_SQL}, z AS (SELECT feature, x, y, sum(v) AS value FROM m JOIN s USING (o) GROUP BY ALL) SELECT o AS object_idx, sum(value) AS value FROM m JOIN z USING (feature, x, y) GROUP BY o")
def quantiser_scores(spark, d):
    return feedback.quantiser_scores(_seen(spark, d), _grid(spark, d))


@query("""WITH p AS (SELECT user_id AS o, event_type AS stage, count(*)::DOUBLE AS v FROM events GROUP BY ALL)
SELECT o AS object_idx, sum(v) AS value, string_agg(stage || '=' || v::BIGINT::VARCHAR, ' ' ORDER BY stage) AS stages FROM p GROUP BY o""")
def duplicate_merge(spark, d):
    parts = table(spark, d, "events").select(F.col("user_id").alias("object_idx"), F.col("event_type").alias("stage"), F.lit(1.0).alias("value"))
    m = feedback.merge_duplicates(parts)
    stages = F.array_join(F.transform(F.map_entries("by_stage"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("long").cast("string"))), " ")
    return m.select("object_idx", "value", stages.alias("stages"))


@query("SELECT user_id AS object_idx, round(sum(value * CASE event_type WHEN 'view' THEN 0.5 ELSE 2.0 END), 4) AS value FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1")
def aspects_match(spark, d):
    r = table(spark, d, "events").select(F.col("user_id").alias("object_idx"), F.col("event_type").alias("aspect"), "value")
    return feedback.match_aspects(r, {"view": 0.5, "purchase": 2.0}).withColumn("value", F.round("value", 4))


@query("""WITH a AS (SELECT event_type AS aspect, user_id AS o, CASE WHEN max(value) > 150 THEN 1 ELSE -1 END AS v FROM events GROUP BY ALL UNION ALL SELECT event_type, user_id, CASE WHEN min(value) < 1 THEN 1 ELSE 0 END FROM events GROUP BY ALL)
SELECT aspect, o AS object_idx, CASE WHEN max(v) > 0 THEN max(v) ELSE min(v) END AS v FROM a GROUP BY ALL""")
def aspects_union(spark, d):
    g = table(spark, d, "events").groupBy(F.col("event_type").alias("aspect"), F.col("user_id").alias("object_idx"))
    return feedback.union_aspects([g.agg(F.when(F.max("value") > 150, 1).otherwise(-1).alias("v")), g.agg(F.when(F.min("value") < 1, 1).otherwise(0).alias("v"))])


@query("""WITH l AS (SELECT 'first' AS feature, n AS level, n * n AS units, greatest(0, least(n - 1, floor((embedding[1]::DOUBLE + 0.3) / 0.6 * n))) AS x, greatest(0, least(n - 1, floor((embedding[2]::DOUBLE + 0.3) / 0.6 * n))) AS y FROM embeddings, (VALUES (4), (8), (16)) v(n) WHERE label = 1),
c AS (SELECT feature, level, units, x, y, count(*) AS v FROM l GROUP BY ALL), p AS (SELECT *, v / sum(v) OVER (PARTITION BY level) AS p FROM c),
h AS (SELECT feature, level, round(-sum(p * ln(p)) / ln(max(units)), 9) AS h FROM p GROUP BY ALL) SELECT feature, min_by(level, (h, level)) AS level FROM h GROUP BY feature""")
def top_level_by_entropy(spark, d):
    f = _features(spark, d).where("label = 1").select("vec", F.explode(F.array(F.lit(4), F.lit(8), F.lit(16))).alias("level"))
    cell = lambda i: F.greatest(F.lit(0), F.least(F.col("level") - 1, F.floor((F.col("vec")[i].cast("double") + 0.3) / 0.6 * F.col("level"))))
    levels = f.select(F.lit("first").alias("feature"), "level", (F.col("level") * F.col("level")).alias("units"), cell(0).alias("x"), cell(1).alias("y")).groupBy("feature", "level", "units", "x", "y").agg(F.count("*").cast("double").alias("value"))
    return feedback.best_level(levels)


@query(f"WITH {_HITS_SQL} SELECT vec_id AS object_idx FROM embeddings WHERE label IN (1, 2) AND vec_id % 3 <> 0 AND vec_id NOT IN (SELECT o FROM s)")
def restricted_candidates(spark, d):
    f = _features(spark, d)
    within = [f.where("label in (1, 2)").select("object_idx"), f.where("object_idx % 3 <> 0").select("object_idx")]
    return feedback.restrict(f.select("object_idx"), within, [_seen(spark, d)])


_UP = "WITH RECURSIVE e AS (SELECT n_regionkey + 1000000000 AS p, n_nationkey + 900000000 AS c FROM nation UNION ALL SELECT c_nationkey + 900000000, c_custkey FROM customer), v AS (SELECT c_custkey AS o, c_acctbal AS v FROM customer)"


@query(f"""{_UP}, u AS (SELECT e.p AS o, sum(v) AS v FROM e JOIN v ON v.o = e.c GROUP BY 1), a AS (SELECT o, sum(v) AS v FROM (SELECT * FROM v UNION ALL SELECT * FROM u) GROUP BY o),
n AS (SELECT p, count(*) AS n FROM e GROUP BY p), w AS (SELECT e.c AS o, a.v / n.n AS v FROM e JOIN a ON a.o = e.p JOIN n ON n.p = e.p)
SELECT o AS object_idx, round(sum(v), 4) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM w) GROUP BY o""")
def relevance_updown(spark, d):
    scores = table(spark, d, "customer").select(F.col("c_custkey").alias("object_idx"), F.col("c_acctbal").alias("value"))
    return hierarchy.expand(scores, _chain(spark, d), "updown").withColumn("value", F.round("value", 4))


_WEIGHTED = "w AS (SELECT feature, 1 + (1/3::DOUBLE - 1) * H / ln(64) AS weight FROM e), b AS (SELECT feature, x, y, value * weight AS value, row_number() OVER (PARTITION BY feature ORDER BY value * weight DESC, x, y) AS r FROM c JOIN w USING (feature)), g AS (SELECT * FROM b WHERE r <= 20 ORDER BY value DESC, feature, x, y LIMIT 30)"


@query(f"""WITH {_HITS_SQL}, {_ENTROPY}, {_WEIGHTED}, j AS (SELECT m.o, round(sum(value), 9) AS v FROM m JOIN g USING (feature, x, y) GROUP BY m.o),
k2 AS (SELECT * FROM j ORDER BY v DESC, o LIMIT 200)
SELECT o AS object_idx, round(v, 7) AS value FROM k2 WHERE o NOT IN (SELECT o FROM s) AND o IN (SELECT vec_id FROM embeddings WHERE label <> 3) ORDER BY v DESC, o LIMIT 20""")
def feedback_stages(spark, d):
    types = _features(spark, d).where("label <> 3").select("object_idx")
    r = feedback.create("maps(weights=entropy,permap=20,units=30,objects=200)", _grid(spark, d), _seen(spark, d), 8, 8, 20, types=types)
    return r.run().withColumn("value", F.round("value", 7))


@query(f"""WITH {_HITS_SQL}, z AS (SELECT feature, x, y, sum(v) AS value FROM m JOIN s USING (o) GROUP BY ALL), j AS (SELECT m.o, sum(value) AS v FROM m JOIN z USING (feature, x, y) GROUP BY m.o)
SELECT o AS object_idx, v AS value FROM j WHERE o NOT IN (SELECT o FROM s) ORDER BY v DESC, o LIMIT 20""")
def feedback_quantiser(spark, d):
    return feedback.create("quantiser", _grid(spark, d), _seen(spark, d), 8, 8, 20).run()


@query(f"""WITH {_HITS_SQL} SELECT vec_id AS object_idx, 0.0::DOUBLE AS value FROM embeddings WHERE vec_id NOT IN (SELECT o FROM s) ORDER BY md5('42-' || vec_id::VARCHAR), vec_id LIMIT 20""")
def feedback_random(spark, d):
    return feedback.create("random", _grid(spark, d), _seen(spark, d), 8, 8, 20).run()


@query()
def linear_bandit(spark, d):
    f = _features(spark, d).select("object_idx", "vec")
    return feedback.linear_bandit(f, _seen(spark, d)).orderBy(F.desc(F.round("value", 6)), "object_idx").limit(20).withColumn("value", F.round("value", 5))


@query("""WITH r AS (SELECT user_id AS session, event_id, ntile(1) OVER () AS one, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, event_id % 50 AS o, value FROM events),
f AS (SELECT session, o, min(step) AS first_step, max_by(value, step) AS last_value, count(*) AS times FROM r GROUP BY ALL)
SELECT session, count(*) AS objects, sum(times)::BIGINT AS marks, count(*) FILTER (last_value > 50) AS relevant, max(first_step) AS newest FROM f GROUP BY session""")
def query_state(spark, d):
    """What each session has seen: objects, how often they were marked, which are relevant by their last mark, and when one was last new."""
    from pyspark.sql.window import Window as W

    e = table(spark, d, "events").select(F.col("user_id").alias("session"), (F.col("event_id") % 50).alias("object_idx"), "value", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("step"))
    f = e.groupBy("session", "object_idx").agg(F.min("step").alias("first_step"), F.max_by("value", "step").alias("last_value"), F.count("*").alias("times"))
    return f.groupBy("session").agg(F.count("*").alias("objects"), F.sum("times").alias("marks"), F.count_if(F.col("last_value") > 50).alias("relevant"), F.max("first_step").alias("newest"))


@query("""WITH g AS (SELECT user_id, event_id % 20 AS o, epoch(ts) AS t, lead(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT o AS object_idx, count(*) AS fixations, round(sum(least(coalesce(nxt - t, 0), 600)), 3) AS dwell, round(max(least(coalesce(nxt - t, 0), 600)), 3) AS longest FROM g GROUP BY o""")
def gaze_relevance(spark, d):
    """Dwell on each object by the time to a user's next event, ten minutes at most."""
    from .streaming import events as E

    e = table(spark, d, "events").select(F.col("user_id").alias("viewer"), (F.col("event_id") % 20).alias("object_idx"), "ts", "event_id")
    return E.dwell(e, 600).withColumns({c: F.round(c, 3) for c in ("dwell", "longest")})


@query("SELECT vec_id AS object_idx, list_transform(list_zip(embedding, embedding[2:] || [embedding[1]]), lambda t: CASE WHEN sign(t[1]) > 0 OR sign(t[2]) > 0 THEN greatest(sign(t[1]), sign(t[2])) ELSE least(sign(t[1]), sign(t[2])) END::INT) AS v FROM embeddings")
def vector_ternary(spark, d):
    """Ternary or of the signs of a vector and of the vector moved by one, component by component."""
    sign = lambda v: F.transform(v, lambda x: F.signum(x).cast("int"))
    moved = F.concat(F.slice("vec", 2, 63), F.slice("vec", 1, 1))
    return _features(spark, d).select("object_idx", F.zip_with(sign(F.col("vec")), sign(moved), sets.t_or).alias("v"))


@query("SELECT vec_id AS object_idx, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.1) * (x::DOUBLE - 0.1) * 2)), 6) AS weighted, round(list_sum(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN abs(x::DOUBLE) * ln(abs(x::DOUBLE) / 0.125) END)), 5) AS inverse FROM embeddings")
def distance_variants(spark, d):
    f, flat = _features(spark, d), F.array_repeat(F.lit(0.125), 64)
    weighted = V.weighted_euclidean("vec", F.array_repeat(F.lit(0.1), 64), F.array_repeat(F.lit(2.0), 64))
    inverse = V.divergence(F.transform(F.col("vec").cast("array<double>"), lambda x: F.abs(x)), flat)
    return f.select("object_idx", F.round(weighted, 6).alias("weighted"), F.round(inverse, 5).alias("inverse"))
