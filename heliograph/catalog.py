"""All queries of the library, by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import text as T
from .functions import vectors as V
from .operators import boxes, evaluate, hierarchy, knn, models, ontology, quantize, retrieval, sets
from .operators.som import TreeSom
from .plans import expression
from .runtime import staged, table
from .streaming import events as E

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "knn_euclidean"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _features(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("object_idx"), F.col("embedding").alias("vec"), "label")


# -- nearest neighbours -------------------------------------------------------

_PAIR = {
    "euclidean": "list_sum(list_transform(list_zip(q.v, o.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))",
    "maximum": "list_max(list_transform(list_zip(q.v, o.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))",
    "manhattan": "list_sum(list_transform(list_zip(q.v, o.v), lambda t: abs(t[1] - t[2])))",
    "ell": "pow(list_sum(list_transform(list_zip(q.v, o.v), lambda t: pow(abs(t[1] - t[2]), 3))), 2.0 / 3)",
    "cosine": "1 - list_sum(list_transform(list_zip(q.v, o.v), lambda t: t[1] * t[2])) / sqrt(list_sum(list_transform(q.v, lambda x: x * x))) / sqrt(list_sum(list_transform(o.v, lambda x: x * x)))",
    "chisquare": "list_sum(list_transform(list_zip(q.v, o.v), lambda t: CASE WHEN t[1] + t[2] = 0 THEN 0 ELSE (t[1] - t[2]) * (t[1] - t[2]) / (t[1] + t[2]) END))",
    "histogram_intersection": "-list_sum(list_transform(list_zip(q.v, o.v), lambda t: least(t[1], t[2])))",
}


#: The queries of a search grow with the table. The ten first rows are what the first SQL of these queries names.
EVERY, FIRST = "% 100 = 0", "< 10"


def _knn_sql(metric: str, k: int, which: str = FIRST) -> str:
    v = "list_transform(embedding, lambda x: x::DOUBLE)"
    if metric in ("chisquare", "histogram_intersection"):
        v = "list_transform(embedding, lambda x: abs(x::DOUBLE))"
    return f"""
    WITH o AS (SELECT vec_id AS id, {v} AS v FROM embeddings),
    d AS (SELECT q.id AS query_idx, o.id AS object_idx, round(round({_PAIR[metric]}, 9), 6) AS distance,
                 row_number() OVER (PARTITION BY q.id ORDER BY round({_PAIR[metric]}, 9), o.id)::INT AS rank
          FROM o q JOIN o ON q.id <> o.id WHERE q.id {which})
    SELECT query_idx, object_idx, rank, distance FROM d WHERE rank <= {k}"""


def _knn(metric: str, k: int, which: str = FIRST):
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = _features(spark, d).select("object_idx", "vec")
        if metric in ("chisquare", "histogram_intersection"):
            f = f.withColumn("vec", F.transform(F.col("vec").cast("array<double>"), lambda x: F.abs(x)))
        return knn.knn_join(f, f.where(f"object_idx {which}"), k, metric).withColumn("distance", F.round("distance", 6))

    return run


for _m in _PAIR:
    query(_knn_sql(_m, 5), f"knn_{_m}")(_knn(_m, 5))
    query(_knn_sql(_m, 5, EVERY), f"knn_{_m}_every")(_knn(_m, 5, EVERY))


def _distance(name: str):
    def run(spark, d):
        f = _features(spark, d)
        return f.select("object_idx", F.round(V.distance(name, F.transform(F.col("vec"), lambda x: F.abs(x)), F.array_repeat(F.lit(0.125), 64)), 6).alias("distance"))

    return run


_KULLBACK = "pow(list_sum(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 0.125 * ln(0.125 / abs(x::DOUBLE)) ELSE 0 END)), 2)"
query(f"SELECT vec_id AS object_idx, round({_KULLBACK}, 6) AS distance FROM embeddings", "distance_kullback")(_distance("kullback"))
query("SELECT vec_id AS object_idx, round(list_sum(list_transform(embedding, lambda x: (abs(x::DOUBLE) - 0.125) * (abs(x::DOUBLE) - 0.125))), 6) AS distance FROM embeddings", "distance_euclidean")(_distance("euclidean"))

_VOTE_SQL, _VOTE_EVERY_SQL = (f"""
WITH n AS ({_knn_sql("euclidean", 7, which)}),
l AS (SELECT n.query_idx, n.rank, e.label FROM n JOIN embeddings e ON e.vec_id = n.object_idx),
u AS (SELECT query_idx, k, label, count(*) AS votes FROM l, range(1, 8) r(k) WHERE rank <= k GROUP BY ALL),
b AS (SELECT *, max(votes) OVER (PARTITION BY query_idx, k) AS best FROM u),
w AS (SELECT *, count(*) OVER (PARTITION BY query_idx, k) AS winners FROM b WHERE votes = best)
SELECT query_idx, {{label}} AS label, max_by(votes, k) AS votes FROM w WHERE winners = 1 GROUP BY query_idx""" for which in (FIRST, EVERY))


def _neighbours(spark, d, k=7, which=FIRST):
    f = _features(spark, d)
    return knn.knn_join(f, f.where(f"object_idx {which}"), k), f


@query(_VOTE_SQL.replace("{label}", "max_by(label, k)"))
def knn_vote(spark, d):
    n, f = _neighbours(spark, d)
    return knn.vote(n, f)


@query(_VOTE_SQL.replace("{label}", "CASE WHEN max_by(votes, k) >= 3 THEN max_by(label, k) END"))
def knn_reject(spark, d):
    n, f = _neighbours(spark, d)
    return knn.vote(n, f, reject=3)


@query(_VOTE_EVERY_SQL.replace("{label}", "max_by(label, k)"))
def knn_vote_every(spark, d):
    n, f = _neighbours(spark, d, which=EVERY)
    return knn.vote(n, f)


@query(_VOTE_EVERY_SQL.replace("{label}", "CASE WHEN max_by(votes, k) >= 3 THEN max_by(label, k) END"))
def knn_reject_every(spark, d):
    n, f = _neighbours(spark, d, which=EVERY)
    return knn.vote(n, f, reject=3)


# -- vectors ------------------------------------------------------------------

_MEANS_SQL = "SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i"


@query(f"SELECT label, i::INT AS i, round(m, 9) AS mean FROM ({_MEANS_SQL})")
def class_mean_vector(spark, d):
    return quantize.means(_features(spark, d), "label").select("label", F.posexplode("vec").alias("i", "mean")).withColumn("mean", F.round("mean", 9))


@query(f"""
WITH m AS (SELECT label, list(m ORDER BY i) AS v FROM ({_MEANS_SQL}) GROUP BY label),
d AS (SELECT e.vec_id, m.label AS unit, list_sum(list_transform(list_zip(e.embedding, m.v), lambda t: (t[1]::DOUBLE - t[2]) * (t[1]::DOUBLE - t[2]))) AS distance FROM embeddings e, m)
SELECT vec_id AS object_idx, min_by(unit, (round(distance, 9), unit))::BIGINT AS unit, round(round(min(distance), 9), 6) AS distance FROM d GROUP BY vec_id""")
def nearest_centroid(spark, d):
    f = _features(spark, d)
    c = quantize.means(f, "label").select(F.col("label").cast("long").alias("unit"), "vec")
    return knn.assign(f, c).withColumn("distance", F.round("distance", 6))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
m AS (SELECT vec_id, v, list_sum(v) / 64 AS mean FROM v),
p AS (SELECT *, list_sum(list_transform(v, lambda x: pow(x - mean, 2))) / 63 AS var FROM m)
SELECT vec_id AS object_idx, round(mean, 8) AS mean, round(var, 8) AS variance,
       round(list_sum(list_transform(v, lambda x: pow(x - mean, 3))) / 64 / pow(var, 1.5), 6) AS skewness,
       round(list_sum(list_transform(v, lambda x: pow(x - mean, 4))) / 64 / (var * var) - 3, 6) AS kurtosis FROM p""")
def vec_moments(spark, d):
    m = _features(spark, d).select("object_idx", V.moments("vec").alias("m"))
    return m.select("object_idx", F.round("m.mean", 8).alias("mean"), F.round("m.variance", 8).alias("variance"), F.round("m.skewness", 6).alias("skewness"), F.round("m.kurtosis", 6).alias("kurtosis"))


@query("""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS v FROM embeddings)
SELECT vec_id AS object_idx, round(list_sum(v), 6) AS l1, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l2,
       round(pow(list_sum(list_transform(v, lambda x: x * x * x)), 1.0 / 3), 6) AS l3 FROM v""")
def vec_norms(spark, d):
    return _features(spark, d).select("object_idx", *[F.round(V.norm("vec", p), 6).alias(f"l{p}") for p in (1, 2, 3)])


@query("""
WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
r AS (SELECT i, min(x) AS lo, max(x) AS hi FROM x GROUP BY i)
SELECT vec_id AS object_idx, round(sum(CASE WHEN hi > lo THEN (x - lo) / (hi - lo) ELSE 0.5 END), 6) AS scaled_sum FROM x JOIN r USING (i) GROUP BY vec_id""")
def minmax_scale(spark, d):
    f = _features(spark, d)
    r = f.agg(F.array(*[F.struct(F.min(F.col("vec")[i].cast("double")).alias("lo"), F.max(F.col("vec")[i].cast("double")).alias("hi")) for i in range(64)]).alias("r"))
    s = F.zip_with(F.col("vec").cast("array<double>"), "r", lambda x, r: F.when(r["hi"] > r["lo"], (x - r["lo"]) / (r["hi"] - r["lo"])).otherwise(0.5))
    return f.join(F.broadcast(r)).select("object_idx", F.round(V.total(s), 6).alias("scaled_sum"))  # r is one row


@query("SELECT vec_id AS object_idx, round(list_sum(list_transform(embedding, lambda x: sign(x) * sqrt(abs(x::DOUBLE)))), 6) AS total FROM embeddings")
def signed_sqrt(spark, d):
    return _features(spark, d).select("object_idx", F.round(V.total(V.signed_sqrt("vec")), 6).alias("total"))


@query("SELECT vec_id AS object_idx, list_transform(range(64), lambda i: embedding[((i % 8) * 8 + i // 8 + 1)::INT]::DOUBLE) AS vec FROM embeddings")
def feature_transpose(spark, d):
    return _features(spark, d).select("object_idx", V.transpose("vec", 8, 8).alias("vec"))


@query("""SELECT vec_id AS object_idx, len(embedding || [label::FLOAT])::INT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) + label, 6) AS total FROM embeddings""")
def feature_concat(spark, d):
    f = _features(spark, d)
    second = f.select("object_idx", F.array(F.col("label").cast("float")).alias("second"))
    c = f.select("object_idx", "vec").join(second, "object_idx").select("object_idx", F.concat("vec", "second").alias("v"))
    return c.select("object_idx", F.size("v").alias("n"), F.round(V.total(F.col("v").cast("array<double>")), 6).alias("total"))


@query("""SELECT d.doc_id, coalesce(max(quality), 0)::DOUBLE AS quality, coalesce(max(toxic), 0)::DOUBLE AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id""")
def detection_pivot(spark, d):
    lab = table(spark, d, "labels")
    long = lab.select("doc_id", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("detector", "score"))
    p = long.groupBy("doc_id").pivot("detector", ["quality", "toxic"]).agg(F.max("score"))
    return table(spark, d, "documents").select("doc_id").join(p, "doc_id", "left").select("doc_id", *[F.coalesce(F.col(c), F.lit(0)).cast("double").alias(c) for c in ("quality", "toxic")])


# -- ternary sets -------------------------------------------------------------

_SETS_SQL = """SELECT object_idx, coalesce(max(CASE WHEN name = 'purchase' THEN v END), 0) AS a, coalesce(max(CASE WHEN name = 'view' THEN v END), 0) AS b, coalesce(max(CASE WHEN name = 'signup' THEN v END), 0) AS c
FROM (SELECT user_id AS object_idx, event_type AS name, CASE WHEN avg(value) > 50 THEN 1 WHEN avg(value) < 47 THEN -1 ELSE 0 END AS v FROM events GROUP BY 1, 2) GROUP BY object_idx"""
_TERNARY = {
    "and": "least(a, b)",
    "or": "CASE WHEN a > 0 OR b > 0 THEN greatest(a, b) ELSE least(a, b) END",
    "ormax": "greatest(a, b)",
    "minus": "least(a, -b)",
    "xor": "CASE WHEN least(a, -b) > 0 OR least(b, -a) > 0 THEN greatest(least(a, -b), least(b, -a)) ELSE least(least(a, -b), least(b, -a)) END",
    "mask": "CASE WHEN b > 0 THEN a ELSE 0 END",
}


def _named(spark, d):
    m = sets.mean(F.col("value"))
    return table(spark, d, "events").groupBy(F.col("user_id").alias("object_idx"), F.col("event_type").alias("name")).agg(F.when(m > 50, 1).when(m < 47, -1).otherwise(0).alias("v"))


def _ternary(op):
    def run(spark, d):
        n = _named(spark, d)
        users = table(spark, d, "events").select(F.col("user_id").alias("object_idx")).distinct()
        c = sets.combine(n.where("name = 'purchase'"), n.where("name = 'view'"), op)
        return users.join(c, "object_idx", "left").select("object_idx", F.coalesce("v", F.lit(0)).alias("v"))

    return run


for _o, _s in _TERNARY.items():
    query(f"SELECT object_idx, ({_s})::INT AS v FROM ({_SETS_SQL})", f"ternary_{_o}")(_ternary(_o))


@query(f"""WITH s AS ({_SETS_SQL}), x AS (SELECT object_idx, least(a, b) AS p, c FROM s)
SELECT object_idx, least(p, -(CASE WHEN c = 0 THEN -1 ELSE c END))::INT AS v FROM x""")
def set_expression(spark, d):
    return expression.evaluate("(purchase & view) \\ !signup", _named(spark, d))


@query(f"SELECT object_idx, (CASE WHEN object_idx BETWEEN 3 AND 9 THEN (CASE WHEN a = -1 THEN 1 ELSE a END) ELSE least((CASE WHEN a = -1 THEN 1 ELSE a END), 0) END)::INT AS v FROM ({_SETS_SQL})")
def set_function(spark, d):
    users = table(spark, d, "events").select(F.col("user_id").alias("object_idx")).distinct()
    return expression.evaluate("%purchase & $indexrange(3, 9)", _named(spark, d), users)


@query(f"SELECT count(*) FILTER (a = -1) AS minus, count(*) FILTER (a = 0) AS zero, count(*) FILTER (a = 1) AS plus FROM ({_SETS_SQL})")
def set_counts(spark, d):
    return sets.counts(sets.wide(_named(spark, d), ["purchase", "view", "signup"]).select("object_idx", F.col("purchase").alias("v")))


@query("""SELECT doc_id AS object_idx FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5('42-' || doc_id::VARCHAR), doc_id LIMIT 50""")
def random_unseen(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("object_idx"))
    seen = table(spark, d, "labels").select(F.col("doc_id").alias("object_idx"))
    return sets.seeded(docs.join(seen, "object_idx", "left_anti"), 50)


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def head_n(spark, d):
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(20)


# -- hierarchy ----------------------------------------------------------------

_LINE = "(l_orderkey * 10 + l_linenumber)"


def _parts(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parent_idx"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("child_idx"), (F.col("l_quantity") - 20).alias("value"))
    one = li.groupBy("parent_idx", "child_idx").agg(F.sum("value").alias("value"))
    return one.select(F.col("child_idx").alias("object_idx"), "value"), one.select("parent_idx", "child_idx")


_PARTS_SQL = f"SELECT l_orderkey AS p, {_LINE} AS c, sum(l_quantity - 20) AS v FROM lineitem GROUP BY 1, 2"
for _h, _s in (("sum", "sum(v)"), ("max", "max(v)"), ("avg", "sum(v) / count(*)")):
    query(f"SELECT p AS object_idx, round({_s}, 6) AS value FROM ({_PARTS_SQL}) GROUP BY p", f"relevance_up_{_h}")(lambda spark, d, h=_h: hierarchy.relevance_up(*_parts(spark, d), h).withColumn("value", F.round("value", 6)))
for _h, _s in (("sqrsum", "sqrt(sum(greatest(v, 0) * greatest(v, 0)))"), ("sublinear", "sum(v / r)")):
    query(f"SELECT p AS object_idx, round({_s}, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY v DESC, c) AS r FROM ({_PARTS_SQL})) GROUP BY p", f"subscore_{_h}")(lambda spark, d, h=_h: hierarchy.combine_parts(*_parts(spark, d), h).withColumn("value", F.round("value", 6)))


@query("SELECT e.o_orderkey AS object_idx, round(c.c_acctbal / count(*) OVER (PARTITION BY e.o_custkey), 6) AS value FROM orders e JOIN customer c ON c.c_custkey = e.o_custkey")
def relevance_down(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("parent_idx"), F.col("o_orderkey").alias("child_idx"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("object_idx"), F.col("c_acctbal").alias("value"))
    return hierarchy.relevance_down(c, e).withColumn("value", F.round("value", 6))


def _chain(spark, d):
    """region <- nation <- customer, as one edge table."""
    n = table(spark, d, "nation").select((F.col("n_regionkey") + 1_000_000_000).cast("long").alias("parent_idx"), (F.col("n_nationkey") + 900_000_000).cast("long").alias("child_idx"))
    c = table(spark, d, "customer").select((F.col("c_nationkey") + 900_000_000).cast("long").alias("parent_idx"), F.col("c_custkey").alias("child_idx"))
    return n.unionByName(c)


@query("""WITH RECURSIVE e AS (SELECT n_regionkey + 1000000000 AS p, n_nationkey + 900000000 AS c FROM nation UNION ALL SELECT c_nationkey + 900000000, c_custkey FROM customer),
r AS (SELECT c, p FROM e UNION ALL SELECT r.c, e.p FROM r JOIN e ON e.c = r.p)
SELECT c AS child_idx, max(p) AS root_idx FROM r GROUP BY c""")
def root_of(spark, d):
    return hierarchy.roots(_chain(spark, d))


@query("SELECT o_orderkey AS child_idx, count(*) OVER (PARTITION BY o_custkey) - 1 AS n FROM orders")
def siblings(spark, d):
    return hierarchy.siblings(table(spark, d, "orders").select(F.col("o_custkey").alias("parent_idx"), F.col("o_orderkey").alias("child_idx")))


@query("SELECT o_custkey AS object_idx, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 12")
def nchildren(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("object_idx")).agg(F.count("*").alias("n")).where("n >= 12")


# -- measures -----------------------------------------------------------------


def _ranked(spark, d):
    """n_chars as a detector of quality, and its inverse as one of toxicity."""
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.explode(F.array(F.struct(F.lit("quality").alias("group"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("relevant")), F.struct(F.lit("toxic").alias("group"), (-F.col("n_chars").cast("double")).alias("score"), F.col("toxic").alias("relevant")))).alias("x"), F.col("doc_id").alias("object_idx")).select("x.group", "object_idx", "x.score", "x.relevant")


_RANKED_SQL = """r0 AS (SELECT 'quality' AS g, l.doc_id AS o, n_chars::DOUBLE AS s, quality AS r FROM labels l JOIN documents d ON l.doc_id = d.doc_id
UNION ALL SELECT 'toxic', l.doc_id, -n_chars::DOUBLE, toxic FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
r1 AS (SELECT *, row_number() OVER w AS k, sum(r) OVER w AS tp FROM r0 WINDOW w AS (PARTITION BY g ORDER BY s DESC, o ROWS UNBOUNDED PRECEDING)),
s0 AS (SELECT g, s, sum(r) AS p, sum(1 - r) AS n FROM r0 GROUP BY g, s),
s1 AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER e AS allp, sum(n) OVER e AS alln FROM s0 WINDOW w AS (PARTITION BY g ORDER BY s DESC ROWS UNBOUNDED PRECEDING), e AS (PARTITION BY g))"""


@query(f'WITH {_RANKED_SQL} SELECT g AS "group", round(sum(CASE WHEN r = 1 THEN tp / k ELSE 0 END) / sum(r), 9) AS average_precision FROM r1 GROUP BY g')
def average_precision(spark, d):
    return evaluate.average_precision(_ranked(spark, d)).withColumn("average_precision", F.round("average_precision", 9))


@query(f'WITH {_RANKED_SQL} SELECT g AS "group", sum(CASE WHEN k <= 100 THEN r END) / 100.0::DOUBLE AS precision, round(sum(CASE WHEN k <= 100 THEN r END) / sum(r), 9) AS recall FROM r1 GROUP BY g')
def precision_at_100(spark, d):
    return evaluate.precision_at(_ranked(spark, d), 100).withColumn("recall", F.round("recall", 9))


@query(f"""WITH {_RANKED_SQL} SELECT g AS "group", round(sum(n * (2 * tp - p) / 2.0) / max(allp) / max(alln), 9) AS auc,
round(min_by((1 - tp / allp + fp / alln) / 2, (abs(1 - tp / allp - fp / alln), -s)), 9) AS eer FROM s1 GROUP BY g""")
def roc_auc(spark, d):
    return evaluate.roc(_ranked(spark, d)).select("group", F.round("auc", 9).alias("auc"), F.round("eer", 9).alias("eer"))


@query(f"""WITH {_RANKED_SQL}, f AS (SELECT *, 2.0 * tp / (tp + fp + allp) AS f FROM s1) SELECT g AS "group", max_by(s, (f, s)) AS threshold, round(max(f), 9) AS f FROM f GROUP BY g""")
def best_threshold(spark, d):
    return evaluate.best_threshold(_ranked(spark, d)).withColumn("f", F.round("f", 9))


def _judged(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select(F.col("quality").alias("source"), F.when(F.col("n_chars") > 1000, 1).when(F.col("n_chars") < 400, 0).alias("destination"))


_JUDGED_SQL = "SELECT quality AS source, CASE WHEN n_chars > 1000 THEN 1 WHEN n_chars < 400 THEN 0 END AS destination FROM labels l JOIN documents d ON l.doc_id = d.doc_id"


@query(f"SELECT source, destination, count(*) AS n FROM ({_JUDGED_SQL}) GROUP BY 1, 2")
def confusion(spark, d):
    return evaluate.confusion(_judged(spark, d))


@query(f"SELECT count(*) FILTER (source = destination) AS correct, count(*) FILTER (destination IS NULL) AS rejected, count(*) FILTER (source <> destination) AS erroneous, round(count(*) FILTER (source = destination) / count(*), 9) AS accuracy FROM ({_JUDGED_SQL})")
def accuracy(spark, d):
    return evaluate.accuracy(_judged(spark, d)).withColumn("accuracy", F.round("accuracy", 9))


@query("SELECT event_id, event_type, round((rank() OVER (PARTITION BY event_type ORDER BY value) - 1) / count(*) OVER (PARTITION BY event_type), 9) AS cdf FROM events")
def cdf_value(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", F.col("event_type").alias("group"), "value")
    return evaluate.cdf(e).select("event_id", "event_type", F.round("cdf", 9).alias("cdf"))


# -- quantisers ---------------------------------------------------------------


@query("""WITH b AS (SELECT greatest(1, least(20, ceil(l_extendedprice / 5000.0)))::INT AS bin FROM lineitem)
SELECT bin, count(*) AS n, (sum(count(*)) OVER (ORDER BY bin))::BIGINT AS cumulative FROM b GROUP BY bin""")
def histogram_bins(spark, d):
    return quantize.histogram(table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("value")), 0, 100_000, 20)


@query("""WITH v AS (SELECT value, count(*) AS n FROM events GROUP BY value),
p AS (SELECT value, floor(coalesce(sum(n) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 8 / sum(n) OVER ())::INT AS part FROM v)
SELECT part, count(*) AS n, round(min(e.value), 6) AS low, round(max(e.value), 6) AS high FROM events e JOIN p ON p.value = e.value GROUP BY part""")
def equal_frequency(spark, d):
    q = quantize.equal_frequency(table(spark, d, "events").select("value"), 8)
    return q.groupBy("part").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"))


@query("""WITH n AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), p AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM n)
SELECT lang AS "group", round(-sum(p * ln(p)) / ln(2), 9) AS entropy FROM p GROUP BY lang""")
def symbol_entropy(spark, d):
    return quantize.entropy(table(spark, d, "documents").select(F.col("lang").alias("group"), F.col("source").alias("symbol"))).withColumn("entropy", F.round("entropy", 9))


@query("SELECT vec_id AS object_idx, [label::DOUBLE, label::DOUBLE + 0.5, (vec_id % 4)::DOUBLE, (vec_id % 4)::DOUBLE + 0.25] AS vec FROM embeddings")
def product_decode(spark, d):
    codes = _features(spark, d).select("object_idx", F.array(F.col("label").cast("int"), (F.col("object_idx") % 4).cast("int")).alias("codes"))
    book = spark.range(100).select(F.lit(0).alias("sub"), F.col("id").cast("int").alias("code"), F.array(F.col("id").cast("double"), F.col("id") + 0.5).alias("part")).unionByName(spark.range(4).select(F.lit(1).alias("sub"), F.col("id").cast("int").alias("code"), F.array(F.col("id").cast("double"), F.col("id") + 0.25).alias("part")))
    return quantize.decode_products(codes, book)


@query()
def kmeans(spark, d):
    f = _features(spark, d)
    return knn.assign(f, quantize.kmeans(f, 10)).groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("error"))


@query()
def som_units(spark, d):
    f = _features(spark, d)
    return TreeSom([(4, 4), (8, 8)]).fit(f).bmu(f).groupBy("level").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("units"), F.round(F.avg("distance"), 6).alias("error"))


# -- relevance feedback -------------------------------------------------------


def _grid(spark, d):
    """Each object on an 8 x 8 map for either of two features: the bins of two pairs of components."""
    cell = lambda i: F.greatest(F.lit(0), F.least(F.lit(7), F.floor((F.col("vec")[i].cast("double") + 0.3) / 0.075))).cast("int")
    f = _features(spark, d)
    return f.select("object_idx", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), cell(i).alias("x"), cell(i + 1).alias("y")) for n, i in (("first", 0), ("second", 2))])).alias("m")).select("m.feature", "object_idx", "m.x", "m.y")


def _seen(spark, d):
    return _features(spark, d).where("object_idx < 60").select("object_idx", F.when(F.col("label") == 1, 1.0).otherwise(-1.0).alias("value"))


_CELL = "greatest(0, least(7, floor((embedding[{0}]::DOUBLE + 0.3) / 0.075)))::INT"
_HITS_SQL = f"""m AS (SELECT 'first' AS feature, vec_id AS o, {_CELL.format(1)} AS x, {_CELL.format(2)} AS y FROM embeddings UNION ALL SELECT 'second', vec_id, {_CELL.format(3)}, {_CELL.format(4)} FROM embeddings),
s AS (SELECT vec_id AS o, CASE WHEN label = 1 THEN 1.0 ELSE -1.0 END::DOUBLE AS v FROM embeddings WHERE vec_id < 60),
h AS (SELECT feature, x, y, sum(CASE WHEN v > 0 THEN v / (SELECT sum(v) FROM s WHERE v > 0) ELSE v / (SELECT -sum(v) FROM s WHERE v < 0) END) AS hits FROM m JOIN s USING (o) GROUP BY ALL),
k AS (SELECT * FROM (VALUES (-2, 1/3::DOUBLE), (-1, 2/3::DOUBLE), (0, 1::DOUBLE), (1, 2/3::DOUBLE), (2, 1/3::DOUBLE)) k(d, w)),
mass AS (SELECT t, sum(w) AS mass FROM range(8) r(t), k WHERE t + d BETWEEN 0 AND 7 GROUP BY t),
cx AS (SELECT feature, x + d AS x, y, sum(hits * w) AS v FROM h, k WHERE x + d BETWEEN 0 AND 7 GROUP BY ALL),
nx AS (SELECT feature, x, y, v / mass AS v FROM cx JOIN mass ON t = x),
cy AS (SELECT feature, x, y + d AS y, sum(v * w) AS v FROM nx, k WHERE y + d BETWEEN 0 AND 7 GROUP BY ALL),
c AS (SELECT feature, x, y, v / mass AS value FROM cy JOIN mass ON t = y)"""


@query(f"WITH {_HITS_SQL} SELECT feature, x, y, round(hits, 9) AS hits FROM h")
def hits_placed(spark, d):
    return retrieval.place(_seen(spark, d), _grid(spark, d)).withColumn("hits", F.round("hits", 9))


@query(f"WITH {_HITS_SQL} SELECT feature, x::INT AS x, y::INT AS y, round(value, 9) AS value FROM c")
def hits_convolved(spark, d):
    return retrieval.convolve(retrieval.place(_seen(spark, d), _grid(spark, d)), 8, 8).select("feature", F.col("x").cast("int"), F.col("y").cast("int"), F.round("value", 9).alias("value"))


@query(f"""WITH {_HITS_SQL}, o AS (SELECT m.o, round(sum(value), 9) AS v FROM m JOIN c USING (feature, x, y) WHERE m.o >= 60 GROUP BY m.o)
SELECT o AS object_idx, round(v, 7) AS value FROM o ORDER BY v DESC, o LIMIT 20""")
def feedback_round(spark, d):
    bmu, seen = _grid(spark, d), _seen(spark, d)
    maps = retrieval.convolve(retrieval.place(seen, bmu), 8, 8)
    return retrieval.score_objects(maps, bmu, seen, 20).withColumn("value", F.round("value", 7))


# -- text ---------------------------------------------------------------------

_TERMS_SQL = "t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL)"


def _counts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    return docs.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


@query(f"""WITH {_TERMS_SQL}, f AS (SELECT term, count(*) AS df FROM c GROUP BY term)
SELECT doc_id, round(sum(ln(1 + n) * ln((SELECT count(*) FROM documents)::DOUBLE / df)), 5) AS weight FROM c JOIN f USING (term) GROUP BY doc_id""")
def tfidf(spark, d):
    c = staged(_counts(spark, d), "terms")
    df = c.groupBy("term").agg(F.count("*").alias("df"))
    n = table(spark, d, "documents").count()
    return c.join(df, "term").groupBy("doc_id").agg(F.round(F.sum(T.tf("l", F.col("n"), F.lit(1), F.lit(1)) * T.idf("l", F.lit(float(n)), F.col("df"))), 5).alias("weight"))


@query(f"WITH {_TERMS_SQL} SELECT term, sum(n)::BIGINT AS n, count(*) AS docs FROM c GROUP BY term ORDER BY n DESC, term LIMIT 100")
def top_terms(spark, d):
    return _counts(spark, d).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "term").limit(100)


@query("""WITH g AS (SELECT item_id, substr(text, i::INT, 3) AS gram FROM (SELECT item_id, ' ' || text || ' ' AS text FROM benchmark), range(1, 100000) r(i) WHERE i <= length(text) - 2)
SELECT item_id, ('0x' || substr(md5(gram), 1, 2))::INT AS bucket, count(*) AS n FROM g GROUP BY ALL""")
def ngram_hash(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.concat(F.lit(" "), "text", F.lit(" ")).alias("text"))
    g = b.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring(F.col("text"), i, F.lit(3)))).alias("gram"))
    return g.groupBy("item_id", T.char_ngram_bucket(F.col("gram")).alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
g AS (SELECT list_aggregate(w[i:i + 1], 'string_agg', ' ') AS gram FROM w, range(1, 10000) r(i) WHERE i < len(w))
SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) > 1""")
def ngram_counts(spark, d):
    w = table(spark, d, "benchmark").select(T.terms(F.col("text")).alias("w")).where(F.size("w") > 1)
    return w.select(F.explode(T.ngrams(F.col("w"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")


@query(f"""WITH {_TERMS_SQL} SELECT doc_id, count(*) AS terms, sum(n)::BIGINT AS hits FROM c WHERE term IN ('the', 'and', 'with', 'que') GROUP BY doc_id HAVING count(*) >= 2""")
def inverted_search(spark, d):
    c = _counts(spark, d).where(F.col("term").isin("the", "and", "with", "que"))
    return c.groupBy("doc_id").agg(F.count("*").alias("terms"), F.sum("n").alias("hits")).where("terms >= 2")


@query("""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
c AS (SELECT item_id, t, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT a.item_id AS candidate, sum(least(a.n, coalesce(b.n, 0))) AS clipped, sum(a.n) AS total FROM c a LEFT JOIN c b ON b.t = a.t AND b.item_id = (a.item_id + 1) % 40 WHERE a.item_id < 40 GROUP BY 1),
l AS (SELECT item_id, sum(n) AS len FROM c GROUP BY 1)
SELECT candidate, round(clipped / total * CASE WHEN total > r.len THEN 1 ELSE exp(1 - r.len / total) END, 9) AS bleu FROM p JOIN l r ON r.item_id = (candidate + 1) % 40""")
def bleu_unigrams(spark, d):
    b = table(spark, d, "benchmark").where("item_id < 40")
    c = b.select("item_id", F.explode(T.terms(F.col("text"))).alias("t")).groupBy("item_id", "t").agg(F.count("*").alias("n"))
    length = c.groupBy(F.col("item_id").alias("reference")).agg(F.sum("n").alias("len"))
    ref = c.select(F.col("item_id").alias("reference"), "t", F.col("n").alias("rn"))
    cand = c.withColumn("reference", (F.col("item_id") + 1) % 40)
    p = cand.join(ref, ["reference", "t"], "left").groupBy(F.col("item_id").alias("candidate"), "reference").agg(F.sum(F.least("n", F.coalesce("rn", F.lit(0)))).alias("clipped"), F.sum("n").alias("total")).join(length, "reference")
    brevity = F.when(F.col("total") > F.col("len"), 1.0).otherwise(F.exp(1 - F.col("len") / F.col("total")))
    return p.select("candidate", F.round(F.col("clipped") / F.col("total") * brevity, 9).alias("bleu"))


@query("""WITH i AS (SELECT item_id, text, lead(item_id, 1, (SELECT min(item_id) FROM benchmark)) OVER (ORDER BY item_id) AS reference FROM benchmark),
w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM benchmark),
c AS (SELECT item_id, t, count(*) AS n FROM w GROUP BY ALL), p AS (SELECT a.item_id AS candidate, i.reference, sum(least(a.n, coalesce(b.n, 0))) AS clipped, sum(a.n) AS total FROM c a JOIN i ON i.item_id = a.item_id LEFT JOIN c b ON b.t = a.t AND b.item_id = i.reference GROUP BY 1, 2),
l AS (SELECT item_id, sum(n) AS len FROM c GROUP BY 1)
SELECT candidate, round(clipped / total * CASE WHEN total > r.len THEN 1 ELSE exp(1 - r.len / total) END, 9) AS bleu FROM p JOIN l r ON r.item_id = p.reference""")
def bleu_unigrams_every(spark, d):
    """Every item against the next one by id, the last against the first."""
    b = table(spark, d, "benchmark")
    ids = b.select("item_id")
    least = ids.agg(F.min("item_id").alias("least"))
    # One row an item in one window: ids only, no text.
    after = ids.withColumn("next", F.lead("item_id").over(W.orderBy("item_id"))).crossJoin(F.broadcast(least)).select("item_id", F.coalesce("next", "least").alias("reference"))
    c = b.select("item_id", F.explode(T.terms(F.col("text"))).alias("t")).groupBy("item_id", "t").agg(F.count("*").alias("n"))
    length = c.groupBy(F.col("item_id").alias("reference")).agg(F.sum("n").alias("len"))
    ref = c.select(F.col("item_id").alias("reference"), "t", F.col("n").alias("rn"))
    p = c.join(after, "item_id").join(ref, ["reference", "t"], "left").groupBy(F.col("item_id").alias("candidate"), "reference").agg(F.sum(F.least("n", F.coalesce("rn", F.lit(0)))).alias("clipped"), F.sum("n").alias("total")).join(length, "reference")
    brevity = F.when(F.col("total") > F.col("len"), 1.0).otherwise(F.exp(1 - F.col("len") / F.col("total")))
    return p.select("candidate", F.round(F.col("clipped") / F.col("total") * brevity, 9).alias("bleu"))


@query("""WITH n AS (SELECT DISTINCT p_type FROM part), d AS (SELECT p.p_partkey, n.p_type, levenshtein(p.p_name, n.p_type) AS distance FROM part p, n)
SELECT p_partkey, min(distance)::INT AS distance, min_by(p_type, (distance, p_type)) AS closest FROM d GROUP BY p_partkey""")
def closest_word(spark, d):
    p = table(spark, d, "part")
    # Part types are a vocabulary of fixed size; it rides along as one array.
    words = p.agg(F.array_sort(F.collect_set("p_type")).alias("words"))
    best = F.array_min(F.transform("words", lambda w: F.struct(F.levenshtein("p_name", w).alias("distance"), w.alias("closest"))))
    return p.join(F.broadcast(words)).select("p_partkey", best.alias("b")).select("p_partkey", "b.distance", "b.closest")


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(regexp_extract_all(html, '<a '))::INT AS links FROM pages""")
def url_parts(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_count("html", F.lit("<a ")).alias("links"))


@query("SELECT event_type, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_props(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("""WITH s AS (SELECT event_id, hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS s FROM events)
SELECT event_id, format('{}:{:02d}:{:02d}.000', s // 3600, s // 60 % 60, s % 60) AS code, s::DOUBLE AS back FROM s""")
def timecodes(spark, d):
    e = table(spark, d, "events").select("event_id", (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("s"))
    e = e.select("event_id", T.timecode(F.col("s")).alias("code"))
    return e.withColumn("back", T.seconds(F.col("code")))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def date_buckets(spark, d):
    return table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query()
def stemmed_terms(spark, d):
    stem = F.pandas_udf(T.stem, "string")
    # Each distinct word is stemmed once.
    w = table(spark, d, "benchmark").select(F.explode(T.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return w.groupBy(stem("term").alias("stem")).agg(F.sum("n").alias("n"))


# -- events -------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windows_tumbling(spark, d):
    return E.tumbling(table(spark, d, "events"), "1 hour").withColumn("total", F.round("total", 4))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL (i) HOUR AS start, count(*) AS n FROM events, range(3) r(i) GROUP BY 1")
def windows_sliding(spark, d):
    return E.sliding(table(spark, d, "events"), "3 hours", "1 hour")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    return E.sessions(table(spark, d, "events"), "30 minutes")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS mean FROM events")
def rolling_mean(spark, d):
    return E.rolling_mean(table(spark, d, "events"), 5).select("event_id", F.round("mean", 6).alias("mean"))


@query("SELECT event_id, round(jump, 6) AS jump FROM (SELECT event_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS jump FROM events) WHERE jump >= 100")
def jump_boundaries(spark, d):
    return E.jumps(table(spark, d, "events"), 100).select("event_id", F.round("jump", 6).alias("jump"))


def _segments(spark, d, kind):
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), s.alias("begin"), (s + F.col("value") * 60 + 60).alias("end"))


_SEG = "SELECT user_id AS k, event_id AS id, epoch(ts) AS b, epoch(ts) + value * 60 + 60 AS e FROM events WHERE event_type = '{}'"


@query(f"""WITH s AS ({_SEG.format("view")}), r AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR b - reach > 600 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT k AS key, round(min(b), 3) AS "begin", round(max(e), 3) AS "end", count(*) AS n FROM i GROUP BY k, island""")
def merged_segments(spark, d):
    return E.merged(_segments(spark, d, "view"), 600).select("key", F.round("begin", 3).alias("begin"), F.round("end", 3).alias("end"), "n")


@query(f"""WITH a AS ({_SEG.format("view")}), b AS ({_SEG.format("click")})
SELECT a.k AS key, a.id AS a, b.id AS b, round(least(a.e, b.e) - greatest(a.b, b.b), 3) AS shared FROM a JOIN b ON a.k = b.k AND a.b < b.e AND b.b < a.e""")
def range_overlap(spark, d):
    return E.overlaps(_segments(spark, d, "view"), _segments(spark, d, "click"), 7200).withColumn("shared", F.round("shared", 3))


@query("""SELECT p.event_id AS id, round(v.value, 6) AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max_by(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(spark, d):
    e = table(spark, d, "events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max_by("value", "event_id").alias("value"))
    left = e.where("event_type = 'purchase'").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return E.as_of(left, views.select(F.col("user_id").alias("key"), "ts", "value")).select("id", F.round("value", 6).alias("value"))


# -- relational forms ---------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 9) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    li = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 9).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n.n_name, round(sum(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey GROUP BY 1""")
def revenue_by_nation(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, c.c_custkey == o.o_custkey).join(n, n.n_nationkey == c.c_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders)")
def semi_anti(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_anti").select("c_custkey").union(c.where("c_mktsegment = 'BUILDING'").join(o, "c_custkey", "left_semi").select("c_custkey")).distinct()


@query("(SELECT DISTINCT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'click') EXCEPT SELECT user_id FROM events WHERE event_type = 'error' AND value > 100")
def set_operations(spark, d):
    e = table(spark, d, "events")
    of = lambda c: e.where(c).select("user_id")
    return of("event_type = 'view'").intersect(of("event_type = 'click'")).subtract(of("event_type = 'error' and value > 100"))


# -- boxes, fusion, ontology, models ------------------------------------------


def _boxes(spark, d, kind):
    """Part orders as boxes: quantity by line number, a key for each order."""
    li = table(spark, d, "lineitem").where(F.col("l_returnflag") == kind)
    x, y = F.col("l_quantity"), F.col("l_linenumber").cast("double")
    return li.select(F.col("l_orderkey").alias("key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.struct(x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 2.5).alias("y1")).alias("box")).dropDuplicates(["id"])


def _boxes_sql(kind):
    return f"SELECT l_orderkey AS key, l_orderkey * 10 + l_linenumber AS id, l_quantity AS x0, l_linenumber::DOUBLE AS y0, l_quantity + 10 AS x1, l_linenumber + 2.5::DOUBLE AS y1 FROM lineitem WHERE l_returnflag = '{kind}' AND l_orderkey * 10 + l_linenumber IN (SELECT l_orderkey * 10 + l_linenumber FROM lineitem GROUP BY 1 HAVING count(*) = 1)"


@query(f"""WITH a AS ({_boxes_sql("A")}), b AS ({_boxes_sql("N")}),
j AS (SELECT a.key, a.id, b.id AS other, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared FROM a JOIN b USING (key))
SELECT key, id, max_by(other, (shared, -other)) AS other, round(max(shared), 6) AS shared, round(max(shared) / (50 - max(shared)), 6) AS ratio FROM j WHERE shared > 0 GROUP BY key, id""")
def box_best_match(spark, d):
    once = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).count().where("count = 1").select("id")
    of = lambda k: _boxes(spark, d, k).join(once, "id", "left_semi")
    return boxes.best_match(of("A"), of("N"), "key").withColumns({"shared": F.round("shared", 6), "ratio": F.round("ratio", 6)})


@query("""SELECT event_type, round(avg(least(a, b)), 6) AS lowest, round(avg(greatest(a, b)), 6) AS highest, round(avg((a + b) / 2), 6) AS mean,
round(avg(CASE WHEN a > 0 AND b > 0 THEN sqrt(a * b) ELSE 0 END), 6) AS geometric, round(avg(CASE WHEN a > 0 AND b > 0 THEN 2 / (1 / a + 1 / b) ELSE 0 END), 6) AS harmonic
FROM (SELECT event_type, value AS a, (event_id % 100)::DOUBLE AS b FROM events) GROUP BY event_type""")
def score_fusion(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("a"), (F.col("event_id") % 100).cast("double").alias("b"))
    names = {"lowest": "min", "highest": "max", "mean": "mean", "geometric": "geometric", "harmonic": "harmonic"}
    return e.groupBy("event_type").agg(*[F.round(F.avg(boxes.fuse([F.col("a"), F.col("b")], how)), 6).alias(n) for n, how in names.items()])


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smoothed FROM events")
def time_fusion(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("parent"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("score"))
    return boxes.smooth(e, 2).select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT n_name AS f, r_name AS s FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region UNION SELECT 'WORLD', 'ALL'),
c AS (SELECT f, s FROM e UNION SELECT c.f, e.s FROM c JOIN e ON c.s = e.f) SELECT f AS first, s AS second FROM c""")
def ontology_closure(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    e = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("first"), F.col("r_name").alias("second"))
    e = e.unionByName(r.select(F.col("r_name").alias("first"), F.lit("WORLD").alias("second"))).unionByName(spark.range(1).select(F.lit("WORLD").alias("first"), F.lit("ALL").alias("second")))
    return ontology.closure(e)


@query("SELECT l_returnflag AS \"group\", round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(corr(l_quantity, l_extendedprice), 8) AS correlation FROM lineitem GROUP BY 1")
def least_squares(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return models.line_fit(p).select("group", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("correlation", 8).alias("correlation"))


@query()
def principal_components(spark, d):
    f = _features(spark, d)
    mean, directions, _ = models.principal_components(f, 4)
    return models.project(f, mean, directions).select("object_idx", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


@query()
def local_subspaces(spark, d):
    n, f = _neighbours(spark, d, 30, EVERY)
    return models.local_subspace(n, f, f.where(f"object_idx {EVERY}"), f.select("object_idx", "label"), 4)


@query("""WITH b AS (SELECT quality AS r, (n_chars // 500)::BIGINT AS bin FROM labels l JOIN documents d ON l.doc_id = d.doc_id), c AS (SELECT bin, sum(r) AS p, sum(1 - r) AS n FROM b GROUP BY bin)
SELECT bin, round(sum(p) OVER w / sum(p + n) OVER w, 9) AS precision, round(sum(p) OVER w / sum(p) OVER (), 9) AS recall FROM c WINDOW w AS (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING)""")
def pdf_precision(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    c = j.groupBy(F.floor(F.col("n_chars") / 500).alias("bin")).agg(F.sum("quality").alias("p"), F.count("*").alias("all"))
    w = W.orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)  # one row per bin
    return c.select("bin", F.round(F.sum("p").over(w) / F.sum("all").over(w), 9).alias("precision"), F.round(F.sum("p").over(w) / F.sum("p").over(W.partitionBy()), 9).alias("recall"))


@query("""SELECT event_type, min(k) AS first_hit, round((min(k) - 1 + 1) / (max(n) + 1.0), 9) AS share FROM
(SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n, user_id FROM events) WHERE user_id % 7 = 0 GROUP BY event_type""")
def first_hit(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("group"), F.col("event_id").alias("object_idx"), F.col("value").alias("score"), F.when(F.col("user_id") % 7 == 0, 1).otherwise(0).alias("relevant"))
    r = evaluate.ranks(e).groupBy("group").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first_hit"), F.count("*").alias("n")).where("first_hit is not null")
    return r.select(F.col("group").alias("event_type"), "first_hit", F.round(F.col("first_hit") / (F.col("n") + 1.0), 9).alias("share"))


@query("""WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER () AS pab, sum(n) OVER (PARTITION BY lang) / sum(n) OVER () AS pa, sum(n) OVER (PARTITION BY source) / sum(n) OVER () AS pb FROM c)
SELECT round(sum(pab * ln(pab / (pa * pb))), 9) AS mutual_information FROM p""")
def mutual_information(spark, d):
    c = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    every = F.sum("n").over(W.partitionBy())
    p = c.select((F.col("n") / every).alias("pab"), (F.sum("n").over(W.partitionBy("lang")) / every).alias("pa"), (F.sum("n").over(W.partitionBy("source")) / every).alias("pb"))
    return p.agg(F.round(F.sum(F.col("pab") * F.log(F.col("pab") / (F.col("pa") * F.col("pb")))), 9).alias("mutual_information"))


@query("SELECT conv_id, min(turn)::BIGINT AS first_turn, string_agg(role, '+' ORDER BY turn) AS roles, count(*) AS n FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def conversation_chain(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return c.groupBy("conv_id").agg(F.min("turn").cast("long").alias("first_turn"), F.array_join(F.transform(lines, lambda x: x["role"]), "+").alias("roles"), F.count("*").alias("n"))


# The other catalogues register their queries here.
from . import catalog_feedback, catalog_media, catalog_sets  # noqa: E402, F401
