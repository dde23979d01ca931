"""Queries on objects, set functions, joins and set statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _features, query
from .operators import boxes, evaluate, objects, sets
from .plans import expression
from .runtime import table

def _function(text: str, sql: str, frame):
    """A query that evaluates one $function over a table of objects, and its SQL: objects where the condition holds."""

    def run(spark, d):
        return expression.evaluate(text, None, frame(spark, d))

    return run


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("object_idx"), "text", F.col("source").alias("aux_id"), "n_chars")


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("object_idx"), F.col("o_orderdate").alias("date"), F.col("o_custkey").alias("parent_idx"), F.concat(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("label"))


_SET_FUNCTIONS = {
    "set_date": ("$date('2024-01-01', '2030-12-31') | $date('1992-01-01', '1994-06-30')", "o_orderkey AS object_idx, CASE WHEN o_orderdate::DATE BETWEEN DATE '2024-01-01' AND DATE '2030-12-31' OR o_orderdate::DATE BETWEEN DATE '1992-01-01' AND DATE '1994-06-30' THEN 1 ELSE 0 END AS v FROM orders", _orders),
    "set_children": ("$children(1, 4, 7)", "o_orderkey AS object_idx, CASE WHEN o_custkey IN (1, 4, 7) THEN 1 ELSE 0 END AS v FROM orders", _orders),
    "set_regexp": ("$regexp('^O[0-9]*7$')", "o_orderkey AS object_idx, CASE WHEN regexp_matches(o_orderstatus || o_orderkey::VARCHAR, '^O[0-9]*7$') THEN 1 ELSE 0 END AS v FROM orders", _orders),
    "set_labelrange": ("$labelrange('O100', 'O2')", "o_orderkey AS object_idx, CASE WHEN o_orderstatus || o_orderkey::VARCHAR BETWEEN 'O100' AND 'O2' THEN 1 ELSE 0 END AS v FROM orders", _orders),
    "set_eye": ("$eye(1, 2, 3)", "o_orderkey AS object_idx, CASE WHEN o_orderkey IN (1, 2, 3) THEN 1 ELSE 0 END AS v FROM orders", _orders),
    "set_split": ("$split(1, 4)", "o_orderkey AS object_idx, CASE WHEN o_orderkey % 4 = 1 THEN 1 ELSE 0 END AS v FROM orders", _orders),
    "set_text": ("$text('the') & ~$text('and')", "doc_id AS object_idx, least(a, -b) AS v FROM (SELECT doc_id, CASE WHEN list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'the') THEN 1 ELSE 0 END AS a, CASE WHEN list_contains(regexp_extract_all(lower(text), '[a-z0-9]+'), 'and') THEN 1 ELSE 0 END AS b FROM documents)", _documents),
    "set_sql": ("$sql('n_chars > 1000')", "doc_id AS object_idx, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS v FROM documents", _documents),
    "set_auxid": ("$auxid('src_1', 'site1', 'source_1')", "doc_id AS object_idx, CASE WHEN source IN ('src_1', 'site1', 'source_1') THEN 1 ELSE 0 END AS v FROM documents", _documents),
    "set_data": ("$data(0, '>', '0.1')", "vec_id AS object_idx, CASE WHEN embedding[1] > 0.1::DOUBLE THEN 1 ELSE 0 END AS v FROM embeddings", lambda spark, d: _features(spark, d).withColumn("vec", F.col("vec").cast("array<double>"))),
}
for _n, (_t, _s, _f) in _SET_FUNCTIONS.items():
    query(f"SELECT {_s}", _n)(_function(_t, _s, _f))


def _keywords(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("class"), F.col("user_id").alias("object_idx"), "value")


@query("SELECT doc_id AS object_idx, CASE WHEN doc_id = m THEN 1 ELSE 0 END AS v FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents)")
def set_masters(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("object_idx"), F.col("text").alias("content"))
    return expression.evaluate("$masters()", None, objects.masters(docs))


@query("SELECT doc_id AS object_idx, CASE WHEN doc_id <> m THEN 1 ELSE 0 END AS v FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS m FROM documents)")
def set_duplicates(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("object_idx"), F.col("text").alias("content"))
    return expression.evaluate("$duplicates()", None, objects.masters(docs))


@query("SELECT user_id AS object_idx FROM events WHERE value > 120 GROUP BY user_id HAVING count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type <> 'view') = 0")
def set_only(spark, d):
    return objects.only(_keywords(spark, d).where("value > 120"), "view")


@query("SELECT user_id AS object_idx, min_by(event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END) AS class FROM events WHERE value > 100 AND event_type IN ('purchase', 'signup', 'error') GROUP BY 1")
def set_switch(spark, d):
    return objects.switch(_keywords(spark, d).where("value > 100"), ["purchase", "signup", "error"])


@query("SELECT user_id AS object_idx, count(DISTINCT event_type) AS n FROM events WHERE value > 100 GROUP BY 1 HAVING count(DISTINCT event_type) >= 2")
def set_nkeys(spark, d):
    return objects.n_keys(_keywords(spark, d).where("value > 100"), 2)


@query("SELECT user_id AS object_idx FROM (SELECT user_id, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) ORDER BY v DESC, user_id LIMIT 10")
def set_head(spark, d):
    ranked = _keywords(spark, d).groupBy("class", "object_idx").agg(F.max("value").alias("value"))
    return objects.head(ranked, "view", 10)


@query("SELECT o_orderkey AS object_idx FROM orders ORDER BY md5('7-' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def set_randcut(spark, d):
    return sets.seeded(_orders(spark, d).select("object_idx"), 100, 7)


@query("SELECT conv_id AS parent_idx, turn AS frame FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)) WHERE k = (n + 1) // 2")
def set_middleframe(spark, d):
    return objects.middle_frame(table(spark, d, "conversations").select(F.col("conv_id").alias("parent_idx"), F.col("turn").alias("frame")).distinct())


@query("SELECT user_id AS parent_idx, min_by(event_id, (ts, event_id)) AS frame FROM events GROUP BY user_id, floor(epoch(ts) / 86400)")
def set_persecond(spark, d):
    """The first event of each user's day: one in every 1/86400 of a second's rate."""
    e = table(spark, d, "events").select(F.col("user_id").alias("parent_idx"), F.col("event_id").alias("frame"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return objects.per_second(e, 1 / 86400)


@query("SELECT c_custkey AS parent_idx, c_custkey::VARCHAR || ':' || f::VARCHAR AS label, f::INT AS frame FROM customer, range(0, 12, 3) r(f) WHERE f < c_nationkey % 13 ")
def insert_frames(spark, d):
    return objects.frames(table(spark, d, "customer").select(F.col("c_custkey").alias("object_idx"), (F.col("c_nationkey") % 13).alias("frames")), 3).where("frame < 12")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'purchase' THEN 'bought' ELSE event_type END AS name FROM events")
def concept_names(spark, d):
    names = spark.createDataFrame([("view", "seen"), ("purchase", "bought")], "name string, target string")
    return objects.renamed(table(spark, d, "events").select("event_id", F.col("event_type").alias("name")), names)


@query("SELECT n_name AS label, coalesce(c, -1)::BIGINT AS object_idx FROM nation LEFT JOIN (SELECT min(c_custkey) AS c, c_nationkey FROM customer GROUP BY 2 HAVING count(*) > 5) ON n_nationkey = c_nationkey")
def label_lookup(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("object_idx"), F.count("*").alias("n")).where("n > 5")
    known = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("label"), "object_idx")
    return objects.lookup(n.select(F.col("n_name").alias("label")), known)


@query("SELECT event_id AS pos, (event_id * 7) % 900 AS object_idx, embedding[1]::DOUBLE AS first FROM events JOIN embeddings ON vec_id = (event_id * 7) % 900")
def features_by_index(spark, d):
    wanted = table(spark, d, "events").select(F.col("event_id").alias("pos"), ((F.col("event_id") * 7) % 900).alias("object_idx"))
    return objects.by_indices(wanted, _features(spark, d)).select("pos", "object_idx", F.col("vec")[0].cast("double").alias("first"))


@query("SELECT vec_id AS object_idx, variant, round(CASE variant WHEN '' THEN 1 WHEN 'mirror' THEN 1 ELSE 0.5 END * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings, (VALUES (''), ('mirror'), ('half')) v(variant)")
def feature_augmentation(spark, d):
    f = _features(spark, d).select("object_idx", F.col("vec").cast("array<double>").alias("vec"))
    a = objects.augmented(f, {"mirror": f.withColumn("vec", F.reverse("vec")), "half": f.withColumn("vec", F.transform("vec", lambda x: x / 2))})
    return a.select("object_idx", "variant", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("SELECT 'users' AS database, user_id AS object_idx, (user_id % 10)::INT AS unit, n AS value FROM (SELECT DISTINCT user_id FROM events) u JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) l ON l.label = user_id % 10")
def foreign_map(spark, d):
    """Objects of one database on the map of another."""
    users = table(spark, d, "events").select(F.lit("users").alias("database"), F.col("user_id").alias("object_idx"), (F.col("user_id") % 10).cast("int").alias("unit")).distinct()
    m = _features(spark, d).groupBy(F.col("label").alias("unit")).agg(F.count("*").alias("value")).withColumn("database", F.lit("vectors"))
    return objects.foreign(users, m, "vectors").select("database", "object_idx", "unit", "value")


@query("""WITH n AS (SELECT doc_id, 'd' || doc_id::VARCHAR AS label, text, md5(text) AS digest FROM documents),
w AS (SELECT digest, min(label) AS label FROM n WHERE doc_id % 2 = 1 AND digest NOT IN (SELECT digest FROM n WHERE doc_id % 2 = 0) GROUP BY digest)
SELECT label, digest, (SELECT max(doc_id) FROM n WHERE doc_id % 2 = 0) + row_number() OVER (ORDER BY digest) AS object_idx FROM w""")
def object_insertion(spark, d):
    """Documents of odd number as new objects beside those of even number."""
    n = table(spark, d, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("label"), F.col("text").alias("content"))
    known = n.where("doc_id % 2 = 0").select(F.col("doc_id").alias("object_idx"), "label", F.md5(F.col("content").cast("binary")).alias("digest"))
    return objects.insert(known, n.where("doc_id % 2 = 1").select("label", "content"))


@query("SELECT e.user_id AS object_idx, coalesce(round(v.t, 4), 0)::DOUBLE AS total, (v.t IS NULL)::INT AS missing FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (SELECT user_id, sum(value) AS t FROM events WHERE event_type = 'error' AND value > 60 GROUP BY 1) v USING (user_id)")
def zero_filled(spark, d):
    e = table(spark, d, "events")
    f = e.where("event_type = 'error' and value > 60").groupBy(F.col("user_id").alias("object_idx")).agg(F.array(F.sum("value"), F.lit(1.0)).alias("vec"))
    out = objects.filled(e.select(F.col("user_id").alias("object_idx")).distinct(), f, 2)
    return out.select("object_idx", F.round(F.col("vec")[0], 4).alias("total"), (1 - F.col("vec")[1]).cast("int").alias("missing"))


@query("""SELECT doc_id AS object_idx, CASE WHEN l.doc_id IS NOT NULL THEN 'lang=' || lang || ' quality=' || quality::VARCHAR || ' source=labelled' ELSE 'lang=' || lang || ' source=' || source END AS fields
FROM documents LEFT JOIN labels l USING (doc_id)""")
def text_index_update(spark, d):
    """Fields of documents, with those of labelled ones put over them."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("object_idx"), F.create_map(F.lit("lang"), "lang", F.lit("source"), "source").alias("fields"))
    new = table(spark, d, "labels").select(F.col("doc_id").alias("object_idx"), F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("source"), F.lit("labelled")).alias("fields"))
    u = objects.updated(docs, new)
    return u.select("object_idx", F.array_join(F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("fields"))


@query("SELECT item_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')) AS text FROM benchmark")
def text_rules(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.trim(objects.rewritten(F.lower("text"), [("[^a-z0-9 ]", ""), (" +", " ")])).alias("text"))


# -- set statistics -----------------------------------------------------------


def _assigned(spark, d):
    f = _features(spark, d)
    cell = F.when(F.col("vec")[0] > 0, 2).otherwise(0) + F.when(F.col("vec")[1] > 0, 1).otherwise(0)
    return f.select(cell.alias("unit"), "label")


_CELLS = "SELECT CASE WHEN embedding[1] > 0 THEN 2 ELSE 0 END + CASE WHEN embedding[2] > 0 THEN 1 ELSE 0 END AS unit, label FROM embeddings"


@query(f"WITH n AS (SELECT unit, label, count(*) AS n FROM ({_CELLS}) GROUP BY ALL), u AS (SELECT max(n) AS most, sum(n) AS n FROM n GROUP BY unit) SELECT round(sum(most) / sum(n), 9) AS purity FROM u")
def purity(spark, d):
    return objects.purity(_assigned(spark, d)).withColumn("purity", F.round("purity", 9))


@query(f"WITH n AS (SELECT unit, label, count(*) AS n FROM ({_CELLS}) GROUP BY ALL) SELECT label, count(*) AS units, round(max(n) / sum(n), 9) AS largest FROM n GROUP BY label")
def fragmentation(spark, d):
    return objects.fragmentation(_assigned(spark, d)).withColumn("largest", F.round("largest", 9))


@query("""WITH x AS (SELECT label, vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, i, count(*) AS n, sum(x) AS s, sum(x * x) AS q FROM x GROUP BY ALL)
SELECT label, max(n) AS n, round(sum(2 * (n * q - s * s) / (n * (n - 1))), 7) AS distance FROM s GROUP BY label""")
def pair_distances(spark, d):
    return objects.pair_distance(_features(spark, d)).withColumn("distance", F.round("distance", 7))


@query("""WITH x AS (SELECT label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), a AS (SELECT i, avg(x) AS a FROM x GROUP BY i)
SELECT round(sum((x - m) * (x - m)) / (SELECT count(*) FROM embeddings), 7) AS within, round(sum((m - a) * (m - a)) / (SELECT count(*) FROM embeddings), 7) AS between FROM x JOIN m USING (label, i) JOIN a USING (i)""")
def class_scatter(spark, d):
    s = objects.scatter(_features(spark, d))
    return s.select(F.round("within", 7).alias("within"), F.round("between", 7).alias("between"))


@query("SELECT event_type AS \"group\", count(*) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, min(value) AS low, max(value) AS high FROM events GROUP BY 1")
def moments_merged(spark, d):
    """Accumulators of every user's values, merged by type."""
    v = F.col("value")
    parts = table(spark, d, "events").groupBy(F.col("event_type").alias("group"), "user_id").agg(F.count("*").alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("squares"), F.min(v).alias("low"), F.max(v).alias("high"))
    return objects.merged_moments(parts).withColumns({"mean": F.round("mean", 6), "variance": F.round("variance", 4)})


@query("""WITH c AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t FROM c)
SELECT round(max(t) * (sum(n * n / (na * nb)) - 1), 5) AS statistic, (count(DISTINCT a) - 1) * (count(DISTINCT b) - 1) AS freedom FROM p""")
def chi_square_test(spark, d):
    return objects.chi_square(table(spark, d, "documents").select(F.col("lang").alias("a"), F.col("source").alias("b"))).withColumn("statistic", F.round("statistic", 5))


@query("SELECT l_returnflag AS \"group\", count(*) AS n, round(corr(l_quantity, l_extendedprice), 8) AS r, round(corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - pow(corr(l_quantity, l_extendedprice), 2))), 4) AS t FROM lineitem GROUP BY 1")
def correlation_test(spark, d):
    p = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("group"), F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return objects.correlation_test(p).withColumns({"r": F.round("r", 8), "t": F.round("t", 4)})


@query("SELECT event_type AS \"group\", round(1 / avg(value), 8) AS rate, round(-count(*) * (ln(avg(value)) + 1), 3) AS log_likelihood FROM events GROUP BY 1")
def exponential_fit(spark, d):
    f = objects.exponential_fit(table(spark, d, "events").select(F.col("event_type").alias("group"), "value"))
    return f.withColumns({"rate": F.round("rate", 8), "log_likelihood": F.round("log_likelihood", 3)})


@query("""WITH g AS (SELECT event_type, avg(value) AS m, ln(avg(value)) - avg(ln(value)) AS s FROM events WHERE value > 0 GROUP BY 1), k AS (SELECT *, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS shape FROM g)
SELECT event_type AS "group", round(shape, 7) AS shape, round(m / shape, 5) AS scale FROM k""")
def gamma_fit(spark, d):
    f = objects.gamma_fit(table(spark, d, "events").select(F.col("event_type").alias("group"), "value"))
    return f.withColumns({"shape": F.round("shape", 7), "scale": F.round("scale", 5)})


@query("SELECT l_returnflag AS detector, l_linestatus AS class, count(*) AS n, round(avg(l_discount), 7) AS mean, round(stddev_samp(l_discount), 6) AS deviation, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY 1, 2")
def detection_stats(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("detector"), F.col("l_linestatus").alias("class"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("l_discount"), 7).alias("mean"), F.round(F.stddev_samp("l_discount"), 6).alias("deviation"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"))


@query("SELECT (CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1500 THEN 2 ELSE 0 END)::INT AS type, count(*) AS n FROM part GROUP BY 1")
def target_types(spark, d):
    mask = F.when(F.col("p_size") > 25, 1).otherwise(0).bitwiseOR(F.when(F.col("p_retailprice") > 1500, 2).otherwise(0))
    return table(spark, d, "part").groupBy(mask.alias("type")).agg(F.count("*").alias("n"))


@query("SELECT event_type, true AS close, count(*) AS n FROM events GROUP BY 1")
def approximate_counts(spark, d):
    """Sketched distinct counts and quantiles, and whether they lie within their stated errors of the exact ones."""
    g = table(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("b"), F.approx_percentile("value", 0.5, 1000).alias("p"), F.median("value").alias("m"), F.count("*").alias("n"))
    return g.select("event_type", ((F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b") + 1) & (F.abs(F.col("p") - F.col("m")) <= 0.05 * F.col("m") + 0.5)).alias("close"), "n")


@query("SELECT vec_id AS object_idx, (len(list_distinct(list_transform(embedding, lambda x: round(x::DOUBLE, 3)))) = 64) AS distinct_components FROM embeddings")
def distinct_components(spark, d):
    v = F.transform("vec", lambda x: F.round(x.cast("double"), 3))
    return _features(spark, d).select("object_idx", (F.size(F.array_distinct(v)) == F.size(v)).alias("distinct_components"))


# -- measures -----------------------------------------------------------------

from .catalog import _RANKED_SQL, _ranked  # noqa: E402


@query(f'WITH {_RANKED_SQL} SELECT g AS "group", round(avg(1.0 / k), 9) AS mean_inverse_rank FROM r1 WHERE r = 1 GROUP BY g')
def mean_inverse_rank(spark, d):
    return evaluate.mean_inverse_rank(_ranked(spark, d)).withColumn("mean_inverse_rank", F.round("mean_inverse_rank", 9))


@query(f'WITH {_RANKED_SQL}, p AS (SELECT *, sum(r) OVER (PARTITION BY g) AS allp FROM r1) SELECT g AS "group", round(max(least(tp / k, tp / allp)), 9) AS value FROM p GROUP BY g')
def max_precision_recall(spark, d):
    return evaluate.max_precision_recall(_ranked(spark, d)).withColumn("value", F.round("value", 9))


@query(f"""WITH {_RANKED_SQL}, j AS (SELECT g, k, CASE WHEN o % 3 = 0 THEN NULL ELSE r END AS r, o, s FROM r1),
q AS (SELECT *, sum(coalesce(r, 0)) OVER w AS tp, sum(CASE WHEN r IS NULL THEN 0 ELSE 1 END) OVER w AS seen FROM j WINDOW w AS (PARTITION BY g ORDER BY k))
SELECT g AS "group", round(sum(CASE WHEN r = 1 THEN 1.0 / k + (k - 1.0) / k * CASE WHEN k > 1 THEN (seen - 1) / (k - 1.0) * (tp - 1 + 1e-5) / (seen - 1 + 2e-5) ELSE 0 END END) / sum(r), 8) AS inferred_average_precision FROM q GROUP BY g""")
def inferred_average_precision(spark, d):
    r = _ranked(spark, d).withColumn("relevant", F.when(F.col("object_idx") % 3 != 0, F.col("relevant")))
    return evaluate.inferred_average_precision(r).withColumn("inferred_average_precision", F.round("inferred_average_precision", 8))


@query(f"""WITH {_RANKED_SQL}, f AS (SELECT *, tp / allp - fp / alln AS r0 FROM s1) SELECT g AS "group", max_by(s, (r0, s)) AS threshold, round(max(r0), 9) AS r0 FROM f GROUP BY g""")
def threshold_max_r0(spark, d):
    return evaluate.best_threshold(_ranked(spark, d), "r0").withColumn("r0", F.round("r0", 9))


@query(f"""WITH {_RANKED_SQL} SELECT g AS "group", min(s) AS threshold, max(tp + fp)::BIGINT AS count FROM s1 WHERE tp + fp <= 40 GROUP BY g""")
def threshold_by_count(spark, d):
    return evaluate.best_threshold(_ranked(spark, d), "count", 40)


@query("""WITH i AS (SELECT item_id, lead(item_id, 1, (SELECT min(item_id) FROM benchmark)) OVER (ORDER BY item_id) AS ref, regexp_extract_all(lower(text), '[a-z]') AS w FROM benchmark),
g AS (SELECT item_id, k, list_aggregate(w[j:j + k - 1], 'string_agg', ' ') AS g, count(*) AS n FROM i, range(1, 5) a(k), range(1, 100000) b(j) WHERE j <= len(w) - k + 1 GROUP BY ALL),
p AS (SELECT c.item_id, c.k, sum(least(c.n, coalesce(r.n, 0))) / sum(c.n) AS p FROM g c JOIN i ON i.item_id = c.item_id LEFT JOIN g r ON r.item_id = i.ref AND r.k = c.k AND r.g = c.g GROUP BY ALL),
m AS (SELECT item_id, CASE WHEN count(*) = 4 AND min(p) > 0 THEN exp(sum(ln(CASE WHEN p > 0 THEN p END)) / 4) ELSE 0 END AS p FROM p GROUP BY item_id)
SELECT i.item_id AS id, round(m.p * CASE WHEN len(i.w) > len(r.w) THEN 1 ELSE exp(1 - len(r.w) / len(i.w)) END, 9) AS bleu FROM i JOIN m USING (item_id) JOIN i r ON r.item_id = i.ref""")
def bleu_four(spark, d):
    """Letters as tokens, every item against the next one by id, the last against the first."""
    from pyspark.sql.window import Window as W

    b = table(spark, d, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z]"), F.lit(0)).alias("words"))
    least = b.agg(F.min("item_id").alias("least"))
    # One row an item in one window: ids only, no text.
    pairs = b.select("item_id").withColumn("next", F.lead("item_id").over(W.orderBy("item_id"))).join(F.broadcast(least)).select("item_id", F.coalesce("next", "least").alias("ref"))
    refs = pairs.join(b.withColumnRenamed("item_id", "ref"), "ref").select(F.col("item_id").alias("id"), "words")
    return evaluate.bleu(b.withColumnRenamed("item_id", "id"), refs).withColumn("bleu", F.round("bleu", 9))


@query("SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 6) AS difference, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS cumulated FROM events")
def cumulate_difference(spark, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.round(F.col("value") - F.lag("value").over(w), 6).alias("difference"), F.round(F.sum("value").over(w.rowsBetween(W.unboundedPreceding, 0)), 4).alias("cumulated"))


@query("SELECT event_type, round(avg(CASE WHEN value = 0 OR event_id % 100 = 0 THEN 0 ELSE 1 / (0.3 / value + 0.7 / (event_id % 100)) END), 6) AS f FROM events GROUP BY 1")
def harmonic_mean(spark, d):
    e = table(spark, d, "events").select("event_type", F.col("value").alias("a"), (F.col("event_id") % 100).cast("double").alias("b"))
    return e.groupBy("event_type").agg(F.round(F.avg(evaluate.harmonic(F.col("a"), F.col("b"), 0.3)), 6).alias("f"))


@query("""WITH a AS (SELECT l_orderkey AS key, l_linenumber AS id, l_quantity AS x0, 0.0 AS y0, l_quantity + 5 AS x1, l_linenumber::DOUBLE AS y1 FROM lineitem)
SELECT count(*) AS n, count(*) FILTER ((x1 - x0) * (y1 - y0) >= 15) AS large, count(*) FILTER (x1 > x0 AND y1 > y0) AS valid, count(*) FILTER (x0 + x1 > 40) AS central FROM a""")
def box_filters(spark, d):
    box = F.struct(F.col("l_quantity").alias("x0"), F.lit(0.0).alias("y0"), (F.col("l_quantity") + 5).alias("x1"), F.col("l_linenumber").cast("double").alias("y1"))
    a = table(spark, d, "lineitem").select(box.alias("box"))
    return a.agg(F.count("*").alias("n"), F.count_if(boxes.area("box") >= 15).alias("large"), F.count_if(boxes.valid("box")).alias("valid"), F.count_if(F.col("box.x0") + F.col("box.x1") > 40).alias("central"))
