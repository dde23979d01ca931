"""Queries on media arrays, models, text and time, with their SQL. Embeddings stand for pictures of 8 x 8 grey values and for sounds."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .catalog import _TERMS_SQL, _counts, _features, query
from .functions import text as T
from .functions import vectors as V
from .operators import knn, media, models, quantize
from .runtime import table
from .streaming import events as E


def _pictures(spark, d):
    return _features(spark, d).select("object_idx", F.col("vec").cast("array<double>").alias("pixels"))


_PIXELS = "p AS (SELECT vec_id AS o, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"WITH {_PIXELS} SELECT o AS object_idx, (i // 8 // 4 * 2 + i % 8 // 4)::INT AS tile, round(avg(v), 8) AS mean FROM p GROUP BY 1, 2")
def picture_tiles(spark, d):
    return _pictures(spark, d).select("object_idx", F.posexplode(media.tiles(F.col("pixels"), 8, 8, 2, 2)).alias("tile", "mean")).withColumn("mean", F.round("mean", 8))


@query(f"WITH {_PIXELS}, m AS (SELECT o, avg(v) AS m FROM p GROUP BY o) SELECT o AS object_idx, round(max(m), 8) AS mean, round(sqrt(avg(pow(v - m, 2))), 8) AS deviation, round(cbrt(avg(pow(v - m, 3))), 5) AS skew FROM p JOIN m USING (o) GROUP BY o")
def picture_moments(spark, d):
    m = _pictures(spark, d).select("object_idx", media.colour_moments(F.col("pixels")).alias("m"))
    return m.select("object_idx", F.round("m.mean", 8).alias("mean"), F.round("m.deviation", 8).alias("deviation"), F.round("m.skew", 5).alias("skew"))


@query(f"""WITH {_PIXELS}, n AS (SELECT a.o, a.i, [round(abs(r.v - a.v), 9), round(abs(b.v - a.v), 9), round(abs(e.v - a.v), 9), round(abs(w.v - a.v), 9)] AS f FROM p a JOIN p r ON r.o = a.o AND r.i = a.i + 1 JOIN p b ON b.o = a.o AND b.i = a.i + 8 JOIN p e ON e.o = a.o AND e.i = a.i + 9 JOIN p w ON w.o = a.o AND w.i = a.i + 7 WHERE a.i % 8 BETWEEN 1 AND 6 AND a.i < 56)
SELECT o AS object_idx, count(*) FILTER (k = 1) AS across, count(*) FILTER (k = 2) AS down, count(*) FILTER (k = 3) AS falling, count(*) FILTER (k = 4) AS rising FROM (SELECT o, list_position(f, list_max(f)) AS k FROM n WHERE list_max(f) > 0) GROUP BY o""")
def picture_edges(spark, d):
    e = _pictures(spark, d).select("object_idx", F.explode(media.edge_directions(F.col("pixels"), 8, 8)).alias("k"))
    return e.groupBy("object_idx").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in enumerate(("across", "down", "falling", "rising"), 1)])


@query(f"""WITH {_PIXELS}, q AS (SELECT o, i, greatest(0, least(3, floor((v + 0.25) * 8)))::INT AS v FROM p), c AS (SELECT a.o, a.v AS a, b.v AS b, count(*) AS n FROM q a JOIN q b ON a.o = b.o AND b.i = a.i + 1 WHERE a.i % 8 < 7 GROUP BY ALL)
SELECT o AS object_idx, round(sum(n * (a - b) * (a - b)) / 56, 8) AS contrast, round(sum(n * n) / 3136.0::DOUBLE, 8) AS energy FROM c GROUP BY o""")
def picture_texture(spark, d):
    levels = F.transform("pixels", lambda v: F.greatest(F.lit(0), F.least(F.lit(3), F.floor((v + 0.25) * 8))).cast("int"))
    t = _pictures(spark, d).select("object_idx", levels.alias("levels")).select("object_idx", media.neighbour_levels(F.col("levels"), 8, 8, 4).alias("pairs"))
    t = t.select("object_idx", media.cooccurrence(F.col("pairs"), 4).alias("t"))
    return t.select("object_idx", F.round("t.contrast", 8).alias("contrast"), F.round("t.energy", 8).alias("energy"))


_AROUND = " + ".join(f"CASE WHEN embedding[i + {1 + s}] >= embedding[i + 1] THEN {1 << k} ELSE 0 END" for k, s in enumerate((-9, -8, -7, 1, 9, 8, 7, -1)))


@query(f"SELECT object_idx, code::INT AS code, count(*) AS n FROM (SELECT vec_id AS object_idx, ({_AROUND}) AS code FROM embeddings, range(8, 56) r(i) WHERE i % 8 BETWEEN 1 AND 6) GROUP BY ALL")
def picture_patterns(spark, d):
    codes = _pictures(spark, d).select("object_idx", F.explode(media.local_binary_patterns(F.col("pixels"), 8, 8)).alias("code"))
    return codes.groupBy("object_idx", "code").agg(F.count("*").alias("n"))


_NINE = ", ".join(f"embedding[(greatest(0, least(7, i // 8 + {dy})) * 8 + greatest(0, least(7, i % 8 + {dx})) + 1)::INT]::DOUBLE" for dy in (-1, 0, 1) for dx in (-1, 0, 1))


@query(f"SELECT vec_id AS object_idx, round(sum(list_sort([{_NINE}])[5] * (i + 1)), 6) AS total FROM embeddings, range(64) r(i) GROUP BY vec_id")
def picture_median(spark, d):
    m = _pictures(spark, d).select("object_idx", F.posexplode(media.median_filter(F.col("pixels"), 8, 8)).alias("i", "v"))
    return m.groupBy("object_idx").agg(F.round(F.sum(F.col("v") * (F.col("i") + 1)), 6).alias("total"))


@query()
def picture_regions(spark, d):
    """Bright and dark areas of every picture after a chain of steps."""
    p = media.chain(_pictures(spark, d).withColumnRenamed("pixels", "labels"), "median+binarise(0.02)", 8, 8)
    return media.regions(p, 8)


@query("SELECT vec_id AS object_idx, f::INT AS frame, round(list_sum(list_transform(embedding[f * 20 + 1:least(64, f * 20 + 20)], lambda x: x::DOUBLE * x::DOUBLE)) / (least(64, f * 20 + 20) - f * 20), 9) AS energy FROM embeddings, range(4) r(f)")
def sound_energy(spark, d):
    return _pictures(spark, d).select("object_idx", F.posexplode(media.average_energy(F.col("pixels"), 20)).alias("frame", "energy")).withColumn("energy", F.round("energy", 9))


@query("""WITH s AS (SELECT vec_id, k, sum(embedding[i + 1]::DOUBLE * cos(2 * pi() * k * i / 64)) AS re, sum(embedding[i + 1]::DOUBLE * sin(2 * pi() * k * i / 64)) AS im FROM embeddings, range(64) a(i), range(33) b(k) GROUP BY ALL)
SELECT vec_id AS object_idx, CASE WHEN k < 9 THEN 0 ELSE (k - 1) // 8 END::INT AS band, round(sum(re * re + im * im), 6) AS energy FROM s GROUP BY 1, 2""")
def sound_spectrum(spark, d):
    s = media.spectrum(_pictures(spark, d).withColumnRenamed("pixels", "samples"), 4)
    return s.select("object_idx", F.posexplode("bands").alias("band", "energy")).withColumn("energy", F.round("energy", 6))


@query("SELECT vec_id // 4 AS object_idx, i::INT AS i, round(avg(embedding[i + 1]::DOUBLE), 8) AS mean FROM embeddings, range(64) r(i) GROUP BY 1, 2")
def frames_averaged(spark, d):
    """Every four vectors as frames of one object."""
    f = _features(spark, d).select(F.floor(F.col("object_idx") / 4).alias("object_idx"), (F.col("object_idx") % 4).alias("frame"), "vec")
    return media.frame_treatment(f, "average").select("object_idx", F.posexplode("vec").alias("i", "mean")).withColumn("mean", F.round("mean", 8))


@query("SELECT vec_id // 4 AS object_idx, sum(len(embedding))::INT AS n, round(sum(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) * (vec_id % 4 + 1)), 5) AS total FROM embeddings GROUP BY 1")
def frames_concatenated(spark, d):
    f = _features(spark, d).select(F.floor(F.col("object_idx") / 4).alias("object_idx"), (F.col("object_idx") % 4).alias("frame"), F.col("vec").cast("array<double>").alias("vec"))
    c = media.frame_treatment(f, "concatenate")
    total = F.aggregate(F.transform("vec", lambda x, i: x * (F.floor(i / 64) + 1)), F.lit(0.0), lambda a, x: a + x)
    return c.select("object_idx", F.size("vec").alias("n"), F.round(total, 5).alias("total"))


@query("SELECT page_id, len(regexp_extract_all(html, 'href=\"([^\"]*)\"')) AS links, len(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS targets, 42 AS dummy FROM pages")
def web_links(spark, d):
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.size(F.array_distinct(links)).cast("long").alias("targets"), F.lit(42).alias("dummy"))


@query("SELECT event_id, year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events")
def message_dates(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", *[F.date_part(F.lit(p), "ts").cast("long").alias(p) for p in ("year", "month", "day", "hour")], T.xsd_time(F.col("ts")).alias("stamp"))


@query("""WITH j AS (SELECT user_id AS key, epoch(ts) AS t, event_type AS feature FROM events WHERE value > 100),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t, feature) <= 86400 THEN 0 ELSE 1 END AS new FROM j), g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, feature ROWS UNBOUNDED PRECEDING) AS g FROM n)
SELECT key, round(min(t), 3) AS "at", count(DISTINCT feature) AS votes FROM g GROUP BY key, g HAVING count(DISTINCT feature) >= 2""")
def boundary_votes(spark, d):
    """Boundaries that two kinds of events share within a day."""
    b = table(spark, d, "events").where("value > 100").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_type").alias("feature"))
    return E.votes(b, 2, 86400).withColumn("at", F.round("at", 3))


@query()
def time_warping(spark, d):
    """Each vector against the next one by id, as curves."""
    f = _features(spark, d).select("object_idx", "vec")
    p = f.join(f.select((F.col("object_idx") - 1).alias("object_idx"), F.col("vec").alias("b")), "object_idx")
    return media.warped(p.select(F.col("object_idx").alias("id"), F.slice("vec", 1, 16).alias("a"), F.slice("b", 1, 16).alias("b"))).withColumn("distance", F.round("distance", 6))


# -- models -------------------------------------------------------------------


@query()
def lbg(spark, d):
    f = _features(spark, d)
    return knn.assign(f, quantize.lbg(f, 8)).groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 6).alias("error"))


@query()
def subspace_classes(spark, d):
    f = _features(spark, d)
    c = models.classify_by_subspace(f, models.subspaces(f, 3))
    return c.join(f.select("object_idx", F.col("label").alias("truth")), "object_idx").groupBy("truth", "label").agg(F.count("*").alias("n"))


def _signed(spark, d):
    return _features(spark, d).select("object_idx", F.col("vec").cast("array<double>").alias("vec"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))


@query()
def svm_decisions(spark, d):
    rows = _signed(spark, d)
    w = models.linear_svm(rows, cost=1.0, rounds=25)
    return rows.select("object_idx", "y", F.round(models.decision("vec", w), 4).alias("decision"))


@query()
def svm_grid(spark, d):
    return spark.createDataFrame(models.grid_search(_signed(spark, d), [0.1, 1.0], 2, 10), "cost double, accuracy double")


@query("""SELECT vec_id AS object_idx, round(list_sum(list_transform(embedding, lambda x: sqrt(abs(x::DOUBLE)) * sqrt(0.65))), 6) AS first,
round(list_sum(list_transform(embedding, lambda x: sqrt(abs(x::DOUBLE)) * sqrt(1.3 / cosh(pi() * 0.65)) * cos(0.65 * ln(CASE WHEN x <> 0 THEN abs(x::DOUBLE) ELSE 1 END)))), 6) AS second FROM embeddings""")
def kernel_map(spark, d):
    v = models.kernel_map(F.transform(F.col("vec").cast("array<double>"), lambda x: F.abs(x)))
    pick = lambda k: V.total(F.filter(F.transform("m", lambda x, i: F.when(i % 3 == k, x)), lambda x: x.isNotNull()))
    return _features(spark, d).select("object_idx", v.alias("m")).select("object_idx", F.round(pick(0), 6).alias("first"), F.round(pick(1), 6).alias("second"))


@query()
def feature_selection(spark, d):
    return spark.createDataFrame([(k, c) for k, c in enumerate(models.select_components(_signed(spark, d), 5))], "place int, component int")


# -- text ---------------------------------------------------------------------


@query(f"""WITH {_TERMS_SQL}, f AS (SELECT term, count(*) AS df FROM c GROUP BY term), w AS (SELECT term, ('0x' || substr(md5(term), 1, 2))::INT / 255.0 - 0.5 AS a, ('0x' || substr(md5(term), 3, 2))::INT / 255.0 - 0.5 AS b FROM f)
SELECT doc_id, round(sum(n * ln((SELECT count(*) FROM documents)::DOUBLE / df) * a), 4) AS a, round(sum(n * ln((SELECT count(*) FROM documents)::DOUBLE / df) * b), 4) AS b FROM c JOIN f USING (term) JOIN w USING (term) GROUP BY doc_id""")
def word_vectors(spark, d):
    """Sums of word vectors by tf-idf; a word's vector here is two bytes of its digest."""
    from .runtime import staged

    c = staged(_counts(spark, d), "terms")
    df = c.groupBy("term").agg(F.count("*").alias("df"))
    byte = lambda k: F.conv(F.substring(F.md5(F.col("term").cast("binary")), k, 2), 16, 10).cast("int") / 255.0 - 0.5
    book = df.select("term", F.array(byte(1), byte(3)).alias("vec"))
    n = table(spark, d, "documents").count()
    weights = c.join(df, "term").select("doc_id", "term", (F.col("n") * F.log(F.lit(float(n)) / F.col("df"))).alias("weight"))
    bag = T.word_bag(weights, book)
    return bag.select("doc_id", F.round(F.col("vec")[0], 4).alias("a"), F.round(F.col("vec")[1], 4).alias("b"))


@query("SELECT event_id, printf('%02d:%02d:%06.3f', (value * 60)::BIGINT // 3600, (value * 60)::BIGINT // 60 % 60, ((value * 60)::BIGINT % 60)::DOUBLE) AS vtt, printf('PT%dH%dM%dS', (value * 60)::BIGINT // 3600, (value * 60)::BIGINT // 60 % 60, (value * 60)::BIGINT % 60) AS duration FROM events")
def time_strings(spark, d):
    s = F.round(F.col("value") * 60).cast("long")
    return table(spark, d, "events").select("event_id", T.vtt(s).alias("vtt"), T.media_duration(s).alias("duration"))


@query("""WITH w AS (SELECT user_id AS key, epoch(ts) AS t, epoch(ts) + value AS fin, event_type AS word FROM events),
n AS (SELECT *, CASE WHEN t - lag(fin) OVER (PARTITION BY key ORDER BY t, word) <= 3600 THEN 0 ELSE 1 END AS new FROM w), g AS (SELECT *, sum(new) OVER (PARTITION BY key ORDER BY t, word ROWS UNBOUNDED PRECEDING) AS line FROM n)
SELECT key, round(min(t), 3) AS "begin", round(max(fin), 3) AS "end", string_agg(word, ' ' ORDER BY t, word) AS text FROM g GROUP BY key, line""")
def speech_lines(spark, d):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = table(spark, d, "events").select(F.col("user_id").alias("key"), at.alias("at"), (at + F.col("value")).alias("end"), F.col("event_type").alias("word"))
    return E.speech_lines(w, 3600).withColumns({"begin": F.round("begin", 3), "end": F.round("end", 3)})


_STOPS = {"de": ["der", "die", "und", "das"], "en": ["the", "and", "of", "to"], "es": ["el", "los", "que", "en"], "fr": ["le", "les", "des", "et"]}
_HITS = ", ".join(f"len(list_filter(w, lambda x: x IN ({', '.join(repr(s) for s in ws)}))) AS {k}" for k, ws in _STOPS.items())


@query(f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), h AS (SELECT doc_id, {_HITS} FROM w)
SELECT doc_id, CASE WHEN greatest(de, en, es, fr) = 0 THEN NULL WHEN de = greatest(de, en, es, fr) THEN 'de' WHEN en = greatest(de, en, es, fr) THEN 'en' WHEN es = greatest(de, en, es, fr) THEN 'es' ELSE 'fr' END AS lang FROM h""")
def language_by_stop_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.language_by_words(T.terms(F.col("text")), _STOPS).alias("lang"))


@query("SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]) AS words, base64(p_name::BLOB) AS encoded, regexp_matches(p_name, '^[A-Z]') AS proper FROM part")
def string_tools(spark, d):
    return table(spark, d, "part").select("p_partkey", F.transform(F.split("p_name", " "), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000000))).alias("words"), F.base64(F.encode("p_name", "utf-8")).alias("encoded"), F.col("p_name").rlike("^[A-Z]").alias("proper"))


@query("SELECT vec_id AS object_idx, (embedding[3:5] || [label::FLOAT]) AS picked, len(list_filter(embedding, lambda x: x > 0)) AS positive, list_position(embedding, list_max(embedding))::INT AS top FROM embeddings")
def array_tools(spark, d):
    f = _features(spark, d)
    return f.select("object_idx", F.array_append(F.slice("vec", 3, 3), F.col("label").cast("float")).alias("picked"), F.size(F.filter("vec", lambda x: x > 0)).cast("long").alias("positive"), F.array_position("vec", F.array_max("vec")).cast("int").alias("top"))


@query("SELECT event_id, (json_extract(props, '$.k')::BIGINT) AS k, '<e><k>' || json_extract_string(props, '$.k') || '</k></e>' AS xml, (json_extract(props, '$.k')::BIGINT + 1)::DOUBLE AS next FROM events")
def xml_and_json(spark, d):
    k = F.get_json_object("props", "$.k")
    xml = F.concat(F.lit("<e><k>"), k, F.lit("</k></e>"))
    return table(spark, d, "events").select("event_id", k.cast("long").alias("k"), xml.alias("xml"), (F.xpath_double(xml, F.lit("/e/k")) + 1).alias("next"))


@query("SELECT l_orderkey, l_linenumber, round(avg(l_extendedprice), 4) AS smoothed, count(*) AS n FROM lineitem GROUP BY 1, 2")
def detections_combined(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.round(F.avg("l_extendedprice"), 4).alias("smoothed"), F.count("*").alias("n"))


@query("SELECT r_name AS super, l_returnflag AS class, round(max(l_discount), 6) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2")
def superclass_fusion(spark, d):
    """The best score of the objects under each root, by class."""
    li, o, c, n, r = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    up = o.join(c, F.col("c_custkey") == F.col("o_custkey")).join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(r, F.col("r_regionkey") == F.col("n_regionkey")).select("o_orderkey", F.col("r_name").alias("super"))
    return li.join(up, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("super", F.col("l_returnflag").alias("class")).agg(F.round(F.max("l_discount"), 6).alias("score"))


@query("""SELECT s_suppkey AS subject, n_name AS place, r_name AS wider FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""")
def triple_patterns(spark, d):
    """Triples of places, matched by two patterns that share a variable."""
    from .sources import triples

    s, n, r = table(spark, d, "supplier"), table(spark, d, "nation"), table(spark, d, "region")
    t = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("s"), F.lit("in").alias("p"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("o"))
    t = t.unionByName(n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("name").alias("p"), F.col("n_name").alias("o")))
    t = t.unionByName(n.join(r, n.n_regionkey == r.r_regionkey).select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("s"), F.lit("part").alias("p"), F.col("r_name").alias("o")))
    m = triples.match(t, [("?subject", "in", "?n"), ("?n", "name", "?place"), ("?n", "part", "?wider")])
    return m.where(F.col("wider").isin("ASIA", "EUROPE")).select(F.substring("subject", 2, 20).cast("long").alias("subject"), "place", "wider")
