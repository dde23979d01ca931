"""Core operators against values worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from heliograph.functions import text as T
from heliograph.functions import vectors as V
from heliograph.graph import components
from heliograph.operators import boxes, evaluate, hierarchy, knn, models, ontology, quantize, retrieval, sets
from heliograph.operators.som import TreeSom
from heliograph.plans import expression
from heliograph.sources import binvec, textfiles
from heliograph.streaming import events as E


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


@pytest.mark.parametrize("op,table", [("and", (-1, -1, -1, 0)), ("or", (-1, -1, 1, 0)), ("minus", (-1, -1, -1, 0)), ("mask", (0, 0, -1, 0))])
def test_ternary(spark, op, table):
    a = spark.createDataFrame([(1, -1), (2, -1), (3, -1)], "object_idx long, v int")
    b = spark.createDataFrame([(1, -1), (3, 1), (4, 0)], "object_idx long, v int")
    assert [v for _, v in rows(sets.combine(a, b, op), "object_idx", "v")] == list(table)


def test_or_is_not_max(spark):
    a = spark.createDataFrame([(1, -1)], "object_idx long, v int")
    none = spark.createDataFrame([], "object_idx long, v int")
    assert rows(sets.combine(a, none, "or")) == [(1, -1)]
    assert rows(sets.combine(a, none, "ormax")) == [(1, 0)]


def test_expression(spark):
    named = spark.createDataFrame([("a", 1, 1), ("a", 2, -1), ("b", 1, 1), ("b", 3, 1)], "name string, object_idx long, v int")
    assert rows(expression.evaluate("a & ~b | %a", named)) == [(1, 1), (2, 1), (3, -1)]
    assert rows(expression.evaluate("(a | b) \\ a", named)) == [(1, -1), (2, -1), (3, 0)]
    for bad in ("a &", "(a", "a b", "$no(1)", "a @ b"):
        with pytest.raises(ValueError):
            expression.evaluate(bad, named)


def test_knn_and_vote(spark):
    f = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "object_idx long, vec array<double>")
    n = knn.knn_join(f, f.where("object_idx = 0"), 2)
    assert rows(n) == [(0, 1, 1, 1.0), (0, 2, 2, 4.0)]
    labels = spark.createDataFrame([(1, "x"), (2, "y")], "object_idx long, label string")
    assert rows(knn.vote(n, labels)) == [(0, "x", 1)]  # a tie drops the farthest
    assert rows(knn.vote(n, labels, reject=2)) == [(0, None, 1)]


def test_distances(spark):
    d = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>")
    want = {"euclidean": 13.0, "maximum": 9.0, "manhattan": 5.0, "histogram_intersection": 3.0, "chisquare": 1 + 9 / 7, "kullback": (3 * math.log(3) + 5 * math.log(2.5)) ** 2}
    for k, v in want.items():
        assert d.select(V.distance(k, "a", "b").alias("x")).first()["x"] == pytest.approx(v)


def test_hierarchy(spark):
    e = spark.createDataFrame([(10, 1), (10, 2), (20, 10)], "parent_idx long, child_idx long")
    s = spark.createDataFrame([(1, 4.0)], "object_idx long, value double")
    assert rows(hierarchy.relevance_up(s, e, "avg")) == [(10, 2.0)]
    assert rows(hierarchy.roots(e)) == [(1, 20), (2, 20), (10, 20)]
    down = spark.createDataFrame([(10, 3.0)], "object_idx long, value double")
    assert rows(hierarchy.relevance_down(down, e)) == [(1, 1.5), (2, 1.5)]
    assert rows(hierarchy.siblings(e)) == [(1, 1), (2, 1), (10, 0)]


def test_measures(spark):
    r = spark.createDataFrame([("g", 1, 0.9, 1), ("g", 2, 0.8, 0), ("g", 3, 0.7, 1), ("g", 4, 0.1, 0)], "group string, object_idx long, score double, relevant int")
    assert evaluate.average_precision(r).first()["average_precision"] == pytest.approx((1 + 2 / 3) / 2)
    assert evaluate.roc(r).first()["auc"] == pytest.approx(0.75)
    assert evaluate.best_threshold(r).first()["threshold"] == 0.7


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (7, 7)], "u long, v long")
    assert dict(rows(components(e))) == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}
    assert components(e.where("u = 999")).count() == 0


def test_quantisers(spark):
    v = spark.createDataFrame([(x,) for x in (0.0, 1.0, 1.0, 2.0, 10.0)], "value double")
    assert rows(quantize.histogram(v, 0, 10, 10), "bin", "n") == [(1, 3), (2, 1), (10, 1)]  # right-closed
    f = spark.createDataFrame([(i, [float(i // 5), 0.0]) for i in range(10)], "object_idx long, vec array<double>")
    assert sorted(x for _, (x, _) in rows(quantize.kmeans(f, 2))) == [0.0, 1.0]


def test_feedback_stages(spark):
    bmu = spark.createDataFrame([("f", 1, 0, 0), ("f", 2, 1, 0), ("f", 3, 3, 3)], "feature string, object_idx long, x int, y int")
    seen = spark.createDataFrame([(1, 1.0)], "object_idx long, value double")
    maps = retrieval.convolve(retrieval.place(seen, bmu), 4, 4, radius=1)
    assert [r["object_idx"] for r in retrieval.score_objects(maps, bmu, seen, 5).collect()] == [2]


def test_som_separates(spark):
    f = spark.createDataFrame([(i, [float(i % 2) * 10, 0.0]) for i in range(40)], "object_idx long, vec array<double>")
    b = TreeSom([(2, 2), (4, 4)]).fit(f).bmu(f).where("level = 1")
    units = {(r["object_idx"] % 2, r["unit"]) for r in b.collect()}
    assert not {u for k, u in units if k} & {u for k, u in units if not k}


def test_binary_vectors(spark, tmp_path):
    (tmp_path / "colour.bin").write_bytes(binvec.pack({0: [1, 2], 2: [3, 4]}, 2))
    assert rows(binvec.read(spark, str(tmp_path)), "feature", "object_idx", "vec") == [("colour", 0, [1.0, 2.0]), ("colour", 2, [3.0, 4.0])]
    with pytest.raises(ValueError):
        binvec.unpack(b"NOPE".ljust(64, b"\0"))


def test_text_files(spark, tmp_path):
    (tmp_path / "labels").write_text("# all\na1 image+segment\n\nb2\n")
    assert rows(textfiles.read_labels(spark, str(tmp_path / "labels"))) == [("a1", ["image", "segment"]), ("b2", None)]
    (tmp_path / "cls").write_text("a1\nb1 .. b3 # range\n")
    o = spark.createDataFrame([(x,) for x in ("a1", "b1", "b2", "b3", "c")], "label string")
    assert rows(textfiles.read_class(spark, str(tmp_path / "cls"), o)) == [("a1",), ("b1",), ("b2",), ("b3",)]
    (tmp_path / "contents").write_text("a1 cat,dog\n")
    assert rows(textfiles.read_contents(spark, str(tmp_path / "contents"))) == [("a1", "cat"), ("a1", "dog")]
    (tmp_path / "dat").write_text("2\n1 2 a1\n3 4 b2\n")
    assert rows(textfiles.read_features(spark, str(tmp_path / "dat"))) == [("a1", [1.0, 2.0]), ("b2", [3.0, 4.0])]
    h = spark.createDataFrame([("a1", "hit", 0.5)], "label string, text string, score double")
    assert json.loads(textfiles.wadm(h).first()["json"])["target"] == "a1"


def test_porter():
    for w, s in (("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("agreed", "agre"), ("adjustment", "adjust"), ("sky", "sky")):
        assert T.porter(w) == s


def test_timecode(spark):
    r = spark.createDataFrame([(3661.5,)], "s double").select(T.timecode(F.col("s")).alias("c")).withColumn("b", T.seconds(F.col("c"))).first()
    assert tuple(r) == ("1:01:01.500", 3661.5)


def test_events_batch(spark):
    s = spark.createDataFrame([(1, 1, 0.0, 5.0), (1, 2, 6.0, 9.0), (1, 3, 30.0, 31.0)], "key long, id long, begin double, end double")
    assert rows(E.merged(s, 2.0), "begin", "end") == [(0.0, 9.0), (30.0, 31.0)]
    o = spark.createDataFrame([(1, 9, 4.0, 8.0)], "key long, id long, begin double, end double")
    assert rows(E.overlaps(s, o, 3.0), "a", "b", "shared") == [(1, 9, 1.0), (2, 9, 2.0)]


def test_streaming_twin(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "cp")
    e = spark.createDataFrame([(i, 1, "view", float(i), 60 * i) for i in range(10)], "event_id long, user_id long, event_type string, value double, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    e.write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    q = E.tumbling(stream, "5 minutes", "10 minutes").writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", out).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("tumbled"), "start", "n") == rows(E.tumbling(e, "5 minutes"), "start", "n")


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "first string, second string")
    assert rows(ontology.closure(e)) == sorted([(p, q) for p in "abc" for q in "abc"] + [("x", "y")])
    m = spark.createDataFrame([("x", 1)], "concept string, object_idx long")
    assert rows(ontology.expand(m, e)) == [("x", 1), ("y", 1)]


def test_principal_component_of_a_line(spark):
    f = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(9)], "object_idx long, vec array<double>")
    mean, d, var = models.principal_components(f, 1)
    assert mean.tolist() == pytest.approx([4, 8, 1]) and d[0].tolist() == pytest.approx([5**-0.5, 2 * 5**-0.5, 0])
    assert var[0] == pytest.approx(7.5 * 5)
    assert models.project(f, mean, d).where("object_idx = 4").first()["vec"][0] == pytest.approx(0)


def test_local_subspace(spark):
    f = spark.createDataFrame([(0, [5.0, 0.1]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 3.0]), (4, [6.0, 3.0])], "object_idx long, vec array<double>")
    n = knn.knn_join(f, f.where("object_idx = 0"), 4)
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "object_idx long, label int")
    assert rows(models.local_subspace(n, f, f.where("object_idx = 0"), labels, 2)) == [(0, 0)]


def test_boxes_and_fusion(spark):
    b = "key long, id long, box struct<x0 double, y0 double, x1 double, y1 double>"
    left = spark.createDataFrame([(1, 1, (0.0, 0.0, 2.0, 2.0))], b)
    right = spark.createDataFrame([(1, 5, (1.0, 1.0, 3.0, 3.0)), (1, 6, (0.0, 0.0, 2.0, 1.0)), (2, 7, (0.0, 0.0, 2.0, 2.0))], b)
    assert rows(boxes.best_match(left, right, "key")) == [(1, 1, 6, 2.0, 0.5)]
    s = spark.createDataFrame([(1.0, 4.0, 0.0)], "a double, b double, c double")
    assert s.select(boxes.fuse([F.col("a"), F.col("b")], "geometric").alias("g")).first()["g"] == pytest.approx(2)
    assert s.select(boxes.fuse([F.col("a"), F.col("c")], "harmonic").alias("g")).first()["g"] == 0
