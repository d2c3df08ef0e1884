"""D1-D5, C1b, R1 against brute force; S1-S10 sources and sinks."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from themelens.functions import vectors as vx
from themelens.operators import distances, kmeans, projection
from themelens.sources import io


def test_distances(spark):
    df = spark.createDataFrame([([0.0, 0.0], [3.0, 4.0])], "a array<double>, b array<double>")
    r = df.select(vx.euclidean_distance(F.col("a"), F.col("b")).alias("d"),
                  vx.squared_distance(F.col("a"), F.col("b")).alias("r")).first()
    assert (r.d, r.r) == (5.0, 25.0)


def _points(spark, n=60, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, d))
    return x, spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<double>")


def test_pairs_within_equals_brute_force(spark):
    x, df = _points(spark)
    t = 0.35
    want = {(i, j) for i, j in itertools.combinations(range(len(x)), 2) if np.linalg.norm(x[i] - x[j]) <= t}
    got = {(r.id_a, r.id_b) for r in distances.pairs_within(df, t).collect()}
    assert got == want


def test_cross_knn_equals_brute_force(spark):
    x, df = _points(spark)
    left, right = df.filter("vec_id < 20"), df.filter("vec_id >= 20")
    got = distances.cross_knn(left, right, k=3, radius=0.05).collect()   # several rounds
    for i in range(20):
        d = sorted((np.sum((x[i] - x[j]) ** 2), j) for j in range(20, len(x)))[:3]
        mine = sorted((r.rank, r.right_id) for r in got if r.left_id == i)
        assert [j for _, j in mine] == [j for _, j in d]


def test_assign_nearest_center(spark):
    x, df = _points(spark)
    centers = kmeans.first_k_centers(df, 3, "vec_id", "embedding")
    got = {r.vec_id: r.cluster for r in kmeans.assign(df, centers).collect()}
    c = np.array(centers)
    for i in range(len(x)):
        assert got[i] == int(np.argmin(((c - x[i]) ** 2).sum(1)))


def test_kmeans_fit_invariants(spark):
    from pyspark.ml.functions import array_to_vector
    x, df = _points(spark)
    model, lab = kmeans.kmeans_fit(df.withColumn("features", array_to_vector("embedding")), k=3)
    c = np.array(model.clusterCenters())
    for r in lab.collect():
        assert r.cluster == int(np.argmin(((c - np.array(r.embedding)) ** 2).sum(1)))


def test_kmeans_labels_do_not_depend_on_partitions(spark):
    """Dense and sparse vectors, equal and missing ones: the same centres and labels on 1 and 7 partitions."""
    from pyspark.ml.linalg import Vectors
    rng = np.random.default_rng(7)
    blobs = [(i, Vectors.dense((rng.normal(0, 0.3, 5) + 5 * (i % 4)).tolist())) for i in range(200)]
    blobs += [(200 + i, blobs[0][1]) for i in range(50)] + [(250, None)]
    sparse = [(i, Vectors.sparse(300, {int(j): float(rng.random()) for j in {i % 3, *rng.integers(0, 300, i % 9).tolist()}}))
              for i in range(150)] + [(150, Vectors.sparse(300, {}))]
    for rows, k in ((blobs, 4), (sparse, 3)):
        df = spark.createDataFrame(rows, ["id", "features"])
        runs = []
        for parts, order in ((1, "id"), (7, "rand(3)")):
            dealt = df.orderBy(F.expr(order)).repartition(parts)
            model, lab = kmeans.kmeans_fit(dealt, k=k, id_col="id")
            runs.append((np.array(model.clusterCenters()).tobytes(), sorted((r.id, r.cluster) for r in lab.collect() if r.cluster is not None)))
        assert runs[0] == runs[1]
        centers = np.array(model.clusterCenters())
        dense = {i: v.toArray() for i, v in rows if v is not None}
        assert all(label == ((centers - dense[i]) ** 2).sum(axis=1).argmin() for i, label in runs[0][1])
        assert len(runs[0][1]) == len(dense)
    assert len({label for i, label in runs[0][1]}) == 3


def test_kmeans_with_few_distinct_vectors(spark):
    from pyspark.ml.linalg import Vectors
    df = spark.createDataFrame([(i, Vectors.dense([float(i % 2), 1.0])) for i in range(9)], ["id", "features"])
    model, lab = kmeans.kmeans_fit(df, k=5, id_col="id")
    assert sorted(c.tolist() for c in model.clusterCenters()) == [[0.0, 1.0], [1.0, 1.0]]
    assert lab.groupBy("cluster").count().count() == 2
    _, none = kmeans.kmeans_fit(df.where("id < 0"), k=2)
    assert none.columns == ["id", "features", "cluster"] and none.count() == 0


def test_unknown_method_raises(spark):
    _, df = _points(spark)
    with pytest.raises(ValueError):
        kmeans.cluster(df, "nope")
    with pytest.raises(ValueError):
        projection.reduce_dimensions(df, "tsne")


def test_pca_matches_numpy(spark):
    x, df = _points(spark, d=5)
    out = projection.pca_project(df).orderBy("vec_id").select("dim_x", "dim_y").toPandas().to_numpy()
    xc = x - x.mean(0)
    w, u = np.linalg.eigh(np.cov(xc, rowvar=False))
    top = u[:, np.argsort(w)[::-1][:2]]
    ref = xc @ top
    for j in range(2):
        assert abs(abs(np.corrcoef(ref[:, j], out[:, j])[0, 1]) - 1) < 1e-9


def test_sparse_pca_matches_dense(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((40, 12)) > 0.6) * rng.random((40, 12))
    rows = [(i, [(f"t{j:02d}", j, float(x[i, j])) for j in range(12) if x[i, j] > 0]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, tfidf array<struct<term:string,term_id:int,w:double>>")
    terms = [f"t{j:02d}" for j in range(12)]
    mu, comps, vals = projection.pca_sparse(df, terms, 40, k=2, n_iter=4)
    w, u = np.linalg.eigh(np.cov(x, rowvar=False))
    top = u[:, np.argsort(w)[::-1][:2]].T
    assert np.allclose(vals, np.sort(w)[::-1][:2], rtol=1e-6)
    for j in range(2):
        assert abs(abs(top[j] @ comps[j]) - 1) < 1e-6


def test_sorted_position(spark):
    keys = sorted(["b", "d", "x y", "it's"])
    df = spark.createDataFrame([(k,) for k in ["a", "b", "d", "x y", "it's", "zz"]], "k string")
    got = [r.p for r in df.select(vx.sorted_position(keys, F.col("k")).alias("p")).collect()]
    assert got == [0, 1, 2, 4, 3, 0]


def test_format_dispatch_and_empty_guard(spark, tmp_path):
    with pytest.raises(ValueError):
        io.read_records(spark, str(tmp_path / "x.xlsx"))
    empty = spark.createDataFrame([], "titulo string")
    assert io.write_records(empty, str(tmp_path / "e.json")) is False
    assert not os.path.exists(tmp_path / "e.json")


def test_roundtrips(spark, tmp_path):
    rows = [("Título \"q\"", "linha1\nlinha2", ""), ("B", "ção", "x")]
    df = spark.createDataFrame(rows, "titulo string, resumo string, autor string")
    j = str(tmp_path / "r.json")
    io.write_records(df, j)
    assert sorted(map(tuple, io.read_records(spark, j, schema=df.schema).collect())) == sorted(rows)
    c = str(tmp_path / "r.csv")
    io.write_records(df, c)
    back = sorted(tuple(v if v is not None else "" for v in r) for r in io.read_records(spark, c, schema=df.schema).collect())
    assert back == sorted(rows)


def test_preview(spark):
    df = spark.createDataFrame([(1, "x" * 120, " "), (2, "b", "c"), (3, "d", None), (4, "e", "f")],
                               "doc_id long, titulo string, resumo string")
    got = io.record_preview(df, "doc_id", columns=["titulo", "resumo"]).orderBy("doc_id", "field_pos").collect()
    assert [(r.doc_id, r.field) for r in got] == [(1, "titulo"), (2, "titulo"), (2, "resumo"), (3, "titulo")]
    assert got[0].shown == "x" * 100 + "..."


def test_kmeans_passes_read_vectors_as_bytes(spark):
    """Packed rows hold the entries of dense, sparse and empty vectors, also in a slice, and a step adds them up exactly."""
    from pyspark.ml.linalg import Vectors
    vectors = [Vectors.dense([1.5, 0.0, -2.0, 4.0]), Vectors.sparse(4, {1: 3.0, 3: -1.0}), Vectors.sparse(4, {}), Vectors.dense([0.0] * 4)]
    rows = spark.createDataFrame([(v, i) for i, v in enumerate(vectors)], ["features", "row"])
    packed = kmeans._packed(rows).orderBy("row")
    assert [f.dataType.simpleString() for f in packed.schema] == ["int", "binary", "binary", "bigint"]
    held = packed.toArrow().combine_chunks()
    assert [kmeans._unpack(*(c.as_py() for c in row)).tolist() for row in zip(*(held[n] for n in ("size", "dims", "vals")))] == [
        v.toArray().tolist() for v in vectors]
    part = held.slice(1, 2).to_batches()[0]
    starts, sizes, dims, values = kmeans._unpacked(part.column(1), part.column(2))
    assert (starts.tolist(), sizes.tolist(), dims.tolist(), values.tolist()) == ([0, 2], [2, 0], [1, 3], [3.0, -1.0])
    centers = np.array([[1.5, 0.0, -2.0, 4.0], [0.0, 1.0, 0.0, 0.0]])
    moved = kmeans._step(packed, centers, 2.0 ** 30)
    assert np.allclose(moved, [[1.5, 0.0, -2.0, 4.0], [0.0, 1.0, 0.0, -1 / 3]])
