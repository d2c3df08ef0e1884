"""Registered queries: vectors, K-means steps, distances and projections (C1, C1b, D, R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..operators import distances, kmeans, projection
from ..sources.tables import read_table
from .registry import query

K = 6
KNN_K = 5
RANGE_T = 1.1

SQL_LONG = """
WITH emb AS (SELECT vec_id, label, embedding FROM embeddings),
lv AS (
  SELECT vec_id, label, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS x
  FROM emb)"""

SQL_ASSIGN = SQL_LONG + f""",
cents AS (SELECT vec_id AS cid_src, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS cluster
          FROM emb ORDER BY vec_id LIMIT {K}),
cl AS (SELECT c.cluster, lv.dim, lv.x AS cx FROM cents c JOIN lv ON lv.vec_id = c.cid_src),
d AS (SELECT lv.vec_id, cl.cluster, sum((lv.x - cl.cx) * (lv.x - cl.cx)) AS r
      FROM lv JOIN cl ON lv.dim = cl.dim GROUP BY lv.vec_id, cl.cluster),
asg AS (SELECT vec_id, cluster FROM (
          SELECT vec_id, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY round(r, 9), cluster) AS rn FROM d)
        WHERE rn = 1)"""

SQL_LABEL_CENTERS = SQL_LONG + """,
lc AS (SELECT label, dim, avg(x) AS cx FROM lv GROUP BY label, dim),
r AS (SELECT lv.vec_id, sum((lv.x - lc.cx) * (lv.x - lc.cx)) AS r
      FROM lv JOIN lc ON lv.label = lc.label AND lv.dim = lc.dim GROUP BY lv.vec_id)"""


def _emb(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings", spread=True)


def _label_center_dist(spark, sf_dir):
    """Each vector against the mean vector of its label (label centres: labels x dims, tiny)."""
    e = _emb(spark, sf_dir)
    cents = kmeans.centroids(e, "embedding", "label")
    c = (cents.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("s"))
         .select("label", F.transform("s", lambda x: x["value"]).alias("center")))
    j = e.join(c, "label")
    return j.select("vec_id", vx.squared_distance(vx.as_double_array("embedding"), F.col("center")).alias("r"))


@query("euclidean_distance", oracle=SQL_LABEL_CENTERS + """
SELECT vec_id, round(sqrt(r), 6) AS distance FROM r""")
def q_euclidean_distance(spark, sf_dir):
    return _label_center_dist(spark, sf_dir).select("vec_id", F.round(vx.rdist_to_dist(F.col("r")), 6).alias("distance"))


@query("squared_distance", oracle=SQL_LABEL_CENTERS + """
SELECT vec_id, round(r, 6) AS rdist FROM r""")
def q_squared_distance(spark, sf_dir):
    return _label_center_dist(spark, sf_dir).select("vec_id", F.round("r", 6).alias("rdist"))


@query("distance_convert", oracle=SQL_LABEL_CENTERS + """
SELECT vec_id, round(sqrt(r) * sqrt(r), 6) AS rdist_back, round(sqrt(r), 6) AS dist FROM r""")
def q_distance_convert(spark, sf_dir):
    d = _label_center_dist(spark, sf_dir).withColumn("dist", vx.rdist_to_dist(F.col("r")))
    return d.select("vec_id", F.round(vx.dist_to_rdist(F.col("dist")), 6).alias("rdist_back"),
                    F.round("dist", 6).alias("dist"))


@query("kmeans_assign", oracle=SQL_ASSIGN + """
SELECT vec_id, cluster FROM asg""")
def q_kmeans_assign(spark, sf_dir):
    e = _emb(spark, sf_dir)
    centers = kmeans.first_k_centers(e, K, "vec_id", "embedding")
    return kmeans.assign(e, centers).select("vec_id", "cluster")


@query("kmeans_lloyd_step", oracle=SQL_ASSIGN + """
SELECT CAST(a.cluster AS INTEGER) AS cluster, lv.dim, round(avg(lv.x), 6) AS value
FROM asg a JOIN lv USING (vec_id) GROUP BY a.cluster, lv.dim""")
def q_kmeans_lloyd_step(spark, sf_dir):
    e = _emb(spark, sf_dir)
    centers = kmeans.first_k_centers(e, K, "vec_id", "embedding")
    return kmeans.lloyd_step(e, centers).select("cluster", "dim", F.round("value", 6).alias("value"))


def _sql_next(n: int) -> str:
    """Assignments ``asg{n}`` to the means of the assignments before."""
    before = f"asg{n - 1}" if n > 1 else "asg"
    return f""",
cl{n} AS (SELECT a.cluster, lv.dim, avg(lv.x) AS cx FROM {before} a JOIN lv USING (vec_id) GROUP BY a.cluster, lv.dim),
d{n} AS (SELECT lv.vec_id, c.cluster, sum((lv.x - c.cx) * (lv.x - c.cx)) AS r
       FROM lv JOIN cl{n} c ON lv.dim = c.dim GROUP BY lv.vec_id, c.cluster),
asg{n} AS (SELECT vec_id, cluster FROM (
           SELECT vec_id, cluster, row_number() OVER (PARTITION BY vec_id ORDER BY round(r, 9), cluster) AS rn FROM d{n})
         WHERE rn = 1)"""


@query("kmeans_fixed_start", oracle=SQL_ASSIGN + _sql_next(1) + _sql_next(2) + """
SELECT vec_id, cluster FROM asg2""")
def q_kmeans_fixed_start(spark, sf_dir):
    """C1 labels after two iterations from the vectors of the smallest ids."""
    from pyspark.ml.functions import array_to_vector
    e = read_table(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", array_to_vector(vx.as_double_array("embedding")).alias("features"))
    start = kmeans.first_k_centers(e, K, "vec_id", "embedding")
    return kmeans.kmeans_fit(e, max_iter=2, tol=0.0, start=start, id_col="vec_id")[1].select("vec_id", "cluster")


@query("kmeans_fit", oracle="""
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad_label, CAST(0 AS BIGINT) AS n_misassigned FROM embeddings""")
def q_kmeans_fit(spark, sf_dir):
    """C1 invariants as one row: every label in [0, k) and every point at its nearest
    fitted centre (checked independently of the model's own predict)."""
    from pyspark.ml.functions import array_to_vector
    e = _emb(spark, sf_dir).withColumn("features", array_to_vector(vx.as_double_array("embedding")))
    model, lab = kmeans.kmeans_fit(e, "features", k=K)
    centers = [list(map(float, c)) for c in model.clusterCenters()]
    chk = kmeans.assign(lab.drop("features"), centers, out_col="nearest")
    return chk.agg(F.count(F.lit(1)).alias("n_rows"),
                   F.count_if((F.col("cluster") < 0) | (F.col("cluster") >= K)).alias("n_bad_label"),
                   F.count_if(F.col("cluster") != F.col("nearest")).alias("n_misassigned"))


@query("pairwise_within", oracle=SQL_LONG + f"""
SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS distance
FROM lv a JOIN lv b ON a.dim = b.dim AND a.vec_id < b.vec_id
GROUP BY a.vec_id, b.vec_id HAVING sum((a.x - b.x) * (a.x - b.x)) <= {RANGE_T} * {RANGE_T}""")
def q_pairwise_within(spark, sf_dir):
    out = distances.pairs_within(_emb(spark, sf_dir), RANGE_T)
    return out.select("id_a", "id_b", F.round("distance", 6).alias("distance"))


@query("cross_knn", oracle=SQL_LONG + f""",
pairs AS (
  SELECT a.vec_id AS left_id, b.vec_id AS right_id, sum((a.x - b.x) * (a.x - b.x)) AS r
  FROM lv a JOIN lv b ON a.dim = b.dim
  WHERE a.label % 2 = 0 AND b.label % 2 = 1
  GROUP BY a.vec_id, b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(r, 9), right_id) AS rank FROM pairs)
SELECT left_id, CAST(rank AS BIGINT) AS rank, right_id, round(sqrt(r), 6) AS distance FROM ranked WHERE rank <= {KNN_K}""")
def q_cross_knn(spark, sf_dir):
    """Even-label vectors (left) against odd-label vectors (right)."""
    e = _emb(spark, sf_dir)
    left, right = e.filter(F.col("label") % 2 == 0), e.filter(F.col("label") % 2 == 1)
    out = distances.cross_knn(left, right, KNN_K)
    return out.select("left_id", "rank", "right_id", F.round("distance", 6).alias("distance"))


@query("vector_center", oracle=SQL_LONG + """
SELECT dim, round(avg(x), 6) AS mean FROM lv GROUP BY dim""")
def q_vector_center(spark, sf_dir):
    return projection.vector_mean(_emb(spark, sf_dir)).select("dim", F.round("mean", 6).alias("mean"))


@query("vector_cov", oracle=SQL_LONG + """
SELECT a.dim AS i, b.dim AS j, round(covar_samp(a.x, b.x), 6) AS cov
FROM lv a JOIN lv b ON a.vec_id = b.vec_id GROUP BY a.dim, b.dim""")
def q_vector_cov(spark, sf_dir):
    return projection.vector_cov(_emb(spark, sf_dir)).select("i", "j", F.round("cov", 6).alias("cov"))


@query("pca_project", oracle="""
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad_mean, CAST(0 AS BIGINT) AS n_bad_corr,
       CAST(0 AS BIGINT) AS n_bad_order FROM embeddings""")
def q_pca_project(spark, sf_dir):
    """R1 invariants: zero mean, uncorrelated, variance of x >= variance of y."""
    p = projection.pca_project(_emb(spark, sf_dir))
    s = p.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("dim_x").alias("mx"), F.avg("dim_y").alias("my"),
              F.corr("dim_x", "dim_y").alias("c"), F.var_samp("dim_x").alias("vx"), F.var_samp("dim_y").alias("vy"))
    return s.select("n_rows",
                    (F.abs("mx") + F.abs("my") > 1e-9).cast("long").alias("n_bad_mean"),
                    (F.abs("c") > 1e-6).cast("long").alias("n_bad_corr"),
                    (F.col("vx") < F.col("vy")).cast("long").alias("n_bad_order"))


@query("pca_reduce")
def q_pca_reduce(spark, sf_dir):
    e = _emb(spark, sf_dir)
    n = e.count()
    return projection.pca_reduce(e, n).select("vec_id", "reduced")


MIN_SAMPLES = 5


@query("core_distance", oracle=SQL_LONG + f""",
pairs AS (
  SELECT a.vec_id AS id, b.vec_id AS other, sum((a.x - b.x) * (a.x - b.x)) AS r
  FROM lv a JOIN lv b ON a.dim = b.dim GROUP BY a.vec_id, b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(r, 9), other) AS rk FROM pairs)
SELECT id AS vec_id, round(sqrt(r), 6) AS core_distance FROM ranked WHERE rk = {MIN_SAMPLES}""")
def q_core_distance(spark, sf_dir):
    from ..operators.density import core_distances
    c = core_distances(_emb(spark, sf_dir), MIN_SAMPLES)
    return c.select("vec_id", F.round("core_distance", 6).alias("core_distance"))


@query("mutual_reachability", oracle=f"""
WITH pairs AS (
  SELECT a.vec_id AS id, b.vec_id AS other,
         list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d
  FROM embeddings a CROSS JOIN embeddings b),
core AS (SELECT id, d AS c FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(d, 9), other) AS rk FROM pairs)
         WHERE rk = {MIN_SAMPLES})
SELECT p.id AS id_a, p.other AS id_b, round(p.d, 6) AS distance, round(greatest(ca.c, cb.c, p.d), 6) AS weight
FROM pairs p JOIN core ca ON ca.id = p.id JOIN core cb ON cb.id = p.other
WHERE p.id < p.other AND p.d <= {RANGE_T}""")
def q_mutual_reachability(spark, sf_dir):
    from ..operators.density import mutual_reachability
    m = mutual_reachability(_emb(spark, sf_dir), MIN_SAMPLES, RANGE_T)
    return m.select("id_a", "id_b", F.round("distance", 6).alias("distance"), F.round("weight", 6).alias("weight"))


@query("density_cluster", oracle="""
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad_label, CAST(0 AS BIGINT) AS n_small FROM embeddings""")
def q_density_cluster(spark, sf_dir):
    """C2 invariants: every row labelled in [-1, K) and every cluster holds at least
    min_cluster_size = max(5, n // 20) rows."""
    from ..operators.density import density_cluster
    e = _emb(spark, sf_dir)
    lab = density_cluster(e).select("vec_id", "cluster").persist()
    n = lab.count()
    m = max(5, n // 20)
    sizes = lab.filter(F.col("cluster") >= 0).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    k = sizes.count()
    small = sizes.filter(F.col("size") < m).agg(F.count(F.lit(1)).alias("n_small"))
    stats = lab.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count_if((F.col("cluster") < -1) | (F.col("cluster") >= F.lit(k))).alias("n_bad_label"))
    return stats.withColumn("n_small", F.lit(small.first()["n_small"]).cast("long"))


PLANTED_NOISE = 97


@query("density_planted", oracle=f"""
WITH named AS (SELECT vec_id, label, vec_id % {PLANTED_NOISE} = 0 AS far FROM embeddings),
firsts AS (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS cluster FROM named WHERE NOT far GROUP BY label)
SELECT n.vec_id, CAST(CASE WHEN n.far THEN -1 ELSE f.cluster END AS INTEGER) AS cluster
FROM named n LEFT JOIN firsts f USING (label)""")
def q_density_planted(spark, sf_dir):
    """C2 on the vectors drawn together around a place of their label, some of them thrown far away:
    every label is a cluster, numbered by its first vector, and what lies far away is noise."""
    from ..operators.density import density_cluster
    far = F.when(F.col("vec_id") % PLANTED_NOISE == 0, F.lit(1000.0) + F.col("vec_id")).otherwise(F.lit(0.0))
    place = F.array(F.col("label") * 4.0, far)
    near = F.transform(vx.as_double_array("embedding"), lambda x: x * 0.3)
    moved = _emb(spark, sf_dir).select("vec_id", F.concat(near, place).alias("embedding"))
    return density_cluster(moved).select("vec_id", "cluster")


@query("pca_reduce_variances", oracle="""
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad_mean, CAST(0 AS BIGINT) AS n_bad_cov, CAST(0 AS BIGINT) AS n_bad_order,
       CAST(0 AS BIGINT) AS n_bad_total FROM embeddings""")
def q_pca_reduce_variances(spark, sf_dir):
    """R2 invariants: the reduced columns have mean 0, are uncorrelated, fall in variance, and hold no more of it than there is
    but at least their share by number."""
    e = _emb(spark, sf_dir)
    n = e.count()
    reduced = projection.pca_reduce(e, n).select("reduced")
    means = projection.vector_mean(reduced, "reduced").agg(F.count_if(F.abs("mean") > 1e-9).alias("n_bad_mean"))
    cov = projection.vector_cov(reduced, "reduced").persist()
    own = cov.where("i = j").select(F.col("i").alias("k"), F.col("cov").alias("var"))
    following = own.select((F.col("k") - 1).alias("k"), F.col("var").alias("next"))
    order = own.join(following, "k").agg(F.count_if(F.col("var") < F.col("next") - 1e-12).alias("n_bad_order"))
    off = cov.agg(F.count_if((F.col("i") != F.col("j")) & (F.abs("cov") > 1e-9)).alias("n_bad_cov"))
    held = own.agg(F.sum("var").alias("held"), F.count("*").alias("k")).first()
    total = projection.vector_cov(e).where("i = j").agg(F.sum("cov").alias("all"), F.count("*").alias("d")).first()
    bad = not total["all"] * held["k"] / total["d"] - 1e-9 <= held["held"] <= total["all"] + 1e-9
    counts = [t.first()[0] for t in (means, off, order)]  # one row each
    cov.unpersist()
    return e.agg(F.count("*").alias("n_rows"), *[F.lit(c).cast("long").alias(name) for c, name in zip(
        [*counts, int(bad)], ["n_bad_mean", "n_bad_cov", "n_bad_order", "n_bad_total"])])
