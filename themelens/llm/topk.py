"""Exact top-k by inner product: pivot-table elimination.

The distances of a vector to a set of pivots give, by the triangle inequality, a lower
bound of its distance to any other vector: the largest difference of their distances to one
pivot.  With the norms that is an upper bound of their inner product.  The origin is one
of the pivots, so the bound is never above the product of the norms.

Candidates lie in cells (the nearest of at most ``PIVOT_SAMPLE`` centres) and, within a cell,
in groups of about ``GROUP`` vectors by ranges of the distance to its centre; copies and hot
ranges are dealt to groups by a number of their own.  Of every group and cell the smallest and
largest distance to each pivot are kept.  A query first searches its own group, which gives
it a k-th score to beat; then it goes only to cells, and of these only to groups, whose
bound reaches that score.  Within a group it takes its candidates in the order of their
bounds, and stops exactly when no bound left reaches its k-th best score.

A task holds one group and one block of queries, both of bounded size.  Pivots and centres
come from a sample of ``PIVOT_SAMPLE`` vectors; they change the speed, never the result.

Defined results: vectors that are null, empty, or hold null or non-finite components take
no part, nor do rows with a null id; a candidate of another length than the query's is
none; several rows of one id are all candidates, and the smallest vector of them is the
query; a query without candidates gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, query, read

PIVOTS = 32
PIVOT_SAMPLE = 2048
#: Vectors in a group of candidates and queries in a block, about.
GROUP, BLOCK = 4096, 2048
#: Steps in which distances to a centre are counted.
BINS = 1024
#: Candidates that a query evaluates between two looks at its bounds.
STEP = 256

CELL = ["size", "cell"]
PLACE = [*CELL, "range", "share"]


class Landmarks(NamedTuple):
    """What vectors of one length are measured by."""

    pivots: np.ndarray
    centres: np.ndarray
    reach: float  # a usual distance to the nearest centre


class Search(NamedTuple):
    """Tables of one search: see ``prepare``."""

    placed: DataFrame
    asked: DataFrame
    home: DataFrame
    routes: DataFrame


def quantise(rows: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """id and v = floor(scale * component), without the rows that take no part."""
    vector = F.col(vector_col)
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return rows.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & ~bad).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def choose_landmarks(vectors: DataFrame, n: int, group: int) -> dict[int, Landmarks]:
    """By vector length: farthest-first pivots, and centres, out of the sample with the smallest hashes."""
    sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_SAMPLE).collect()
    out = {}
    for size in {len(r.v) for r in sample}:
        points = np.array([r.v for r in sample if len(r.v) == size], dtype=float)
        pivots = [np.zeros(size)]
        far = np.linalg.norm(points, axis=1)
        while len(pivots) <= min(PIVOTS, len(points)) and far.max() > 0:
            pivots.append(points[far.argmax()])
            far = np.minimum(far, np.linalg.norm(points - pivots[-1], axis=1))
        # as many cells as there are groups to fill, by this length's share of the sample
        centres = points[:max(1, -(-n * len(points) // (len(sample) * group)))]
        near = nearest(points, centres)[1]
        out[size] = Landmarks(np.array(pivots), centres, float(np.median(near)) or 1.0)
    return out


def landmarks_of(table: dict[int, Landmarks], size: int) -> Landmarks:
    """A length that the sample misses is measured from the origin alone."""
    origin = np.zeros((1, size))
    return table.get(size) or Landmarks(origin, origin, 1.0)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((points - p) ** 2).sum(axis=1) for p in pivots], axis=1))


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre (the first of equal ones) and the distance to it."""
    squares = -2.0 * (points @ centres.T) + (centres ** 2).sum(axis=1)
    cell = squares.argmin(axis=1)
    return cell, np.linalg.norm(points - centres[cell], axis=1)


def by_length(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix of the vectors of each length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy()
    flat, ends = column.flatten().to_numpy(), np.cumsum(sizes)
    return {int(s): (np.flatnonzero(sizes == s), np.stack([flat[e - s:e] for e in ends[sizes == s]]))
            for s in np.unique(sizes)}


def lists(matrix: np.ndarray) -> pa.Array:
    ends = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.ravel()))


def place(vectors: DataFrame, shared, with_distances: bool) -> DataFrame:
    """``vectors`` (id, v) with size, cell and bin, and the distances to the pivots where they are wanted."""

    def measure(batches):
        for batch in batches:
            for size, (at, v) in by_length(batch.column(1)).items():
                marks, points = landmarks_of(shared.value, size), v.astype(float)
                cell, away = nearest(points, marks.centres)
                step = (BINS * (away / (away + marks.reach))).astype(np.int32)
                own = batch.take(pa.array(at))
                columns = [own.column(0), own.column(1), pa.array(np.full(len(at), size, dtype=np.int32)),
                           pa.array(cell.astype(np.int32)), pa.array(step)]
                if with_distances:
                    columns.append(lists(distances(points, marks.pivots)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "v", *CELL, "bin", *(["far"] if with_distances else [])]
    more = ", far array<double>" if with_distances else ""
    return vectors.select("id", "v").mapInArrow(measure, f"id long, v array<long>, size int, cell int, bin int{more}")


def search_group(queries, candidates, pivots: np.ndarray, k: int, floors=None):
    """(query id, candidate id, score) of each query's ``k`` best in one group.

    What scores less than a query's floor may be left out.
    """
    q_ids, q = queries
    c_ids, c = candidates
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    qf, cf = q.astype(float), c.astype(float)
    q_far, c_far = distances(qf, pivots), distances(cf, pivots)
    c_norm = (cf ** 2).sum(axis=1)
    out = []
    for n in range(len(q)):
        low = np.zeros(len(c))
        for p in range(len(pivots)):
            np.maximum(low, np.abs(c_far[:, p] - q_far[n, p]), out=low)
        q_norm = float((qf[n] ** 2).sum())
        bound = (q_norm + c_norm - low ** 2) / 2
        bound += 1.0 + 1e-9 * (q_norm + c_norm)  # rounding errors never lower a bound below the score
        bound[c_ids == q_ids[n]] = -np.inf
        by_bound = np.argsort(-bound, kind="stable")
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        least = -np.inf if floors is None else floors[n]
        for at in range(0, len(by_bound), STEP):
            take = by_bound[at:at + STEP]
            if len(best) >= k:
                least = max(least, best[k - 1])
            if bound[take[0]] == -np.inf or bound[take[0]] < least:
                break
            take = take[bound[take] > -np.inf]
            ids, scores = np.concatenate([best_ids, c_ids[take]]), np.concatenate([best, c[take] @ q[n]])
            top = np.lexsort((ids, -scores))[:k]
            best_ids, best = ids[top], scores[top]
        out += zip([int(q_ids[n])] * len(best), best_ids.tolist(), best.tolist())
    return out


def ids_and_vectors(table) -> tuple[np.ndarray, np.ndarray]:
    """Of a group, whose vectors are all of one length."""
    (_, v), = by_length(table.column("v")).values()
    return table.column("id").to_numpy(), v


def home_search(asked: DataFrame, placed: DataFrame, shared, k: int) -> DataFrame:
    """Each query's best in its own group, and a row (query_id null) with the pivot ranges of each group."""
    schema = ("query_id long, vec_id long, score long, size int, cell int, range long, share int, n long, "
              "low array<double>, high array<double>")
    names = ["query_id", "vec_id", "score", *PLACE, "n", "low", "high"]

    def search(queries, candidates):
        if not candidates.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, types)})
        own = ids_and_vectors(candidates)
        pivots = landmarks_of(shared.value, own[1].shape[1]).pivots
        far = distances(own[1].astype(float), pivots)
        found = search_group(ids_and_vectors(queries), own, pivots, k) if queries.num_rows else []
        here = [candidates.column(c)[0].as_py() for c in PLACE]
        rows = [(*f, *here, None, None, None) for f in found]
        rows.append((None, None, None, *here, len(own[0]), far.min(axis=0).tolist(), far.max(axis=0).tolist()))
        return pa.table({c: pa.array(v, t) for c, t, v in zip(names, types, zip(*rows))})

    types = [pa.int64()] * 3 + [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.float64())] * 2
    return asked.select(*PLACE, "id", "v").groupBy(*PLACE).cogroup(
        placed.select(*PLACE, "id", "v").groupBy(*PLACE)).applyInArrow(search, schema)


def reaches(low, high):
    """Whether a query (far, norm, floor) may find its floor among vectors with these pivot ranges."""
    below = F.array_max(F.zip_with(low, F.col("far"), lambda x, y: x - y))
    above = F.array_max(F.zip_with(F.col("far"), high, lambda x, y: x - y))
    gap = F.greatest(F.lit(0.0), below, above)
    norms = F.col("norm") + F.pow(high[0], F.lit(2.0))  # the first pivot is the origin
    bound = (norms - gap * gap) / 2 + 1.0 + F.lit(1e-9) * norms
    return F.col("floor").isNull() | (bound >= F.col("floor"))


def prepare(vectors: DataFrame, is_query, k: int, group: int) -> tuple[Search, object]:
    """The vectors and queries with their places, what the queries' own groups hold, and where each query still has to look."""
    spark, n = vectors.sparkSession, vectors.count()
    shared = spark.sparkContext.broadcast(choose_landmarks(vectors, n, group))
    placed = materialise(place(vectors, shared, False).withColumn("row", F.monotonically_increasing_id()), "cells")
    in_cell = Window.partitionBy(*CELL).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    ranges = placed.groupBy(*CELL, "bin").agg(F.count("*").alias("n")).select(
        *CELL, "bin", F.floor(F.coalesce(F.sum("n").over(in_cell), F.lit(0)) / group).alias("range"),
        F.ceil(F.col("n") / group).cast("int").alias("shares"))
    ranges = materialise(ranges, "ranges")
    share = lambda *c: F.pmod(F.xxhash64(*c), "shares").cast("int").alias("share")
    asked = place(vectors.where(is_query).groupBy("id").agg(F.min("v").alias("v")), shared, True)
    asked = materialise(asked.join(ranges, [*CELL, "bin"]).select("id", "v", "far", *PLACE[:3], share("id")), "asked")
    placed = materialise(placed.join(ranges, [*CELL, "bin"]).select("id", "v", *PLACE[:3], share("row")), "placed")
    home = materialise(home_search(asked, placed, shared, k), "home")

    groups = home.where("query_id IS NULL").select(*PLACE, "n", "low", "high")
    ends = groups.select(*CELL, F.posexplode(F.arrays_zip("low", "high")).alias("at", "end")).groupBy(*CELL, "at").agg(
        F.min("end.low").alias("low"), F.max("end.high").alias("high"))
    end = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x[c])
    cells = ends.groupBy(*CELL).agg(end("low").alias("cell_low"), end("high").alias("cell_high"))
    floors = home.where("query_id IS NOT NULL").groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count("*") >= k, F.min("score")).alias("floor"))
    seekers = asked.join(floors, "id", "left").select(
        "id", "far", F.pow(F.col("far")[0], F.lit(2.0)).alias("norm"), "floor", "size",
        F.struct("cell", "range", "share").alias("home"))
    near = seekers.join(cells, "size").where(reaches(F.col("cell_low"), F.col("cell_high"))).drop("cell_low", "cell_high")
    routes = near.join(groups, CELL).where(reaches(F.col("low"), F.col("high")) & (F.struct("cell", "range", "share") != F.col("home")))
    return Search(placed, asked, home, materialise(routes.select("id", "floor", *PLACE, "n"), "routes")), shared


def top_k(rows: DataFrame, is_query, k: int = 5, scale: float = 256.0, id_col: str = "vec_id",
          vector_col: str = "embedding", group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` best rows but its own, ties to the smaller id.

    ``is_query``: condition on the column ``id``; ``group``: vectors in a group of candidates, about.
    """
    vectors = materialise(quantise(rows, scale, id_col, vector_col), "vectors")
    search, shared = prepare(vectors, is_query, k, group)
    visits = search.routes.groupBy(*PLACE).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    left = search.routes.select("id", "floor", *PLACE).join(visits, PLACE).withColumn(
        "block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).drop("blocks").join(search.asked.select("id", "v"), "id")
    right = search.placed.join(visits, PLACE).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def look(queries, candidates):
        found = []
        if queries.num_rows and candidates.num_rows:
            own = ids_and_vectors(candidates)
            floors = queries.column("floor").to_numpy().astype(float)  # null: not a number
            pivots = landmarks_of(shared.value, own[1].shape[1]).pivots
            found = search_group(ids_and_vectors(queries), own, pivots, k, np.where(np.isnan(floors), -np.inf, floors))
        columns = list(zip(*found)) or [(), (), ()]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    key = [*PLACE, "block"]
    away = left.select(*key, "id", "v", "floor").groupBy(*key).cogroup(right.select(*key, "id", "v").groupBy(*key)).applyInArrow(
        look, "query_id long, vec_id long, score long")
    best = away.union(search.home.where("query_id IS NOT NULL").select("query_id", "vec_id", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@query("op9_exact_top_k", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row of ``embeddings`` whose id is divisible by 50."""
    return top_k(read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 50 == 0)
