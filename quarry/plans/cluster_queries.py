"""Registered queries: clustering (K*, P14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as K
from ..operators import medoids as MD
from ..operators.columns import drop_noise
from . import fixtures as fx
from .registry import register, rounded, rsql

# planted clusters on events: 4 centres plus bounded jitter; every 97th event is noise (0)
CL_X = "(10.0 * (event_id % 4) + (value % 1.0))"
CL_Y = "(-5.0 * (event_id % 4) + ((value * 7) % 1.0))"
CL_C = "CASE WHEN event_id % 97 = 0 THEN 0 ELSE CAST(event_id % 4 + 1 AS INTEGER) END"
CL_SQL = f"(SELECT event_id, {CL_X} AS x, {CL_Y} AS y, {CL_C} AS cluster FROM events)"


def cl_frame(spark, sf):
    return fx.t(spark, sf, "events").select("event_id", F.expr(CL_X).alias("x"), F.expr(CL_Y).alias("y"),
                                            F.expr(CL_C).alias("cluster"))


@register("k1_prepare_zscore", rsql("""
SELECT (value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) AS value,
  (user_id - (SELECT avg(user_id) FROM events)) / (SELECT stddev_samp(user_id) FROM events) AS user_id, event_type
FROM events""", ["value", "user_id"]))
def k1_prepare(spark, sf):
    return rounded(K.prepare(fx.t(spark, sf, "events"), ["value", "user_id", "event_type"], "zscore"))


# the planted clusters are far apart: sizes and centres are known
PLANTED_SQL = rsql(f"""SELECT count(*) AS n, avg(x) AS x, avg(y) AS y FROM (SELECT event_id, {CL_X} AS x, {CL_Y} AS y FROM events) AS s
GROUP BY event_id % 4""", ["x", "y"], 6)


def _found(labelled, cluster):
    return rounded(labelled.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
                   .drop(cluster), 6)


@register("k2_kmeans_best_of_starts", PLANTED_SQL)
def k2_kmeans(spark, sf):
    df = cl_frame(spark, sf)
    fit = K.kmeans(df, ["x", "y"], k=4, n_starts=25)
    lab = K.assign_nearest(df, ["x", "y"], fit.centers, "kmeans_cluster")
    return _found(lab, "kmeans_cluster")


@register("k6_euclidean_distance_to_centre", rsql(f"""
SELECT event_id, sqrt(power(x - (SELECT avg(x) FROM {CL_SQL} AS a), 2) + power(y - (SELECT avg(y) FROM {CL_SQL} AS b), 2))
  AS distance FROM {CL_SQL} AS s""", ["distance"]))
def k6_euclid(spark, sf):
    df = cl_frame(spark, sf)
    m = df.agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return rounded(df.crossJoin(m)  # one-row side
                   .select("event_id", K.euclidean(["x", "y"], ["cx", "cy"]).alias("distance")))


@register("k7_gower_distance_to_point", rsql("""
WITH r AS (SELECT max(l_quantity) - min(l_quantity) AS rq, max(l_discount) - min(l_discount) AS rd FROM lineitem)
SELECT l_orderkey, l_linenumber, (abs(l_quantity - 25.0) / rq + abs(l_discount - 0.05) / rd
  + CASE WHEN l_returnflag <> 'N' THEN 1.0 ELSE 0.0 END + CASE WHEN l_linestatus <> 'O' THEN 1.0 ELSE 0.0 END) / 4
  AS gower FROM lineitem, r""", ["gower"]))
def k7_gower(spark, sf):
    li = fx.t(spark, sf, "lineitem")
    feats = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    rg = K.gower_ranges(li, feats)
    point = {"l_quantity": 25.0, "l_discount": 0.05, "l_returnflag": "N", "l_linestatus": "O"}
    return rounded(li.select("l_orderkey", "l_linenumber", K.gower_to(li, feats, point, rg).alias("gower")))


@register("k8_within_cluster_ss", rsql(f"""
SELECT cluster, count(*) AS n, coalesce(var_samp(x) * (count(x) - 1), 0) + coalesce(var_samp(y) * (count(y) - 1), 0)
  AS wss FROM {CL_SQL} AS s GROUP BY cluster""", ["wss"], 4))
def k8_wss(spark, sf):
    return rounded(K.within_ss(cl_frame(spark, sf), ["x", "y"]), 4)


SIL_SQL = f"""
WITH d AS (SELECT * FROM {CL_SQL} AS s WHERE cluster <> 0),
c AS (SELECT cluster, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(x * x + y * y) AS msq FROM d GROUP BY cluster),
md AS (SELECT d.event_id, d.cluster AS own, c.cluster, c.n,
              (d.x * d.x + d.y * d.y) - 2 * (d.x * c.mx + d.y * c.my) + c.msq AS m FROM d CROSS JOIN c),
ab AS (SELECT event_id, own,
         max(CASE WHEN cluster = own THEN CASE WHEN n > 1 THEN m * n / (n - 1.0) ELSE 0 END END) AS a,
         min(CASE WHEN cluster <> own THEN m END) AS b,
         max(CASE WHEN cluster = own THEN n END) AS n_own FROM md GROUP BY event_id, own)
SELECT event_id, own AS cluster, CASE WHEN n_own <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab"""


@register("k10_silhouette_per_row_sq_euclidean", rsql(SIL_SQL, ["silhouette"]))
def k10_silhouette(spark, sf):
    s = K.silhouette(cl_frame(spark, sf), ["x", "y"], "cluster", noise=0)
    return rounded(s.select("event_id", "cluster", "silhouette"))


@register("k9_mean_silhouette", rsql(f"SELECT avg(silhouette) AS silhouette FROM ({SIL_SQL}) AS t", ["silhouette"]))
def k9_mean_silhouette(spark, sf):
    v = K.mean_silhouette(cl_frame(spark, sf), ["x", "y"], "cluster", noise=0)
    return rounded(spark.createDataFrame([(v,)], "silhouette double"))


@register("k11_elbow_wss")
def k11_elbow(spark, sf):
    return rounded(K.elbow(cl_frame(spark, sf), ["x", "y"], ks=range(1, 11), n_starts=10), 2)


@register("k4_k12_hierarchical_micro_clusters", PLANTED_SQL)
def k4_hier(spark, sf):
    df = cl_frame(spark, sf)
    fit = K.hierarchical(df, ["x", "y"], k=4, method="ward.D2", micro=100)
    lab = K.hierarchical_labels(df, fit, "hc")
    return _found(lab, "hc")


@register("k12_merge_heights_last20")
def k12_heights(spark, sf):
    fit = K.hierarchical(cl_frame(spark, sf), ["x", "y"], k=4, method="average", micro=100)
    return rounded(spark.createDataFrame(K.merge_heights(fit, 20), "idx int, height double"), 6)


@register("k3_clara_medoids_gower")
def k3_clara(spark, sf):
    li = fx.t(spark, sf, "lineitem")
    feats = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    fit = K.clara(li, feats, k=3, samples=5)
    lab = K.medoid_labels(li, fit)
    return lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


# groups far apart: the best medoids are the best of each group
_APART = """(SELECT event_id % 4 AS grp, 10.0 * (event_id % 4) + user_id % 7 AS x, CAST(CAST(floor(value) AS BIGINT) % 5 AS DOUBLE) AS y,
  substr('abcd', CAST(event_id % 4 + 1 AS INT), 1) AS g FROM events)"""


@register("k3_medoids_objective", rsql(f"""
WITH p AS (SELECT grp, x, y, count(*) AS w FROM {_APART} AS e GROUP BY grp, x, y),
r AS (SELECT max(x) - min(x) AS rx, max(y) - min(y) AS ry FROM p),
c AS (SELECT a.grp, b.x, b.y, sum(a.w * (abs(a.x - b.x) / rx + abs(a.y - b.y) / ry) / 3) AS cost
      FROM p AS a JOIN p AS b ON a.grp = b.grp CROSS JOIN r GROUP BY a.grp, b.x, b.y),
m AS (SELECT grp, min(cost) AS cost FROM c GROUP BY grp)
SELECT 4 AS k, sum(cost) AS objective, CAST(0 AS BIGINT) AS better_swaps FROM m""", ["objective"]))
def k3_objective(spark, sf):
    """Objective over all rows, and how many exchanges with a candidate would still lower it."""
    rows = spark.sql(f"SELECT x, y, g FROM {_APART.replace('events', '{events}')} AS e", events=fx.t(spark, sf, "events"))
    fit = MD.k_medoids(rows, ["x", "y", "g"], k=4)
    return rounded(spark.createDataFrame([(4, fit.objective, fit.better_swaps)], "k int, objective double, better_swaps long"))


@register("k3_medoids_whole_table")
def k3_medoids(spark, sf):
    """Sizes and costs of the clusters of all rows, by their medoids."""
    li = fx.t(spark, sf, "lineitem")
    feats = ["l_quantity", "l_discount", "l_returnflag", "l_linestatus"]
    lab = K.medoid_labels(li, MD.k_medoids(li, feats, k=3))
    return rounded(lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("medoid_distance").alias("cost")))


# two features: the eigenvectors of a 2 x 2 covariance matrix have a closed form
PCA_SQL = f"""
WITH d AS (SELECT event_id, x, y FROM {CL_SQL} AS s),
m AS (SELECT avg(x) AS mx, avg(y) AS my, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM d),
e AS (SELECT *, (a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b) AS l1,
              (a + c) / 2 - sqrt(power((a - c) / 2, 2) + b * b) AS l2 FROM m),
v AS (SELECT *, b / sqrt(b * b + power(l1 - a, 2)) AS v1x, (l1 - a) / sqrt(b * b + power(l1 - a, 2)) AS v1y,
              b / sqrt(b * b + power(l2 - a, 2)) AS v2x, (l2 - a) / sqrt(b * b + power(l2 - a, 2)) AS v2y FROM e),
s AS (SELECT *, CASE WHEN (abs(v1x) >= abs(v1y) AND v1x < 0) OR (abs(v1y) > abs(v1x) AND v1y < 0)
                     THEN -1 ELSE 1 END AS s1,
               CASE WHEN (abs(v2x) >= abs(v2y) AND v2x < 0) OR (abs(v2y) > abs(v2x) AND v2y < 0)
                     THEN -1 ELSE 1 END AS s2 FROM v)
SELECT event_id, s1 * ((x - mx) * v1x + (y - my) * v1y) AS PC1, s2 * ((x - mx) * v2x + (y - my) * v2y) AS PC2
FROM d, s"""


@register("k13_pca_scores", rsql(PCA_SQL, ["PC1", "PC2"], 6))
def k13_pca(spark, sf):
    df = cl_frame(spark, sf)
    fit = K.pca(df, ["x", "y"])
    return rounded(K.pca_scores(df, fit, keep=["event_id"]), 6)


@register("k14_cluster_profiles", rsql(f"""
SELECT cluster, 'x' AS feature, avg(x) AS mean FROM {CL_SQL} AS s WHERE cluster <> 0 GROUP BY cluster
UNION ALL SELECT cluster, 'y', avg(y) FROM {CL_SQL} AS s WHERE cluster <> 0 GROUP BY cluster""", ["mean"]))
def k14_profiles(spark, sf):
    return rounded(K.profiles(cl_frame(spark, sf), ["x", "y"]))


@register("k15_cluster_and_noise_counts", f"""
SELECT count(DISTINCT CASE WHEN cluster <> 0 THEN cluster END) AS n_clusters,
  count(*) FILTER (WHERE cluster = 0) AS n_noise FROM {CL_SQL} AS s""")
def k15_counts(spark, sf):
    return K.cluster_counts(cl_frame(spark, sf))


@register("p14_drop_noise_rows", rsql(f"SELECT * FROM {CL_SQL} AS s WHERE cluster <> 0", ["x", "y"]))
def p14_drop_noise(spark, sf):
    return rounded(drop_noise(cl_frame(spark, sf)))


# DBSCAN fixture: the planted clusters, with every 97th event moved away by value * 10 (noise)
DB_X = f"({CL_X} + CASE WHEN event_id % 97 = 0 THEN value * 10 ELSE 0.0 END)"
DB_Y = f"({CL_Y} + CASE WHEN event_id % 97 = 0 THEN value * 10 ELSE 0.0 END)"


@register("k5_dbscan_grid")
def k5_dbscan(spark, sf):
    from ..operators.dbscan import dbscan
    df = fx.t(spark, sf, "events").select("event_id", F.expr(DB_X).alias("x"), F.expr(DB_Y).alias("y"))
    lab = dbscan(df, ["x", "y"], eps=0.5, min_pts=5)
    return lab.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@register("k13_pca_scores_closed_form", rsql(PCA_SQL, ["PC1", "PC2"], 6))
def k13_pca_closed(spark, sf):
    df = cl_frame(spark, sf)
    fit = K.pca(df, ["x", "y"])
    return rounded(K.pca_scores(df, fit, keep=["event_id"]), 6)
