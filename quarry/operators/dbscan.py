"""DBSCAN (K5) on a grid, exact, without all-pairs work inside a group.

Points are first reduced to distinct coordinates with a multiplicity, so
a value repeated by a third of all rows is one weighted point.  Grid
cells have side eps / sqrt(d): two points of one cell are always within
eps.  Hence

* a cell holding >= minPts points makes all its points core -- no pair is
  formed for it;
* only points of *sparse* cells (< minPts points each) count neighbours
  exactly, against the points of the cells within reach (a bounded set of
  offsets); the pairs per sparse point are bounded by the neighbour
  cells' sizes, the number of sparse points per cell by minPts;
* core points of one cell are connected to each other, so clusters are
  connected components over *cells*.  Two adjacent core cells are linked
  when some pair of their core points is within eps: first by a
  certificate on sub-cells (4^d per cell; a sub-cell pair whose farthest
  corners are within eps proves the link), and only the remaining
  ambiguous sub-cell pairs compare points;
* components: min-label propagation over the cell graph with pointer
  jumping; lineage is cut with a reliable checkpoint every round.
* border points (not core, a core point within eps) join the smallest
  cluster id among those core points; the rest is noise (0).

Cluster ids are numbered 1..K by each component's smallest cell key.
Supports 1 to 3 features (the reference presets three columns).
"""

from __future__ import annotations

import itertools
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.roles import col
from ..session import cut_lineage

SUB = 4  # sub-cells per axis for the link certificate


def _offsets(d: int) -> list[tuple[int, ...]]:
    r = int(math.floor(math.sqrt(d))) + 1
    out = []
    for o in itertools.product(range(-r, r + 1), repeat=d):
        if sum(max(abs(v) - 1, 0) ** 2 for v in o) <= d:   # min cell distance <= eps
            out.append(o)
    return out


def _dist2(a: list, b: list):
    s = None
    for x, y in zip(a, b):
        t = (x - y) * (x - y)
        s = t if s is None else s + t
    return s


def dbscan(df: DataFrame, features: list[str], eps: float = 0.5, min_pts: int = 5,
           out: str = "cluster") -> DataFrame:
    """Label every row of ``df`` (complete in ``features``) with its cluster (0 = noise)."""
    d = len(features)
    if not 1 <= d <= 3:
        raise ValueError("dbscan supports 1 to 3 features")
    if eps <= 0 or min_pts < 1:
        raise ValueError("eps must be > 0 and minPts >= 1")
    spark = df.sparkSession
    side = eps / math.sqrt(d)
    eps2 = eps * eps
    xs = [f"x{i}" for i in range(d)]
    cs = [f"c{i}" for i in range(d)]
    base = df.select(*[col(f).cast("double").alias(x) for f, x in zip(features, xs)]).na.drop()
    pts = (base.groupBy(*xs).agg(F.count(F.lit(1)).alias("w"))
           .select(*xs, "w", *[F.floor(F.col(x) / side).cast("long").alias(c) for x, c in zip(xs, cs)])
           .persist(StorageLevel.MEMORY_AND_DISK))
    cells = pts.groupBy(*cs).agg(F.sum("w").alias("cnt"))
    pts_c = pts.join(cells, cs)
    offs = _offsets(d)
    off_arr = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offs])

    # -- core status ---------------------------------------------------------
    sparse = pts_c.where(F.col("cnt") < min_pts)
    probe = (sparse.select(*[F.col(x).alias("p" + x) for x in xs], *[F.col(c).alias("p" + c) for c in cs],
                           F.explode(off_arr).alias("o"))
             .select("*", *[(F.col("p" + c) + F.col("o")[i]).alias(c) for i, c in enumerate(cs)]).drop("o"))
    near = (probe.join(pts.select(*xs, *cs, "w"), cs)
            .where(_dist2([F.col("p" + x) for x in xs], [F.col(x) for x in xs]) <= eps2))
    counts = near.groupBy(*["p" + x for x in xs]).agg(F.sum("w").alias("nb"))
    sparse_core = counts.where(F.col("nb") >= min_pts).select(*[F.col("p" + x).alias(x) for x in xs]) \
        .withColumn("core_s", F.lit(True))
    labeled = (pts_c.join(sparse_core, xs, "left")
               .withColumn("core", (F.col("cnt") >= min_pts) | F.coalesce("core_s", F.lit(False)))
               .drop("core_s").persist(StorageLevel.MEMORY_AND_DISK))
    core = labeled.where("core").select(*xs, *cs)

    # -- links between adjacent core cells -----------------------------------
    subw = side / SUB
    core_sub = core.select(*xs, *cs, *[F.floor(F.col(x) / subw).cast("long").alias("s" + x) for x in xs])
    core_cells = core.select(*cs).distinct()
    pair = (core_cells.select(*[F.col(c).alias("a" + c) for c in cs], F.explode(off_arr).alias("o"))
            .select("*", *[(F.col("a" + c) + F.col("o")[i]).alias("b" + c) for i, c in enumerate(cs)]).drop("o"))
    pair = pair.join(core_cells.select(*[F.col(c).alias("b" + c) for c in cs]), ["b" + c for c in cs])
    a_key = F.struct(*[F.col("a" + c) for c in cs])
    b_key = F.struct(*[F.col("b" + c) for c in cs])
    pair = pair.where(a_key < b_key)
    subs = core_sub.select(*cs, *["s" + x for x in xs]).distinct()
    sa = subs.select(*[F.col(c).alias("a" + c) for c in cs], *[F.col("s" + x).alias("as" + x) for x in xs])
    sb = subs.select(*[F.col(c).alias("b" + c) for c in cs], *[F.col("s" + x).alias("bs" + x) for x in xs])
    # bounded per cell pair: at most (4^d)^2 sub-cell pairs
    sp = pair.join(sa, ["a" + c for c in cs]).join(sb, ["b" + c for c in cs])
    gap = [F.greatest(F.abs(F.col("as" + x) - F.col("bs" + x)) - 1, F.lit(0)).cast("double") * subw for x in xs]
    span = [(F.abs(F.col("as" + x) - F.col("bs" + x)) + 1).cast("double") * subw for x in xs]
    mind2 = sum((g * g for g in gap[1:]), gap[0] * gap[0])
    maxd2 = sum((s * s for s in span[1:]), span[0] * span[0])
    # small margins keep the bounds safe against rounding of the sub-cell index
    sp = sp.withColumn("mind2", mind2).withColumn("maxd2", maxd2).where(F.col("mind2") <= eps2 * (1 + 1e-9))
    cell_cols = ["a" + c for c in cs] + ["b" + c for c in cs]
    certified = sp.where(F.col("maxd2") <= eps2 * (1 - 1e-9)).select(*cell_cols).distinct()
    ambiguous = sp.join(certified, cell_cols, "left_anti")
    pa = core_sub.select(*[F.col(c).alias("a" + c) for c in cs], *[F.col("s" + x).alias("as" + x) for x in xs],
                         *[F.col(x).alias("ax" + x) for x in xs])
    pb = core_sub.select(*[F.col(c).alias("b" + c) for c in cs], *[F.col("s" + x).alias("bs" + x) for x in xs],
                         *[F.col(x).alias("bx" + x) for x in xs])
    checked = (ambiguous.join(pa, ["a" + c for c in cs] + ["as" + x for x in xs])
               .join(pb, ["b" + c for c in cs] + ["bs" + x for x in xs])
               .where(_dist2([F.col("ax" + x) for x in xs], [F.col("bx" + x) for x in xs]) <= eps2)
               .select(*cell_cols).distinct())
    edges = certified.unionByName(checked).distinct()

    # -- connected components over core cells --------------------------------
    node = F.struct(*[F.col(c) for c in cs])
    nodes = core_cells.select(node.alias("n"))
    e = edges.select(F.struct(*[F.col("a" + c).alias(c) for c in cs]).alias("u"),
                     F.struct(*[F.col("b" + c).alias(c) for c in cs]).alias("v"))
    e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).persist(StorageLevel.MEMORY_AND_DISK)
    lab = cut_lineage(nodes.select(F.col("n"), F.col("n").alias("l")))
    it = 0
    while True:
        it += 1
        # min label over neighbours, then pointer jumping (label of the label)
        nb = e.join(lab.select(F.col("n").alias("v"), F.col("l").alias("lv")), "v") \
              .groupBy("u").agg(F.min("lv").alias("m"))
        new = (lab.join(nb.withColumnRenamed("u", "n"), "n", "left")
               .select("n", F.least("l", F.coalesce("m", "l")).alias("l")))
        jump = new.select(F.col("n").alias("l"), F.col("l").alias("ll"))
        new = new.join(jump, "l", "left").select("n", F.least("l", F.coalesce("ll", "l")).alias("l"))
        # the cell graph is small next to the data: a reliable checkpoint each round keeps
        # the plan flat (it would double every round otherwise)
        new = cut_lineage(new)
        changed = new.join(lab.withColumnRenamed("l", "old"), "n").where(F.col("l") != F.col("old")).limit(1).count()
        lab = new
        if changed == 0:
            break
    roots = lab.select("l").distinct()
    from ..functions.rowindex import with_row_index
    ids = with_row_index(roots.select("l", *[F.col("l")[c].alias(c) for c in cs]), [F.col(c) for c in cs],
                         "cid", bucket_key=F.col(cs[0]))
    cell_label = lab.join(ids.select("l", "cid"), "l").select(*[F.col("n")[c].alias(c) for c in cs], "cid")

    # -- border points and final labels ---------------------------------------
    core_pts = labeled.where("core").join(cell_label, cs).select(*xs, F.col("cid").alias("label"))
    non_core = labeled.where(~F.col("core")).select(*xs, *cs)
    nprobe = (non_core.select(*[F.col(x).alias("p" + x) for x in xs], *[F.col(c).alias("p" + c) for c in cs],
                              F.explode(off_arr).alias("o"))
              .select("*", *[(F.col("p" + c) + F.col("o")[i]).alias(c) for i, c in enumerate(cs)]).drop("o"))
    core_by_cell = labeled.where("core").join(cell_label, cs).select(*xs, *cs, F.col("cid"))
    border = (nprobe.join(core_by_cell, cs)
              .where(_dist2([F.col("p" + x) for x in xs], [F.col(x) for x in xs]) <= eps2)
              .groupBy(*["p" + x for x in xs]).agg(F.min("cid").alias("label"))
              .select(*[F.col("p" + x).alias(x) for x in xs], "label"))
    point_label = core_pts.unionByName(border)
    keyed = df.select("*", *[col(f).cast("double").alias("__" + x) for f, x in zip(features, xs)])
    pl = point_label.select(*[F.col(x).alias("__" + x) for x in xs], F.col("label").cast("int").alias(out))
    res = keyed.join(pl, ["__" + x for x in xs], "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))
    return res.drop(*["__" + x for x in xs])

