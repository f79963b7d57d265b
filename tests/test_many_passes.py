"""Learners of hundreds of passes: few tasks for few rows, and what is independent side by side."""

from pyspark.sql import functions as F

from quarry.operators import learners as LR


def _three_classes(spark, n=600):
    return spark.range(n).repartition(30).select(
        (F.col("id") % 50).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
        F.element_at(F.array(*[F.lit(c) for c in "pqr"]), (F.col("id") % 50 / 17 + 1).cast("int")).alias("c"))


def test_one_vs_rest_svms_train_side_by_side_on_few_parts(spark, monkeypatch):
    seen, fit = [], LR.OneVsRest.fit
    monkeypatch.setattr(LR.OneVsRest, "fit", lambda self, rows: seen.append((self.getParallelism(), rows.rdd.getNumPartitions())) or fit(self, rows))
    df = _three_classes(spark)
    t = LR.train(df, "c", ["a", "b"], "svm", task="classification")
    assert seen == [(3, 1)]
    got = t.predict(df, keep=["c"])
    assert got.count() == 600 and got.where("c = prediction").count() > 540


def test_kernel_features_keep_their_rows(spark):
    """Each mapped vector stays beside the columns of its own row."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from quarry.operators import gradient as GD
    km = GD.make_kernel("radial", [0.0, 0.0], [1.0, 1.0], 2, n_features=5, seed=1)
    df = spark.range(200).repartition(7).select(F.col("id"), array_to_vector(F.array(F.col("id") / 10, F.col("id") % 3 + 0.0)).alias("features"))
    rows = LR._kernel_features(df, km, 2).select("id", vector_to_array("features").alias("z")).collect()
    assert sorted(r.id for r in rows) == list(range(200))
    for r in rows:
        np.testing.assert_allclose(r.z, km.transform(np.array([[r.id / 10, r.id % 3]]))[0], atol=1e-12)


def test_a_pass_tells_all_splits_that_the_bins_of_one_feature_allow(spark, monkeypatch):
    """Splits near the ends of a node made as many passes over all rows as the chain of nodes was deep."""
    from quarry.operators import trees as TR
    passes, count = [], TR._count
    monkeypatch.setattr(TR, "_count", lambda *a: passes.append(len(a[2])) or count(*a))
    # a third of the values is in one bin of the table
    x = F.when(F.col("id") % 3 == 0, 500 + F.col("id") / 1e6).otherwise(F.col("id") % 1000).cast("double")
    df = spark.range(6000).repartition(4).select("id", x.alias("x"), (F.xxhash64("id") % 100).cast("double").alias("y"))
    t = LR.train(df, "y", ["x"], "rf", task="regression", params={"trees": 2, "mtry": 1, "bootstrap": False, "min_split": 2, "local_rows": 50})
    assert len(passes) <= 5
    got = t.predict(df, keep=["id", "x", "y"]).groupBy("x").agg(F.avg("y").alias("mean"), F.min("prediction").alias("a"), F.max("prediction").alias("b"))
    assert got.where((F.abs(F.col("mean") - F.col("a")) > 1e-9) | (F.abs(F.col("mean") - F.col("b")) > 1e-9)).count() == 0


def test_depth_and_rows_of_a_side_hold_within_a_pass(spark):
    df = spark.range(3000).repartition(3).select(F.col("id").cast("double").alias("x"), (F.col("id") % 97).cast("double").alias("y"))
    for local in (40, 65_536):
        m = LR.train(df, "y", ["x"], "rf", task="regression", params={"trees": 1, "mtry": 1, "bootstrap": False, "max_depth": 3, "local_rows": local}).model
        assert len(m.tops[0].feature) <= 15


def test_a_tree_of_one_number_is_the_tree_with_a_constant_beside_it():
    import numpy as np

    from quarry.operators import trees as TR
    g = np.random.default_rng(3)
    for classes, limits in ((0, TR.Limits(None, 2)), (3, TR.Limits(None, 2)), (0, TR.Limits(4, 20, 7)), (2, TR.Limits(5, 20, 7))):
        x, w = np.round(g.normal(size=800), 2), g.integers(0, 3, 800).astype(float)
        y = g.integers(0, classes, 800).astype(float) if classes else g.normal(size=800)
        a = TR.grow_local(x[:, None], y, w, TR.Shape((0,), classes), limits, 1, 1)
        b = TR.grow_local(np.column_stack([x, np.zeros(800)]), y, w, TR.Shape((0, 0), classes), limits, 2, 1)
        for name in ("feature", "left", "right", "larger_left", "cut"):
            np.testing.assert_array_equal(getattr(a, name), getattr(b, name))
        np.testing.assert_allclose(a.stats, b.stats, atol=1e-9)


def test_small_tables_are_boosted_in_one_piece(spark, monkeypatch):
    """Hundreds of passes of a job each cost more than a task that holds a bounded number of values."""
    import numpy as np

    from quarry.operators import boosting as BO
    from quarry.operators import trees as TR
    monkeypatch.setattr(TR, "LOCAL_ROWS", 10)
    cuts, cut = [], BO.cut_lineage
    monkeypatch.setattr(BO, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    df = _three_classes(spark)
    whole = LR.train(df, "c", ["a", "b"], "gbm", task="classification", params={"trees": 12}).model
    assert len(cuts) == 1
    blocks = LR.train(df, "c", ["a", "b"], "gbm", task="classification", params={"trees": 12, "local_rows": 10}).model
    assert len(cuts) > 3
    np.testing.assert_allclose(whole.deviances, blocks.deviances)
    np.testing.assert_allclose(whole.gains, blocks.gains, atol=1e-9)
    monkeypatch.setattr(BO, "LOCAL_VALUES", 100)
    assert BO.local_rows(whole.shape) == 16


def test_network_sums_of_few_parts_take_one_stage(spark, monkeypatch):
    import numpy as np

    from quarry.operators import gradient as GD
    from quarry.operators import network as NN
    g = np.random.default_rng(5)
    v = g.normal(size=(90, 3))
    blocks = GD.design_arrays(spark.createDataFrame(v.tolist(), "a double, b double, y double").repartition(4), ["a", "b"], "y")
    shape, points = NN.Shape(2, 2, 0), [g.normal(size=9), g.normal(size=9)]
    monkeypatch.setattr(NN, "FEW_PARTS", 0, raising=False)
    summed = NN.summed(blocks, shape, points)
    monkeypatch.setattr(NN, "FEW_PARTS", 64, raising=False)
    monkeypatch.setattr(NN.F, "posexplode", None)
    for (loss, gradient), (other, other_gradient), w in zip(NN.summed(blocks, shape, points), summed, points, strict=True):
        want = shape.loss(w, v[:, :2], v[:, 2])
        np.testing.assert_allclose([loss, other], want[0])
        np.testing.assert_allclose([gradient, other_gradient], [want[1], want[1]])


def test_radial_map_is_the_cosine():
    import math

    import numpy as np

    from quarry.operators import gradient as GD
    km = GD.make_kernel("radial", [1.0, -2.0], [0.5, 3.0], 2, n_features=7, seed=2)
    x = np.random.default_rng(1).normal(size=(1000, 2)) * [40, 5]
    want = math.sqrt(2 / 7) * np.cos((x - km.mean) / km.sd @ km.W + km.b)
    np.testing.assert_allclose(km.transform(x), want, atol=1e-12)
    assert km.transform(x[:0]).shape == (0, 7)
