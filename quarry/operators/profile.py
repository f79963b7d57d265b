"""Profiling and EDA statistics (survey 2.4): one wide aggregate per kind.

Every statistic for every column comes from a single ``agg`` (whole-stage
codegen, partial aggregation before the shuffle); quantiles come from
:mod:`quarry.functions.quantiles`; counts of distinct values and top
values go through the long form ``(column, value)`` so many columns do
not multiply rows through Expand.  Results are small long-form
DataFrames.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import moments
from ..functions.hotjoin import broadcast_if_small
from ..functions.quantiles import quantiles
from ..functions.roles import FLOAT_TYPES, col, dtype_of, missing, roles, type_name
from ..session import cut_lineage


def _clean(df: DataFrame, c: str):
    """Column value with NaN as NULL, as double."""
    x = col(c)
    if isinstance(dtype_of(df, c), FLOAT_TYPES):
        x = F.when(~F.isnan(x), x)
    return x.cast("double")


def _spark(df):
    return df.sparkSession


DESC_SCHEMA = T.StructType([
    T.StructField("variable", T.StringType()),
    T.StructField("n", T.LongType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("sd", T.DoubleType()),
    T.StructField("iqr", T.DoubleType()),
    T.StructField("skewness", T.DoubleType()),
    T.StructField("kurtosis", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("missing", T.LongType()),
    T.StructField("missing_pct", T.DoubleType()),
])


def moment_stats(df: DataFrame, cols: list[str]) -> dict:
    """One pass: n, mean, sd, var, skew/kurt (sample & population), min, max, missing."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(cols):
        x = _clean(df, c)
        aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"mean{i}"),
                 F.stddev_samp(x).alias(f"sd{i}"), F.var_samp(x).alias(f"var{i}"),
                 moments.sample_skewness(x).alias(f"skew{i}"),
                 moments.sample_kurtosis(x).alias(f"kurt{i}"),
                 F.skewness(x).alias(f"pskew{i}"), F.kurtosis(x).alias(f"pkurt{i}"),
                 F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
    r = df.agg(*aggs).collect()[0]
    out = {"__rows": r["__rows"]}
    for i, c in enumerate(cols):
        out[c] = {k: r[f"{k}{i}"] for k in
                  ("n", "mean", "sd", "var", "skew", "kurt", "pskew", "pkurt", "min", "max")}
        out[c]["missing"] = r["__rows"] - r[f"n{i}"]
    return out


def describe(df: DataFrame, cols: list[str] | None = None, extended: bool = True) -> DataFrame:
    """Descriptive statistics per numeric column (long form)."""
    num = cols if cols is not None else roles(df)[0]
    st = moment_stats(df, num)
    qs = quantiles(df, num, [0.25, 0.5, 0.75])
    rows = []
    n_rows = st["__rows"]
    for c in num:
        s = st[c]
        q1, med, q3 = qs.get(c, [None] * 3)
        rows.append((c, s["n"], s["mean"], med, s["sd"],
                     (q3 - q1) if q1 is not None else None,
                     s["skew"], s["kurt"], s["min"], s["max"], s["missing"],
                     (100.0 * s["missing"] / n_rows) if n_rows else None))
    out = _spark(df).createDataFrame(rows, DESC_SCHEMA)
    if not extended:
        out = out.select("variable", "mean", "median", "sd", "min", "max", "missing")
    return out


def _long_strings(df: DataFrame, cols: list[str]) -> DataFrame:
    """(variable, value) with every value as text, NaN/NULL as NULL."""
    structs = [F.struct(F.lit(c).alias("variable"), _text(df, c).alias("value")) for c in cols]
    return df.select(F.inline(F.array(*structs)))


def _text(df, c):
    x = col(c)
    if isinstance(dtype_of(df, c), FLOAT_TYPES):
        x = F.when(~F.isnan(x), x)
    return x.cast("string")


def column_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per column: rows, missing, distinct present values (exact).

    Long form + two-level groupBy: partial aggregation collapses repeated
    values before the shuffle; no Expand of many count_distinct.
    """
    cols = cols if cols is not None else df.columns
    lv = _long_strings(df, cols)
    per_value = lv.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("c"))
    return (per_value.groupBy("variable")
            .agg(F.sum("c").alias("rows"),
                 F.sum(F.when(F.col("value").isNull(), F.col("c")).otherwise(0)).alias("missing"),
                 F.count("value").alias("unique")))


def variable_types(df: DataFrame) -> DataFrame:
    """Type, unique (without missing), missing count and percent."""
    types = _spark(df).createDataFrame(
        [(f.name, type_name(f.dataType), i) for i, f in enumerate(df.schema.fields)],
        "variable string, type string, pos int")
    cc = column_counts(df)
    return (types.join(F.broadcast(cc), "variable", "left")
            .select("variable", "type", F.col("unique").cast("long").alias("n_unique"),
                    F.col("missing").cast("long").alias("n_missing"),
                    (F.col("missing") * 100.0 / F.col("rows")).alias("pct_missing"), "pos")
            .orderBy("pos").drop("pos"))


def variable_info(df: DataFrame) -> DataFrame:
    """Type, missing, unique where missing counts as one value."""
    vt = variable_types(df)
    return vt.select("variable", "type", F.col("n_missing").alias("missing"),
                     (F.col("n_unique") + F.when(F.col("n_missing") > 0, 1).otherwise(0))
                     .cast("long").alias("unique"))


def missing_summary(df: DataFrame) -> DataFrame:
    """T5: missing count/percent, type and complete count per column, by missing desc."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(df.columns):
        aggs.append(F.count_if(missing(df, c)).alias(f"m{i}"))
    r = df.agg(*aggs).collect()[0]
    n = r["__rows"]
    rows = [(c, type_name(dtype_of(df, c)), r[f"m{i}"], (100.0 * r[f"m{i}"] / n) if n else None,
             n - r[f"m{i}"], i) for i, c in enumerate(df.columns)]
    out = _spark(df).createDataFrame(
        rows, "variable string, type string, missing long, missing_pct double, complete long, pos int")
    return out.orderBy(F.desc("missing_pct"), "pos").drop("pos")


def duplicate_count(df: DataFrame) -> int:
    """Rows beyond the first of each group of identical rows."""
    r = (df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("c"))
         .agg(F.sum(F.col("c") - 1).alias("d")).collect()[0]["d"])
    return int(r or 0)


def duplicate_rows(df: DataFrame) -> DataFrame:
    """T6 as a DataFrame (one row)."""
    return (df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("c"))
            .agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, missing share, duplicates."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs.append(sum((F.count_if(missing(df, c)) for c in df.columns), F.lit(0)).alias("cells_missing")
                if df.columns else F.lit(0).alias("cells_missing"))
    base = df.agg(*aggs)
    dup = duplicate_rows(df)
    ncol = len(df.columns)
    num, cat, _ = roles(df)
    return (base.crossJoin(dup)  # one row x one row
            .select(F.col("rows").cast("long").alias("n_rows"), F.lit(ncol).cast("long").alias("n_cols"),
                    F.lit(len(num)).cast("long").alias("n_numeric"),
                    F.lit(len(cat)).cast("long").alias("n_categorical"),
                    F.col("cells_missing").cast("long").alias("total_missing"),
                    F.try_divide(F.col("cells_missing") * 100.0, F.col("rows") * F.lit(ncol)).alias("missing_pct"),
                    "duplicate_rows"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with exactly one distinct present value."""
    one = [F.struct(F.lit(c).alias("variable"), (F.min(_text(df, c)) == F.max(_text(df, c))).alias("same"))
           for c in df.columns]
    return df.agg(F.array(*one).alias("a")).select(F.inline("a")).where("same").select("variable")


def high_missing_columns(df: DataFrame, threshold_pct: float = 30.0) -> DataFrame:
    """Columns whose missing percent is above the threshold (30 live, 20 report)."""
    shares = [F.struct(F.lit(c).alias("variable"),
                       F.try_divide(F.count_if(_text(df, c).isNull()) * 100.0, F.count(F.lit(1)))
                       .alias("missing_pct")) for c in df.columns]
    return (df.agg(F.array(*shares).alias("a")).select(F.inline("a")).where(F.col("missing_pct") > threshold_pct))


def skewness_table(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """E3/E4 per column in the reference's sample-sd form (one pass)."""
    num = cols if cols is not None else roles(df)[0]
    structs = [F.struct(F.lit(c).alias("variable"),
                        moments.sample_skewness(_clean(df, c)).alias("skewness"),
                        moments.sample_kurtosis(_clean(df, c)).alias("kurtosis")) for c in num]
    return df.agg(F.array(*structs).alias("a")).select(F.inline("a"))


def skewed_columns(df: DataFrame, cols: list[str] | None = None, threshold: float = 1.0) -> DataFrame:
    """abs(skewness) > threshold, direction right (> t) / left (< -t)."""
    return (skewness_table(df, cols).where(F.abs("skewness") > threshold)
            .select("variable", "skewness",
                    F.when(F.col("skewness") > 0, "right").otherwise("left").alias("direction")))


def zero_variance_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Numeric columns whose sample variance is exactly 0."""
    num = cols if cols is not None else roles(df)[0]
    # by the values: merged partial variances of equal values need not be 0 to the last bit
    structs = [F.struct(F.lit(c).alias("variable"), F.min(_clean(df, c)).alias("lo"), F.max(_clean(df, c)).alias("hi"),
                        F.count(_clean(df, c)).alias("n")) for c in num]
    return (df.agg(F.array(*structs).alias("a")).select(F.inline("a"))
            .where((F.col("lo") == F.col("hi")) & (F.col("n") > 1)).select("variable"))


def outlier_share(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """E17 base: per column, share of present values outside the 1.5 IQR fences."""
    num = cols if cols is not None else roles(df)[0]
    qs = quantiles(df, num, [0.25, 0.75])
    structs = []
    for c in num:
        q1, q3 = qs[c]
        x = _clean(df, c)
        if q1 is None:
            share = F.lit(None).cast("double")
        else:
            iq = q3 - q1
            share = F.avg(F.when(x.isNotNull(),
                                 ((x < q1 - 1.5 * iq) | (x > q3 + 1.5 * iq)).cast("double")))
        structs.append(F.struct(F.lit(c).alias("variable"), F.count(x).alias("n"),
                                share.alias("outlier_share")))
    return df.agg(F.array(*structs).alias("a")).select(F.inline("a"))


def outlier_prone_columns(df: DataFrame, cols=None, share: float = 0.05, min_n: int = 10) -> DataFrame:
    """Share by IQR rule > 5% and at least 10 values."""
    return (outlier_share(df, cols).where((F.col("n") >= min_n) & (F.col("outlier_share") > share))
            .select("variable", "outlier_share"))


def variance_ranking(df: DataFrame, cols: list[str] | None = None, top: int | None = None) -> DataFrame:
    """Var / (max - min + 1e-10), descending (top 5 shown by the report)."""
    num = cols if cols is not None else roles(df)[0]
    structs = []
    for c in num:
        x = _clean(df, c)
        score = F.when(F.count(x) >= 2, F.var_samp(x) / (F.max(x) - F.min(x) + F.lit(1e-10)))
        structs.append(F.struct(F.lit(c).alias("variable"), score.alias("score")))
    out = df.agg(F.array(*structs).alias("a")).select(F.inline("a")).where(F.col("score").isNotNull())
    out = out.orderBy(F.desc("score"), "variable")
    return out.limit(top) if top else out


def _top_per_variable(counts: DataFrame, variables: list[str], k: int) -> DataFrame:
    """Top ``k`` (count desc, value asc, missing last) per variable.

    One ``orderBy().limit(k)`` per variable: each task keeps at most k rows
    (TakeOrderedAndProject), so a column with billions of distinct values
    never lands whole in one window partition.
    """
    order = [F.desc("count"), F.col("value").asc_nulls_last()]
    parts = [counts.where(F.col("variable") == F.lit(v)).orderBy(*order).limit(k) for v in variables]
    if not parts:
        return counts.limit(0).withColumn("rank", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy("variable").orderBy(*order)   # at most k rows per variable here
    return out.withColumn("rank", F.row_number().over(w))


def categorical_summary(df: DataFrame, cols: list[str] | None = None, top: int = 5) -> DataFrame:
    """Unique count and top values with counts (missing is a value).

    Ties in count are broken by value (ascending, missing last).
    """
    cat = cols if cols is not None else roles(df)[1]
    lv = _long_strings(df, cat)
    counts = lv.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))
    uniq = counts.groupBy("variable").agg(F.count("value").alias("n_unique"))
    return (_top_per_variable(counts, cat, top)
            .join(uniq, "variable")
            .select("variable", "n_unique", F.col("rank").cast("long").alias("rank"), "value",
                    F.col("count").cast("long").alias("count")))


def correlation_matrix(df: DataFrame, cols: list[str] | None = None, method: str = "pearson",
                       use: str = "complete") -> DataFrame:
    """Correlation matrix in long form (var1, var2, correlation).

    ``use="complete"``: rows complete in all columns (listwise);
    ``use="pairwise"``: each pair over the rows where both are present.
    Spearman = Pearson on average ranks (ties get the mean rank); Kendall = tau-b.
    """
    num = cols if cols is not None else roles(df)[0]
    if len(num) < 2:
        return _spark(df).createDataFrame([], "var1 string, var2 string, correlation double")
    data = df.select(*[_clean(df, c).alias(c) for c in num])
    if use == "complete":
        from .cleaning import drop_incomplete
        data = drop_incomplete(data)
    if method == "kendall":
        from .kendall import kendall_matrix
        return kendall_matrix(data, num)
    if method == "spearman":
        data = average_ranks(data, num, pairwise=(use == "pairwise"))
    elif method != "pearson":
        raise ValueError(f"Unsupported correlation method: {method}")
    if use == "complete":
        # rows are complete: every pair comes from one centred cross-product matrix
        # (p(p+1)/2 sums) instead of p^2 masked correlation aggregates
        from .linear import _moments
        _, _, G = _moments(data, num)
        rows = []
        for i, a in enumerate(num):
            for j, b in enumerate(num):
                den = G[i, i] * G[j, j]
                r = (1.0 if i == j else float(G[i, j] / den ** 0.5)) if den > 0 else None
                rows.append((a, b, r))
        return _spark(df).createDataFrame(rows, "var1 string, var2 string, correlation double")
    structs = []
    for i, a in enumerate(num):
        for j, b in enumerate(num):
            r = F.lit(1.0) if i == j else moments.safe_corr(col(a), col(b))
            if i == j:
                r = F.when(F.stddev_samp(col(a)) > 0, F.lit(1.0))
            structs.append(F.struct(F.lit(a).alias("var1"), F.lit(b).alias("var2"),
                                    r.cast("double").alias("correlation")))
    return data.agg(F.array(*structs).alias("a")).select(F.inline("a"))


def average_ranks(df: DataFrame, cols: list[str], pairwise: bool = False) -> DataFrame:
    """Replace each column by its average rank (1-based; ties share the mean rank).

    Ranks are computed per column over its distinct values (counts, then
    running sums by blocks) and joined back on the value itself, so no
    row id is needed.
    """
    if pairwise:
        raise ValueError("Spearman with pairwise deletion is not supported; use complete rows")
    out = df.select(*[col(c) for c in cols])
    for i, c in enumerate(cols):
        vc = df.groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("c"))
        ranked = _value_ranks(vc).withColumnRenamed("v", f"__v{i}").withColumnRenamed("rank", f"__r{i}")
        out = out.join(ranked, out[c] == ranked[f"__v{i}"]).drop(c, f"__v{i}").withColumnRenamed(f"__r{i}", c)
    return out.select(*[col(c) for c in cols])


def _value_ranks(vc: DataFrame) -> DataFrame:
    """Average rank per distinct value from (v, c) counts via a row index on v."""
    from ..functions.rowindex import with_row_index
    idx = with_row_index(vc, ["v"], "__i")
    # cumulative count before each value = sum of counts of smaller values;
    # computed as bucket-level prefix by a second index over expanded counts
    w = idx.select("v", "c", "__i")
    cum = _prefix_sum(w, "__i", "c")
    return cum.select("v", ((F.col("before") + 1 + F.col("before") + F.col("c")) / 2.0).alias("rank"))


def _prefix_sum(df: DataFrame, order: str, val: str, block: int = 100_000) -> DataFrame:
    """Exclusive prefix sum of ``val`` in ``order`` (1..n index), by blocks.

    Sum per block of ``block`` consecutive indices, running total of the block sums, then a window
    inside each block.  The block sums go the same way over blocks of blocks, so that no window
    has more than ``block`` rows; they are broadcast only while they are few.
    """
    b = F.floor((F.col(order) - 1) / block)
    blocks = cut_lineage(df.groupBy(b.alias("__blk")).agg(F.sum(val).alias("__s")))
    few = blocks.count()
    if few <= block:
        wb = Window.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
        offsets = blocks.select("__blk", F.coalesce(F.sum("__s").over(wb), F.lit(0)).alias("__off"))
    else:
        summed = _prefix_sum(blocks.select((F.col("__blk") + 1).alias("__o"), "__s"), "__o", "__s", block)
        offsets = summed.select((F.col("__o") - 1).alias("__blk"), F.col("before").alias("__off"))
    wi = Window.partitionBy("__blk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("__blk", b).join(broadcast_if_small(offsets, few), "__blk")
            .withColumn("before", F.col("__off") + F.coalesce(F.sum(val).over(wi), F.lit(0)))
            .drop("__blk", "__off"))


def high_correlation_pairs(df: DataFrame, cols=None, threshold: float = 0.8) -> DataFrame:
    """Upper-triangle pairs with abs(r) > threshold, with a label."""
    num = cols if cols is not None else roles(df)[0]
    pos = {c: i for i, c in enumerate(num)}
    m = correlation_matrix(df, num, "pearson", "complete")
    order = _spark(df).createDataFrame([(c, i) for c, i in pos.items()], "v string, i int")
    return (m.join(F.broadcast(order.withColumnRenamed("v", "var1").withColumnRenamed("i", "i1")), "var1")
            .join(F.broadcast(order.withColumnRenamed("v", "var2").withColumnRenamed("i", "i2")), "var2")
            .where((F.col("i1") < F.col("i2")) & (F.abs("correlation") > threshold))
            .select("var1", "var2", "correlation",
                    F.format_string("%s ~ %s (r = %.2f)", "var1", "var2", "correlation").alias("label")))


def auto_eda(df: DataFrame, high_missing_pct: float = 20.0) -> DataFrame:
    """Bundle as a long DataFrame (section, key, value)."""
    spark = _spark(df)
    num, cat, _ = roles(df)
    rows = []
    ov = overview(df).collect()[0].asDict()
    for k in ("n_rows", "n_cols", "n_numeric", "n_categorical", "total_missing", "missing_pct",
              "duplicate_rows"):
        v = ov[k]
        rows.append(("profile", k, str(round(v, 1)) if isinstance(v, float) else str(v)))
    issues = []
    hm = [r["variable"] for r in high_missing_columns(df, high_missing_pct).collect()]
    if hm:
        issues.append("many values missing: " + ", ".join(hm))
    if ov["duplicate_rows"] > 0:
        issues.append("rows that repeat others: %d" % ov["duplicate_rows"])
    if num:
        zv = [r["variable"] for r in zero_variance_columns(df, num).collect()]
        if zv:
            issues.append("constant: " + ", ".join(zv))
        op = [r["variable"] for r in outlier_prone_columns(df, num).collect()]
        if op:
            issues.append("more than 5%% outliers: %s" % ", ".join(op))
    for s in issues or ["none found"]:
        rows.append(("issues", "issue", s))
    if num:
        for r in skewed_columns(df, num).collect():
            rows.append(("skewed_" + r["direction"], r["variable"], "%.4f" % r["skewness"]))
        if len(num) >= 2:
            pairs = high_correlation_pairs(df, num).collect()
            for r in pairs:
                rows.append(("high_correlations", f'{r["var1"]}~{r["var2"]}', r["label"]))
            if not pairs:
                rows.append(("high_correlations", "none", "no pair above 0.8"))
        for r in variance_ranking(df, num).collect():
            rows.append(("variable_importance", r["variable"], "%.4f" % r["score"]))
    if cat:
        for r in categorical_summary(df, cat).collect():
            rows.append(("categorical_summary", r["variable"],
                         f'{r["rank"]}:{r["value"]}={r["count"]} (unique {r["n_unique"]})'))
    return spark.createDataFrame(rows, "section string, key string, value string")


def insights(df: DataFrame) -> DataFrame:
    """(severity, title, message); "All clear!" when nothing is found."""
    spark = _spark(df)
    ov = overview(df).collect()[0]
    out = []
    if ov["missing_pct"] and ov["missing_pct"] > 0:
        out.append(("warning", "Missing Data", "missing share of all cells: %.1f%%" % ov["missing_pct"]))
    if ov["duplicate_rows"] > 0:
        out.append(("warning", "Duplicate Rows", "rows that repeat others: %d" % ov["duplicate_rows"]))
    num = roles(df)[0]
    if num:
        hs = [r["variable"] for r in skewed_columns(df, num).collect()]
        if hs:
            out.append(("info", "High Skewness",
                        "skewness beyond 1: " + ", ".join(hs)))
    hm = [r["variable"] for r in high_missing_columns(df, 30.0).collect()]
    if hm:
        out.append(("danger", "High Missing (>30%)", ", ".join(hm)))
    cc = [r["variable"] for r in constant_columns(df).collect()]
    if cc:
        cc = [c for c in df.columns if c in set(cc)]
        out.append(("danger", "Constant Columns", ", ".join(cc)))
    if not out:
        out.append(("success", "All clear!", "nothing to report"))
    return spark.createDataFrame(out, "severity string, title string, message string")

