"""Profile and aggregations (exploration statistics).

All per-column statistics are computed in one aggregate pass and unpivoted
afterwards with ``inline``; a loop of one job per column is never used.
Results are small (one row per column, group or class) by construction,
except :func:`target_rate` / :func:`value_distribution`, which are one row per
key and stay distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import is_double, nan_to_null, ratio, rnd
from .quantiles import exact_quantiles, radix_quantiles


def _present(df: DataFrame, c: str):
    """A value counts as present when not null and, for floating columns, not NaN."""
    f = df.schema[c]
    cond = F.col(c).isNotNull()
    if is_double(f.dataType):
        cond = cond & ~F.isnan(F.col(c))
    return cond


# A1 -------------------------------------------------------------------------
def profile_columns(df: DataFrame, only_missing: bool = False) -> DataFrame:
    """One row per column: position, name, type, rows, columns, non-null count, null %.

    Sorted by null % descending, then column position.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(_present(df, c)).alias(f"_nn{i}") for i, c in enumerate(cols)]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                 F.col(f"_nn{i}").alias("non_null"))
        for i, c in enumerate(cols)
    ])
    out = one.select(F.col("_n").alias("n_rows"), F.lit(len(cols)).alias("n_cols"), F.inline(rows))
    out = out.select("position", "column", "dtype", "n_rows", "n_cols", "non_null",
                     rnd(F.coalesce(ratio(F.col("n_rows") - F.col("non_null"), F.col("n_rows")),
                                        F.lit(0.0)) * 100, 2).alias("null_pct"))
    if only_missing:
        out = out.where(F.col("null_pct") > 0)
    return out.orderBy(F.col("null_pct").desc(), F.col("position"))


# A2 -------------------------------------------------------------------------
def count_duplicates(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier identical row; null equals null (group semantics)."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("n_duplicates"),
                 F.count(F.lit(1)).alias("n_distinct_rows"))


# A3 -------------------------------------------------------------------------
def as_date(df: DataFrame, c: str):
    """A date column from date, timestamp or text (bad text becomes null)."""
    dt = df.schema[c].dataType
    if isinstance(dt, T.DateType):
        return F.col(c)
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.to_date(F.col(c))
    return F.try_to_date(F.col(c).cast("string"))


def date_coverage(df: DataFrame, date_col: str) -> DataFrame:
    """min, max, distinct dates, distinct years and the sorted year list.

    The year list is bounded by the number of calendar years.
    """
    d = as_date(df, date_col)
    return df.select(d.alias("_d")).agg(
        F.min("_d").alias("min_date"), F.max("_d").alias("max_date"),
        F.count_distinct("_d").alias("n_dates"),
        F.count_distinct(F.year("_d")).alias("n_years"),
        F.array_sort(F.collect_set(F.year("_d"))).alias("years"),
    )


# A4 -------------------------------------------------------------------------
def group_size_stats(df: DataFrame, key: str) -> DataFrame:
    """groups, min/max/mean size, key of the smallest and of the largest group.

    Null keys are not a group. Ties go to the lowest key.
    """
    sizes = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_size"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.min("_size").alias("min_size"),
        F.max("_size").alias("max_size"),
        rnd(F.avg("_size"), 1).alias("mean_size"),
        F.min_by(F.col(key), F.struct(F.col("_size"), F.col(key))).alias("key_min"),
        F.min_by(F.col(key), F.struct(-F.col("_size"), F.col(key))).alias("key_max"),
    )


# A5 -------------------------------------------------------------------------
def target_balance(df: DataFrame, target: str, yes: str = "Yes", no: str = "No") -> DataFrame:
    """Counts of yes / no / missing, % missing, base rate and always-no accuracy (in %)."""
    t = F.col(target)
    one = df.agg(F.count_if(t == yes).alias("n_yes"), F.count_if(t == no).alias("n_no"),
                 F.count_if(t.isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_rows"))
    valid = F.col("n_yes") + F.col("n_no")
    return one.select(
        "n_yes", "n_no", "n_missing", "n_rows",
        rnd(ratio(F.col("n_missing"), F.col("n_rows")) * 100, 2).alias("pct_missing"),
        rnd(ratio(F.col("n_yes"), valid) * 100, 2).alias("base_rate_pct"),
        rnd(ratio(F.col("n_no"), valid) * 100, 2).alias("always_no_pct"),
    )


# A6 -------------------------------------------------------------------------
def persistence_baseline(df: DataFrame, today: str, target: str, yes: str = "Yes",
                         no: str = "No") -> DataFrame:
    """Predict ``target`` = ``today`` on rows where both are known.

    ``p_yes_given_today_yes_pct`` is also the precision of the rule;
    ``recall_pct`` is the share of yes targets the rule catches.
    """
    a, b = F.col(today), F.col(target)
    both = df.where(a.isNotNull() & b.isNotNull())
    one = both.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(a == b).alias("_eq"),
        F.count_if(a == yes).alias("_ty"), F.count_if((a == yes) & (b == yes)).alias("_ty_yy"),
        F.count_if(a == no).alias("_tn"), F.count_if((a == no) & (b == yes)).alias("_tn_yy"),
        F.count_if(b == yes).alias("_yy"),
    )
    return one.select(
        rnd(ratio(F.col("_eq"), F.col("n_rows")) * 100, 2).alias("accuracy_pct"),
        "n_rows",
        rnd(ratio(F.col("_ty_yy"), F.col("_ty")) * 100, 2).alias("p_yes_given_today_yes_pct"),
        rnd(ratio(F.col("_tn_yy"), F.col("_tn")) * 100, 2).alias("p_yes_given_today_no_pct"),
        rnd(ratio(F.col("_ty_yy"), F.col("_ty")) * 100, 2).alias("precision_pct"),
        rnd(ratio(F.col("_ty_yy"), F.col("_yy")) * 100, 2).alias("recall_pct"),
    )


# A7 -------------------------------------------------------------------------
def numeric_describe(df: DataFrame, cols: Sequence[str], exact_mean_scale: int | None = None) -> DataFrame:
    """min, max, mean, sample std, count per numeric column (NaN counts as missing).

    A double ``avg`` depends on the order in which partitions are summed, so
    two runs (or two engines) can differ in the last bit. With
    ``exact_mean_scale`` the values are summed as DECIMAL(38, scale) -- exact
    and order independent -- and the exact sum is divided by the count; on
    decimal overflow the double mean is used.
    """
    aggs = []
    for i, c in enumerate(cols):
        v = nan_to_null(F.col(c).cast("double"))
        mean = F.avg(v)
        if exact_mean_scale is not None:
            dsum = F.try_sum(v.cast(f"decimal(38,{int(exact_mean_scale)})"))
            mean = F.coalesce(F.try_divide(dsum.cast("double"), F.count(v).cast("double")), F.avg(v))
        aggs += [F.min(v).alias(f"mn{i}"), F.max(v).alias(f"mx{i}"), mean.alias(f"av{i}"),
                 F.stddev_samp(v).alias(f"sd{i}"), F.count(v).alias(f"ct{i}")]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"), F.col(f"mn{i}").alias("min"),
                 F.col(f"mx{i}").alias("max"), F.col(f"av{i}").alias("mean"),
                 F.col(f"sd{i}").alias("std"), F.col(f"ct{i}").alias("count"))
        for i, c in enumerate(cols)
    ])
    return one.select(F.inline(rows))


# A8 -------------------------------------------------------------------------
def target_correlations(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Pearson correlation of each column with a 0/1 label over pair-complete rows.

    Null when either side is constant or fewer than 2 rows remain. Built from
    covariance and variances (``corr`` itself divides by zero under ANSI).
    Sorted by absolute value descending, nulls last.
    """
    y0 = nan_to_null(F.col(label).cast("double"))
    aggs = []
    for i, c in enumerate(cols):
        x0 = nan_to_null(F.col(c).cast("double"))
        x = F.when(y0.isNotNull(), x0)
        y = F.when(x0.isNotNull(), y0)
        aggs += [F.covar_samp(x, y).alias(f"cv{i}"), F.var_samp(x).alias(f"vx{i}"),
                 F.var_samp(y).alias(f"vy{i}"), F.count(x).alias(f"n{i}")]
    one = df.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        ok = (F.col(f"n{i}") >= 2) & (F.col(f"vx{i}") > 0) & (F.col(f"vy{i}") > 0)
        r = F.when(ok, F.try_divide(F.col(f"cv{i}"), F.sqrt(F.col(f"vx{i}") * F.col(f"vy{i}"))))
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                             r.alias("corr"), F.col(f"n{i}").alias("n_pairs")))
    out = one.select(F.inline(F.array(*rows)))
    return out.orderBy(F.abs("corr").desc_nulls_last(), "position")


# A9 -------------------------------------------------------------------------
def class_means(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Mean of each column per class; the null class is dropped."""
    return (df.where(F.col(target).isNotNull()).groupBy(target)
              .agg(*[F.avg(nan_to_null(F.col(c).cast("double"))).alias(f"mean_{c}") for c in cols]))


# A10 ------------------------------------------------------------------------
def value_distribution(df: DataFrame, col: str) -> DataFrame:
    """Count per value, null included, most frequent first (ties by value)."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("n").desc(), F.col(col).asc_nulls_first()))


# A11 ------------------------------------------------------------------------
def target_rate(df: DataFrame, key: str | list[str], label: str, digits: int = 2) -> DataFrame:
    """Mean of a 0/1 label in % and the row count per key.

    Rows with a null key or label are dropped; the rate is rounded to
    ``digits`` and the result sorted by rate descending, key ascending.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cond = F.col(label).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return (df.where(cond).groupBy(*keys)
              .agg(rnd(F.avg(F.col(label).cast("double")) * 100, digits).alias("rate_pct"),
                   F.count(F.lit(1)).alias("n"))
              .orderBy(F.col("rate_pct").desc(), *[F.col(k).asc() for k in keys]))


# A12 ------------------------------------------------------------------------
def rate_extremes(rates: DataFrame, key: str, k: int, rate_col: str = "rate_pct") -> DataFrame:
    """The k highest and the k lowest rates, with ``side`` and 1-based ``position``.

    Both ends come from one order (rate desc, key asc): the lowest are the
    last k rows of that order. The limit is the feature (a top-k report).
    """
    top = (rates.orderBy(F.col(rate_col).desc(), F.col(key).asc()).limit(k)
           .select(F.lit("top").alias("side"), key, rate_col))
    bottom = (rates.orderBy(F.col(rate_col).asc(), F.col(key).desc()).limit(k)
              .select(F.lit("bottom").alias("side"), key, rate_col))
    return top.unionByName(bottom)


# A13 ------------------------------------------------------------------------
def rate_by_month(df: DataFrame, date_col: str, label: str) -> DataFrame:
    """Label rate in % per calendar month (1..12) of ``date_col``."""
    m = df.select(F.month(as_date(df, date_col)).alias("month"), F.col(label))
    return target_rate(m, "month", label)


def month_extremes(rates: DataFrame) -> DataFrame:
    """Wettest and driest month of a :func:`rate_by_month` table (lowest month on ties)."""
    return rates.agg(
        F.max_by("month", F.struct(F.col("rate_pct"), -F.col("month"))).alias("wettest_month"),
        F.max("rate_pct").alias("wettest_pct"),
        F.min_by("month", F.struct(F.col("rate_pct"), F.col("month"))).alias("driest_month"),
        F.min("rate_pct").alias("driest_pct"),
    )


# A14 ------------------------------------------------------------------------
FIVE_NUMBERS = (0.0, 0.25, 0.5, 0.75, 1.0)


def class_quantiles(df: DataFrame, cols: Sequence[str], target: str, **kw) -> DataFrame:
    """Five-number summary (min, q1, median, q3, max) per class and column."""
    d = df.where(F.col(target).isNotNull())
    q = exact_quantiles(d, cols, FIVE_NUMBERS, group_cols=[target], **kw)
    names = {0.0: "min", 0.25: "q1", 0.5: "median", 0.75: "q3", 1.0: "max"}
    return (q.groupBy(target, "column", "n")
             .agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(nm) for p, nm in names.items()]))


# A15 ------------------------------------------------------------------------
def median_shift(df: DataFrame, cols: Sequence[str], train_flag: str, **kw) -> DataFrame:
    """Median of each column on all rows and on training rows, and their distance."""
    q = radix_quantiles(df, cols, [0.5], scopes={"all": None, "train": F.col(train_flag)}, **kw)
    out = q.groupBy("column").agg(
        F.max(F.when(F.col("scope") == "all", F.col("quantile"))).alias("median_all"),
        F.max(F.when(F.col("scope") == "train", F.col("quantile"))).alias("median_train"),
    )
    return out.withColumn("abs_diff", F.abs(F.col("median_all") - F.col("median_train")))
