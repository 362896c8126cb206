"""Projections, filters and row rules (narrow transformations, no shuffle)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import typed_null
from .profile import as_date


# P1
def drop_unlabelled(df: DataFrame, target: str) -> DataFrame:
    """Remove rows whose target is missing (they cannot be learned from)."""
    return df.where(F.col(target).isNotNull())


# P2
def encode_label(df: DataFrame, target: str, yes: str = "Yes", out: str = "label") -> DataFrame:
    """Training label: rows without target dropped, then 1 if equal to ``yes`` else 0."""
    return drop_unlabelled(df, target).withColumn(out, (F.col(target) == F.lit(yes)).cast("int"))


# P3
def label_map_expr(c: Column, yes: str = "Yes", no: str = "No") -> Column:
    return F.when(c == F.lit(yes), F.lit(1)).when(c == F.lit(no), F.lit(0))


def map_label(df: DataFrame, target: str, yes: str = "Yes", no: str = "No",
              out: str = "label") -> DataFrame:
    """Exploration label: ``yes`` 1, ``no`` 0, anything else (and null) null."""
    return df.withColumn(out, label_map_expr(F.col(target), yes, no))


# P4
def add_month(df: DataFrame, date_col: str, out: str = "Month") -> DataFrame:
    """Calendar month 1..12 of a date, timestamp or date text; null on a bad date."""
    return df.withColumn(out, F.month(as_date(df, date_col)))


# P5
def feature_lists(df: DataFrame, categorical: Sequence[str],
                  drop: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names from the schema.

    Declared categorical columns that exist keep the declared order; every
    other column not in ``drop`` is numeric, in schema order.
    """
    present = [c for c in df.columns if c not in set(drop)]
    cats = [c for c in categorical if c in present]
    nums = [c for c in present if c not in set(cats)]
    return nums, cats


def select_features(df: DataFrame, categorical: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    nums, cats = feature_lists(df, categorical, drop)
    return df.select(*nums, *cats)


# P6
def align_columns(df: DataFrame, columns: T.StructType | Sequence[tuple[str, str]],
                  keep: Sequence[str] = ()) -> DataFrame:
    """Keep the asked columns in order, drop extras, add missing ones as typed nulls.

    ``keep`` names pass-through columns (ids, timestamps) placed first.
    """
    if isinstance(columns, T.StructType):
        spec = [(f.name, f.dataType) for f in columns.fields]
    else:
        spec = list(columns)
    have = set(df.columns)
    names = {n for n, _ in spec}
    passthrough = [F.col(c) for c in keep if c in have and c not in names]
    # try_cast: a badly typed value becomes null instead of failing the job
    # under ANSI (records are validated separately, see validate_records)
    return df.select(*passthrough, *[(F.col(n).try_cast(t) if n in have else typed_null(t)).alias(n)
                                     for n, t in spec])


# P7
def validate_records(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Add ``violations`` (names of failed rules, in rule order) and ``valid``.

    A rule is a boolean column that must be true; a null result counts as a
    failure, so rules state explicitly when null is allowed.
    """
    failed = [F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items()]
    v = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    return df.withColumn("violations", v).withColumn("valid", F.size("violations") == 0)


def parse_json_records(lines: DataFrame, schema: T.StructType, text_col: str = "value") -> DataFrame:
    """Typed fields of flat JSON records plus ``type_errors``: the fields that
    were given but do not have the declared type (they are null in the typed
    columns). Works on batch and streaming text."""
    typed = F.from_json(F.col(text_col), schema, {"mode": "PERMISSIVE"})
    raw = F.from_json(F.col(text_col), T.MapType(T.StringType(), T.StringType()), {"mode": "PERMISSIVE"})
    parsed = lines.select(typed.alias("_t"), raw.alias("_r"))
    errors = F.array_compact(F.array(*[
        F.when(F.col("_r")[f.name].isNotNull() & F.col("_t")[f.name].isNull(), F.lit(f.name))
        for f in schema.fields]))
    return parsed.select(*[F.col("_t")[f.name].alias(f.name) for f in schema.fields], errors.alias("type_errors"))


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) frames of :func:`validate_records` -- two filters of one plan."""
    checked = validate_records(df, rules)
    return checked.where("valid").drop("violations", "valid"), checked.where(~F.col("valid"))


def feature_record_rules(month_col: str = "Month", type_errors_col: str | None = None) -> dict[str, Column]:
    """Rules of a feature record: all fields optional, month in 1..12 when given,
    and (when parsed by :func:`parse_json_records`) no badly typed field."""
    m = F.col(month_col)
    rules = {"month_range": m.isNull() | m.between(1, 12)}
    if type_errors_col:
        rules["well_typed"] = F.size(F.col(type_errors_col)) == 0
    return rules


# P8
def filter_group(df: DataFrame, column: str, value, require_rows: bool = True) -> DataFrame:
    """Rows of one group (one station); error when the group does not exist."""
    out = df.where(F.col(column) == F.lit(value))
    if require_rows and out.isEmpty():
        raise ValueError(f"no rows with {column} = {value!r}")
    return out


# P9
def apply_threshold(df: DataFrame, proba: str = "proba", threshold: float = 0.5,
                    out: str = "decision") -> DataFrame:
    """Decision is ``proba >= threshold``."""
    return df.withColumn(out, F.col(proba) >= F.lit(float(threshold)))


# P10
def null_count_per_row(df: DataFrame, cols: Sequence[str] | None = None, out: str = "n_null") -> DataFrame:
    """Number of missing values in each row (NaN counts as missing)."""
    cols = list(cols or df.columns)
    parts = []
    for c in cols:
        miss = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            miss = miss | F.isnan(F.col(c))
        parts.append(miss.cast("int"))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return df.withColumn(out, total)
