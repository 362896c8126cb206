import math

from stratocast.operators import profile as A
from stratocast.operators import rows as P


def _obs(spark):
    rows = [
        ("2010-01-01", "Sydney", 10.0, "N", "No", "No"),
        ("2010-01-02", "Melbourne", None, "S", "Yes", "Yes"),
        ("2010-01-03", "Sydney", 12.0, None, "No", "No"),
        ("2010-02-04", "Melbourne", float("nan"), "N", "Yes", "Yes"),
        ("bad", "Sydney", 14.0, "N", None, "No"),
        ("2011-03-01", None, 20.0, "E", "No", None),
    ]
    return spark.createDataFrame(rows, "Date string, Location string, MinTemp double, WindGustDir string, "
                                       "RainToday string, RainTomorrow string")


def test_profile_counts_nan_as_missing(spark):
    out = {r["column"]: r for r in A.profile_columns(_obs(spark)).collect()}
    assert out["MinTemp"]["non_null"] == 4
    assert out["MinTemp"]["null_pct"] == round(2 / 6 * 100, 2)
    assert out["Date"]["null_pct"] == 0.0
    first = A.profile_columns(_obs(spark)).first()
    assert first["null_pct"] >= out["Location"]["null_pct"]


def test_count_duplicates_null_equals_null(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (2, "a")], "k int, v string")
    assert A.count_duplicates(df).first()["n_duplicates"] == 3


def test_date_coverage_bad_dates_are_null(spark):
    r = A.date_coverage(_obs(spark), "Date").first()
    assert str(r["min_date"]) == "2010-01-01" and str(r["max_date"]) == "2011-03-01"
    assert r["n_dates"] == 5 and r["years"] == [2010, 2011]


def test_group_size_stats_ties_to_lowest_key(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "k string")
    r = A.group_size_stats(df, "k").first()
    assert (r["n_groups"], r["min_size"], r["max_size"], r["key_min"], r["key_max"]) == (3, 1, 2, "c", "a")


def test_target_balance_and_persistence(spark):
    r = A.target_balance(_obs(spark), "RainTomorrow").first()
    assert (r["n_yes"], r["n_no"], r["n_missing"]) == (2, 3, 1)
    assert r["base_rate_pct"] == 40.0 and r["always_no_pct"] == 60.0
    p = A.persistence_baseline(_obs(spark), "RainToday", "RainTomorrow").first()
    assert p["n_rows"] == 4 and p["accuracy_pct"] == 100.0 and p["p_yes_given_today_yes_pct"] == 100.0


def test_correlation_guards_constant_and_pairs(spark):
    df = spark.createDataFrame([(1.0, 5.0, 0), (2.0, 5.0, 1), (3.0, 5.0, 1), (None, 5.0, 0)],
                               "x double, const double, y int")
    out = {r["column"]: r for r in A.target_correlations(df, ["x", "const"], "y").collect()}
    assert out["const"]["corr"] is None
    assert abs(out["x"]["corr"] - 0.8660254037844387) < 1e-12 and out["x"]["n_pairs"] == 3


def test_rates_and_extremes(spark):
    obs = P.map_label(_obs(spark), "RainTomorrow")
    rates = A.target_rate(obs, "Location", "label").collect()
    assert [(r["Location"], r["rate_pct"], r["n"]) for r in rates] == [("Melbourne", 100.0, 2), ("Sydney", 0.0, 3)]
    ext = A.rate_extremes(A.target_rate(obs, "Location", "label"), "Location", 1).collect()
    assert {(r["side"], r["Location"]) for r in ext} == {("top", "Melbourne"), ("bottom", "Sydney")}


def test_rate_by_month_and_extremes(spark):
    obs = P.map_label(_obs(spark), "RainTomorrow")
    m = {r["month"]: r["rate_pct"] for r in A.rate_by_month(obs, "Date", "label").collect()}
    assert m == {1: round(100 / 3, 2), 2: 100.0}
    e = A.month_extremes(A.rate_by_month(obs, "Date", "label")).first()
    assert (e["wettest_month"], e["driest_month"]) == (2, 1)


def test_describe_and_class_statistics(spark):
    d = {r["column"]: r for r in A.numeric_describe(_obs(spark), ["MinTemp"]).collect()}["MinTemp"]
    vals = [10.0, 12.0, 14.0, 20.0]
    mean = sum(vals) / 4
    assert d["count"] == 4 and d["mean"] == mean
    assert abs(d["std"] - math.sqrt(sum((v - mean) ** 2 for v in vals) / 3)) < 1e-12
    cm = {r["RainTomorrow"]: r["mean_MinTemp"] for r in A.class_means(_obs(spark), ["MinTemp"], "RainTomorrow").collect()}
    assert cm == {"No": 12.0, "Yes": None}
    cq = {r["RainTomorrow"]: r for r in A.class_quantiles(_obs(spark), ["MinTemp"], "RainTomorrow").collect()}
    assert (cq["No"]["min"], cq["No"]["median"], cq["No"]["max"]) == (10.0, 12.0, 14.0)


def test_median_shift(spark):
    df = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (10.0, False)], "x double, tr boolean")
    r = A.median_shift(df, ["x"], "tr").first()
    assert (r["median_all"], r["median_train"], r["abs_diff"]) == (2.5, 1.5, 1.0)


def test_empty_input(spark):
    df = spark.createDataFrame([], "k string, y int, x double")
    assert A.target_rate(df, "k", "y").count() == 0
    assert A.profile_columns(df).first()["n_rows"] == 0
    assert A.target_balance(df.withColumnRenamed("k", "t"), "t").first()["base_rate_pct"] is None


def test_row_rules(spark):
    obs = _obs(spark)
    assert P.encode_label(obs, "RainTomorrow").count() == 5
    assert [r["Month"] for r in P.add_month(obs, "Date").collect()] == [1, 1, 1, 2, None, 3]
    nums, cats = P.feature_lists(obs, ["Location", "WindGustDir", "Month"], drop=["Date", "RainTomorrow"])
    assert cats == ["Location", "WindGustDir"] and nums == ["MinTemp", "RainToday"]
    aligned = P.align_columns(obs, [("MinTemp", "double"), ("Sunshine", "double")])
    assert aligned.columns == ["MinTemp", "Sunshine"] and aligned.where("Sunshine is not null").count() == 0
    rec = spark.createDataFrame([(0,), (13,), (1,), (12,), (None,)], "Month int")
    v = [r["valid"] for r in P.validate_records(rec, P.feature_record_rules()).collect()]
    assert v == [False, False, True, True, True]
    assert [r["n_null"] for r in P.null_count_per_row(obs).collect()][:4] == [0, 1, 1, 1]
    try:
        P.filter_group(obs, "Location", "Perth")
        raise AssertionError("expected an error")
    except ValueError:
        pass


def test_align_columns_never_fails_on_bad_text(spark):
    df = spark.createDataFrame([("12",), ("abc",)], "Month string")
    assert [r["Month"] for r in P.align_columns(df, [("Month", "int")]).collect()] == [12, None]


def test_json_records_with_wrong_types_are_rejected(spark):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("Month", T.IntegerType()), T.StructField("Humidity3pm", T.DoubleType()),
                           T.StructField("Location", T.StringType())])
    lines = spark.createDataFrame([('{"Month": 7, "Humidity3pm": 80.5, "Location": "Sydney"}',),
                                   ('{"Month": 7, "Humidity3pm": "high"}',),
                                   ('{}',),
                                   ('{"Month": 13}',)], "value string")
    recs = P.parse_json_records(lines, schema)
    out = P.validate_records(recs, P.feature_record_rules("Month", "type_errors")).collect()
    assert [r["valid"] for r in out] == [True, False, True, False]
    assert out[1]["violations"] == ["well_typed"] and out[1]["type_errors"] == ["Humidity3pm"]
    assert out[3]["violations"] == ["month_range"]
