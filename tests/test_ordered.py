"""Skew-proof running sums equal plain windows, also when a key holds a third of all rows."""

import pytest
from pyspark.sql import Window, functions as F

from slotwise.operators import drift, history, metrics, profiles
from slotwise.plans.dims import bounded, left_lookup, with_value
from slotwise.plans.ordered import heavy_keys, prior_sums, with_position

ORDER = ["booking_datetime", "booking_id"]


@pytest.fixture(scope="module")
def skewed(bookings):
    """A third of all bookings belong to one customer."""
    hot = F.col("booking_id").cast("long") % 3 == 0
    return bookings.withColumn(
        "customer_id", F.when(hot, F.lit("hot")).otherwise(F.col("customer_id"))
    )


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_heavy_keys_found(skewed):
    heavy = heavy_keys(skewed, ["customer_id"], 100).collect()
    assert [row["customer_id"] for row in heavy] == ["hot"]
    assert heavy_keys(skewed, ["customer_id"], 10**6) is None


@pytest.mark.parametrize("task_rows", [5, 100, 10**6])
def test_prior_sums_by_key(skewed, task_rows):
    window = (
        Window.partitionBy("customer_id").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    )
    plain = skewed.withColumn("s", F.coalesce(F.sum("hour_of_day").over(window), F.lit(0)))
    ours = prior_sums(skewed, ["customer_id"], ORDER, {"s": F.col("hour_of_day")}, task_rows)
    assert rows(ours, "booking_id", "s") == rows(plain, "booking_id", "s")
    assert set(ours.columns) == set(plain.columns)


def test_prior_sums_without_key(bookings):
    window = Window.orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    plain = bookings.withColumn("s", F.coalesce(F.sum("hour_of_day").over(window), F.lit(0)))
    ours = prior_sums(bookings, [], ORDER, {"s": F.col("hour_of_day")}, task_rows=50)
    assert rows(ours, "booking_id", "s") == rows(plain, "booking_id", "s")


def test_position_of_heavy_and_light_keys(skewed):
    window = Window.partitionBy("customer_id")
    plain = skewed.withColumns(
        {
            "position": F.row_number().over(window.orderBy(*ORDER)),
            "key_rows": F.count(F.lit(1)).over(window),
        }
    )
    ours = with_position(skewed, ["customer_id"], ORDER, task_rows=100)
    wanted = ("booking_id", "position", "key_rows")
    assert rows(ours, *wanted) == rows(plain, *wanted)


def test_history_and_profiles_do_not_depend_on_the_split(skewed):
    columns = ("booking_id", "prior_visits", "prior_noshows")
    assert rows(history.customer_history(skewed, 50), *columns) == rows(
        history.customer_history(skewed), *columns
    )
    split, plain = (profiles.customer_profiles(skewed, task_rows=n) for n in (50, 10**6))
    columns = (
        "customer_id", "total_bookings", "total_revenue", "primary_service", "visit_trend",
        "segment", "churn_score", "days_since_last_visit",
    )
    assert rows(split, *columns) == rows(plain, *columns)
    assert rows(profiles.visit_trend(skewed, 50), "customer_id", "visit_trend") == rows(
        plain, "customer_id", "visit_trend"
    )


def test_rfm_does_not_depend_on_the_split(bookings):
    cdf = profiles.customer_profiles(bookings)
    columns = ("customer_id", "r_score", "f_score", "m_score")
    assert rows(profiles.rfm_scores(cdf, 20), *columns) == rows(profiles.rfm_scores(cdf), *columns)


def test_metrics_and_drift_do_not_depend_on_the_split(bookings):
    scored = bookings.select(
        F.when(F.col("outcome") == "No-Show", 1.0).otherwise(0.0).alias("label"),
        (F.col("booking_lead_time_hours") / 1000).alias("score"),
    )
    assert metrics.roc_auc(scored, task_rows=10).first()[0] == pytest.approx(
        metrics.roc_auc(scored).first()[0], abs=1e-12
    )
    assert metrics.best_f1_threshold(scored, task_rows=10).first() == (
        metrics.best_f1_threshold(scored).first()
    )
    old, new = (bookings.filter(F.col("hour_of_day") < 14), bookings.filter(F.col("hour_of_day") > 11))
    assert rows(drift.ks_2samp(old, new, task_rows=5), "feature", "statistic") == rows(
        drift.ks_2samp(old, new), "feature", "statistic"
    )


def test_lookup_beyond_the_broadcast_bound(spark):
    facts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "z"), (4, None)], "id int, k string")
    dim = spark.createDataFrame([("a", 10), ("b", 20)], "k string, v int")
    assert bounded(dim, 1)[1] is False and bounded(dim, 2)[1] is True
    for limit in (1, 100):
        joined = left_lookup(facts, dim, "k", limit)
        assert rows(joined.filter("v IS NOT NULL"), "id", "v") == [(1, 10), (2, 20)]
        assert joined.count() == 4


@pytest.mark.parametrize("size", [3, 200])
def test_value_lookup_as_case_or_join(spark, size):
    facts = spark.createDataFrame([(1, "k1"), (2, "it's"), (3, None), (4, "?")], "id int, k string")
    pairs = [("it's", 0.5), *[(f"k{i}", float(i)) for i in range(size)]]
    dim = spark.createDataFrame(pairs, "k string, v double")
    found = with_value(facts, dim, "k", "v", "out", -1.0)
    assert rows(found, "id", "out") == [(1, 1.0), (2, 0.5), (3, -1.0), (4, -1.0)]


def test_heavy_keys_from_a_sample(spark):
    df = spark.range(30_000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    assert [tuple(r) for r in heavy_keys(df, ["k"], 5_000).collect()] == [(0, 10_000)]
    assert heavy_keys(df, ["k"], 20_000) is None


def test_more_slices_than_shuffle_partitions(spark):
    """One key cut into slices of 50 rows, many more than the setting has."""
    df = spark.range(2000).select(F.lit("hot").alias("k"), F.col("id").alias("t"))
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < 2000 // 50
    summed = prior_sums(df, ["k"], ["t"], {"n": F.lit(1).cast("long")}, 50)
    assert [r["n"] for r in summed.orderBy("t").collect()] == list(range(2000))


def test_every_key_may_be_heavy(spark):
    """Three hundred heavy keys and no light one."""
    df = spark.range(6000).select((F.col("id") % 300).alias("k"), F.col("id").alias("t"))
    assert heavy_keys(df, ["k"], 10).count() == 300
    summed = prior_sums(df, ["k"], ["t"], {"n": F.lit(1).cast("long")}, 10)
    assert summed.filter(F.col("n") != F.floor(F.col("t") / 300)).count() == 0 and summed.count() == 6000


def _plain_as_of(skewed):
    """Counters and last outcome before every request, row by row."""
    found = {}
    all_rows = skewed.withColumn("moment", history.requested_at()).collect()
    of = {}
    for r in all_rows:
        of.setdefault(r["customer_id"], []).append(r)
    for r in all_rows:
        seen = [b for b in of[r["customer_id"]] if b["booking_datetime"] < r["moment"]]
        last = max(seen, key=lambda b: (b["booking_datetime"], b["booking_id"]), default=None)
        found[r["booking_id"]] = (
            len(seen),
            sum(b["outcome"] == "No-Show" for b in seen),
            max((b["past_cancellation_count"] for b in seen), default=0),
            last and last["outcome"],
        )
    return found


@pytest.mark.parametrize("task_rows", [100, 10**6])
def test_requests_see_earlier_bookings_only(skewed, task_rows):
    """Also when the hot customer is cut into slices."""
    few = skewed.filter("customer_id = 'hot' OR CAST(booking_id AS BIGINT) % 4 = 0").drop("is_repeat_customer")
    expected = _plain_as_of(few)
    counters = history.history_as_of(few, few, history.requested_at(), task_rows)
    joined = history.asof_join(
        few.drop("outcome"), few.select("booking_id", "customer_id", "booking_datetime", "outcome"),
        ["customer_id"], history.requested_at(), F.col("booking_datetime"), ["outcome"],
        ["booking_id"], task_rows=task_rows,
    )
    last = {r["booking_id"]: r["outcome"] for r in joined.collect()}
    found = {
        r["booking_id"]: (*[r[name] for name in history.COUNTERS], last[r["booking_id"]])
        for r in counters.collect()
    }
    assert found == expected and any(v[0] for v in found.values())


def test_as_of_join_of_ties_nulls_and_clashing_names(spark):
    schema = "k string, t int, found string, asked string, known int"
    left = spark.createDataFrame(
        [("a", 5, "L1", "x", 1), ("a", 1, "L2", "x", 2), (None, 5, "L3", "x", 3), ("a", None, "L4", "x", 4),
         ("z", 9, "L5", "x", 5), ("a", 5, "L1", "x", 1)], schema,
    )
    right = spark.createDataFrame(
        [("a", 5, 1, "same"), ("a", 3, 1, "low"), ("a", 3, 2, None), ("a", 2, 9, "old"), (None, 1, 1, "none"),
         ("a", None, 1, "never")], "k string, t int, at int, value string",
    )

    def joined(equal, right=right):
        found = history.asof_join(
            left, right, ["k"], F.col("t"), F.col("t"), ["value", "at"], ["at"], equal, 2
        )
        assert found.columns == [*left.columns, "value", "at"]
        return sorted((r["found"], r["value"], r["at"]) for r in found.collect())

    none = [("L2", None, None), ("L3", None, None), ("L4", None, None), ("L5", None, None)]
    assert joined(False) == [("L1", None, 2)] * 2 + none  # the value of the last row is null
    assert joined(True) == [("L1", "same", 1)] * 2 + none
    assert joined(False, right.limit(0)) == [("L1", None, None)] * 2 + none


def test_requests_as_of_take_one_shuffle(bookings):
    plan = history.history_as_of(bookings, bookings, history.requested_at())
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in text
