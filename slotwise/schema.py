"""Fixed schemas; nothing is inferred from files."""

from __future__ import annotations

from pyspark.sql import types as T

BOOKINGS = T.StructType(
    [
        T.StructField("booking_id", T.StringType(), False),
        T.StructField("customer_id", T.StringType()),
        T.StructField("service_type", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("booking_datetime", T.TimestampNTZType()),
        T.StructField("booking_lead_time_hours", T.LongType()),
        T.StructField("day_of_week", T.LongType()),
        T.StructField("hour_of_day", T.LongType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("past_visit_count", T.LongType()),
        T.StructField("past_cancellation_count", T.LongType()),
        T.StructField("past_noshow_count", T.LongType()),
        T.StructField("is_repeat_customer", T.BooleanType()),
        T.StructField("service_duration_mins", T.LongType()),
        T.StructField("staff_id", T.StringType()),
        T.StructField("outcome", T.StringType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("service_type", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("booking_lead_time_hours", T.LongType()),
        T.StructField("day_of_week", T.LongType()),
        T.StructField("hour_of_day", T.LongType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("past_visit_count", T.LongType()),
        T.StructField("past_cancellation_count", T.LongType()),
        T.StructField("past_noshow_count", T.LongType()),
        T.StructField("service_duration_mins", T.LongType()),
        T.StructField("staff_id", T.StringType()),
        T.StructField("month", T.LongType()),
    ]
)

REQUEST_BATCH = T.StructType([T.StructField("bookings", T.ArrayType(REQUEST))])

DRIFT_LOG = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("drift_score", T.DoubleType()),
        T.StructField("drifted_features", T.ArrayType(T.StringType())),
        T.StructField("total_features_tested", T.LongType()),
        T.StructField("should_retrain", T.BooleanType()),
    ]
)
