"""Registered queries: key rotation and payload encryption."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import security as SEC
from ..sources import fixtures as V
from ._registry import query

# Demonstration secret and salt seed for the registered check only; callers
# of the operators pass their own.
DEMO_SECRET = "corridor-demo-secret"
DEMO_SALT_SEED = "corridor-demo-salt"


@query("b26_rotation_buckets", sql="""
select timestamp // 300 as rotation_bucket, count(*) as n_readings, min(reading_id) as first_reading_id
from readings group by 1""")
def b26_rotation_buckets(spark, sf_dir):
    r = V.readings(spark, sf_dir)
    return (r.groupBy(SEC.rotation_bucket("timestamp").alias("rotation_bucket"))
            .agg(F.count(F.lit(1)).alias("n_readings"), F.min("reading_id").alias("first_reading_id")))


@query("b25_payload_roundtrip")
def b25_payload_roundtrip(spark, sf_dir):
    """Encrypt each reading's payload with its 5-minute key, decrypt it
    again and check the round trip (property: every row is ok)."""
    r = V.readings(spark, sf_dir)
    payload = F.struct("reading_id", "location", "weather", "vehicle_count", "average_speed_kmph")
    e = SEC.encrypted_payloads(r, payload, DEMO_SECRET, DEMO_SALT_SEED)
    schema = "reading_id bigint, location string, weather string, vehicle_count int, average_speed_kmph double"
    d = e.withColumn("back", SEC.decrypt(F.col("token"), F.col("key"), schema))
    return d.select("reading_id", "rotation_bucket", "key_fingerprint", F.length("token").alias("token_length"),
                    (F.col("back") == payload).alias("roundtrip_ok"))
