"""Queries that run a stream over the tables and return what it gave."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from craterloom.plans.inputs import duck, relation
from craterloom.plans.registry import query, rounded
from craterloom.sources.scratch import ensure_checkpoint_dir
from craterloom.streaming import catalog as S


@query("2.12", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet")
    # a file source wants a folder: a copy of the table's rows in the shared one
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    out = S.run_into_table(S.windowed_counts(stream, "ts", "event_type", "1 hour", "1000 days"), f"{base}/out", f"{base}/state")
    return rounded(out.withColumn("start", F.col("start").cast("timestamp_ntz")), 4)


@query("2.12 T5", duck("products") + """, u AS (SELECT * FROM products WHERE status IN ('validated', 'partial', 'parsed')) SELECT instrument, product_id, acquisition_time FROM u
QUALIFY row_number() OVER (PARTITION BY instrument ORDER BY coalesce(epoch_us(TRY_CAST(acquisition_time AS TIMESTAMPTZ)), -4611686018427387904) DESC, product_id DESC) = 1""")
def stream_latest_product(spark, d):
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    p = relation(spark, d, "products").select("product_id", "instrument", "status", "acquisition_time")
    p.write.parquet(f"{base}/in")
    stream = S.ingest(spark, f"{base}/in", "product_id string, instrument string, status string, acquisition_time string")
    return S.run_into_table(S.latest_by(stream, "instrument"), f"{base}/out", f"{base}/state")


@query("2.12 P2", duck("products") + "SELECT status, count(*) AS n FROM products GROUP BY status")
def stream_ingest(spark, d):
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    relation(spark, d, "products").select("product_id", "status").write.parquet(f"{base}/in")
    S.run_once(S.ingest(spark, f"{base}/in", "product_id string, status string"), f"{base}/out", f"{base}/state")
    return spark.read.schema("product_id string, status string").parquet(f"{base}/out").groupBy("status").agg(F.count("*").alias("n"))
