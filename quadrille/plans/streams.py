"""Queries: aggregates of events as a stream, read file by file until there is no more, each trigger's whole result written in place of the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille import sinks, streaming
from quadrille.plans.feat import read
from quadrille.plans.registry import Registry

query = Registry()
MINUTE = "yyyy-MM-dd HH:mm"


def streamed(spark: SparkSession, sf_dir: str, form: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    found = form(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    path = sinks.scratch(spark, name)
    run = found.writeStream.outputMode("complete").option("checkpointLocation", f"{path}/state").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/rows")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/rows")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = streamed(spark, sf_dir, streaming.windowed, "windows")
    return w.select(F.date_format("start", MINUTE).alias("start"), "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(c) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M') AS stop, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = streamed(spark, sf_dir, streaming.sessions, "sessions")
    return s.select("user_id", F.date_format("start", MINUTE).alias("start"), F.date_format("end", MINUTE).alias("stop"), "n")
