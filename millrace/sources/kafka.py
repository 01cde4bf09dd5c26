"""Topics of the crawler as Structured Streaming sources and sinks. The Kafka connector is the cluster's; tests use files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

RETRY = "url string, retryCount int, lastAttempt timestamp, httpStatus int"
CONTENT = "url string, title string, content string, author string, publish_at timestamp"
#: Topics with text payloads, and schemas of those with JSON payloads.
TEXT_TOPICS = ("new_url_tasks", "fetching_tasks", "parsing_tasks", "home_parsing_tasks")
JSON_TOPICS = {"retry_url_tasks": RETRY, "storing_tasks": CONTENT}


def read_options(servers: str, topic: str, per_trigger: int = 100_000) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "maxOffsetsPerTrigger": str(per_trigger)}


def write_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic, "kafka.acks": "all", "kafka.retries": "3", "kafka.batch.size": "16384", "kafka.linger.ms": "5", "kafka.compression.type": "zstd"}


def source(spark: SparkSession, servers: str, topic: str, per_trigger: int = 100_000) -> DataFrame:
    """A topic from its beginning: (value, ts) for text, the fields and ts for JSON."""
    raw = spark.readStream.format("kafka").options(**read_options(servers, topic, per_trigger)).load()
    return decoded(raw.select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("ts")), topic)


def sources(spark: SparkSession, servers: str) -> dict[str, DataFrame]:
    """All topics, for streaming.flows.start_topics."""
    return {t: source(spark, servers, t) for t in (*TEXT_TOPICS, *JSON_TOPICS)}


def decoded(raw: DataFrame, topic: str) -> DataFrame:
    """Payloads of a topic; JSON that can't be read becomes nulls, unknown fields are ignored."""
    if topic in JSON_TOPICS:
        return raw.select(F.from_json("value", JSON_TOPICS[topic]).alias("v"), "ts").select("v.*", "ts")
    return raw


def written(rows: DataFrame, topic: str) -> DataFrame:
    """(value): payloads of a topic, text as it is, other columns as JSON."""
    value = F.col("value") if topic in TEXT_TOPICS else F.to_json(F.struct(*rows.columns))
    return rows.select(value.cast("string").alias("value"))


def sink(stream: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    """Write a stream to a topic; compressed, acknowledged by all replicas."""
    return written(stream, topic).writeStream.format("kafka").options(**write_options(servers, topic), checkpointLocation=checkpoint)


def publish(servers: str, topic: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch function that sends its rows to a topic."""
    return lambda batch, n: written(batch, topic).write.format("kafka").options(**write_options(servers, topic)).save()
