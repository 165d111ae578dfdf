"""Kafka source and sink for the event stream; they need Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .online import EVENT


def to_messages(events: DataFrame) -> DataFrame:
    """key and value: the card, and the event as JSON."""
    return events.select(F.col("card_id").alias("key"), F.to_json(F.struct("*")).alias("value"))


def from_messages(messages: DataFrame) -> DataFrame:
    """Events from the JSON in ``value``; a value that is not an event gives nulls."""
    return messages.select(F.from_json(F.col("value").cast("string"), EVENT).alias("e")).select("e.*")


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The topic from its start; with an availableNow trigger a query ends where the topic ended when it began."""
    source = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return from_messages(source.option("startingOffsets", "earliest").option("failOnDataLoss", True).load())


def write_topic(events: DataFrame, servers: str, topic: str) -> None:
    """All events to the topic, keyed by card, so that a card's order holds within its partition."""
    to_messages(events).write.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all").option("topic", topic).save()
