"""Conversations and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank

DEFAULT_TITLE = "New conversation"


def list_conversations(conversations: DataFrame, order: str = "created_at") -> DataFrame:
    """Newest first; a blank title gets the default one."""
    title = F.when(is_blank(F.col("title")), F.lit(DEFAULT_TITLE)).otherwise(F.col("title"))
    return conversations.withColumn("title", title).orderBy(F.col(order).desc())


def conversations_of(messages: DataFrame) -> DataFrame:
    """Conversations behind a message table: the first user text is the title."""
    return messages.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("text")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("title"),
        F.count(F.lit(1)).alias("messages"), F.max("turn").alias("last_turn"))


def list_messages(messages: DataFrame, conv_id) -> DataFrame:
    return messages.filter(F.col("conv_id") == conv_id).orderBy("turn")


def append_messages(conversations: DataFrame, messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with the new ones added, and the new ones of unknown conversations."""
    known = conversations.select("conv_id").distinct()
    return (
        messages.unionByName(new.join(known, "conv_id", "left_semi")),
        new.join(known, "conv_id", "left_anti"),
    )
