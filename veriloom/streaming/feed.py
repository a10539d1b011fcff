"""Attempts that arrive as files, decided with the same plan as a batch.

Nothing in the decision needs state or event time: ranks and groups live within one
attempt, so each micro-batch is decided on its own in ``foreachBatch`` and appended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decide as D


def decide_attempts(attempts: DataFrame, policy: D.Policy = D.Policy()) -> DataFrame:
    """(attempt_id, decision, confidence) of attempts with an evidence array; without evidence the decision is to abstain."""
    items = attempts.select("attempt_id", F.explode_outer("evidence").alias("e")).select("attempt_id", "e.entailment_probability", "e.contradiction_probability")
    scored = F.col("entailment_probability").isNotNull() & F.col("contradiction_probability").isNotNull()
    decided = D.decide(D.query_aggregates(items, ["attempt_id"], policy, scored), policy)
    return decided.select("attempt_id", "decision", "confidence")


def decide_stream(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, policy: D.Policy = D.Policy()) -> StreamingQuery:
    """Follows a folder of Parquet files of attempts and appends their decisions to ``sink``."""
    feed = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        # The folder of a batch is replaced if the batch runs again, so a restart writes nothing twice.
        decide_attempts(batch, policy).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return feed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
