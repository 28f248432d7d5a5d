"""Scoring an unbounded target pool with a certified threshold; an addition to what batch runs do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake.functions import heads


def gate(stream: DataFrame, head: heads.Head, tau: float) -> DataFrame:
    """Each record with its score and whether it is answered; no state."""
    scored = stream.withColumn("logit", head.logit(F.col("x"))).withColumns(heads.scored(F.col("logit")))
    return scored.withColumn("answered", heads.answered(F.col("score"), tau))


def windowed_partition(gated: DataFrame, time: str, *, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, answered, below_threshold) by event time; windows close after `late`, later records are dropped."""
    return gated.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count_if("answered").alias("answered"), F.count_if(~F.col("answered")).alias("below_threshold"))
