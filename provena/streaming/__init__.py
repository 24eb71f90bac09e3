"""Votes as a stream. The reference has no streaming operators; this is an extension of the vote aggregation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vote_totals(votes: DataFrame, track: list[str], at: str = "at", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Total and greatest confidence per track and window of event time; votes that come later than `late` after the newest are not waited for.

    votes: track, confidence, at. The state is one row per track and open window. Works on a stream and on a table.
    """
    rows = votes.withWatermark(at, late).groupBy(*track, F.window(at, window).alias("window"))
    return rows.agg(F.sum("confidence").alias("total"), F.max("confidence").alias("max")).select(*track, F.col("window.start").alias("start"), "total", "max")
