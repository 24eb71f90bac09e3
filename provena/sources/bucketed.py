"""Tables bucketed by a key, so that later joins on it need no exchange."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.shared import shared_dir


def bucketed(df: DataFrame, key: str, buckets: int, label: str = "bucketed", apart: bool = False) -> DataFrame:
    """df written as a table of `buckets` buckets by key, sorted by it, in the shared folder, and read again.

    Tables that are to be joined need the same number of buckets. The rows of a bucket are brought together by one exchange while writing, so a
    bucket is one file; the table stays in the session's catalogue and in the folder until it is dropped. apart: df is partitioned so already.
    """
    name = f"{label}_{uuid.uuid4().hex}"
    path = f"{shared_dir(df.sparkSession)}/{name}"
    (df if apart else df.repartition(buckets, F.col(key))).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def release_media(responses: DataFrame, catalogue: DataFrame, discs: DataFrame) -> DataFrame:
    """(release_id, medium_pos, streams, n_tracks, n_discs): media of responses with the catalogue's medium at the same position and its discs.

    A release that the catalogue does not know is skipped; a medium that it does not have has no tracks. All three are joined on release_id alone and media are
    found by position within the release, so tables bucketed by release meet without an exchange.

    responses: release_id, medium_pos, streams. catalogue: release_id, media (array of medium_pos, n_tracks). discs: release_id, media (array of medium_pos, n_discs).
    """
    rows = responses.join(catalogue.select("release_id", F.col("media").alias("_media")).hint("merge"), "release_id")
    rows = rows.join(discs.select("release_id", F.col("media").alias("_discs")).hint("merge"), "release_id", "left")
    at = lambda c, n: F.get(F.filter(c, lambda m: m["medium_pos"] == F.col("medium_pos")), F.lit(0))[n]
    return rows.select("release_id", "medium_pos", "streams", at("_media", "n_tracks").alias("n_tracks"), F.coalesce(at("_discs", "n_discs"), F.lit(0).cast("long")).alias("n_discs"))
