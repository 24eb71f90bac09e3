"""Rate limits, caches and pages of lookups, as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from provena.schema import PAGE_SIZE


def rate_slots(arrivals: DataFrame, interval: Column, service: str = "service", arrival: str = "arrival", order: list[str] | None = None, calls: int = 4096) -> DataFrame:
    """arrivals with slot: slot_i = max(arrival_i, slot_(i-1) + interval), per service. `order` has to follow the arrival.

    In closed form slot_i = i * I + running maximum of (arrival_k - k * I). A service is cut into slices of the time of `calls` intervals; the
    number of calls and the maximum before a slice come from one row per slice, so no task holds a service.
    """
    slice_ = F.floor(F.col(arrival) / (interval * F.lit(calls).cast("long")))
    within = Window.partitionBy(service, "_s").orderBy(*(order or [arrival]))
    rows = arrivals.withColumn("_s", slice_).withColumn("_i", F.row_number().over(within).cast("long") - 1).withColumn("_a", F.col(arrival) - F.col("_i") * interval)
    before = Window.partitionBy("_v").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    slices = rows.groupBy(F.col(service).alias("_v"), F.col("_s").alias("_t")).agg(F.count("*").alias("_n"), F.max("_a").alias("_m"))
    slices = slices.withColumn("_b", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("_p", F.max(F.col("_m") - F.col("_b") * interval).over(before))
    rows = rows.withColumn("_r", F.max("_a").over(within.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_i") * interval)
    rows = rows.join(slices.select("_v", "_t", "_b", "_p"), F.col(service).eqNullSafe(F.col("_v")) & F.col("_s").eqNullSafe(F.col("_t")))
    return rows.withColumn("slot", F.greatest("_r", F.col("_p") + (F.col("_b") + F.col("_i")) * interval)).select(*arrivals.columns, "slot")


def cached(requests: DataFrame, key: list[str], order: str) -> DataFrame:
    """requests with hit: an earlier request had the same key."""
    return requests.withColumn("hit", F.row_number().over(Window.partitionBy(*key).orderBy(order)) > 1)


def cache_statistics(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"))


def covering_cache(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests answered by a stored query on the same (entity, id, resource) whose parameters hold all of the request's.

    params: an array of names; limit and offset do not count.
    """
    asked = requests.withColumn("_p", F.array_except("params", F.array(F.lit("limit"), F.lit("offset"))))
    have = stored.select("entity", "id", "resource", F.col("params").alias("_s"), "answer")
    rows = asked.join(have, ["entity", "id", "resource"]).where(F.size(F.array_except("_p", "_s")) == 0)
    return rows.groupBy(*requests.columns).agg(F.min("answer").alias("answer"))


def pages(totals: DataFrame, key: list[str], total: str = "total", page: int = PAGE_SIZE) -> DataFrame:
    """(key, offset, rows) of the pages that a browse of `total` rows fetches, up to and with the empty page that ends it."""
    last = F.call_function("div", F.col(total) + page - 1, F.lit(page))
    out = totals.select(*key, F.col(total), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_k"))
    # the offset moves by the rows received, so the empty page stands at the total
    offset = F.least(F.col("_k") * page, F.col(total))
    return out.select(*key, offset.cast("long").alias("offset"), F.least(F.lit(page), F.col(total) - offset).cast("long").alias("rows"))


def retries(attempts: DataFrame, key: list[str], limit: int = 5) -> DataFrame:
    """The outcome of each request: the first attempt that is not a 5xx answer, of `limit` at most; else the last one.

    attempts: key, attempt (from 1), http.
    """
    rows = attempts.where(F.col("attempt") <= limit)
    done = rows.groupBy(*key).agg(F.min(F.when(~F.col("http").between(500, 599), F.struct("attempt", "http"))).alias("a"), F.max(F.struct("attempt", "http")).alias("z"))
    end = F.coalesce("a", "z")
    return done.select(*key, end["attempt"].alias("attempts"), end["http"].alias("http"))


def request_body(fingerprints: DataFrame, lookup: str = "lookup") -> DataFrame:
    """One body per lookup from (lookup, ordinal, stream_index, fingerprint, duration): numbered parameters in order, and the order of the streams."""
    rows = fingerprints.withColumn("_n", F.row_number().over(Window.partitionBy(lookup).orderBy("ordinal", "stream_index")) - 1)
    part = F.concat(F.lit("&duration."), F.col("_n").cast("string"), F.lit("="), F.col("duration").cast("string"), F.lit("&fingerprint."), F.col("_n").cast("string"), F.lit("="), F.col("fingerprint"))
    rows = rows.groupBy(lookup).agg(F.sort_array(F.collect_list(F.struct("_n", part.alias("p"), "stream_index"))).alias("x"))
    return rows.select(lookup, F.array_join(F.transform("x", lambda y: y["p"]), "").alias("body"), F.transform("x", lambda y: y["stream_index"]).alias("streams"))


def original_streams(answers: DataFrame, bodies: DataFrame, lookup: str = "lookup") -> DataFrame:
    """answers (lookup, index, ...) with the caller's stream_index: the place that the request gave it."""
    order = bodies.select(lookup, F.posexplode("streams").alias("_k", "stream_index"))
    return answers.join(order, (answers[lookup] == order[lookup]) & (F.col("index") == F.col("_k") + 1)).drop(order[lookup]).drop("_k")
