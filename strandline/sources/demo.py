"""A made-up site's events, the same for the same arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.contract import InvalidQuery
from strandline.functions.properties import PROMOTED
from strandline.functions.times import DAY, SECOND

MAX_EVENTS = 2_000_000
PAGES = ["/", "/pricing", "/docs", "/blog", "/signup", "/changelog"]


def generate(spark: SparkSession, now: int, visitors: int = 4000, n_days: int = 90, seed: int = 0) -> DataFrame:
    """Events of `visitors` over the days up to now, made on the executors: visits of one to eight
    page views, some clicks and sign-ups; at most two million."""
    if visitors * 24 > MAX_EVENTS:
        raise InvalidQuery("at most 2,000,000 events")
    u = lambda *by: F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(1_000_000)) / 1e6
    visits = spark.range(visitors).withColumn("visit", F.explode(F.sequence(F.lit(0), F.floor(u("id") * 3).cast("int"))))
    start = now - ((u("id", "visit", F.lit("t")) * n_days + 0.02) * DAY).cast("long")
    rows = visits.withColumn("start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(u("id", "visit", F.lit("n")) * 8).cast("int"))))
    place = u("id", "visit", "k", F.lit("p"))
    name = F.when(F.col("k") == 0, "$pageview").when(place < 0.15, "$autocapture").when(place > 0.97, "signup").otherwise("$pageview")
    path = F.get(F.array(*map(F.lit, PAGES)), F.floor(u("id", "visit", "k") * len(PAGES)).cast("int"))
    at = F.col("start") + F.col("k") * 20 * SECOND
    own = {"pathname": path, "session_id": F.concat_ws("-", F.lit("s"), "id", "visit"), "browser": F.get(F.array(F.lit("Chrome"), F.lit("Firefox"), F.lit("Safari")), F.pmod("id", F.lit(3)).cast("int")), "lib": F.lit("web")}
    promoted = [own.get(c, F.lit(None).cast("string")).alias(c) for c in PROMOTED.values()]
    return rows.select(F.md5(F.concat_ws("-", F.lit(seed), "id", "visit", "k")).alias("uuid"), name.alias("event"), F.concat(F.lit("visitor-"), "id").alias("distinct_id"), F.timestamp_micros(at).alias("timestamp"), F.to_json(F.struct(path.alias("$pathname"))).alias("properties"), *promoted)
