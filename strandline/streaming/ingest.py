"""Streams of captured bodies into the lake."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.sources import capture, lake

LOG = logging.getLogger(__name__)
BODY_SCHEMA = "body string, received_us long, sent_at_us long, user_agent string, ip string"


def body_stream(spark: SparkSession, path: str, files_a_batch: int = 1000, bytes_a_batch: int = 1 << 30) -> DataFrame:
    """Captured bodies from JSON files as they arrive. A micro-batch takes at most so many files or
    bytes, whichever is less: a backlog is worked off in batches of bounded size, and waits in the
    folder, not in memory."""
    return spark.readStream.schema(BODY_SCHEMA).option("maxFilesPerTrigger", files_a_batch).option("maxBytesPerTrigger", bytes_a_batch).json(path)


def freshness(query: StreamingQuery, now_us: int) -> dict:
    """How far a stream is behind: seconds since the newest micro-batch with rows began, its rows,
    its seconds, and whether more rows come in than are worked off."""
    last = next((p for p in reversed(query.recentProgress) if p.numInputRows), None)
    if last is None:
        return {"lag_s": None, "rows": 0, "batch_s": None, "falling_behind": False}
    began = int(datetime.fromisoformat(last.timestamp.replace("Z", "+00:00")).timestamp() * 1e6)
    arriving, done = last.inputRowsPerSecond or 0.0, last.processedRowsPerSecond or 0.0
    return {"lag_s": max(0.0, (now_us - began) / 1e6), "rows": last.numInputRows, "batch_s": last.durationMs.get("triggerExecution", 0) / 1000, "falling_behind": arriving > done}


def ingest(bodies: DataFrame, projects: DataFrame, root: str, checkpoint: str, salt: str | None = None, forward: Callable[[DataFrame, int], None] | None = None, now_us: Callable[[], int] = lambda: time.time_ns() // 1000, **trigger: object) -> StreamingQuery:
    """Start the stream: parse, resolve, enrich and commit each micro-batch to the lake below `root`.

    `projects` (token, project_id) says where a token's events go; unknown tokens are dropped. Late
    events are written to their own day: there is no watermark, and nothing is dropped for its
    age. A retried micro-batch is committed once. `forward`: a further sink for the published
    events, which it may leave out as it likes; its failure doesn't stop the stream.
    """

    def publish(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        events = capture.enrich(capture.resolve(capture.parse(batch)), salt).join(projects, "token")
        events = events.select("project_id", *lake.EVENT_SCHEMA.names)
        made = lake.commit(spark, root, events, None, now_us(), tag=f"batch-{number}")
        if made and made % (2 * lake.KEPT_COMMITS) == 0:
            lake.merge_commits(spark, root)
        if not made or forward is None:
            return
        try:
            forward(lake.read_lake(spark, root, lake.catalog(spark, root).where(F.col("created_generation") == made)).drop("relative_path"), number)
        except Exception as e:  # noqa: BLE001
            LOG.warning("batch %d was not forwarded: %s", number, e)

    return bodies.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish).trigger(**(trigger or {"processingTime": "1 second"})).start()
