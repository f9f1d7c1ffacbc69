"""Incremental preparation: files that arrive are prepared once each, whatever is restarted."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from datetime import UTC, datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from ..operators.manifest import missing

log = logging.getLogger(__name__)

#: Seconds without a finished batch after which a run counts as stalled.
STALL = 10.0


class Progress(StreamingQueryListener):
    """Rows that queries have taken in, and whether they stand still; add it by ``spark.streams.addListener``."""

    def __init__(self, stall: float = STALL):
        self.stall, self.rows, self.batches, self.running, self.last = stall, 0, 0, 0, time.monotonic()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.running, self.last = self.running + 1, time.monotonic()

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows, self.batches, self.last = self.rows + event.progress.numInputRows, self.batches + 1, time.monotonic()

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.last = time.monotonic()

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.running -= 1

    def stalled(self) -> bool:
        """Whether a query runs and nothing has come from it for ``stall`` seconds; that is logged, too."""
        waited = time.monotonic() - self.last
        if self.running > 0 and waited > self.stall:
            log.warning("no batch for %.0f seconds; %d rows so far", waited, self.rows)
            return True
        return False


def set_broken_state_aside(spark: SparkSession, checkpoint: str) -> str | None:
    """Rename a checkpoint whose logs can't be read, and give its new name; None if it is sound or not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(checkpoint).getFileSystem(spark._jsc.hadoopConfiguration())
    logs = [f"{checkpoint}/{d}" for d in ("offsets", "commits") if files.exists(path(f"{checkpoint}/{d}"))]
    if not logs:
        return None
    try:
        # Every log file begins with its version.
        broken = not spark.read.format("binaryFile").load(logs).where(~F.col("content").cast("string").startswith("v1")).isEmpty()
    except (PySparkException, Py4JJavaError):
        broken = True
    if not broken:
        return None
    aside = f"{checkpoint}_corrupted_{datetime.now(UTC):%Y%m%d_%H%M%S}"
    if not files.rename(path(checkpoint), path(aside)):
        raise OSError(f"{checkpoint} is broken and can't be renamed")
    log.warning("broken state renamed to %s; starting anew", aside)
    return aside


def prepare(spark: SparkSession, incoming: str, schema: StructType, outputs: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], key: str = "key", max_files: int = 64) -> StreamingQuery:
    """Follow ``incoming`` (Parquet) and append ``transform`` of rows with new keys to ``outputs``.

    ``max_files`` per trigger holds back a flood. A batch that is run again
    finds its keys written and adds nothing, so that a broken state is set aside
    and all files are read again. Runs until it has seen all there is.
    """
    set_broken_state_aside(spark, checkpoint)

    def append(batch: DataFrame, _: int) -> None:
        new = transform(batch).dropDuplicates([key])
        try:
            done = spark.read.parquet(outputs)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        (missing(new, done, key) if done is not None else new).write.mode("append").parquet(outputs)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(incoming)
    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
