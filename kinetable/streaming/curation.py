"""Bronze detections taken in as they arrive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinetable.operators.curation import medallion_step
from kinetable.sources.files import remove_folder


def run_medallion_stream(
    detections: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame, int], None],
    outcomes: Callable[[], DataFrame], checkpoint: str, timeout: int = 3600,
) -> StreamingQuery:
    """Apply one medallion step per micro-batch until the source is drained.

    ``load`` reads the state table and ``store`` writes the next one under the
    batch number, so a batch that is run again replaces its own result.
    """
    def step(batch: DataFrame, number: int) -> None:
        store(medallion_step(load(), batch, outcomes(), F.current_timestamp(), timeout), number)

    return (
        detections.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


@dataclass(frozen=True)
class StateStore:
    """States of all recordings in a folder, one table a batch.

    A batch reads the table of the one before it and replaces its own, so a batch that runs again changes nothing.
    """

    spark: SparkSession
    folder: str
    schema: str

    def path(self, batch: int) -> str:
        return f"{self.folder.rstrip('/')}/states/{batch}"

    def load(self, batch: int) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path(batch))

    def step(self, batch: int, detected: DataFrame, outcomes: DataFrame, timeout: int, limit: int | None) -> None:
        states = medallion_step(self.load(batch - 1), detected, outcomes, F.current_timestamp(), timeout, limit)
        names = self.load(-1).columns
        states.select(*names).write.mode("overwrite").parquet(self.path(batch))
        remove_folder(self.path(batch - 2))


def follow_medallion(
    detections: DataFrame, store: StateStore, outcomes: Callable[[], DataFrame], checkpoint: str, *,
    timeout: int = 3600, limit: int | None = None, beat: int = 10,
) -> StreamingQuery:
    """Take in detections as they come and time out stale recordings, also while nothing comes.

    A beat every ``beat`` seconds makes a batch of its own, in which only the clock has moved.
    """
    clock = store.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    beats = clock.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in detections.schema], F.lit(True).alias("_beat"))
    both = detections.withColumn("_beat", F.lit(False)).unionByName(beats)

    def step(batch: DataFrame, number: int) -> None:
        store.step(number, batch.where("not _beat").drop("_beat"), outcomes(), timeout, limit)

    return both.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        processingTime=f"{beat} seconds").start()
