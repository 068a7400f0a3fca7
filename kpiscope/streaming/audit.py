"""An audit table that a stream appends to exactly once, and its readers.

Each micro-batch is written in a folder of its own number, whole or not at all, and then named in a manifest. A
batch that is delivered again finds its number there and adds nothing; rows of a batch that broke off before its
manifest entry are not read, and are replaced when it comes again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "at timestamp, request_id string, persona string, action string, granted boolean, code string, detail string"
MANIFEST = "batch long, n_rows long"


@dataclass(frozen=True)
class AuditTable:
    path: str

    def committed(self, spark: SparkSession) -> DataFrame:
        """(batch, n_rows) of each batch that is whole."""
        try:
            return spark.read.schema(MANIFEST).json(f"{self.path}/manifest/*")
        except Exception as e:  # no batch has been committed yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return spark.createDataFrame([], MANIFEST)

    def append(self, batch: DataFrame, number: int) -> bool:
        """Whether the batch was new; for ``foreachBatch``."""
        spark = batch.sparkSession
        if self.committed(spark).where(F.col("batch") == number).limit(1).count():
            return False
        rows = f"{self.path}/rows/batch={number}"
        batch.select(*[c.split()[0] for c in EVENTS.split(", ")]).write.mode("overwrite").parquet(rows)
        n = spark.read.schema(EVENTS).parquet(rows).count()
        spark.createDataFrame([(number, n)], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{number}")
        return True

    def run(self, stream: DataFrame) -> StreamingQuery:
        """Append all that the stream has now; it goes on where it ended."""
        write = lambda batch, number: self.append(batch, number)
        return stream.writeStream.option("checkpointLocation", f"{self.path}/progress").trigger(availableNow=True).foreachBatch(write).start()

    def events(self, spark: SparkSession) -> DataFrame:
        """All events of whole batches, with the batch of each."""
        done = self.committed(spark).select("batch")
        if not done.limit(1).count():
            return spark.createDataFrame([], f"{EVENTS}, batch long")
        rows = spark.read.schema(f"{EVENTS}, batch long").option("basePath", f"{self.path}/rows").parquet(f"{self.path}/rows")
        return rows.join(done, "batch", "left_semi")

    def by_request(self, spark: SparkSession, request_id: str) -> DataFrame:
        return self.events(spark).where(F.col("request_id") == request_id).orderBy("at", "action")

    def denials(self, spark: SparkSession) -> DataFrame:
        return self.events(spark).where(~F.col("granted"))

    def tail(self, spark: SparkSession, n: int = 50) -> DataFrame:
        """The last n events, newest first; each part keeps its own last n before they meet."""
        return self.events(spark).orderBy(F.desc("at"), F.desc("request_id"), F.desc("action"), F.desc("detail")).limit(n)
