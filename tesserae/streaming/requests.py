"""Requests as a stream: each micro-batch is answered with the newest run of the registry, failures go to a table of their own.

A batch's run is written down before the batch is answered, and each batch owns its folders of answers and failures. So a batch that is run
again after a failure gives the same answers by the same run, once. The model's tables are read again only when the registry names a newer run.

Defined cases: without any run all requests fail with `no model`; an empty batch writes empty folders; requests keep their columns; the
columns batch_id and run_id are added and must not be there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.scratch import drop, keep
from tesserae.sources.store import Runs

Respond = Callable[[DataFrame, dict[str, DataFrame]], DataFrame]


class Server:
    """respond(requests, tables of the model) gives the requests' answers with `error`, null where all went well."""

    def __init__(self, runs: Runs, kind: str, tables: list[str], respond: Respond, out: str):
        self.runs, self.kind, self.tables, self.respond, self.out = runs, kind, tables, respond, out.rstrip("/")
        self.run_id: str | None = None
        self.model: dict[str, DataFrame] = {}

    def _run_of(self, batch: DataFrame, batch_id: int) -> str | None:
        """The run written down for the batch, at first the newest one."""
        path = f"{self.out}/runs/batch_id={batch_id}"
        try:
            return batch.sparkSession.read.schema("run_id string").parquet(path).first()[0]
        except (AnalysisException, TypeError):  # not there, or not written to the end
            run_id = self.runs.newest(self.kind)
            batch.sparkSession.createDataFrame([(run_id,)], "run_id string").coalesce(1).write.mode("overwrite").parquet(path)
            return run_id

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        run_id = self._run_of(batch, batch_id)
        if run_id != self.run_id:
            self.run_id, self.model = run_id, {t: self.runs.load(run_id, t) for t in self.tables} if run_id else {}
        rows = keep(batch)
        said = self.respond(rows, self.model) if run_id else rows.withColumn("error", F.lit("no model"))
        said = keep(said.withColumn("run_id", F.lit(run_id).cast("string")))
        good = F.col("error").isNull()
        if run_id:  # without a model there are no answers whose columns are known
            said.where(good).drop("error").write.mode("overwrite").parquet(f"{self.out}/answers/batch_id={batch_id}")
        said.where(~good).select(*(c for c in batch.columns if c in said.columns), "error", "run_id").write.mode("overwrite").parquet(f"{self.out}/failures/batch_id={batch_id}")
        drop(rows, said)

    def start(self, asked: DataFrame, checkpoint: str, **trigger):
        """The running query over a stream of requests; trigger as in DataStreamWriter (availableNow by default)."""
        return asked.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
