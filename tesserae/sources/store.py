"""Feature tables and the registry of runs, as Parquet."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of scalers and models in the order in which they are preferred.
SCALERS, MODELS = ("knn_scaler", "svm_scaler", "scaler"), ("knn", "svm")


def write_features(df: DataFrame, path: str) -> None:
    """Partitioned by split, so that a reader of one split opens only its files."""
    _need(df, "label", "features", "split")
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_features(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    _need(df, "label", "features", "split")
    return df.where(F.col("split") == split).drop("split") if split else df


def _need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


@dataclass(frozen=True)
class Runs:
    """Runs below a folder: each has tables under run_id=<id>, and a row in `runs` with its kind, parameters and metrics."""

    spark: SparkSession
    root: str

    def _path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def save(self, kind: str, tables: dict[str, DataFrame], parameters: dict | None = None, metrics: dict | None = None, run_id: str | None = None) -> str:
        """Writes the tables, then the row that makes the run visible. A named run (such as `best`) replaces its tables."""
        run_id = run_id or f"{kind}-{uuid.uuid4().hex[:12]}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self._path(f"tables/{name}/run_id={run_id}"))
        row = [(run_id, kind, json.dumps(sorted(tables)), json.dumps(parameters or {}, sort_keys=True), json.dumps(metrics or {}, sort_keys=True))]
        rows = self.spark.createDataFrame(row, "run_id string, kind string, tables string, parameters string, metrics string").withColumn("saved_at", F.current_timestamp())
        rows.coalesce(1).write.mode("append").parquet(self._path("runs"))
        return run_id

    def runs(self) -> DataFrame:
        """One row for each run: the last that was saved."""
        df = self.spark.read.parquet(self._path("runs"))
        return df.groupBy("run_id").agg(F.max_by(F.struct("kind", "tables", "parameters", "metrics"), "saved_at").alias("x"), F.max("saved_at").alias("saved_at")).select("run_id", "x.*", "saved_at")

    def load(self, run_id: str, table: str) -> DataFrame:
        return self.spark.read.parquet(self._path(f"tables/{table}/run_id={run_id}"))

    def scaler(self, run_id: str) -> DataFrame:
        """The first of SCALERS that the run has."""
        return self._first(run_id, SCALERS)

    def model(self, run_id: str) -> tuple[str, DataFrame]:
        """(kind, table) of the first of MODELS that the run has."""
        kind = next((k for k in MODELS if k in self._tables(run_id)), None)
        if kind is None:
            raise FileNotFoundError(f"run {run_id} has none of {MODELS}")
        return kind, self.load(run_id, kind)

    def best(self, kind: str, metric: str = "accuracy") -> str | None:
        """The run with the largest metric; of equal ones the first saved."""
        value = F.get_json_object("metrics", f"$.{metric}").cast("double")
        rows = self.runs().where((F.col("kind") == kind) & value.isNotNull()).orderBy(value.desc(), "saved_at").limit(1).collect()
        return rows[0]["run_id"] if rows else None

    def newest(self, kind: str) -> str | None:
        """The run of a kind that was saved last; None if there is none yet."""
        try:
            rows = self.runs().where(F.col("kind") == kind).orderBy(F.col("saved_at").desc(), "run_id").limit(1).collect()
        except AnalysisException:  # nothing saved
            return None
        return rows[0]["run_id"] if rows else None

    def _tables(self, run_id: str) -> list[str]:
        rows = self.runs().where(F.col("run_id") == run_id).collect()
        return json.loads(rows[0]["tables"]) if rows else []

    def _first(self, run_id: str, names: tuple[str, ...]) -> DataFrame:
        have = self._tables(run_id)
        name = next((n for n in names if n in have), None)
        if name is None:
            raise FileNotFoundError(f"run {run_id} has none of {names}")
        return self.load(run_id, name)


def log_sweep(swept: DataFrame, path: str, run_id: str) -> None:
    swept.withColumn("run_id", F.lit(run_id)).write.mode("append").parquet(path)
