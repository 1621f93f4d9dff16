"""Stages that resume: each output is committed under a key of what it was made from.

A stage's key is a hash of its name, its version and the keys of its inputs; a
source's key is a hash of its rows, whatever their order. Outputs are written to a
folder of that key and count once a marker stands beside them, which is the last
thing written. A run that finds a marker reads the output and doesn't compute it again, so
a run after a failure goes on behind the last finished stage, and one over
other rows begins where they are used.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks

EVENTS = "job_id string, stage string, message string, updated_at double, seq long, extra map<string,string>, reset boolean"


@dataclass(frozen=True)
class Stage:
    """``run`` takes the tables named by ``inputs``, in order; a new ``version`` computes the stage anew."""

    name: str
    inputs: tuple[str, ...]
    run: Callable[..., DataFrame]
    version: str = "1"


class StageFailed(RuntimeError):
    """The stage that failed; those before it stay committed."""


def rows_key(df: DataFrame) -> str:
    """A key of the rows as a multiset: their number and two sums of hashes, one row to the driver."""
    columns = [F.to_json(F.struct(c)) if t.startswith("map") else F.col(f"`{c}`") for c, t in df.dtypes]
    sums = [F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)")) for seed in (1, 2)]
    return hashlib.sha256(json.dumps([df.schema.json(), *map(str, df.agg(F.count("*"), *sums).first())]).encode()).hexdigest()


class Stages:
    """Runs stages of one job below ``folder``, which driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, job_id: str):
        self.spark, self.folder, self.job_id = spark, folder.rstrip("/"), job_id
        self.seq = time.time_ns()

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _marker(self, at: str) -> dict | None:
        files, path = self._files(f"{at}.committed/_SUCCESS")
        return json.loads(self.spark.read.text(f"{at}.committed").first()[0]) if files.exists(path) else None

    def _tell(self, stage: str, message: str, reset: bool = False, **extra: object) -> None:
        self.seq += 1
        row = (self.job_id, stage, message, time.time(), self.seq, {k: str(v) for k, v in extra.items()}, reset)
        self.spark.createDataFrame([row], EVENTS).coalesce(1).write.mode("append").json(f"{self.folder}/events")

    def events(self) -> DataFrame:
        """T-4. Status events of all jobs below the folder, as ``summaries.merged_status`` takes them."""
        return self.spark.read.schema(EVENTS).json(f"{self.folder}/events")

    def run(self, stages: list[Stage], sources: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """C15. The sources and the output of every stage by name; K8: a report of the stages in ``folder``/report."""
        tables = dict(sources)
        keys = {name: rows_key(df) for name, df in sources.items()}
        told = []
        self._tell("queued", f"{len(stages)} stages", reset=True)
        for s in stages:
            key = hashlib.sha256(json.dumps([s.name, s.version, [keys[i] for i in s.inputs]]).encode()).hexdigest()
            at = f"{self.folder}/stages/{s.name}-{key[:32]}"
            done = self._marker(at)
            reused = done is not None
            if not reused:
                self._tell(s.name, "running")
                try:
                    s.run(*[tables[i] for i in s.inputs]).write.mode("overwrite").parquet(at)
                    out = self.spark.read.parquet(at)
                    done = {"key": key, "rows": out.count(), "schema": out.schema.jsonValue()}
                    self.spark.createDataFrame([(json.dumps(done),)], "value string").coalesce(1).write.mode("overwrite").text(f"{at}.committed")
                except Exception as e:
                    self._tell("error", f"{s.name}: {type(e).__name__}", failed_stage=s.name)
                    raise StageFailed(s.name) from e
            tables[s.name], keys[s.name] = self.spark.read.parquet(at), key
            told.append((s.name, done["rows"], reused))
            self._tell(s.name, "reused" if reused else "done", **{f"{s.name}_rows": done["rows"]})
        summary = self.spark.createDataFrame(told, "stage string, rows long, reused boolean")
        sinks.write_report(summary, self.job_id, f"{self.folder}/report")
        self._tell("done", "report written")
        return tables
