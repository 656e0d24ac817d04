"""Tables to which batches are appended exactly once.

A batch is written to a folder of its own attempt, then committed: a log entry under the batch's
name, which names the attempt. Only committed attempts are read. A batch that has an entry is not
written again; one that was stopped before its entry is written anew, under another attempt, and
what the first left is never read. The entry is a file renamed into place: on HDFS, and for
one writer at a time on other stores, a name is taken once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class BatchTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    @staticmethod
    def _entry(batch: str) -> str:
        if not batch or "/" in batch or batch[0] in "._":
            raise ValueError(f"no name for a batch: {batch!r}")
        return f"{batch}.json"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._at("_log", self._entry(batch)))

    def append(self, rows: DataFrame, batch: str) -> bool:
        """False if the batch was there already; ``rows`` are not computed then."""
        if self.committed(batch):
            return False
        return self.commit(self.write(rows), batch)

    def write(self, rows: DataFrame) -> dict:
        """An attempt, not yet to be seen: what ``commit`` takes."""
        attempt = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{attempt}")
        return {"attempt": attempt, "schema": rows.schema.json()}

    def commit(self, entry: dict, batch: str) -> bool:
        """False if another attempt has taken the batch's name before."""
        name, draft = self._at("_log", self._entry(batch)), self._at("_drafts", entry["attempt"])
        self._fs.mkdirs(self._at("_log"))
        out = self._fs.create(draft, True)
        try:
            out.write(json.dumps(entry).encode())
        finally:
            out.close()
        if self._fs.exists(name) or not self._fs.rename(draft, name):
            self._fs.delete(draft, False)
            return False
        return True

    def batches(self) -> dict[str, dict]:
        """The log, by batch: one small entry for each."""
        if not self._fs.exists(self._at("_log")):
            return {}
        files = [r for r in self.spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(f"{self.path}/_log").selectExpr("_metadata.file_name as name", "value").collect()]
        return {r["name"].removesuffix(".json"): json.loads(r["value"]) for r in files}

    def read(self) -> DataFrame | None:
        """All committed rows; None while there is no batch."""
        log = self.batches()
        if not log:
            return None
        schema = StructType.fromJson(json.loads(log[max(log)]["schema"]))
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{log[b]['attempt']}" for b in sorted(log)))
