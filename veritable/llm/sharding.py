"""Operator 9. Sharding by size-tiered compaction with a versioned manifest.

Arrivals are appended as small immutable shards (Parquet files that nothing changes
afterwards). A shard belongs to the tier of its size: tier t holds sizes up to
``small * fanout ** t``. When a tier has ``fanout`` shards, they are merged in order of arrival
into shards of about ``target`` bytes, each of which takes the place of its first source; a
shard of half of ``target`` or more is final. The table is what the newest manifest lists. A
commit writes a new manifest under the next version's name by a rename that fails if the name
exists, so a reader sees the old or the new list, never a mixture, and of two writers one loses
and starts over. The file system must offer that rename: HDFS does; on local disks and object
stores Hadoop looks first and moves then, so there only one writer at a time is safe. Shards
that no manifest lists (of a lost task or a lost race) are never read.

Row data passes through Spark's writers only; the driver handles file names and sizes. Any
schema works, null values and long texts included; columns that only some arrivals have are
null in the rest, and the manifest keeps the schema of all arrivals. An empty arrival adds a
version without shards; a table of empty ones reads as an empty table. Rows are kept as they
come, repeated ones included.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

SMALL, FANOUT, TARGET = 16 << 20, 4, 128 << 20
AT_ONCE = 16


class ShardTable:
    def __init__(self, spark: SparkSession, path: str, small: int = SMALL, fanout: int = FANOUT, target: int = TARGET):
        self.spark, self.path, self.small, self.fanout, self.target = spark, path.rstrip("/"), small, fanout, target
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """The newest version; 0 for a table without any commit."""
        if not self._fs.exists(self._at("manifests")):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(self._at("manifests"))]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "schema": {"type": "struct", "fields": []}, "shards": []}
        stream = self._fs.open(self._at(f"manifests/v{version:012d}.json"))
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, base: int, shards: list[dict], schema: StructType) -> int:
        text = json.dumps({"version": base + 1, "schema": schema.jsonValue(), "shards": shards}, sort_keys=True)
        self._fs.mkdirs(self._at("manifests"))
        draft, final = self._at(f"manifests/.draft-{uuid.uuid4().hex}"), self._at(f"manifests/v{base + 1:012d}.json")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        # a rename without overwriting: it moves the draft or fails because the name is taken
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(draft, final, options)
        return base + 1

    def _written(self, folder: str, **more) -> list[dict]:
        files = sorted((f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(self._at(folder)) if f.getPath().getName().endswith(".parquet"))
        return [{"name": f"{folder}/{name}", "bytes": size, **more} for name, size in files]

    def append(self, rows: DataFrame) -> int:
        """Every non-empty partition of ``rows`` becomes one shard; returns the new version."""
        folder = f"data/a-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        made = self._written(folder, level=0)
        if len(made) == 1 and self.spark.read.parquet(f"{self.path}/{folder}").isEmpty():
            made = []
        while True:
            base = self.manifest()
            try:
                return self._commit(base["version"], base["shards"] + made, _joined(StructType.fromJson(base["schema"]), rows.schema))
            except Exception as error:
                if "already exist" not in str(error):
                    raise

    def _tier(self, size: int) -> int:
        tier, most = 0, self.small
        while size > most:
            tier, most = tier + 1, most * self.fanout
        return tier

    def plan(self, shards: list[dict]) -> list[list[dict]]:
        """Groups to merge: per tier below the target, in order of arrival."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self._tier(s["bytes"]), []).append(s)
        groups: list[list[dict]] = []
        for _, members in sorted(tiers.items()):
            if len(members) < self.fanout:
                continue
            group: list[dict] = []
            for s in members:
                if group and sum(x["bytes"] for x in group) + s["bytes"] > self.target:
                    groups.append(group)
                    group = []
                group.append(s)
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def _merge(self, group: list[dict]) -> list[dict]:
        """One task reads a group's shards and writes one of target size, without a shuffle."""
        folder = f"data/m-{uuid.uuid4().hex}"
        rows = self.spark.read.option("mergeSchema", True).parquet(*(f"{self.path}/{s['name']}" for s in group))
        rows.coalesce(1).write.parquet(f"{self.path}/{folder}")
        return self._written(folder, level=1 + max(s["level"] for s in group))

    def compact(self) -> int:
        """Merge until no tier is full, up to ``AT_ONCE`` groups side by side. Returns the
        version reached. Merged shards' sources stay until ``vacuum``."""
        while True:
            base = self.manifest()
            if not (groups := self.plan(base["shards"])):
                return base["version"]
            with ThreadPoolExecutor(AT_ONCE) as pool:
                made = list(pool.map(self._merge, groups))
            places = {s["name"]: [] for g in groups for s in g} | {g[0]["name"]: m for g, m in zip(groups, made)}
            try:
                self._commit(base["version"], [x for s in base["shards"] for x in places.get(s["name"], [s])], StructType.fromJson(base["schema"]))
            except Exception as error:
                if "already exist" not in str(error):
                    raise

    def vacuum(self) -> int:
        """Delete shards that the newest manifest does not list; older versions end with it."""
        live = {s["name"].rpartition("/")[0] for s in self.manifest()["shards"]}
        kept = {s["name"] for s in self.manifest()["shards"]}
        removed, files = 0, self._fs.listFiles(self._at("data"), True)
        while files.hasNext():
            name = files.next().getPath().toString().rpartition("/data/")[2]
            if f"data/{name}" not in kept and (name.endswith(".parquet") or f"data/{name}".rpartition("/")[0] not in live):
                self._fs.delete(self._at(f"data/{name}"), False)
                removed += 1
        return removed

    def read(self, version: int | None = None, shard: str = "__shard") -> DataFrame:
        """The table as of a version, with the shard each row is in as a column ``shard``. The
        columns are those of all arrivals, empty ones too. A name that is taken is an error."""
        found = self.manifest(version)
        if not found["version"]:
            raise ValueError("nothing has arrived yet: the schema is unknown")
        schema = StructType.fromJson(found["schema"])
        if shard.lower() in (f.name.lower() for f in schema):
            raise ValueError(f"there is a column {shard} already: give another name for the shard")
        if not found["shards"]:
            return self.spark.createDataFrame([], schema).withColumn(shard, F.lit(None).cast("string"))
        # basePath-less reads of single files add no partition column
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/{s['name']}" for s in found["shards"]))
        return rows.withColumn(shard, F.element_at(F.split("_metadata.file_path", "/data/"), -1))


def _joined(known: StructType, more: StructType) -> StructType:
    """The columns of both; one that both have must have one type."""
    types = {f.name: f.dataType for f in known}
    for f in more:
        if types.get(f.name, f.dataType) != f.dataType:
            raise ValueError(f"column {f.name} came as {types[f.name].simpleString()}, now as {f.dataType.simpleString()}")
    return StructType([*known.fields, *(StructField(f.name, f.dataType) for f in more if f.name not in types)])
