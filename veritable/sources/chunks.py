"""An endless source: a folder into which a device, or a job, puts numbered chunks of rows.

A chunk is a folder ``chunk-000000``, ``chunk-000001`` and so on of Parquet files; it counts
once it has its ``_SUCCESS`` file, so half-written ones are never read. The offset is the number of
chunks read: a batch is a range of numbers, the same whenever it is asked for again, and each of
its files is a partition. A lost task reads its file again; a restarted query goes on at
its checkpoint. When a batch is done for good, ``_released`` says how many chunks may be deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def chunk_path(folder: str, number: int) -> str:
    return f"{folder}/chunk-{number:06d}"


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


@dataclass
class ChunkFile(InputPartition):
    path: str


class ChunkReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.folder, self.names = options["path"].rstrip("/"), schema.fieldNames()
        self.most = int(options.get("chunksPerBatch", "0"))
        self.seen = 0

    def initialOffset(self) -> dict:
        return {"chunks": 0}

    def latestOffset(self) -> dict:
        store, folder = _store(self.folder)
        n = self.seen
        while store.get_file_info(f"{chunk_path(folder, n)}/_SUCCESS").type == pa.fs.FileType.File and not (self.most and n >= self.seen + self.most):
            n += 1
        return {"chunks": n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, folder = _store(self.folder)
        self.seen = max(self.seen, end["chunks"])
        files = []
        for n in range(start["chunks"], end["chunks"]):
            found = store.get_file_info(pa.fs.FileSelector(chunk_path(folder, n)))
            names = sorted(f.base_name for f in found if f.is_file and f.base_name[0] not in "._")
            files += [ChunkFile(f"{chunk_path(self.folder, n)}/{name}") for name in names]
        return files

    def read(self, partition: ChunkFile) -> Iterator[pa.RecordBatch]:
        store, path = _store(partition.path)
        with store.open_input_file(path) as file:
            yield from pa.parquet.ParquetFile(file).iter_batches(columns=self.names)

    def commit(self, end: dict) -> None:
        store, folder = _store(self.folder)
        with store.open_output_stream(f"{folder}/_released") as file:
            file.write(str(end["chunks"]).encode())


class Chunks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        raise ValueError("give the chunks' schema: spark.readStream.format('chunks').schema(...)")

    def streamReader(self, schema: StructType) -> ChunkReader:
        return ChunkReader(schema, self.options)


def read_chunks(spark: SparkSession, folder: str, schema: str, chunks_per_batch: int = 0) -> DataFrame:
    """A stream of the rows of all chunks, past and future."""
    spark.dataSource.register(Chunks)
    return spark.readStream.format("chunks").schema(schema).option("chunksPerBatch", str(chunks_per_batch)).load(folder)
