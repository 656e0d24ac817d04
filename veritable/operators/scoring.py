"""Running models and media processing over tables, and resuming such runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritable.operators.registry import eligible
from veritable.sources.commits import BatchTable


def score_batches(df: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.Series]], keys: list[str], batch_rows: int = 256) -> DataFrame:
    """keys and logit. ``load`` runs once per task and returns the model: a function of a
    batch of rows."""
    fields = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for pdf in batches:
            for at in range(0, len(pdf), batch_rows):
                part = pdf.iloc[at : at + batch_rows]
                yield part[keys].assign(logit=model(part).to_numpy(dtype=float))

    return df.mapInPandas(run, f"{fields}, logit double")


def process(df: DataFrame, work: Callable[[dict], dict], key: str, schema: str) -> DataFrame:
    """key, status, error_message and the fields of ``schema``: ``work`` gets one row as a dict
    and returns its fields; what it raises becomes the row's failure, not the job's. Rows are
    dicts one by one, as fits media, where a row is a file."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                try:
                    rows.append({**dict.fromkeys(names), **work(row), key: row[key], "status": "success", "error_message": None})
                except Exception as error:  # the contract: a bad sample is a result
                    rows.append({**dict.fromkeys(names), key: row[key], "status": "failed", "error_message": f"{type(error).__name__}: {error}"})
            yield pd.DataFrame(rows, columns=[key, "status", "error_message", *names])

    return df.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, status string, error_message string, {schema}")


def resume(registry: DataFrame, metadata: DataFrame, artifacts: DataFrame, work: Callable[[dict], dict], key: str, schema: str, version: str, retry_failed: bool = False) -> DataFrame:
    """Metadata rows of this run: what earlier runs have finished is left out."""
    todo = eligible(registry, metadata, artifacts, key, version, retry_failed)
    done = process(todo, work, key, schema).join(todo.select(key, "retry_count"), key)
    return done.withColumn("preprocessing_version", F.lit(version))


def recovered(registry: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Registry after a run: status from its metadata; rows that a crash left PROCESSING fail."""
    m = metadata.select(key, F.col("status").alias("__s"), F.col("error_message").alias("__e"))
    rows = registry.join(m, key, "left")
    status = F.when(F.col("__s") == "success", "PROCESSED").when(F.col("__s") == "failed", "FAILED").when(F.col("status") == "PROCESSING", "FAILED").otherwise(F.col("status"))
    reason = F.coalesce("__e", F.when(F.col("__s").isNull() & (F.col("status") == "PROCESSING"), "interrupted"))
    return rows.withColumn("failure_reason", reason).withColumn("status", status).drop("__s", "__e")


def throughput(history: DataFrame, at: str, done: str, total: int) -> DataFrame:
    """Rows per second between successive counts, and seconds left at that pace."""
    from pyspark.sql import Window

    # a run's progress log: a few rows per minute, ordered by time within each run
    w = Window.partitionBy("run").orderBy(at)
    seconds = F.unix_timestamp(at) - F.unix_timestamp(F.lag(at).over(w))
    rate = F.try_divide((F.col(done) - F.lag(done).over(w)).cast("double"), seconds)
    return history.withColumn("per_second", rate).withColumn("seconds_left", F.try_divide(F.lit(total) - F.col(done), F.col("per_second")))


def run_batches(registry: DataFrame, table: BatchTable, work: Callable[[dict], dict], key: str, schema: str, version: str, batches: int = 16, stop: Callable[[int, str], None] | None = None) -> DataFrame:
    """Process every row of ``registry`` once, in ``batches`` parts by hash of ``key``, whatever
    the run is stopped by. Each part is one committed batch of ``table``: a run that begins again
    leaves out parts that are there, and what a stopped one wrote without a commit is never
    read. Returns the registry as all committed batches have it (``recovered``): it is derived
    from them, so there is no second write that could be missed. Rows with a null key are one
    part's. ``stop(part, point)`` is told of the points "written" and "committed" (for tests)."""
    tell = stop or (lambda part, point: None)
    for part in range(batches):
        batch = f"{version}-{batches}-{part:04d}"
        if table.committed(batch):
            continue
        todo = registry.where(F.pmod(F.xxhash64(key), F.lit(batches)) == part)
        entry = table.write(process(todo, work, key, schema).withColumn("preprocessing_version", F.lit(version)))
        tell(part, "written")
        table.commit(entry, batch)
        tell(part, "committed")
    done = table.read()
    return recovered(registry, done.where(F.col("preprocessing_version") == version), key)
