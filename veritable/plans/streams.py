"""Registered queries of live streams, endless sources, resumable runs and scans with ordinals,
with DuckDB SQL.

Importing this module adds them to the catalog's dictionaries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from veritable.operators import scoring
from veritable.operators.shared import shared_dir
from veritable.plans import bindings as b
from veritable.plans.bindings import with_ctes
from veritable.plans.catalog import query
from veritable.sources import chunks, tables
from veritable.sources.commits import BatchTable
from veritable.streaming import live, windows

_LIVE = """, w as (select *, avg(x) over (partition by user_id order by pos rows between 15 preceding and current row) as raw from stream), k as (select user_id, ((pos - 16) // 8)::int as window_idx, pos as frame_idx, raw from w where pos >= 16 and (pos - 16) % 8 = 0),
  l as (select user_id, window_idx, frame_idx, raw, list(raw) over (partition by user_id order by window_idx rows unbounded preceding) as xs from k)
  select user_id::varchar as stream, window_idx, frame_idx::bigint as frame_idx, raw, list_reduce(xs, lambda a, v: 0.3::double * v + 0.7::double * a) as smoothed from l"""


@query(with_ctes("stream", _LIVE))
def t02_live_windows(spark, sf):
    """All events as a stream of files: half of the rows, dealt by hash, come before the others, a
    tenth comes twice, and the query is stopped in between and goes on at its checkpoint."""
    folder = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    rows = b.stream(spark, sf).select(F.col("user_id").cast("string").alias("stream"), F.col("pos").cast("long").alias("pos"), "x")
    half = F.pmod(F.xxhash64("stream", "pos"), F.lit(2))
    twice = F.pmod(F.xxhash64("pos", "stream"), F.lit(10)) == 0
    for arrival in (0, 1):
        rows.where((half == arrival) | twice).write.mode("append").parquet(f"{folder}/arrivals")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/arrivals")
        live.run_available(live.live_windows(stream, 16, 8, 0.3), f"{folder}/windows", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/windows").select("stream", "window_idx", "frame_idx", "raw", "smoothed")


@query("select user_id, event_id, value from events")
def s39_chunk_stream(spark, sf):
    """All events as chunks of an endless source, taken in by two runs of one query."""
    folder = f"{shared_dir(spark)}/device-{uuid.uuid4().hex}"
    rows = b.table(spark, sf, "events").select("user_id", "event_id", "value")
    for number in (0, 1):
        rows.where(F.col("event_id") % 2 == number).write.parquet(chunks.chunk_path(f"{folder}/chunks", number))
        stream = chunks.read_chunks(spark, f"{folder}/chunks", "user_id long, event_id long, value double")
        live.run_available(stream, f"{folder}/taken", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/taken")


def _sweep_sql(configs: list[tuple[int, float]]) -> str:
    parts = [f"""select {size} as window_size, {overlap}::double as overlap, user_id, pos, raw, ms from (select *, avg(x) over (partition by user_id order by pos rows between {size - 1} preceding and current row) as raw, (pos % 7) / 4.0::double as ms from stream) where pos >= {size} and (pos - {size}) % {windows.effective_step(size, overlap)} = 0""" for size, overlap in configs]
    return f""", k as ({" union all ".join(parts)}), f as (select window_size, overlap, user_id, count(*) as n, sum(ms) as ms, list_reduce(list(raw order by pos), lambda a, v: 0.3::double * v + 0.7::double * a) as s from k group by 1, 2, 3),
      g as (select c.window_size, c.overlap, u.user_id, coalesce(n, 0) as n, ms, coalesce(s, 0.5) as prob, (u.user_id % 2 = 0) as y from (select distinct window_size, overlap from k) c cross join (select distinct user_id from stream) u left join f on f.window_size = c.window_size and f.overlap = c.overlap and f.user_id = u.user_id),
      r as (select *, rank() over (partition by window_size, overlap order by prob) + (count(*) over (partition by window_size, overlap, prob) - 1) / 2 as rk from g)
      select window_size, overlap, round(avg((prob >= 0.5 and y or prob < 0.5 and not y)::int), 9) as accuracy, round((sum(rk) filter (y) - count(*) filter (y) * (count(*) filter (y) + 1) / 2) / count(*) filter (y) / count(*) filter (not y), 9) as roc_auc, count(*) as support, sum(n)::bigint as n_windows, round(sum(ms) / sum(n), 9) as mean_latency from r group by 1, 2"""


_CONFIGS = [(size, overlap) for size in (8, 16, 32) for overlap in (0.0, 0.5)]


@query(with_ctes("stream", _sweep_sql(_CONFIGS)))
def t10_sweep_metrics(spark, sf):
    rows = b.stream(spark, sf).withColumn("ms", (F.col("pos") % 7) / 4)
    labels = rows.select("user_id").distinct().withColumn("y", (F.col("user_id") % 2 == 0).cast("int"))
    out = windows.evaluate_sweep(rows, labels, "user_id", _CONFIGS, 0.3, latency="ms")
    return out.select("window_size", "overlap", *(F.round(c, 9).alias(c) for c in ("accuracy", "roc_auc")), "support", "n_windows", F.round("mean_latency", 9).alias("mean_latency"))


class _Stopped(Exception):
    pass


@query(with_ctes("registry", """select o_orderkey, split, label, case when o_orderkey % 11 = 0 then 'FAILED' else 'PROCESSED' end as status,
  case when o_orderkey % 11 = 0 then 'ValueError: no picture in ' || o_orderkey end as failure_reason from registry"""))
def u05_resumed_run(spark, sf):
    """A run over all orders that is stopped after a write without its commit, then after a
    commit, and begun again each time."""
    table = BatchTable(spark, f"{shared_dir(spark)}/run-{uuid.uuid4().hex}")
    registry = b.registry(spark, sf)

    def work(row: dict) -> dict:
        if row["o_orderkey"] % 11 == 0:
            raise ValueError(f"no picture in {row['o_orderkey']}")
        return {"width": row["o_orderkey"] % 640}

    def stopper(part: int, point: str):
        def stop(now: int, where: str) -> None:
            if (now, where) == (part, point):
                raise _Stopped

        return stop

    for stop in (stopper(1, "written"), stopper(2, "committed"), None):
        try:
            done = scoring.run_batches(registry, table, work, "o_orderkey", "width long", "v3", batches=4, stop=stop)
        except _Stopped:
            continue
    return done.select("o_orderkey", "split", "label", "status", "failure_reason")


@query("select l_orderkey, l_linenumber, row_number() over () - 1 as ordinal from lineitem")
def s22_ordinals(spark, sf):
    return tables.numbered_scan(b.table(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "ordinal")

