"""Count-based sliding windows and exponential smoothing over whole tables (live: ``live``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritable.operators import metrics
from veritable.operators.shared import join_same, materialize, numbered
from veritable.streaming.scan import affine_last, affine_scan, ema_map


def step_size(window: int, overlap: float) -> int:
    if window < 1:
        raise ValueError("a window has at least one element")
    return max(1, int(window * (1 - overlap)))


def effective_step(window: int, overlap: float) -> int:
    """A step longer than the window drops only the window itself."""
    return min(step_size(window, overlap), window)


def positions(df: DataFrame, stream: str, *order: str) -> DataFrame:
    """pos: 1, 2, ... within each stream, by counts of sorted ranges: a stream may hold most rows."""
    return numbered(df, [stream], list(order))


def _with_overhang(df: DataFrame, stream: str, window: int, pos: str, least: int = 4096) -> DataFrame:
    """Rows dealt to blocks of positions (__block); the last window - 1 rows of a block come again
    in the next one, at most an eighth of all, so that each block can slide on its own."""
    block = max(least, 8 * window)
    own = F.floor((F.col(pos) - 1) / block)
    again = F.when(F.col(pos) > (own + 1) * block - (window - 1), own + 1)
    return df.select("*", own.alias("__own"), F.explode(F.array_compact(F.array(own, again))).alias("__block"))


def moving_mean(df: DataFrame, stream: str, windows: list[int], pos: str = "pos", value: str = "x") -> DataFrame:
    """raw<window>: mean of the last ``window`` rows, for each size. ``pos`` numbers a stream's
    rows without gaps. No task holds a whole stream."""
    rows = _with_overhang(df, stream, max(windows), pos)
    slide = Window.partitionBy(stream, "__block").orderBy(pos)
    for window in windows:
        rows = rows.withColumn(f"raw{window}", F.avg(value).over(slide.rowsBetween(1 - window, 0)))
    return rows.where("__block = __own").drop("__block", "__own")


def sliding_windows(df: DataFrame, stream: str, window: int, step: int, value: str = "x") -> DataFrame:
    """Mean of every full window k = 0, 1, ... (elements k*step+1 .. k*step+window): stream,
    window_idx, frame_idx (its last element), raw. The partial tail is dropped. A window is
    a sum over the last ``window`` rows, within blocks of positions."""
    rows = moving_mean(df, stream, [window], value=value)
    full = rows.where((F.col("pos") >= window) & ((F.col("pos") - window) % step == 0))
    return full.select(stream, ((F.col("pos") - window) / step).cast("int").alias("window_idx"), F.col("pos").cast("int").alias("frame_idx"), F.col(f"raw{window}").alias("raw"))


def ema_last(df: DataFrame, stream: str, order: str, value: str, alpha: float) -> DataFrame:
    """The smoothed value after each stream's last element: s = alpha x + (1 - alpha) s. ``order``
    are whole numbers; null values change nothing."""
    return affine_last(df, [stream], order, ema_map(F.col(value), alpha))


def ema_series(windows: DataFrame, stream: str, alpha: float, threshold: float = 0.5) -> DataFrame:
    """window_idx, frame_idx, raw, smoothed and is_fake of every window, by a prefix scan over
    blocks of windows."""
    rows = affine_scan(windows.select(stream, "window_idx", "frame_idx", "raw"), [stream], "window_idx", ema_map(F.col("raw"), alpha))
    return rows.withColumn("is_fake", F.col("smoothed") >= threshold)


def _ends_of_windows(df: DataFrame, stream: str, configs: list[tuple[int, float]], order: str, more: list[str] = []) -> DataFrame:  # noqa: B006
    """stream, window_size, overlap, at, raw (and ``more``) of the rows that end a window of a
    configuration; a stream's first row is there too, with a null raw if it ends none."""
    df = moving_mean(df, stream, sorted({w for w, _ in configs}), order)
    choices = [F.struct(F.lit(w).alias("window_size"), F.lit(o).alias("overlap"), F.lit(effective_step(w, o)).alias("step"), F.col(f"raw{w}").alias("raw")) for w, o in configs]
    rows = df.select(stream, *more, F.col(order).alias("at"), F.explode(F.array(*choices)).alias("c")).select(stream, *more, "at", "c.*")
    full = (F.col("at") >= F.col("window_size")) & ((F.col("at") - F.col("window_size")) % F.col("step") == 0)
    return rows.where(full | (F.col("at") == 1)).withColumn("raw", F.when(full, F.col("raw"))).drop("step")


def sweep(df: DataFrame, stream: str, configs: list[tuple[int, float]], alpha: float, order: str = "pos") -> DataFrame:
    """Final smoothed score of each stream for every (window, overlap); 0.5 where the stream is
    too short for a window. One scan and one shuffle serve all
    configurations; each window size is averaged once."""
    rows = _ends_of_windows(df, stream, configs, order)
    last = affine_last(rows, ["window_size", "overlap", stream], "at", ema_map(F.col("raw"), alpha), "final_score")
    return last.withColumn("final_score", F.coalesce("final_score", F.lit(0.5)))


def evaluate_sweep(df: DataFrame, labels: DataFrame, stream: str, configs: list[tuple[int, float]], alpha: float, order: str = "pos", latency: str | None = None, score: str = "final") -> DataFrame:
    """A row for each (window_size, overlap): the metrics of its streams' scores against
    ``labels`` (stream, y), n_windows and mean_latency (of the column ``latency`` at the rows that end a
    window). A stream's score is its last smoothed value, 0.5 without a window ("final"), or the
    mean of its smoothed values, left out without one ("mean")."""
    if score not in ("final", "mean"):
        raise ValueError(f"unknown score {score}")
    keys = ["window_size", "overlap"]
    rows = _ends_of_windows(df, stream, configs, order, [] if latency is None else [latency])
    rows = affine_scan(rows, [*keys, stream], "at", ema_map(F.col("raw"), alpha))
    full = F.col("raw").isNotNull()
    took = F.sum(F.when(full, F.col(latency).cast("double"))) if latency else F.lit(None).cast("double")
    each = rows.groupBy(*keys, stream).agg(F.count_if(full).alias("windows"), F.coalesce(F.max_by("smoothed", "at"), F.lit(0.5)).alias("final"), F.avg(F.when(full, F.col("smoothed"))).alias("mean"), took.alias("took"))
    each = materialize(each.select(*keys, stream, "windows", "took", F.col(score).alias("prob")), "sweep")
    spent = each.groupBy(*keys).agg(F.sum("windows").alias("n_windows"), F.try_divide(F.sum("took"), F.sum("windows")).alias("mean_latency"))
    return join_same(metrics.all_metrics(each.join(labels, stream), keys), spent, keys)


def smooth_boxes(boxes: Column, alpha: float) -> Column:
    """Running average of one coordinate, cut to whole numbers before it is fed back."""
    first = F.get(boxes, F.lit(0)).cast("int")
    start = F.struct(F.array(first).alias("out"), first.alias("last"))
    rest = F.slice(boxes, F.lit(2), F.greatest(F.size(boxes) - 1, F.lit(0)))

    def step(a, x):
        v = (F.lit(alpha) * x + F.lit(1 - alpha) * a["last"]).cast("int")
        return F.struct(F.concat(a["out"], F.array(v)).alias("out"), v.alias("last"))

    return F.when(F.size(boxes) > 0, F.aggregate(rest, start, step, lambda a: a["out"])).otherwise(F.array().cast("array<int>"))
