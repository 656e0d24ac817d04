import random
import re
import time

import pandas as pd
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veritable.sources import chunks as C
from veritable.streaming import live as L
from veritable.streaming import windows as W
from veritable.streaming.scan import affine_last, affine_scan, ema_map


@pytest.mark.parametrize("window,overlap,want", [(16, 0.5, 8), (32, 0.75, 8), (16, 0.0, 16), (16, 0.99, 1)])
def test_step_size(window, overlap, want):
    assert W.step_size(window, overlap) == want


@pytest.mark.parametrize("xs,alpha,want", [([0.8, 0.6], 0.3, 0.74), ([0.8] * 20, 0.3, 0.8), ([0.5, 0.9], 0.0, 0.5), ([0.5, 0.9], 1.0, 0.9)])
def test_ema(spark, xs, alpha, want):
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "s long, pos int, x double")
    assert W.ema_last(df, "s", "pos", "x", alpha).first().smoothed == pytest.approx(want, abs=1e-9)


def by_hand(xs, window, step, alpha):
    buffer, s, out = [], None, []
    for i, x in enumerate(xs, 1):
        buffer.append(x)
        if len(buffer) >= window:
            raw = sum(buffer[:window]) / window
            s = raw if s is None else alpha * raw + (1 - alpha) * s
            out.append((len(out), i, raw, s))
            buffer = buffer[step:]
    return out


@pytest.mark.parametrize("window,step", [(4, 2), (5, 5), (3, 1)])
def test_batch_windows_equal_the_loop(spark, window, step):
    r = random.Random(window)
    streams = {k: [r.random() for _ in range(n)] for k, n in (("a", 23), ("b", window), ("c", 1))}
    df = spark.createDataFrame([(k, i, x) for k, xs in streams.items() for i, x in enumerate(xs, 1)], "stream string, pos int, x double")
    got = W.ema_series(W.sliding_windows(df, "stream", window, step), "stream", 0.3).collect()
    for k, xs in streams.items():
        mine = sorted((g.window_idx, g.frame_idx, g.raw, g.smoothed) for g in got if g.stream == k)
        want = by_hand(xs, window, step, 0.3)
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert [v for m in mine for v in m[2:]] == pytest.approx([v for w in want for v in w[2:]])
    sweep = {(s.window_size, s.stream): s.final_score for s in W.sweep(df, "stream", [(window, 0.0)], 0.3).collect()}
    assert sweep[(window, "c")] == (0.5 if window > 1 else streams["c"][0])


def same_windows(got, stream, want):
    mine = sorted((g.window_idx, g.frame_idx, g.raw, g.smoothed) for g in got if g.stream == stream)
    assert [m[:2] for m in mine] == [w[:2] for w in want]
    assert [x for m in mine for x in m[2:]] == pytest.approx([x for w in want for x in w[2:]])


ROWS = "stream string, pos long, x double"


def take_in(spark, folder, rows, part):
    """One more arrival, and a run of the query over whatever is new."""
    spark.createDataFrame(rows, ROWS).coalesce(1).write.json(f"{folder}/in/{part}")
    live = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).json(f"{folder}/in/*")
    L.run_available(L.live_windows(live, 4, 2, 0.3), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema(L.SCHEMA).parquet(f"{folder}/out").collect()


def test_live_windows_in_disorder_over_batches_and_restarts(spark, tmp_path):
    r = random.Random(1)
    xs = {k: [r.random() for _ in range(30)] for k in ("a", "b")}
    rows = [(k, i, v[i - 1]) for k, v in xs.items() for i in range(1, 31)]
    r.shuffle(rows)
    for part in range(3):
        odd = [(None, 1, 0.5), ("a", None, 0.5), ("a", 3, None), ("a", 0, 0.5)]
        again = rows[:7] + [rows[20 * part]] * 3 if part else []
        got = take_in(spark, tmp_path, rows[20 * part : 20 * part + 20] + again + odd, part)
    for k, v in xs.items():
        same_windows(got, k, by_hand(v, 4, 2, 0.3))
    assert {g.stream for g in got} == {"a", "b"}


def test_live_windows_pass_over_what_stays_away(spark, tmp_path):
    rows = [("a", i, i / 32) for i in range(1, 21) if i != 6]
    spark.createDataFrame(rows, ROWS).coalesce(1).write.json(f"{tmp_path}/in/0")
    live = spark.readStream.schema(ROWS).json(f"{tmp_path}/in/*")
    out = L.live_windows(live, 4, 2, 0.3, patience_ms=500).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    job = out.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="1 second").start()
    want = by_hand([x for _, _, x in rows], 4, 2, 0.3)
    got, until = [], time.monotonic() + 60
    try:
        while len(got) < len(want) and time.monotonic() < until:
            time.sleep(1)
            got = spark.read.schema(L.SCHEMA).parquet(f"{tmp_path}/out").collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
    finally:
        job.stop()
    assert [(g.window_idx, g.smoothed) for g in sorted(got, key=lambda g: g.window_idx)] == [(k, pytest.approx(s)) for k, (_, _, _, s) in enumerate(want)]


class Store:
    """A state store of one key, in memory, that counts calls which write."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def _state(self, name, *_):
        return State(self, name)

    getValueState = getListState = getMapState = _state


class State:
    def __init__(self, store, name):
        self.store, self.name = store, name

    def exists(self):
        return self.name in self.store.kept

    def get(self):
        kept = self.store.kept.get(self.name)
        return iter(kept) if isinstance(kept, list) else kept

    def iterator(self):
        return iter(self.store.kept[self.name])

    def _write(self, value):
        self.store.calls += 1
        self.store.kept[self.name] = value

    update = put = _write

    def clear(self):
        self.store.calls += 1
        self.store.kept.pop(self.name, None)

    def appendValue(self, value):
        self._write([*self.store.kept.get(self.name, []), value])

    def updateValue(self, key, value):
        self._write([*self.store.kept.get(self.name, []), (key, value)])

    def removeKey(self, key):
        self._write([kv for kv in self.store.kept[self.name] if kv[0] != key])


def test_live_windows_call_the_store_a_few_times_however_many_values_wait():
    r = random.Random(2)
    xs = [r.random() for _ in range(400)]
    order = list(range(2, 401))
    r.shuffle(order)
    store, out = Store(), []
    live = L.Windows(4, 2, 0.3, 0.5, None)
    live.init(store)
    for came in (order[:150], order[100:300], order[300:], [1], [1, 7]):
        store.calls = 0
        for pdf in live.handleInputRows(("a",), iter([pd.DataFrame({"pos": came, "x": [xs[i - 1] for i in came]})]), None):
            out += pdf[["window_idx", "frame_idx", "raw", "smoothed"]].values.tolist()
        assert store.calls <= 4
    assert out == [pytest.approx(w) for w in by_hand(xs, 4, 2, 0.3)]


@pytest.mark.parametrize("alpha", [0.0, 0.3, 1.0])
def test_scans_of_long_streams_equal_the_loop(spark, alpha):
    """One stream with nine rows of ten, blocks far smaller than it, nulls, a stream without a name."""
    r = random.Random(3)
    streams = {"long": [r.choice([None, r.random(), r.random()]) for _ in range(900)], "short": [r.random() for _ in range(7)], None: [None, 0.5, None], "none": [None]}
    rows = [(k, i, x, "kept") for k, xs in streams.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "stream string, pos int, x double, smoothed_before string").repartition(5)
    got = affine_scan(df, ["stream"], "pos", ema_map(F.col("x"), alpha), block=4)
    assert got.columns == [*df.columns, "smoothed"] and not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    found = {(g.stream, g.pos): g.smoothed for g in got.collect()}
    last = {g.stream: g.smoothed for g in affine_last(df, ["stream"], "pos", ema_map(F.col("x"), alpha), block=4).collect()}
    for k, xs in streams.items():
        s = None
        for i, x in enumerate(xs):
            s = s if x is None else x if s is None else alpha * x + (1 - alpha) * s
            assert found[k, i] == (None if s is None else pytest.approx(s, abs=1e-12))
        assert last[k] == (None if s is None else pytest.approx(s, abs=1e-12))
    assert affine_scan(df.limit(0), ["stream"], "pos", ema_map(F.col("x"), alpha)).count() == 0


def test_moving_means_overlap_their_blocks(spark):
    xs = list(range(100))
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(xs, 1)], "stream string, pos long, x double")
    rows = W._with_overhang(df, "stream", 3, "pos", least=10)  # blocks of 24
    assert rows.count() == 100 + 2 * 4
    got = {r.pos: r.raw3 for r in W.moving_mean(df, "stream", [3]).collect()}
    assert got == {i: pytest.approx(sum(xs[max(0, i - 3) : i]) / min(i, 3)) for i in range(1, 101)}


@pytest.mark.parametrize("score", ["final", "mean"])
def test_sweeps_are_evaluated_against_labels(spark, score):
    r = random.Random(5)
    streams = {f"s{k}": [r.random() for _ in range(n)] for k, n in enumerate((30, 18, 7, 3, 1))}
    df = spark.createDataFrame([(k, i, x, i / 10) for k, xs in streams.items() for i, x in enumerate(xs, 1)], "s string, pos long, x double, ms double")
    labels = spark.createDataFrame([(k, i % 2) for i, k in enumerate(streams)], "s string, y int")
    got = {(g.window_size, g.overlap): g for g in W.evaluate_sweep(df, labels, "s", [(4, 0.5), (8, 0.0)], 0.3, latency="ms", score=score).collect()}
    for (window, overlap), g in got.items():
        made = {k: by_hand(xs, window, W.effective_step(window, overlap), 0.3) for k, xs in streams.items()}
        value = {k: (v[-1][3] if score == "final" else sum(x[3] for x in v) / len(v)) if v else (0.5 if score == "final" else None) for k, v in made.items()}
        known = [(i % 2, value[k]) for i, k in enumerate(streams) if value[k] is not None]
        assert g.accuracy == pytest.approx(sum((p >= 0.5) == bool(y) for y, p in known) / len(known)) and g.support == len(known)
        assert g.n_windows == sum(map(len, made.values())) and g.mean_latency == pytest.approx(sum(x[1] / 10 for v in made.values() for x in v) / g.n_windows)
    assert len(got) == 2
    with pytest.raises(ValueError):
        W.evaluate_sweep(df, labels, "s", [(4, 0.5)], 0.3, score="last")


def test_positions_of_a_stream_that_holds_most_rows(spark):
    rows = [("a", i % 400, i) for i in range(2000)] + [(None, 5, 1), (None, None, 2), ("b", 1, 1)]
    df = spark.createDataFrame(rows, "stream string, ts int, id int").repartition(7)
    got = {(r.stream, r.id): r.pos for r in W.positions(df, "stream", "ts", "id").collect()}
    want = {("a", i): k for k, i in enumerate(sorted(range(2000), key=lambda i: (i % 400, i)), 1)} | {(None, 2): 1, (None, 1): 2, ("b", 1): 1}
    assert got == want and W.positions(df.limit(0), "stream", "ts").count() == 0


def test_chunks_are_read_once_whatever_stops_the_query(spark, tmp_path):
    folder = str(tmp_path / "device")
    schema = "id long, x double"

    def chunk(number, ids):
        spark.createDataFrame([(i, i / 2) for i in ids], schema).write.parquet(C.chunk_path(folder, number))

    def run():
        L.run_available(C.read_chunks(spark, folder, schema), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        return sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    chunk(0, range(10))
    chunk(2, range(20, 30))  # comes early: waits for chunk 1
    assert run() == list(range(10))
    chunk(1, range(10, 20))
    parts = [p for p in (tmp_path / "device" / "chunk-000001").iterdir() if p.suffix == ".parquet" and p.stat().st_size > 0]
    whole = parts[0].read_bytes()
    for crc in parts[0].parent.glob(".*.crc"):
        crc.unlink()
    parts[0].write_bytes(whole[:40])  # a task of this batch fails
    with pytest.raises(StreamingQueryException):
        run()
    parts[0].write_bytes(whole)
    assert run() == list(range(30)) and run() == list(range(30))
    assert int((tmp_path / "device" / "_released").read_text()) <= 3


def test_boxes_are_cut_to_whole_numbers(spark):
    got = spark.range(1).select(W.smooth_boxes(F.array(*map(F.lit, (10, 15, 20))), 0.3)).first()[0]
    assert got == [10, 11, 13]
