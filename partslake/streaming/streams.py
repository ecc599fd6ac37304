"""Structured Streaming forms of the capture operators.

Rows of a camera or bin are put in order by event time: they wait in the state until the
watermark has passed them, and a timer of the key then takes them on. Rows may so arrive in
any order within the allowed delay; what comes later still is marked and not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from partslake.operators.recognise import MEDIUM, TIGHT
from partslake.session import cut_lineage
from partslake.sources import commits
from partslake.streaming.capture_store import apply_captures

# How far rows may be out of order, unless the caller says otherwise.
DELAY = "10 seconds"

# Keys of a stream are dealt to so many buckets; a call works on all rows of one.
BUCKETS = 256


@dataclass
class Runs:
    """Rows of several keys, those of one key together and in order."""

    rows: pd.DataFrame
    of: np.ndarray  # the number of each row's key
    first: np.ndarray  # where each key begins

    @property
    def last(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.rows)) - 1

    def before(self, values: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The value of the row before; for the first row of a key that of ``start``."""
        out = np.concatenate([values[:1], values[:-1]])
        out[self.first] = start
        return out

    def since(self, values: np.ndarray, reset: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Sum of ``values`` since the last ``reset``, that row included, or on from ``start``."""
        total, begins = np.cumsum(values), reset.copy()
        base = total - values - np.where(reset, 0, start[self.of])
        begins[self.first] = True
        return total - base[np.maximum.accumulate(np.where(begins, np.arange(len(values)), 0))]


State = dict[str, np.ndarray]
Step = Callable[[State, Runs], tuple[State, pd.DataFrame]]


def _pack(frame: pd.DataFrame | pa.Table, schema: pa.Schema) -> tuple[bytes]:
    """A table as one value of the state."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(frame if isinstance(frame, pa.Table) else pa.Table.from_pandas(frame, schema, preserve_index=False))
    return (sink.getvalue().to_pybytes(),)


def _unpack(packed: Iterable[tuple[bytes]]) -> pa.Table:
    return pa.concat_tables(pa.ipc.open_stream(value).read_all() for (value,) in packed)


def _frame(table: pa.Table) -> pd.DataFrame:
    # a whole number beside a null stays one
    return table.to_pandas(integer_object_nulls=True)


class InOrder(StatefulProcessor):
    """Rows of the keys of one bucket, handed to ``step`` once the watermark is past them, in order per key.

    State: the rows that wait and what ``step`` returned last for each key, both packed as
    tables, since a call and a value of the state cost the same for one row and for
    thousands; and the time of the bucket's one timer, that of the earliest waiting row. A
    row behind the watermark comes out at once with ``late`` set: rows after it may have
    been handed on.
    """

    def __init__(self, rows: StructType, key: str, order: list[str], state: StructType, start: tuple, output: StructType, step: Step):
        self.rows, self.key, self.order = to_arrow_schema(rows), key, order
        self.state, self.start = to_arrow_schema(state), start
        self.output, self.step = output, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "packed binary")
        self.last = handle.getValueState("last", "packed binary")
        self.timer = handle.getValueState("timer", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = max(timerValues.getCurrentWatermarkInMs(), 0) * 1000
        earliest = None
        for frame in rows:
            late = frame["us"] < passed
            if passed and late.any():
                yield self._out(frame[late], True)
                frame = frame[~late]
            if len(frame):
                self.waiting.appendValue(_pack(frame[self.rows.names], self.rows))
                us = int(frame["us"].min())
                earliest = us if earliest is None else min(earliest, us)
        if earliest is not None:
            self._wake(earliest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = _unpack(self.waiting.get())
        is_ready = pc.less(held["us"], passed)
        ready, rest = held.filter(is_ready), held.filter(pc.invert(is_ready))
        self.waiting.clear()
        self.timer.clear()
        if len(rest):
            self.waiting.put([_pack(rest, self.rows)])
            self._wake(pc.min(rest["us"]).as_py())
        if len(ready):
            out = self._take(_frame(ready))
            if len(out):
                yield self._out(out, False)

    def close(self) -> None:
        pass

    def _take(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Hand rows to ``step`` with the state of their keys, and keep what it returns."""
        rows = rows.sort_values(self.order, kind="stable")
        of, keys = pd.factorize(rows[self.key], use_na_sentinel=False)
        place = np.argsort(of, kind="stable")
        rows, of = rows.iloc[place].reset_index(drop=True), of[place]
        runs = Runs(rows, of, np.flatnonzero(np.diff(of, prepend=-1)))
        keys = [None if pd.isna(k) else k for k in keys]
        kept = _frame(_unpack([self.last.get()]) if self.last.exists() else self.state.empty_table())
        met = {None if pd.isna(k) else k: n for n, k in enumerate(kept["key"])}
        at = [met.get(k) for k in keys]
        state = {}
        for name, start in zip(self.state.names[1:], self.start):
            values = kept[name].to_numpy()
            state[name] = np.empty(len(keys), object if isinstance(start, (str, list)) else type(start))
            for n, m in enumerate(at):
                state[name][n] = start if m is None else values[m]
        new, out = self.step(state, runs)
        others = kept[~kept.index.isin([m for m in at if m is not None])]
        fresh = pd.DataFrame({"key": pd.Series(keys, dtype=object)} | {c: pd.Series(list(v)) for c, v in new.items()})
        self.last.update(_pack(pd.concat([others, fresh], ignore_index=True) if len(others) else fresh, self.state))
        return out

    def _wake(self, us: int) -> None:
        """Let the bucket's timer go off once the watermark is past ``us``."""
        due = us // 1000 + 1
        if self.timer.exists():
            (set_to,) = self.timer.get()
            if set_to <= due:
                return
            self.handle.deleteTimer(set_to)
        self.handle.registerTimer(due)
        self.timer.update((due,))

    def _out(self, frame: pd.DataFrame, late: bool) -> pd.DataFrame:
        return frame.reindex(columns=[f.name for f in self.output.fields[:-1]]).assign(late=late).reset_index(drop=True)


def _in_order(
    events: DataFrame, key: str, columns: str, order: list[str], state: str, start: tuple, output: str, step: Step, delay: str
) -> DataFrame:
    """Run ``step(state, runs)`` over the rows of each key by event time, keeping its state.

    ``columns`` are those of ``events`` that ``step`` reads, as a schema; it gets the event
    time ``ts`` as ``us``, microseconds, and the rows of many keys at once. The result has
    ``output`` and ``late``.
    """
    spark = events.sparkSession
    # state with lists and timers needs this store
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    named = [c.split()[0] for c in columns.split(", ")]
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # without the time column itself Spark leaves late rows to us
    plain = timed.select(*[F.col(n).cast(c.split(" ", 1)[1]).alias(n) for n, c in zip(named, columns.split(", "))], F.unix_micros("ts").alias("us"))
    result = StructType.fromDDL(f"{output}, late boolean")
    rows, kept = (StructType.fromDDL(x) for x in (f"{columns}, us long", f"key string, {state}"))
    processor = InOrder(rows, key, ["us", *order], kept, start, result, step)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("_bucket")
    return plain.select(bucket, "*").groupBy("_bucket").transformWithStateInPandas(processor, result, "append", "eventTime")


def on_time(result: DataFrame) -> DataFrame:
    """What an operator found, without the rows that came too late."""
    return result.filter(~F.col("late")).drop("late")


def to_two(result: DataFrame, path: str, late_path: str, checkpoint: str) -> DataStreamWriter:
    """Write results to ``path`` and rows that came too late to ``late_path``, a folder per batch.

    A batch that is run again replaces its own folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        on_time(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.filter("late").drop("late").write.mode("overwrite").parquet(f"{late_path}/batch={batch_id}")
        batch.unpersist()

    return result.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def stream_dedup(captures: DataFrame, delay: str | None = None) -> DataFrame:
    """First capture of each image hash, however late or far apart its captures are.

    Every hash stays in the state, one key each; ``dedup_into`` keeps them in files. With
    ``delay`` a hash is forgotten once the watermark passes it: then late captures are
    dropped, and a hash can come out again.
    """
    if delay is None:
        return captures.dropDuplicates(["image_hash"])
    timed = captures.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["image_hash"])


def create_seen(spark: SparkSession, root: str, schema: StructType, buckets: int = commits.BUCKETS) -> None:
    """A store for ``dedup_into``: hashes met so far, and the first capture of each."""
    empty = spark.createDataFrame([], schema)
    commits.create(spark, root, {"seen": (empty.select("image_hash"), ["image_hash"]), "first": (empty, [])}, buckets)


def dedup_into(captures: DataFrame, root: str, checkpoint: str, tidy_every: int = 16) -> DataStreamWriter:
    """First capture of each image hash into the table ``first`` of the store at ``root``.

    The stream keeps no state. A batch reads the files of met hashes whose filter may hold
    one of its own, and adds its new hashes and their captures in one commit, so a batch
    that is run again adds nothing. Within a batch the smallest ``ts`` comes first; a null
    hash is a hash like others.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != "image_hash"]
        one = batch.groupBy("image_hash").agg(F.min_by(F.struct(*rest), F.struct("ts", *[c for c in rest if c != "ts"])).alias("r"))
        one = cut_lineage(one.select("image_hash", "r.*").select(*batch.columns))
        known = commits.read_keys(one, root, "seen").withColumnRenamed("image_hash", "_seen")
        new = cut_lineage(one.join(known, F.col("image_hash").eqNullSafe(F.col("_seen")), "left_anti"))
        number = commits.commit(spark, root, {"seen": new.select("image_hash"), "first": new}, writer="dedup", batch=batch_id)
        if number % tidy_every == 0:
            commits.compact(spark, root, "seen")
            commits.vacuum(spark, root)

    return captures.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def stream_camera_lost(reads: DataFrame, limit: int = 5, delay: str = DELAY) -> DataFrame:
    """First point of each run of ``limit`` failures per camera of ``(camera, ts, seq, ok)``."""

    def step(state: State, runs: Runs) -> tuple[State, pd.DataFrame]:
        bad = (~runs.rows["ok"].astype(bool)).to_numpy()
        run = runs.since(bad.astype(np.int64), ~bad, state["fails"])
        return {"fails": run[runs.last]}, runs.rows.loc[bad & (run == limit), ["camera", "seq"]]

    return _in_order(
        reads, "camera", "camera string, seq long, ok boolean", ["seq"], "fails long", (0,), "camera string, seq long", step, delay
    )


def stream_retry_cap(
    events: DataFrame, cap: int = 2, gap_seconds: float = 10.0, distinct: float = MEDIUM, delay: str = DELAY
) -> DataFrame:
    """Attempts per part at a camera of ``(camera, ts, capture_id, reframing, vec)``."""

    def step(state: State, runs: Runs) -> tuple[State, pd.DataFrame]:
        rows, known = runs.rows, np.array([len(v) > 0 for v in state["vec"]])
        # zeros behind a shorter vector change neither its length nor a product
        width = max(map(len, [*rows["vec"], *state["vec"]]))
        wide = lambda vecs: np.stack([np.pad(np.asarray(v, float), (0, width - len(v))) if len(v) < width else np.asarray(v, float) for v in vecs])
        vecs = wide(rows["vec"])
        vecs /= np.maximum(np.linalg.norm(vecs, axis=1, keepdims=True), 1e-300)
        secs = rows["us"].to_numpy() / 1e6
        prev_vec, prev_ts = runs.before(vecs, wide(state["vec"])), runs.before(secs, state["ts"])
        new = (secs - prev_ts > gap_seconds) & (1 - (vecs * prev_vec).sum(axis=1) >= distinct)
        new[runs.first] &= known
        new[runs.first] |= ~known
        part = runs.since(new.astype(np.int64), np.zeros(len(rows), bool), state["part_no"])
        retry = rows["reframing"].astype(int).to_numpy()
        tried = runs.since(retry, new, state["attempts"])
        outcome = np.where(
            retry == 0, "ok", np.where(tried > cap, "EscalatedToManual", "Reframing")
        )
        out = pd.DataFrame(
            {
                "camera": rows["camera"],
                "capture_id": rows["capture_id"],
                "part_no": part,
                "attempts": tried,
                "outcome": outcome,
            }
        )
        return {"ts": secs[runs.last], "vec": vecs[runs.last], "part_no": part[runs.last], "attempts": tried[runs.last]}, out

    return _in_order(
        events,
        "camera",
        "camera string, capture_id long, reframing boolean, vec array<double>",
        ["capture_id"],
        "ts double, vec array<double>, part_no long, attempts long",
        (0.0, [], 0, 0),
        "camera string, capture_id long, part_no long, attempts long, outcome string",
        step,
        delay,
    )


def stream_undo_window(events: DataFrame, seconds: float = 5.0, delay: str = DELAY) -> DataFrame:
    """Undos of ``(bin, ts, event_id, kind)`` with the write each takes back, if legal."""

    def step(state: State, runs: Runs) -> tuple[State, pd.DataFrame]:
        rows = runs.rows
        kind, secs, event_id = rows["kind"].to_numpy(dtype=object), rows["us"].to_numpy() / 1e6, rows["event_id"].to_numpy()
        legal = (runs.before(kind, state["kind"]) == "write") & (secs - runs.before(secs, state["ts"]) <= seconds)
        out = rows[["bin", "event_id"]].assign(
            legal=legal, write_id=pd.array(runs.before(event_id, state["event_id"]), dtype="Int64")
        )
        out.loc[~legal, "write_id"] = pd.NA
        last = runs.last
        new = {"kind": [str(k) for k in kind[last]], "ts": secs[last], "event_id": event_id[last]}
        return new, out[(kind == "undo")]

    return _in_order(
        events,
        "bin",
        "bin string, event_id long, kind string",
        ["event_id"],
        "kind string, ts double, event_id long",
        ("", 0.0, 0),
        "bin string, event_id long, legal boolean, write_id long",
        step,
        delay,
    )


def stream_captures(
    captures: DataFrame,
    verdicts: DataFrame,
    sections: DataFrame,
    root: str,
    model_hash: str,
    checkpoint: str,
    tight: float = TIGHT,
    medium: float = MEDIUM,
    *,
    check: Callable[[DataFrame], DataFrame] | None = None,
    enrich: Callable[[DataFrame], DataFrame] | None = None,
) -> DataStreamWriter:
    """Captures into the store at ``root`` (``capture_store.create``), one commit per micro-batch."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_captures(batch, verdicts, sections, root, model_hash, batch_id, tight, medium, check=check, enrich=enrich)

    return captures.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
