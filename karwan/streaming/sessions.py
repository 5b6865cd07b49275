"""Sessions of events: idle time-outs, bounded history, repeated messages; as batch plans and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: An event more than IDLE_S seconds after the one before opens a new session.
IDLE_S = 45 * 60
#: More than REPEATS equal messages within REPEAT_S seconds of the first of them are blocked.
REPEAT_S, REPEATS = 30, 3


def sessionize(events: DataFrame, key: str, ts: str, order: str, idle: int = IDLE_S) -> DataFrame:
    """events with session_no, from 1 in each key; events with a null key or time are left out.

    Equal times are ordered by `order`. Exactly `idle` seconds keep a session open.
    """
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = F.unix_micros(F.col(ts).cast("timestamp")) - F.lag(F.unix_micros(F.col(ts).cast("timestamp"))).over(w)
    fresh = F.when(gap.isNull() | (gap > idle * 1_000_000), 1).otherwise(0)
    live = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    return live.withColumn("fresh__", fresh).withColumn("session_no", F.sum("fresh__").over(w)).drop("fresh__")


def history(events: DataFrame, key: str, ts: str, order: str, value: str, n: int = 4) -> DataFrame:
    """events with first_value, previous, last_n (the values of at most n events before) and turn (how many so far)."""
    w = Window.partitionBy(key).orderBy(ts, order)
    return events.select(
        "*", F.first(value).over(w).alias("first_value"), F.lag(value).over(w).alias("previous"),
        F.collect_list(value).over(w.rowsBetween(-n, -1)).alias("last_n"), F.row_number().over(w).alias("turn"),
    )


def _repeat_step(state: tuple[str | None, float, int], text: str, at: float) -> tuple[tuple[str | None, float, int], bool]:
    last, since, n = state
    if text != last or at - since > REPEAT_S:
        return (text, at, 1), False
    return (text, since, n + 1), n + 1 > REPEATS


def repeats(events: DataFrame, key: str, ts: str, order: str, text: str) -> DataFrame:
    """events with blocked: whether a message repeats the run before it too often.

    The run's window begins at its first message and blocked messages count too, so this is an ordered fold. It streams
    through sorted partitions with the state of one key at a time, whatever the number of a key's events.
    """
    at = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000
    live = events.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    cols = events.columns
    sorted_ = live.withColumns({"at__": at, "text__": F.coalesce(F.lower(F.btrim(F.regexp_replace(F.col(text), r"\s+", " "))), F.lit(""))}).repartition(key).sortWithinPartitions(key, "at__", order)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, (None, 0.0, 0)
        for b in batches:
            out = []
            for k, x, t in zip(b[key], b["text__"], b["at__"]):
                if k != now:
                    now, state = k, (None, 0.0, 0)
                state, blocked = _repeat_step(state, x, t)
                out.append(blocked)
            yield b[cols].assign(blocked=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields) + ", blocked boolean"
    return sorted_.mapInPandas(fold, schema)


def session_windows(stream: DataFrame, key: str, ts: str, late: str = "1 hour", idle: int = IDLE_S) -> DataFrame:
    """(key, start, end, n) per session of a stream or a table; in a stream a session closes when the watermark has passed it."""
    w = F.session_window(F.col(ts), f"{idle} seconds")
    marked = stream.withWatermark(ts, late) if stream.isStreaming else stream
    return marked.where(F.col(key).isNotNull()).groupBy(F.col(key), w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_repeats(stream: DataFrame, key: str, ts: str, text: str, late: str = "1 hour") -> DataFrame:
    """(key, n_messages, n_blocked) so far after each batch: repeats() with its state kept between the batches of a stream.

    Inside a batch events are taken in the order of their times; a key's state goes when the watermark has passed its session.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    marked = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    rows = marked.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(ts).alias("when"), F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).alias("at"), F.coalesce(F.lower(F.btrim(F.regexp_replace(F.col(text), r"\s+", " "))), F.lit("")).alias("text"))

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, since, n, seen, blocked = state.get if state.exists else (None, 0.0, 0, 0, 0)
        whole = pd.concat(list(batches), ignore_index=True).sort_values("at", kind="stable")
        run = (last, since, n)
        for x, t in zip(whole["text"], whole["at"]):
            run, no = _repeat_step(run, x, t)
            seen, blocked = seen + 1, blocked + no
        state.update((*run, seen, blocked))
        state.setTimeoutTimestamp(max(int(whole["at"].max() * 1000), state.getCurrentWatermarkMs()) + IDLE_S * 1000)
        yield pd.DataFrame({"key": [k[0]], "n_messages": [seen], "n_blocked": [blocked]})

    return rows.groupBy("key").applyInPandasWithState(step, "key string, n_messages long, n_blocked long", "last string, since double, n long, seen long, blocked long", "update", GroupStateTimeout.EventTimeTimeout)
