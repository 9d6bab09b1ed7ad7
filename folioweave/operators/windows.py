"""Windows that open at an event: fixed-length spans, each starting at the first event past the last.

Rate limits and cached entries with a life time both work so: an event within
``span_ms`` of the opening event belongs to it, the next event opens anew. The
rule is sequential, but not per key as a whole. Each key is cut into time
chunks; a chunk needs to know only when the window that reaches into it opened.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioweave.operators.ordered import with_previous


def _chain_ends(ts: np.ndarray, span_ms: int) -> tuple[np.ndarray, np.ndarray]:
    """For each event, the event that opens the next window, and the last opening of the chain it starts."""
    following = np.searchsorted(ts, ts + span_ms, side="left")
    last = np.arange(len(ts))
    for i in range(len(ts) - 1, -1, -1):
        if following[i] < len(ts):
            last[i] = last[following[i]]
    return following, last


def _chunk_summary(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk: which last opening each possible entry leads to, as runs of entries with the same one."""
    ts, span_ms = np.sort(pdf["ts"].to_numpy()), int(pdf["span"].iloc[0])
    _, last = _chain_ends(ts, span_ms)
    # Entries that matter: the first opening in the chunk lies within a span of its start.
    first = np.arange(int(np.searchsorted(ts, ts[0] + span_ms, side="left")) + 1)
    first = first[first < len(ts)]
    ends = ts[last[first]]
    change = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
    return pd.DataFrame({
        "key": pdf["key"].iloc[0], "chunk": pdf["chunk"].iloc[0], "span": span_ms,
        "from_ts": ts[first[change]], "to_ts": ts[first[np.r_[change[1:] - 1, len(first) - 1]]], "last": ends[change],
    })


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per key, over its chunk summaries: the window open at each chunk's start."""
    pdf, span_ms = pdf.sort_values(["chunk", "from_ts"]), int(pdf["span"].iloc[0])
    out, opened = [], None
    for chunk, runs in pdf.groupby("chunk", sort=True):
        out.append((pdf["key"].iloc[0], int(chunk), opened))
        ends = runs["to_ts"].to_numpy()
        at = 0 if opened is None else int(np.searchsorted(ends, opened + span_ms, side="left"))
        if at < len(ends):
            opened = int(runs["last"].iloc[at])
    frame = pd.DataFrame(out, columns=["key", "chunk", "opened"])
    frame["opened"] = frame["opened"].astype("Int64")
    return frame


def _openings(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per chunk with its entry known: the opening time of every event's window."""
    ts, span_ms = np.sort(pdf["ts"].to_numpy()), int(pdf["span"].iloc[0])
    opened = pdf["opened"].iloc[0]
    result = np.empty(len(ts), dtype="int64")
    at = 0 if pd.isna(opened) else int(np.searchsorted(ts, int(opened) + span_ms, side="left"))
    result[:at] = 0 if pd.isna(opened) else int(opened)
    following, _ = _chain_ends(ts, span_ms)
    while at < len(ts):
        result[at:following[at]] = ts[at]
        at = int(following[at])
    return pd.DataFrame({"key": pdf["key"].iloc[0], "ts": ts, "opened": result})


def event_windows(events: DataFrame, key: str, span_ms: int | Column, chunk_ms: int | None = None) -> DataFrame:
    """``key``, ``ts``, ``opened``: each distinct event time with the opening time of its window.

    ``events`` has ``ts`` in milliseconds; ``span_ms`` may be a column that is the same in all rows of a key. Events of the same
    time count once, so a chunk holds at most its length in rows however hot its key is. The walk over a key sees each
    chunk's summary: one row per distinct outcome of the chunk's first span, usually few, as chains that start apart soon meet.
    """
    span = span_ms if isinstance(span_ms, Column) else F.lit(span_ms)
    length = F.lit(chunk_ms) if chunk_ms else F.greatest(16 * F.col("span"), F.lit(600_000))
    times = events.select(F.col(key).cast("string").alias("key"), "ts", span.cast("bigint").alias("span")).distinct()
    times = times.withColumn("chunk", F.floor(F.col("ts") / length))
    summary = times.groupBy("key", "chunk").applyInPandas(
        _chunk_summary, "key STRING, chunk BIGINT, span BIGINT, from_ts BIGINT, to_ts BIGINT, last BIGINT")
    entries = summary.groupBy("key").applyInPandas(_walk, "key STRING, chunk BIGINT, opened BIGINT")
    return times.join(entries, ["key", "chunk"]).groupBy("key", "chunk").applyInPandas(
        _openings, "key STRING, ts BIGINT, opened BIGINT")


def rate_limit_audit(requests: DataFrame, key: str, limit: int | Column, window_ms: int | Column, opened: str | None = None) -> DataFrame:
    """Wait of each request (0 is admitted) under ``limit`` per window; ``limit + 1`` pass in each.

    ``requests``: ``event_id``, ``ts`` (ms) and the key; limit and window may be columns, the same in all rows of a key. Ranks
    inside a window come from counts per millisecond; requests of one millisecond are told apart by a bounded number of first
    ones. ``opened`` names a column for the time at which a request's window opened.
    """
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    rows = requests.withColumns({"key": F.col(key).cast("string"), "__limit": as_column(limit).cast("bigint"), "__span": as_column(window_ms).cast("bigint")})
    windows = event_windows(rows, "key", F.col("__span"))
    counts = rows.groupBy("key", "ts", "__limit").agg(F.count(F.lit(1)).alias("n")).join(windows, ["key", "ts"])
    before = F.sum("n").over(Window.partitionBy("key", "opened").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1))
    room = counts.withColumn("room", F.col("__limit") + 1 - F.coalesce(before, F.lit(0))).drop("n", "__limit")
    first = F.row_number().over(Window.partitionBy("key", "ts").orderBy("event_id"))
    leading = rows.select("key", "ts", "event_id", "__limit").withColumn("rn", first).filter(F.col("rn") <= F.col("__limit") + 1)
    admitted = leading.join(room, ["key", "ts"]).filter(F.col("rn") <= F.col("room")).select("event_id", F.lit(True).alias("admitted"))
    waits = (
        rows.join(windows, ["key", "ts"]).join(admitted, "event_id", "left")
        .withColumn("wait_ms", F.when(F.col("admitted"), 0).otherwise(F.col("opened") + F.col("__span") - F.col("ts")).cast("bigint"))
    )
    return (waits.withColumnRenamed("opened", opened) if opened else waits.drop("opened")).drop("key", "admitted", "__limit", "__span")


def parsed_rate(rate: Column) -> Column:
    """``limit`` and ``span`` of a rate string: ``n/ms`` lets n more in after the opening request, ``ms`` none before the gap is over.

    Null where nothing is limited: no rate, ``0``, a span of 0, and what is no rate at all.
    """
    text = F.trim(rate)
    per_window = F.struct(F.regexp_extract(text, r"^(\d+)/", 1).try_cast("bigint").alias("limit"), F.regexp_extract(text, r"/(\d+)$", 1).try_cast("bigint").alias("span"))
    gap = F.struct(F.lit(0).cast("bigint").alias("limit"), text.try_cast("bigint").alias("span"))
    read = F.when(text.rlike(r"^\d+/\d+$"), per_window).when(text.rlike(r"^\d+$"), gap)
    return F.when(read["limit"].isNotNull() & (read["span"] > 0), read)


def rate_limit_by_source(requests: DataFrame, key: str, rates: DataFrame) -> DataFrame:
    """``rate_limit_audit`` under each source's own rate: ``rates`` has the key and ``rate``. Requests without a limit wait 0."""
    limited = requests.join(rates.select(key, parsed_rate(F.col("rate")).alias("__rate")), key, "left")
    audited = rate_limit_audit(limited.where("__rate IS NOT NULL"), key, F.col("__rate.limit"), F.col("__rate.span"))
    free = limited.where("__rate IS NULL").withColumn("wait_ms", F.lit(0).cast("bigint"))
    return audited.drop("__rate").unionByName(free.drop("__rate"))


def ttl_refetch(reads: DataFrame, key: str, ttl_ms: int | Column) -> DataFrame:
    """Reads of a cached entry: ``refetch`` where it was missing or past its life time.

    The entry is valid through its last millisecond; of reads at one time the first refetches. A life time may be a column,
    the same in all rows of an entry; one of 0 (or null) never ends.
    """
    ttl = (ttl_ms if isinstance(ttl_ms, Column) else F.lit(ttl_ms)).cast("bigint")
    rows = reads.withColumns({"key": F.col(key).cast("string"), "__ttl": F.coalesce(F.nullif(ttl, F.lit(0)), F.lit(-1))})
    ending = event_windows(rows.where("__ttl > 0"), "key", F.col("__ttl") + 1)
    lasting = rows.where("__ttl <= 0").groupBy("key").agg(F.min("ts").alias("ts")).withColumn("opened", F.col("ts"))
    opened = ending.unionByName(lasting.select("key", "ts", "opened")).where("opened = ts")
    first = rows.groupBy("key", "ts").agg(F.min("event_id").alias("first_id"))
    starts = first.join(opened, ["key", "ts"]).select("key", "ts", "first_id")
    return (
        rows.join(starts, ["key", "ts"], "left")
        .withColumn("refetch", F.coalesce(F.col("event_id") == F.col("first_id"), F.lit(False)))
        .drop("key", "first_id", "__ttl")
    )


def new_item_counts(polls: DataFrame, key: str, chunk: Column) -> DataFrame:
    """New items per poll: growth of ``amount`` since the key's poll before; none for the first."""
    placed = with_previous(polls, [key], F.struct("ts", "event_id"), chunk, F.col("amount"), "previous")
    return placed.withColumn("new_items", F.greatest(F.lit(0), F.coalesce(F.col("amount") - F.col("previous"), F.lit(0)))).drop("previous")
