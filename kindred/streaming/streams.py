"""Incremental and streaming forms; each equals its batch twin, in whatever order files come."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..sources.tables import upsert_folders

UNDO = "error"


def latest_verdict(log: DataFrame, key: str, verdict: str, order: list[str], undo: str = UNDO) -> DataFrame:
    """The last verdict of each key; a last one that undoes removes the key.

    An aggregate, so that rows of a busy key are reduced before the shuffle.
    """
    last = log.groupBy(key).agg(F.max_by(verdict, F.struct(*order)).alias("verdict"))
    return last.filter(F.col("verdict") != undo)


def status_by_window(events: DataFrame, ts: str = "ts", stage: str = "event_type", size: str = "1 day", late: str | None = None) -> DataFrame:
    """``window_start, stage, n`` in tumbling windows; with ``late`` rows beyond that delay are dropped."""
    marked = events.withWatermark(ts, late) if late else events
    counts = marked.groupBy(F.window(ts, size), F.col(stage).alias("stage")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), "stage", "n")


def event_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run a stream over what there is and stop: results are Parquet files at ``path``."""
    return stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(stream: DataFrame, key: str, verdict: str, order: list[str], path: str, checkpoint: str, late: str | None = None, folders: int = 64) -> StreamingQuery:
    """The last row of each key by ``order`` in a table of ``folders`` at ``path``: ``key, *order, verdict``.

    A key's last row is kept in the state store; a micro-batch hands on only keys whose last row is newer, and only their
    folders are written.  The table is the same in whatever order and files rows come, a batch that is run again changes
    nothing, and a restart without new rows leaves all as it is.

    Without ``late`` no row is too late and every key keeps its state.  With it (an interval by the first column of
    ``order``, a time) a key's state goes when the newest row of earlier batches is that much ahead of the key's last,
    and rows as far behind are dropped; a key that comes again is held against the table's own row, which only a newer
    one replaces.  Null keys go together; of rows alike in ``order`` the largest verdict stays.
    """
    types = dict(stream.dtypes)
    names = [key, *order, verdict]
    schema = ", ".join(f"`{n}` {types[n]}" for n in names)
    held = ", ".join(f"`{n}` {'long' if types[n].startswith('timestamp') else types[n]}" for n in [*order, verdict])

    def newer(group: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.concat([f.sort_values([*order, verdict]).tail(1) for f in frames]).sort_values([*order, verdict]).tail(1)
        now = tuple(_plain(x) for x in last[[*order, verdict]].iloc[0])
        was = tuple(state.get) if state.exists else None
        if was is None or now > was:
            state.update(now)
            yield last[names]
        if late:  # the watermark is ``late`` behind already
            state.setTimeoutTimestamp(max(max(now, was or now)[0] // 1000, state.getCurrentWatermarkMs() + 1))

    marked = stream.withWatermark(order[0], late) if late else stream
    changed = marked.select(*names).groupBy(key).applyInPandasWithState(newer, schema, held, "update", "EventTimeTimeout" if late else "NoTimeout")

    def put(batch: DataFrame, _: int) -> None:
        upsert_folders(batch, path, [key], [F.col(c) for c in (*order, verdict)], folders)

    return changed.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _plain(x):
    """A value as the state holds it: times as microseconds."""
    return x.value // 1000 if isinstance(x, pd.Timestamp) else x.item() if hasattr(x, "item") else x


def stream_counts(stream: DataFrame, path: str, checkpoint: str, ts: str = "ts", stage: str = "event_type", size: str = "1 day", late: str | None = None, folders: int = 16) -> StreamingQuery:
    """:func:`status_by_window` as a table of ``folders`` at ``path``: ``window_start, window_end, stage, n, last_ts``.

    Counts of open windows stand in the state store, and a micro-batch writes the folders of windows that it changed.
    With ``late``, a window that ended that long before the newest row of earlier batches is closed: its state goes and
    rows that still come for it are dropped.  Without, no row is too late and the state has a row for each window and
    stage.  Counts do not depend on the order of files (with ``late``, as far as rows are not later than that).
    """
    marked = stream.withWatermark(ts, late) if late else stream
    counts = marked.groupBy(F.window(ts, size), F.col(stage).alias("stage")).agg(F.count("*").alias("n"), F.max(ts).alias("last_ts"))
    rows = counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "stage", "n", "last_ts")

    def put(batch: DataFrame, _: int) -> None:
        upsert_folders(batch, path, ["window_start", "stage"], [F.col("n")], folders)

    return rows.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def closed_windows(counts: DataFrame, late: str) -> DataFrame:
    """``window_start, stage, n`` of the windows that ended ``late`` or more before the last row seen."""
    last = counts.agg((F.max("last_ts") - F.expr(f"INTERVAL {late}")).alias("_closed"))
    return counts.join(F.broadcast(last), F.col("window_end") <= F.col("_closed")).select("window_start", "stage", "n")


def incremental_topk(hits: DataFrame, queries: DataFrame, vectors: DataFrame, changed: DataFrame, k: int, search: Callable[[DataFrame, DataFrame, int], DataFrame]) -> DataFrame:
    """Stored hits brought up to date after the vectors ``changed(entity_id, grp)`` were added, altered or removed.

    ``vectors`` are all there are now, ``queries`` the ones to answer.  A query whose own vector changed, or that lost a
    stored hit to a change, or that has no stored hits is asked anew over all vectors; any other meets the changed
    vectors only.
    """
    from ..operators.vectors import ranked
    from ..sources.shared import written

    moved = changed.select("entity_id", "grp").distinct()
    asked = F.col("query_id").alias("entity_id"), "grp"
    gone = moved.withColumnRenamed("entity_id", "cand_id")
    stale = hits.join(gone, ["cand_id", "grp"], "left_semi").select(*asked)
    unknown = queries.select("entity_id", "grp").join(hits.select(*asked).distinct(), ["entity_id", "grp"], "left_anti")
    anew = written(stale.union(moved).union(unknown).distinct(), "anew")
    own = lambda df, like: df.select(*[F.col(c).alias(c) for c in like.columns])  # noqa: E731  columns told apart from those of ``vectors``
    whole = search(own(queries.join(anew, ["entity_id", "grp"], "left_semi"), queries), vectors, k)
    rest = own(queries.join(anew, ["entity_id", "grp"], "left_anti"), queries)
    fresh = search(rest, own(vectors.join(moved, ["entity_id", "grp"], "left_semi"), vectors), k)
    kept = hits.join(rest.select(F.col("entity_id").alias("query_id"), "grp"), ["query_id", "grp"], "left_semi").select(*hits.columns)
    return ranked(kept.drop("rank").unionByName(fresh.drop("rank")).unionByName(whole.drop("rank")), k)
