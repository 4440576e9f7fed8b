"""The cap per hotel on a stream of review records."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from guestlens.operators.workplan import MAX_REVIEWS_PER_HOTEL

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Records above the limit that are held before the last places are dropped again.
_SLACK = 4096


class _FirstPlaces(StatefulProcessor):
    """Holds the places of a hotel's first records. `out` tells what a record that came
    before was pushed out by, which is how a stream takes back what it has given."""

    def __init__(self, limit: int, order: tuple[str, ...], columns: tuple[str, ...]):
        self.limit, self.order, self.columns = limit, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        places = T.StructType([T.StructField(f"p{i}", T.LongType()) for i in range(len(self.order))])
        self.held = handle.getMapState("held", places, T.StructType([T.StructField("held", T.BooleanType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = {tuple(int(p) for p in place) for place in self.held.keys()}
        now: dict[tuple, tuple | None] = dict.fromkeys(before)
        last = max(now) if len(now) >= self.limit else None
        for batch in rows:
            places = list(zip(*(batch[c].astype("int64") for c in self.order)))
            for place, row in zip(places, batch[list(self.columns)].itertuples(index=False, name=None)):
                if place not in now and (last is None or place < last):
                    now[place] = row
            if len(now) > self.limit + _SLACK:
                now = {place: now[place] for place in sorted(now)[: self.limit]}
                last = max(now)
        kept = set(sorted(now)[: self.limit])
        gone, new = sorted(before - kept), sorted(kept - before)
        for place in gone:
            self.held.removeKey(place)
        for place in new:
            self.held.updateValue(place, (True,))
        if new:
            yield self.frame([now[place] for place in new], False)
        if gone:
            known = [{self.columns[0]: key[0], **dict(zip(self.order, place))} for place in gone]
            yield self.frame([[row.get(c) for c in self.columns] for row in known], True)

    def frame(self, rows: list, out: bool) -> pd.DataFrame:
        columns = {c: pd.Series(values, dtype=object) for c, values in zip(self.columns, zip(*rows))}
        return pd.DataFrame(columns).assign(out=out)

    def close(self) -> None:
        pass


def _first_of_batches(records: DataFrame, limit: int, order: tuple[str, ...], hotel: str) -> DataFrame:
    """Without the records that cannot be among the first `limit` of their hotel, as their own
    Arrow batch has so many places before theirs. What is left of a large hotel is small
    enough to meet in a task."""

    def first(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            places = batch.select([hotel, *order]).to_pandas()
            kept = places.drop_duplicates().sort_values(list(order), kind="stable")
            kept = kept.index[kept.groupby(hotel, dropna=False, sort=False).cumcount() < limit]
            yield batch.take(pa.array(np.sort(kept.to_numpy()), pa.int64()))

    return records.mapInArrow(first, records.schema)


def cap_stream(
    records: DataFrame, limit: int = MAX_REVIEWS_PER_HOTEL, order: tuple[str, ...] = ("page_no", "pos"), hotel: str = "hotel_url"
) -> DataFrame:
    """A stream of changes: every record that is among the first `limit` of its hotel when
    it arrives, with `out` false; and the place (hotel and order, other columns null) of each
    one that a later arrival with an earlier place pushes out, with `out` true.

    `order` are long columns, unique within a hotel; a place that comes again is ignored. The
    state is at most `limit` places per hotel. What the changes leave in the end is the same
    for every split of the records into batches (`after_changes`). Records of one hotel meet
    in a task of each batch, as a stream of frames of bounded size; where they are read, those
    that have `limit` places before theirs in the same Arrow batch are left out.
    """
    columns = (hotel, *(c for c in records.columns if c != hotel))
    form = T.StructType([*(T.StructField(c, records.schema[c].dataType) for c in columns), T.StructField("out", T.BooleanType())])
    first = _first_of_batches(records, limit, order, hotel)
    return first.groupBy(hotel).transformWithStateInPandas(_FirstPlaces(limit, order, columns), form, "Append", "None")


def after_changes(changes: DataFrame, order: tuple[str, ...] = ("page_no", "pos"), hotel: str = "hotel_url") -> DataFrame:
    """The records that the stored changes leave. A place is given and taken back at most
    once, so this is one anti join on it, which is unique on both sides."""
    place = [hotel, *order]
    gone = changes.where("out").select(*(F.col(c).alias(f"_{c}") for c in place))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in place]
    return changes.where(~F.col("out")).join(gone, same, "left_anti").drop("out")


def start_capped(records: DataFrame, path: str, checkpoint: str, **more) -> StreamingQuery:
    """Appends the changes of all that is available to the files at `path`, each once."""
    spark: SparkSession = records.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)  # a query keeps the settings it is started with
    try:
        changes = cap_stream(records, **more).writeStream.format("parquet").option("path", path)
        return changes.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
