"""Stateful streams: the last accepted rows, shuffle buffers, bounded seen-sets, late data.

State is kept in RocksDB by ``transformWithState``: a batch reads and writes the entries that
its rows touch, whatever the size of the state, and a restart takes it from the checkpoint.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Event times of rows, of the timers that end a source, and of the row that sets them off.
ROW_TIME, TIMER_TIME, END_TIME = 5 * 86_400, 10 * 86_400, 20 * 86_400


class FifoWindow(StatefulProcessor):
    """Accepts a key unless it is among the last ``size`` accepted ones; a hit doesn't refresh
    its place.  ``ring`` has the key of each slot, ``held`` those in the window."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "key string", "turn long")
        self.ring = handle.getMapState("ring", "slot long", "key string")
        self.accepted = handle.getValueState("accepted", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("place", kind="stable")
        n = self.accepted.get()[0] if self.accepted.exists() else 0
        held: dict[str, int | None] = {}
        ring: dict[int, str] = {}
        before, kept = n, []
        for k in frame["key"]:
            if k not in held:
                held[k] = n if self.held.containsKey((k,)) else None
            kept.append(held[k] is None)
            if held[k] is None:
                slot = n % self.size
                if n >= self.size:
                    held[ring[slot] if slot in ring else self.ring.getValue((slot,))[0]] = None
                ring[slot], held[k], n = k, n, n + 1
        if n > before:
            for slot, k in ring.items():
                self.ring.updateValue((slot,), (k,))
            for k, turn in held.items():
                if turn is None:
                    self.held.removeKey((k,))
                elif turn >= before:
                    self.held.updateValue((k,), (turn,))
            self.accepted.update((n,))
        yield frame[kept][["place", "key"]]

    def close(self) -> None:
        pass


class ShuffleBuffer(StatefulProcessor):
    """Per source: holds ``capacity`` rows; a further row takes the place of one that is drawn
    by the hash of seed, source and number of draws; a timer at the end of the stream draws the
    rest.  Rows up to the position that a source begins at were consumed before."""

    def __init__(self, capacity: int, seed: str):
        self.capacity, self.seed = capacity, seed

    def init(self, handle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot long", "place long")
        self.counters = handle.getValueState("counters", "held long, draws long, position long")

    def _open(self) -> None:
        self.have: dict[int, int] = {}
        self.changed: set[int] = set()
        self.n, self.draws, self.position = self.counters.get() if self.counters.exists() else (0, 0, None)
        self.stored = self.n

    def _slot(self, i: int) -> int:
        if i not in self.have:
            self.have[i] = self.slots.getValue((i,))[0]
        return self.have[i]

    def _draw(self, source: str) -> int:
        digest = hashlib.sha256(f"{self.seed}:{source}:{self.draws}".encode()).hexdigest()
        at, self.n, self.draws = int(digest, 16) % self.n, self.n - 1, self.draws + 1
        drawn, moved = self._slot(at), self._slot(self.n)
        self.have[at] = moved
        self.changed |= {at}
        return drawn

    def _close(self) -> None:
        for i in range(self.n, self.stored):
            self.slots.removeKey((i,))
        for i in self.changed:
            if i < self.n:
                self.slots.updateValue((i,), (self.have[i],))
        self.counters.update((self.n, self.draws, self.position))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        out, first, known = [], self.draws, self.position
        for place in pd.concat(list(rows))["place"].dropna().astype("int64").sort_values().tolist():
            if known is not None and place <= known:
                continue
            self.have[self.n], self.position, self.n = place, place, self.n + 1
            self.changed.add(self.n - 1)
            if self.n > self.capacity:
                out.append(self._draw(key[0]))
        if key[0] is not None:
            self._close()
            self.handle.registerTimer(TIMER_TIME * 1000)
        yield self._rows(key[0], first, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._open()
        first = self.draws
        out = [self._draw(key[0]) for _ in range(self.n)]
        self._close()
        yield self._rows(key[0], first, out)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        position = initialState["position"].iloc[0]
        self.counters.update((0, 0, None if pd.isna(position) else int(position)))

    @staticmethod
    def _rows(source, first: int, out: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"source": pd.Series([source] * len(out), dtype=object), "turn": pd.Series(range(first, first + len(out)), dtype="int64"), "place": pd.Series(out, dtype="int64")})

    def close(self) -> None:
        pass


class SeenSet(StatefulProcessor):
    """Rows have several keys.  A row is accepted if it has no reason against it and none of
    its keys is excluded or was seen with an accepted row; more than ``cap`` seen keys are an
    error, which fails the batch before it is committed.  ``counts`` has rows by source and
    verdict."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle) -> None:
        self.seen = handle.getMapState("seen", "key string", "place long")
        self.excluded = handle.getMapState("excluded", "key string", "place long")
        self.counts = handle.getMapState("counts", "source string, verdict string", "n long")
        self.total = handle.getValueState("total", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("place", kind="stable")
        total = self.total.get()[0] if self.total.exists() else 0
        new: dict[str, int] = {}
        counts: Counter = Counter()
        verdicts = []
        for place, source, reason, keys in zip(frame["place"], frame["source"], frame["reason"], frame["keys"], strict=True):
            own = list(dict.fromkeys(keys))
            if reason is not None:
                verdict = reason
            elif any(self.excluded.containsKey((k,)) for k in own):
                verdict = "reference_overlap"
            elif any(k in new or self.seen.containsKey((k,)) for k in own):
                verdict = "duplicate"
            elif total + len(new) + len(own) > self.cap:
                raise RuntimeError(f"more than {self.cap} keys would be kept; none is forgotten silently")
            else:
                verdict = "accepted"
                new |= dict.fromkeys(own, int(place))
            verdicts.append(verdict)
            counts[(source, verdict)] += 1
        for k, place in new.items():
            self.seen.updateValue((k,), (place,))
        for k, n in counts.items():
            self.counts.updateValue(k, (n + (self.counts.getValue(k)[0] if self.counts.containsKey(k) else 0),))
        self.total.update((total + len(new),))
        yield pd.DataFrame({"place": frame["place"].to_numpy(), "verdict": pd.Series(verdicts, dtype=object)})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for k in initialState["key"]:
            self.excluded.updateValue((k,), (-1,))

    def close(self) -> None:
        pass


def _owned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("owner", F.lit(0))


def fifo_dedup(stream: DataFrame, size: int) -> DataFrame:
    """Rows (place, key) accepted by one window over all sources; a null key counts as ''.

    The window counts accepted rows of the whole stream, so it has a single owner; a batch's
    keys are held in memory, so the source should bound its batches."""
    rows = _owned(stream.select("place", F.coalesce("key", F.lit("")).alias("key")))
    return rows.groupBy("owner").transformWithStateInPandas(FifoWindow(size), "place long, key string", "Append", "None")


def shuffle_buffer(stream: DataFrame, capacity: int, seed: str, begun: DataFrame | None = None) -> DataFrame:
    """Rows (source, place) in the order that each source's buffer gives them out, numbered.
    The row that ``mark_end`` writes after the last one ends all sources.  ``begun`` (source,
    position) has the sources that were read before, as ``shuffle_positions`` gives them."""
    ended = F.col("source").isNull() & F.col("place").isNull()
    rows = stream.withColumn("ts", F.timestamp_seconds(F.when(ended, F.lit(END_TIME)).otherwise(F.lit(ROW_TIME)))).withWatermark("ts", "1 day")
    return rows.groupBy("source").transformWithStateInPandas(ShuffleBuffer(capacity, seed), "source string, turn long, place long", "Append", "EventTime", initialState=None if begun is None else begun.groupBy("source"))


def mark_end(spark: SparkSession, path: str) -> None:
    """Write the row that ends the sources of a stream of (source, place) rows."""
    spark.createDataFrame([(None, None)], "source string, place long").write.mode("append").parquet(path)


def shuffle_positions(spark: SparkSession, checkpoint: str, sources: list[str]) -> DataFrame:
    """For a changed set of ``sources``, from the stored state of the stream before: source,
    position (null for a new source), and how many rows its buffer still held.  Those are
    dropped: they were taken in under other rules.  A source can't be left out."""
    read = spark.read.format("statestore").option("stateVarName", "counters").load(checkpoint)
    have = read.select(F.col("key.source").alias("source"), F.col("value.position").alias("position"), F.col("value.held").alias("dropped")).filter("source is not null")
    lost = have.filter(~F.col("source").isin(sources)).count()
    if lost:
        raise ValueError(f"{lost} sources of the saved state are left out")
    named = spark.createDataFrame([(s,) for s in sources], "source string")
    return named.join(have, "source", "left").select("source", "position", F.coalesce("dropped", F.lit(0)).alias("dropped"))


def seen_set(stream: DataFrame, cap: int, excluded: DataFrame | None = None) -> DataFrame:
    """place, verdict of every row (place, source, reason, keys); ``excluded`` has a column key.

    That no key of an accepted row comes twice is a statement on the whole stream in its order,
    so there is a single owner, whose state ``cap`` bounds."""
    rows = _owned(stream.select("place", "source", "reason", "keys"))
    begin = None if excluded is None else _owned(excluded.select("key")).groupBy("owner")
    return rows.groupBy("owner").transformWithStateInPandas(SeenSet(cap), "place long, verdict string", "Append", "None", initialState=begin)


def seen_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """source, verdict, n of a stored seen-set."""
    read = spark.read.format("statestore").option("stateVarName", "counts").load(checkpoint)
    return read.select("user_map_key.source", "user_map_key.verdict", F.col("user_map_value.n").alias("n"))


def event_counts(stream: DataFrame, width: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Rows and sum of value by type and window of event time; later rows than ``late`` go."""
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def event_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Rows by user and session of event time; later rows than ``late`` go."""
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
