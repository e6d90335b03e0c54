"""Stateful processors for what Spark's streaming operators can't express: arrival order and strict-next patterns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: State of these processors lives in RocksDB.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

#: Of a run over whole tables: no lookup before each write (for a count of rows that nobody reads), one store for both sides
#: of a join in place of four, commits that write what changed.
WHOLE = PROVIDER | {
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false", "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}

#: Rows of a device in a chunk of its state and in a frame of its results.
CHUNK = 10_000


class FirstNew(StatefulProcessor):
    """Of a device's rows that say new, the first to arrive keeps it. Arrival order within a micro-batch is by `seq`."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        new = [f["is_new"].to_numpy(dtype=object) == "1" for f in frames]
        if any(n.any() for n in new):
            keep = None
            if not self.seen.exists():
                self.seen.update((True,))
                keep = min((int(q[n].min()), k) for k, (q, n) in enumerate(zip((f["seq"].to_numpy() for f in frames), new, strict=True)) if n.any())
            for k, (f, n) in enumerate(zip(frames, new, strict=True)):
                flags = f["is_new"].to_numpy(dtype=object, copy=True)
                flags[n] = "0"
                if keep and keep[1] == k:
                    flags[int((n & (f["seq"].to_numpy() == keep[0])).argmax())] = "1"
                f["is_new"] = flags
        yield from frames

    def close(self) -> None:
        pass


def repair_is_new(df: DataFrame, mid: str = "mid") -> DataFrame:
    """Streaming form; df has mid, is_new and seq (the topic's offset). State never expires: one flag per device."""
    return df.groupBy(mid).transformWithStateInPandas(FirstNew(), df.schema, "Append", "None")


class InOrder(StatefulProcessor):
    """Takes the rows of a device in event time: rows wait until the watermark passes them, then take() sees them one by one in
    order of (ts, seq). Rows behind the watermark are dropped. A device has one timer, at the least time at which something
    can happen. Every call of the state is a message to the JVM, so rows wait in chunks, one for each frame that came, and
    what take() remembers is read and written once for all rows that are due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows string")
        self.next = handle.getValueState("next", "at bigint")

    def load(self) -> None:
        """Before the rows that are due: what is remembered of the device."""
        raise NotImplementedError

    def take(self, row: tuple[int, int, str], entry: bool, out: list) -> None:
        raise NotImplementedError

    def settle(self, now: int, out: list) -> int | None:
        """After the rows that are due: what the time alone decides, and when to look again."""

    def save(self) -> None:
        raise NotImplementedError

    def _timer(self, at: int) -> None:
        """The timer goes to `at` unless it is set for an earlier time."""
        if self.next.exists():
            before = self.next.get()[0]
            if before <= at:
                return
            self.handle.deleteTimer(before)
        self.next.update((at,))
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, least, chunks = timerValues.getCurrentWatermarkInMs(), None, []
        for b in rows:
            came = [(ts, seq, bool(entry), payload) for ts, seq, entry, payload in zip(b["ts"].tolist(), b["seq"].tolist(), b["entry"].tolist(), b["payload"].tolist(), strict=True) if ts >= watermark]
            if came:
                chunks.append((json.dumps(came),))
                first = min(r[0] for r in came)
                least = first if least is None else min(least, first)
        if chunks:
            self.waiting.appendList(chunks)
            self._timer(least + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out, due, later = [], {}, []
        for (chunk,) in self.waiting.get():
            for ts, seq, entry, payload in json.loads(chunk):
                if ts < now:
                    due[ts, seq] = entry, payload
                else:
                    later.append((ts, seq, entry, payload))
        if due and later:
            self.waiting.put([(json.dumps(later[k : k + CHUNK]),) for k in range(0, len(later), CHUNK)])
        elif due:
            self.waiting.clear()
        self.load()
        for k in sorted(due):
            entry, payload = due[k]
            self.take((*k, payload), entry, out)
        again = self.settle(now, out)
        self.save()
        at = [t for t in (again, min(r[0] for r in later) + 1 if later else None) if t is not None]
        if at:
            self.next.update((min(at),))
            self.handle.registerTimer(min(at))
        else:
            self.next.clear()
        for k in range(0, len(out), CHUNK):
            yield self._frame(key, out[k : k + CHUNK])

    @staticmethod
    def _frame(key, rows: list) -> pd.DataFrame:
        ts, seq, payload = zip(*rows, strict=True)
        return pd.DataFrame({"mid": [key[0]] * len(rows), "ts": ts, "seq": seq, "payload": payload})

    def close(self) -> None:
        pass


class Remembering(InOrder):
    """InOrder with one value that lives from row to row."""

    kept = ("kept", "")

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState(*self.kept)

    def load(self) -> None:
        self.value = self.before = tuple(self.state.get()) if self.state.exists() else None

    def save(self) -> None:
        if self.value != self.before:
            self.state.update(self.value) if self.value is not None else self.state.clear()


class Jumps(Remembering):
    """Entries whose strict next row is an entry, comes `within` later, or does not come. One entry may be pending; it goes out
    when the watermark is `within` behind it and nothing came."""

    kept = ("pending", "ts bigint, seq bigint, payload string")

    def __init__(self, within_ms: int):
        self.within = within_ms

    def take(self, row: tuple[int, int, str], entry: bool, out: list) -> None:
        p = self.value
        if p is not None and (entry or row[0] - p[0] >= self.within):
            out.append(p)
        self.value = row if entry else None

    def settle(self, now: int, out: list) -> int | None:
        p = self.value
        if p is None:
            return None
        if now < p[0] + self.within:
            return p[0] + self.within
        out.append(p)
        self.value = None
        return None


class Visits(Remembering):
    """The first entry of each day. As rows come in event time, the last day seen is all that is remembered."""

    kept = ("day", "day bigint")

    def take(self, row: tuple[int, int, str], entry: bool, out: list) -> None:
        day = (row[0] // 86_400_000,)
        if entry and self.value != day:
            self.value = day
            out.append(row)


def _in_order(pages: DataFrame, processor: InOrder, delay: str, carry: tuple[str, ...]) -> DataFrame:
    rows = pages.withWatermark("event_time", delay).select(
        "mid", "event_time", "ts", "seq", F.col("last_page_id").isNull().alias("entry"), F.to_json(F.struct(*carry)).alias("payload"))
    found = rows.groupBy("mid").transformWithStateInPandas(processor, "mid string, ts bigint, seq bigint, payload string", "Append", "EventTime")
    back = F.from_json("payload", ", ".join(f"{c} string" for c in carry))
    return found.select("mid", "ts", "seq", F.timestamp_millis("ts").alias("event_time"), back.alias("p")).select("mid", "ts", "seq", "event_time", "p.*")


CARRIED = ("vc", "ch", "ar", "is_new")


def user_jumps(pages: DataFrame, within_ms: int = 10_000, delay: str = "2 seconds", carry: tuple[str, ...] = CARRIED) -> DataFrame:
    """Streaming form; pages have mid, ts, seq, event_time, last_page_id and the carried columns."""
    return _in_order(pages, Jumps(within_ms), delay, carry)


def first_visits(pages: DataFrame, delay: str = "2 seconds", carry: tuple[str, ...] = CARRIED) -> DataFrame:
    """First entry of each device and UTC day in event time, whatever the order of arrival."""
    return _in_order(pages, Visits(), delay, carry)


class Changelog(StatefulProcessor):
    """Settles the changes of a key by their sequence. A change behind the last one taken is stale and goes; any other takes
    back the row that was sent before and sends the new one, unless it deletes. Deleted keys keep their sequence, so that a
    stale change can't bring them back."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq bigint, row string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = sorted((int(s), k, d, r) for b in rows for k, (s, d, r) in enumerate(zip(b["seq"], b["deleted"], b["row"], strict=True)))
        seen, sent = self.last.get() if self.last.exists() else (None, None)
        before, out = (seen, sent), []
        for seq, _, deleted, row in batch:
            if seen is not None and seq <= seen:
                continue
            now = None if deleted else row
            if sent is not None:
                out.append((key[0], seq, 0, False, sent))
            if now is not None:
                out.append((key[0], seq, 1, True, now))
            seen, sent = seq, now
        if (seen, sent) != before:
            self.last.update((seen, sent))
        yield pd.DataFrame(out, columns=["key", "seq", "step", "flag", "row"]).astype({"seq": "int64", "step": "int32", "flag": "bool"})

    def close(self) -> None:
        pass


def retractions(log: DataFrame, pk: str = "id") -> DataFrame:
    """(key, seq, step, flag, row) of a stream of change envelopes with `seq`: a retract stream in which every row that is
    taken back was sent before with the same content, whatever the order of arrival."""
    value = F.coalesce(F.col("after")[pk], F.col("before")[pk])
    rows = log.select(value.alias("key"), "seq", F.col("type").eqNullSafe("delete").alias("deleted"), F.to_json("after").alias("row")).where(F.col("key").isNotNull() & F.col("seq").isNotNull())
    found = rows.groupBy("key").transformWithStateInPandas(Changelog(), "key string, seq bigint, step int, flag boolean, row string", "Update", "None")
    return found.withColumn("row", F.from_json("row", "map<string,string>"))
