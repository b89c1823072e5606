"""Structured Streaming over the event table: normalise, deduplicate, window, keyed state, order book."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions.columns import c
from tidemark.sources.tables import shared_folder

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LATENESS = "2 hours"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a file stream; event time is an instant (UTC), late rows are kept for ``LATENESS``."""
    raw = spark.readStream.schema(SCHEMA).parquet(f"{sf_dir}/events*.parquet")
    return raw.withColumn("at", c("ts").cast("timestamp")).withWatermark("at", LATENESS)


def normalised(stream: DataFrame) -> DataFrame:
    """Stable id of the payload, sequence number parsed, parse status."""
    k = F.get_json_object("props", "$.k").cast("int")
    return stream.select("event_id", "at", "user_id", "event_type", "value", k.alias("k"), F.substring(F.sha2(F.concat_ws(":", c("event_id").cast("string"), "props"), 256), 1, 16).alias("payload_id"), F.when(k.isNull(), "parse_error").otherwise("ok").alias("status"))


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """An event that comes again within the watermark is dropped."""
    return stream.dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """Notional and count of each type and window."""
    return stream.groupBy("event_type", F.window("at", width)).agg(F.sum("value").alias("notional"), F.count("*").alias("n"))


def replay_counters(stream: DataFrame, gap_s: int = 3600) -> DataFrame:
    """Per user the events, repeated payloads in a row and time gaps, in event-time order within a batch."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, repeats, gaps, last_at, last_props = state.get if state.exists else (0, 0, 0, 0, "")
        for row in pd.concat(list(frames)).sort_values(["at", "event_id"]).itertuples(index=False):
            at = int(row.at.value // 1000)
            repeats += bool(n) and row.props == last_props
            gaps += bool(n) and at - last_at > gap_s * 1_000_000
            n, last_at, last_props = n + 1, at, row.props
        state.update((n, repeats, gaps, last_at, last_props))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "repeats": [repeats], "gaps": [gaps]})

    keyed = stream.select("user_id", "event_id", "at", "props").groupBy("user_id")
    return keyed.applyInPandasWithState(update, "user_id bigint, n bigint, repeats bigint, gaps bigint", "n bigint, repeats bigint, gaps bigint, last_at bigint, last_props string", "update", GroupStateTimeout.NoTimeout)


def order_books(stream: DataFrame) -> DataFrame:
    """Price levels per user kept as state.  A view sets a bid, a click an ask, quantity k; k under 20 deletes the level."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = json.loads(state.get[0]) if state.exists else {"view": {}, "click": {}}
        for row in pd.concat(list(frames)).sort_values(["at", "event_id"]).itertuples(index=False):
            side, price = book.get(row.event_type), f"{row.value:.2f}"
            if side is None:
                continue
            if row.k < 20:
                side.pop(price, None)
            else:
                side[price] = int(row.k)
        state.update((json.dumps(book, sort_keys=True),))
        bids, asks = ({float(p): q for p, q in book[s].items()} for s in ("view", "click"))
        yield pd.DataFrame({"user_id": [key[0]], "best_bid": [max(bids, default=None)], "best_ask": [min(asks, default=None)], "bid_levels": [len(bids)], "ask_levels": [len(asks)]}).astype({"best_bid": "float64", "best_ask": "float64"})

    keyed = normalised(stream).select("user_id", "event_id", "at", "event_type", "value", "k").groupBy("user_id")
    return keyed.applyInPandasWithState(update, "user_id bigint, best_bid double, best_ask double, bid_levels bigint, ask_levels bigint", "book string", "update", GroupStateTimeout.NoTimeout)


LEVELS = "array<struct<price:double,qty:double>>"


class DepthBook:
    """One symbol's book: a snapshot, then diffs that must bridge it and follow each other without a gap."""

    FIELDS = ("bids", "asks", "snapshot_id", "last_id", "applied", "gaps", "stale", "status")

    def __init__(self, held: dict | None = None) -> None:
        for name in self.FIELDS:
            setattr(self, name, (held or {}).get(name))
        self._shown = None  # until the book changes

    def snapshot(self, update_id: int, bids: list, asks: list) -> tuple[str, str | None]:
        self.bids, self.asks = ({f"{x['price']!r}": x["qty"] for x in side if x["qty"] > 0} for side in (bids, asks))
        self.snapshot_id = self.last_id = update_id
        self._shown = None
        self.applied, self.gaps, self.stale, self.status = 0, self.gaps or 0, self.stale or 0, "awaiting_bridge"
        return "snapshot", None

    def diff(self, first: int | None, final: int | None, previous: int | None, bids: list, asks: list) -> tuple[str, str | None]:
        """The action taken on a diff and why."""
        if self.snapshot_id is None:
            return "awaiting_snapshot", None
        if final is None:
            return "parse_error", "missing_final_update_id"
        if final < self.snapshot_id:
            self.stale += 1
            return "dropped_stale", None
        if not self.applied:
            reason = "first_update_does_not_bridge_snapshot" if first is not None and not first <= self.snapshot_id <= final else None
        elif previous is not None:
            reason = "depth_pu_gap" if previous != self.last_id else None
        else:
            reason = "depth_update_gap" if first is not None and first > self.last_id + 1 else None
        if reason:
            self.status, self.gaps = "resync_required", self.gaps + 1
            return "resync_required", reason
        for book, side in ((self.bids, bids), (self.asks, asks)):
            for x in side:
                if x["qty"] > 0:
                    book[f"{x['price']!r}"] = x["qty"]
                else:
                    book.pop(f"{x['price']!r}", None)
        self.last_id, self.applied, self._shown = final, self.applied + 1, None
        self.status = self.status if self.status == "resync_required" else "active"
        return "applied", None

    def shown(self) -> dict:
        """Best prices, mid, spread and a checksum of the book."""
        if self._shown is None:
            self._shown = self._look()
        return self._shown

    def _look(self) -> dict:
        bids, asks = (sorted(((float(p), q) for p, q in (side or {}).items()), reverse=up) for side, up in ((self.bids, True), (self.asks, False)))
        bid, ask = (side[0][0] if side else None for side in (bids, asks))
        mid = None if bid is None or ask is None else (bid + ask) / 2
        text = json.dumps([self.last_id, bids, asks], separators=(",", ":"))
        return {"best_bid": bid, "best_ask": ask, "mid": mid, "spread_bps": (ask - bid) / mid * 1e4 if mid else None, "levels": len(bids) + len(asks), "checksum": hashlib.sha256(text.encode()).hexdigest()}

    def held(self) -> str:
        return json.dumps({name: getattr(self, name) for name in self.FIELDS})


def depth_updates(stream: DataFrame) -> DataFrame:
    """What each message (``symbol, at, event_id, kind, first_id, final_id, previous_id, bids, asks``) did to its symbol's book.

    A message of kind "snapshot" sets the book anew, others are diffs.  Books are
    keyed state; messages of a batch are taken in event-time order.  A message
    goes to its book, and what it did comes back, as one JSON text: what pandas
    takes a column and group would cost more than the books do.
    """
    names = ["event_id", "kind", "first_id", "final_id", "previous_id", "bids", "asks"]
    message = F.to_json(F.struct(F.unix_micros(c("at").cast("timestamp")).alias("at"), *names), {"ignoreNullFields": "false"})
    levels = lambda side: [{"price": float(x["price"]), "qty": float(x["qty"])} for x in side or ()]

    def in_time(m: dict) -> tuple:
        return m["at"] is None, m["at"] or 0, m["event_id"] is None, m["event_id"] or 0

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        book = DepthBook(json.loads(state.get[0]) if state.exists else None)
        out = []
        for m in sorted((json.loads(text) for frame in frames for text in frame["message"]), key=in_time):
            bids, asks = levels(m["bids"]), levels(m["asks"])
            if m["kind"] == "snapshot":
                action, reason = book.snapshot(m["final_id"], bids, asks)
            else:
                action, reason = book.diff(m["first_id"], m["final_id"], m["previous_id"], bids, asks)
            out.append(json.dumps({"event_id": m["event_id"], "action": action, "reason": reason, "status": book.status, **book.shown()}))
        state.update((book.held(),))
        yield pd.DataFrame({"symbol": key[0], "did": out})

    fields = "event_id bigint, action string, reason string, status string, best_bid double, best_ask double, mid double, spread_bps double, levels bigint, checksum string"
    keyed = stream.select("symbol", message.alias("message")).groupBy("symbol")
    did = keyed.applyInPandasWithState(update, "symbol bigint, did string", "book string", "append", GroupStateTimeout.NoTimeout)
    return did.select("symbol", F.from_json("did", fields).alias("did")).select("symbol", "did.*")


def depth_messages(events: DataFrame) -> DataFrame:
    """Depth messages drawn from events: a purchase is a snapshot, the others diffs of two levels; sizes of 0 delete a level."""
    k = F.get_json_object("props", "$.k").cast("int")
    level = lambda price, qty: F.struct(price.cast("double").alias("price"), qty.cast("double").alias("qty"))
    size = F.greatest(k - 20, F.lit(0))
    bids = F.array(level(F.lit(100) - k % 10, size), level(F.lit(90) - k % 7, k))
    asks = F.array(level(F.lit(101) + k % 10, size), level(F.lit(111) + k % 7, k))
    kind = F.when(c("event_type") == "purchase", "snapshot").otherwise("diff")
    final = F.when(k % 29 != 3, c("event_id") - F.when(k % 13 == 5, 2000).otherwise(0))
    return events.select(c("user_id").alias("symbol"), "at", "event_id", kind.alias("kind"), (c("event_id") - 300).alias("first_id"), F.when(kind == "snapshot", c("event_id")).otherwise(final).alias("final_id"), F.when(k % 31 == 7, c("event_id") - 1).alias("previous_id"), bids.alias("bids"), asks.alias("asks"))


def heartbeats(stream: DataFrame, interval_s: int = 6 * 3600, expiry_s: int = 24 * 3600) -> DataFrame:
    """``user_id, started, at, kind, messages``: a heartbeat each interval of a session's life, and its end.

    A session begins with an event and lives until ``expiry_s`` without one; it
    is touched by events and beats at ``started`` + k intervals whether events
    come or not: timers on the watermark fire where nothing does, so that a
    silent session still beats once an interval and is then dropped, and state
    is bounded by the sessions that live.  ``messages`` counts the events up to
    the beat.  The rows do not depend on how events are cut into batches as long
    as they come in order; an event behind the last one of its session is
    counted but moves no clock.
    """
    interval, expiry = interval_s * 1_000_000, expiry_s * 1_000_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, last, beaten, messages = state.get if state.exists else (None, None, 0, 0)
        out: list[tuple] = []

        def until(now: int) -> None:
            nonlocal started, beaten, messages
            while started is not None and (due := started + (beaten + 1) * interval) <= min(now, last + expiry):
                beaten += 1
                out.append((started, due, "heartbeat", messages))
            if started is not None and last + expiry <= now:
                out.append((started, last + expiry, "expired", messages))
                started, beaten, messages = None, 0, 0

        times = sorted(int(t.value // 1000) for f in frames for t in f["at"])
        for at in times:
            until(at - 1)
            if started is None:
                started = last = at
            last = max(last, at)
            messages += 1
        watermark = state.getCurrentWatermarkMs() * 1000
        until(watermark)
        if started is None:
            if state.exists:
                state.remove()
        else:
            state.update((started, last, beaten, messages))
            state.setTimeoutTimestamp(max(watermark // 1000 + 1, min(started + (beaten + 1) * interval, last + expiry) // 1000))
        yield pd.DataFrame({"user_id": pd.Series([key[0]] * len(out), dtype="int64"), "started": pd.to_datetime([x[0] for x in out], unit="us"), "at": pd.to_datetime([x[1] for x in out], unit="us"), "kind": pd.Series([x[2] for x in out], dtype=str), "messages": pd.Series([x[3] for x in out], dtype="int64")})

    keyed = stream.select("user_id", "at").groupBy("user_id")
    return keyed.applyInPandasWithState(update, "user_id bigint, started timestamp, at timestamp, kind string, messages bigint", "started bigint, last bigint, beaten bigint, messages bigint", "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over all that is there and return what it wrote; with ``keys`` the last row of each.

    Output and checkpoint go to the cluster's shared checkpoint folder.
    """
    spark = stream.sparkSession
    root = shared_folder(spark) + f"/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/b={number}")

    sink: Callable = write
    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/out")
    names = [x for x in out.columns if x not in {"_batch", "b"}]
    if keys:
        out = out.groupBy(*keys).agg(F.max_by(F.struct(*[x for x in names if x not in keys]), "_batch").alias("_s")).select(*keys, "_s.*")
    elif mode == "complete":
        last = out.agg(F.max("_batch").alias("_last"))
        out = out.join(F.broadcast(last), c("_batch") == c("_last"))
    return out.select(*names)
