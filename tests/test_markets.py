"""Books, trades, margins and order-book diffs against literal cases and plain loops."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import venue as v
from tidemark.operators import markets

LEVEL = "array<struct<price:double,qty:double>>"


def test_microstructure_of_two_snapshots(spark):
    depths = spark.createDataFrame(
        [("BTC", 1000, [(100.0, 1.0), (99.0, 4.0)], [(100.01, 1.0), (102.0, 1.0)]), ("BTC", 2000, [(100.0, 3.0)], [(101.0, 1.0), (102.0, 9.0)]), ("ETH", 1500, [], [(5.0, 1.0)])], f"symbol string, at bigint, bids {LEVEL}, asks {LEVEL}"
    )
    trades = spark.createDataFrame([("BTC", 900, 100.0, 2.0, False), ("BTC", 1000, 100.0, 1.0, True), ("BTC", 1500, 101.0, 3.0, True), ("BTC", 2500, 1.0, 1.0, False)], "symbol string, at bigint, price double, qty double, buyer_is_maker boolean")
    got = {(r.symbol, r.at): r for r in markets.microstructure(depths, trades).collect()}
    a, b, e = got["BTC", 1000], got["BTC", 2000], got["ETH", 1500]
    assert (a.signed_delta, a.trade_count, a.replenishment, a.spread_spike, a.imbalanced_levels) == (100.0, 2, 0.0, 0, 1)
    assert (a.bid_depth_1bp, a.ask_depth_1bp) == (100.0, pytest.approx(100.01))
    assert (b.signed_delta, b.trade_count, b.spread_spike, b.imbalanced_levels) == (-303.0, 1, 1, 0)
    assert b.replenishment == pytest.approx((300 + 101 + 918) / (100 + 396 + 100.01 + 102) - 1)
    assert b.absorption == 1.0 and a.absorption == 1.0
    assert (e.best_bid, e.spread_bps, e.bid_depth_1bp, e.signed_delta, e.trade_count, e.imbalanced_levels) == (0.0, 0.0, 0.0, 0.0, 0, 0)


def test_trimmed_mean_drops_a_tenth_at_both_ends(spark):
    rows = [("a", float(x)) for x in range(20)] + [("a", -5.0)] + [("b", 1.0), ("b", 3.0)] + [("c", 2.0)] * 9 + [("c", 50.0)]
    got = {r.g: r.trimmed for r in markets.trimmed_mean(spark.createDataFrame(rows, "g string, x double"), "g", "x").collect()}
    assert got == {"a": sum(range(2, 18)) / 16, "b": 2.0, "c": 2.0}


def test_margins_and_fills(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first()["x"]
    tiers = [(50.0, None, 0.02), (0.0, 50.0, 0.01)]
    assert [one(v.maintenance_margin(F.lit(n), tiers)) for n in (0.0, -49.0, 50.0, 1e9)] == [0.01, 0.01, 0.02, 0.02]
    assert one(v.maintenance_margin(F.lit(99.0), [(0.0, 50.0, 0.01)])) == 0.01
    no, yes = F.lit(False), F.lit(True)
    assert one(v.fill_ratio(F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0), no)) == 1.0
    assert one(v.fill_ratio(F.lit(10.0), F.lit(0.0), F.lit(9.0), F.lit(1.0), no)) == 0.0
    assert one(v.fill_ratio(F.lit(10.0), F.lit(5.0), F.lit(9.0), F.lit(1.25), yes)) == pytest.approx(0.5 / 1.25 * 0.85)
    assert one(v.fill_ratio(F.lit(1000.0), F.lit(5.0), F.lit(9.0), F.lit(1.0), no)) == 0.05
    assert one(v.adverse_bps(F.lit(10.0), F.lit(1.0), F.lit(1.75), yes, F.lit(3.0), F.lit(3.0), yes)) == 0.0
    assert one(v.adverse_bps(F.lit(100.0), F.lit(0.5), F.lit(1.5), yes, F.lit(3.0), F.lit(0.0), no)) == pytest.approx(100 * (0.2 + 0.6) * 1.2)
    assert one(v.note_value(F.array(F.lit("a=1"), F.lit("tick=x"), F.lit("tick=0.5")), "tick", 9.0)) == 0.5
    assert one(v.embargo_bars(F.lit(1000), F.lit(4), 0.02)) == 20
    with pytest.raises(ValueError, match="embargo"):
        v.embargo_bars(F.lit(1), F.lit(1), 0.2)


def test_depth_diffs_by_the_rules():
    from tidemark.streaming.events import DepthBook

    up = lambda p, q: {"price": p, "qty": q}
    book = DepthBook()
    assert book.diff(1, 2, None, [], []) == ("awaiting_snapshot", None)
    book.snapshot(100, [up(10.0, 1.0), up(9.0, 2.0)], [up(11.0, 1.0)])
    assert book.diff(90, None, None, [], []) == ("parse_error", "missing_final_update_id")
    assert book.diff(90, 99, None, [], []) == ("dropped_stale", None)
    assert book.diff(101, 105, None, [], []) == ("resync_required", "first_update_does_not_bridge_snapshot")
    assert book.diff(95, 105, None, [up(10.0, 0.0), up(9.5, 3.0)], [up(10.5, 1.0)]) == ("applied", None)
    assert (book.shown()["best_bid"], book.shown()["best_ask"], book.shown()["mid"], book.shown()["levels"]) == (9.5, 10.5, 10.0, 4)
    assert book.status == "resync_required"  # until a new snapshot
    assert book.diff(106, 110, 104, [], []) == ("resync_required", "depth_pu_gap")
    assert book.diff(108, 110, None, [], []) == ("resync_required", "depth_update_gap")
    assert book.diff(106, 110, 105, [], []) == ("applied", None)
    book.snapshot(200, [up(1.0, 1.0)], [])
    assert (book.status, book.gaps, book.stale) == ("awaiting_bridge", 3, 1)
    assert DepthBook(__import__("json").loads(book.held())).shown() == book.shown()


def test_streamed_books_equal_a_plain_loop(spark, sf):
    from tidemark import plans
    from tidemark.streaming import events as s

    got = {r.event_id: (r.action, r.reason, r.status, r.best_bid, r.best_ask, r.checksum) for r in plans.queries()["j05_depth_updates"](spark, sf).collect()}
    rows = s.depth_messages(spark.read.parquet(f"{sf}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))).orderBy("at", "event_id").collect()
    books, want = {}, {}
    for r in rows:
        book = books.setdefault(r.symbol, s.DepthBook())
        did = book.snapshot(r.final_id, r.bids, r.asks) if r.kind == "snapshot" else book.diff(r.first_id, r.final_id, r.previous_id, r.bids, r.asks)
        shown = book.shown()
        want[r.event_id] = (*did, book.status, shown["best_bid"], shown["best_ask"], shown["checksum"])
    assert got == want
    assert {a for a, *_ in want.values()} >= {"applied", "resync_required", "snapshot", "awaiting_snapshot"}


def test_a_book_is_looked_at_once_until_it_changes():
    from tidemark.streaming.events import DepthBook

    level = lambda p, q: {"price": p, "qty": q}
    book = DepthBook()
    book.snapshot(100, [level(10.0, 1.0)], [level(11.0, 1.0)])
    seen = book.shown()
    assert book.diff(90, 99, None, [level(10.5, 1.0)], []) == ("dropped_stale", None)
    assert book.shown() is seen
    assert book.diff(95, 105, None, [level(10.5, 1.0)], []) == ("applied", None)
    assert book.shown()["best_bid"] == 10.5 and book.shown()["checksum"] != seen["checksum"]
    book.snapshot(200, [level(9.0, 1.0)], [])
    assert (book.shown()["best_bid"], book.shown()["best_ask"]) == (9.0, None)
