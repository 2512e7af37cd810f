"""What is carried along a series, sought in it or closed over links: against loops, and by the plan."""

import re
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import carry, closure, fills, indicators, joins, passage
from quantloom.operators.windows import recurrence

T0 = datetime(2024, 1, 1)
BAR = "symbol string, ts timestamp_ntz, low double, high double"


def exchanges(df):
    """The keys of each shuffle in the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan.replace("_chunk", "chunk"))]


@pytest.fixture(scope="module")
def one_symbol(spark):
    """(left, right): one symbol holds all rows, over 40 days, with times that meet and nulls."""
    rng = np.random.default_rng(1)
    at = lambda n: [T0 + timedelta(minutes=15 * int(x)) for x in rng.integers(0, 40 * 96, n)]
    left = [(i, "S", t) for i, t in enumerate(at(400))] + [(900, "S", T0 - timedelta(days=3)), (901, "S", T0 + timedelta(days=99)), (902, "S", None), (903, None, T0), (904, "T", T0)]
    right = [("S", t, None if i % 9 == 0 else float(i)) for i, t in enumerate(at(150)) if not T0 + timedelta(days=5) < t < T0 + timedelta(days=20)] + [("S", None, 5.0), (None, T0, 6.0)]
    return left, right


def test_asof_both_ways_of_one_symbol_that_holds_all_rows(spark, one_symbol):
    left, right = one_symbol
    a = spark.createDataFrame(left, "id int, symbol string, ts timestamp_ntz").repartition(3)
    b = spark.createDataFrame(right, "symbol string, ts timestamp_ntz, v double")
    known = defaultdict(list)
    for s, t, v in right:
        if s and t and v is not None:
            known[s].append((t, v))
    pick = {
        "back": lambda s, t: max((x for x in known[s] if x[0] <= t), default=(0, None))[1],
        "strict": lambda s, t: max((x for x in known[s] if x[0] < t), default=(0, None))[1],
        "forward": lambda s, t: min((x for x in known[s] if x[0] > t), default=(0, None))[1],
    }
    got = {
        "back": joins.asof_backward(a, b, ["symbol"], ["v"]), "strict": joins.asof_backward(a, b, ["symbol"], ["v"], strict=True), "forward": joins.asof_forward(a, b, ["symbol"], ["v"]),
    }
    for kind, df in got.items():
        assert {r.id: r.v for r in df.collect()} == {i: pick[kind](s, t) if s and t else None for i, s, t in left}
        # the rows themselves are dealt by symbol and chunk; by symbol alone only what chunks hand on
        assert ["symbol", "chunk"] in exchanges(df)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert all("_row" not in x for x in plan.splitlines() if "Window [" in x and "chunk" not in x.split("windowspecdefinition(", 1)[1].split("ASC")[0])


def test_recurrence_is_dealt_by_chunk_though_the_input_lies_by_symbol(spark):
    bars = spark.createDataFrame([("S", T0 + timedelta(days=i), float(i % 13)) for i in range(200)], "symbol string, ts timestamp_ntz, close double")
    by_symbol = bars.repartition("symbol").withColumn("n", F.count("*").over(carry.Window.partitionBy("symbol")))
    df = recurrence(by_symbol, ["symbol"], F.col("close"), "y", 0.7, F.date_trunc("month", "ts"))
    assert ["symbol", "chunk"] in exchanges(df)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("FlatMapGroupsInArrow") == 1  # one row a block goes through Python, no bar does
    y, want = None, {}
    for i in range(200):
        x = float(i % 13)
        y = x if y is None else 0.7 * y + 0.3 * x
        want[T0 + timedelta(days=i)] = y
    assert {r.ts: r.y for r in df.collect()} == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("decay", [0.0, 0.01, 0.5, 0.999, 1.0])
def test_recurrence_of_long_chunks_in_blocks(spark, decay):
    rng = np.random.default_rng(4)
    x = rng.normal(size=3000) * 10.0 ** rng.integers(-6, 7, 3000)
    rows = [(i, None if i % 11 == 3 or i < 2 else float(v)) for i, v in enumerate(x)]
    got = {r.ts: r.y for r in recurrence(spark.createDataFrame(rows, "ts int, x double").withColumn("k", F.lit("k")), ["k"], F.col("x"), "y", decay, (F.col("ts") / 1700).cast("int"), 0.5 if decay == 1 else None).collect()}
    y, gain = None, 0.5 if decay == 1 else 1 - decay
    for i, v in rows:
        y = y if v is None else v if y is None else decay * y + gain * v
        if decay == 1 and v is not None and i == 2:
            y = v
        assert got[i] == (None if y is None else pytest.approx(y, rel=1e-9, abs=1e-9))


def test_running_numbers_and_fills_of_one_symbol(spark):
    rng = np.random.default_rng(5)
    rows = [("S", T0 + timedelta(hours=int(h)), i) for i, h in enumerate(rng.integers(0, 24 * 30, 500))]
    df = carry.numbered(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, id int").repartition(4), ["symbol"], "n", F.to_date("ts"), ["ts", "id"])
    want = {i: n for n, (_, _, i) in enumerate(sorted(rows, key=lambda r: (r[1], r[2])), 1)}
    assert {r.id: r.n for r in df.collect()} == want
    assert ["symbol", "chunk"] in exchanges(df)


def test_fills_of_tenths_leave_no_slivers(spark, monkeypatch):
    """Tenths do not add up exactly in doubles; chunks of three fills are summed apart."""
    monkeypatch.setattr(fills, "SEQ_CHUNK", 3)
    rows = [("X", n, "BUY" if n % 2 else "SELL", 0.1, float(n), n) for n in range(1, 201)]
    got = fills.fifo_match(spark.createDataFrame(rows, "symbol string, seq long, side string, quantity double, price double, ts long"), ["symbol"]).collect()
    assert sorted((r.buy_seq, r.sell_seq, r.quantity) for r in got) == [(n, n + 1, 0.1) for n in range(1, 200, 2)]


def test_union_of_times_carries_last_values(spark):
    rows = {"a": [("A", 1, 1.0), ("A", 5, None), ("A", 70_000, 3.0), ("A", 5, 2.0)], "b": [("B", 3, 9.0), ("B", 3, 4.0), ("B", None, 1.0), (None, 4, 1.0)]}
    frames = [spark.createDataFrame(r, "k string, ts long, v double") for r in rows.values()]
    got = {(r.k, r.ts): r.v for r in carry.union_times(frames, ["k"], ["v"]).collect()}
    assert got == {("A", 1): 1.0, ("A", 3): 1.0, ("A", 5): 2.0, ("A", 70_000): 3.0, ("B", 1): None, ("B", 3): 9.0, ("B", 5): 9.0, ("B", 70_000): 9.0}


def test_values_from_ahead_take_one_pass(spark):
    """A frame that ends with its chunk is gone through anew for each row: 60,000 rows of a day took their square."""
    n = 60_000
    rows = spark.range(n).select(F.lit("S").alias("symbol"), F.expr(f"timestamp_ntz '{T0}' + make_dt_interval(0, 0, 0, cast(id as int))").alias("ts"), "id")
    got = joins.asof_forward(rows, rows.where("id % 1000 = 0").select("symbol", "ts", F.col("id").alias("v")), ["symbol"], ["v"])
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    wrong = got.where(~F.col("v").eqNullSafe(F.when(F.col("id") < n - 1000, (F.floor(F.col("id") / 1000) + 1) * 1000)))
    assert got.count() == n and wrong.count() == 0


# first passage


@pytest.mark.parametrize("radix", [5, 16])
def test_first_touch_equals_a_walk_along_the_bars(spark, monkeypatch, radix):
    monkeypatch.setattr(passage, "RADIX", radix)
    rng = np.random.default_rng(6)
    minute = lambda n: T0 + timedelta(minutes=int(n))
    lows = np.round(100 + np.cumsum(rng.normal(size=600)), 2)
    bars = {i: (float(x), float(x + rng.integers(0, 4))) for i, x in enumerate(lows) if i not in (77, 300)}
    table = [("S", minute(i), *b) for i, b in bars.items()] + [("S", minute(450), 1.0, 1.0), ("S", minute(500) + timedelta(seconds=7), 5.0, 6.0)]
    spans = []
    for k in range(120):
        a, n = int(rng.integers(-5, 560)), int(rng.choice([0, 1, 3, 30, 200]))
        w = float(rng.choice([1, 4, 30, 1000]))
        spans.append((k, "S", minute(a), minute(a + n), float(lows[max(0, a)]) - w, float(lows[max(0, a)]) + w))
    spans += [(900, "S", minute(10), minute(5), 0.0, 1.0), (901, "S", minute(10) + timedelta(seconds=1), minute(15), 0.0, 1.0), (902, "S", None, minute(5), 0.0, 1.0), (903, "T", minute(1), minute(2), 0.0, 1.0), (904, "S", minute(1), minute(2), None, 1.0)]
    got = passage.first_touch(spark.createDataFrame(spans, "id int, symbol string, a timestamp_ntz, b timestamp_ntz, dn double, up double"), spark.createDataFrame(table, BAR), ["symbol"], "id", "a", "b", "dn", "up", 60).collect()
    assert len(got) == len(spans)
    for r in got:
        _, s, a, b, dn, up = next(x for x in spans if x[0] == r.id)
        first, last = (round((x - T0) / timedelta(minutes=1)) if x else None for x in (a, b))
        whole = s == "S" and r.id < 900 and first < last and all(i in bars and i not in (450, 500) for i in range(first + 1, last + 1))
        hit = next((i for i in range(first + 1, last + 1) if bars[i][0] <= dn or bars[i][1] >= up), None) if whole else None
        kind = None if hit is None else "both" if bars[hit][0] <= dn and bars[hit][1] >= up else "down" if bars[hit][0] <= dn else "up"
        assert (r.complete, r.touched, r.touched_at) == (whole, kind, None if hit is None else minute(hit)), (r, a, b)


@pytest.mark.parametrize("radix", [5, 16])
def test_first_touch_by_cells_equals_a_walk(spark, monkeypatch, radix):
    monkeypatch.setattr(passage, "SENT", 0)
    test_first_touch_equals_a_walk_along_the_bars(spark, monkeypatch, radix)


@pytest.mark.parametrize("sent", [0, 1 << 17])
def test_first_touch_sends_blocks_only(spark, monkeypatch, tmp_path, sent):
    """Spans in a small file were sent to all tasks with all the blocks that fill them: Spark takes them for as small as their file."""
    monkeypatch.setattr(passage, "SENT", sent)
    n = 3_000
    spans = spark.range(n).select("id", F.lit("S").alias("symbol"), F.expr(f"timestamp_ntz '{T0}' + make_dt_interval(0, 0, cast(id % 100 as int))").alias("a"), F.expr(f"timestamp_ntz '{T0}' + make_dt_interval(0, 0, cast(id % 100 + 1 + id % 31 as int))").alias("b"),
                                  F.lit(0.5).alias("dn"), F.when(F.col("id") % 2 == 0, 130.0).otherwise(500.0).alias("up"))
    table = spark.range(200).select(F.lit("S").alias("symbol"), F.expr(f"timestamp_ntz '{T0}' + make_dt_interval(0, 0, cast(id as int))").alias("ts"), F.lit(1.0).alias("low"), (F.col("id") + 40.0).alias("high"))
    for name, df in (("spans", spans), ("bars", table)):
        df.write.parquet(str(tmp_path / name))
    df = passage.first_touch(spark.read.parquet(str(tmp_path / "spans")), spark.read.parquet(str(tmp_path / "bars")), ["symbol"], "id", "a", "b", "dn", "up", 60)

    def built(node):
        kids = node.children()
        if node.nodeName() == "BroadcastHashJoin":
            yield (node.right() if node.buildSide().toString() == "BuildRight" else node.left()).toString()
        for k in range(kids.size()):
            yield from built(kids.apply(k))

    sides = list(built(df._jdf.queryExecution().sparkPlan()))
    assert bool(sides) == bool(sent) and not any("Generate" in x or "spans" in x or "Aggregate" in x for x in sides), sides
    got = {r.id: (r.n_bars, r.complete, r.touched, r.touched_at) for r in df.collect()}
    for k in range(n):
        a, b = k % 100, k % 100 + 1 + k % 31
        hit = max(90, a + 1) if k % 2 == 0 and b >= 90 else None
        assert got[k] == (b - a, True, None if hit is None else "up", None if hit is None else T0 + timedelta(minutes=hit))


def test_a_long_span_meets_few_blocks(spark):
    cover = spark.range(1).select(passage._cover(F.lit(5).cast("long"), F.lit(60_000).cast("long"), 4).alias("c")).first().c
    points = sorted(p for b in cover for p in range(b.id * 16**b.level, (b.id + 1) * 16**b.level))
    assert points == list(range(5, 60_001)) and len(cover) < 120


# links


def plain_closure(links, roots=None):
    below = defaultdict(set)
    for c, p in links:
        if c is not None and p is not None and c != p:
            below[p].add(c)
    out = {}
    for root in roots if roots is not None else list(below):
        front, depth, seen = {root}, 0, {root}
        while front:
            depth += 1
            front = {c for x in front for c in below.get(x, ())} - seen
            seen |= front
            out |= {(root, c): depth for c in front}
    return out


@pytest.mark.parametrize("links", [
    [(i, i // 2) for i in range(2, 60)], [(i + 1, i) for i in range(21)], [(1, 2), (2, 3), (3, 1), (4, 3), (5, 5), (6, None), (None, 1), (2, 1), (2, 1)], [(7, 7)],
])
def test_descendants_of_trees_chains_and_cycles(spark, links):
    df = spark.createDataFrame(links, "child int, parent int")
    pairs = lambda x: {(r.ancestor, r.descendant): r.depth for r in x.collect()}
    assert pairs(closure.descendants(df, "child", "parent")) == plain_closure(links)
    roots = spark.createDataFrame([(1,), (3,), (99,), (None,), (3,)], "id int")
    assert pairs(closure.descendants(df, "child", "parent", roots)) == plain_closure(links, [1, 3, 99])
