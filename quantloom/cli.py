"""Command line: backtest, portfolio, walk-forward, batch, validate, report.

python -m quantloom.cli backtest --lake PATH --strategy sma_pullback --symbols ES,NQ --timeframe 1h --out PATH
"""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from .session import build_session
from .settings import RunSettings


def _params(text: str | None) -> dict:
    return json.loads(text) if text else {}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--lake", required=True)
    common.add_argument("--timeframe", default="1h")
    common.add_argument("--start")
    common.add_argument("--end")
    for name in ("backtest", "wfo", "batch", "validate"):
        s = sub.add_parser(name, parents=[common])
        s.add_argument("--symbols", default="")
        s.add_argument("--out")
        if name != "validate":
            s.add_argument("--strategy", required=True, help="an id; several, with commas, for batch")
            s.add_argument("--params", help="JSON")
        if name == "wfo":
            s.add_argument("--folds", type=int, default=5)
            s.add_argument("--trials", type=int, default=20)
    s = sub.add_parser("portfolio", parents=[common])
    s.add_argument("--config", required=True, help="JSON: target_vol, rebalance, slots of id, strategy, symbols, weight, params")
    s.add_argument("--out", required=True)
    s = sub.add_parser("report")
    s.add_argument("--bundle", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = build_session()
    from .operators import metrics, quality, search
    from .plans import endpoints
    from .simulation import portfolio, runs
    from .sources import bundles
    from .sources.lake import Lake

    if a.command == "report":
        b = bundles.load(spark, a.bundle)
        b["trades"] = b["trades"].withColumnRenamed("symbol", "strategy") if "strategy" not in b["trades"].columns else b["trades"]
        print(endpoints.text_report(b))
        return 0
    lake = Lake(spark, a.lake)
    s = replace(RunSettings.from_env(), timeframe=a.timeframe)
    if a.command == "portfolio":
        text = "".join(r[0] for r in spark.read.text(a.config).collect())
        c = json.loads(text)
        slots = [portfolio.Slot(str(x.get("id", i)), x["strategy"], tuple(x["symbols"]), x["weight"], x.get("timeframe", a.timeframe), x.get("duty_cycle", 1.0), x.get("params", {})) for i, x in enumerate(c["slots"])]
        known = {k: c[k] for k in ("target_vol", "vol_lookback", "max_expansion", "max_contracts", "rebalance") if k in c}
        symbols, frames = sorted({x for sl in slots for x in sl.symbols}), sorted({sl.timeframe for sl in slots})
        out = runs.simulate_portfolio(lake.load(symbols, frames, a.start, a.end), slots, portfolio.PortfolioSettings(s, **known)).cache()
        stats = metrics.curve_metrics(runs.history(out), ["run_id"], s.risk_free_rate).first().asDict()
        tables = {"history": runs.history(out), "trades": runs.trades(out), "exposure": runs.exposure(out), "slot_pnl": runs.slot_pnl(out)}
        facts = {"slots": {sl.id: sl.strategy for sl in slots}, "slot_weights": {sl.id: sl.weight for sl in slots}, "config": c, "slot_count": len(slots), "initial_capital": s.initial_capital}
        print(json.dumps(bundles.strict(bundles.save(spark, a.out, "portfolio", tables, stats, facts)), default=str))
        return 0
    symbols = [x for x in a.symbols.split(",") if x]
    bars = lake.load(symbols, a.timeframe, a.start, a.end) if symbols else lake.bars().where(f"timeframe = '{a.timeframe}'")
    if a.command == "validate":
        v = quality.validate(bars)
        print(quality.report(v))
        return int(v.where("not is_valid").limit(1).count() > 0)
    s = s.with_params(**_params(a.params))
    if a.command == "batch":
        t = search.run_batch(bars, a.strategy.split(","), s)
        if a.out:
            t.coalesce(1).write.mode("overwrite").option("header", True).csv(a.out)
        t.orderBy("strategy", "symbol").show(200, truncate=False)
        return 0
    if a.command == "wfo":
        r = search.walk_forward(bars.drop("timeframe", "average", "contract"), a.strategy, s, a.folds, 0.10, a.trials)
        print(json.dumps(bundles.strict({"verdict": r["verdict"], "notes": r["notes"], "candidate": r["candidate"], "folds": [vars(f) for f in r["folds"]]}), indent=2))
        return int(r["verdict"] == "FAIL")
    out = runs.simulate(bars, a.strategy, s).cache()
    stats = metrics.curve_metrics(runs.history(out), ["symbol"], s.risk_free_rate).join(metrics.trade_stats(runs.trades(out), ["symbol"]).withColumnRenamed("t_stat", "trade_t_stat"), "symbol", "left")
    stats.show(200, truncate=False)
    if a.out:
        bundles.save(spark, a.out, "single", {"history": runs.history(out), "trades": runs.trades(out)}, {r.symbol: r.asDict() for r in stats.collect()})
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
