"""Times operators over minute bars of every user at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line.

Bars are resampled from the events and written once; that is timed apart. Each operator
then reads the written bars and is run ``RUNS`` times: ``cold`` holds the first run,
``queries`` the best of the others. Operators over several symbols at a time read the minute
bars of every event type. ``tenfold`` times some operators once over ten copies of
all bars under other symbols, which shows how time follows the rows.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

RUNS = 3


def operators() -> dict:
    """Name to a function of (bars, bars with their base columns) that gives the operator's rows."""
    from tidebar.functions.windows import staged
    from tidebar.operators import balance, channels, metrics, parabolic, pipelines, preprocess, recurrences, sequences, targets, trend, volatility

    def summaries(b):
        return sequences.summaries(b, 24, 12, 6)

    return {
        "sma": lambda b, w: w.withColumns({f"sma_{n}": trend.sma("close", n) for n in (5, 20)}),
        "bollinger": lambda b, w: w.withColumns(trend.bollinger()),
        "engineered_features": lambda b, w: w.withColumns(trend.engineered()),
        "stochastic": lambda b, w: staged(w, {"k": trend.stochastic_k(14)}, {"d": trend.sma("k", 3)}),
        "mfi": lambda b, w: staged(w, trend.money_flow(), {"mfi": trend.mfi(14)}),
        "donchian": lambda b, w: w.withColumns(channels.donchian(20)),
        "adx": lambda b, w: staged(w, channels.movement(), channels.directional(14), {"adx": channels.adx(14)}),
        "obv": lambda b, w: staged(w, {"signed": volatility.signed_volume()}, {"obv": volatility.obv()}),
        "vwap": lambda b, w: w.withColumns({"vwap_20": volatility.periodic_vwap(20), "vwap": volatility.cumulative_vwap()}),
        "realized_volatility": lambda b, w: w.withColumn("realized_vol", volatility.realized_vol()),
        "ema": lambda b, w: recurrences.apply(b, recurrences.Ema(9), recurrences.Ema(21)),
        "rsi": lambda b, w: recurrences.apply(b, recurrences.Rsi(14)),
        "macd": lambda b, w: recurrences.apply(b, recurrences.Macd()),
        "atr": lambda b, w: recurrences.apply(b, recurrences.Atr(14)),
        "all_indicators": lambda b, w: recurrences.apply(
            staged(w, {**trend.bollinger(), **trend.engineered(), **channels.donchian(20), **trend.money_flow()}, {"mfi": trend.mfi(14), "vwap_20": volatility.periodic_vwap(20)}), recurrences.Rsi(14), recurrences.Atr(14), recurrences.Macd()
        ),
        "sequence_summaries": lambda b, w: summaries(b),
        "all_targets": lambda b, w: targets.all_targets(summaries(b), 24),
        "balance_to_min": lambda b, w: balance.balance_to_min(targets.volatility(summaries(b))),
        "column_stats": lambda b, w: preprocess.column_stats(b, "close"),
        "saved_statistics": lambda b, w: pipelines.apply(b, pipelines.fit(b, ["close", "volume"]), ["close", "volume"]),
        "regression": lambda b, w: metrics.regression(w, "c1", "close", "symbol"),
        "momentum": lambda b, w: staged(w, {"mom": trend.momentum("close", 10)}, {"accel": trend.acceleration("mom"), "slope": trend.slope("mom", 10)}),
        "cci": lambda b, w: w.withColumn("cci", trend.cci(20)),
        "volatility_features": lambda b, w: staged(w, {"realized_vol": volatility.realized_vol(24), "range_vol": volatility.range_vol()}, {"vol_of_vol": volatility.vol_of_vol()}),
        "consolidation": lambda b, w: staged(w, {"choppiness": volatility.choppiness(14), "efficiency": volatility.efficiency(10), **volatility.directional_moves()}, {"dm_balance": volatility.directional_balance(14)}),
        "regime": lambda b, w: w.withColumns({"place": volatility.position_in_range(20), "squeeze": volatility.squeeze_on(20), "compression": volatility.range_compression(10, 40)}),
        "sequence_zscores": lambda b, w: sequences.zscores(b, "close", 24, 12, 6),
        "parabolic": lambda b, w: parabolic.parabolic(b),
        "liquidity_driver": lambda b, w: volatility.liquidity(b),
    }


def market_operators() -> dict:
    """The same for operators that align several symbols by time."""
    from tidebar.operators import crossasset

    return {"cross_correlation": lambda b, w: crossasset.mean_correlation(b), "cross_sentiment": lambda b, w: crossasset.sentiment(b)}


TENFOLD = ("sma", "stochastic", "ema", "rsi", "macd", "atr", "all_indicators", "balance_to_min")


def main() -> None:
    from pyspark.sql import SparkSession

    from tidebar.functions.windows import with_base
    from tidebar.sources.bars import resample

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="tidebar-bench-")

    def timed(work) -> float:
        began = time.perf_counter()
        work()
        return round(time.perf_counter() - began, 3)

    try:
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        events.count()  # starts the JVM's compiler
        minutes = resample(events, "minute", "user_id").selectExpr("cast(symbol as string) as symbol", "ts", "open", "high", "low", "close", "volume")
        resampled = timed(lambda: minutes.write.parquet(f"{folder}/bars"))
        resample(events, "minute").write.parquet(f"{folder}/types")
        bars, types = spark.read.parquet(f"{folder}/bars"), spark.read.parquet(f"{folder}/types")
        rows = bars.count()
        cold, warm, tenfold = {}, {}, {}
        run = lambda make, b: timed(lambda: make(b, with_base(b)).write.format("noop").mode("overwrite").save())
        for found, b in ((operators(), bars), (market_operators(), types)):
            for name, make in found.items():
                runs = [run(make, b) for _ in range(RUNS)]
                cold[name], warm[name] = runs[0], min(runs[1:])
        bars.selectExpr("explode(sequence(0, 9)) as k", "*").selectExpr("concat(symbol, '-', k) as symbol", "ts", "open", "high", "low", "close", "volume").write.parquet(f"{folder}/more")
        more = spark.read.parquet(f"{folder}/more")
        for name in TENFOLD:
            tenfold[name] = run(operators()[name], more)
        total = round(sum(warm.values()), 3)
        print(
            json.dumps(
                {
                    "metric": "total_seconds",
                    "value": total,
                    "unit": "sec",
                    "queries": warm,
                    "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                    "rows": rows,
                    "cpus": int(cpus),
                    "resample": resampled,
                    "cold": cold,
                    "rows_per_second": {n: round(rows / s) for n, s in warm.items() if n not in market_operators()},
                    "tenfold": tenfold,
                }
            )
        )
    finally:
        spark.stop()
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
