"""Extensions: vital signs as they arrive. The batch operators stay the reference for results."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.normalize import first_number
from ..operators.readings import TOTALS, item_key


def arriving(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """sid, item, ts, v of a stream of raw rows (sid, ts, item_raw, value_raw), with a watermark on ts."""
    x = stream.select("sid", F.col("ts").cast("timestamp").alias("ts"), item_key(F.col("item_raw")).alias("item"), first_number(F.col("value_raw")).alias("v"))
    x = x.where("sid <> -1 and ts is not null and v is not null").where((F.col("v") != 0) | F.col("item").isin(*TOTALS))
    return x.withWatermark("ts", late)


def windowed(readings: DataFrame, width: str = "15 minutes", slide: str = "5 minutes") -> DataFrame:
    """Per source and sliding window: n, mean, lo, hi. Emitted once the watermark has passed the window."""
    return readings.groupBy(F.window("ts", width, slide).alias("w"), "sid", "item").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi")).select("sid", "item", F.col("w.start").alias("start"), "n", "mean", "lo", "hi")


def stuck_alerts(readings: DataFrame, least: int = 10) -> DataFrame:
    """sid, item, v, n whenever a source has sent the same number `least` times in a row. The state is one number and a count."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        out = []
        for b in batches:
            for v in b.sort_values("ts")["v"]:
                n = n + 1 if v == last else 1
                last = v
                if n == least:
                    out.append((key[0], key[1], float(v), n))
        state.update((last, n))
        yield pd.DataFrame(out, columns=["sid", "item", "v", "n"])

    return readings.groupBy("sid", "item").applyInPandasWithState(run, "sid long, item string, v double, n int", "last double, n int", "append", "NoTimeout")
