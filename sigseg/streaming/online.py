"""Online segmentation of event streams: closed bins, then a forward filter with one small state for each sequence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sigseg.operators.hmm import HmmModel


def closed_bins(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """chrom, start, value, n: sums by tumbling window of ``ts``; a bin appears once the watermark has passed it, later events are dropped."""
    keyed = events.withWatermark("ts", late).groupBy("chrom", F.window("ts", width))
    return keyed.agg(F.sum("value").alias("value"), F.count("*").alias("n")).select("chrom", F.col("window.start").alias("start"), "value", "n")


def online_filter(bins: DataFrame, model: HmmModel) -> DataFrame:
    """chrom, bin, p (of each state given all bins up to it), for a stream of chrom, bin, obs; bins that come after a later one are skipped."""
    a, start = np.asarray(model.transition), np.asarray(model.start)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, alpha = (state.get[0], np.array(state.get[1])) if state.exists else (-1, start)
        fresh = not state.exists
        rows = pd.concat(list(batches)).sort_values("bin")
        out = []
        for b, o in zip(rows["bin"], rows["obs"], strict=True):
            if b <= last:
                continue
            moved = alpha if fresh else alpha @ a
            value = moved * model.emission.densities(np.asarray([o], float))[0]
            alpha, last, fresh = value / max(value.sum(), 1e-300), int(b), False
            out.append((key[0], last, alpha.tolist()))
        state.update((last, alpha.tolist()))
        yield pd.DataFrame(out, columns=["chrom", "bin", "p"])

    return bins.groupBy("chrom").applyInPandasWithState(run, "chrom string, bin long, p array<double>", "last long, alpha array<double>", "append", GroupStateTimeout.NoTimeout)
