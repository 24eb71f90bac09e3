"""Sample rates: polyphase filtering of streams, block by block."""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The filter goes to executors with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Coefficients are whole numbers over 2**SCALE, so sums are exact and the same in any order.
SCALE = 15


def phases(up: int, down: int, taps: int = 16) -> list[list[int]]:
    """For each of the `up` places between two samples the weights of the `taps` samples around it: a sinc under a Hann window, cut off at the lower rate.

    The weights of a phase add up to 2**SCALE; what rounding leaves goes to the largest.
    """
    if taps % 2 or taps < 2:
        raise ValueError("an even number of taps")
    cutoff = min(1.0, up / down)
    out = []
    for p in range(up):
        x = [k - taps // 2 + 1 - p / up for k in range(taps)]
        w = [(math.sin(math.pi * cutoff * v) / (math.pi * v) if v else cutoff) * (0.5 + 0.5 * math.cos(math.pi * v / (taps / 2))) for v in x]
        whole = [round(v / sum(w) * (1 << SCALE)) for v in w]
        whole[max(range(taps), key=lambda k: whole[k])] += (1 << SCALE) - sum(whole)
        out.append(whole)
    return out


def _pairs(words: np.ndarray) -> np.ndarray:
    """(2, n) signed samples of unsigned stereo words."""
    return words.astype("<u4").view("<i2").reshape(-1, 2).T.astype(np.int64)


def resample(samples: DataFrame, up: int, down: int, taps: int = 16, key: str = "stream_index", block: int = 65536) -> DataFrame:
    """(key, j, s): streams of stereo words at up / down times their rate, n samples becoming ceil(n * up / down).

    Sample m lies at m * down / up of the old ones (counted from 0) and is the rounded, clipped sum of the `taps` old samples around that place; beyond a stream's ends is silence. Blocks of
    positions also get taps / 2 samples of both neighbours, so a stream of any length is spread over tasks, and blocks change no result. Positions run from 1
    without gaps; a gap or a null sample fails the query.
    """
    common = math.gcd(up, down)
    up, down = up // common, down // common
    table = np.array(phases(up, down, taps), np.int64)
    half = taps // 2
    block = max(block, taps)
    at = F.col("j").cast("long") - 1
    own, place = F.call_function("div", at, F.lit(block)), at % block
    copies = F.filter(F.array(F.when(place < half, own - 1), own, F.when(place >= block - half, own + 1)), lambda b: b >= 0)
    rows = samples.select(key, at.alias("at"), F.col("s").cast("long").alias("s"), F.explode(copies).alias("block"))

    def filtered(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("at")
        b, places = int(group["block"].iloc[0]), group["at"].to_numpy()
        if group["s"].isna().any() or (np.diff(places) != 1).any() or places[0] != max(0, b * block - half):
            raise ValueError(f"stream {group[key].iloc[0]}: positions with a gap, twice there, or without a sample")
        last = min(int(places[-1]) + 1, (b + 1) * block)
        first_out, end_out = -(-b * block * up // down), -(-last * up // down)
        if last <= b * block:  # only the neighbour's samples
            end_out = first_out
        m = np.arange(first_out, end_out) * down
        wide = np.zeros((2, len(places) + 2 * taps), np.int64)
        wide[:, taps : taps + len(places)] = _pairs(group["s"].to_numpy(np.int64))
        start = m // up - half + 1 - int(places[0]) + taps
        total = np.zeros((2, len(m)), np.int64)
        for k in range(taps):
            total += wide[:, start + k] * table[m % up, k]
        out = np.clip(total + (1 << SCALE - 1) >> SCALE, -32768, 32767) & 0xFFFF
        return pd.DataFrame({key: [group[key].iloc[0]] * len(m), "j": np.arange(first_out, end_out) + 1, "s": out[0] | out[1] << 16})

    kind = samples.schema[key].dataType.simpleString()
    return rows.groupBy(key, "block").applyInPandas(filtered, f"{key} {kind}, j long, s long")
