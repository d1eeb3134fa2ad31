"""Jump consistent hashing of 64-bit keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the multiplier of the published generator (Lamping and Veach, 2014).
MULTIPLIER = np.uint64(2862933555777941757)


def jump_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each key; all keys jump together until none moves within range."""
    state = keys.astype(np.int64).view(np.uint64)
    at = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            state[live] = state[live] * MULTIPLIER + np.uint64(1)
            draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead = ((at[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            inside = ahead < buckets
            live = live[inside]
            at[live] = ahead[inside]
    return at.astype(np.int32)


def jump_hash(key: Column, buckets: int) -> Column:
    """Server of a key under jump consistent hashing. Null keys give null."""

    @F.pandas_udf("int")
    def run(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        out = pd.Series(pd.array([pd.NA] * len(keys), dtype="Int32"), index=keys.index)
        out[known] = jump_buckets(keys[known].to_numpy(np.int64), buckets)
        return out

    return run(key)
