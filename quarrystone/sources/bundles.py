"""NPZ feature bundles: a checked decode into window rows."""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DIMENSIONS = {"dino": 384, "videomae": 384, "beats": 768, "egemaps": 88}
WINDOW_ROWS = "bundle_id string, window int, modality string, vector array<float>, valid array<boolean>"


def encode(vectors: dict[str, np.ndarray], valid: dict[str, np.ndarray]) -> tuple[bytes, str]:
    out = io.BytesIO()
    np.savez_compressed(out, **vectors, **{f"{k}_valid": v for k, v in valid.items()})
    return out.getvalue(), hashlib.sha256(out.getvalue()).hexdigest()


def decode(bundles: DataFrame) -> DataFrame:
    """bundles: bundle_id, payload, sha256 -> one row per (window, modality). A wrong digest, member or shape, or a
    value other than 0 where masked out, fails the row's task."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = []
            for b, payload, digest in zip(df["bundle_id"], df["payload"], df["sha256"], strict=True):
                if hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"{b}: digest differs")
                with np.load(io.BytesIO(payload), allow_pickle=False) as z:
                    if set(z.files) != {*DIMENSIONS, *(f"{k}_valid" for k in DIMENSIONS)}:
                        raise ValueError(f"{b}: unexpected members")
                    n = len(z["dino"])
                    for k, d in DIMENSIONS.items():
                        v, m = z[k], z[f"{k}_valid"]
                        if v.shape != (n, d) or m.shape != (n, d) or (v[~m] != 0).any() or not np.isfinite(v).all():
                            raise ValueError(f"{b}: bad {k}")
                        out += [(b, i, k, v[i].astype(np.float32), m[i]) for i in range(n)]
            yield pd.DataFrame(out, columns=["bundle_id", "window", "modality", "vector", "valid"])

    return bundles.select("bundle_id", "payload", "sha256").mapInPandas(rows, WINDOW_ROWS)
