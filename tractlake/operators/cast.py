"""Types of positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tractlake.errors import DTypeError
from tractlake.functions import geometry as G
from tractlake.model import FLOATS, Tractogram, dtype_of, points_type


def half(values: pd.Series) -> pd.Series:
    """Each list of numbers rounded to half precision."""
    with np.errstate(over="ignore"):
        return values.map(lambda v: np.asarray(v, dtype=np.float32).astype(np.float16).astype(np.float32))


def cast_positions(t: Tractogram, dtype: str) -> Tractogram:
    """Positions of another type. They always pass through single precision; other arrays stay."""
    dtype = dtype_of(dtype)
    if dtype not in FLOATS:
        raise DTypeError(f"positions can't be {dtype}")
    points = F.transform("points", lambda p: F.struct(*(p[a].cast("float").alias(a) for a in G.AXES)))
    if dtype == "float16":
        round_ = F.pandas_udf(half, "array<float>")
        flat = round_(F.flatten(F.transform("points", lambda p: F.array(*(p[a].cast("float") for a in G.AXES)))))
        rows = t.streamlines.withColumn("__f", flat)
        points = F.transform("points", lambda p, i: F.struct(*(F.get("__f", i * 3 + k).alias(a) for k, a in enumerate(G.AXES))))
        return t.with_(streamlines=rows.withColumn("points", points.cast(points_type(dtype))).drop("__f"), dtype=dtype)
    return t.with_(streamlines=t.streamlines.withColumn("points", points.cast(points_type(dtype))), dtype=dtype)
