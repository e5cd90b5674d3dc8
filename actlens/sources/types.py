"""Names of the store's types: what they are as Spark columns and as NumPy arrays."""

from __future__ import annotations

import numpy as np

#: Parquet and Spark have no half precision: it is kept as single precision, which holds its values exactly.
SPARK = {"float16": "float", "bfloat16": "float", "float32": "float", "int32": "int", "int64": "bigint"}
NUMPY = {"float16": np.float16, "bfloat16": np.float16, "float32": np.float32, "int32": np.int32, "int64": np.int64}


def spark_type(name: str) -> str:
    if name not in SPARK:
        raise ValueError(f"unknown type: {name}")
    return SPARK[name]


def numpy_type(name: str) -> type:
    if name not in NUMPY:
        raise ValueError(f"unknown type: {name}")
    return NUMPY[name]
