"""Closed-form weights, the same in Spark SQL, DuckDB and NumPy: no files, no random numbers."""

from __future__ import annotations

import numpy as np


def weight(salt: int, out: int, into: int) -> np.ndarray:
    """Matrix [out, into] of ((31 o + 17 i + 101 salt) mod 97 - 48) / 480."""
    o, i = np.arange(out)[:, None], np.arange(into)[None, :]
    return ((o * 31 + i * 17 + salt * 101) % 97 - 48) / 480.0


def weight_sql(salt: int, o: str, i: str) -> str:
    return f"((({o}) * 31 + ({i}) * 17 + {salt * 101}) % 97 - 48) / CAST(480.0 AS DOUBLE)"


def vector(salt: int, n: int) -> np.ndarray:
    return weight(salt, 1, n)[0]


def gamma(salt: int, n: int) -> np.ndarray:
    return 1.0 + vector(salt, n)


def embedding(ids: np.ndarray, width: int) -> np.ndarray:
    """Rows of the token table: ((37 id + 11 j + 7 ((id j) mod 13)) mod 101 - 50) / 50."""
    i, j = np.asarray(ids, dtype=np.int64)[:, None], np.arange(width)[None, :]
    return ((i * 37 + j * 11 + (i * j) % 13 * 7) % 101 - 50) / 50.0


def embedding_sql(i: str, j: str) -> str:
    return f"((({i}) * 37 + ({j}) * 11 + ((({i}) * ({j})) % 13) * 7) % 101 - 50) / CAST(50.0 AS DOUBLE)"
