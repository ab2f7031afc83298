"""Objects of this package for executors that don't have it."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle


def packed(value: object) -> bytes:
    """``value`` as bytes for a broadcast: classes of this package travel inside (a broadcast alone would only name them)."""
    return cloudpickle.dumps(value)


def unpacked(data: bytes) -> object:
    return pickle.loads(data)
