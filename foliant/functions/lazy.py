"""Vectorised functions that are made when they are called: a module can be imported before there is a session."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def vectorised(kind: str):
    def make(f):
        @wraps(f)
        def call(*cols) -> Column:
            return F.pandas_udf(f, kind)(*cols)

        return call

    return make
