"""Column expressions built once per Spark application.

An expression over column names does not depend on a DataFrame. The large ones take
seconds to put together from Python, which a stream would pay per micro-batch.
"""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession


def per_application(build):
    cache: dict = {}

    @functools.wraps(build)
    def cached(*args):
        app = SparkSession.active().sparkContext.applicationId
        key = (app, *args)
        if key not in cache:
            for old in [k for k in cache if k[0] != app]:
                del cache[old]
            cache[key] = build(*args)
        return cache[key]

    return cached
