"""Name a value inside one Column expression."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used.

    Inside array lambdas Spark does not share repeated subexpressions, and deep
    expressions that repeat their input grow exponentially; a one-element
    transform binds the value instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reusable(build: Callable) -> Callable:
    """Build a large expression over fixed column names once per Spark context.

    Columns are immutable, and describing one of a few hundred nodes to the JVM
    takes far longer than planning it.
    """
    built: dict = {}

    @wraps(build)
    def lookup(*names):
        context = SparkContext._active_spark_context
        key = (id(context), context.applicationId if context else None, names)
        if key not in built:
            built[key] = build(*names)
        return built[key]

    return lookup
