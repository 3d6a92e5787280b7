"""Memoisation of large Column expression trees.

Building a feature expression from Python costs one JVM call per node, and
the URL / content / score expressions have thousands of nodes (literal
dictionaries).  Columns are unresolved expressions, valid for any DataFrame
in the same JVM, so builders whose arguments are plain hashable values are
cached per JVM.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def _jvm_key():
    sc = SparkContext._active_spark_context
    return id(sc._jvm) if sc is not None else None


def jvm_memo(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        key = (_jvm_key(), args, tuple(sorted(kwargs.items())))
        try:
            hash(key)
        except TypeError:
            return fn(*args, **kwargs)
        if key not in cache:
            cache[key] = fn(*args, **kwargs)
        return cache[key]

    wrapper.cache = cache
    return wrapper


def freeze(value):
    """Hashable form of dictionaries / lists used as parameters."""
    if isinstance(value, dict):
        return tuple(sorted((k, freeze(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple, set, frozenset)):
        return tuple(freeze(v) for v in value)
    return value
