"""Dense-vector column expressions (D1-D3) over ``array<double>`` columns.

All distances are higher-order array functions evaluated inside the JVM;
squared distances are used for every comparison (the square root is monotone).
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(c) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def squared_distance(a: Column, b: Column) -> Column:
    """Reduced (squared euclidean) distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


def euclidean_distance(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(squared_distance(a, b))


def dist_to_rdist(d: Column) -> Column:
    """D3: distance -> reduced distance."""
    return d * d


def rdist_to_dist(r: Column) -> Column:
    """D3: reduced distance -> distance."""
    return F.sqrt(r)


def json_literal(value, ddl: str) -> Column:
    """A literal of any size as ONE expression node: ``from_json`` over a string
    literal, constant-folded by the optimizer into a single value.  (An
    ``array(lit, lit, ...)`` tree of thousands of nodes makes analysis slow.)"""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), ddl)


def double_array(values) -> Column:
    """``array<double>`` literal."""
    return json_literal([float(v) for v in values], "array<double>")


def string_array(values) -> Column:
    """``array<string>`` literal."""
    return json_literal([str(v) for v in values], "array<string>")


def literal_matrix(rows) -> Column:
    """A small matrix (list of float lists) as an ``array<array<double>>`` literal."""
    return json_literal([[float(v) for v in r] for r in rows], "array<array<double>>")


def nearest(vec: Column, centers: Column) -> Column:
    """Index (0-based) of the nearest center; ties go to the lowest index."""
    d = F.transform(centers, lambda c: squared_distance(vec, c))
    return (F.array_position(d, F.array_min(d)) - 1).cast("int")


def sorted_position(sorted_keys, key: Column) -> Column:
    """1-based position of ``key`` in the sorted literal list ``sorted_keys`` (0 when absent).

    A binary search written with ``aggregate``: O(log n) array reads per lookup
    against a literal array, instead of the linear key scan a literal map lookup
    does.  The search state (lo, hi) is packed into one long to keep each step
    allocation-free.  Keys must be sorted in code-point (= UTF-8 byte, Spark's)
    order.
    """
    n = len(sorted_keys)
    if n == 0:
        return F.lit(0)
    keys = string_array(sorted_keys)
    steps = max(1, int(n).bit_length() + 1)
    shift = F.lit(1 << 32)
    init = F.lit((1 << 32) + n + 1)                       # lo = 1, hi = n + 1

    def step(s, _):
        lo, hi = (s / shift).cast("long"), s % shift
        mid = ((lo + hi) / 2).cast("long")
        below = F.element_at(keys, mid.cast("int")) < key
        return F.when(lo >= hi, s).when(below, (mid + 1) * shift + hi).otherwise(lo * shift + mid)

    lo = (F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step) / shift).cast("int")
    return F.when((lo <= F.lit(n)) & (F.element_at(keys, F.least(lo, F.lit(n))) == key), lo).otherwise(F.lit(0))


#: up to this many keys a linear, codegen-friendly scan beats the interpreted search
LINEAR_LOOKUP_MAX = 4096


def key_position(sorted_keys, key: Column) -> Column:
    """1-based position of ``key`` in the sorted literal list (0 when absent):
    ``array_position`` for short lists, binary search beyond."""
    if len(sorted_keys) <= LINEAR_LOOKUP_MAX:
        return F.array_position(string_array(sorted_keys), key).cast("int")
    return sorted_position(sorted_keys, key)


def in_list_filter(array_col: str, field: str, values) -> Column:
    """``filter(array_col, x -> x.field IN (values))`` with the list written once in
    SQL: the optimizer turns a long literal IN list into a hash-set lookup."""
    items = ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)
    return F.expr(f"filter(`{array_col}`, x -> x.`{field}` IN ({items}))")
