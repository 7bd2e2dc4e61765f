"""Equi-joins with typed keys, coalesced outer keys and named conflicts."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.errors import JoinError, TypeMismatch
from quillon.types import field, require_unique

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "left_semi": "left_semi", "left_anti": "left_anti"}


def join(
    left: DataFrame, right: DataFrame, keys: str | Sequence[str | tuple[str, str]], how: str = "inner", conflict: str = "suffix", left_label: str = "left", right_label: str = "right"
) -> DataFrame:
    """Left columns, then right columns without their keys; null keys never match.

    keys are names, or pairs of a left and a right name, of exactly the same types. In right and full joins the key
    is the side's that has one. Other names that both sides have are told apart by conflict: "suffix" (x_left, x_right),
    "prefix" (left_x, right_x) or "error". Spark picks the physical join from the sizes that it sees at run time.
    """
    if how not in KINDS:
        raise JoinError(f"no join {how!r}")
    pairs = [(k, k) if isinstance(k, str) else tuple(k) for k in ([keys] if isinstance(keys, str) else keys)]
    if not pairs:
        raise JoinError("a join needs a key")
    pairs = [(field(left, a).name, field(right, b).name) for a, b in pairs]
    for a, b in pairs:
        if left.schema[a].dataType != right.schema[b].dataType:
            raise TypeMismatch(f"key {a} is {left.schema[a].dataType.simpleString()}, {b} is {right.schema[b].dataType.simpleString()}")
    right_keys = {b for _, b in pairs}
    rest = [c for c in right.columns if c not in right_keys]
    both = {c.lower() for c in left.columns} & {c.lower() for c in rest}
    if both and conflict == "error":
        raise JoinError(f"both sides have {', '.join(sorted(both))}")

    def named(name: str, label: str) -> str:
        if name.lower() not in both:
            return name
        return f"{name}_{label}" if conflict == "suffix" else f"{label}_{name}"

    lhs = left.select(*(F.col(f"`{c}`").alias(f"l{i}") for i, c in enumerate(left.columns)))
    rhs = right.select(*(F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(right.columns)))
    at_left, at_right = ({c: f"{side}{i}" for i, c in enumerate(df.columns)} for side, df in (("l", left), ("r", right)))
    met = lhs.join(rhs, reduce(operator.and_, [F.col(at_left[a]) == F.col(at_right[b]) for a, b in pairs]), KINDS[how])
    of_key = dict(pairs)
    out = []
    for c in left.columns:
        value = F.col(at_left[c])
        if how in ("right", "full") and c in of_key:
            value = F.coalesce(value, F.col(at_right[of_key[c]]))
        out.append((value, named(c, left_label)))
    if how not in ("left_semi", "left_anti"):
        out += [(F.col(at_right[c]), named(c, right_label)) for c in rest]
    else:
        out = [(F.col(at_left[c]), c) for c in left.columns]
    require_unique([n for _, n in out])
    return met.select(*(c.alias(n) for c, n in out))


def inner_join(left: DataFrame, right: DataFrame, keys: str | Sequence, **options: str) -> DataFrame:
    return join(left, right, keys, "inner", **options)


def left_join(left: DataFrame, right: DataFrame, keys: str | Sequence, **options: str) -> DataFrame:
    return join(left, right, keys, "left", **options)


def right_join(left: DataFrame, right: DataFrame, keys: str | Sequence, **options: str) -> DataFrame:
    return join(left, right, keys, "right", **options)


def full_outer_join(left: DataFrame, right: DataFrame, keys: str | Sequence, **options: str) -> DataFrame:
    return join(left, right, keys, "full", **options)
