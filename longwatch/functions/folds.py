"""Folds over an array that gather values on the way, without copying what was gathered at each step, and values that are worked out once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that are held apart before they are put behind the others at once.
_SOME = 64


def gathered(items: Column, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column, Column]], kind: str) -> Column:
    """An array of the values that a fold over items gathers, in order.

    state: names and first values of what is carried along. step(a, x) gives
    the next state, whether a value is gathered here, and the value, of the type
    kind. Gathered values are kept in pieces: appending one copies a piece of 64
    at most, and pieces are put together once.
    """
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    first = F.struct(*[v.alias(k) for k, v in state.items()], none.alias("_some"), nothing.alias("_done"))

    def run(a: Column, x: Column) -> Column:
        new, keep, value = step(a, x)
        longer = F.concat(a["_some"], F.array(value))
        full = F.size(a["_some"]) >= _SOME - 1
        some = F.when(~keep, a["_some"]).when(full, none).otherwise(longer)
        done = F.when(keep & full, F.concat(a["_done"], F.array(longer))).otherwise(a["_done"])
        return F.struct(*[new[k].alias(k) for k in state], some.alias("_some"), done.alias("_done"))

    return F.aggregate(items, first, run, lambda a: F.concat(F.flatten(a["_done"]), a["_some"]))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once, however often it is used; a column named twice is worked out twice."""
    return F.get(F.transform(F.array(value), use), 0)
