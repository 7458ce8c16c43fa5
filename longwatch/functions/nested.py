"""Rewriting of values at any depth of a nested column, by walking its type."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What becomes of a field: its new column, None to leave it and look inside, or DROP. It gets the names down to the field, the column, its type and its siblings' struct.
Rule = Callable[[tuple[str, ...], Column, T.DataType, Column], "Column | None | str"]
DROP = "drop"


def rewritten(value: Column, kind: T.DataType, rule: Rule, path: tuple[str, ...] = ()) -> Column:
    """A value with its fields rewritten; nulls stay null, elements of arrays and values of maps are looked into."""
    if isinstance(kind, T.StructType):
        fields = []
        for f in kind.fields:
            own = value.getField(f.name)
            new = rule((*path, f.name), own, f.dataType, value)
            if isinstance(new, str):
                continue
            fields.append((rewritten(own, f.dataType, rule, (*path, f.name)) if new is None else new).alias(f.name))
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType) and _nested(kind.elementType):
        return F.transform(value, lambda x: rewritten(x, kind.elementType, rule, path))
    if isinstance(kind, T.MapType) and _nested(kind.valueType):
        return F.transform_values(value, lambda _, x: rewritten(x, kind.valueType, rule, path))
    return value


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
