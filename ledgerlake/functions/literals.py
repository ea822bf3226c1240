"""Large literal maps / arrays as ONE SQL expression.

Building a 131-entry map with ``F.create_map(F.lit(..), ...)`` costs one Python→JVM call per
literal (hundreds per map, per use); ``F.expr`` of the same text is a single call parsed in
the JVM. The resulting expressions are identical literals, constant-folded by Catalyst.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    s = str(v).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{s}'"


def array_of(values) -> Column:
    return F.expr("array(" + ", ".join(sql_literal(v) for v in values) + ")")


def map_of(pairs) -> Column:
    return F.expr("map(" + ", ".join(f"{sql_literal(k)}, {sql_literal(v)}" for k, v in pairs) + ")")


def map_of_structs(rows, fields) -> Column:
    """MAP<row[0], STRUCT<fields = row[1:]>>."""
    items = []
    for r in rows:
        st = ", ".join(f"'{n}', {sql_literal(v)}" for n, v in zip(fields, r[1:]))
        items.append(f"{sql_literal(r[0])}, named_struct({st})")
    return F.expr("map(" + ", ".join(items) + ")")


def array_of_structs(rows, fields) -> Column:
    items = [", ".join(f"'{n}', {sql_literal(v)}" for n, v in zip(fields, r)) for r in rows]
    return F.expr("array(" + ", ".join(f"named_struct({x})" for x in items) + ")")
