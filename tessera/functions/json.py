"""JSON operators over text columns, as Catalyst expressions.

``get`` is ->, ``get_text`` is ->>, ``path`` is #>, ``contains`` is @>, ``has_key`` is ?
and ``merge`` the shallow object merge.  A missing key or index is NULL everywhere.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _step(key: str | int) -> str:
    return f"[{key}]" if isinstance(key, int) else "['" + key.replace("'", "\\'") + "']"


def _segments(path: str) -> list[str | int]:
    """The steps of '{a,0,b}' (or '[a,0,b]'); numbers index arrays."""
    inner = path.strip()[1:-1]
    return [int(s) if re.fullmatch(r"\d+", s) else s for s in (x.strip() for x in inner.split(",")) if s]


def _raw(j: Column, json_path: str) -> Column:
    """The JSON text at a path; strings keep their quotes, JSON null is 'null'."""
    return F.to_json(F.try_variant_get(F.try_parse_json(j), json_path, "variant"))


def get(j: Column, key: str | int) -> Column:
    """j -> key: the JSON text of a member or element."""
    return _raw(j, "$" + _step(key))


def get_text(j: Column, key: str | int) -> Column:
    """j ->> key: the member as text without quotes; JSON null is NULL."""
    return F.get_json_object(j, "$" + _step(key))


def path(j: Column, segments: str) -> Column:
    """j #> '{a,b}': the JSON text at a path."""
    return _raw(j, "$" + "".join(map(_step, _segments(segments))))


def path_text(j: Column, segments: str) -> Column:
    """j #>> '{a,b}': the text at a path."""
    return F.get_json_object(j, "$" + "".join(map(_step, _segments(segments))))


def has_key(j: Column, key: str) -> Column:
    """j ? key: whether an object has the top-level key; false for anything else but NULL."""
    return F.when(j.isNotNull(), F.coalesce(F.array_contains(F.json_object_keys(j), key), F.lit(False)))


def _within(v: Column, pattern: Any) -> Column:
    """Whether the variant contains the pattern: objects by key, arrays by any element, scalars by value."""
    kind = F.schema_of_variant(v)
    if isinstance(pattern, dict):
        held = F.coalesce(kind.startswith("OBJECT"), F.lit(False))
        for k, p in pattern.items():
            held = held & F.coalesce(_within(F.try_variant_get(v, "$" + _step(k), "variant"), p), F.lit(False))
        return held
    elements = F.try_variant_get(v, "$", "array<variant>")
    if isinstance(pattern, list):
        held = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
        for p in pattern:
            held = held & _any(elements, p)
        return held
    # An array contains a scalar that is one of its elements.
    return _same(v, pattern) | _any(elements, pattern)


def _any(elements: Column, pattern: Any) -> Column:
    """Whether an element is the scalar, or contains the object or array."""
    test = _within if isinstance(pattern, (dict, list)) else _same
    return F.coalesce(F.exists(elements, lambda x: test(x, pattern)), F.lit(False))


def _same(v: Column, scalar: Any) -> Column:
    kind = F.schema_of_variant(v)
    if scalar is None:
        return F.coalesce(kind == "VOID", F.lit(False))
    if isinstance(scalar, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == scalar), F.lit(False))
    if isinstance(scalar, (int, float)):
        number = kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT")
        return F.coalesce(number & (F.try_variant_get(v, "$", "double") == float(scalar)), F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(v, "$", "string") == scalar), F.lit(False))


def contains(j: Column, pattern: str) -> Column:
    """j @> pattern for a constant pattern, compiled to path predicates; NULL for NULL, false for text that isn't JSON."""
    return F.when(j.isNotNull(), F.coalesce(_within(F.try_parse_json(j), json.loads(pattern)), F.lit(False)))


def contains_sql(j: str, pattern: str) -> str:
    """``contains`` as SQL text over an expression."""
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def same(v: str, scalar: Any) -> str:
        kind = f"schema_of_variant({v})"
        if scalar is None:
            test = f"{kind} = 'VOID'"
        elif isinstance(scalar, bool):
            test = f"{kind} = 'BOOLEAN' AND try_variant_get({v}, '$', 'boolean') = {str(scalar).lower()}"
        elif isinstance(scalar, (int, float)):
            test = f"{kind} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' AND try_variant_get({v}, '$', 'double') = {float(scalar)!r}D"
        else:
            test = f"{kind} = 'STRING' AND try_variant_get({v}, '$', 'string') = {quoted(scalar)}"
        return f"coalesce({test}, false)"

    def some(v: str, p: Any, level: int) -> str:
        test = (within if isinstance(p, (dict, list)) else lambda x, y, _: same(x, y))(f"x{level}", p, level + 1)
        return f"coalesce(exists(try_variant_get({v}, '$', 'array<variant>'), x{level} -> {test}), false)"

    def within(v: str, p: Any, level: int) -> str:
        if isinstance(p, dict):
            members = [f"coalesce({within(f'try_variant_get({v}, {quoted('$' + _step(k))}, ' + repr('variant') + ')', x, level)}, false)" for k, x in p.items()]
            return "(" + " AND ".join([f"coalesce(schema_of_variant({v}) LIKE 'OBJECT%', false)", *members]) + ")"
        if isinstance(p, list):
            return "(" + " AND ".join([f"coalesce(schema_of_variant({v}) LIKE 'ARRAY%', false)", *[some(v, x, level) for x in p]]) + ")"
        return f"({same(v, p)} OR {some(v, p, level)})"

    return f"(CASE WHEN {j} IS NOT NULL THEN coalesce({within(f'try_parse_json({j})', json.loads(pattern), 0)}, false) END)"


def _holds(a: Any, b: Any) -> bool:
    if isinstance(b, dict):
        return isinstance(a, dict) and all(k in a and _holds(a[k], x) for k, x in b.items())
    if isinstance(b, list):
        return isinstance(a, list) and all(any(_holds(y, x) for y in a) for x in b)
    if isinstance(a, list):
        return any(_holds(y, b) for y in a if not isinstance(y, list))
    return type(a) is not dict and isinstance(a, bool) == isinstance(b, bool) and a == b


def _decide(x: str | None, y: str | None) -> bool | None:
    if x is None or y is None:
        return None
    try:
        return _holds(json.loads(x), json.loads(y))
    except ValueError:
        return False


def contains_udf():
    """j @> pattern for a pattern that differs by row: Arrow batches through Python."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_decide(a, b) for a, b in zip(x, y)], dtype=object)

    return run


def contains_column(j: Column, pattern: Column) -> Column:
    """j @> pattern for a pattern in a column."""
    return contains_udf()(j, pattern)


def merge(a: Column, b: Column) -> Column:
    """a || b of JSON objects: shallow, the right side wins, members in order of their names."""
    maps = [F.from_json(x, "map<string,variant>") for x in (a, b)]
    left = F.map_filter(maps[0], lambda k, _: ~F.array_contains(F.map_keys(maps[1]), k))
    members = F.array_sort(F.concat(*[F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))) for m in (left, maps[1])]))
    spelled = F.transform(members, lambda e: F.concat(F.to_json(F.array(e["k"])).substr(F.lit(2), F.length(F.to_json(F.array(e["k"]))) - 2), F.lit(":"), e["v"]))
    return F.concat(F.lit("{"), F.array_join(spelled, ","), F.lit("}"))
