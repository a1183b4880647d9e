"""The metadata filter language, compiled to a Column.

Quirks that callers rely on: an empty filter is true; ``in`` with an empty list is
false; equality with null never holds; any operator of a node but AND (also NOT)
joins its conditions with OR; empty or malformed conditions are true.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the fields that a filter may name.
FIELDS = ("source_kind", "source_path", "chunk_index", "section_id", "section_title")


def _in(column: Column, value) -> Column:
    if not isinstance(value, (list, tuple)):
        raise ValueError("in needs a list")
    return column.isin(*value) if value else F.lit(False)


#: What a leaf's operator does with its column and value.
LEAVES: dict[str, Callable[[Column, object], Column]] = {"==": lambda column, value: column == F.lit(value), "in": _in}


def _leaf(node: dict, fields: tuple[str, ...]) -> Column:
    name, test = str(node["field"]).removeprefix("meta."), LEAVES.get(node.get("operator"))
    if name not in fields or test is None:
        raise ValueError(f"unknown field or operator: {name} {node.get('operator')}")
    return test(F.col(name), node.get("value"))


def compiled(node: dict | None, fields: tuple[str, ...] = FIELDS) -> Column:
    parts = node.get("conditions") if node else None
    if node and "field" in node:
        return _leaf(node, fields)
    if not (parts and isinstance(parts, (list, tuple))):
        return F.lit(True)
    join = and_ if str(node.get("operator", "AND")).upper() == "AND" else or_
    return reduce(join, (compiled(p, fields) for p in parts))


def equal(field: str, value) -> dict:
    return {"field": field, "operator": "==", "value": value}


def both(*conditions: dict | None) -> dict:
    return {"operator": "AND", "conditions": [c for c in conditions if c]}


def section_filter(source_path: str, section_id: str) -> dict:
    return both(equal("source_path", source_path), equal("section_id", section_id))


def chunk_filter(source_path: str, indexes) -> dict:
    return both(equal("source_path", source_path), {"field": "chunk_index", "operator": "in", "value": sorted(set(indexes))})


def scope(base: dict | None, source_path: str | None, section_id: str | None, section_title: str | None) -> tuple[dict, str]:
    """Base conditions plus a resolved file and a section; an id wins over a title.

    Without a resolved file a title is ignored and everything is searched.
    """
    parts, label = [base], "all files"
    if source_path:
        parts.append(equal("source_path", source_path))
        label = source_path
    if section_id:
        parts.append(equal("section_id", section_id))
        label += f" / {section_id}"
    elif section_title and source_path:
        parts.append(equal("section_title", section_title))
        label += f" / {section_title}"
    return both(*parts), label
