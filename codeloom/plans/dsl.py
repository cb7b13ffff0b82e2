"""The JSON query language, compiled into one lazy plan of filters and semi joins."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..operators.predicates import where_all
from ..schema import RELATIONS

ENTITIES = ("module", "function", "where_function", "import", "type", "constructor", "field", "class", "instance", "function_called", "instance_function")
#: Joins whose result is the child: its table and how it hangs on the parent.
_CALLERS = ("calling_function", "called_by")
_CALLEES = ("called_function",)


@dataclass
class QueryNode:
    type_name: str
    conditions: list[dict] = field(default_factory=list)
    children: list["QueryNode"] = field(default_factory=list)


def parse(query: dict) -> QueryNode:
    """{"type", "conditions", "joins": [{"type", ...}]} -> nodes; the type is "function" if absent."""
    return QueryNode(query.get("type", "function"), list(query.get("conditions") or []), [parse(j) for j in query.get("joins") or []])


def _semi(left: DataFrame, left_key: str, right: DataFrame, right_key: str) -> DataFrame:
    keys = right.select(F.col(right_key).alias("_key"))
    return left.join(keys, left[left_key] == keys["_key"], "left_semi")


def _entity(catalog: Catalog, node: QueryNode, strict: bool, wildcards: bool) -> DataFrame:
    return where_all(catalog[node.type_name], node.conditions, strict, wildcards)


def _join(catalog: Catalog, rows: DataFrame, parent: str, child: QueryNode, strict: bool, wildcards: bool) -> tuple[DataFrame, str]:
    edges = catalog["function_dependency"]
    if parent == "function" and child.type_name in _CALLERS + _CALLEES:
        mine, theirs = ("callee_id", "caller_id") if child.type_name in _CALLERS else ("caller_id", "callee_id")
        others = where_all(catalog["function"], child.conditions, strict, wildcards)
        if child.type_name in _CALLERS:  # the callers are the result
            found = _semi(others, "id", _semi(edges, mine, rows, "id"), theirs)
            return _joins(catalog, found, "function", child.children, strict, wildcards)
        others, _ = _joins(catalog, others, "function", child.children, strict, wildcards)
        return _semi(rows, "id", _semi(edges, theirs, others, "id"), mine), "function"
    if (parent, child.type_name) not in RELATIONS:
        if strict:
            raise ValueError(f"no relation from {parent} to {child.type_name}")
        return rows, parent
    left, right = RELATIONS[parent, child.type_name]
    if (parent, child.type_name) == ("module", "function"):  # the functions are the result
        found = _semi(_entity(catalog, child, strict, wildcards), right, rows, left)
        return _joins(catalog, found, "function", child.children, strict, wildcards)
    kids, kind = _joins(catalog, _entity(catalog, child, strict, wildcards), child.type_name, child.children, strict, wildcards)
    if kind != child.type_name:
        raise ValueError(f"below {child.type_name} a join may not change the result to {kind}")
    return _semi(rows, left, kids, right), parent


def _joins(catalog: Catalog, rows: DataFrame, kind: str, children: list[QueryNode], strict: bool, wildcards: bool) -> tuple[DataFrame, str]:
    switched = False
    for child in children:
        if switched:
            raise ValueError("a join that changes the result's type must be the last of its siblings")
        before = kind
        rows, kind = _join(catalog, rows, kind, child, strict, wildcards)
        switched = kind != before or (before == "function" and child.type_name in _CALLERS)
    return rows, kind


def execute(catalog: Catalog, query: dict, strict: bool = True, wildcards: bool = False) -> DataFrame:
    """Rows of the query's entity (of the functions, for module -> function; of the callers, for calling_function),
    each once. strict: unknown types of joins, columns and operators are errors, else they are passed over."""
    node = parse(query)
    if node.type_name not in ENTITIES:
        raise ValueError(f"unknown entity {node.type_name!r}")
    rows = _entity(catalog, node, strict, wildcards)
    return _joins(catalog, rows, node.type_name, node.children, strict, wildcards)[0]
