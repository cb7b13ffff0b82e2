"""Aggregations over the call graph and patterns of calls, types and nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from .predicates import like_pattern


def most_called(c: Catalog, limit: int = 10) -> DataFrame:
    """The functions with most callers. Counted before the join, so only the counts meet the functions."""
    n = c["function_dependency"].groupBy("callee_id").agg(F.count("*").alias("calls"))
    f, m = c["function"].select("id", "name", "module_id"), c["module"].select(F.col("id").alias("_m"), F.col("name").alias("_module"))
    out = n.join(f, n["callee_id"] == f["id"]).join(m, F.col("module_id") == F.col("_m"), "left")
    return out.select("id", "name", F.coalesce("_module", F.lit("")).alias("module"), "calls").orderBy(F.desc("calls"), "id").limit(limit)


def outgoing_calls(c: Catalog, limit: int = 20) -> DataFrame:
    n = c["function_dependency"].groupBy("caller_id").agg(F.count("*").alias("calls"))
    f = c["function"].select("id", "name")
    return n.join(f, n["caller_id"] == f["id"]).select("id", "name", "calls").orderBy(F.desc("calls"), "id").limit(limit)


def _ends(c: Catalog) -> tuple[DataFrame, DataFrame]:
    f = c["function"].select("id", "name", "module_id")
    return tuple(f.select(F.col("id").alias(f"{x}_id"), F.col("name").alias(x), F.col("module_id").alias(f"{x}_module_id")) for x in ("caller", "callee"))


def call_pairs(c: Catalog, caller: str = "", callee: str = "") -> DataFrame:
    """Calls whose ends have these parts in their names, whatever the case."""
    a, b = _ends(c)
    a = a.where(F.contains(F.lower("caller"), F.lit(caller.lower())))
    b = b.where(F.contains(F.lower("callee"), F.lit(callee.lower())))
    m = c["module"].select(F.col("id").alias("_i"), F.col("name").alias("_n"))
    out = c["function_dependency"].join(a, "caller_id").join(b, "callee_id")
    for x in ("caller", "callee"):
        out = out.join(m.select(F.col("_i").alias(f"{x}_module_id"), F.col("_n").alias(f"{x}_module")), f"{x}_module_id", "left")
    return out.select("caller_id", "caller", "caller_module", "callee_id", "callee", "callee_module")


def type_usage(c: Catalog, name: str) -> DataFrame:
    """Functions with the name in their signature or text, and where."""
    has = lambda col: F.coalesce(F.contains(F.lower(col), F.lit(name.lower())), F.lit(False))
    f = c["function"].withColumn("in_signature", has("function_signature")).withColumn("in_code", has("raw_string"))
    return f.where("in_signature or in_code").select("id", "name", "in_signature", "in_code")


def nested_functions(c: Catalog) -> DataFrame:
    """Functions that have where functions, with these in the order of ids."""
    w = c["where_function"].groupBy("parent_function_id").agg(F.count("*").alias("n_nested"), F.sort_array(F.collect_list(F.struct("id", "name"))).alias("nested"))
    f = c["function"].select("id", "name")
    return f.join(w, f["id"] == w["parent_function_id"]).select("id", "name", "n_nested", "nested")


def pattern_match(c: Catalog, pattern: dict) -> DataFrame:
    """{"type": "function_call" | "type_usage" | "code_structure", ...}; another type is an error. Forms that the
    language names but doesn't define (usage elsewhere than in functions, other structures) have no rows."""
    kind = pattern.get("type", "function")
    if kind == "function_call":
        return call_pairs(c, pattern.get("caller", ""), pattern.get("callee", ""))
    if kind == "type_usage":
        out = type_usage(c, pattern.get("type_name", ""))
        return out if pattern.get("usage_in", "function") == "function" else out.limit(0)
    if kind == "code_structure":
        out = nested_functions(c)
        return out if pattern.get("structure_type", "nested_function") == "nested_function" else out.limit(0)
    raise ValueError(f"unknown pattern type {kind!r}")


def cross_module_dependencies(c: Catalog) -> DataFrame:
    """Calls between different modules. Calls are counted by the modules' ids before the names are met."""
    a, b = _ends(c)
    n = c["function_dependency"].join(a.drop("caller"), "caller_id").join(b.drop("callee"), "callee_id").where("caller_module_id <> callee_module_id")
    n = n.groupBy("caller_module_id", "callee_module_id").agg(F.count("*").alias("calls"))
    m = c["module"].select(F.col("id").alias("_i"), F.col("name").alias("_n"))
    for x in ("caller", "callee"):
        n = n.join(m.select(F.col("_i").alias(f"{x}_module_id"), F.col("_n").alias(f"{x}_module")), f"{x}_module_id")
    return n.select("caller_module_id", "caller_module", "callee_module_id", "callee_module", "calls")


def module_coupling(c: Catalog) -> DataFrame:
    """Incoming, outgoing and total calls over module borders for every module, also those without any."""
    x = cross_module_dependencies(c)
    sides = x.select(F.col("callee_module_id").alias("_m"), F.col("calls").alias("i"), F.lit(0).cast("bigint").alias("o")).union(x.select("caller_module_id", F.lit(0).cast("bigint"), "calls"))
    n = sides.groupBy("_m").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    m = c["module"].select("id", "name").join(n, F.col("id") == F.col("_m"), "left")
    i, o = F.coalesce("i", F.lit(0)).cast("bigint"), F.coalesce("o", F.lit(0)).cast("bigint")
    return m.select("id", "name", i.alias("incoming"), o.alias("outgoing"), (i + o).alias("total")).orderBy(F.desc("total"), "id")


def line_counts(c: Catalog, limit: int = 20) -> DataFrame:
    f = c["function"].withColumn("n_lines", F.col("line_number_end") - F.col("line_number_start") + 1)
    return f.select("id", "name", "n_lines").orderBy(F.desc("n_lines"), "id").limit(limit)


def entity_stats(c: Catalog) -> DataFrame:
    kinds = ("module", "function", "where_function", "type", "class", "instance", "import")
    parts = [c[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("entity"), "n") for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def busy_functions(c: Catalog, least: int = 2) -> DataFrame:
    """Functions with ``least`` callees or more, left-joined and filtered by HAVING."""
    f, m, e = c["function"], c["module"].select(F.col("id").alias("_m"), F.col("name").alias("module")), c["function_dependency"]
    out = f.join(m, f["module_id"] == m["_m"]).join(e, f["id"] == e["caller_id"], "left")
    return out.groupBy("id", "name", "module").agg(F.count("callee_id").alias("n_calls")).where(F.col("n_calls") >= least)
