"""Lookups of entities: by key, by module, by text, by source location (single and in bulk)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from .predicates import like_pattern


def all_modules(c: Catalog) -> DataFrame:
    return c["module"]


def module_by_name(c: Catalog, name: str) -> DataFrame:
    """One row at most: the least id."""
    return c["module"].where(F.col("name") == name).orderBy("id").limit(1)


def functions_by_module(c: Catalog, module_id: int) -> DataFrame:
    return c["function"].where(F.col("module_id") == module_id)


def function_by_name(c: Catalog, name: str, module_id: int | None = None) -> DataFrame:
    rows = c["function"].where(F.col("name") == name)
    return rows if module_id is None else rows.where(F.col("module_id") == module_id)


def children_of_module(c: Catalog, kind: str, module_name: str) -> DataFrame:
    """Types, classes, imports or instances of the modules of that name."""
    keys = c["module"].where(F.col("name") == module_name).select(F.col("id").alias("_m"))
    rows = c[kind]
    return rows.join(keys, rows["module_id"] == keys["_m"], "left_semi")


def function_details(c: Catalog, function_id: int | None = None) -> DataFrame:
    """Per function: its module, where functions, callees and callers, as sorted arrays (empty, not null)."""
    f = c["function"] if function_id is None else c["function"].where(F.col("id") == function_id)
    ids = f.select(F.col("id").alias("_id"))
    w = c["where_function"].groupBy(F.col("parent_function_id").alias("_w")).agg(F.sort_array(F.collect_list(F.struct("id", "name"))).alias("where_functions"))
    names = c["function"].select(F.col("id").alias("_other"), F.col("name").alias("_name"))

    def other(mine: str, theirs: str, alias: str) -> DataFrame:
        e = c["function_dependency"].join(ids, F.col(mine) == F.col("_id"), "left_semi").join(names, F.col(theirs) == F.col("_other"))
        return e.groupBy(F.col(mine).alias(f"_{alias}")).agg(F.sort_array(F.collect_list(F.struct(F.col("_other").alias("id"), F.col("_name").alias("name")))).alias(alias))

    m = c["module"].select(F.col("id").alias("_m"), F.col("name").alias("module"))
    calls, called = other("caller_id", "callee_id", "calls"), other("callee_id", "caller_id", "called_by")
    out = f.join(m, f["module_id"] == m["_m"], "left").join(w, F.col("id") == F.col("_w"), "left").join(calls, F.col("id") == F.col("_calls"), "left").join(called, F.col("id") == F.col("_called_by"), "left")
    pair = "array<struct<id:bigint,name:string>>"
    return out.select("id", "name", "module", *[F.coalesce(x, F.array().cast(pair)).alias(x) for x in ("where_functions", "calls", "called_by")])


def search_content(c: Catalog, part: str) -> DataFrame:
    """Functions whose text has ``part``, whatever the case (% and _ stand for themselves)."""
    return c["function"].where(F.contains(F.lower("raw_string"), F.lower(F.lit(part))))


def types_by_name(c: Catalog, name: str, path_regex: str | None = None) -> DataFrame:
    rows = c["type"].where(F.col("type_name") == name)
    return rows if path_regex is None else rows.where(F.col("src_loc").rlike(path_regex))


def find_module(c: Catalog, pattern: str) -> DataFrame:
    return c["module"].where(F.col("name").ilike(like_pattern(pattern)))


def _in_module(c: Catalog, kind: str, condition) -> DataFrame:
    rows = c[kind].alias("x")
    m = c["module"].where(condition).select(F.col("id").alias("_m"), F.col("name").alias("_module"))
    return rows.join(m, F.col("x.module_id") == F.col("_m")).select("x.*", F.col("_module").alias("in_module"))


def instances_per_module(c: Catalog, name: str) -> DataFrame:
    return _in_module(c, "instance", F.col("name") == name)


def type_in_module(c: Catalog, type_name: str, module: str) -> DataFrame:
    return _in_module(c, "type", F.col("name") == module).where(F.col("type_name") == type_name)


def function_in_module(c: Catalog, name: str, module: str) -> DataFrame:
    """The module's name is a pattern, whatever its case."""
    return _in_module(c, "function", F.col("name").ilike(like_pattern(module))).where(F.col("name") == name)


def class_in_module(c: Catalog, name: str, module: str) -> DataFrame:
    """A module is known by its name with or without .hs."""
    return _in_module(c, "class", F.col("name").isin(module, module + ".hs")).where(F.col("class_name") == name)


def function_at(c: Catalog, path: str, line: int) -> DataFrame:
    """As-of: the last function that starts at or before the line, of those whose location has the path."""
    rows = c["function"].where(F.contains(F.lower("src_loc"), F.lower(F.lit(path))) & (F.col("line_number_start") <= line))
    return rows.orderBy(F.desc("line_number_start"), "id").limit(1)


_LOCATION = {"type": "src_loc", "import": "src_loc", "class": "src_location"}


def element_at(c: Catalog, kind: str, path: str, line: int) -> DataFrame:
    """Interval: the innermost type, import or class around the line, of those whose location has the path."""
    rows = c[kind].where(F.contains(F.lower(_LOCATION[kind]), F.lower(F.lit(path))) & (F.col("line_number_start") <= line) & (F.col("line_number_end") >= line))
    return rows.orderBy(F.desc("line_number_start"), "id").limit(1)


def asof_join(probes: DataFrame, targets: DataFrame, by: str, at: str, start: str, key: str) -> DataFrame:
    """Each probe with the key of the last target of the same ``by`` whose ``start`` isn't after ``at`` (ties: greatest key);
    null if there is none. One pass: both sides are merged by (by, time), and the last target seen is carried on, so a
    busy file is sorted, never multiplied out."""
    names = probes.columns
    p = probes.select(F.col(by).alias("_by"), F.col(at).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(targets.schema[key].dataType).alias("_key"), F.struct(*names).alias("_row"))
    t = targets.where(F.col(start).isNotNull()).select(F.col(by).alias("_by"), F.col(start).alias("_t"), F.lit(0).alias("_k"), F.col(key).alias("_key"), F.lit(None).cast(p.schema["_row"].dataType).alias("_row"))
    last = F.expr("last(_key, true) over (partition by _by order by _t, _k, _key rows between unbounded preceding and current row)")
    return t.unionByName(p).withColumn("_last", last).where("_k = 1").select("_row.*", F.when(F.col("_by").isNotNull() & F.col("_t").isNotNull(), F.col("_last")).alias("target_id"))


def innermost_join(probes: DataFrame, targets: DataFrame, by: str, at: str, start: str, end: str, probe_key: str, key: str) -> DataFrame:
    """Each probe with the innermost target around it: the greatest start, then the least key; null if there is none. Lines are whole
    numbers. A target is cut into stretches of 2**k lines that begin at multiples of 2**k, two of each k at most, and of all that have a
    stretch one is kept; a line is looked up in the one stretch of each k that it lies in. So neither many targets around the same
    lines nor many probes of one line are multiplied out."""
    spans = targets.where(F.col(start) <= F.col(end)).groupBy(F.col(by).alias("_by"), F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e")).agg(F.min(key).alias("_key"))
    spans = spans.withColumn("_top", F.expr("length(bin(_e - _s + 1)) - 1"))
    cut = spans.select("_by", F.struct("_s", (-F.col("_key")).alias("_key")).alias("_best"), F.expr("explode(transform(sequence(0, _top), k -> struct(k, -shiftright(-_s, k) as l, shiftright(_e + 1, k) as r))) as _x")).where("_x.l < _x.r")
    cut = cut.select("_by", "_best", F.col("_x.k").alias("_k"), F.expr("explode(array(if(_x.l & 1 = 1, _x.l, null), if(_x.r & 1 = 1, _x.r - 1, null))) as _n")).where("_n is not null")
    best = cut.groupBy("_by", "_k", "_n").agg(F.max("_best").alias("_best"))
    lines = probes.select(F.col(by).alias("_by"), F.col(at).cast("bigint").alias("_at")).where("_by is not null and _at is not null").distinct()
    lines = lines.crossJoin(F.broadcast(spans.agg(F.max("_top").alias("_top")))).select("_by", "_at", F.explode(F.expr("sequence(0, _top)")).alias("_k")).withColumn("_n", F.expr("shiftright(_at, _k)"))
    found = lines.join(best, ["_by", "_k", "_n"]).groupBy("_by", "_at").agg((-F.max("_best")["_key"]).alias("target_id"))
    hit = probes.join(found, (probes[by] == found["_by"]) & (probes[at].cast("bigint") == found["_at"]), "left")
    return hit.select(*[probes[n] for n in probes.columns], "target_id")


def type_document(c: Catalog, name: str | None = None) -> DataFrame:
    """Types with their constructors, each with its fields, as nested arrays in the order of ids."""
    t = c["type"] if name is None else c["type"].where(F.col("type_name") == name)
    f = c["field"].groupBy("constructor_id").agg(F.sort_array(F.collect_list(F.struct("id", "field_name", "field_type_raw"))).alias("fields"))
    k = c["constructor"].join(f, F.col("id") == F.col("constructor_id"), "left")
    k = k.groupBy("type_id").agg(F.sort_array(F.collect_list(F.struct("id", "name", "fields"))).alias("constructors"))
    return t.join(k, t["id"] == k["type_id"], "left").drop("type_id")
