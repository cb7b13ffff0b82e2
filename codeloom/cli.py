"""Command line: ``python -m codeloom.cli ingest DUMPS OUT``, ``query OUT NAME ..``, ``graph OUT DIR``, ``gexf OUT FILE``, ``sql OUT TEXT``, ``create OUT``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog
from .operators import aggregates, graphs, lookups
from .plans import dsl
from .sources import export, resolve


def _functions(c: Catalog, name: str, module: str | None) -> DataFrame:
    rows = c["function"].where(F.col("name") == name)
    return rows if module is None else lookups._in_module(c, "function", F.col("name") == module).where(F.col("x.name") == name)


def module(c: Catalog, a: argparse.Namespace) -> DataFrame:
    """What the module holds, a row for each element."""
    parts = [c["function"].select(F.lit("function").alias("kind"), "id", "name", "module_id")]
    for kind, name in (("type", "type_name"), ("class", "class_name"), ("instance", "instance_signature"), ("import", "module_name")):
        parts.append(c[kind].select(F.lit(kind).alias("kind"), "id", F.col(name).alias("name"), "module_id"))
    rows = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])
    keys = c["module"].where(F.col("name") == a.name).select(F.col("id").alias("_m"))
    return rows.join(keys, F.col("module_id") == F.col("_m"), "left_semi").select("kind", "id", "name").orderBy("kind", "id")


def function(c: Catalog, a: argparse.Namespace) -> DataFrame:
    """The details of the functions of this name: module, nested functions, calls and callers."""
    ids = _functions(c, a.name, a.module).select(F.col("id").alias("_i"))
    return lookups.function_details(c).join(ids, F.col("id") == F.col("_i"), "left_semi")


def type_(c: Catalog, a: argparse.Namespace) -> DataFrame:
    rows = lookups.type_document(c, a.name)
    return rows if a.module is None else rows.join(c["module"].where(F.col("name") == a.module).select(F.col("id").alias("_m")), F.col("module_id") == F.col("_m"), "left_semi")


def call_graph(c: Catalog, a: argparse.Namespace) -> DataFrame:
    """The calls within the depth of the function of this name in this module, with names."""
    steps = graphs.call_graph(c, _functions(c, a.function, a.module).select("id"), a.depth).select("depth", "caller_id", "callee_id").distinct()
    for x in ("caller", "callee"):
        steps = steps.join(c["function"].select(F.col("id").alias(f"{x}_id"), F.concat_ws(":", "module_name", "name").alias(x)), f"{x}_id")
    return steps.select("depth", "caller", "callee").orderBy("depth", "caller", "callee")


_MODULE = [("--module", {"help": "only in the module of this name"})]
#: name -> (arguments, query)
QUERIES = {
    "list-modules": ([], lambda c, a: lookups.all_modules(c)),
    "module": ([("name", {})], module),
    "function": ([("name", {}), *_MODULE], function),
    "type": ([("name", {}), *_MODULE], type_),
    "type-dep-graph": ([], lambda c, a: graphs.type_graph(c)),
    "type-graph": ([("type_name", {}), ("module", {}), ("--module-pattern", {"help": "a part of the ids of the types to show"})], lambda c, a: graphs.type_subgraph(c, a.type_name, a.module, a.module_pattern)),
    "most-called": ([("--limit", {"type": int, "default": 10})], lambda c, a: aggregates.most_called(c, a.limit)),
    "call-graph": ([("function", {}), ("module", {}), ("--depth", {"type": int, "default": 2})], call_graph),
    "search": ([("pattern", {})], lambda c, a: lookups.search_content(c, a.pattern)),
    "advanced": ([("query", {"help": "JSON"})], lambda c, a: dsl.execute(c, json.loads(a.query))),
    "pattern": ([("query", {"help": "JSON"})], lambda c, a: aggregates.pattern_match(c, json.loads(a.query))),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="codeloom")
    sub = p.add_subparsers(dest="what", required=True)
    for name, args in {"create": ["out"], "ingest": ["dumps", "out"], "graph": ["out", "dir"], "gexf": ["out", "file"], "sql": ["out", "text"]}.items():
        s = sub.add_parser(name)
        for x in args:
            s.add_argument(x)
        if name == "ingest":
            s.add_argument("--append", action="store_true")
        if name == "gexf":
            s.add_argument("--full", action="store_true", help="the whole property graph instead of the small one")
    q = sub.add_parser("query")
    q.add_argument("out")
    kinds = q.add_subparsers(dest="query_name", required=True)
    for name, (args, _) in QUERIES.items():
        s = kinds.add_parser(name)
        for x, how in args:
            s.add_argument(x, **how)
    return p


def run(a: argparse.Namespace, spark: SparkSession) -> DataFrame | None:
    """What there is to show, None for commands that write."""
    if a.what == "create":
        Catalog(spark).save(a.out)
    elif a.what == "ingest":
        resolve.ingest(spark, a.dumps, a.out, "append" if a.append else "overwrite")
    else:
        c = Catalog.load(spark, a.out)
        if a.what == "graph":
            export.write_graph(*export.property_graph(c), a.dir)
        elif a.what == "gexf":
            export.write_gexf(*(export.property_graph(c) if a.full else export.light_graph(c)), a.file)
        elif a.what == "sql":
            return c.sql(a.text)
        else:
            return QUERIES[a.query_name][1](c, a)
    return None


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    out = run(a, spark or SparkSession.builder.appName("codeloom").getOrCreate())
    if out is not None:
        out.show(truncate=False)


if __name__ == "__main__":
    main()
