"""Call graphs and graphs of types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.loops import cut
from ..functions.typeast import refs_column


def call_graph(c: Catalog, roots: DataFrame | int, depth: int = 2) -> DataFrame:
    """(root, depth, caller_id, callee_id): the calls within ``depth`` steps of the roots, self-calls aside, each once per
    depth. Depth under 1 gives no rows. Steps are joins of a frontier of distinct functions, so paths never multiply."""
    spark = c.spark
    if not isinstance(roots, DataFrame):
        roots = c["function"].where(F.col("id") == roots).select("id")
    edges = c["function_dependency"].where("caller_id <> callee_id")
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("node"))
    out = spark.createDataFrame([], "root bigint, depth int, caller_id bigint, callee_id bigint")
    for d in range(1, depth + 1):
        step = front.join(edges, F.col("node") == F.col("caller_id")).select("root", F.lit(d).alias("depth"), "caller_id", "callee_id")
        out = out.union(step)
        front = step.select("root", F.col("callee_id").alias("node")).distinct()
        if d % 4 == 0:
            front = cut(front)
    return out


def call_graph_document(c: Catalog, function_id: int, depth: int = 2) -> dict:
    """The nested document {id, name, module, calls} of one function: one query for all levels, put together here."""
    if depth < 1:
        return {}
    rows = call_graph(c, function_id, depth).select("caller_id", "callee_id").distinct()
    ids = rows.select(F.explode(F.array("caller_id", "callee_id")).alias("_i")).union(c.spark.createDataFrame([(function_id,)], "_i bigint")).distinct()
    m = c["module"].select(F.col("id").alias("_m"), F.col("name").alias("_module"))
    f = c["function"].join(ids, F.col("id") == F.col("_i"), "left_semi").join(m, F.col("module_id") == F.col("_m"), "left")
    info = {r[0]: {"id": r[0], "name": r[1], "module": r[2]} for r in f.select("id", "name", F.coalesce("_module", F.lit("Unknown"))).toLocalIterator()}
    calls: dict[int, list[int]] = {}
    for a, b in rows.orderBy("caller_id", "callee_id").toLocalIterator():
        calls.setdefault(a, []).append(b)

    def node(i: int, left: int) -> dict:
        return info[i] | ({"calls": [node(j, left - 1) for j in calls.get(i, []) if j in info]} if left > 0 else {})

    return node(function_id, depth) if function_id in info else {}


def type_nodes(c: Catalog) -> DataFrame:
    m = c["module"].select(F.col("id").alias("_m"), F.col("name").alias("module"))
    t = c["type"].join(m, F.col("module_id") == F.col("_m"), "left")
    return t.select(F.concat_ws(":", "src_loc", "type_name").alias("node"), "type_name", "module", F.col("id").alias("type_id"), "raw_code", "src_loc")


def type_graph(c: Catalog) -> DataFrame:
    """(src, dst), each once: from each type to every type of a name that its fields refer to, or to the bare name where no
    type has it; a constructor without fields adds its own name."""
    nodes = type_nodes(c)
    k = c["constructor"].select(F.col("id").alias("_k"), F.col("name").alias("_kname"), "type_id")
    of = nodes.select("node", "type_id").join(k, "type_id")
    f = c["field"].select("constructor_id", "field_type_structure")
    refs = of.join(f, F.col("_k") == F.col("constructor_id")).select("node", F.explode(refs_column("field_type_structure", "query")).alias("ref")).select("node", F.col("ref.name").alias("ref")).distinct()
    targets = nodes.select(F.col("node").alias("_target"), "type_name")
    edges = refs.join(targets, F.col("ref") == F.col("type_name"), "left").select(F.col("node").alias("src"), F.coalesce("_target", "ref").alias("dst"))
    leaves = of.join(f.select("constructor_id"), F.col("_k") == F.col("constructor_id"), "left_anti").select(F.col("node").alias("src"), F.col("_kname").alias("dst"))
    return edges.union(leaves).distinct()


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node) reached from the starts along (src, dst) edges, the starts included. Each round joins only the new nodes; it
    ends, cycles or not, when there are none. A round's nodes are checkpointed."""
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(starts.select("node").distinct())
    front = seen
    while not front.isEmpty():
        new = front.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = cut(new.join(seen, "node", "left_anti"))
        seen = cut(seen.union(front))
    return seen


def type_subgraph(c: Catalog, type_name: str, module: str, module_pattern: str | None = None) -> DataFrame:
    """(node) of the types reached from those of this name in this module. The pattern is a part of the node's id."""
    nodes = type_nodes(c)
    starts = nodes.where((F.col("type_name") == type_name) & (F.col("module") == module)).select("node")
    edges = type_graph(c).join(nodes.select(F.col("node").alias("_n")), F.col("dst") == F.col("_n"), "left_semi")
    found = reachable(edges, starts)
    return found if module_pattern is None else found.where(F.contains("node", F.lit(module_pattern)))


def nested_type_bodies(c: Catalog, names: list[str], gateway: str, should_not_match: str | None = None) -> DataFrame:
    """(raw_code), each once: for each name the first type whose module has ``gateway`` in it (else the first of all), and all types
    reached from it whose location has it too, but for locations with ``should_not_match``."""
    nodes = type_nodes(c)
    mine = nodes.where(F.col("type_name").isin(*names)) if names else nodes.limit(0)
    order = F.struct(~F.coalesce(F.contains("module", F.lit(gateway)), F.lit(False)), F.col("type_id"))
    roots = mine.groupBy("type_name").agg(F.min_by(F.struct("node", "raw_code"), order).alias("r")).select("r.*")
    edges = type_graph(c).join(nodes.select(F.col("node").alias("_n")), F.col("dst") == F.col("_n"), "left_semi")
    found = reachable(edges, roots).where(F.contains("node", F.lit(gateway)))
    bodies = nodes.join(found, "node", "left_semi")
    if should_not_match:
        bodies = bodies.where(~F.contains("src_loc", F.lit(should_not_match)))
    return roots.select("raw_code").union(bodies.select("raw_code")).distinct()
