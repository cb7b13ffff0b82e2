"""The code model as a property graph: nodes (id, label, props) and edges (src, dst, type), as Parquet by label and type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.typeast import is_atomic_column, refs_column


def _nodes(df: DataFrame, label: str, key: Column, **props: str) -> DataFrame:
    pairs = [x for k, v in props.items() for x in (F.lit(k), F.col(v).cast("string"))]
    named = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return df.select(key.alias("id"), F.lit(label).alias("label"), named.alias("props"))


def _edges(df: DataFrame, kind: str, src: Column | str, dst: Column | str) -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return df.select(c(src).alias("src"), c(dst).alias("dst"), F.lit(kind).alias("type"))


#: Bytes of the files that edges are made from, for each task that tells them apart.
TASK_BYTES = 8_000_000


def _once(edges: DataFrame) -> DataFrame:
    """Each edge once. They are shuffled as they are into tasks whose number grows with the tables: hardly any repeat, so that telling them apart
    before the shuffle as well would hold what a task has of them for nothing."""
    leaves = edges._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    tasks = sum(x for x in sizes if x < 1 << 60) // TASK_BYTES  # beyond: not known
    return edges.repartition(max(tasks, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "src", "dst", "type").distinct()


def property_graph(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges). Ids are natural: module, module:name, parent.name for nested functions; an import's is the MD5 of its module,
    line, target, package and alias. Each node of a label is one, the one with most properties; each (src, dst, type) is one. Called
    functions and imported modules and packages that the catalog lacks are nodes without properties."""
    m = c["module"].select(F.col("id").alias("_m"), F.col("name").alias("module"))
    join = lambda t: c[t].join(m, F.col("module_id") == F.col("_m"))
    cat = lambda *x: F.concat_ws(":", *x)
    fn = join("function").withColumn("nid", cat("module", "name"))
    ty = join("type").withColumn("nid", cat("module", "type_name"))
    cl = join("class").withColumn("nid", cat("module", "class_name"))
    ins = join("instance").withColumn("nid", cat("module", "instance_definition"))
    im = join("import").withColumn("nid", F.md5(F.concat_ws(":", "module", F.coalesce(F.col("line_number_start").cast("string"), F.lit("")), *[F.coalesce(x, F.lit("")) for x in ("module_name", "package_name", "as_module_name")])))
    k = c["constructor"].join(ty.select(F.col("id").alias("type_id"), F.col("nid").alias("tid")), "type_id").withColumn("nid", F.concat_ws("::", "tid", "name"))
    fd = c["field"].join(k.select(F.col("id").alias("constructor_id"), F.col("nid").alias("kid")), "constructor_id").withColumn("nid", F.concat_ws(".", "kid", "field_name"))
    fid = fn.select(F.col("id").alias("_f"), F.col("nid").alias("fid"))
    wh = c["where_function"].join(fid, F.col("parent_function_id") == F.col("_f")).withColumn("nid", F.concat_ws(".", "fid", "name"))
    calls = c["function_called"].where("coalesce(module_name, '') <> '' and coalesce(name, '') <> ''").withColumn("nid", cat("module_name", "name"))
    out = calls.join(fid, F.col("function_id") == F.col("_f"))
    deep = calls.join(wh.select(F.col("id").alias("_w"), F.col("nid").alias("wid")), F.col("where_function_id") == F.col("_w"))
    refs = fd.withColumn("ref", F.explode(refs_column("field_type_structure", "graph"))).withColumn("atomic", is_atomic_column("field_type_structure"))
    used = fn.select("nid", F.explode(F.from_json("instances_used", "array<string>")).alias("_sig")).distinct().join(ins.select("instance_signature", F.col("nid").alias("iid")), F.col("_sig") == F.col("instance_signature"))
    members = c["instance_function"].join(ins.select(F.col("id").alias("instance_id"), F.col("nid").alias("iid")), "instance_id").join(fid, F.col("function_id") == F.col("_f"))
    known = F.coalesce("module_name", F.lit("")) != ""
    packaged = F.coalesce("package_name", F.lit("")) != ""
    nodes = [
        _nodes(m, "Module", F.col("module"), name="module"),
        _nodes(im.where(known), "Module", F.col("module_name"), name="module_name"),
        _nodes(im.where(packaged), "Package", F.col("package_name"), name="package_name"),
        _nodes(fn, "Function", F.col("nid"), name="name", signature="function_signature", src_loc="src_loc", line_start="line_number_start", line_end="line_number_end"),
        _nodes(calls, "Function", F.col("nid"), name="name"),
        _nodes(wh, "WhereFunction", F.col("nid"), name="name", signature="function_signature"),
        _nodes(ty, "Type", F.col("nid"), name="type_name", kind="type_of_type", src_loc="src_loc"),
        _nodes(k, "Constructor", F.col("nid"), name="name"),
        _nodes(fd, "Field", F.col("nid"), name="field_name", raw="field_type_raw"),
        _nodes(cl, "Class", F.col("nid"), name="class_name", src_loc="src_location"),
        _nodes(ins, "Instance", F.col("nid"), signature="instance_signature", src_loc="src_loc"),
        _nodes(im.withColumn("q", F.col("qualified_style").isNotNull()), "ImportRecord", F.col("nid"), importer="module", imported="module_name", alias="as_module_name", is_hiding="is_hiding", is_qualified="q"),
    ]
    target = cat(F.coalesce("ref.module", F.lit("")), F.col("ref.name"))
    edges = [
        *[_edges(t, kind, "module", "nid") for t, kind in ((fn, "HAS_FUNCTION"), (ty, "HAS_TYPE"), (cl, "HAS_CLASS"), (ins, "HAS_INSTANCE"), (im, "DECLARES_IMPORT"))],
        *[_edges(t, "DEFINED_IN", "nid", "module") for t in (fn, ty, cl, ins)],
        _edges(k, "HAS_CONSTRUCTOR", "tid", "nid"),
        _edges(fd, "HAS_FIELD", "kid", "nid"),
        _edges(refs.where((F.concat_ws(":", "ref.module", "ref.name")) != F.expr("split(kid, '::')[0]")), "USES_TYPE", "nid", target),
        _edges(refs.where("atomic"), "HAS_ATOMIC_TYPE", "nid", target),
        _edges(im.where(known), "IMPORTS_MODULE", "nid", "module_name"),
        _edges(im.where(packaged), "IMPORTS_PACKAGE", "nid", "package_name"),
        _edges(out, "CALLS", "fid", "nid"),
        _edges(deep, "CALLS", "wid", "nid"),
        _edges(wh, "DEFINES_WHERE", "fid", "nid"),
        _edges(used, "USES_INSTANCE_SIGNATURE", "nid", "iid"),
        _edges(members, "IMPLEMENTS", "iid", "fid"),
    ]
    n = reduce(DataFrame.union, nodes).where("id is not null")
    n = n.groupBy("id", "label").agg(F.max_by(F.map_entries("props"), F.struct(F.size("props"), F.to_json("props"))).alias("p")).select("id", "label", F.map_from_entries("p").alias("props"))
    return n, _once(reduce(DataFrame.union, edges).where("src is not null and dst is not null"))


def light_graph(c: Catalog) -> tuple[DataFrame, DataFrame]:
    """The small graph: functions, types, constructors and fields, ids with ``--``; nested calls folded into their functions, and
    calls made by the functions of instances that a function uses."""
    nodes, edges = property_graph(c)
    m = c["module"].select(F.col("id").alias("_m"), F.col("name").alias("module"))
    top = c["where_function"].select(F.col("id").alias("_w"), "parent_function_id")
    fn = c["function"].join(m, F.col("module_id") == F.col("_m")).select(F.col("id").alias("_f"), F.concat_ws("--", "module", "name").alias("src"))
    calls = c["function_called"].join(top, F.col("where_function_id") == F.col("_w"), "left").withColumn("owner", F.coalesce("function_id", "parent_function_id"))
    own = calls.join(fn, F.col("owner") == F.col("_f")).where("coalesce(name, '') <> ''").select("owner", "src", F.concat_ws("--", "module_name", "name").alias("dst"))
    sig = c["function"].select(F.col("id").alias("user"), F.explode(F.from_json("instances_used", "array<string>")).alias("_s")).join(c["instance"].select(F.col("id").alias("instance_id"), "instance_signature"), F.col("_s") == F.col("instance_signature"))
    through = sig.join(c["instance_function"].select("instance_id", F.col("function_id").alias("member")), "instance_id").join(own.select(F.col("owner").alias("member"), "dst"), "member").join(fn, F.col("user") == F.col("_f"))
    call_edges = own.select("src", "dst").union(through.select("src", "dst")).select("src", "dst", F.lit("calls").alias("type"))
    kinds = ("HAS_CONSTRUCTOR", "HAS_FIELD", "USES_TYPE")
    dash = lambda x: F.regexp_replace(x, "^([^:]*):(?!:)", "$1--")
    rest = edges.where(F.col("type").isin(*kinds)).select(dash("src").alias("src"), dash("dst").alias("dst"), "type")
    light = nodes.where(F.col("label").isin("Function", "Type", "Constructor", "Field")).select(dash("id").alias("id"), "label", "props")
    return light, _once(call_edges.union(rest))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """MERGE: rows of ``new`` take the place of those of ``old`` with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GEXF text for small graphs, streamed through the driver row by row."""
    from xml.sax.saxutils import quoteattr as q

    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<gexf version="1.2" xmlns="http://www.gexf.net/1.2draft"><graph defaultedgetype="directed"><nodes>\n')
        for r in nodes.select("id", "label").toLocalIterator():
            f.write(f"<node id={q(r[0])} label={q(r[1])}/>\n")
        f.write("</nodes><edges>\n")
        for i, r in enumerate(edges.select("src", "dst", "type").toLocalIterator()):
            f.write(f'<edge id="{i}" source={q(r[0])} target={q(r[1])} label={q(r[2])}/>\n')
        f.write("</edges></graph></gexf>\n")
