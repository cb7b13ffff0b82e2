"""From dumps to the tables of the code model: identities, edges and references resolved by joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.loops import cut, stored
from ..functions.typeast import refs_column
from ..schema import SCHEMAS
from . import dumps


def with_ids(df: DataFrame, *keys: str, offset: int = 0) -> DataFrame:
    """Dense ids from offset + 1 in the order of the keys: positions within range partitions plus the sizes of those before,
    so that no task sees all rows."""
    n = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    spread = df.repartitionByRange(int(n), *keys).sortWithinPartitions(*keys)
    spread = spread.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id() - F.shiftleft(F.col("_p").cast("bigint"), 33))
    spread = stored(spread)
    sizes = {r[0]: r[1] for r in spread.groupBy("_p").count().collect()}  # one number for each partition
    before, total = {}, offset
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    start = F.create_map(*[F.lit(x) for kv in before.items() for x in kv]) if before else None
    ids = F.col("_i") + 1 + (F.get(F.array(*[F.lit(before.get(p, 0)) for p in range(max(before) + 1)]), F.col("_p")) if before else F.lit(0))
    return spread.withColumn("id", ids.cast("bigint") if start is not None else F.lit(None).cast("bigint")).drop("_p", "_i")


def next_id(df: DataFrame) -> int:
    return df.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]


#: Ids of a block; blocks up to this number, and ids in them, are sent to every executor (some 100 MB), more are joined by a shuffle.
BLOCK, BROADCAST_BLOCKS, BROADCAST_IDS = 1000, 200_000, 4_000_000


def _classes(rows: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Ids with the same keys are one class, known by its least id: (c, keys..) and (c, j, ids), its ids in blocks. An id is in one class."""
    each = rows.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("k"))
    classes = stored(each.groupBy("k").agg(F.min("id").alias("c"), F.collect_list(F.struct("id")).alias("ids")))
    blocks = classes.select("c", F.posexplode(F.expr(f"transform(sequence(0, (size(ids) - 1) div {BLOCK}), j -> slice(ids, cast(j * {BLOCK} + 1 as int), {BLOCK}))")).alias("j", "ids"))
    n = blocks.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    return classes.select("c", F.explode("k").alias("k")).select("c", "k.*"), F.broadcast(blocks) if n[0] <= BROADCAST_BLOCKS and n[1] <= BROADCAST_IDS else blocks


def call_edges(owners: DataFrame, calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_id, callee_id), each once: every function of a caller's key with every function of a callee's (module, name).
    owners: (key.., id) rows; calls without module or name resolve to nothing.

    Where names repeat, pairs grow with the square of the functions. They are told apart as pairs of classes, functions with the same
    keys, and become pairs of ids at the very end: these are never shuffled, sorted or held, and no row makes more than BLOCK * BLOCK."""
    (caller, a), (callee, b) = _classes(owners, "full_key"), _classes(functions, "module_name", "name")
    named = calls.where("coalesce(module_name, '') <> '' and coalesce(name, '') <> ''").select("full_key", "module_name", "name").distinct()
    pairs = named.join(caller.withColumnRenamed("c", "ca"), "full_key").join(callee.withColumnRenamed("c", "cb"), ["module_name", "name"]).select("ca", "cb").distinct()
    pairs = pairs.join(a.selectExpr("c as ca", "j as ja"), "ca").join(b.selectExpr("c as cb", "j as jb"), "cb")
    # in so many tasks however few bytes they are
    pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ca", "ja", "cb", "jb")
    pairs = pairs.join(a.toDF("ca", "ja", "xs"), ["ca", "ja"]).join(b.toDF("cb", "jb", "ys"), ["cb", "jb"])
    return pairs.select(F.explode("xs").alias("x"), "ys").select("x.id", F.explode("ys").alias("y")).select(F.col("id").alias("caller_id"), F.col("y.id").alias("callee_id"))


def resolution_counts(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(missing, ambiguous) distinct (module, name) keys of calls."""
    n = functions.groupBy(F.col("module_name").alias("_m"), F.col("name").alias("_n")).agg(F.count("*").alias("k"))
    c = calls.where("coalesce(module_name, '') <> '' and coalesce(name, '') <> ''").select("module_name", "name").distinct()
    j = c.join(n, (F.col("module_name") == F.col("_m")) & (F.col("name") == F.col("_n")), "left")
    return j.agg(F.count_if(F.col("k").isNull()).alias("missing"), F.count_if(F.col("k") > 1).alias("ambiguous"))


def unambiguous(functions: DataFrame) -> DataFrame:
    """(module_name, name, id) of the names that one function only has in its module."""
    return functions.groupBy("module_name", "name").agg(F.count("*").alias("_k"), F.min("id").alias("id")).where("_k = 1").drop("_k")


def build(spark: SparkSession, root: str) -> Catalog:
    """All tables, from a folder of dumps. Ids follow natural keys, so they are the same on every run."""
    return _built(spark, root)[0]


def _built(spark: SparkSession, root: str) -> tuple[Catalog, Callable[[], DataFrame]]:
    """The tables, each made when it is first asked for, and what gives (caller_id, module_name, name) of all calls, whether they resolve or not."""
    fn, nested = dumps.function_heads(spark, root), dumps.where_functions(spark, root)
    cl, im, ty, ins = dumps.classes(spark, root), dumps.imports(spark, root), dumps.types(spark, root), dumps.instances(spark, root)

    @cache
    def module() -> DataFrame:
        paths = dumps.files(spark, root, ".hs.json").groupBy("module").agg(F.min("path").alias("path"))
        names = dumps.function_modules(spark, root).union(cl.select("module_name")).union(im.select("importer")).union(ty.select("module_name")).union(ins.select("module_name")).distinct()
        return with_ids(names.join(paths, names["module_name"] == paths["module"], "left").select(F.col("module_name").alias("name"), F.coalesce("path", "module_name").alias("path")), "name")

    def in_module(df: DataFrame, by: str = "module_name") -> DataFrame:
        mid = module().select(F.col("id").alias("module_id"), F.col("name").alias("_mod"))
        return df.join(mid, df[by] == mid["_mod"]).drop("_mod")

    @cache
    def one() -> DataFrame:
        """One function for each canonical key; the last by its full name holds."""
        located = F.when((F.col("src_loc") != "") & (F.col("line_number_start") > 0), F.concat(F.lit(":"), "src_loc", F.lit(":"), "line_number_start")).otherwise("")
        key = F.concat_ws(":", "module_name", "name", F.coalesce("signature", F.lit("")))
        cols = [c for c in fn.columns if c != "module_name"]
        rows = fn.withColumn("canonical", F.concat(key, located)).groupBy("module_name", "canonical").agg(F.max_by(F.struct(*cols), F.struct("full", F.coalesce("raw_string", F.lit("")))).alias("r")).select("module_name", "canonical", "r.*")
        return with_ids(in_module(rows), "module_name", "canonical").withColumn("full_key", F.concat_ws("\x00", "module_name", "full"))

    def function() -> DataFrame:
        return one().select(
            "id", "name", F.expr("nullif(signature, '')").alias("function_signature"), F.expr("nullif(raw_string, '')").alias("raw_string"), F.expr("nullif(src_loc, '')").alias("src_loc"), "module_name", "line_number_start", "line_number_end",
            F.lit("_function").alias("type_enum"), F.to_json("instances_used").alias("instances_used"), "module_id", "function_input", "function_output",
        )

    def own() -> DataFrame:
        return one().select("id", "full_key")

    def calls() -> DataFrame:
        return dumps.function_calls(spark, root).select(F.concat_ws("\x00", "module_name", "full").alias("full_key"), "c.*")

    @cache
    def wh() -> DataFrame:
        rows = nested.withColumn("full_key", F.concat_ws("\x00", "module_name", "full")).join(own().withColumnRenamed("id", "parent_function_id"), "full_key")
        return with_ids(rows, "parent_function_id", "path")

    def where_function() -> DataFrame:
        return wh().select("id", "name", F.expr("nullif(signature, '')").alias("function_signature"), F.lit(None).cast("string").alias("raw_string"), F.expr("nullif(src_loc, '')").alias("src_loc"), "parent_function_id", "depth", "path")

    def clear() -> DataFrame:
        return unambiguous(one()).select("id")

    def called() -> DataFrame:
        """Calls as rows: of functions whose names are unambiguous, and of the functions nested in any."""
        kept = ("module_name", "name", "package_name", "src_loc", "type_enum")
        top = own().join(clear(), "id").join(calls(), "full_key").select(F.col("id").alias("function_id"), F.lit(None).cast("bigint").alias("where_function_id"), *kept)
        deep = wh().select(F.lit(None).cast("bigint").alias("function_id"), F.col("id").alias("where_function_id"), F.explode("calls").alias("c")).select("function_id", "where_function_id", *[f"c.{x}" for x in kept])
        rows = top.unionByName(deep).withColumn("_type", F.col("type_enum"))
        rows = with_ids(rows, "function_id", "where_function_id", "module_name", "name", "_type", "package_name", "src_loc")
        return rows.withColumn("function_name", F.col("name")).withColumn("function_signature", F.lit(None).cast("string"))

    @cache
    def types() -> DataFrame:
        return with_ids(in_module(ty), "module_name", "type_name")

    @cache
    def ctor() -> DataFrame:
        return with_ids(types().select(F.col("id").alias("type_id"), F.posexplode("constructors").alias("k", "c")).select("type_id", "k", F.col("c.name").alias("name"), "c.fields"), "type_id", "k")

    @cache
    def field() -> DataFrame:
        rows = ctor().select(F.col("id").alias("constructor_id"), F.posexplode("fields").alias("k", "f"))
        return with_ids(rows.select("constructor_id", "k", F.col("f.name").alias("field_name"), F.expr("nullif(f.raw, '')").alias("field_type_raw"), F.col("f.structure").alias("field_type_structure")), "constructor_id", "k")

    @cache
    def inst() -> DataFrame:
        return with_ids(in_module(ins), "module_name", "src_loc", "instance_definition")

    def members() -> DataFrame:
        rows = dumps.instance_members(inst(), one().join(clear(), "id", "left_semi"), "id", "id")
        return with_ids(rows.select(F.col("instance").alias("instance_id"), F.col("function").alias("function_id")), "instance_id", "function_id")

    tables = {
        "module": module, "function": function, "where_function": where_function, "function_called": called, "function_dependency": lambda: call_edges(own(), calls(), one()),
        "import": lambda: with_ids(in_module(im, "importer"), "importer", "line_number_start", "module_name"), "type": types, "constructor": ctor, "field": field, "class": lambda: with_ids(in_module(cl), "module_name", "class_name", "line_number_start"),
        "instance": inst, "instance_function": members, "type_dependency": lambda: type_edges(types(), ctor(), field()),
    }
    typed = lambda k: lambda: tables[k]().select(*[F.col(f"`{c.name}`").cast(c.dataType) for c in SCHEMAS[k]])
    return Catalog(spark, {k: typed(k) for k in tables}), lambda: own().join(calls(), "full_key").select(F.col("id").alias("caller_id"), "module_name", "name")


def type_edges(types: DataFrame, ctor: DataFrame, field: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(dependent_id, dependency_id), each once: types that fields refer to, by module (the owner's, where none is said) and name;
    never to the owner's own name. targets: the types that may be referred to, where they are others than ``types``."""
    t = types.select(F.col("id").alias("dependent_id"), F.col("module_name").alias("_om"), F.col("type_name").alias("_on"))
    c = ctor.select(F.col("id").alias("_c"), "type_id")
    refs = t.join(c, F.col("dependent_id") == F.col("type_id")).join(field, F.col("_c") == F.col("constructor_id"))
    refs = refs.select("dependent_id", "_om", "_on", F.explode(refs_column("field_type_structure", "loader")).alias("r")).where("r.name <> _on")
    refs = refs.select("dependent_id", F.coalesce(F.expr("nullif(r.module, '')"), "_om").alias("_m"), F.col("r.name").alias("_n")).distinct()
    target = (types if targets is None else targets).groupBy(F.col("module_name").alias("_m"), F.col("type_name").alias("_n")).agg(F.max("id").alias("dependency_id"))
    return refs.join(target, ["_m", "_n"]).select("dependent_id", "dependency_id").where("dependent_id <> dependency_id").distinct()


def ingest(spark: SparkSession, root: str, out: str, mode: str = "overwrite") -> Catalog:
    """Build and write all tables. mode "append" adds, with ids after those that are there, the rows whose natural keys are new."""
    if mode == "append":
        old = Catalog.load(spark, out)
        build_into(spark, root, out, old)
    else:
        build(spark, root).save(out, mode)
    return Catalog.load(spark, out)


#: Columns that hold another table's id.
_REFERS = {"module_id": "module", "parent_function_id": "function", "function_id": "function", "where_function_id": "where_function", "type_id": "type", "constructor_id": "constructor", "instance_id": "instance", "caller_id": "function", "callee_id": "function", "dependent_id": "type", "dependency_id": "type"}


def build_into(spark: SparkSession, root: str, out: str, old: Catalog) -> None:
    """Modules that the tables lack come in whole; those that are there stay as they are. Calls and type references go by name, among the
    new rows, from new to old ones, and from old ones to what was missing before."""
    new, calls = _built(spark, root)
    known = old["module"].select(F.col("name").alias("_k"))
    fresh = new["module"].join(known, F.col("name") == F.col("_k"), "left_anti")
    shift = {k: next_id(old[k]) - 1 for k in SCHEMAS if "id" in SCHEMAS[k].names}
    kept = {"module": fresh}
    for k, by in (("function", "module_id"), ("import", "module_id"), ("type", "module_id"), ("class", "module_id"), ("instance", "module_id")):
        kept[k] = new[k].join(fresh.select(F.col("id").alias("_m")), F.col(by) == F.col("_m"), "left_semi")
    parents = (("where_function", "function", "parent_function_id"), ("constructor", "type", "type_id"), ("field", "constructor", "constructor_id"), ("instance_function", "instance", "instance_id"))
    for k, parent, by in parents:
        kept[k] = new[k].join(kept[parent].select(F.col("id").alias("_p")), F.col(by) == F.col("_p"), "left_semi")
    f, w = kept["function"].select(F.col("id").alias("_f")), kept["where_function"].select(F.col("id").alias("_w"))
    c = new["function_called"]
    kept["function_called"] = c.join(f, F.col("function_id") == F.col("_f"), "left_semi").union(c.join(w, F.col("where_function_id") == F.col("_w"), "left_semi"))
    kept["function_dependency"] = new["function_dependency"].join(f, F.col("caller_id") == F.col("_f"), "left_semi").join(f, F.col("callee_id") == F.col("_f"), "left_semi")
    t = kept["type"].select(F.col("id").alias("_t"))
    kept["type_dependency"] = new["type_dependency"].join(t, F.col("dependent_id") == F.col("_t"), "left_semi").join(t, F.col("dependency_id") == F.col("_t"), "left_semi")
    moved = {}
    for k in SCHEMAS:
        by = {n: k if n == "id" else _REFERS.get(n) for n in SCHEMAS[k].names}
        moved[k] = kept[k].select(*[(F.col(f"`{n}`") + shift[t]).cast("bigint").alias(n) if t else F.col(f"`{n}`") for n, t in by.items()])
    # across: the ids of both sides are final here
    mine = calls().join(f, F.col("caller_id") == F.col("_f"), "left_semi").withColumn("caller_id", F.col("caller_id") + shift["function"])
    theirs = old["function_called"].where("function_id is not null").select(F.col("function_id").alias("caller_id"), "module_name", "name")
    across = _by_name(mine, old["function"]).union(_by_name(theirs, moved["function"]))
    moved["function_dependency"] = moved["function_dependency"].union(across).distinct()
    named = [_named(x["type"], m) for x, m in ((moved, moved["module"]), (old, old["module"]))]
    across = type_edges(named[0], moved["constructor"], moved["field"], named[1]).union(type_edges(named[1], old["constructor"], old["field"], named[0]))
    moved["type_dependency"] = moved["type_dependency"].union(across).distinct()
    # all is computed before the first table that it was read from grows
    for k, rows in [(k, cut(x)) for k, x in moved.items()]:
        rows.write.mode("append").parquet(f"{out}/{k}")


def _by_name(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller_id, callee_id) of calls (caller_id, module_name, name)."""
    f = functions.select(F.col("id").alias("callee_id"), F.col("module_name").alias("_m"), F.col("name").alias("_n"))
    c = calls.where("coalesce(module_name, '') <> '' and coalesce(name, '') <> ''").distinct()
    return c.join(f, (F.col("module_name") == F.col("_m")) & (F.col("name") == F.col("_n"))).select("caller_id", "callee_id").distinct()


def _named(types: DataFrame, module: DataFrame) -> DataFrame:
    return types.join(module.select(F.col("id").alias("module_id"), F.col("name").alias("module_name")), "module_id")
