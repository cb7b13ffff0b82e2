"""Readers of compiler dumps: one lazy DataFrame per kind, the suffix of the file deciding on the kind.

Files are read whole, in executors; records that can't be read are left out one by one, and counted by
``rejects``. Object keys are dynamic, so schemas are given, never inferred.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest first, so that none is cut within another.
SUFFIXES = (
    ".hs.function_instance_mapping.json",
    ".hs.type.typechecker.json",
    ".hs.module_imports.json",
    ".hs.types.parser.json",
    ".hs.function_code.json",
    ".hs.instance_code.json",
    ".hs.typeUpdates.json",
    ".hs.types_code.json",
    ".hs.class_code.json",
    ".hs.fieldUsage.json",
    ".hs.json",
)
_CALL = "struct<_type:string,type_enum:string,name:string,module_name:string,package_name:string,src_loc:string>"
_ENTRY = f"struct<key:string,typeSignature:string,expr:{_CALL},functionIO:struct<inputs:array<string>,outputs:array<string>>>"


def module_name(relative: Column) -> Column:
    """Module of a path below the dump folder."""
    p = F.concat(F.lit("/"), F.ltrim(relative, F.lit("/")))
    p = F.regexp_replace(p, "/build/autogen(?=/)", "")
    p = F.ltrim(F.regexp_replace(p, "/(app|dist|compiler)(?=/)", ""), F.lit("/"))
    p = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), SUFFIXES, p)
    cut = F.when(F.lit(False), p)
    for mark in ("src/", "src-generated/", "src-extras/", "/app/", "test/"):
        cut = cut.when(F.contains(p, F.lit(mark)), F.element_at(F.split(p, mark), -1))
    return F.translate(cut.otherwise(p), "/", ".")


def unqualified(text: Column) -> Column:
    """Each word without what stands before its last dot."""
    return F.array_join(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.element_at(F.split(w, r"\."), -1)), " ")


def files(spark: SparkSession, root: str | DataFrame, suffix: str, stream: bool = False) -> DataFrame:
    """(path, module, value): the whole text of every file below the root that ends with the suffix. In place of a folder, root may be
    a table (path, value) of texts that were read elsewhere, with paths below the root."""
    if isinstance(root, DataFrame):
        rows = root.where(F.endswith(F.col("path"), F.lit(suffix)))
        return rows.select("path", module_name(F.col("path")).alias("module"), "value")
    reader = (spark.readStream if stream else spark.read).schema("value string")
    rows = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(root, wholetext=True)
    base = root.rstrip("/") + "/"
    base = base.split("://", 1)[-1] if "://" in base else base
    path = F.regexp_replace(F.expr("_metadata.file_path"), "^[a-z]+:(//)?(?=/)", "")
    path = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return rows.select(path.alias("path"), "value").withColumn("module", module_name(F.replace(F.col("path"), F.lit(base), F.lit("")))).select("path", "module", "value")


def _object(value: str, kind: str) -> Column:
    """A JSON object with dynamic keys as an array of entries; null if the text isn't one object."""
    return F.map_entries(F.element_at(F.from_json(F.concat(F.lit("["), F.col(value), F.lit("]")), f"array<map<string,{kind}>>"), 1))


#: Of an entry, what tells where it belongs, and what a function's own record is made of; the parser skips the rest.
_PLACE = "struct<key:string>"
_HEAD = "struct<key:string,typeSignature:string,expr:struct<_type:string>,functionIO:struct<inputs:array<string>,outputs:array<string>>>"


def function_entries(spark: SparkSession, root: str, kind: str = _ENTRY) -> DataFrame:
    """(module, path, key, pos, entry) of ``*.hs.json``: one object, or JSON lines with a key each (repeated lines count once)."""
    text = files(spark, root, ".hs.json").withColumn("o", _object("value", f"array<{kind}>"))
    whole = text.where("o is not null").select("module", "path", F.explode("o").alias("e")).select("module", "path", F.col("e.key").alias("key"), F.posexplode("e.value").alias("pos", "entry"))
    lines = text.where("o is null").select("module", "path", F.posexplode(F.split("value", "\n")).alias("pos", "line")).where(F.trim("line") != "")
    lines = lines.groupBy("module", "path", "line").agg(F.min("pos").alias("pos")).withColumn("entry", F.from_json("line", kind))
    lines = lines.where("entry.key is not null").select("module", "path", F.col("entry.key").alias("key"), "pos", "entry")
    return whole.unionByName(lines)


def rejects(spark: SparkSession, root: str) -> DataFrame:
    """(path, n_lines, n_bad): files that aren't one object, and how many of their lines can't be read either."""
    text = files(spark, root, ".hs.json").where(_object("value", f"array<{_ENTRY}>").isNull())
    lines = text.select("path", F.explode(F.split("value", "\n")).alias("line")).where(F.trim("line") != "")
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.count_if(F.from_json("line", _ENTRY)["key"].isNull()).alias("n_bad"))


def _code(spark: SparkSession, root: str) -> DataFrame:
    t = files(spark, root, ".hs.function_code.json").select("module", F.explode(_object("value", "struct<parser_stringified_code:string,line_number:array<int>>")).alias("e"))
    return t.select("module", F.col("e.key").alias("full"), F.col("e.value.parser_stringified_code").alias("code"), F.col("e.value.line_number").alias("lines")).groupBy("module", "full").agg(F.max_by(F.struct("code", "lines"), F.coalesce("code", F.lit(""))).alias("c"))


def _instances_used(spark: SparkSession, root: str) -> DataFrame:
    t = files(spark, root, ".hs.function_instance_mapping.json").select("module", F.explode(_object("value", "array<array<string>>")).alias("e"))
    used = F.transform(F.col("e.value"), lambda x: F.get(x, F.lit(1)))
    return t.select("module", F.element_at(F.split("e.key", r"\$"), -1).alias("short"), used.alias("u")).groupBy("module", "short").agg(F.max("u").alias("instances_used"))


def _called(e: Column) -> Column:
    kind = F.coalesce(e["type_enum"], e["_type"], F.lit(""))
    return F.struct(e["_type"].alias("_type"), kind.alias("type_enum"), e["name"].alias("name"), e["module_name"].alias("module_name"), e["package_name"].alias("package_name"), e["src_loc"].alias("src_loc"))


def _placed(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The entries with their function's full name, whether they are of a function nested in another, and the top-level one's full name."""
    e = function_entries(spark, root, kind).withColumn("full", F.replace("key", F.lit("$_in$"), F.lit("")))
    return e.withColumn("nested", F.contains("full", F.lit("::"))).withColumn("top", F.element_at(F.split("full", "::"), 1))


def function_modules(spark: SparkSession, root: str) -> DataFrame:
    """(module_name) of the modules that have a top-level function."""
    return _placed(spark, root, _PLACE).where("not nested").select(F.col("module").alias("module_name")).distinct()


def function_calls(spark: SparkSession, root: str, light: bool = False) -> DataFrame:
    """(module_name, full, c): the calls of ``functions``, a row each."""
    e = _placed(spark, root, _ENTRY)
    calls = e.where("top <> ''" if light else "not nested").where("entry.expr is not null and entry.typeSignature is null")
    calls = calls.select("module", F.col("top").alias("full"), F.col("nested").cast("int").alias("n"), "key", "pos", F.col("entry.expr").alias("x"))
    calls = calls.groupBy("module", "full", "x._type", "x.name", "x.module_name", "x.package_name").agg(F.max_by("x", F.struct("n", "key", "pos")).alias("x"))
    x = _called(F.col("x")).withField("module_name", F.when(F.col("x._type") == "OverLit", "_lit").otherwise(F.col("x.module_name")))
    return calls.select(F.col("module").alias("module_name"), "full", x.alias("c"))


def functions(spark: SparkSession, root: str, light: bool = False) -> DataFrame:
    """Top-level functions: (module_name, full, name, signature, raw_string, src_loc, lines, inputs, outputs, instances_used, calls).

    The last signature and the last inputs and outputs hold. Calls are those of the function itself (light: also of all
    functions nested in it), each once by (_type, name, module, package), the last one holding; literals are called from
    module ``_lit``."""
    calls = function_calls(spark, root, light).groupBy("module_name", "full").agg(F.sort_array(F.collect_list("c")).alias("calls"))
    rows = function_heads(spark, root).join(calls, ["module_name", "full"], "left")
    return rows.withColumn("calls", F.coalesce("calls", F.array().cast(f"array<{_CALL}>")))


def function_heads(spark: SparkSession, root: str) -> DataFrame:
    """``functions`` without their calls."""
    own = _placed(spark, root, _HEAD).where("not nested")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos")))
    flat = own.select("module", "full", "pos", F.col("entry.typeSignature").alias("sig"), F.when(F.expr("entry.typeSignature is null and entry.expr is null"), F.col("entry.functionIO")).alias("io"))
    heads = flat.groupBy("module", "full").agg(last("sig").alias("signature"), last("io").alias("io"))
    rows = heads.join(_code(spark, root), ["module", "full"], "left").withColumn("name", F.element_at(F.split("full", r"\*\*"), 1)).withColumn("short", F.element_at(F.split("name", r"\$"), -1))
    rows = rows.join(_instances_used(spark, root), ["module", "short"], "left")
    loc = F.coalesce(F.get(F.split("full", r"\*\*"), F.lit(1)), F.lit(""))
    rows = rows.withColumn("src_loc", loc)
    pair = lambda i: F.expr(f"try_cast(nullif(regexp_extract(src_loc, '.*:(\\\\d+),(\\\\d+)-\\\\((\\\\d+),(\\\\d+)\\\\)', {i}), '') as int)")
    first = F.expr("try_cast(get(split(src_loc, ':'), 1) as int)")
    known = (F.col("src_loc") != "") & (F.col("src_loc") != "<no location info>")
    lines = F.col("c.lines")
    start = F.when(known, F.coalesce(F.get(lines, F.lit(0)), first, pair(1))).otherwise(None)
    end = F.when(known, F.when(F.get(lines, F.lit(0)).isNotNull(), F.get(lines, F.lit(1))).otherwise(F.coalesce(first, pair(3)))).otherwise(None)
    return rows.select(
        F.col("module").alias("module_name"), "full", "name", "signature", F.col("c.code").alias("raw_string"), "src_loc", F.coalesce(start, F.lit(-1)).alias("line_number_start"), F.coalesce(end, F.lit(-1)).alias("line_number_end"),
        F.col("io.inputs").alias("function_input"), F.col("io.outputs").alias("function_output"), F.coalesce("instances_used", F.array().cast("array<string>")).alias("instances_used"),
    )


def where_functions(spark: SparkSession, root: str) -> DataFrame:
    """Functions nested at any depth: (module_name, full of the top-level function, path, depth, name, signature, src_loc, calls)."""
    e = function_entries(spark, root).withColumn("path", F.replace("key", F.lit("$_in$"), F.lit(""))).where("contains(path, '::')")
    parts = F.split("path", "::")
    sig = F.col("entry.typeSignature")
    g = e.groupBy("module", "path").agg(
        F.max_by(sig, F.when(sig.isNotNull(), F.col("pos"))).alias("signature"),
        F.sort_array(F.collect_set(F.when(sig.isNull() & F.col("entry.expr").isNotNull(), _called(F.col("entry.expr"))))).alias("calls"),
    )
    me = F.element_at(parts, -1)
    return g.where(F.trim(F.element_at(parts, 1)) != "").select(
        F.col("module").alias("module_name"), F.element_at(parts, 1).alias("full"), "path", (F.size(parts) - 1).alias("depth"), F.element_at(F.split(me, r"\*\*"), 1).alias("name"), "signature",
        F.coalesce(F.get(F.split(me, r"\*\*"), F.lit(1)), F.lit("")).alias("src_loc"), "calls",
    )


def _array(spark: SparkSession, root: str, suffix: str, kind: str) -> DataFrame:
    """The records of files that hold one array."""
    t = files(spark, root, suffix)
    return t.select("path", "module", F.explode(F.from_json("value", f"array<struct<{kind}>>")).alias("r"))


def _lines(of: str) -> list[Column]:
    at = F.col(of)
    return [F.coalesce(F.get(at, F.lit(i)), F.lit(-1)).alias(n) for i, n in enumerate(("line_number_start", "line_number_end"))]


def classes(spark: SparkSession, root: str) -> DataFrame:
    r = _array(spark, root, ".hs.class_code.json", "className:string,classDefinition:string,classLocation:string,line_number:array<int>")
    return r.select(F.col("module").alias("module_name"), F.col("r.className").alias("class_name"), F.col("r.classDefinition").alias("class_definition"), F.col("r.classLocation").alias("src_location"), *_lines("r.line_number"))


def imports(spark: SparkSession, root: str) -> DataFrame:
    kind = "`moduleName'`:string,packageName:string,asModuleName:string,isImplicit:boolean,isSafe:boolean,isBootSource:boolean,hidingSpec:struct<isHiding:boolean,names:array<string>>,qualifiedStyle:struct<tag:string>,line_number:array<int>"
    r = _array(spark, root, ".hs.module_imports.json", kind)
    return r.select(
        F.col("module").alias("importer"), F.col("r.`moduleName'`").alias("module_name"), F.col("r.packageName").alias("package_name"), F.replace("path", F.lit(".module_imports.json"), F.lit("")).alias("src_loc"),
        F.coalesce("r.isBootSource", F.lit(False)).alias("is_boot_source"), F.col("r.isSafe").alias("is_safe"), F.col("r.isImplicit").alias("is_implicit"), F.col("r.asModuleName").alias("as_module_name"),
        F.col("r.qualifiedStyle.tag").alias("qualified_style"), F.col("r.hidingSpec.isHiding").alias("is_hiding"), F.col("r.hidingSpec.names").alias("hiding_specs"), *_lines("r.line_number"),
    )


def imports_of_module(spark: SparkSession, root: str, module: str) -> DataFrame:
    return imports(spark, root).where(F.col("importer") == module)


def types(spark: SparkSession, root: str, suffix: str = ".hs.type.typechecker.json") -> DataFrame:
    """(module_name, type_name, type_of_type, raw_code, src_loc, lines, constructors: array<(name, fields: array<(name, raw, structure)>)>).

    Several constructors make a sum type, else the kind decides, data if it is no known one. Newtypes, classes and instances
    keep no constructors."""
    kind = "struct<typeKind:string,dataConstructors:array<struct<dataConNames:string,fields:map<string,string>>>>"
    t = files(spark, root, suffix).select("module", F.explode(_object("value", kind)).alias("e")).select("module", F.col("e.key").alias("type_name"), "e.value.*")
    raw = _array(spark, root, ".hs.types_code.json", "typeName:string,typeLocation:string,typeDefinition:string,line_number:array<int>")
    raw = raw.groupBy("module", F.col("r.typeName").alias("type_name")).agg(F.max("r").alias("r"))
    t = t.join(raw, ["module", "type_name"], "left")
    k = F.lower("typeKind")
    known = F.when(k.isin("data", "type", "newtype", "class", "instance"), k).otherwise("data")
    what = F.when(F.size("dataConstructors") > 1, "sumtype").otherwise(known)

    def field(e: Column) -> Column:
        v = e["value"]
        inner = F.get_json_object(v, "$.structure")
        return F.struct(e["key"].alias("name"), F.coalesce(F.get_json_object(v, "$.raw_code"), F.lit("")).alias("raw"), F.coalesce(inner, v).alias("structure"))

    cons = F.transform(F.coalesce("dataConstructors", F.array()), lambda d: F.struct(F.coalesce(d["dataConNames"], F.col("type_name")).alias("name"), F.transform(F.coalesce(F.map_entries(d["fields"]), F.array()), field).alias("fields")))
    empty = F.filter(cons, lambda x: F.lit(False))
    return t.where("typeKind is not null").select(
        F.col("module").alias("module_name"), "type_name", what.alias("type_of_type"), F.coalesce("r.typeDefinition", F.lit("")).alias("raw_code"), F.coalesce("r.typeLocation", F.lit("")).alias("src_loc"), *_lines("r.line_number"),
        F.when(what.isin("data", "sumtype", "type"), cons).otherwise(empty).alias("constructors"),
    )


def instances(spark: SparkSession, root: str) -> DataFrame:
    r = _array(spark, root, ".hs.instance_code.json", "instanceDefinition:string,instanceType:string,instanceLocation:string,line_number:array<int>")
    return r.select(
        F.col("module").alias("module_name"), F.col("r.instanceDefinition").alias("instance_definition"), F.coalesce("r.instanceType", F.lit("")).alias("instance_signature"), unqualified(F.coalesce("r.instanceType", F.lit(""))).alias("instance_id"),
        F.coalesce("r.instanceLocation", F.lit("")).alias("src_loc"), *_lines("r.line_number"),
    )


def instance_members(inst: DataFrame, funcs: DataFrame, inst_key: str, func_key: str) -> DataFrame:
    """(instance, function): the range join of functions that start within an instance's lines, ends included, of its module."""
    i = inst.select(F.col(inst_key).alias("instance"), F.col("module_name").alias("_m"), F.col("line_number_start").alias("_s"), F.col("line_number_end").alias("_e"))
    f = funcs.select(F.col(func_key).alias("function"), F.col("module_name").alias("_fm"), F.col("line_number_start").alias("_at"))
    return i.join(f, (F.col("_m") == F.col("_fm")) & F.col("_at").between(F.col("_s"), F.col("_e"))).select("instance", "function")
