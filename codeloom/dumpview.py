"""The driver's tables written as compiler dumps, so that readers and resolution can be held against SQL over the same tables.

Parts are functions (their brands are modules), neighbouring lines of an order are calls, conversations are nested functions,
suppliers types, regions classes, nations instances, customers imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.loops import stored
from .sources import resolve

_MODULE = "replace(p_brand, '#', '')"
_FULL = f"concat(replace(p_name, ' ', '_'), '**src/', {_MODULE}, '.hs:', p_size, ':', p_partkey)"


#: Keys of the driver's tables whose records of a module make one text: the texts of a module grow in number, not in length.
PIECE = 20_000


def _file(rows: DataFrame, suffix: str, value, by: str = "i") -> DataFrame:
    """The texts of each module m: its dump in pieces, each a whole object or array, by ranges of a key."""
    rows = rows.withColumn("_s", F.floor(F.col(by) / PIECE))
    if suffix in (".hs.json", ".hs.function_code.json"):  # so many that tasks of few bytes are long
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "m", "_s")
    return rows.groupBy("m", "_s").agg(value.alias("value")).select(F.concat(F.lit("src/"), "m", F.lit(suffix)).alias("path"), "value")


def _object(key: str, value) -> F.Column:
    return F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key), value))))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, value) of all dumps."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    part, line, talk = read("part"), read("lineitem"), read("conversations")
    fn = part.selectExpr("p_partkey as k", f"{_MODULE} as m", f"{_FULL} as full", "p_type as sig")
    a, b = line.selectExpr("l_orderkey as o", "l_linenumber as n", "l_partkey as k"), line.selectExpr("l_orderkey as o", "l_linenumber - 1 as n", "l_partkey as callee")
    callee = part.selectExpr("p_partkey as callee", f"{_MODULE} as module_name", "replace(p_name, ' ', '_') as name")
    calls = a.join(b, ["o", "n"]).select("k", "callee").distinct().join(callee, "callee")
    call = F.struct(F.lit("HsVar").alias("_type"), "name", "module_name", F.lit("p").alias("package_name"), F.lit("x").alias("src_loc"))
    none = F.lit(None).cast("string")
    signature = F.struct(F.col("sig").alias("typeSignature"), F.lit(None).cast("struct<_type:string,name:string,module_name:string,package_name:string,src_loc:string>").alias("expr"))
    made = calls.groupBy("k").agg(F.sort_array(F.collect_set(F.struct(none.alias("typeSignature"), call.alias("expr")))).alias("made"))
    own = fn.join(made, "k", "left").select("m", "k", F.concat(F.lit("$_in$"), "full").alias("key"), F.concat(F.array(signature), F.coalesce("made", F.array().cast(made.schema["made"].dataType))).alias("v"))
    nested = talk.join(fn, F.col("conv_id") == F.col("k")).select("m", "k", F.concat(F.lit("$_in$"), "full", F.lit("::"), "role", "turn", F.lit("**w")).alias("key"), F.array(F.struct(F.col("role").alias("typeSignature"), signature["expr"].alias("expr"))).alias("v"))
    functions = _file(own.union(nested), ".hs.json", _object("key", F.col("v")), "k")
    code = _file(fn.join(part, F.col("k") == F.col("p_partkey")).select("m", "k", "full", F.struct(F.concat(F.lit("body of "), "full").alias("parser_stringified_code"), F.array("p_size", F.col("p_size") + 3).alias("line_number")).alias("v")), ".hs.function_code.json", _object("full", F.col("v")), "k")
    sup = read("supplier").selectExpr("concat('N', s_nationkey) as m", "s_name", "cast(s_suppkey as int) as i")
    target = F.format_string("Supplier#%09d", (F.col("i") * 7 + 3) % 130)
    sup = sup.join(sup.select(F.col("s_name").alias("_t"), F.col("m").alias("_tm")), target == F.col("_t"), "left").drop("_t")  # where the type that a field refers to is
    atom = F.to_json(F.struct(F.lit("AtomicType").alias("tag"), F.struct(F.coalesce("_tm", F.lit("")).alias("moduleName'"), target.alias("typeName'"), F.lit("p").alias("packageName")).alias("contents")))
    kinds = sup.select("m", "i", "s_name", F.struct(F.when(F.col("i") % 3 == 0, "newtype").otherwise("data").alias("typeKind"), F.array(F.struct(F.concat(F.lit("Mk"), "s_name").alias("dataConNames"), F.create_map(F.lit("f"), F.from_json(atom, "tag string, contents struct<`moduleName'`:string,`typeName'`:string,packageName:string>")).alias("fields"))).alias("dataConstructors")).alias("v"))
    types = _file(kinds, ".hs.type.typechecker.json", _object("s_name", F.col("v")))
    raw = _file(sup, ".hs.types_code.json", F.to_json(F.collect_list(F.struct(F.col("s_name").alias("typeName"), F.concat("m", F.lit(".hs")).alias("typeLocation"), F.concat(F.lit("data "), "s_name").alias("typeDefinition"), F.array("i", F.col("i") + 4).alias("line_number")))))
    region = read("region").selectExpr("concat('R', r_regionkey) as m", "r_name", "r_regionkey as i")
    classes = _file(region, ".hs.class_code.json", F.to_json(F.collect_list(F.struct(F.col("r_name").alias("className"), F.concat(F.lit("class "), "r_name").alias("classDefinition"), F.col("m").alias("classLocation"), F.array("i", F.col("i") + 1).alias("line_number")))))
    nation = read("nation").selectExpr("concat('Brand', n_nationkey + 1) as m", "n_name", "n_nationkey as i")
    instances = _file(nation, ".hs.instance_code.json", F.to_json(F.collect_list(F.struct(F.concat(F.lit("instance "), "n_name").alias("instanceDefinition"), F.concat(F.lit("C "), "n_name").alias("instanceType"), F.col("m").alias("instanceLocation"), F.array("i", F.col("i") + 20).alias("line_number")))))
    cust = read("customer").selectExpr("concat('N', c_nationkey) as m", "c_name", "c_mktsegment", "cast(c_custkey as int) as i")
    hiding = F.struct((F.col("i") % 4 == 0).alias("isHiding"), F.array(F.lit("x")).alias("names"))
    imports = _file(cust, ".hs.module_imports.json", F.to_json(F.collect_list(F.struct(F.col("c_mktsegment").alias("moduleName'"), F.lit("p").alias("packageName"), F.col("c_name").alias("asModuleName"), F.lit(False).alias("isImplicit"), F.lit(True).alias("isSafe"), hiding.alias("hidingSpec"), F.struct(F.lit("Qualified").alias("tag")).alias("qualifiedStyle"), F.array("i", "i").alias("line_number")))))
    out = functions
    for more in (code, types, raw, classes, instances, imports):
        out = out.union(more)
    return out


def ingested(spark: SparkSession, sf_dir: str):
    """The catalog that is built from these dumps."""
    return resolve.build(spark, stored(texts(spark, sf_dir)))


#: The same tables by SQL over the driver's. Ids are the ranks of the natural keys.
CTES = """WITH p AS (SELECT p_partkey AS k, replace(p_brand, '#', '') AS m, replace(p_name, ' ', '_') AS name, p_type AS sig, p_size AS line,
  'src/' || replace(p_brand, '#', '') || '.hs:' || CAST(p_size AS VARCHAR) || ':' || CAST(p_partkey AS VARCHAR) AS loc FROM part),
modules AS (SELECT row_number() OVER (ORDER BY name) AS id, name FROM (SELECT m AS name FROM p UNION SELECT 'N' || CAST(s_nationkey AS VARCHAR) FROM supplier UNION SELECT 'R' || CAST(r_regionkey AS VARCHAR) FROM region
  UNION SELECT 'Brand' || CAST(n_nationkey + 1 AS VARCHAR) FROM nation UNION SELECT 'N' || CAST(c_nationkey AS VARCHAR) FROM customer)),
fns AS (SELECT row_number() OVER (ORDER BY m, m || ':' || name || ':' || sig || ':' || loc || ':' || CAST(line AS VARCHAR)) AS id, * FROM p),
made AS (SELECT DISTINCT a.l_partkey AS k, q.m, q.name FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 JOIN p q ON q.k = b.l_partkey),
clear AS (SELECT m, name, min(id) AS id FROM fns GROUP BY m, name HAVING count(*) = 1),
types AS (SELECT row_number() OVER (ORDER BY 'N' || CAST(s_nationkey AS VARCHAR), s_name) AS id, 'N' || CAST(s_nationkey AS VARCHAR) AS m, s_name, CAST(s_suppkey AS INT) AS i,
  'Supplier#' || lpad(CAST((s_suppkey * 7 + 3) % 130 AS VARCHAR), 9, '0') AS ref FROM supplier) """

_ROWS = {
    "module": ("id, name, path", "SELECT id, name, CASE WHEN name LIKE 'Brand%' AND name IN (SELECT m FROM p) THEN 'src/' || name || '.hs.json' ELSE name END AS path FROM modules"),
    "function": ("id, name, function_signature, raw_string, src_loc, module_name, line_number_start, line_number_end, module_id", "SELECT f.id, f.name, sig AS function_signature, 'body of ' || f.name || '**' || loc AS raw_string, loc AS src_loc, m AS module_name, line AS line_number_start, line + 3 AS line_number_end, d.id AS module_id FROM fns f JOIN modules d ON d.name = m"),
    "where_function": ("name, function_signature, parent_function_id, depth", "SELECT role || CAST(turn AS VARCHAR) AS name, role AS function_signature, f.id AS parent_function_id, 1 AS depth FROM conversations JOIN fns f ON f.k = conv_id"),
    "function_called": ("function_id, module_name, name, _type", "SELECT f.id AS function_id, c.m AS module_name, c.name, 'HsVar' AS _type FROM made c JOIN fns f ON f.k = c.k JOIN clear x ON x.id = f.id"),
    "function_dependency": ("caller_id, callee_id", "SELECT DISTINCT f.id AS caller_id, g.id AS callee_id FROM made c JOIN fns f ON f.k = c.k JOIN fns g ON g.m = c.m AND g.name = c.name"),
    "import": ("module_name, package_name, as_module_name, qualified_style, is_hiding, line_number_start, module_id", "SELECT c_mktsegment AS module_name, 'p' AS package_name, c_name AS as_module_name, 'Qualified' AS qualified_style, c_custkey % 4 = 0 AS is_hiding, CAST(c_custkey AS INT) AS line_number_start, d.id AS module_id FROM customer JOIN modules d ON d.name = 'N' || CAST(c_nationkey AS VARCHAR)"),
    "type": ("id, type_name, type_of_type, raw_code, src_loc, line_number_start, line_number_end, module_id", "SELECT t.id, s_name AS type_name, CASE WHEN i % 3 = 0 THEN 'newtype' ELSE 'data' END AS type_of_type, 'data ' || s_name AS raw_code, m || '.hs' AS src_loc, i AS line_number_start, i + 4 AS line_number_end, d.id AS module_id FROM types t JOIN modules d ON d.name = m"),
    "constructor": ("name, type_id", "SELECT 'Mk' || s_name AS name, id AS type_id FROM types WHERE i % 3 <> 0"),
    "field": ("field_name, name", "SELECT 'f' AS field_name, ref AS name FROM types WHERE i % 3 <> 0"),
    "type_dependency": ("dependent_id, dependency_id", "SELECT t.id AS dependent_id, u.id AS dependency_id FROM types t JOIN types u ON u.s_name = t.ref WHERE t.i % 3 <> 0 AND t.id <> u.id"),
    "class": ("class_name, class_definition, line_number_end, module_id", "SELECT r_name AS class_name, 'class ' || r_name AS class_definition, r_regionkey + 1 AS line_number_end, d.id AS module_id FROM region JOIN modules d ON d.name = 'R' || CAST(r_regionkey AS VARCHAR)"),
    "instance": ("instance_definition, instance_signature, line_number_start, line_number_end, module_id", "SELECT 'instance ' || n_name AS instance_definition, 'C ' || n_name AS instance_signature, n_nationkey AS line_number_start, n_nationkey + 20 AS line_number_end, d.id AS module_id FROM nation JOIN modules d ON d.name = 'Brand' || CAST(n_nationkey + 1 AS VARCHAR)"),
    "instance_function": ("signature, function_id", "SELECT 'C ' || n_name AS signature, f.id AS function_id FROM nation JOIN fns f ON f.m = 'Brand' || CAST(n_nationkey + 1 AS VARCHAR) AND f.line BETWEEN n_nationkey AND n_nationkey + 20 JOIN clear x ON x.id = f.id"),
}


def _query(table: str, columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = ingested(spark, sf_dir)
        rows = c[table]
        if table == "field":
            rows = rows.withColumn("name", F.get_json_object("field_type_structure", "$.contents.typeName'"))
        elif table == "instance_function":
            rows = rows.join(c["instance"].select(F.col("id").alias("instance_id"), F.col("instance_signature").alias("signature")), "instance_id")
        return rows.select(*columns)

    return run


QUERIES = {f"ingest_{k}": _query(k, [x.strip() for x in cols.split(",")]) for k, (cols, _) in _ROWS.items()}
ORACLE_SQL = {f"ingest_{k}": CTES + sql for k, (_, sql) in _ROWS.items()}
