"""The driver's tables seen as code: deterministic projections, in DataFrames and in the oracle's SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog

_SQL = {
    "module": "SELECT CAST(row_number() OVER (ORDER BY p_brand) AS BIGINT) AS id, p_brand AS name, 'src/' || p_brand AS path FROM (SELECT DISTINCT p_brand FROM part) b",
    "function": """SELECT p_partkey AS id, p_name AS name, p_type || ' -> ' || p_brand AS function_signature, d.text AS raw_string,
        'src/' || p_brand || '.hs:' || CAST(p_size AS VARCHAR) AS src_loc, p_brand AS module_name, p_size AS line_number_start, p_size + 10 AS line_number_end,
        p_type AS type_enum, m.id AS module_id FROM part JOIN module m ON m.name = p_brand LEFT JOIN documents d ON d.doc_id = p_partkey""",
    "function_dependency": """SELECT DISTINCT a.l_partkey AS caller_id, b.l_partkey AS callee_id FROM lineitem a JOIN lineitem b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1""",
    "where_function": """SELECT conv_id * 100000 + turn AS id, role AS name, text AS raw_string, conv_id AS parent_function_id FROM conversations""",
    "type": """SELECT s_suppkey AS id, s_name AS type_name, 'data ' || s_name AS raw_code, 'src/' || n_name || '.hs' AS src_loc,
        CASE WHEN s_suppkey % 3 = 0 THEN 'newtype' ELSE 'data' END AS type_of_type, CAST(s_suppkey % 40 AS INT) AS line_number_start, CAST(s_suppkey % 40 + 5 + s_suppkey % 7 AS INT) AS line_number_end,
        CAST(s_nationkey + 1 AS BIGINT) AS module_id FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
    "constructor": "SELECT s_suppkey AS id, 'Mk' || s_name AS name, s_suppkey AS type_id FROM supplier",
    "field": """SELECT s_suppkey AS id, 'f' || CAST(s_suppkey AS VARCHAR) AS field_name, 'Supplier#' || lpad(CAST((s_suppkey * 7 + 3) % 130 AS VARCHAR), 9, '0') AS field_type_raw,
        '{"tag":"AtomicType","contents":{"moduleName''":"M","typeName''":"Supplier#' || lpad(CAST((s_suppkey * 7 + 3) % 130 AS VARCHAR), 9, '0') || '","packageName":"p"}}' AS field_type_structure, s_suppkey AS constructor_id
        FROM supplier WHERE s_suppkey % 10 <> 9""",
    "type_dependency": "SELECT s_suppkey AS dependent_id, (s_suppkey * 7 + 3) % 130 AS dependency_id FROM supplier WHERE s_suppkey % 10 <> 9 AND (s_suppkey * 7 + 3) % 130 <> s_suppkey AND (s_suppkey * 7 + 3) % 130 IN (SELECT s_suppkey FROM supplier)",
    "class": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS class_name, 'class ' || r_name AS class_definition, 'src/' || r_name || '.hs' AS src_location, r_regionkey * 10 AS line_number_start, r_regionkey * 10 + 15 AS line_number_end, CAST(r_regionkey + 1 AS BIGINT) AS module_id FROM region",
    "instance": "SELECT CAST(n_nationkey AS BIGINT) AS id, 'instance ' || n_name AS instance_definition, 'C ' || n_name AS instance_signature, 'src/' || n_name || '.hs' AS src_loc, n_nationkey AS line_number_start, n_nationkey + 8 AS line_number_end, CAST(n_regionkey + 1 AS BIGINT) AS module_id FROM nation",
    "import": """SELECT c_custkey AS id, c_mktsegment || '.' || n_name AS module_name, CASE WHEN c_custkey % 5 = 0 THEN n_name END AS as_module_name,
        CASE WHEN c_custkey % 3 = 0 THEN 'Qualified' ELSE 'NotQualified' END AS qualified_style, c_custkey % 4 = 0 AS is_hiding, 'src/' || n_name || '.hs' AS src_loc,
        CAST(c_custkey % 50 AS INT) AS line_number_start, CAST(c_custkey % 50 + c_custkey % 3 AS INT) AS line_number_end, CAST(c_nationkey + 1 AS BIGINT) AS module_id FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "function_called": """SELECT (l_partkey * 10000000 + l_suppkey) * 4 + CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS id, l_partkey AS function_id, m.name AS module_name,
        CASE WHEN l_returnflag = 'N' THEN p_name ELSE s_name END AS name,
        CASE l_returnflag WHEN 'R' THEN 'TyConApp' WHEN 'A' THEN 'FunTy' ELSE 'HsVar' END AS _type, CAST(NULL AS VARCHAR) AS function_signature
        FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem) l
        JOIN supplier ON s_suppkey = l_suppkey JOIN module m ON m.id = (s_nationkey + l_partkey % 2) % 25 + 1 JOIN part ON p_partkey = l_suppkey""",
    "instance_function": """SELECT i.id * 1000000000 + f.id AS id, i.id AS instance_id, f.id AS function_id FROM instance i JOIN function f ON f.module_id = i.module_id
        AND f.line_number_start BETWEEN i.line_number_start AND i.line_number_end""",
}
#: In the order in which one may use another.
ORDER = list(_SQL)


def ctes(*names: str) -> str:
    """WITH clause that defines these tables, and those they use, for the oracle."""
    need = set(names)
    need |= {"function", "instance"} if "instance_function" in need else set()
    need |= {"module"} if {"function", "function_called"} & need else set()
    return "WITH RECURSIVE " + ", ".join(f"{n if n not in ('import', 'type', 'class') else _quoted(n)} AS ({_SQL[n]})" for n in ORDER if n in need)


def _quoted(n: str) -> str:
    return f'"{n}"'


def code_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The same projections as a catalog, each a lazy DataFrame over the Parquet scans."""
    read = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet")
    tables: dict[str, DataFrame] = {}
    # one scan view per driver table; the projections themselves are the SQL above, which both engines read alike
    for n in ("part", "lineitem", "supplier", "nation", "region", "customer", "documents", "conversations"):
        read(n).createOrReplaceTempView(f"codeloom_{n}")
    for n in ORDER:
        # under names of their own, so that no view of the session's is replaced
        text = re.sub(r"\b(FROM|JOIN) (part|lineitem|supplier|nation|region|customer|documents|conversations|module|function|instance)\b", r"\1 codeloom_\2", _SQL[n])
        tables[n] = spark.sql(text.replace("VARCHAR", "STRING").replace("''\"", "\\'\""))
        if n in ("module", "function", "instance"):
            tables[n].createOrReplaceTempView(f"codeloom_{n}")
    tables["import"] = tables["import"].withColumn("hiding_specs", F.lit(None).cast("array<string>"))
    return Catalog(spark, tables)
