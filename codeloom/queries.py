"""Registered queries over the code view of the driver's tables, and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dumpview
from .codeview import code_catalog, ctes
from .operators import aggregates, graphs, lookups, textsim, usage
from .operators.predicates import where_all
from .plans import dsl
from .sources import dumps, export, resolve

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, build: Callable, sql: str | None, *tables: str) -> None:
    """build: from a catalog; sql: over the code view's tables, which are put in front."""
    QUERIES[name] = lambda spark, d: build(code_catalog(spark, d))
    if sql is not None:
        ORACLE_SQL[name] = f"{ctes(*tables)} {sql}" if tables else sql


# predicates, over the functions
_F = "SELECT id, name, type_enum, line_number_start FROM function WHERE "
_PREDICATES = {
    "eq": ("name", "red widget", "name = 'red widget'"),
    "ne": ("type_enum", "ECONOMY", "type_enum <> 'ECONOMY'"),
    "gt": ("line_number_start", 40, "line_number_start > 40"),
    "lt": ("line_number_start", 9, "line_number_start < 9"),
    "ge": ("line_number_start", 44, "line_number_start >= 44"),
    "le": ("line_number_end", 15, "line_number_end <= 15"),
    "like": ("name", "%ring%", "name LIKE '%ring%'"),
    "ilike": ("name", "RED%", "name ILIKE 'RED%'"),
    "in": ("type_enum", ["ECONOMY", "PROMO"], "type_enum IN ('ECONOMY', 'PROMO')"),
    "not_in": ("type_enum", ["ECONOMY", "PROMO"], "type_enum NOT IN ('ECONOMY', 'PROMO')"),
    "contains": ("name", "widget", "contains(name, 'widget')"),
    "startswith": ("name", "blue", "starts_with(name, 'blue')"),
    "endswith": ("name", "ring", "ends_with(name, 'ring')"),
    "between": ("line_number_start", [10, 12], "line_number_start BETWEEN 10 AND 12"),
    "is_null": ("raw_string", True, "raw_string IS NULL"),
}
for _op, (_field, _value, _sql) in _PREDICATES.items():
    _add(f"pred_{_op}", lambda c, o=_op, f=_field, v=_value: where_all(c["function"], [{"field": f, "operator": o, "value": v}]).select("id", "name", "type_enum", "line_number_start"), _F + _sql, "function")

# the query language's joins
_DSL = {
    "dsl_module_type": ({"type": "module", "joins": [{"type": "type", "conditions": [{"field": "type_of_type", "value": "newtype"}]}]}, "SELECT id, name FROM module WHERE id IN (SELECT module_id FROM \"type\" WHERE type_of_type = 'newtype')", ("id", "name"), ("module", "type")),
    "dsl_module_import": ({"type": "module", "joins": [{"type": "import", "conditions": [{"field": "module_name", "operator": "startswith", "value": "BUILD"}]}]}, "SELECT id, name FROM module WHERE id IN (SELECT module_id FROM \"import\" WHERE starts_with(module_name, 'BUILD'))", ("id", "name"), ("module", "import")),
    "dsl_module_class": ({"type": "module", "joins": [{"type": "class"}]}, 'SELECT id, name FROM module WHERE id IN (SELECT module_id FROM "class")', ("id", "name"), ("module", "class")),
    "dsl_module_instance": ({"type": "module", "joins": [{"type": "instance"}]}, "SELECT id, name FROM module WHERE id IN (SELECT module_id FROM instance)", ("id", "name"), ("module", "instance")),
    "dsl_function_module": ({"joins": [{"type": "module", "conditions": [{"field": "name", "operator": "like", "value": "Brand#1_"}]}]}, "SELECT id, name FROM function WHERE module_id IN (SELECT id FROM module WHERE name LIKE 'Brand#1_')", ("id", "name"), ("module", "function")),
    "dsl_where": ({"joins": [{"type": "where_function", "conditions": [{"field": "name", "value": "assistant"}]}]}, "SELECT id, name FROM function WHERE id IN (SELECT parent_function_id FROM where_function WHERE name = 'assistant')", ("id", "name"), ("function", "where_function")),
    "dsl_module_function": ({"type": "module", "conditions": [{"field": "name", "value": "Brand#7"}], "joins": [{"type": "function"}]}, "SELECT id, name FROM function WHERE module_id IN (SELECT id FROM module WHERE name = 'Brand#7')", ("id", "name"), ("module", "function")),
    "dsl_callers": ({"conditions": [{"field": "line_number_start", "value": 7}], "joins": [{"type": "calling_function"}]}, "SELECT id, name FROM function WHERE id IN (SELECT caller_id FROM function_dependency JOIN function f ON f.id = callee_id WHERE f.line_number_start = 7)", ("id", "name"), ("function", "function_dependency")),
    "dsl_nested_callers": ({"type": "module", "conditions": [{"field": "name", "value": "Brand#3"}], "joins": [{"type": "function", "joins": [{"type": "called_by"}]}]}, "SELECT id, name FROM function WHERE id IN (SELECT caller_id FROM function_dependency JOIN function f ON f.id = callee_id WHERE f.module_name = 'Brand#3')", ("id", "name"), ("function", "function_dependency")),
    "dsl_callees": ({"joins": [{"type": "called_function", "conditions": [{"field": "line_number_start", "operator": "lt", "value": 3}]}]}, "SELECT id, name FROM function WHERE id IN (SELECT caller_id FROM function_dependency JOIN function f ON f.id = callee_id WHERE f.line_number_start < 3)", ("id", "name"), ("function", "function_dependency")),
}
for _name, (_q, _sql, _cols, _tables) in _DSL.items():
    _add(_name, lambda c, q=_q, k=_cols: dsl.execute(c, q).select(*k), _sql, *_tables)

# lookups
_add("all_modules", lambda c: lookups.all_modules(c).select("id", "name", "path"), "SELECT id, name, path FROM module", "module")
_add("module_by_name", lambda c: lookups.module_by_name(c, "Brand#5").select("id", "name"), "SELECT id, name FROM module WHERE name = 'Brand#5'", "module")
_add("functions_by_module", lambda c: lookups.functions_by_module(c, 3).select("id", "name"), "SELECT id, name FROM function WHERE module_id = 3", "function")
_add("function_by_name", lambda c: lookups.function_by_name(c, "blue plate", 25).select("id", "name"), "SELECT id, name FROM function WHERE name = 'blue plate' AND module_id = 25", "function")
for _k in ("type", "class", "import", "instance"):
    _add(f"children_{_k}", lambda c, k=_k: lookups.children_of_module(c, k, "Brand#1").select("id"), f"SELECT id FROM \"{_k}\" WHERE module_id IN (SELECT id FROM module WHERE name = 'Brand#1')", "module", _k)
_PAIRS = "array_to_string(list_transform(list_sort(list({{'id': {i}, 'name': {n}}})), lambda x: CAST(x.id AS VARCHAR) || ':' || x.name), ',')"


def _joined(col: str):
    return F.array_join(F.transform(col, lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["name"])), ",").alias(col)


_add("function_details", lambda c: lookups.function_details(c).select("id", "name", "module", *[_joined(x) for x in ("where_functions", "calls", "called_by")]), f"""SELECT f.id, f.name, f.module_name AS module, coalesce(w.s, '') AS where_functions, coalesce(a.s, '') AS calls, coalesce(b.s, '') AS called_by FROM function f
LEFT JOIN (SELECT parent_function_id AS k, {_PAIRS.format(i='id', n='name')} AS s FROM where_function GROUP BY 1) w ON w.k = f.id
LEFT JOIN (SELECT caller_id AS k, {_PAIRS.format(i='callee_id', n='g.name')} AS s FROM function_dependency JOIN function g ON g.id = callee_id GROUP BY 1) a ON a.k = f.id
LEFT JOIN (SELECT callee_id AS k, {_PAIRS.format(i='caller_id', n='g.name')} AS s FROM function_dependency JOIN function g ON g.id = caller_id GROUP BY 1) b ON b.k = f.id""", "function", "where_function", "function_dependency")  # fmt: skip
_add("content_search", lambda c: lookups.search_content(c, "éTION").select("id"), "SELECT id FROM function WHERE contains(lower(raw_string), 'étion')", "function")
_add("regex_search", lambda c: lookups.types_by_name(c, "Supplier#000000007", r"NATION_\d+").select("id", "src_loc"), "SELECT id, src_loc FROM \"type\" WHERE type_name = 'Supplier#000000007' AND regexp_matches(src_loc, 'NATION_[0-9]+')", "type")
_add("find_module", lambda c: lookups.find_module(c, "brand#2%").select("id", "name"), "SELECT id, name FROM module WHERE name ILIKE 'brand#2%'", "module")
_add("instances_per_module", lambda c: lookups.instances_per_module(c, "Brand#10").select("id", "in_module"), "SELECT i.id, m.name AS in_module FROM instance i JOIN module m ON m.id = module_id WHERE m.name = 'Brand#10'", "module", "instance")
_add("type_in_module", lambda c: lookups.type_in_module(c, "Supplier#000000002", "Brand#24").select("id", "in_module"), "SELECT t.id, m.name AS in_module FROM \"type\" t JOIN module m ON m.id = module_id WHERE m.name = 'Brand#24' AND type_name = 'Supplier#000000002'", "module", "type")
_add("function_in_module", lambda c: lookups.function_in_module(c, "red widget", "BRAND#1%").select("id", "in_module"), "SELECT f.id, m.name AS in_module FROM function f JOIN module m ON m.id = module_id WHERE m.name ILIKE 'BRAND#1%' AND f.name = 'red widget'", "module", "function")
_add("class_in_module", lambda c: lookups.class_in_module(c, "AFRICA", "Brand#1").select("id", "in_module"), "SELECT c.id, m.name AS in_module FROM \"class\" c JOIN module m ON m.id = module_id WHERE m.name IN ('Brand#1', 'Brand#1.hs') AND class_name = 'AFRICA'", "module", "class")
_add("function_at", lambda c: lookups.function_at(c, "brand#12.hs", 20).select("id", "line_number_start"), "SELECT id, line_number_start FROM function WHERE contains(lower(src_loc), 'brand#12.hs') AND line_number_start <= 20 ORDER BY line_number_start DESC, id LIMIT 1", "function")
for _k, _loc in (("type", "src_loc"), ("import", "src_loc"), ("class", "src_location")):
    _part, _line = "asia.hs" if _k == "class" else "nation_3.hs", 31 if _k == "type" else 21
    _add(f"{_k}_at", lambda c, k=_k, p=_part, n=_line: lookups.element_at(c, k, p, n).select("id", "line_number_start"), f"SELECT id, line_number_start FROM \"{_k}\" WHERE contains(lower({_loc}), '{_part}') AND line_number_start <= {_line} AND line_number_end >= {_line} ORDER BY line_number_start DESC, id LIMIT 1", _k)


def _asof(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    probes, targets = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    return lookups.asof_join(probes, targets, "user_id", "ts", "ts", "event_id").select("event_id", "target_id")


QUERIES["asof_lookup"] = _asof
ORACLE_SQL["asof_lookup"] = "SELECT p.event_id, t.event_id AS target_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') t ON p.user_id = t.user_id AND p.ts >= t.ts"


def _interval(c) -> DataFrame:
    probes = c["function"].select(F.col("id").alias("function_id"), F.col("module_id").alias("m"), F.col("line_number_start").alias("line"))
    types = c["type"].select("id", F.col("module_id").alias("m"), "line_number_start", "line_number_end")
    return lookups.innermost_join(probes, types, "m", "line", "line_number_start", "line_number_end", "function_id", "id").select("function_id", "target_id")


_add("interval_lookup", _interval, """SELECT f.id AS function_id, (SELECT t.id FROM "type" t WHERE t.module_id = f.module_id AND f.line_number_start BETWEEN t.line_number_start AND t.line_number_end
ORDER BY t.line_number_start DESC, t.id LIMIT 1) AS target_id FROM function f""", "function", "type")
_add("type_document", lambda c: lookups.type_document(c).select("id", "type_name", F.to_json("constructors").alias("constructors")).select("id", "type_name", F.regexp_count("constructors", F.lit("field_name")).cast("bigint").alias("n_fields"), F.get_json_object("constructors", "$[0].name").alias("first_constructor")), """SELECT t.id, type_name, count(f.id) AS n_fields, min(k.name) AS first_constructor FROM "type" t LEFT JOIN constructor k ON k.type_id = t.id LEFT JOIN field f ON f.constructor_id = k.id GROUP BY 1, 2""", "type", "constructor", "field")

# aggregates and patterns
_add("most_called", aggregates.most_called, "SELECT f.id, f.name, f.module_name AS module, count(*) AS calls FROM function_dependency JOIN function f ON f.id = callee_id GROUP BY 1, 2, 3 ORDER BY calls DESC, f.id LIMIT 10", "function", "function_dependency")
_add("outgoing_calls", aggregates.outgoing_calls, "SELECT f.id, f.name, count(*) AS calls FROM function_dependency JOIN function f ON f.id = caller_id GROUP BY 1, 2 ORDER BY calls DESC, f.id LIMIT 20", "function", "function_dependency")
_CROSS = "SELECT a.module_id AS caller_module_id, a.module_name AS caller_module, b.module_id AS callee_module_id, b.module_name AS callee_module, count(*) AS calls FROM function_dependency JOIN function a ON a.id = caller_id JOIN function b ON b.id = callee_id WHERE a.module_id <> b.module_id GROUP BY 1, 2, 3, 4"
_add("cross_module_deps", aggregates.cross_module_dependencies, _CROSS, "function", "function_dependency")
_add("module_coupling", aggregates.module_coupling, f"""SELECT m.id, m.name, CAST(coalesce(i, 0) AS BIGINT) AS incoming, CAST(coalesce(o, 0) AS BIGINT) AS outgoing, CAST(coalesce(i, 0) + coalesce(o, 0) AS BIGINT) AS total FROM module m
LEFT JOIN (SELECT callee_module_id AS k, sum(calls) AS i FROM ({_CROSS}) GROUP BY 1) x ON x.k = m.id LEFT JOIN (SELECT caller_module_id AS k, sum(calls) AS o FROM ({_CROSS}) GROUP BY 1) y ON y.k = m.id""", "module", "function", "function_dependency")  # fmt: skip
_add("call_pairs", lambda c: aggregates.pattern_match(c, {"type": "function_call", "caller": "RED", "callee": "ring"}), "SELECT caller_id, a.name AS caller, a.module_name AS caller_module, callee_id, b.name AS callee, b.module_name AS callee_module FROM function_dependency JOIN function a ON a.id = caller_id JOIN function b ON b.id = callee_id WHERE a.name ILIKE '%red%' AND b.name ILIKE '%ring%'", "function", "function_dependency")
_add("type_usage", lambda c: aggregates.pattern_match(c, {"type": "type_usage", "type_name": "promo"}), "SELECT id, name, function_signature ILIKE '%promo%' AS in_signature, coalesce(contains(lower(raw_string), 'promo'), false) AS in_code FROM function WHERE function_signature ILIKE '%promo%' OR contains(lower(raw_string), 'promo')", "function")
_add("nested_functions", lambda c: aggregates.pattern_match(c, {"type": "code_structure", "structure_type": "nested_function"}).select("id", "name", "n_nested", _joined("nested")), f"SELECT f.id, f.name, count(*) AS n_nested, {_PAIRS.format(i='w.id', n='w.name')} AS nested FROM function f JOIN where_function w ON w.parent_function_id = f.id GROUP BY 1, 2", "function", "where_function")
_add("line_count_topk", aggregates.line_counts, "SELECT id, name, line_number_end - line_number_start + 1 AS n_lines FROM function ORDER BY n_lines DESC, id LIMIT 20", "function")
_add("entity_stats", aggregates.entity_stats, " UNION ALL ".join(f"SELECT '{k}' AS entity, count(*) AS n FROM \"{k}\"" for k in ("module", "function", "where_function", "type", "class", "instance", "import")), "module", "function", "where_function", "type", "class", "instance", "import")
_add("having_left_join", lambda c: aggregates.busy_functions(c, 20), "SELECT f.id, f.name, f.module_name AS module, count(callee_id) AS n_calls FROM function f LEFT JOIN function_dependency ON caller_id = f.id GROUP BY 1, 2, 3 HAVING count(callee_id) >= 20", "function", "function_dependency")
_add("custom_sql", lambda c: c.sql("SELECT m.name, count(*) AS n FROM function f JOIN module m ON m.id = f.module_id WHERE f.line_number_start >= :least GROUP BY m.name", {"least": 30}), "SELECT module_name AS name, count(*) AS n FROM function WHERE line_number_start >= 30 GROUP BY 1", "function")

# graphs and texts
_add("call_graph_depth2", lambda c: graphs.call_graph(c, 5, 2), """, e AS (SELECT * FROM function_dependency WHERE caller_id <> callee_id)
SELECT CAST(5 AS BIGINT) AS root, 1 AS depth, caller_id, callee_id FROM e WHERE caller_id = 5 AND 5 IN (SELECT id FROM function) UNION ALL
SELECT 5, 2, caller_id, callee_id FROM e WHERE caller_id IN (SELECT callee_id FROM e WHERE caller_id = 5)""", "function", "function_dependency")  # fmt: skip
_add("call_graph_recursive_sql", lambda c: c.sql("""WITH RECURSIVE h(caller_id, callee_id, depth) AS (SELECT caller_id, callee_id, 1 FROM function_dependency WHERE caller_id = 7 UNION ALL
SELECT d.caller_id, d.callee_id, h.depth + 1 FROM h JOIN function_dependency d ON d.caller_id = h.callee_id WHERE h.depth < 3) SELECT depth, count(*) AS n FROM h GROUP BY depth"""), """, h(caller_id, callee_id, depth) AS (SELECT caller_id, callee_id, 1 FROM function_dependency WHERE caller_id = 7 UNION ALL
SELECT d.caller_id, d.callee_id, h.depth + 1 FROM h JOIN function_dependency d ON d.caller_id = h.callee_id WHERE h.depth < 3) SELECT depth, count(*) AS n FROM h GROUP BY depth""", "function_dependency")  # fmt: skip
_NODES = "src_loc || ':' || type_name"
_TYPE_EDGES = f""", refs AS (SELECT t.src_loc || ':' || t.type_name AS src, f.field_type_raw AS ref FROM "type" t JOIN constructor k ON k.type_id = t.id JOIN field f ON f.constructor_id = k.id),
type_graph AS (SELECT src, coalesce(x.src_loc || ':' || x.type_name, ref) AS dst FROM refs LEFT JOIN "type" x ON x.type_name = ref
UNION SELECT t.src_loc || ':' || t.type_name, k.name FROM "type" t JOIN constructor k ON k.type_id = t.id WHERE k.id NOT IN (SELECT constructor_id FROM field))"""
_add("type_graph", graphs.type_graph, f"{_TYPE_EDGES} SELECT DISTINCT src, dst FROM type_graph", "type", "constructor", "field")
_add("reachability", lambda c: graphs.reachable(graphs.type_graph(c), graphs.type_nodes(c).where("type_name = 'Supplier#000000004'").select("node")), f"""{_TYPE_EDGES}, seen(node) AS (SELECT {_NODES} FROM "type" WHERE type_name = 'Supplier#000000004' UNION SELECT dst FROM seen JOIN type_graph ON src = node) SELECT node FROM seen""", "type", "constructor", "field")
_SEEN = """, seen(node) AS (SELECT src_loc || ':' || type_name FROM "type" WHERE {0} UNION SELECT dst FROM seen JOIN type_graph ON src = node WHERE dst IN (SELECT src_loc || ':' || type_name FROM "type"))"""


def _sub(c) -> DataFrame:
    """The subgraph of one type in whichever module has it."""
    first = graphs.type_nodes(c).where("type_name = 'Supplier#000000004'").select("module").first()
    return graphs.type_subgraph(c, "Supplier#000000004", first[0] if first else "", "NATION_1")


_add("type_subgraph", _sub, _TYPE_EDGES + _SEEN.format("type_name = 'Supplier#000000004'") + " SELECT node FROM seen WHERE contains(node, 'NATION_1')", "type", "constructor", "field")
_add("nested_type_bodies", lambda c: graphs.nested_type_bodies(c, ["Supplier#000000004", "Supplier#000000011"], "Brand#", "NATION_9"), _TYPE_EDGES + _SEEN.format("type_name IN ('Supplier#000000004', 'Supplier#000000011')") + """ SELECT DISTINCT raw_code FROM "type" WHERE type_name IN ('Supplier#000000004', 'Supplier#000000011')
OR (contains(src_loc || ':' || type_name, 'Brand#') AND src_loc || ':' || type_name IN (SELECT node FROM seen) AND NOT contains(src_loc, 'NATION_9'))""", "type", "constructor", "field")
_TOK = "list_distinct(list_filter(regexp_split_to_array(coalesce({0}, ''), '\\s+'), lambda x: x <> ''))"
_SHARE = "len(list_intersect({a}, {b})) / greatest(len({a}), 1)"
_sig, _raw = (_SHARE.format(a=_TOK.format(f"r.{x}"), b=_TOK.format(f"f.{x}")) for x in ("function_signature", "raw_string"))
_add("similar_functions", lambda c: textsim.similar_functions(c, 3, 0.4), f"""SELECT id, name, similarity FROM (SELECT f.id, f.name, round(0.4 * {_sig} + 0.6 * {_raw}, 6) AS similarity FROM function f, (SELECT * FROM function WHERE id = 3) r
WHERE f.id <> 3 AND (contains(lower(f.function_signature), lower(r.function_signature[1:5])) OR contains(lower(f.raw_string), lower(r.raw_string[1:10])) OR length(coalesce(r.raw_string, '')) < 10)) WHERE similarity >= 0.2""", "function")  # fmt: skip
_CODE_SQL = """, p AS (SELECT * FROM (VALUES (0, 'the thing'), (1, 'and'), (2, 'of')) v(j, pat)),
l AS (SELECT id, unnest(string_split(raw_string, chr(10))) AS raw, unnest(range(len(string_split(raw_string, chr(10))))) AS k, len(string_split(raw_string, chr(10))) AS n FROM function WHERE raw_string IS NOT NULL),
t AS (SELECT id, k, n, trim(raw, ' ' || chr(9) || chr(10) || chr(13)) AS x FROM l),
w AS (SELECT id, k - j AS i, count(*) AS hits FROM t, p WHERE x <> '' AND (contains(x, pat) OR contains(pat, x)) AND k - j BETWEEN 0 AND n - 2 GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT id, count(*) AS n_windows, CAST(sum(hits) AS BIGINT) AS n_lines FROM w GROUP BY 1"""
_add("code_patterns", lambda c: textsim.code_patterns(c, "the thing\nand\nof", 2).select("id", F.col("n_windows").cast("bigint").alias("n_windows"), F.size("lines").cast("bigint").alias("n_lines")), _CODE_SQL, "function")
_LINES = "list_distinct(string_split(raw_string, chr(10)))"
_PAIRS_SQL = f""", s AS (SELECT id, {_LINES} AS l FROM function WHERE raw_string <> ''), e AS (SELECT id, len(l) AS n, unnest(l) AS x FROM s),
pairs AS (SELECT a.id AS a, b.id AS b, round(count(*) / (a.n + b.n - count(*)), 6) AS similarity FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.7)"""
_add("similar_pairs", textsim.similar_pairs, f"{_PAIRS_SQL} SELECT a, b, similarity FROM pairs", "function")
_add("group_similar", textsim.group_similar, f"""{_PAIRS_SQL}, nodes AS (SELECT id, row_number() OVER (ORDER BY id) AS k, coalesce((SELECT list(a) FROM pairs WHERE b = id), []) AS before FROM (SELECT a AS id FROM pairs UNION SELECT b FROM pairs)),
steps(k, seeds) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]) UNION ALL SELECT n.k, CASE WHEN list_has_any(s.seeds, n.before) THEN s.seeds ELSE list_append(s.seeds, n.id) END FROM steps s JOIN nodes n ON n.k = s.k + 1),
seeds AS (SELECT unnest(seeds) AS seed FROM (SELECT seeds FROM steps ORDER BY k DESC LIMIT 1)),
members AS (SELECT b AS id, min(a) AS group_id FROM pairs JOIN seeds ON seed = a WHERE b NOT IN (SELECT seed FROM seeds) GROUP BY b)
SELECT group_id, m.id, f.name FROM (SELECT group_id, id FROM members UNION SELECT group_id, group_id FROM members) m JOIN function f ON f.id = m.id""", "function")
_WORDS = " + ".join(f"(length(raw_string) - length(replace(raw_string, '{k}', ''))) // {len(k)}" for k in ("if", "case", "of", "where", "let", "do", "->", "| "))
_add("complexity", textsim.complex_functions, f"""SELECT * FROM (SELECT f.id, f.name, CAST(1 + {_WORDS} + coalesce(c.n, 0) + coalesce(w.n, 0) AS BIGINT) AS complexity, CAST(coalesce(c.n, 0) AS BIGINT) AS n_calls, CAST(coalesce(w.n, 0) AS BIGINT) AS n_where FROM function f
LEFT JOIN (SELECT caller_id AS k, count(*) AS n FROM function_dependency GROUP BY 1) c ON c.k = f.id LEFT JOIN (SELECT parent_function_id AS k, count(*) AS n FROM where_function GROUP BY 1) w ON w.k = f.id WHERE raw_string IS NOT NULL) WHERE complexity >= 10""", "function", "function_dependency", "where_function")  # fmt: skip

# usage
_add("types_used", usage.types_used, """SELECT DISTINCT c.function_id, c.module_name, c.name AS type_name, t.id AS type_id FROM function_called c
LEFT JOIN (SELECT t.id, type_name, m.name AS mn FROM "type" t JOIN module m ON m.id = module_id) t ON t.type_name = c.name AND t.mn = c.module_name WHERE _type IN ('TyConApp', 'FunTy')""", "module", "type", "function_called")  # fmt: skip
_add("functions_used", usage.functions_used, """SELECT c.function_id, c.module_name, c.name AS function_name, CAST(NULL AS VARCHAR) AS type_signature, f.id AS used_id FROM (SELECT DISTINCT function_id, module_name, name FROM function_called WHERE _type <> 'TyConApp') c
LEFT JOIN function f ON f.name = c.name AND lower(f.module_name) = lower(c.module_name)""", "function", "function_called")  # fmt: skip
_add("imports_for_element", lambda c: usage.imports_for_element(c, "NATION_3", "Brand#12").select("statement"), """SELECT DISTINCT 'import ' || CASE WHEN qualified_style = 'Qualified' THEN 'qualified ' ELSE '' END || module_name || CASE WHEN as_module_name IS NOT NULL THEN ' as ' || as_module_name ELSE '' END AS statement
FROM "import" WHERE module_id = (SELECT id FROM module WHERE name = 'Brand#12') AND (contains(module_name, 'NATION_3') OR as_module_name = 'NATION_3')""", "module", "import")  # fmt: skip
_add("element_prompts", lambda c: usage.element_prompts(c, "function"), "SELECT id, CASE WHEN coalesce(function_signature, '') <> '' AND NOT contains(name, '$$') THEN name || ' :: ' || function_signature || chr(10) || coalesce(raw_string, '') END AS prompt FROM function", "function")

# name resolution, range join, paths and the property graph
_add("unambiguous_names", lambda c: resolve.unambiguous(c["function"].select("module_name", "name", "id")), "SELECT module_name, name, min(id) AS id FROM function GROUP BY 1, 2 HAVING count(*) = 1", "function")


def _resolved(c) -> DataFrame:
    f = c["function"].withColumn("full_key", F.concat_ws(":", "module_name", "name"))
    calls = c["function_called"].join(f.select(F.col("id").alias("function_id"), "full_key"), "function_id").select("full_key", "module_name", "name")
    return resolve.call_edges(f.select("id", "full_key"), calls, f)


_add("name_resolution_edges", _resolved, """SELECT DISTINCT g.id AS caller_id, h.id AS callee_id FROM function_called c JOIN function o ON o.id = c.function_id JOIN function g ON g.module_name = o.module_name AND g.name = o.name
JOIN function h ON h.module_name = c.module_name AND h.name = c.name""", "function", "function_called")  # fmt: skip


def _members(c) -> DataFrame:
    named = c["instance"].join(c["module"].select(F.col("id").alias("module_id"), F.col("name").alias("module_name")), "module_id")
    return dumps.instance_members(named, c["function"], "id", "id")


_add("range_join_members", _members, "SELECT i.id AS instance, f.id AS function FROM instance i JOIN function f ON f.module_id = i.module_id AND f.line_number_start BETWEEN i.line_number_start AND i.line_number_end", "function", "instance")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    u = spark.read.parquet(f"{d}/pages.parquet")
    return u.select("page_id", dumps.module_name(F.concat(F.lit("pkg/dist/build/autogen/src/"), F.regexp_replace("url", "^https?://", ""), F.lit(".hs.json"))).alias("module"))


QUERIES["path_to_module"] = _paths
ORACLE_SQL["path_to_module"] = "SELECT page_id, replace(list_last(string_split(replace(regexp_replace(url, '^https?://', '') || '.hs.json', '.hs.json', ''), 'src/')), '/', '.') AS module FROM pages"


def _words(c) -> DataFrame:
    return c["import"].select("id", dumps.unqualified(F.concat("module_name", F.lit(" "), "src_loc")).alias("short"))


_add("qualified_prefix_removal", _words, "SELECT id, list_last(string_split(module_name, '.')) || ' ' || list_last(string_split(src_loc, '.')) AS short FROM \"import\"", "import")
_GRAPH = """, fn AS (SELECT f.id, m.name AS module, m.name || ':' || f.name AS nid FROM function f JOIN module m ON m.id = f.module_id),
ty AS (SELECT t.id, m.name AS module, m.name || ':' || type_name AS nid FROM "type" t JOIN module m ON m.id = t.module_id),
cl AS (SELECT m.name AS module, m.name || ':' || class_name AS nid FROM "class" c JOIN module m ON m.id = c.module_id),
ins AS (SELECT i.id, m.name AS module, m.name || ':' || instance_definition AS nid FROM instance i JOIN module m ON m.id = i.module_id),
im AS (SELECT m.name AS module, i.module_name AS target, md5(m.name || ':' || CAST(line_number_start AS VARCHAR) || ':' || i.module_name || '::' || coalesce(as_module_name, '')) AS nid FROM "import" i JOIN module m ON m.id = i.module_id),
k AS (SELECT c.id, ty.nid AS tid, ty.nid || '::' || c.name AS nid FROM constructor c JOIN ty ON ty.id = c.type_id),
fd AS (SELECT k.nid AS kid, k.nid || '.' || field_name AS nid, 'M:' || field_type_raw AS ref FROM field f JOIN k ON k.id = f.constructor_id),
wh AS (SELECT fn.nid AS fid, fn.nid || '.' || w.name AS nid FROM where_function w JOIN fn ON fn.id = w.parent_function_id),
made AS (SELECT fn.nid AS fid, c.module_name || ':' || c.name AS nid FROM function_called c JOIN fn ON fn.id = c.function_id),
members AS (SELECT ins.nid AS iid, fn.nid AS fid FROM instance_function x JOIN ins ON ins.id = x.instance_id JOIN fn ON fn.id = x.function_id)"""
_ALL = ("module", "function", "where_function", "type", "constructor", "field", "class", "instance", "import", "function_called", "instance_function")
_add("graph_nodes", lambda c: export.property_graph(_full(c))[0].select("id", "label"), _GRAPH + """ SELECT name AS id, 'Module' AS label FROM module UNION SELECT target, 'Module' FROM im UNION SELECT nid, 'Function' FROM fn
UNION SELECT module_name || ':' || name, 'Function' FROM function_called UNION SELECT nid, 'WhereFunction' FROM wh UNION SELECT nid, 'Type' FROM ty UNION SELECT nid, 'Constructor' FROM k UNION SELECT nid, 'Field' FROM fd
UNION SELECT nid, 'Class' FROM cl UNION SELECT nid, 'Instance' FROM ins UNION SELECT nid, 'ImportRecord' FROM im""", *_ALL)
_add("graph_edges", lambda c: export.property_graph(_full(c))[1].select("src", "dst", "type"), _GRAPH + """ SELECT module AS src, nid AS dst, 'HAS_FUNCTION' AS type FROM fn UNION SELECT module, nid, 'HAS_TYPE' FROM ty UNION SELECT module, nid, 'HAS_CLASS' FROM cl
UNION SELECT module, nid, 'HAS_INSTANCE' FROM ins UNION SELECT module, nid, 'DECLARES_IMPORT' FROM im UNION SELECT nid, module, 'DEFINED_IN' FROM fn UNION SELECT nid, module, 'DEFINED_IN' FROM ty
UNION SELECT nid, module, 'DEFINED_IN' FROM cl UNION SELECT nid, module, 'DEFINED_IN' FROM ins UNION SELECT tid, nid, 'HAS_CONSTRUCTOR' FROM k UNION SELECT kid, nid, 'HAS_FIELD' FROM fd
UNION SELECT nid, ref, 'USES_TYPE' FROM fd UNION SELECT nid, ref, 'HAS_ATOMIC_TYPE' FROM fd UNION SELECT nid, target, 'IMPORTS_MODULE' FROM im UNION SELECT fid, nid, 'CALLS' FROM made
UNION SELECT fid, nid, 'DEFINES_WHERE' FROM wh UNION SELECT iid, fid, 'IMPLEMENTS' FROM members""", *_ALL)
_DASH = "regexp_replace({0}, '^([^:]*):', '\\1--') AS {0}"
_add("light_graph", lambda c: export.light_graph(_full(c))[1].select("src", "dst", "type"), f"""{_GRAPH}, light AS (SELECT tid AS src, nid AS dst, 'HAS_CONSTRUCTOR' AS type FROM k UNION SELECT kid, nid, 'HAS_FIELD' FROM fd UNION SELECT nid, ref, 'USES_TYPE' FROM fd UNION SELECT fid, nid, 'calls' FROM made)
SELECT {_DASH.format('src')}, {_DASH.format('dst')}, type FROM light""", *_ALL)


def _full(c):
    """The code view with the columns that it has no data for, as nulls."""
    from .catalog import Catalog
    from .schema import SCHEMAS

    out = {}
    for k, s in SCHEMAS.items():
        if k in c.tables:
            have = c[k]
            out[k] = have.select(*[(F.col(f"`{f.name}`") if f.name in have.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in s])
    return Catalog(c.spark, out)

# plain SQL over the views, the same text for both engines
_COOKBOOK = {
    "sql_modules_sorted": ("SELECT id, name FROM module WHERE path LIKE 'src/%' ORDER BY name", ("module",)),
    "sql_functions_of_module": ("SELECT f.id, f.name, m.name AS module FROM function f JOIN module m ON f.module_id = m.id WHERE m.name = 'Brand#8' ORDER BY f.line_number_start, f.id", ("module", "function")),
    "sql_nested_of_one": ("SELECT w.id, w.name FROM where_function w WHERE w.parent_function_id = (SELECT max(f.id) FROM function f WHERE f.name = 'red widget' AND f.id < 50)", ("function", "where_function")),
    "sql_callers_of": ("SELECT a.id AS caller_id, ma.name AS caller_module FROM function_dependency d JOIN function a ON a.id = d.caller_id JOIN function b ON b.id = d.callee_id JOIN module ma ON ma.id = a.module_id JOIN module mb ON mb.id = b.module_id WHERE b.name = 'hot rod' AND mb.name = 'Brand#16'", ("module", "function", "function_dependency")),
    "sql_callees_of": ("SELECT DISTINCT b.id AS callee_id, b.name FROM function_dependency d JOIN function a ON a.id = d.caller_id JOIN function b ON b.id = d.callee_id WHERE a.id = 11", ("function", "function_dependency")),
    "sql_type_fields": ('SELECT t.type_name, k.name AS constructor, f.field_name, f.field_type_raw FROM "type" t JOIN constructor k ON k.type_id = t.id JOIN field f ON f.constructor_id = k.id WHERE t.module_id = 6', ("type", "constructor", "field")),
    "sql_imports_of": ('SELECT i.id, i.module_name, i.as_module_name FROM "import" i WHERE i.module_id = (SELECT m.id FROM module m WHERE m.name = \'Brand#14\')', ("module", "import")),
    "sql_text_pattern": ("SELECT f.id, f.name FROM function f WHERE f.raw_string LIKE '%the thing%'", ("function",)),
    "sql_classes_with_modules": ('SELECT c.class_name, m.name AS module FROM "class" c JOIN module m ON m.id = c.module_id', ("module", "class")),
    "sql_most_called": ("SELECT f.id, min(f.name) AS name, min(m.name) AS module, count(*) AS n_callers FROM function_dependency d JOIN function f ON d.callee_id = f.id JOIN module m ON m.id = f.module_id GROUP BY f.id ORDER BY n_callers DESC, f.id LIMIT 10", ("module", "function", "function_dependency")),
    "sql_cross_modules": ("SELECT ma.name AS from_module, mb.name AS to_module, count(*) AS n FROM function_dependency d JOIN function a ON d.caller_id = a.id JOIN module ma ON ma.id = a.module_id JOIN function b ON d.callee_id = b.id JOIN module mb ON mb.id = b.module_id WHERE ma.id <> mb.id GROUP BY ma.name, mb.name", ("module", "function", "function_dependency")),
    "sql_longest": ("SELECT f.id, f.name, m.name AS module, f.line_number_end - f.line_number_start AS n_lines FROM module m JOIN function f ON m.id = f.module_id WHERE f.line_number_end > 0 AND f.line_number_start > 0 ORDER BY n_lines DESC, f.id LIMIT 20", ("module", "function")),
    "sql_most_calling": ("SELECT f.id, min(f.name) AS name, min(m.name) AS module, count(*) AS n_callees FROM function_dependency d JOIN function f ON d.caller_id = f.id JOIN module m ON m.id = f.module_id GROUP BY f.id ORDER BY n_callees DESC, f.id LIMIT 20", ("module", "function", "function_dependency")),
    "sql_instances_functions": ("SELECT m.name AS module, i.instance_signature, f.id AS function_id, f.name AS function FROM instance_function x JOIN function f ON x.function_id = f.id JOIN instance i ON x.instance_id = i.id JOIN module m ON m.id = i.module_id", ("module", "function", "instance", "instance_function")),
    "sql_statistics": ('SELECT \'modules\' AS what, count(*) AS n FROM module UNION ALL SELECT \'types\', count(*) FROM "type" UNION ALL SELECT \'functions\', count(*) FROM function UNION ALL SELECT \'nested\', count(*) FROM where_function UNION ALL SELECT \'calls\', count(*) FROM function_dependency UNION ALL SELECT \'instances\', count(*) FROM instance UNION ALL SELECT \'classes\', count(*) FROM "class"', ("module", "function", "where_function", "type", "class", "instance", "function_dependency")),
    "sql_module_imports_left": ('SELECT m.name, count(i.id) AS n_imports FROM module m LEFT JOIN "import" i ON i.module_id = m.id GROUP BY m.id, m.name HAVING count(i.id) >= 1', ("module", "import")),
}
for _name, (_text, _tables) in _COOKBOOK.items():
    _add(_name, lambda c, t=_text: c.sql(t.replace('"type"', "type").replace('"import"', "import").replace('"class"', "class")), _text, *_tables)


def _texts(c) -> DataFrame:
    from .functions.typeast import is_atomic_column, refs_column, text_column

    s = "field_type_structure"
    return c["field"].select("id", text_column(s).alias("text"), is_atomic_column(s).alias("atomic"), *[F.get(refs_column(s, k), F.lit(0))["name"].alias(k) for k in ("loader", "query", "graph")])


_add("field_types", _texts, "SELECT id, field_type_raw AS text, true AS atomic, field_type_raw AS loader, field_type_raw AS query, field_type_raw AS graph FROM field", "field")

# dumps written from the driver's tables, read and resolved
QUERIES |= dumpview.QUERIES
ORACLE_SQL |= dumpview.ORACLE_SQL
