"""Lookups, aggregates, text similarity, graphs and usage on the hand-made models, and against brute force."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeloom.operators import aggregates, graphs, lookups, textsim, usage
from tests import fixtures


@pytest.fixture(scope="module")
def service(spark):
    return fixtures.service(spark)


@pytest.fixture(scope="module")
def mvc(spark):
    return fixtures.mvc(spark)


def test_lookups(service):
    assert lookups.module_by_name(service, "app.util").first()["id"] == 2
    assert lookups.function_at(service, "nowhere", 10).count() == 0
    assert {r["name"] for r in lookups.functions_by_module(service, 3).collect()} == {"requestHandler", "dataHandler"}
    d = lookups.function_details(service, 3).first()
    assert d["module"] == "app.handlers" and [x["name"] for x in d["calls"]] == ["processData", "validateInput"] and [x["name"] for x in d["where_functions"]] == ["errorResponse"] and d["called_by"] == []
    assert lookups.children_of_module(service, "import", "app.handlers").count() == 2
    assert lookups.children_of_module(service, "import", "nope").count() == 0
    assert lookups.class_in_module(service, "Processable", "app.core").count() == 1


def test_aggregates(service, mvc):
    assert [(r["name"], r["calls"]) for r in aggregates.most_called(service, 1).collect()] == [("processData", 2)]
    assert {(r["caller_module"], r["callee_module"]) for r in aggregates.cross_module_dependencies(service).collect()} == {("app.handlers", "app.core"), ("app.handlers", "app.util")}
    rows = {r["name"]: (r["incoming"], r["outgoing"]) for r in aggregates.module_coupling(mvc).collect()}
    assert rows == {"app.utils": (14, 0), "app.controllers": (0, 12), "app.models": (3, 3), "app.views": (6, 8)}
    assert sum(r["calls"] for r in aggregates.cross_module_dependencies(mvc).collect()) == 23
    pairs = aggregates.pattern_match(mvc, {"type": "function_call", "caller": "controller", "callee": "model"}).collect()
    assert len(pairs) == 2
    views = aggregates.call_pairs(mvc, "Controller", "render").collect()
    assert len(views) == 6 and sum(r["callee"] == "renderErrorView" for r in views) == 3
    assert {r["name"] for r in aggregates.nested_functions(mvc).collect()} == {"UserController", "ProductController"}
    assert aggregates.type_usage(mvc, "User").count() >= 3
    assert aggregates.pattern_match(mvc, {"type": "type_usage", "type_name": "User", "usage_in": "class"}).count() == 0
    with pytest.raises(ValueError):
        aggregates.pattern_match(mvc, {"type": "nope"})


def test_similarity_and_complexity(service, mvc):
    assert "validateProduct" in {r["name"] for r in textsim.similar_functions(mvc, 15, 0.4).collect()}
    assert "requestHandler" in {r["name"] for r in textsim.complex_functions(service, 3).collect()}
    assert textsim.code_patterns(mvc, "user <- load\nrender user", 2).count() >= 2
    assert textsim.code_patterns(mvc, "one line", 2).count() == 0


def test_code_patterns_brute(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice(["a", "ab", " b ", "", "cab", "\td"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    c = fixtures.catalog(spark, function=[fixtures.fn(i, f"f{i}", 1, 1, 1, raw_string=t) for i, t in enumerate(texts)])
    for code, least in (("a\nb\nd", 2), ("ab", 1), ("a\n\nb\nc", 3)):
        pattern = [x.strip() for x in code.strip().split("\n")]
        want = {}
        for i, t in enumerate(texts):
            lines = [x.strip() for x in t.split("\n")]
            n = 0
            for k in range(len(lines) - least + 1):
                hits = sum(1 for j in range(min(len(pattern), len(lines) - k)) if lines[k + j] and pattern[j] and (pattern[j] in lines[k + j] or lines[k + j] in pattern[j]))
                n += hits >= least
            if n:
                want[i] = n
        assert {r["id"]: r["n_windows"] for r in textsim.code_patterns(c, code, least).collect()} == want


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from("abcdefg"), min_size=0, max_size=6), min_size=1, max_size=14))
def test_grouping_is_the_greedy_one(spark, sets):
    texts = ["\n".join(s) for s in sets]
    c = fixtures.catalog(spark, function=[fixtures.fn(i, f"f{i}", 1, 1, 1, raw_string=t) for i, t in enumerate(texts)])
    got = {}
    for r in textsim.group_similar(c, 0.6).collect():
        got.setdefault(r["group_id"], set()).add(r["id"])
    want, done = {}, set()
    for i, t in enumerate(texts):
        if i in done or not t:
            continue
        group, a = {i}, set(t.split("\n"))
        for j in range(i + 1, len(texts)):
            if j not in done and texts[j]:
                b = set(texts[j].split("\n"))
                if len(a & b) / len(a | b) >= 0.6 - 1e-12:
                    group.add(j)
        if len(group) > 1:
            want[i] = group
            done |= group
    assert got == want


def test_call_graph(service, mvc):
    rows = graphs.call_graph(mvc, 1, 2).collect()
    assert {(r["depth"], r["callee_id"]) for r in rows} == {(1, 4), (1, 7), (1, 10), (1, 13), (2, 15), (2, 11), (2, 12)}
    doc = graphs.call_graph_document(service, 3, 1)
    assert doc["module"] == "app.handlers" and [x["name"] for x in doc["calls"]] == ["processData", "validateInput"]
    assert graphs.call_graph_document(service, 3, 0) == {} and graphs.call_graph_document(service, 99, 2) == {}


def test_reachability_brute(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)]
    want, todo = {"n1"}, ["n1"]
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in want:
                want.add(b)
                todo.append(b)
    got = graphs.reachable(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("n1",)], "node string"))
    assert {r[0] for r in got.collect()} == want


def test_innermost(spark):
    rng = random.Random(5)
    targets = [(i, rng.choice("ab"), s, s + rng.choice([-1, 0, 3, 40, 200])) for i, s in enumerate(rng.randrange(-90, 150) for _ in range(400))] + [(900, "a", 1, 2_000_000_000), (901, "b", -5, 2_000_000_000), (902, "b", -5, 2_000_000_000)]
    probes = [(i, rng.choice("abc"), rng.randrange(-100, 400)) for i in range(300)] + [(7, "a", 1_999_999_999), (8, "a", None), (9, None, 3), (10, "b", 20), (10, "b", 20)]

    def inside(f, at):
        hit = [(-s, i) for i, g, s, e in targets if g == f and at is not None and s <= at <= e]
        return min(hit)[1] if hit else None

    p, t = spark.createDataFrame(probes, "pid bigint, f string, at int"), spark.createDataFrame(targets, "id bigint, f string, s int, e int")
    got = [(r["pid"], r["target_id"]) for r in lookups.innermost_join(p, t, "f", "at", "s", "e", "pid", "id").collect()]
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    assert sorted(got, key=key) == sorted(((i, inside(f, at)) for i, f, at in probes), key=key)  # equal probes stay two
    assert {r["target_id"] for r in lookups.innermost_join(p, t.limit(0), "f", "at", "s", "e", "pid", "id").collect()} == {None}


def test_asof(spark):
    p = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 5), (4, None, 5), (5, "a", None)], "pid int, f string, t int")
    t = spark.createDataFrame([(10, "a", 2), (11, "a", 5), (12, "a", 5), (13, "c", 0), (14, "a", None)], "id int, f string, s int")
    assert {r["pid"]: r["target_id"] for r in lookups.asof_join(p, t, "f", "t", "s", "id").collect()} == {1: 12, 2: None, 3: None, 4: None, 5: None}


def test_usage_and_imports(spark):
    c = fixtures.catalog(
        spark,
        module=[{"id": 1, "name": "A"}, {"id": 2, "name": "B"}],
        function=[fixtures.fn(1, "f", 1, 1, 5, function_signature="T -> T", raw_string="f = g"), fixtures.fn(2, "g", 2, 1, 5, function_signature="Int", raw_string="g = 1")],
        where_function=[{"id": 1, "name": "w", "parent_function_id": 1}],
        type=[{"id": 1, "type_name": "T", "module_id": 2, "raw_code": "data T = T"}],
        class_=[{"id": 1, "class_name": "g", "module_id": 2}],
        function_called=[
            {"id": 1, "function_id": 1, "module_name": "B", "name": "T", "_type": "TyConApp"},
            {"id": 2, "function_id": 1, "module_name": "base", "name": "Text", "_type": "FunTy"},
            {"id": 3, "function_id": 1, "module_name": "b", "name": "g", "_type": "HsVar"},
            {"id": 4, "where_function_id": 1, "module_name": "base", "name": "map", "_type": "HsVar", "function_signature": "a -> b"},
            {"id": 5, "function_id": 1, "module_name": "_in", "name": "h", "_type": "HsVar"},
        ],
        import_=[{"id": 1, "module_id": 1, "module_name": "Data.Text", "as_module_name": "T", "qualified_style": "Qualified"}, {"id": 2, "module_id": 1, "module_name": "X", "is_hiding": True, "hiding_specs": ["q", "r"]}],
    )
    assert {(r["type_name"], r["type_id"]) for r in usage.types_used(c, 1).collect()} == {("T", 1), ("Text", None)}
    assert {(r["function_name"], r["used_id"]) for r in usage.functions_used(c, 1).collect()} == {("g", 2), ("map", None), ("Text", None)}
    known, other = usage.functions_prompt(c, 1)
    assert known == "```haskell\ng :: Int\ng = 1\n\n```" and other == "map :: a -> b\n"
    known, other = usage.types_prompt(c, 1)
    assert known == "```haskell\ndata T = T\n\n```" and other == "Text imported from this module: base\n"
    say = lambda *a: [r["statement"] for r in usage.imports_for_element(c, *a).orderBy("ordinal").collect()]
    assert say("T", "A") == ["import qualified Data.Text as T"]
    assert say("q", "A") == ["import X hiding (q, r)"]
    assert say("g", "A") == ["import B"] and say("g", "A", "type") == []
    assert say("g", "nope") == ["# Unable to find module 'nope'"]
    assert usage.function_prompt("$$f", "a", "b") is None and usage.function_prompt("f", "a", "b") == "f :: a\nb"


def test_similar_functions_scores_once(spark):
    from codeloom.catalog import Catalog

    rows = [(1, "a", "Int -> Text", "x  y z y"), (2, "validate b", "Int -> Text", "x y q"), (3, "c", "Int", ""), (4, "d", None, "x  y z y and\nmore"), (5, "e", "int -> text", "x  Y z y")]
    c = Catalog(spark, {"function": spark.createDataFrame(rows, "id bigint, name string, function_signature string, raw_string string")})
    got = textsim.similar_functions(c, 1, 0.0)
    words = lambda x: set((x or "").split())
    want = {i: round(0.4 * len(words(rows[0][2]) & words(s)) / 3 + 0.6 * len(words(rows[0][3]) & words(t)) / 3, 6) for i, n, s, t in rows[1:]}
    assert {r["id"]: r["similarity"] for r in got.collect()} == want
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()  # scored already: the sort reads scores
