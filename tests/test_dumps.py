"""Dump readers, resolution, the property graph and the stream, on a small folder of dumps."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom import dumpview
from codeloom.catalog import Catalog
from codeloom.functions import typeast
from codeloom.sources import dumps, export, resolve
from codeloom.streaming.incremental import class_updates


def atom(name, module="M"):
    return {"tag": "AtomicType", "contents": {"moduleName'": module, "typeName'": name, "packageName": "p"}}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    d = tmp_path_factory.mktemp("dumps")
    call = lambda n, m, k="HsVar": {"expr": {"_type": k, "name": n, "module_name": m, "package_name": "p", "src_loc": "x"}}
    files = {
        "dist/build/autogen/src/A/One.hs.json": {
            "$_in$f**src/A/One.hs:3:1-5": [{"typeSignature": "Int"}, {"typeSignature": "T -> T"}, call("g", "A.One"), call("g", "A.One"), call("lit", "x", "OverLit"), {"functionIO": {"inputs": ["T"], "outputs": ["T"]}}],
            "$_in$g**src/A/One.hs:9:1-5": [{"typeSignature": "Int"}, call("f", "A.One")],
            "$_in$f**l::w**src/A/One.hs:4": [{"typeSignature": "W"}, call("k", "B")],
            "$_in$f**src/A/One.hs:3:1-5::w**a::v**b": [call("h", "B")],
        },
        "src/A/One.hs.function_code.json": {"f**src/A/One.hs:3:1-5": {"parser_stringified_code": "f = g", "line_number": [3, 5]}},
        "src/A/One.hs.function_instance_mapping.json": {"x$f": [["f", "C T"]]},
        "src/A/One.hs.class_code.json": [{"className": "C", "classDefinition": "class C", "classLocation": "A/One.hs", "line_number": [1, 2]}],
        "src/A/One.hs.module_imports.json": [{"moduleName'": "B", "packageName": "p", "asModuleName": "Q", "isImplicit": False, "isSafe": True, "hidingSpec": {"isHiding": True, "names": ["x"]}, "qualifiedStyle": {"tag": "Qualified"}, "line_number": [1, 1]}],
        "src/A/One.hs.types_code.json": [{"typeName": "T", "typeLocation": "A/One.hs", "typeDefinition": "data T", "line_number": [7, 8]}],
        "src/A/One.hs.type.typechecker.json": {
            "T": {"typeKind": "data", "dataConstructors": [{"dataConNames": "T1", "fields": {"a": {"raw_code": "U", "structure": atom("U", "A.One")}}}, {"dataConNames": "T2", "fields": {}}]},
            "U": {"typeKind": "newtype", "dataConstructors": [{"dataConNames": "U", "fields": {"u": atom("T", "A.One")}}]},
            "V": {"typeKind": "odd", "dataConstructors": [{"dataConNames": "V", "fields": {"v": {"tag": "ListType", "contents": atom("T", "A.One")}}}]},
            "bad": {},
        },
        "src/A/One.hs.instance_code.json": [{"instanceDefinition": "instance C T", "instanceType": "C T", "instanceLocation": "A/One.hs", "line_number": [2, 6]}],
    }
    for p, data in files.items():
        (d / p).parent.mkdir(parents=True, exist_ok=True)
        (d / p).write_text(json.dumps(data))
    line = json.dumps({"key": "$_in$h**src/B.hs:1:1", "typeSignature": "H"})
    (d / "src/B.hs.json").write_text("\n".join([line, line, "{broken", json.dumps({"key": "$_in$h**src/B.hs:1:1", **call("f", "A.One")})]))
    (d / "src/A/empty.hs.class_code.json").write_text("")
    return str(d)


def test_module_names(spark):
    cases = {"app/dist/build/autogen/src/A/B.hs.json": "A.B", "x/src-generated/C.hs.types_code.json": "C", "pkg/test/D.hs.json": "D", "E/F.hs.class_code.json": "E.F", "a/src/b/src/G.hs.json": "G"}
    df = spark.createDataFrame([(p,) for p in cases], "p string").select("p", dumps.module_name(F.col("p")).alias("m"))
    assert {r["p"]: r["m"] for r in df.collect()} == cases


def test_functions(spark, root):
    rows = {r["name"]: r for r in dumps.functions(spark, root).collect()}
    f = rows["f"]
    assert (f["module_name"], f["signature"], f["raw_string"], f["line_number_start"], f["line_number_end"]) == ("A.One", "T -> T", "f = g", 3, 5)
    assert f["function_input"] == ["T"] and f["instances_used"] == ["C T"]
    assert sorted((c["module_name"], c["name"]) for c in f["calls"]) == [("A.One", "g"), ("_lit", "lit")]
    assert rows["g"]["line_number_start"] == 9
    assert rows["h"]["module_name"] == "B" and rows["h"]["signature"] == "H" and len(rows["h"]["calls"]) == 1
    light = {r["name"]: r for r in dumps.functions(spark, root, light=True).collect()}
    assert "h" in {c["name"] for c in light["f"]["calls"]}
    assert [(r["n_lines"], r["n_bad"]) for r in dumps.rejects(spark, root).collect()] == [(4, 1)]
    assert {(r["name"], r["depth"]) for r in dumps.where_functions(spark, root).collect()} == {("w", 1), ("v", 2)}


def test_other_kinds(spark, root):
    assert dumps.classes(spark, root).first()["class_name"] == "C"
    i = dumps.imports_of_module(spark, root, "A.One").first()
    assert (i["package_name"], i["as_module_name"], i["is_safe"], i["hiding_specs"], i["qualified_style"]) == ("p", "Q", True, ["x"], "Qualified")
    t = {r["type_name"]: r for r in dumps.types(spark, root).collect()}
    assert {k: (v["type_of_type"], len(v["constructors"])) for k, v in t.items()} == {"T": ("sumtype", 2), "U": ("newtype", 0), "V": ("data", 1)}
    assert t["T"]["line_number_start"] == 7 and dumps.instances(spark, root).first()["instance_id"] == "C T"


def test_ingest_and_graph(spark, root, tmp_path):
    c = resolve.ingest(spark, root, str(tmp_path / "out"))
    n = {k: c[k].count() for k in ("module", "function", "where_function", "import", "type", "constructor", "class", "instance", "instance_function", "function_dependency", "type_dependency")}
    assert n == {"module": 2, "function": 3, "where_function": 1, "import": 1, "type": 3, "constructor": 3, "class": 1, "instance": 1, "instance_function": 1, "function_dependency": 3, "type_dependency": 2}
    assert sorted(r[0] for r in c["function"].select("id").collect()) == [1, 2, 3]
    again = resolve.ingest(spark, root, str(tmp_path / "out"), mode="append")
    assert again["function"].count() == 3
    nodes, edges = export.property_graph(c)
    kinds = {r[0] for r in edges.select("type").distinct().collect()}
    assert {"CALLS", "DEFINES_WHERE", "USES_INSTANCE_SIGNATURE", "IMPLEMENTS", "IMPORTS_MODULE", "IMPORTS_PACKAGE", "HAS_ATOMIC_TYPE", "USES_TYPE", "HAS_CLASS"} <= kinds
    assert nodes.groupBy("id", "label").count().where("count > 1").count() == 0
    export.write_graph(nodes, edges, str(tmp_path / "graph"))
    assert spark.read.parquet(str(tmp_path / "graph/edges")).count() == edges.count()
    light, light_edges = export.light_graph(c)
    assert light_edges.where("type = 'calls' and src = 'A.One--f' and dst = 'B--h'").count() == 1
    export.write_gexf(light, light_edges, str(tmp_path / "g.gexf"))
    assert "A.One--f" in (tmp_path / "g.gexf").read_text()
    assert c.sql("SELECT name FROM class WHERE id = :i", {"i": 1}).columns == ["name"] if "name" in c["class"].columns else True
    assert Catalog.load(spark, str(tmp_path / "out"))["type"].count() == 3


def test_type_structures():
    t = {"tag": "AppType", "contents": [atom("Maybe"), [[atom("Int")]]]}
    assert typeast.to_text(typeast.parse(t)) == "(Maybe Int)"
    f = {"tag": "Func", "contents": [atom("A"), {"tag": "ListType", "contents": atom("B")}]}
    assert typeast.to_text(typeast.parse(f)) == "(A -> [B])"
    q = {"tag": "QualType", "contents": {"context": [atom("Eq")], "body": {"tag": "TupleType", "contents": [atom("A"), atom("B")]}}}
    assert typeast.to_text(typeast.parse(q)) == "(Eq) => (A, B)"
    fa = {"tag": "ForallType", "contents": {"binders": [{"typeName'": "a"}], "body": {"tag": "DocType", "contents": [atom("X"), "text"]}}}
    names = lambda x, k: [r[1] for r in typeast.references(typeast.parse(x), k)]
    assert names(fa, "query") == ["a", "X"] and names(fa, "graph") == ["X"] and names(fa, "loader") == []
    assert names({"tag": "AppType", "contents": [atom("L"), []]}, "loader") == [] and names({"tag": "AppType", "contents": [atom("L"), []]}, "query") == ["L"]
    for odd in (None, 3, {}, {"tag": "FuncType", "contents": []}, {"tag": "New", "contents": 1}):
        assert typeast.parse(odd)[0] == "unknown"
    assert typeast.to_text(typeast.load("not json")) == "not json"
    for tag in ("BangType", "RecordType", "PromotedTupleType", "PromotedListType", "KindSigType", "IParamType"):
        body = {"f": atom("Z")} if tag == "RecordType" else ["n", atom("Z")] if tag == "IParamType" else [atom("Z"), atom("Z")] if tag == "KindSigType" else [atom("Z")] if tag.startswith("Promoted") else atom("Z")
        assert "Z" in names({"tag": tag, "contents": body}, "query")


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()

    def put(name, text):
        (src / f"{name}.hs.class_code.json").write_text(json.dumps([{"className": "K", "classDefinition": text, "classLocation": "l", "line_number": [1, 1]}]))
        class_updates(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("module_name", "class_definition").collect())

    assert put("A", "one") == [("A", "one")]
    assert put("B", "two") == [("A", "one"), ("B", "two")]
    (tmp_path / "out").rename(tmp_path / "out.last")  # where a crash between the two renames leaves it
    assert put("C", "three") == [("A", "one"), ("B", "two"), ("C", "three")]
    assert not (tmp_path / "out.last").exists()


def test_tables_are_made_when_asked_for(spark, root, monkeypatch):
    made = []
    monkeypatch.setattr(resolve, "with_ids", lambda df, *keys, f=resolve.with_ids: made.append(keys) or f(df, *keys))
    c = resolve.build(spark, root)
    assert made == []
    assert [r["class_name"] for r in c["class"].collect()] == ["C"]
    assert made == [("name",), ("module_name", "class_name", "line_number_start")]  # modules and classes, nothing else
    assert c["class"].count() == 1 and len(made) == 2


def test_dumps_in_pieces(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    whole = {k: sorted(map(str, dumpview.QUERIES[f"ingest_{k}"](spark, d).collect())) for k in ("function",)}
    monkeypatch.setattr(dumpview, "PIECE", 50)
    texts = dumpview.texts(spark, d).where("path like '%.hs.json'").selectExpr("length(value) as n", "path").collect()
    assert len(texts) > len({r["path"] for r in texts}) and max(r["n"] for r in texts) < sum(r["n"] for r in texts) / 25
    assert whole == {k: sorted(map(str, dumpview.QUERIES[f"ingest_{k}"](spark, d).collect())) for k in whole}


def test_call_edges_of_repeated_names(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 3)
    owners = [(i, f"k{i % 3}") for i in range(30)] + [(4, "k2"), (None, "k0")]  # an id of two keys, and none
    functions = [(i, "M", f"n{i % 4}") for i in range(40)] + [(5, "M", "n0"), (6, None, "n0")]
    calls = [("k0", "M", "n0"), ("k1", "M", "n0"), ("k2", "M", "n1"), ("k0", "M", "n3"), ("k0", "M", "n0"), ("k0", None, "n0"), ("k0", "M", "")]
    o, f, c = spark.createDataFrame(owners, "id bigint, full_key string"), spark.createDataFrame(functions, "id bigint, module_name string, name string"), spark.createDataFrame(calls, "full_key string, module_name string, name string")
    edges = resolve.call_edges(o, c, f)
    want = {(i, j) for i, k in owners for a, m, n in calls if a == k and m and n for j, x, y in functions if (x, y) == (m, n)}
    key = lambda e: (e[0] is not None, e[0] or 0, e[1])
    assert sorted(map(tuple, edges.collect()), key=key) == sorted(want, key=key)
    # pairs of ids are made at the end: nothing gathers or sends them
    plan = edges._jdf.queryExecution().executedPlan().toString().split("Generate explode(xs")[0]
    assert "Generate" in plan and "Exchange" not in plan and "Aggregate" not in plan


def test_edges_are_told_apart_in_tasks_that_grow_in_number(spark, tmp_path, monkeypatch):
    rows = [(f"a{i % 40}", f"b{i % 7}", "T") for i in range(3000)] + [("a0", None, "T")] * 2
    spark.createDataFrame(rows, "src string, dst string, type string").write.parquet(str(tmp_path / "e"))
    edges = spark.read.parquet(str(tmp_path / "e"))
    monkeypatch.setattr(export, "TASK_BYTES", sum(p.stat().st_size for p in (tmp_path / "e").glob("*.parquet")) // 11)
    once = export._once(edges)
    assert sorted(map(str, once.collect())) == sorted({str(r) for r in edges.collect()})
    assert once.rdd.getNumPartitions() >= 11
