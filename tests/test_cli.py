"""The command line, on tables of two folders of dumps; appending."""

import json

import pytest

from codeloom import cli
from codeloom.sources import resolve


def put(folder, module, functions, types=()):
    """A module's dumps: functions as {name: [(module, name) it calls]}, types as {name: [(module, type) of its fields]}."""
    folder.mkdir(parents=True, exist_ok=True)
    data = {}
    for k, (name, calls) in enumerate(functions.items()):
        rows = [{"typeSignature": "T"}] + [{"expr": {"_type": "HsVar", "name": n, "module_name": m, "package_name": "p", "src_loc": "x"}} for m, n in calls]
        data[f"$_in${name}**src/{module}.hs:{10 * k + 1}:1-5"] = rows
    (folder / f"src/{module}.hs.json").parent.mkdir(parents=True, exist_ok=True)
    (folder / f"src/{module}.hs.json").write_text(json.dumps(data))
    atom = lambda m, n: {"tag": "AtomicType", "contents": {"moduleName'": m, "typeName'": n, "packageName": "p"}}
    kinds = {t: {"typeKind": "data", "dataConstructors": [{"dataConNames": t, "fields": {f"f{i}": atom(m, n) for i, (m, n) in enumerate(refs)}}]} for t, refs in dict(types).items()}
    (folder / f"src/{module}.hs.type.typechecker.json").write_text(json.dumps(kinds))
    (folder / f"src/{module}.hs.types_code.json").write_text(json.dumps([{"typeName": t, "typeLocation": f"{module}.hs", "typeDefinition": f"data {t}", "line_number": [1, 2]} for t in kinds]))


@pytest.fixture(scope="module")
def out(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    put(d / "one", "A", {"f": [("A", "g"), ("B", "h")], "g": []}, {"T": [("B", "U")]})
    put(d / "two", "B", {"h": [("A", "g"), ("B", "k")], "k": [("A", "f")]}, {"U": [("A", "T")]})
    put(d / "two", "A", {"f": [], "other": []})  # there already: stays as it is
    where = str(d / "out")
    cli.main(["ingest", str(d / "one"), where], spark)
    cli.main(["ingest", str(d / "two"), where, "--append"], spark)
    return where


def rows(spark, *argv):
    return [tuple(r) for r in cli.run(cli.parser().parse_args(argv), spark).collect()]


def test_append_finds_edges_across(spark, out):
    got = rows(spark, "sql", out, "SELECT a.module_name || '.' || a.name, b.module_name || '.' || b.name FROM function_dependency JOIN function a ON a.id = caller_id JOIN function b ON b.id = callee_id")
    assert sorted(got) == [("A.f", "A.g"), ("A.f", "B.h"), ("B.h", "A.g"), ("B.h", "B.k"), ("B.k", "A.f")]
    got = rows(spark, "sql", out, "SELECT a.type_name, b.type_name FROM type_dependency JOIN type a ON a.id = dependent_id JOIN type b ON b.id = dependency_id")
    assert sorted(got) == [("T", "U"), ("U", "T")]
    ids = [r[0] for r in rows(spark, "sql", out, "SELECT id FROM function")]
    assert sorted(ids)[:2] == [1, 2] and len(set(ids)) == 4 and rows(spark, "sql", out, "SELECT count(*) FROM module") == [(2,)]
    again = resolve.ingest(spark, out.replace("/out", "/two"), out, "append")
    assert again["function"].count() == 4 and again["function_dependency"].count() == 5


def test_queries(spark, out):
    q = lambda *argv: rows(spark, "query", out, *argv)
    assert sorted(r[1] for r in q("list-modules")) == ["A", "B"]
    assert [(k, n) for k, _, n in q("module", "B")] == [("function", "h"), ("function", "k"), ("type", "U")] and q("module", "none") == []
    (_, name, module, nested, calls, callers), = q("function", "g")
    assert (name, module, nested, [r["name"] for r in calls], [r["name"] for r in callers]) == ("g", "A", [], [], ["f", "h"])
    assert len(q("function", "g", "--module", "A")) == 1 and q("function", "g", "--module", "B") == []
    assert len(q("type", "T")) == 1 and q("type", "T", "--module", "B") == []
    assert q("most-called", "--limit", "1")[0][1] == "g"
    assert q("call-graph", "f", "A", "--depth", "2") == [(1, "A:f", "A:g"), (1, "A:f", "B:h"), (2, "B:h", "A:g"), (2, "B:h", "B:k")]
    assert q("call-graph", "f", "B") == []
    assert q("type-dep-graph") and q("type-graph", "T", "A") and q("type-graph", "T", "A", "--module-pattern", "B.hs") == [("B.hs:U",)]
    assert q("search", "nothing") == [] and len(q("advanced", '{"conditions": [{"field": "name", "value": "k"}]}')) == 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["query", out, "call-graph", "f"])


def test_writers(spark, out, tmp_path):
    cli.main(["graph", out, str(tmp_path / "g")], spark)
    cli.main(["gexf", out, str(tmp_path / "g.gexf"), "--full"], spark)
    cli.main(["query", out, "list-modules"], spark)
    cli.main(["create", str(tmp_path / "empty")], spark)
    assert "A:f" in (tmp_path / "g.gexf").read_text() and rows(spark, "query", str(tmp_path / "empty"), "list-modules") == []
