"""Type structures in tagged JSON: a normal form, the types that they refer to, and their text.

A structure is {"tag": T, "contents": C}; T may lack the suffix "Type". The walkers run in Arrow UDFs: the
structures nest without bound, which no struct type can hold.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE = {"BangType": "bang", "ListType": "list"}
_MANY = {"TupleType": "tuple", "PromotedTupleType": "promoted_tuple", "PromotedListType": "promoted_list"}
_TWO = {"FuncType": ("func", "arg", "result"), "KindSigType": ("kind_sig", "type", "kind"), "IParamType": ("iparam", "name", "type"), "DocType": ("doc", "type", "doc")}
#: A normal node is (kind, children by role); an atom is ("atomic", module, name, package).
Node = tuple


def _list(x) -> list:
    return x if isinstance(x, list) else [x]


def parse(data) -> Node:
    """The normal form of decoded JSON; what can't be understood is ("unknown", text)."""
    if not isinstance(data, dict) or "tag" not in data or "contents" not in data:
        return ("unknown", None if data is None else str(data))
    tag, c = data["tag"], data["contents"]
    tag = tag if isinstance(tag, str) and tag.endswith("Type") else f"{tag}Type"
    try:
        if tag == "AtomicType":
            return _atom(c)
        if tag in _ONE:
            return (_ONE[tag], {"type": parse(c)})
        if tag in _MANY:
            return (_MANY[tag], {"types": [parse(x) for x in _list(c)]})
        if tag in _TWO:
            kind, a, b = _TWO[tag]
            first, second = (c[a], c[b]) if isinstance(c, dict) else (c[0], c[1])
            plain = {"iparam": a, "doc": b}.get(kind)
            return (kind, {r: v if r == plain else parse(v) for r, v in ((a, first), (b, second))})
        if tag == "AppType":
            if isinstance(c, dict) and "tag" not in c:
                f, args = c.get("func"), c.get("args", [])
            elif isinstance(c, list) and c:
                f, args = c[0], c[1] if len(c) > 1 else []
            else:
                f, args = c, []
            bare = lambda x: x[0] if isinstance(x, list) and len(x) == 1 else x
            return ("app", {"func": parse(bare(f)), "args": [parse(bare(x)) for x in _list(args)]})
        if tag == "ForallType":
            binders, body = (c["binders"], c["body"]) if isinstance(c, dict) else (c[0], c[1])
            return ("forall", {"binders": [_atom(b.get("contents", b)) if isinstance(b, dict) else ("atomic", None, str(b), None) for b in _list(binders)], "body": parse(body)})
        if tag == "QualType":
            context, body = (c["context"], c["body"]) if isinstance(c, dict) else (c[0], c[1])
            return ("qual", {"context": [parse(x) for x in _list(context)], "body": parse(body)})
        if tag == "RecordType":
            return ("record", {"fields": [parse(v) for v in c.values()], "names": list(c)})
        if tag == "LiteralType":
            return ("literal", str(c))
        if tag == "WildCardType":
            return ("wildcard", None)
        if tag == "StarType":
            return ("star", None)
    except (KeyError, IndexError, TypeError, AttributeError):
        pass
    return ("unknown", str(data))


def _atom(c) -> Node:
    return ("atomic", c.get("moduleName'"), c.get("typeName'"), c.get("packageName"))


def load(text: str | None) -> Node:
    try:
        data = json.loads(text) if text else None
    except ValueError:
        return ("unknown", text)
    if isinstance(data, dict) and "structure" in data:
        data = data["structure"]
    return parse(data)


#: Which kinds each flavour of reference extraction walks into, besides those that all do.
FLAVOURS = {
    "loader": {"skip": {"kind_sig", "doc", "iparam", "promoted_tuple"}, "binders": False, "bare_app": False},
    "query": {"skip": set(), "binders": True, "bare_app": True},
    "graph": {"skip": set(), "binders": False, "bare_app": True},
}


def references(node: Node, flavour: str = "query") -> list[tuple]:
    """(module, name, package) of the types that a structure refers to, in order, with repeats."""
    how, out, todo = FLAVOURS[flavour], [], [node]
    while todo:
        n = todo.pop()
        kind = n[0]
        if kind == "atomic":
            if n[2]:
                out.append(n[1:])
        elif isinstance(n[1], dict) and kind not in how["skip"]:
            if kind == "app" and not n[1]["args"] and not how["bare_app"]:
                continue
            kids = []
            for role, v in n[1].items():
                if role in ("names", "name") or (role == "binders" and not how["binders"]) or (kind == "doc" and role == "doc"):
                    continue
                kids += v if isinstance(v, list) else [v]
            todo += [k for k in reversed(kids) if isinstance(k, tuple)]
    return out


def to_text(n: Node) -> str:
    """Haskell notation of the seven printable kinds; else the unknown text, or "unknown"."""
    kind, c = n[0], n[1]
    if kind == "atomic":
        return str(n[2])
    if kind == "list":
        return f"[{to_text(c['type'])}]"
    if kind == "tuple" and c["types"]:
        return f"({', '.join(map(to_text, c['types']))})"
    if kind == "app" and c["args"]:
        return f"({' '.join(map(to_text, [c['func'], *c['args']]))})"
    if kind == "func":
        return f"({to_text(c['arg'])} -> {to_text(c['result'])})"
    if kind == "forall" and c["binders"]:
        return f"forall {' '.join(str(b[2]) for b in c['binders'])}. {to_text(c['body'])}"
    if kind == "qual" and c["context"]:
        return f"({', '.join(map(to_text, c['context']))}) => {to_text(c['body'])}"
    return c if kind == "unknown" and c else "unknown"


def refs_column(structure: Column | str, flavour: str = "query") -> Column:
    """array<struct<module, name, package>> of a column of structures in JSON; empty where there is none."""

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("module", pa.string()), ("name", pa.string()), ("package", pa.string())]))
        rows = [[{"module": m, "name": n, "package": p} for m, n, p in references(load(t), flavour)] for t in texts.to_pylist()]
        return pa.array(rows, kind)

    return F.arrow_udf(run, "array<struct<module:string,name:string,package:string>>")(structure)


def text_column(structure: Column | str) -> Column:
    return F.arrow_udf(lambda texts: pa.array([None if t is None else to_text(load(t)) for t in texts.to_pylist()], pa.string()), "string")(structure)


def is_atomic_column(structure: Column | str) -> Column:
    return F.arrow_udf(lambda texts: pa.array([load(t)[0] == "atomic" for t in texts.to_pylist()], pa.bool_()), "boolean")(structure)
