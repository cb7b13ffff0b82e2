"""What a function uses: types, functions, imports; and prompts made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog


def _calls(c: Catalog, function_id: int | None) -> DataFrame:
    """Calls of functions and, under their parents, of where functions at any depth."""
    w = c["where_function"].select(F.col("id").alias("_w"), "parent_function_id")
    called = c["function_called"]
    called = called if "where_function_id" in called.columns else called.withColumn("where_function_id", F.lit(None).cast("bigint"))
    rows = called.join(w, F.col("where_function_id") == F.col("_w"), "left").withColumn("owner", F.coalesce("function_id", "parent_function_id"))
    return rows if function_id is None else rows.where(F.col("owner") == function_id)


def types_used(c: Catalog, function_id: int | None = None) -> DataFrame:
    """(function_id, module_name, type_name, type_id): types that functions mention; type_id is null for those the catalog lacks."""
    rows = _calls(c, function_id).where(F.col("_type").isin("TyConApp", "FunTy")).select("owner", "module_name", "name").distinct()
    m = c["module"].select(F.col("id").alias("_m"), F.col("name").alias("_mn"))
    t = c["type"].join(m, F.col("module_id") == F.col("_m")).select(F.col("id").alias("type_id"), "type_name", "_mn")
    out = rows.join(t, (F.col("name") == F.col("type_name")) & (F.col("module_name") == F.col("_mn")), "left")
    return out.select(F.col("owner").alias("function_id"), "module_name", F.col("name").alias("type_name"), "type_id")


def functions_used(c: Catalog, function_id: int | None = None) -> DataFrame:
    """(function_id, module_name, function_name, type_signature, used_id): used_id is null for functions the catalog lacks. Left out
    are types, literals, built-in modules, and calls whose signature is their own name. Modules match whatever the case."""
    sig = F.coalesce("function_signature", F.lit(""))
    rows = _calls(c, function_id).where(
        (F.coalesce("_type", F.lit("")) != "TyConApp") & ~F.coalesce("module_name", F.lit("")).isin("_in", "_type") & ~sig.isin("FunTy", "ForAllTy", "OverLit") & ((sig == "") | (sig != F.col("name")))
    )
    rows = rows.select("owner", F.col("module_name").alias("_cm"), F.col("name").alias("_cn"), F.col("function_signature").alias("type_signature")).distinct()
    m = c["module"].select(F.col("id").alias("_m"), F.col("name").alias("_mn"))
    f = c["function"].select(F.col("id").alias("used_id"), F.col("name").alias("_fn"), "module_id").join(m, F.col("module_id") == F.col("_m"))
    out = rows.join(f, (F.col("_cn") == F.col("_fn")) & (F.lower("_cm") == F.lower("_mn")), "left")
    return out.select(F.col("owner").alias("function_id"), F.col("_cm").alias("module_name"), F.col("_cn").alias("function_name"), "type_signature", "used_id")


def _block(parts: list[str]) -> str:
    """Parts that aren't within what stands already, one after the other."""
    out = ""
    for p in parts:
        if p not in out:
            out += p
    return out


def _flat(text: str | None) -> str:
    return (text or "").replace("\n", "")


def functions_prompt(c: Catalog, function_id: int) -> tuple[str, str]:
    """(known functions with their code, fenced; signatures of the others) that a function uses."""
    used = functions_used(c, function_id)
    f = c["function"].select(F.col("id").alias("used_id"), "name", "function_signature", "raw_string")
    known = used.where("used_id is not null").select("used_id").distinct().join(f, "used_id").orderBy("used_id").collect()
    other = used.where("used_id is null").orderBy("function_name", "type_signature").collect()
    mine = [f"{_flat(r['name'])} :: {_flat(r['function_signature'])}\n{r['raw_string'] or ''}\n\n" for r in known if r["name"] and r["function_signature"]]
    theirs = [f"{_flat(r['function_name'])} :: {_flat(r['type_signature'])}\n" for r in other if r["function_name"] and r["type_signature"]]
    return "```haskell\n" + _block(mine) + "```" if known else "", _block(theirs)


def types_prompt(c: Catalog, function_id: int) -> tuple[str, str]:
    """(known types' code, fenced; where the others come from) that a function uses."""
    used = types_used(c, function_id)
    t = c["type"].select(F.col("id").alias("type_id"), "raw_code")
    known = used.where("type_id is not null").select("type_id").distinct().join(t, "type_id").orderBy("type_id").collect()
    other = used.where("type_id is null").orderBy("type_name", "module_name").collect()
    theirs = [f"{r['type_name']} imported from this module: {r['module_name']}\n" for r in other]
    return "```haskell\n" + _block([f"{r['raw_code']}\n\n" for r in known]) + "```" if known else "", _block(theirs)


def imports_for_element(c: Catalog, element: str, source_module: str, kind: str = "any") -> DataFrame:
    """(ordinal, statement): how the source module imports an element, else from which other modules it could. One comment line
    where the source module is unknown."""
    m = c["module"].where(F.col("name") == source_module).orderBy("id").limit(1).select(F.col("id").alias("_m"))
    i = c["import"]
    mine = i.join(m, F.col("module_id") == F.col("_m"), "left_semi")
    listed = F.coalesce(F.array_contains("hiding_specs", F.lit(element)), F.lit(False))
    mine = mine.where(F.coalesce(F.contains("module_name", F.lit(element)), F.lit(False)) | F.coalesce(F.col("as_module_name") == element, F.lit(False)) | listed)
    specs = F.coalesce(F.concat(F.when(F.col("is_hiding"), F.lit(" hiding (")).otherwise(F.lit(" (")), F.when(F.size("hiding_specs") > 0, F.array_join("hiding_specs", ", ")), F.lit(")")), F.lit(""))
    text = F.concat(F.lit("import "), F.when(F.col("qualified_style").isin("Qualified", "QualifiedPre", "QualifiedPost"), "qualified ").otherwise(""), F.coalesce("module_name", F.lit("")), specs, F.coalesce(F.concat(F.lit(" as "), F.col("as_module_name")), F.lit("")))
    direct = mine.select(F.struct(F.lit(0).alias("k"), F.col("id").alias("i")).alias("o"), text.alias("statement"))
    names = c["module"].select(F.col("id").alias("_o"), F.col("name").alias("origin")).where(F.col("origin") != source_module)
    origins = None
    for n, (table, col) in enumerate((("function", "name"), ("type", "type_name"), ("class", "class_name"))):
        if kind in (table, "any"):
            part = c[table].where(F.col(col) == element).join(names, F.col("module_id") == F.col("_o")).select(F.struct(F.lit(n + 1).alias("k"), F.col("id").alias("i")).alias("o"), F.concat(F.lit("import "), "origin").alias("statement"))
            origins = part if origins is None else origins.union(part)
    # origins only where the module is known and imports nothing fitting; the comment only where it isn't known
    found = direct
    if origins is not None:
        none = direct.agg(F.count("*").alias("_n")).where("_n = 0").crossJoin(m)
        found = direct.union(origins.join(F.broadcast(none), how="left_semi", on=F.lit(True)))
    missing = m.agg(F.count("*").alias("_n")).where("_n = 0").select(F.struct(F.lit(9).alias("k"), F.lit(0).cast("bigint").alias("i")).alias("o"), F.lit(f"# Unable to find module '{source_module}'").alias("statement"))
    out = found.union(missing).groupBy("statement").agg(F.min("o").alias("o"))
    return out.select(F.expr("row_number() over (order by o, statement)").alias("ordinal"), "statement")


def function_prompt(name: str | None, signature: str | None, raw: str | None) -> str | None:
    """A function's prompt; none for generated names or where the signature is missing."""
    if not signature or not name or "$$" in name:
        return None
    return f"{name} :: {signature}\n{raw or ''}"


def element_prompts(c: Catalog, kind: str) -> DataFrame:
    """(id, prompt) of every function, type, class or import."""
    t = c[kind]
    if kind == "function":
        ok = (F.coalesce("function_signature", F.lit("")) != "") & ~F.contains(F.coalesce("name", F.lit("$$")), F.lit("$$"))
        return t.select("id", F.when(ok, F.concat("name", F.lit(" :: "), "function_signature", F.lit("\n"), F.coalesce("raw_string", F.lit("")))).alias("prompt"))
    if kind == "import":
        return t.select("id", F.to_json(F.struct(*[x for x in t.columns if x not in ("id", "module_id")])).alias("prompt"))
    return t.select("id", F.col({"type": "raw_code", "class": "class_definition"}[kind]).alias("prompt"))
