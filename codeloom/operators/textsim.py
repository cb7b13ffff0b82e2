"""Similarity, patterns, grouping and complexity of function texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.loops import cut, stored


def _tokens(col: str | Column) -> Column:
    text = F.coalesce(col if isinstance(col, Column) else F.col(col), F.lit(""))
    return F.filter(F.array_distinct(F.split(text, r"\s+")), lambda x: x != "")


def similar_functions(c: Catalog, function_id: int, threshold: float = 0.7, bonus_token: str = "validate", threshold_scale: float = 0.5) -> DataFrame:
    """Functions like one of them: shares of its signature's (0.4) and text's (0.6) distinct tokens, and 0.2 if both names
    have the bonus token. Candidates share the signature's or text's start or the bonus token; a short start matches all.
    The reference function is one row, with its tokens, joined as such; nothing is collected. Each candidate is scored once."""
    ref = c["function"].where(F.col("id") == function_id).select(
        F.col("id").alias("_id"), F.coalesce("function_signature", F.lit("")).alias("_sig"), F.coalesce("raw_string", F.lit("")).alias("_raw"), F.coalesce(F.lower("name"), F.lit("")).alias("_name"), _tokens("function_signature").alias("_sigs"), _tokens("raw_string").alias("_raws")
    )
    f = c["function"].crossJoin(F.broadcast(ref.limit(1))).where("id <> _id")  # one row

    def starts(text: str, of: str, n: int) -> Column:
        return (F.length(of) < n) | F.coalesce(F.contains(F.lower(text), F.lower(F.substring(of, 1, n))), F.lit(False))

    both = F.contains("_name", F.lit(bonus_token)) & F.coalesce(F.contains(F.lower("name"), F.lit(bonus_token)), F.lit(False))
    f = f.where(starts("function_signature", "_sig", 5) | starts("raw_string", "_raw", 10) | both)

    def share(mine: str, text: str) -> Column:
        # the reference's tokens, each once and none empty, decide on what is common
        return F.size(F.array_intersect(mine, F.split(F.coalesce(text, F.lit("")), r"\s+"))) / F.greatest(F.size(mine), F.lit(1))

    score = 0.4 * share("_sigs", "function_signature") + 0.6 * share("_raws", "raw_string") + F.when(both, 0.2).otherwise(0.0)
    # exploded, so that the filter takes the score and doesn't work it out again; what passes is kept, so that the sort's sampling doesn't either
    f = f.select("id", "name", F.explode(F.array(F.round(score, 6))).alias("_s")).where(F.col("_s") >= threshold * threshold_scale)
    return stored(f.select("id", "name", F.col("_s").alias("similarity"))).orderBy(F.desc("similarity"), "id")


_TRIM = r"^\s+|\s+$"


def code_patterns(c: Catalog, code: str, min_matches: int = 3) -> DataFrame:
    """Functions with windows of lines like the pattern's: line by line, blank ones aside, one of the two contains the other.
    A window holds where ``min_matches`` lines match. Gives the number of windows and their matching lines."""
    pattern = [x.strip() for x in code.strip().split("\n")]
    f = c["function"].where(F.col("raw_string").isNotNull())
    if len(pattern) < min_matches:
        return f.limit(0).select("id", "name", F.lit(0).alias("n_windows"), F.array().cast("array<struct<line:int,text:string>>").alias("lines"))
    p = F.array(*[F.lit(x) for x in pattern])
    lines = F.transform(F.split("raw_string", "\n", -1), lambda x: F.regexp_replace(x, _TRIM, ""))

    def like(a: Column, b: Column) -> Column:
        return (a != "") & (b != "") & (F.contains(a, b) | F.contains(b, a))

    def windows(at: Column) -> Column:
        # the lines, and for each the pattern's lines that it is like, are computed once, as lambda variables
        hits = F.transform(at, lambda x: F.filter(F.sequence(F.lit(0), F.lit(len(pattern) - 1)), lambda j: like(x, F.get(p, j))))

        def of(h: Column) -> Column:
            starts = F.when(F.size(at) >= min_matches, F.sequence(F.lit(0), F.size(at) - min_matches)).otherwise(F.array().cast("array<int>"))
            reach = F.sequence(F.lit(0), F.lit(len(pattern) - 1))
            each = F.transform(starts, lambda i: F.filter(reach, lambda j: F.coalesce(F.array_contains(F.get(h, i + j), j), F.lit(False))))
            kept = F.filter(F.transform(each, lambda js, i: F.struct(i.alias("i"), js.alias("js"))), lambda w: F.size(w["js"]) >= min_matches)
            return F.transform(kept, lambda w: F.transform(w["js"], lambda j: F.struct((w["i"] + j).cast("int").alias("line"), F.get(at, w["i"] + j).alias("text"))))

        return F.get(F.transform(F.array(hits), of), F.lit(0))

    f = f.select("id", "name", F.get(F.transform(F.array(lines), windows), F.lit(0)).alias("_w"))
    return f.where(F.size("_w") > 0).select("id", "name", F.size("_w").alias("n_windows"), F.flatten("_w").alias("lines"))


def similar_pairs(c: Catalog, threshold: float = 0.7) -> DataFrame:
    """(a, b, similarity) for a < b: Jaccard similarity of the sets of lines, at the threshold or above (which must be over 0).

    Candidates come by prefix filtering, which is exact: with a set's lines ordered from rare to common, two sets that
    are so similar share one of their first size - ceil(threshold * size) + 1 lines. Common lines therefore
    hardly ever join."""
    f = c["function"].where("raw_string is not null and raw_string <> ''").select("id", F.array_distinct(F.split("raw_string", "\n", -1)).alias("lines"))
    f = f.select("id", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"), F.size("lines").alias("n"))
    each = f.select("id", "n", F.explode("lines").alias("line"))
    freq = each.groupBy("line").agg(F.count("*").alias("df")).where("df > 1")
    ranked = each.join(freq, "line", "left").withColumn("r", F.expr("row_number() over (partition by id order by coalesce(df, 1), line)"))
    prefix = ranked.where((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1) & F.col("df").isNotNull())
    x, y = prefix.select("line", F.col("id").alias("a"), F.col("n").alias("na")), prefix.select("line", F.col("id").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("na") >= F.col("nb") * threshold - 1e-9) & (F.col("nb") >= F.col("na") * threshold - 1e-9)
    pairs = x.join(y, "line").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    sets = f.select("id", "lines")
    both = pairs.join(sets.toDF("a", "la"), "a").join(sets.toDF("b", "lb"), "b")
    common = F.size(F.array_intersect("la", "lb"))
    both = both.withColumn("similarity", common / (F.size("la") + F.size("lb") - common))
    return both.where(F.col("similarity") >= threshold - 1e-12).select("a", "b", F.round("similarity", 6).alias("similarity"))


def group_similar(c: Catalog, threshold: float = 0.7) -> DataFrame:
    """(group_id, id, name): the greedy grouping in the order of ids, as a fixed point. A function is a seed if no earlier
    seed is similar to it; any other joins its first similar seed. Groups have two members or more."""
    edges = cut(similar_pairs(c, threshold).select("a", "b"))
    state = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("s", F.lit(0)))  # 0 open, 1 seed, 2 member
    while True:
        before = edges.join(state.toDF("a", "sa"), "a").groupBy(F.col("b").alias("id")).agg(F.max(F.when(F.col("sa") == 1, 1).otherwise(0)).alias("hit"), F.max(F.when(F.col("sa") == 0, 1).otherwise(0)).alias("open"))
        new = F.when(F.col("s") != 0, F.col("s")).when(F.col("hit") == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = cut(state.join(before, "id", "left").select("id", new.alias("s")))
        if state.where("s = 0").isEmpty():
            break
    seeds = state.where("s = 1").select(F.col("id").alias("seed"))
    members = edges.join(seeds, F.col("a") == F.col("seed")).join(state.where("s = 2").select(F.col("id").alias("b")), "b").groupBy(F.col("b").alias("id")).agg(F.min("seed").alias("group_id"))
    all_ids = members.union(members.select(F.col("group_id").alias("id"), "group_id").distinct())
    names = c["function"].select(F.col("id").alias("_f"), "name")
    return all_ids.join(names, F.col("id") == F.col("_f")).select("group_id", "id", "name")


_KEYWORDS = ("if", "case", "of", "where", "let", "do", "->", "| ")


def complex_functions(c: Catalog, threshold: int = 10) -> DataFrame:
    """1 + occurrences of branching words in the text + callees + where functions, at the threshold or above."""
    calls = c["function_dependency"].groupBy(F.col("caller_id").alias("_c")).agg(F.count("*").alias("n_calls"))
    wheres = c["where_function"].groupBy(F.col("parent_function_id").alias("_w")).agg(F.count("*").alias("n_where"))
    f = c["function"].where(F.col("raw_string").isNotNull()).select("id", "name", "raw_string")
    words = sum((F.length("raw_string") - F.length(F.replace("raw_string", F.lit(k), F.lit("")))) / F.lit(len(k)) for k in _KEYWORDS)
    f = f.select("id", "name", words.cast("bigint").alias("_k"))
    f = f.join(calls, F.col("id") == F.col("_c"), "left").join(wheres, F.col("id") == F.col("_w"), "left")
    n_calls, n_where = F.coalesce("n_calls", F.lit(0)).cast("bigint"), F.coalesce("n_where", F.lit(0)).cast("bigint")
    out = f.select("id", "name", (1 + F.col("_k") + n_calls + n_where).alias("complexity"), n_calls.alias("n_calls"), n_where.alias("n_where"))
    return out.where(F.col("complexity") >= threshold).orderBy(F.desc("complexity"), "id")
