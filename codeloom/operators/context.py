"""Context for a task: files by priority, filled into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, scoring
from ..functions.paths import is_test, snippet, token_estimate
from ..functions.symbols import has_role, line_of
from ..plans.graph import Graph
from ..runtime import cut, near
from .impact import path_rows
from .lookup import named_kinds
from .traverse import importers, referrers

MOST = 100


def resolve_targets(g: Graph, edges: DataFrame) -> DataFrame:
    """edges(via, target) as (via, node): the target itself or with an extension, if it is a known file."""
    tries = F.array(F.col("target"), *[F.concat("target", F.lit(e)) for e in fixed.CONTEXT_EXTENSIONS])
    rows = edges.select("via", "target", F.posexplode(tries).alias("p", "path")).join(g.files.select("path"), "path")
    return rows.groupBy("via", "target").agg(F.min_by("path", "p").alias("node")).select("via", "node")


def discover(g: Graph, entries: list[str] | DataFrame, depth: int = 3, include_tests: bool = False, most: int = MOST) -> DataFrame:
    """(path, depth, priority, reason) of files around the entries.

    A file has the priority of its first discovery. Within a level, the order is: imports of the
    frontier, its importers, then files that refer to its symbols; ties go to the smallest frontier
    file (and for references the smallest count). The search ends after the level at which `most`
    files are known; that cap is part of the operator.
    """
    seeds = path_rows(g.files.sparkSession, entries).join(g.files.select(F.col("path").alias("node")), "node", "left_semi")
    seen = cut(seeds.select("node", F.lit(0).alias("depth"), F.lit(1.0).alias("priority"), F.lit("entry file").alias("reason")))
    frontier = seen
    for d in range(1, depth + 1):
        f = near(frontier.select("node"))
        forward = resolve_targets(g, g.edges.where("kind = 'imports'").join(f.withColumnRenamed("node", "source"), "source").select(F.col("source").alias("via"), "target"))
        refs = referrers(g, f, references_only=True)
        order = Window.partitionBy("via", "symbol_id").orderBy("node")
        counted = refs.withColumn("n", F.count("*").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        first = counted.groupBy("node", "via", "symbol_id").agg(F.min("n").alias("n"))
        p = lambda mech, boost=1.0: scoring.priority(d, mech, F.col("node"), boost, include_tests)
        rows = forward.select("node", F.lit(0).alias("rank"), "via", F.lit("").alias("symbol_id"), p("import").alias("priority"), F.concat(F.lit("imported by "), "via").alias("reason"))
        rows = rows.unionByName(importers(g, f).select("node", F.lit(1).alias("rank"), "via", F.lit("").alias("symbol_id"), p("importer").alias("priority"), F.concat(F.lit("imports "), "via").alias("reason")))
        rows = rows.unionByName(first.select("node", F.lit(2).alias("rank"), "via", "symbol_id", p("reference", scoring.reference_boost(F.col("n"))).alias("priority"), F.concat(F.lit("references symbol from "), "via").alias("reason")))
        new = rows.join(seen.select("node"), "node", "left_anti").groupBy("node").agg(F.min(F.struct("rank", "via", "symbol_id", "priority", "reason")).alias("r"))
        frontier = cut(new.select("node", F.lit(d).alias("depth"), "r.priority", "r.reason"))
        seen = seen.unionByName(frontier)
        if frontier.isEmpty() or seen.count() >= most:
            break
    return seen.withColumnRenamed("node", "path")


def exported_symbols(g: Graph, paths: DataFrame) -> DataFrame:
    """(path, id, name, kind, is_exported): exported if another file refers to it or its file has export edges."""
    rows = named_kinds(g.symbols).withColumnRenamed("file_path", "path").join(paths.select("path"), "path", "left_semi")
    used = g.occurrences.where(~has_role(F.col("roles"))).join(rows.select(F.col("id").alias("symbol_id"), "path"), "symbol_id").where("file_path <> path").select(F.col("symbol_id").alias("id")).distinct().withColumn("__u", F.lit(True))
    files = g.edges.where("kind = 'exports'").select(F.col("source").alias("path")).distinct().withColumn("__x", F.lit(True))
    return rows.join(used, "id", "left").join(files, "path", "left").select("path", "id", "name", "kind", F.coalesce("__u", "__x", F.lit(False)).alias("is_exported"))


def compile_context(g: Graph, entries: list[str] | DataFrame, depth: int = 3, budget: int = 50_000, include_tests: bool = False) -> DataFrame:
    """(pos, path, priority, depth, mode, tokens, total): files that fit, in order of priority.

    A file that doesn't fit is replaced by the first lines of its symbols; the first one of which
    not even those fit ends the list. That fold is sequential, over an array of at most MOST entries.
    """
    top = discover(g, entries, depth, include_tests).orderBy(F.desc("priority"), "depth", "path").limit(MOST)
    text = top.join(g.contents, "path", "left").withColumn("full", F.coalesce(token_estimate(F.col("content")), F.lit(0)))
    lines = named_kinds(g.symbols).where("range_start IS NOT NULL").withColumnRenamed("file_path", "path").join(text.select("path", "content"), "path").where("content IS NOT NULL")
    line = snippet(F.col("content"), line_of(F.col("range_start")), 1)
    sigs = lines.withColumn("line", line).where(line_of(F.col("range_start")) < F.size(F.split("content", "\n"))).groupBy("path").agg((F.sum(F.length("line")) + F.count("*") - 1).alias("chars"))
    rows = text.join(sigs, "path", "left").select((-F.col("priority")).alias("o"), "depth", "path", "full", F.ceil(F.coalesce("chars", F.lit(0)) / 4).alias("sig"))
    one = rows.agg(F.array_sort(F.collect_list(F.struct("o", "depth", "path", "full", "sig"))).alias("a"))  # MOST entries
    entry = "array<struct<pos:int,path:string,priority:double,depth:int,mode:string,tokens:bigint,total:bigint>>"

    def add(acc, x):
        fits = acc["total"] + x["full"] <= budget
        some = acc["total"] + x["sig"] <= budget
        tokens = F.when(fits, x["full"]).otherwise(x["sig"])
        item = F.struct((F.size(acc["out"]) + 1).alias("pos"), x["path"].alias("path"), (-x["o"]).alias("priority"), x["depth"].alias("depth"), F.when(fits, "full").otherwise("signatures").alias("mode"), tokens.alias("tokens"), (acc["total"] + tokens).alias("total"))
        go = ~acc["stop"] & (fits | some)
        return F.struct(F.when(go, acc["total"] + tokens).otherwise(acc["total"]).alias("total"), (acc["stop"] | ~(fits | some)).alias("stop"), F.when(go, F.concat(acc["out"], F.array(item).cast(entry))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(False).alias("stop"), F.array().cast(entry).alias("out"))
    return one.select(F.inline(F.aggregate("a", start, add)["out"]))


def summary(filled: DataFrame) -> DataFrame:
    """(files, tokens, truncated, packages) of a filled context; a package is the first two segments of a path."""
    pkg = F.when(F.col("path").contains("/"), F.substring_index("path", "/", 2))
    return filled.agg(F.count("*").alias("files"), F.coalesce(F.max("total"), F.lit(0)).alias("tokens"), F.coalesce(F.bool_or(F.col("mode") == "signatures"), F.lit(False)).alias("truncated"), F.count_distinct(pkg).alias("packages"), F.count_if(is_test(F.col("path"))).alias("tests"))
