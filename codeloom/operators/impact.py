"""What a change to files affects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.paths import is_test, test_command
from ..functions.symbols import has_role, line_of
from ..plans.graph import Graph
from ..runtime import cut, near
from .lookup import first_per, with_snippets
from .prefix import package_of
from .traverse import Uses, calls_by_file, definitions, importers, reach, referrers


def path_rows(spark: SparkSession, paths: list[str] | DataFrame) -> DataFrame:
    """(node) of a list or a table of paths."""
    if isinstance(paths, DataFrame):
        return paths.select(F.col(paths.columns[0]).alias("node")).distinct()
    return spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "node string")


def changed_symbols(g: Graph, paths: DataFrame, distinct: bool = False) -> DataFrame:
    """Symbols with a definition in the paths(node); a row for each definition unless distinct."""
    defs = g.occurrences.where(has_role(F.col("roles"))).join(paths.select(F.col("node").alias("file_path")), "file_path", "left_semi").select(F.col("file_path").alias("def_path"), F.col("symbol_id").alias("id"))
    out = defs.join(g.symbols.select("id", "kind", "name"), "id")
    return out.groupBy("id").agg(F.first("kind").alias("kind"), F.first("name").alias("name"), F.min("def_path").alias("def_path")) if distinct else out


def dependents(g: Graph, paths: DataFrame) -> DataFrame:
    """(path, reason) of files outside paths that hold a changed symbol or import one of the paths."""
    names = g.symbols.select(F.col("id").alias("symbol_id"), "name")
    refs = referrers(g, paths).join(names, "symbol_id").select("node", F.lit(0).alias("rank"), F.concat(F.lit("references "), "name").alias("why"))
    imps = importers(g, paths).select("node", F.lit(1).alias("rank"), F.concat(F.lit("imports "), "via").alias("why"))
    out = refs.unionByName(imps).join(paths, "node", "left_anti")
    return out.groupBy("node").agg(F.min(F.struct("rank", "why")).alias("r")).select(F.col("node").alias("path"), F.col("r.why").alias("reason"))


def recommended_tests(g: Graph, paths: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(path, command) of the test files among the paths and their dependents."""
    found = dependents(g, paths) if found is None else found
    every = paths.select(F.col("node").alias("path")).unionByName(found.select("path")).distinct()
    return every.where(is_test(F.col("path"))).select("path", test_command(F.col("path")).alias("command"))


def key_references(g: Graph, paths: DataFrame, n: int = 3) -> DataFrame:
    """First n references of each changed symbol, with their lines."""
    ids = changed_symbols(g, paths, True).select(F.col("id").alias("symbol_id"))
    refs = g.occurrences.where(~has_role(F.col("roles"))).join(ids, "symbol_id", "left_semi")
    return with_snippets(first_per(refs, "symbol_id", ["file_path", "range_start"], n), g.contents)


def symbol_details(g: Graph, paths: DataFrame) -> DataFrame:
    """Changed symbols with their range; a null range counts as line 0."""
    ids = changed_symbols(g, paths, True).select("id")
    out = with_snippets(g.symbols.join(ids, "id", "left_semi"), g.contents)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("start_line", "start_col", "end_line", "end_col")})


def affected(g: Graph, paths: DataFrame, depth: int = 5, call_graph: bool = False) -> DataFrame:
    """(path, depth, reason) of files reached from paths over references, imports and, if asked, calls."""

    uses = Uses(definitions(g), {0: g.occurrences.select("symbol_id", F.col("file_path").alias("node"))} | ({2: calls_by_file(g)} if call_graph else {}))

    def step(f: DataFrame) -> DataFrame:
        return uses.step(f).unionByName(importers(g, f).select("node", F.lit(1).alias("rank"), "via"))

    why = F.when(F.col("rank") == 0, "references symbol from ").when(F.col("rank") == 1, "imports ").otherwise("calls into ")
    return reach(paths, step, depth).where("depth > 0").select(F.col("node").alias("path"), "depth", F.concat(why, "via").alias("reason"))


def public_symbols(g: Graph, paths: DataFrame) -> DataFrame:
    """Changed symbols of files that export something."""
    exporters = g.edges.where("kind = 'exports'").select(F.col("source").alias("def_path")).distinct()
    return changed_symbols(g, paths, True).join(exporters, "def_path", "left_semi")


def api_breaks(g: Graph, paths: DataFrame) -> DataFrame:
    """(id, name, downstream): public changed symbols that other packages refer to."""
    public = near(cut(public_symbols(g, paths).select("id", "name")))
    refs = g.occurrences.where(~has_role(F.col("roles"))).join(public.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi").select("symbol_id", "file_path").distinct()
    own = package_of(g, paths, "node").where("package IS NOT NULL").select("package").distinct()
    used = package_of(g, refs, "file_path").where("package IS NOT NULL").join(own, "package", "left_anti")
    return used.groupBy(F.col("symbol_id").alias("id")).agg(F.array_sort(F.collect_set("package")).alias("downstream")).join(public, "id").select("id", "name", "downstream")


def affected_packages(g: Graph, paths: DataFrame, found: DataFrame) -> DataFrame:
    every = paths.select(F.col("node").alias("path")).unionByName(found.select("path")).distinct()
    return package_of(g, every).where("package IS NOT NULL").select("package").distinct()


def test_files(paths: DataFrame, found: DataFrame) -> DataFrame:
    """(path, relevance): affected test files, direct up to depth 1, and changed ones."""
    own = paths.select(F.col("node").alias("path"), F.lit(0).alias("depth"))
    return own.unionByName(found.select("path", "depth")).where(is_test(F.col("path"))).select("path", F.when(F.col("depth") <= 1, "direct").otherwise("transitive").alias("relevance"))


def transitive(g: Graph, paths: list[str] | DataFrame, depth: int = 5, call_graph: bool = False) -> dict[str, DataFrame]:
    """affected, packages, breaks, tests and the one-row risk of a change."""
    paths = near(cut(path_rows(g.files.sparkSession, paths)))
    found = cut(affected(g, paths, depth, call_graph))
    packages, breaks = cut(affected_packages(g, paths, found)), cut(api_breaks(g, paths))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = found.agg(F.count("*").alias("affected"), F.count_if(~is_test(F.col("path"))).alias("untested"))
    for part in (n(g.files, "files"), n(packages, "packages"), n(g.projects, "projects"), n(breaks, "breaks"), n(public_symbols(g, paths), "public")):
        one = one.join(F.broadcast(part))  # rows of one
    c = F.col
    x = scoring.risk(c("affected"), c("files"), c("breaks"), c("packages"), F.greatest(c("projects"), F.lit(1)), c("untested"), scoring.boundary_proximity(c("breaks"), c("public")))
    risk = one.withColumn("__x", x).select("affected", "untested", "packages", "breaks", scoring.risk_score(c("__x")).alias("score"), scoring.risk_category(c("__x")).alias("category"), scoring.boundary_risk(c("breaks")).alias("boundary_risk"))
    return {"affected": found, "packages": packages, "breaks": breaks, "tests": test_files(paths, found), "risk": risk}


def reference_lines(rows: DataFrame) -> DataFrame:
    return rows.select("symbol_id", "file_path", line_of(F.col("range_start")).alias("line"))
