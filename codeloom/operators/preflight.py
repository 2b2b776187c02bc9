"""What to look at before a file is edited."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.paths import basename, is_test
from ..functions.symbols import has_role
from ..plans.graph import Graph
from ..runtime import cut
from .impact import transitive
from .lookup import first_per, named_kinds, with_snippets
from .prefix import longest_prefix, violations


def _uses(g: Graph, path: str) -> DataFrame:
    """References of the file's symbols."""
    ids = named_kinds(g.symbols).where(F.col("file_path") == path).select(F.col("id").alias("symbol_id"), "name", "kind")
    return ids.join(g.occurrences.where(~has_role(F.col("roles"))), "symbol_id", "left")


def symbols(g: Graph, path: str, fast: bool = False) -> DataFrame:
    """(id, name, kind, signature, is_exported, n_call_sites, test_files).

    Export edges don't matter here: a use in another file does. The signature is the first line of the definition.
    """
    out = F.col("file_path") != path
    n = F.count_if(out)
    heads = with_snippets(named_kinds(g.symbols).where(F.col("file_path") == path), g.contents).select("id", F.coalesce(F.split("snippet", "\n")[0], F.lit("")).alias("signature"))
    return _uses(g, path).groupBy(F.col("symbol_id").alias("id"), "name", "kind").agg(
        F.coalesce(F.bool_or(out), F.lit(False)).alias("is_exported"), (F.least(n, F.lit(5)) if fast else n).alias("n_call_sites"), F.array_sort(F.collect_set(F.when(is_test(F.col("file_path")), F.col("file_path")))).alias("test_files")
    ).join(heads, "id").select("id", "name", "kind", "signature", "is_exported", "n_call_sites", "test_files")


def call_sites(g: Graph, path: str, fast: bool = False) -> DataFrame:
    """References from other files with their line; the first five of each symbol if fast."""
    rows = _uses(g, path).where(F.col("file_path") != path)
    rows = first_per(rows, "symbol_id", ["file_path", "range_start"], 5) if fast else rows
    return with_snippets(rows, g.contents).select("symbol_id", "name", F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.split("snippet", "\n")[0].alias("snippet"))


def blast_radius(g: Graph, path: str, fast: bool = False) -> DataFrame:
    """(direct, transitive, risk). Fast: from direct dependents alone."""
    direct = _uses(g, path).where(F.col("file_path") != path).agg(F.count_distinct("file_path").alias("direct"))
    if fast:
        return direct.select("direct", F.col("direct").alias("transitive"), scoring.fast_risk(F.col("direct")).alias("risk"))
    return direct.join(F.broadcast(transitive(g, [path], 3)["risk"].select(F.col("affected").alias("transitive"), F.col("category").alias("risk"))))  # one row each


def boundary(g: Graph, path: str, layers: DataFrame) -> DataFrame:
    """(layer, can_import, broken): the file's layer and the targets that it may not import."""
    own = longest_prefix(g.files.sparkSession.createDataFrame([(path,)], "source string"), "source", layers, "prefix", "layer", "layer").where("layer IS NOT NULL")
    bad = violations(g, layers).where(F.col("source") == path).groupBy("source").agg(F.array_sort(F.collect_set("target")).alias("broken"))
    return own.join(layers.select("layer", "can_import"), "layer").join(bad, "source", "left").select("layer", "can_import", F.coalesce("broken", F.array().cast("array<string>")).alias("broken"))


def checklist(g: Graph, path: str, fast: bool = False, layers: DataFrame | None = None) -> DataFrame:
    """(no, name, text) of what to do, in order."""
    sites = call_sites(g, path, fast)
    each = sites.groupBy("symbol_id", "name").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(basename(F.col("file")))), ", ").alias("files"))
    plural = F.when(F.col("n") > 1, "s").otherwise("")
    text = F.concat(F.lit("If you change '"), "name", F.lit("', update "), F.col("n").cast("string"), F.lit(" call site"), plural, F.lit(" in: "), "files")
    out = each.select(F.lit(1).alias("no"), "name", text.alias("text"))
    tests = _uses(g, path).where(is_test(F.col("file_path"))).agg(F.array_sort(F.collect_set("file_path")).alias("t")).where("size(t) > 0")
    out = out.unionByName(tests.select(F.lit(2).alias("no"), F.lit("").alias("name"), F.concat(F.lit("Run tests: "), F.array_join("t", ", ")).alias("text")))
    radius = blast_radius(g, path, fast).where("risk IN ('high', 'critical')")
    out = out.unionByName(radius.select(F.lit(3).alias("no"), F.lit("").alias("name"), F.concat(F.lit("Warning: "), "risk", F.lit(" blast radius ("), F.col("direct").cast("string"), F.lit(" direct dependents)")).alias("text")))
    if layers is not None:
        b = cut(boundary(g, path, layers))
        may = F.when(F.size("can_import") == 0, "none").otherwise(F.array_join("can_import", ", "))
        out = out.unionByName(b.select(F.lit(4).alias("no"), F.lit("").alias("name"), F.concat(F.lit("Boundary: "), "layer", F.lit(" layer (can import: "), may, F.lit(")")).alias("text")))
        out = out.unionByName(b.where("size(broken) > 0").select(F.lit(5).alias("no"), F.lit("").alias("name"), F.concat(F.lit("Boundary violations: "), F.array_join("broken", ", ")).alias("text")))
    return out
