"""Checks of a graph: each gives issues (check, type, subject, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import compilers
from ..plans.graph import Graph
from .lookup import is_source, tested_after_edit
from .metrics import api_surface, coupling, cycles, diff_api, diff_coupling, diff_cycles
from .prefix import violations

CHECKS = ("index_freshness", "missing_tests", "typecheck", "boundaries", "policies")


def _issues(df: DataFrame, check: str, kind: str, subject: Column, message: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(kind).alias("type"), subject.alias("subject"), message.alias("message"))


def freshness(g: Graph) -> DataFrame:
    """Dirty source files that changed after the last full index (time 0 if there was none)."""
    last = g.meta.where("key = 'last_full_scip_index_ts'").agg(F.coalesce(F.max(F.col("value").cast("bigint")), F.lit(0)).alias("last"))
    late = g.dirty.where(is_source(F.col("path"))).join(F.broadcast(last)).where("changed_at > last")  # one row
    return _issues(late, "index_freshness", "STALE_INDEX", F.col("path"), F.concat(F.lit("changed after the last index: "), "path"))


def missing_tests(g: Graph) -> DataFrame:
    """One issue if no test ran after the last edit."""
    return _issues(tested_after_edit(g.ledger).where("NOT tested"), "missing_tests", "MISSING_TEST_RUN", F.lit("ledger"), F.lit("no test run after the last edit"))


def typecheck(logs: DataFrame) -> DataFrame:
    """logs(log_id, tool, output); tool is tsc, go, cargo or any other for the generic form."""
    of = lambda *t: logs.where(F.col("tool").isin(*t)).select("log_id", "output")
    rows = compilers.tsc(of("tsc")).unionByName(compilers.go_vet(of("go"))).unionByName(compilers.cargo(of("cargo"))).unionByName(compilers.generic(logs.where(~F.col("tool").isin("tsc", "go", "cargo")).select("log_id", "output")))
    return _issues(rows, "typecheck", "TYPE_ERROR", F.col("file"), F.col("message"))


def boundaries(g: Graph, layers: DataFrame) -> DataFrame:
    return _issues(violations(g, layers), "boundaries", "BOUNDARY_VIOLATION", F.col("source"), F.concat("from_layer", F.lit(" must not import "), "to_layer", F.lit(": "), "target"))


def policies(g: Graph, rules: dict, before: dict[str, DataFrame] | None) -> DataFrame:
    """deny_new_cycles, max_public_api_growth and max_coupling_increase against a snapshot; none, no issues."""
    none = g.files.sparkSession.createDataFrame([], schemas.ISSUES)
    if not rules or before is None:
        return none
    out = none
    if rules.get("deny_new_cycles"):
        new = diff_cycles(cycles(g), before["cycles"]).where("change = 'new'")
        out = out.unionByName(_issues(new, "policies", "NEW_CYCLE", F.array_join("members", " -> "), F.concat(F.lit("new cycle: "), F.array_join("members", " -> "))))
    if rules.get("max_public_api_growth") is not None:
        grown = diff_api(api_surface(g), before["api"]).where(F.col("delta") > rules["max_public_api_growth"])
        out = out.unionByName(_issues(grown, "policies", "API_GROWTH", F.col("package"), F.concat(F.lit("public API grew by "), F.col("delta").cast("string"))))
    if rules.get("max_coupling_increase") is not None:
        more = diff_coupling(coupling(g), before["coupling"]).where(F.col("delta") > rules["max_coupling_increase"])
        out = out.unionByName(_issues(more, "policies", "COUPLING_INCREASE", F.col("module"), F.concat("metric", F.lit(" grew by "), F.col("delta").cast("string"))))
    return out


def unupdated_references(g: Graph) -> DataFrame:
    """A placeholder that always passes."""
    return g.files.sparkSession.createDataFrame([], schemas.ISSUES)


def verify(g: Graph, layers: DataFrame | None = None, rules: dict | None = None, before: dict | None = None, logs: DataFrame | None = None) -> DataFrame:
    """All issues; an index without files has the one issue EMPTY_INDEX."""
    spark = g.files.sparkSession
    if g.files.isEmpty():
        return spark.createDataFrame([("index", "EMPTY_INDEX", "files", "the index has no files")], schemas.ISSUES)
    out = freshness(g).unionByName(missing_tests(g)).unionByName(policies(g, rules or {}, before))
    out = out if layers is None else out.unionByName(boundaries(g, layers))
    return out if logs is None else out.unionByName(typecheck(logs))


def summary(issues: DataFrame) -> DataFrame:
    """(check, n_issues, passed, first_message) of every check."""
    spark = issues.sparkSession
    every = spark.createDataFrame([(c,) for c in CHECKS], "check string")
    n = issues.groupBy("check").agg(F.count("*").alias("n"), F.min("message").alias("first_message"))
    return every.join(n, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n_issues"), F.col("n").isNull().alias("passed"), "first_message")


def worst_files(issues: DataFrame, k: int = 5) -> DataFrame:
    return issues.where("check = 'typecheck' AND subject <> ''").groupBy("subject").agg(F.count("*").alias("errors")).orderBy(F.desc("errors"), "subject").limit(k)


def recommendations(issues: DataFrame, most: int = 15) -> DataFrame:
    """(no, text): at most `most`, worst files first, then three of each of boundaries and stale files."""
    tool = compilers.TOOL
    rows = worst_files(issues).select(F.lit(1).alias("no"), F.concat(F.lit(f"{tool} impact "), "subject").alias("text"))
    for no, check, word in ((2, "boundaries", "review imports of "), (3, "index_freshness", "index again: ")):
        few = issues.where(F.col("check") == check).select("subject").distinct().orderBy("subject").limit(3)
        rows = rows.unionByName(few.select(F.lit(no).alias("no"), F.concat(F.lit(word), "subject").alias("text")))
    rows = rows.unionByName(issues.where("check = 'missing_tests'").select(F.lit(4).alias("no"), F.lit("run the tests").alias("text")))
    return rows.orderBy("no", "text").limit(most)
