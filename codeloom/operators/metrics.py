"""Coupling, cycles and public API of a graph, and differences of two snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import round3
from ..plans.graph import Graph
from .prefix import or_unknown, package_of
from .traverse import cycles


def coupling(g: Graph, scope: str | None = None) -> DataFrame:
    """(module, ca, ce, instability): distinct importers and imports of every module; self-imports count on both sides."""
    e = g.edges.where("kind = 'imports'").select("source", "target")
    e = (e.where(F.col("source").startswith(scope)) if scope else e).distinct()
    into = e.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("ca"))
    out_of = e.groupBy(F.col("source").alias("module")).agg(F.count("*").alias("ce"))
    both = into.join(out_of, "module", "full_outer").select("module", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    return both.withColumn("instability", round3(F.col("ce") / (F.col("ca") + F.col("ce"))))


def api_surface(g: Graph) -> DataFrame:
    """(package, exports): export edges, repeats included."""
    rows = package_of(g, g.edges.where("kind = 'exports'").select("source"), "source")
    return rows.groupBy(or_unknown(F.col("package")).alias("package")).agg(F.count("*").alias("exports"))


def cycle_summary(g: Graph, scope: str | None = None) -> DataFrame:
    return cycles(g, scope).agg(F.count("*").alias("total"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"), (F.count("*") > 0).alias("has_cycles"))


def diff_coupling(now: DataFrame, before: DataFrame) -> DataFrame:
    """(module, metric, previous, current, delta) for modules of both whose value grew."""
    old = before.select("module", *[F.col(c).alias(f"p_{c}") for c in ("ca", "ce", "instability")])
    both = now.join(old, "module").selectExpr("module", "stack(3, 'ca', double(p_ca), double(ca), 'ce', double(p_ce), double(ce), 'instability', p_instability, instability) AS (metric, previous, current)")
    return both.withColumn("delta", round3(F.col("current") - F.col("previous"))).where("delta > 0")


def diff_cycles(now: DataFrame, before: DataFrame) -> DataFrame:
    """(change, members): cycles that are new or removed."""
    new, old = now.select("members"), before.select("members")
    return new.join(old, "members", "left_anti").select(F.lit("new").alias("change"), "members").unionByName(old.join(new, "members", "left_anti").select(F.lit("removed").alias("change"), "members"))


def diff_api(now: DataFrame, before: DataFrame) -> DataFrame:
    """(package, previous, current, delta) where exports changed; packages that vanished are not reported."""
    old = before.select("package", F.col("exports").alias("previous"))
    out = now.join(old, "package", "left").select("package", F.coalesce("previous", F.lit(0)).alias("previous"), F.col("exports").alias("current"))
    return out.withColumn("delta", F.col("current") - F.col("previous")).where("delta <> 0")


def snapshot(g: Graph, snapshot_id: str) -> dict[str, DataFrame]:
    """coupling, cycles and api of a graph, marked with an id."""
    return {k: df.withColumn("snapshot_id", F.lit(snapshot_id)) for k, df in (("coupling", coupling(g)), ("cycles", cycles(g)), ("api", api_surface(g)))}


def save_snapshot(g: Graph, folder: str, snapshot_id: str) -> None:
    for name, df in snapshot(g, snapshot_id).items():
        df.write.mode("overwrite").parquet(f"{folder}/{snapshot_id}/{name}")


def load_snapshot(spark, folder: str, snapshot_id: str) -> dict[str, DataFrame] | None:
    """None if there is no whole snapshot of that id."""
    from pyspark.errors import AnalysisException

    try:
        return {n: spark.read.parquet(f"{folder}/{snapshot_id}/{n}") for n in ("coupling", "cycles", "api")}
    except AnalysisException:
        return None
