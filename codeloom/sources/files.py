"""Source trees as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import basename, content_hash, extension, language_of
from . import stores

_or = lambda names: "|".join(re.escape(n) for n in names)
SKIPPED = rf"(^|/)({_or(fixed.SKIPPED_FOLDERS)}|\.[^/]+)/"
NO_PROJECT = rf"(^|/)({_or(fixed.NO_PROJECT_FOLDERS)}|\.[^/]+)/"
ARTIFACT = rf"(^|/)(({_or(fixed.ARTIFACT_NAMES)})|({_or(fixed.ARTIFACT_STARTS)})[^/]*|[^/]+({_or(fixed.ARTIFACT_EXTENSIONS)}))$"


def is_indexed(p: Column) -> Column:
    return extension(p).isin(*fixed.LANGUAGES) & ~p.rlike(SKIPPED)


def is_artifact(p: Column) -> Column:
    return p.rlike(ARTIFACT) & ~p.rlike(SKIPPED)


def _relative(root: str, path: str) -> str:
    return path.removeprefix(root.rstrip("/") + "/").removeprefix("./")


def source_files(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    """(path, language, hash, content) of source files below root, or of those in `only` that exist; paths are relative to root."""
    paths = stores.walk(spark, root, fixed.SKIPPED_FOLDERS) if only is None else spark.createDataFrame([(_relative(root, p),) for p in dict.fromkeys(only)], "path string")
    df = stores.read(paths.where(is_indexed(F.col("path"))), root)
    return df.select("path", language_of(F.col("path")).alias("language"), content_hash(F.col("content")).alias("hash"), F.decode("content", "UTF-8").alias("content"))


def artifact_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of configuration files."""
    paths = stores.walk(spark, root, fixed.SKIPPED_FOLDERS).where(is_artifact(F.col("path")))
    return stores.read(paths, root).select("path", F.decode("content", "UTF-8").alias("content"))


def changed_paths(spark: SparkSession, diff_text: str) -> DataFrame:
    """(path) of the lines of a name-only diff."""
    return spark.createDataFrame([(x.strip(),) for x in diff_text.splitlines() if x.strip()], "path string")


def json_config(texts: DataFrame, schema: str) -> DataFrame:
    """texts(content) parsed leniently; malformed and missing ones give no row."""
    return texts.select(F.from_json("content", schema, {"mode": "PERMISSIVE"}).alias("x")).where("x IS NOT NULL").select("x.*")


BOUNDARIES = "layers map<string, struct<path: string, canImport: array<string>>>"
POLICIES = "policies struct<max_public_api_growth: int, deny_new_cycles: boolean, max_coupling_increase: double, require_tests_for_changed_exports: boolean>"


def _glob(pattern: Column) -> Column:
    """A workspace pattern as a regular expression."""
    safe = F.regexp_replace(F.regexp_replace(pattern, r"^\./|/+$", ""), r"([.+()^$|\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(safe, F.lit("**"), F.lit("\u0001")), F.lit("*"), F.lit("[^/]*")), F.lit("\u0001"), F.lit(".*")), F.lit("$"))


def detect_projects(listing: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """(project_id, root, language) from listing(path) and manifest(content), the root package.json.

    If the manifest names workspaces and such folders have a marker or a manifest, the projects are
    those in them; else the root if it has a marker; else folders one level down.
    """
    at = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("."))
    rows = listing.where(~F.col("path").rlike(NO_PROJECT)).select(at.alias("root"), basename(F.col("path")).alias("name"))
    found = None
    for language, names in fixed.PROJECT_MARKERS.items():
        hit = F.lit(False)
        for n in names:
            hit = hit | (F.col("name").endswith(n[1:]) if n.startswith("*") else F.col("name") == n)
        part = rows.where(hit).select("root", F.lit(language).alias("language"))
        found = part if found is None else found.unionByName(part)
    found = found.distinct()
    if manifest is not None:
        packages = manifest.select(F.from_json("content", "workspaces string").alias("w")).select("w.workspaces").where("workspaces IS NOT NULL")
        globs = packages.select(F.explode(F.coalesce(F.from_json("workspaces", "array<string>"), F.from_json("workspaces", "packages array<string>")["packages"])).alias("g")).select(_glob(F.col("g")).alias("g"))
        folders = found.select("root").unionByName(rows.where("name = 'package.json'").select("root")).distinct()
        named = folders.join(F.broadcast(globs), F.expr("root RLIKE g"), "left_semi")  # one manifest's patterns
        if not named.isEmpty():
            inside = found.join(named, "root", "left_semi")
            return inside.select(F.col("root").alias("project_id"), "root", "language")
    top = found.where("root = '.'")
    chosen = found.where("NOT contains(root, '/') AND root <> '.'") if top.isEmpty() else top
    return chosen.select(F.col("root").alias("project_id"), "root", "language")
