"""Symbols in configuration files, and references to them in source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.paths import basename


def _key_line(content: Column, key: Column) -> Column:
    """First line with `key:`, quoted or not; else 0."""
    safe = F.regexp_replace(key, r"([.*+?^${}()|\[\]\\/])", r"\\$1")
    pattern = F.concat(F.lit("[\"']?"), safe, F.lit("[\"']?\\s*:"))
    hits = F.filter(F.transform(F.split(content, "\n"), lambda x, i: F.when(F.regexp_like(x, pattern), i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(hits, F.lit(0)), F.lit(0))


def _keyed(df: DataFrame, keys: Column, prefix: str, kind: str) -> DataFrame:
    rows = df.select("path", "content", F.explode(keys).alias("name"))
    return rows.select(F.concat(F.lit(f"artifact:{prefix}:"), "name").alias("id"), "name", F.lit(kind).alias("kind"), F.col("path").alias("file_path"), _key_line(F.col("content"), F.col("name")).cast("int").alias("line"))


def _lines(df: DataFrame) -> DataFrame:
    return df.select("path", F.posexplode(F.split("content", "\n")).alias("line", "raw"))


def _found(rows: DataFrame, pattern: str, prefix: str, kind: str, text: str = "raw") -> DataFrame:
    name = F.regexp_extract(text, pattern, 1)
    return rows.where(F.col(text).rlike(pattern)).select(F.concat(F.lit(f"artifact:{prefix}:"), name).alias("id"), name.alias("name"), F.lit(kind).alias("kind"), F.col("path").alias("file_path"), F.col("line").cast("int"))


def env_symbols(df: DataFrame) -> DataFrame:
    rows = _lines(df).withColumn("t", F.regexp_replace("raw", r"^\s+|\s+$", ""))
    return _found(rows.where(~F.col("t").startswith("#")), r"^([A-Za-z_]\w*)=", "env", "env_var", "t")


def package_symbols(df: DataFrame) -> DataFrame:
    ok = df.where(F.is_valid_utf8("content") & F.try_parse_json("content").isNotNull())
    scripts = _keyed(ok, F.json_object_keys(F.get_json_object("content", "$.scripts")), "script", "config_key")
    own = F.json_object_keys("content")
    return scripts.unionByName(_keyed(ok, F.filter(F.array(*map(F.lit, fixed.PACKAGE_KEYS)), lambda k: F.array_contains(own, k)), "pkg", "config_key"))


def tsconfig_symbols(df: DataFrame) -> DataFrame:
    ok = df.where(F.try_parse_json("content").isNotNull())
    return _keyed(ok, F.json_object_keys(F.get_json_object("content", "$.compilerOptions")), "tsconfig", "config_key")


def sql_symbols(df: DataFrame) -> DataFrame:
    """First match of each statement in a line."""
    rows = _lines(df)
    out = _found(rows, fixed.CREATE_TABLE, "table", "table")
    out = out.unionByName(_found(rows, fixed.ALTER_TABLE, "table", "table"))
    return out.unionByName(_found(rows, fixed.CREATE_INDEX, "index", "index"))


def yaml_keys(df: DataFrame) -> DataFrame:
    """(path, level, top, second, name): keys at indents of 0, 2 and 4, each under the last key above it."""
    w = Window.partitionBy("path").orderBy("line")
    key = lambda p: F.nullif(F.regexp_extract("raw", p, 1), F.lit(""))
    rows = _lines(df).withColumns({"k1": key(fixed.YAML_TOP), "k2": key(fixed.YAML_SECOND), "k3": key(fixed.YAML_THIRD)})
    rows = rows.withColumn("top", F.last("k1", True).over(w)).where("top IS NOT NULL")
    run = F.sum(F.col("k1").isNotNull().cast("int")).over(w)
    rows = rows.withColumn("run", run).withColumn("second", F.last("k2", True).over(Window.partitionBy("path", "run").orderBy("line")))
    level = F.when(F.col("k1").isNotNull(), 1).when(F.col("k2").isNotNull(), 2).when(F.col("k3").isNotNull() & F.col("second").isNotNull(), 3)
    return rows.withColumn("level", level).where("level IS NOT NULL").select("path", "level", "top", "second", F.coalesce("k1", "k2", "k3").alias("name")).distinct()


def openapi_symbols(df: DataFrame) -> DataFrame:
    js = df.where(F.col("path").endswith(".json") & F.try_parse_json("content").isNotNull())
    schemas = F.coalesce(F.get_json_object("content", "$.components.schemas"), F.get_json_object("content", "$.definitions"))
    out = _keyed(js, F.json_object_keys(F.get_json_object("content", "$.paths")), "endpoint", "api_endpoint").unionByName(_keyed(js, F.json_object_keys(schemas), "schema", "api_schema"))
    text = df.where(~F.col("path").endswith(".json"))
    keys = yaml_keys(text).join(text, "path")
    of = lambda cond, prefix, kind: _keyed(keys.where(cond).select("path", "content", F.array("name").alias("n")), F.col("n"), prefix, kind)
    return out.unionByName(of("level = 2 AND top = 'paths'", "endpoint", "api_endpoint")).unionByName(of("level = 3 AND top = 'components' AND second = 'schemas' OR level = 2 AND top = 'definitions'", "schema", "api_schema"))


def extract(files: DataFrame) -> DataFrame:
    """(id, name, kind, file_path, line) of files(path, content), by file name."""
    n, p = basename(F.col("path")), F.col("path")
    env = p.endswith(".env") | n.contains(".env.")
    out = env_symbols(files.where(env))
    out = out.unionByName(package_symbols(files.where(n == "package.json"))).unionByName(tsconfig_symbols(files.where(n == "tsconfig.json")))
    out = out.unionByName(sql_symbols(files.where(p.endswith(".sql"))))
    return out.unionByName(openapi_symbols(files.where(n.rlike(r"^(openapi|swagger)\.(json|ya?ml)$"))))


def config_references(code: DataFrame, symbols: DataFrame) -> DataFrame:
    """config_ref edges from code(path, content) to env variables and tables.

    Names are extracted from the code and met by an equi-join; code and symbols are never crossed.
    """
    def names(patterns):
        return F.array_distinct(F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns]))

    env = code.select("path", F.explode(names(fixed.ENV_USES)).alias("name")).join(symbols.where("kind = 'env_var'").select("name", "id").distinct(), "name").withColumn("confidence", F.lit("high"))
    tab = code.select("path", F.explode(F.transform(names(fixed.TABLE_USES), F.lower)).alias("k")).join(symbols.where("kind = 'table'").select(F.lower("name").alias("k"), "id").distinct(), "k").withColumn("confidence", F.lit("approximate"))
    return env.select("path", "id", "confidence").unionByName(tab.select("path", "id", "confidence")).distinct().select(F.col("path").alias("source"), F.col("id").alias("target"), F.lit("config_ref").alias("kind"), "confidence")
