"""The tables of a code graph, and a graph derived from the star-schema tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from .. import schemas
from ..runtime import written


@dataclass(frozen=True)
class Graph:
    files: DataFrame
    symbols: DataFrame
    occurrences: DataFrame
    edges: DataFrame
    projects: DataFrame
    ledger: DataFrame
    dirty: DataFrame
    meta: DataFrame
    contents: DataFrame

    def having(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    def stored(self, *names: str) -> Graph:
        """The graph with some of its tables computed once, in the shared folder: for operators that read them at every level of a search."""
        return self.having(**{n: written(getattr(self, n)) for n in names})


def graph_of(spark: SparkSession, **rows) -> Graph:
    """A graph from lists of tuples or DataFrames; what isn't given is empty."""
    made = {n: rows[n] if isinstance(rows.get(n), DataFrame) else spark.createDataFrame(rows.get(n, []), ddl) for n, ddl in schemas.TABLES.items()}
    return Graph(**made)


def save(graph: Graph, folder: str, version: str) -> None:
    """All tables below folder/version; a reader sees a version when its folder has all tables, so nothing is overwritten."""
    for name in schemas.TABLES:
        getattr(graph, name).write.mode("errorifexists").parquet(f"{folder}/{version}/{name}")


def load(spark: SparkSession, folder: str, version: str) -> Graph:
    return Graph(**{n: spark.read.schema(ddl).parquet(f"{folder}/{version}/{n}") for n, ddl in schemas.TABLES.items()})


def file_sql(k: str) -> str:
    """Path of the file with number k, in SQL of either engine."""
    return f"('src/n' || ({k} % 25) || '/s' || {k} || CASE {k} % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.test.ts' ELSE '.java' END)"


def stem_sql(k: str) -> str:
    return f"('src/n' || ({k} % 25) || '/s' || {k} || CASE {k} % 5 WHEN 3 THEN '.test' ELSE '' END)"


LANGUAGE_SQL = "CASE s_suppkey % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'typescript' ELSE 'java' END"

#: name -> SELECT over the star schema; N is the number of suppliers, SHA a hash function, MILLIS the milliseconds of a timestamp.
DERIVED = {
    "files": f"SELECT {file_sql('s_suppkey')} AS path, {LANGUAGE_SQL} AS language, SHA(s_name) AS hash, s_suppkey AS indexed_at FROM supplier",
    "symbols": f"SELECT 'sym:' || p_partkey AS id, p_type AS kind, p_name AS name, {file_sql('(p_partkey % N)')} AS file_path, CAST(p_size * 65536 + 4 AS INT) AS range_start, CAST((p_size + 10) * 65536 + 1 AS INT) AS range_end, p_brand AS doc FROM part",
    "occurrences": f"""SELECT file_path, range_start, max(range_end) AS range_end, symbol_id, max(roles) AS roles FROM (
      SELECT {file_sql('(p_partkey % N)')} AS file_path, CAST(p_size * 65536 + 4 AS INT) AS range_start, CAST((p_size + 10) * 65536 + 1 AS INT) AS range_end, 'sym:' || p_partkey AS symbol_id, 1 AS roles FROM part
      UNION ALL SELECT {file_sql('l_suppkey')}, CAST((l_orderkey % 30000) * 65536 + l_linenumber AS INT), CAST((l_orderkey % 30000) * 65536 + l_linenumber + 5 AS INT), 'sym:' || l_partkey,
        CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 8 ELSE 4 END FROM lineitem) u GROUP BY file_path, range_start, symbol_id""",
    "edges": f"""SELECT DISTINCT {file_sql('a.l_suppkey')} AS source, CASE WHEN b.l_suppkey % 7 = 0 THEN {stem_sql('b.l_suppkey')} ELSE {file_sql('b.l_suppkey')} END AS target, 'imports' AS kind, 'structural' AS confidence
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
      WHERE a.l_suppkey <> b.l_suppkey
      UNION ALL SELECT {file_sql('(p_partkey % N)')}, 'sym:' || p_partkey, 'exports', 'high' FROM part JOIN supplier ON s_suppkey = p_partkey % N WHERE s_acctbal > 5000
      UNION ALL SELECT DISTINCT 'sym:' || a.l_partkey, 'sym:' || b.l_partkey, 'calls', 'approximate'
      FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber
      WHERE a.l_partkey <> b.l_partkey""",
    "projects": "SELECT 'p' || n_nationkey AS project_id, 'src/n' || n_nationkey AS root, 'mixed' AS language, CAST(n_regionkey AS BIGINT) AS last_index_ts FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT 'top', 'src', 'mixed', CAST(0 AS BIGINT)",
    "ledger": "SELECT event_id AS id, MILLIS(ts) AS timestamp, CASE event_type WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'test_run' ELSE event_type END AS event, props AS data FROM events",
    "dirty": f"SELECT {file_sql('(o_custkey % N)')} AS path, max(MILLIS(o_orderdate)) AS changed_at FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
    "meta": "SELECT 'schema_version' AS key, '5' AS value UNION ALL SELECT 'last_full_scip_index_ts', '899000000000'",
    "contents": f"SELECT {file_sql('(doc_id % N)')} AS path, min(text) AS content FROM documents GROUP BY 1",
}
#: Spark's forms of tables that are grouped: rows are told apart by the keys that paths and symbols are made of, before these are made. A test holds them against DERIVED.
KEYED = {
    "occurrences": f"""SELECT {file_sql('k')} AS file_path, range_start, range_end, 'sym:' || p AS symbol_id, roles FROM (SELECT k, range_start, max(range_end) AS range_end, p, max(roles) AS roles FROM (
      SELECT p_partkey % N AS k, CAST(p_size * 65536 + 4 AS INT) AS range_start, CAST((p_size + 10) * 65536 + 1 AS INT) AS range_end, p_partkey AS p, 1 AS roles FROM part
      UNION ALL SELECT l_suppkey, CAST((l_orderkey % 30000) * 65536 + l_linenumber AS INT), CAST((l_orderkey % 30000) * 65536 + l_linenumber + 5 AS INT), l_partkey,
        CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 8 ELSE 4 END FROM lineitem) u GROUP BY k, range_start, p) v""",
    "edges": f"""SELECT {file_sql('a')} AS source, CASE WHEN b % 7 = 0 THEN {stem_sql('b')} ELSE {file_sql('b')} END AS target, 'imports' AS kind, 'structural' AS confidence
      FROM (SELECT DISTINCT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_suppkey <> b.l_suppkey) i
      UNION ALL SELECT {file_sql('(p_partkey % N)')}, 'sym:' || p_partkey, 'exports', 'high' FROM part JOIN supplier ON s_suppkey = p_partkey % N WHERE s_acctbal > 5000
      UNION ALL SELECT 'sym:' || a, 'sym:' || b, 'calls', 'approximate'
      FROM (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber + 1 = b.l_linenumber WHERE a.l_partkey <> b.l_partkey) c""",
}
SOURCES = ("supplier", "part", "lineitem", "nation", "events", "orders", "documents")


def derived(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph; every table is lazy and reads only the columns it needs."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES}
    n = tables["supplier"].count()
    made = {}
    for name, sql in (DERIVED | KEYED).items():
        text = sql.replace("% N)", f"% {n})").replace("% N ", f"% {n} ").replace("SHA(s_name)", "sha2(s_name, 256)")
        text = re.sub(r"MILLIS\((\w+)\)", r"timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', \1)", text)  # free of the session's time zone
        made[name] = spark.sql(_with_frames(text), **{t: df for t, df in tables.items() if f" {t}" in text})
    return Graph(**made)


def _with_frames(text: str) -> str:
    """Table names as {placeholders} that spark.sql() fills with DataFrames."""
    return re.sub(r"\b(FROM|JOIN) (" + "|".join(SOURCES) + r")\b", r"\1 {\2}", text)


def oracle_tables(*names: str) -> str:
    """The same tables as DuckDB common table expressions."""
    out = []
    for name in names:
        text = DERIVED[name].replace("% N)", "% (SELECT count(*) FROM supplier))").replace("% N ", "% (SELECT count(*) FROM supplier) ").replace("SHA(s_name)", "sha256(s_name)")
        text = re.sub(r"MILLIS\((\w+)\)", r"(epoch_us(\1) // 1000)", text)
        out.append(f"{name} AS MATERIALIZED ({text})")
    return ",\n".join(out)
