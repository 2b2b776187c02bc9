"""The engine's queries over the derived graph, each with SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compilers, fixed, redaction, symbols as S
from ..functions.imports import extract_imports, resolve
from ..functions.paths import TEST_FILE, content_hash, is_test, normalize, stem, test_command, token_estimate
from ..operators import changes, context, impact, lookup, metrics, modules, preflight, prefix, traverse, verify
from .. import schemas
from ..sources import artifacts, files
from ..streaming import feeds
from . import samples
from .graph import Graph, derived, graph_of, oracle_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
FILE, SYMBOL, SCOPE = "src/n5/s5.ts", "sym:7", "src/n1"
CHANGED = ["src/n5/s5.ts", "src/n1/s1.py", "src/n0/s0.ts"]
CALLED = "sym:982"
TEST_SQL = TEST_FILE.replace("'", "''")


def query(sql: str | None = None, tables: str = "", raw: bool = False):
    """Registers a function of the graph (or, raw, of the session and folder)."""

    def add(f):
        QUERIES[f.__name__] = f if raw else lambda spark, sf_dir: f(derived(spark, sf_dir))
        if sql is not None:
            head = oracle_tables(*tables.split()) if tables else ""
            body = sql.strip()
            if body.startswith("+"):  # further common table expressions
                SQL[f.__name__] = "WITH RECURSIVE " + head + (",\n" if head else "") + body[1:].lstrip()
            else:
                SQL[f.__name__] = (f"WITH {head}\n" if head else "") + body
        return f

    return add


def _paths(g: Graph, paths=CHANGED) -> DataFrame:
    return impact.path_rows(g.files.sparkSession, list(paths))


CH = "ch(node) AS (VALUES ('src/n5/s5.ts'), ('src/n1/s1.py'), ('src/n0/s0.ts'))"
STEM = r"regexp_replace({0}, '\.[^.]+$', '')"

# --- lookups -------------------------------------------------------------------


@query(f"SELECT * FROM files WHERE path = '{FILE}'", "files")
def file_lookup(g):
    return lookup.by_key(g.files, "path", FILE)


@query(f"SELECT * FROM files WHERE path IN ('{FILE}', 'src/n1/s1.py', 'src/n0/s0.ts', 'none')", "files")
def files_batch(g):
    return lookup.batch(g.files, "path", [*CHANGED, "none"])


@query("SELECT s.* FROM symbols s WHERE file_path IN (SELECT path FROM files WHERE language = 'go')", "files symbols")
def symbols_batch_semi(g):
    return lookup.batch(g.symbols, "file_path", g.files.where("language = 'go'").select("path"))


@query(f"SELECT * FROM symbols WHERE file_path = '{FILE}'", "symbols")
def file_symbols(g):
    return lookup.by_key(g.symbols, "file_path", FILE)


@query(f"SELECT * FROM occurrences WHERE symbol_id = '{SYMBOL}'", "occurrences")
def occurrences_by_symbol(g):
    return lookup.by_key(g.occurrences, "symbol_id", SYMBOL)


@query(f"SELECT 0 AS pos, * FROM edges WHERE target = '{FILE}' UNION ALL SELECT 1, * FROM edges WHERE target = 'src/n5/s5'", "edges")
def edges_by_target(g):
    return lookup.edges_by_targets(g, [FILE, "src/n5/s5"])


@query("SELECT source, target FROM edges WHERE kind = 'exports'", "edges")
def export_edges(g):
    return lookup.edges_of(g, "exports").select("source", "target")


@query("SELECT id, name FROM symbols WHERE name ILIKE 'SMALL%' ORDER BY name, id LIMIT 10", "symbols")
def symbol_search_prefix(g):
    return lookup.search_symbols(g, "SMALL", 10).select("id", "name")


@query("SELECT id, name FROM symbols WHERE name ILIKE '%ing%' ORDER BY name, id LIMIT 10", "symbols")
def symbol_search_substring(g):
    return lookup.search_symbols(g, "ing", 10).select("id", "name")


@query(f"SELECT id, name, (range_start >> 16)::INT AS start_line, (range_start & 65535)::INT AS start_col, (range_end >> 16)::INT AS end_line, (range_end & 65535)::INT AS end_col FROM symbols WHERE id = '{SYMBOL}'", "symbols")
def get_def_unpacked(g):
    return lookup.definition(g, SYMBOL).select("id", "name", "start_line", "start_col", "end_line", "end_col")


@query(f"SELECT file_path, (range_start >> 16)::INT AS start_line, roles FROM occurrences WHERE symbol_id = '{SYMBOL}' AND roles & 1 = 0 AND starts_with(file_path, '{SCOPE}')", "occurrences")
def find_refs_scoped(g):
    return lookup.references(g, SYMBOL, True, SCOPE).select("file_path", "start_line", "roles")


@query("SELECT o.file_path, range_start, array_to_string(string_split(content, chr(10))[(range_start >> 16) + 1:(range_start >> 16) + 3], chr(10)) AS snippet FROM occurrences o JOIN contents c ON c.path = o.file_path WHERE roles = 1", "occurrences contents")
def line_snippets(g):
    rows = g.occurrences.where("roles = 1").join(g.contents.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return lookup.with_snippets(rows, g.contents).select("file_path", "range_start", "snippet")


@query("SELECT (SELECT count(*) FROM files) AS n_files, (SELECT coalesce(max(indexed_at), 0) FROM files) AS last_indexed, (SELECT count(*) FROM symbols) AS n_symbols, (SELECT count(*) FROM edges) AS n_edges, (SELECT count(*) FROM dirty) AS n_dirty", "files symbols edges dirty")
def status_counts(g):
    return lookup.status(g)


@query("SELECT event, max(id) AS id, arg_max(timestamp, id) AS timestamp, arg_max(data, id) AS data FROM ledger GROUP BY event", "ledger")
def ledger_latest_per_event(g):
    return lookup.latest_events(g.ledger)


@query("SELECT id, event FROM ledger WHERE timestamp > 1704300000000", "ledger")
def ledger_after(g):
    return lookup.events_after(g.ledger, 1704300000000).select("id", "event")


@query("SELECT user_id, CASE WHEN max(CASE WHEN event_type = 'click' THEN event_id END) IS NULL THEN true ELSE coalesce(max(CASE WHEN event_type = 'purchase' THEN event_id END) > max(CASE WHEN event_type = 'click' THEN event_id END), false) END AS tested FROM events GROUP BY user_id", raw=True)
def test_after_last_edit(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "purchase", "test_run").otherwise(F.col("event_type"))
    return lookup.tested_after_edit(e.select("user_id", F.col("event_id").alias("id"), kind.alias("event")), "user_id")


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", raw=True)
def event_props_json(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("+w AS (SELECT path, CASE WHEN indexed_at % 3 = 0 THEN 'x' ELSE hash END AS hash FROM files UNION ALL SELECT 'src/new.ts', 'y') SELECT w.path, w.hash, f.path IS NULL AS is_new FROM w LEFT JOIN files f USING (path) WHERE f.path IS NULL OR f.hash <> w.hash", "files")
def stale_files(g):
    walked = g.files.select("path", F.when(F.col("indexed_at") % 3 == 0, "x").otherwise(F.col("hash")).alias("hash"))
    return lookup.stale_files(g, walked.unionAll(g.files.sparkSession.createDataFrame([("src/new.ts", "y")], "path string, hash string")))


# --- changes -------------------------------------------------------------------


@query("+n AS (SELECT path, 'rust' AS language, max(indexed_at) + 1 AS ts FROM files WHERE language = 'go' GROUP BY path) SELECT f.path, f.language, f.indexed_at FROM files f WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT * FROM n", "files")
def upsert_latest_wins(g):
    go = g.files.where("language = 'go'")
    new = go.select("path", F.lit("old").alias("language"), "hash", "indexed_at", F.lit(1).alias("seq")).unionAll(go.select("path", F.lit("rust"), "hash", F.col("indexed_at") + 1, F.lit(2)))
    return changes.upsert(g.files, new, ["path"], "seq").select("path", "language", "indexed_at")


@query("SELECT e.* FROM edges e WHERE NOT (kind IN ('defines', 'references') AND source IN (SELECT path FROM files WHERE language = 'go')) AND NOT (kind = 'calls' AND source IN (SELECT id FROM symbols WHERE file_path IN (SELECT path FROM files WHERE language = 'go')))", "files symbols edges")
def edges_clear_semantic(g):
    return changes.clear_semantic(g, g.files.where("language = 'go'").select("path"))


@query("SELECT * FROM edges WHERE source NOT IN (SELECT path FROM files WHERE language = 'go')", "files edges")
def edges_clear_file(g):
    return changes.clear_edges(g.edges, g.files.where("language = 'go'").select("path"))


@query("SELECT * FROM dirty WHERE NOT starts_with(path, 'src/n1/')", "dirty")
def dirty_clear_prefix(g):
    return changes.clear_dirty(g.dirty, "src/n1")


@query("""+d AS (SELECT file_path, range_start AS d0, range_end AS d1, symbol_id AS source FROM occurrences WHERE roles & 1 = 1),
r AS (SELECT file_path, range_start, range_end, symbol_id AS target FROM occurrences WHERE roles & 1 = 0),
b AS (SELECT r.file_path, target, source, row_number() OVER (PARTITION BY r.file_path, range_start, range_end, target ORDER BY d0 DESC, source DESC) AS n FROM r JOIN d ON r.file_path = d.file_path AND d0 <= range_start AND range_end <= d1)
SELECT source, target, count(*) AS n FROM (SELECT DISTINCT file_path, source, target FROM b WHERE n = 1 AND source <> target) GROUP BY ALL""", "occurrences")
def call_edges_enclosing(g):
    return changes.call_edges(g.occurrences).groupBy("source", "target").agg(F.count("*").alias("n"))


# --- prefixes, modules, metrics ---------------------------------------------------

PKG = "pk AS (SELECT x.path, arg_max(project_id, length(root)) AS package FROM (SELECT path FROM files UNION SELECT source FROM edges) x JOIN projects ON x.path = root OR starts_with(x.path, root || '/') GROUP BY 1)"


@query(f"+{PKG} SELECT path, package FROM files LEFT JOIN pk USING (path)", "files edges projects")
def project_for_path(g):
    return prefix.package_of(g, g.files.select("path"))


LAYERS = "ly(layer, prefix, can) AS (VALUES ('one', 'src/n1/', ['two']), ('two', 'src/n2/', []), ('rest', 'src/', ['one'])), lp AS (SELECT x.path, arg_max(layer, length(prefix)) AS layer FROM (SELECT source AS path FROM edges UNION SELECT target FROM edges) x JOIN ly ON starts_with(x.path, prefix) GROUP BY 1)"


def _layers(g: Graph) -> DataFrame:
    return g.files.sparkSession.createDataFrame([("one", "src/n1/", ["two"]), ("two", "src/n2/", []), ("rest", "src/", ["one"])], "layer string, prefix string, can_import array<string>")


@query(f"+{LAYERS} SELECT path, layer FROM files LEFT JOIN (SELECT path, layer FROM (SELECT x.path, arg_max(layer, length(prefix)) AS layer FROM files x JOIN ly ON starts_with(x.path, prefix) GROUP BY 1)) USING (path)", "files edges")
def layer_for_path(g):
    return prefix.longest_prefix(g.files.select("path"), "path", _layers(g), "prefix", "layer", "layer")


@query(f"+{LAYERS} SELECT 'boundaries' AS check, 'BOUNDARY_VIOLATION' AS type, source AS subject, a.layer || ' must not import ' || b.layer || ': ' || target AS message FROM edges JOIN lp a ON a.path = source JOIN lp b ON b.path = target JOIN ly ON ly.layer = a.layer WHERE kind = 'imports' AND a.layer <> b.layer AND NOT list_contains(can, b.layer)", "edges")
def boundary_violations(g):
    return verify.boundaries(g, _layers(g))


COUPLING = "i AS (SELECT DISTINCT source, target FROM {0} WHERE kind = 'imports'), cp AS (SELECT module, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, floor(coalesce(ce, 0)::DOUBLE / (coalesce(ca, 0) + coalesce(ce, 0)) * 1000 + 0.5) / 1000 AS instability FROM (SELECT target AS module, count(*) AS ca FROM i GROUP BY 1) FULL JOIN (SELECT source AS module, count(*) AS ce FROM i GROUP BY 1) USING (module))"


@query("+" + COUPLING.format("edges") + " SELECT * FROM cp", "edges")
def coupling(g):
    return metrics.coupling(g)


@query("+" + COUPLING.format("(SELECT * FROM edges WHERE starts_with(source, 'src/n1'))") + " SELECT * FROM cp", "edges")
def coupling_scoped(g):
    return metrics.coupling(g, SCOPE)


@query(f"+{PKG} SELECT coalesce(package, 'unknown') AS package, count(*) AS exports FROM edges LEFT JOIN pk ON path = source WHERE kind = 'exports' GROUP BY 1", "files edges projects")
def api_surface(g):
    return metrics.api_surface(g)


SEM = "sem AS (SELECT o.file_path AS \"from\", s.file_path AS \"to\", count(*) AS weight FROM occurrences o JOIN symbols s ON s.id = o.symbol_id WHERE roles & 1 = 0 AND o.file_path <> s.file_path AND o.file_path IN (SELECT path FROM files) AND s.file_path IN (SELECT path FROM files) GROUP BY ALL)"


@query("SELECT source AS \"from\", target AS \"to\", kind FROM edges WHERE kind IN ('imports', 'exports') AND starts_with(source, 'src/n1')", "edges")
def module_graph_imports(g):
    return modules.import_edges(g, SCOPE).select("from", "to", "kind")


@query(f"+{SEM} SELECT \"from\", \"to\", 'semantic' AS kind, weight FROM sem", "files symbols occurrences")
def module_graph_semantic(g):
    return modules.semantic_edges(g)


@query(f"+{SEM}, im AS (SELECT source AS \"from\", target AS \"to\", min(kind) AS i FROM edges WHERE kind IN ('imports', 'exports') GROUP BY ALL) SELECT \"from\", \"to\", CASE WHEN i IS NULL THEN 'semantic' WHEN weight IS NULL THEN 'import' ELSE 'import+semantic' END AS kind, weight FROM im FULL JOIN sem USING (\"from\", \"to\")", "files symbols occurrences edges")
def module_graph_hybrid(g):
    return modules.hybrid_edges(g)


@query(f"+n AS (SELECT path, max(d) AS d FROM (SELECT file_path AS path, 1 AS d FROM symbols WHERE id = '{SYMBOL}' UNION ALL SELECT file_path, 0 FROM occurrences WHERE symbol_id = '{SYMBOL}') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12) SELECT n.path, coalesce(language, 'unknown') AS language FROM n LEFT JOIN files USING (path)", "files symbols occurrences")
def symbol_graph(g):
    return modules.symbol_graph(g, SYMBOL, 12)[0]


@query(r"SELECT path, regexp_replace(path, '[/.\-]', '_', 'g') AS id FROM files", "files")
def mermaid_nodes(g):
    return modules.mermaid_ids(g.files)


@query("SELECT '  \"' || source || '\" -> \"' || target || '\" [label=\"' || kind || '\"];' AS line FROM edges WHERE kind IN ('imports', 'exports')", "edges")
def dot_edges(g):
    return modules.dot_lines(modules.import_edges(g))


# --- graph search ------------------------------------------------------------------

SCC = "im AS (SELECT DISTINCT source AS a, target AS b FROM {0} WHERE kind = 'imports' AND source <> target), reach(a, b) AS (SELECT a, b FROM im UNION SELECT r.a, im.b FROM reach r JOIN im ON r.b = im.a), cy AS (SELECT x.a AS node, least(x.a, min(x.b)) AS comp FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a), cs AS (SELECT comp AS first, list_sort(list(node)) AS members, count(*)::INT AS size FROM cy GROUP BY comp)"


@query("+" + SCC.format("edges") + " SELECT first, array_to_string(members, ',') AS members, size FROM cs", "edges")
def cycles(g):
    return traverse.cycles(g).withColumn("members", F.array_join("members", ","))


@query("+" + SCC.format("edges") + " SELECT count(*) AS total, coalesce(max(size), 0)::INT AS largest, count(*) > 0 AS has_cycles FROM cs", "edges")
def cycle_summary(g):
    return metrics.cycle_summary(g)


CALLS = "r(id, depth) AS (SELECT DISTINCT {b}, 1 FROM edges WHERE kind = 'calls' AND {a} = '{s}' UNION SELECT e.{b}, r.depth + 1 FROM r JOIN edges e ON e.{a} = r.id AND e.kind = 'calls' WHERE r.depth < 2) SELECT '{d}' AS direction, id, name, file_path, min(depth)::INT AS depth FROM r JOIN symbols USING (id) GROUP BY ALL"


@query("+" + CALLS.format(a="target", b="source", d="caller", s=CALLED).replace("GROUP BY ALL", "GROUP BY id, name, file_path"), "symbols edges")
def call_graph_callers_d2(g):
    return traverse.call_graph(g.stored("edges"), CALLED, 2).where("direction = 'caller'").drop("kind")


@query("+" + CALLS.format(a="source", b="target", d="callee", s=CALLED).replace("GROUP BY ALL", "GROUP BY id, name, file_path"), "symbols edges")
def call_graph_callees_d2(g):
    return traverse.call_graph(g.stored("edges"), CALLED, 2).where("direction = 'callee'").drop("kind")


@query(f"+{CH} SELECT s.id, s.kind, s.name, o.file_path AS def_path FROM occurrences o JOIN symbols s ON s.id = o.symbol_id WHERE roles & 1 = 1 AND o.file_path IN (SELECT node FROM ch)", "symbols occurrences")
def impact_changed_symbols(g):
    return impact.changed_symbols(g, _paths(g)).select("id", "kind", "name", "def_path")


DEPS = f"{CH}, df AS (SELECT DISTINCT symbol_id, name FROM occurrences JOIN symbols ON id = symbol_id WHERE roles & 1 = 1 AND occurrences.file_path IN (SELECT node FROM ch)), de AS (SELECT file_path AS path, 0 AS rank, 'references ' || name AS reason FROM occurrences JOIN df USING (symbol_id) UNION ALL SELECT source, 1, 'imports ' || node FROM edges JOIN ch ON target IN (node, {STEM.format('node')})), dd AS (SELECT path, arg_min(reason, (rank, reason)) AS reason FROM de WHERE path NOT IN (SELECT node FROM ch) GROUP BY path)"


@query(f"+{DEPS} SELECT path, reason FROM dd", "symbols occurrences edges")
def impact_dependents(g):
    return impact.dependents(g, _paths(g))


@query(f"+{DEPS} SELECT path, CASE WHEN path LIKE '%.py' THEN 'pytest ' ELSE 'vitest run ' END || path AS command FROM (SELECT path FROM dd UNION SELECT node FROM ch) WHERE regexp_matches(path, '{TEST_SQL}')", "symbols occurrences edges")
def impact_tests(g):
    return impact.recommended_tests(g, _paths(g))


@query(f"+{CH} SELECT symbol_id, file_path, line FROM (SELECT symbol_id, file_path, (range_start >> 16)::INT AS line, row_number() OVER (PARTITION BY symbol_id ORDER BY file_path, range_start) AS n FROM occurrences WHERE roles & 1 = 0 AND symbol_id IN (SELECT symbol_id FROM occurrences WHERE roles & 1 = 1 AND file_path IN (SELECT node FROM ch))) WHERE n <= 3", "occurrences")
def impact_key_refs(g):
    return impact.reference_lines(impact.key_references(g, _paths(g)))


BFS = f"{CH}, bf(path, depth) AS (SELECT node, 0 FROM ch UNION SELECT e.source, bf.depth + 1 FROM bf JOIN edges e ON e.target IN (bf.path, {STEM.format('bf.path')}) WHERE bf.depth < 5), af AS (SELECT path, min(depth)::INT AS depth FROM bf GROUP BY path HAVING min(depth) > 0)"


ALL = "oc AS (SELECT * FROM occurrences)"
FULL = f"{ALL}, {CH}, dp AS (SELECT DISTINCT d.file_path AS a, o.file_path AS b FROM oc d JOIN oc o USING (symbol_id) WHERE d.roles & 1 = 1 UNION SELECT f.path, e.source FROM (SELECT path FROM files UNION SELECT source FROM edges) f JOIN edges e ON e.target = f.path UNION SELECT f.path, e.source FROM (SELECT path FROM files UNION SELECT source FROM edges) f JOIN edges e ON e.target = {STEM.format('f.path')}), bf(path, depth) AS (SELECT node, 0 FROM ch UNION SELECT b, depth + 1 FROM bf JOIN dp ON a = path WHERE depth < 5), af AS (SELECT path, min(depth)::INT AS depth FROM bf GROUP BY path HAVING min(depth) > 0)"


@query(f"+{BFS} SELECT path, depth FROM af", "edges")
def transitive_importers(g):
    g = g.stored("edges")
    found = traverse.reach(_paths(g), lambda f: traverse.importers(g, f).select("node", F.lit(0).alias("rank"), "via"), 5)
    return found.where("depth > 0").select(F.col("node").alias("path"), "depth")


@query(f"+{FULL} SELECT path, depth FROM af", "files occurrences edges")
def transitive_affected_files(g):
    return impact.affected(g.stored("occurrences", "edges"), _paths(g)).select("path", "depth")


@query(f"+{FULL}, {PKG} SELECT DISTINCT package FROM pk WHERE path IN (SELECT path FROM af UNION SELECT node FROM ch)", "files occurrences edges projects")
def transitive_packages(g):
    return impact.transitive(g.stored("occurrences", "edges"), CHANGED)["packages"]


BREAKS = "pu AS (SELECT id, any_value(name) AS name FROM oc JOIN symbols ON id = symbol_id WHERE roles & 1 = 1 AND oc.file_path IN (SELECT node FROM ch) AND oc.file_path IN (SELECT source FROM edges WHERE kind = 'exports') GROUP BY id), px AS (SELECT path, arg_max(project_id, length(root)) AS package FROM (SELECT DISTINCT file_path AS path FROM oc UNION SELECT node FROM ch) x JOIN projects ON x.path = root OR starts_with(x.path, root || '/') GROUP BY 1), br AS (SELECT id, name, array_to_string(list_sort(list(DISTINCT package)), ',') AS downstream FROM pu JOIN oc ON symbol_id = id JOIN px ON path = file_path WHERE roles & 1 = 0 AND package NOT IN (SELECT package FROM px WHERE path IN (SELECT node FROM ch)) GROUP BY ALL)"


@query(f"+{ALL}, {CH}, {BREAKS} SELECT id, name, downstream FROM br".replace("GROUP BY ALL", "GROUP BY id, name"), "symbols occurrences edges projects")
def transitive_api_breaks(g):
    return impact.api_breaks(g, _paths(g)).withColumn("downstream", F.array_join("downstream", ","))


@query(f"""+{FULL}, {PKG}, {BREAKS.replace('GROUP BY ALL', 'GROUP BY id, name')}, k AS (SELECT (SELECT count(*) FROM af) AS affected, (SELECT count(*) FROM af WHERE NOT regexp_matches(path, '{TEST_SQL}')) AS untested,
(SELECT count(*) FROM files) AS files, (SELECT count(DISTINCT package) FROM pk WHERE path IN (SELECT path FROM af UNION SELECT node FROM ch)) AS packages, (SELECT count(*) FROM projects) AS projects, (SELECT count(*) FROM br) AS breaks, (SELECT count(*) FROM pu) AS public),
x AS (SELECT *, least(greatest(0.25::DOUBLE * (affected / files) + 0.30::DOUBLE * least(breaks / 3.0::DOUBLE, 1.0) + 0.15::DOUBLE * (packages / projects) + 0.20::DOUBLE * (CASE WHEN affected > 0 THEN untested / affected ELSE 0 END) + 0.10::DOUBLE * (CASE WHEN public > 0 THEN least(breaks / public, 1.0) ELSE 0 END), 0), 1) AS x FROM k)
SELECT affected, untested, packages, breaks, floor(x * 1000 + 0.5) / 1000 AS score, CASE WHEN x < 0.3 THEN 'low' WHEN x < 0.6 THEN 'medium' WHEN x < 0.8 THEN 'high' ELSE 'critical' END AS category, CASE WHEN breaks <= 0 THEN 'none' WHEN breaks < 2 THEN 'low' WHEN breaks < 5 THEN 'medium' ELSE 'high' END AS boundary_risk FROM x""", "files symbols occurrences edges projects")
def transitive_risk(g):
    return impact.transitive(g.stored("occurrences", "edges"), CHANGED)["risk"]


@query(f"+{FULL} SELECT path, CASE WHEN depth <= 1 THEN 'direct' ELSE 'transitive' END AS relevance FROM af WHERE regexp_matches(path, '{TEST_SQL}') UNION ALL SELECT node, 'direct' FROM ch WHERE regexp_matches(node, '{TEST_SQL}')", "files occurrences edges")
def transitive_tests(g):
    return impact.transitive(g.stored("occurrences", "edges"), CHANGED)["tests"]


CALLING = f"{CH}, dc AS (SELECT DISTINCT file_path AS a, symbol_id FROM occurrences WHERE roles & 1 = 1), nx AS (SELECT a, o.file_path AS b FROM dc JOIN occurrences o USING (symbol_id) UNION SELECT a, s.file_path FROM dc JOIN edges e ON e.target = dc.symbol_id AND e.kind = 'calls' JOIN symbols s ON s.id = e.source UNION SELECT p.path, e.source FROM (SELECT path FROM files UNION SELECT file_path FROM symbols) p JOIN edges e ON e.target IN (p.path, {STEM.format('p.path')})), bf(path, depth) AS (SELECT node, 0 FROM ch UNION SELECT b, depth + 1 FROM bf JOIN nx ON a = path WHERE depth < 5)"


@query(f"+{CALLING} SELECT path, min(depth)::INT AS depth FROM bf GROUP BY path HAVING min(depth) > 0", "files symbols occurrences edges")
def transitive_callers(g):
    return impact.affected(g.stored("occurrences", "edges"), _paths(g), call_graph=True).select("path", "depth")


@query(f"+{CH}, i AS (SELECT DISTINCT symbol_id FROM occurrences WHERE roles & 1 = 1 AND file_path IN (SELECT node FROM ch)) SELECT id, name, kind, doc, coalesce((range_start >> 16)::INT, 0) AS start_line, coalesce((range_end >> 16)::INT, 0) AS end_line FROM symbols WHERE id IN (SELECT symbol_id FROM i)", "symbols occurrences")
def impact_symbol_details(g):
    return impact.symbol_details(g, _paths(g)).select("id", "name", "kind", "doc", "start_line", "end_line")


# --- snapshots and checks --------------------------------------------------------------


def _old(g: Graph) -> Graph:
    """An earlier state: without the edges of files in folders n1 and n10 to n19."""
    return g.having(edges=g.edges.where("NOT startswith(source, 'src/n1')"))


def _modules(g: Graph) -> Graph:
    """The graph with its import and export edges stored: all that metrics, policies and layers read."""
    return g.having(edges=g.edges.where("kind IN ('imports', 'exports')")).stored("edges")


OLD = "(SELECT * FROM edges WHERE NOT starts_with(source, 'src/n1'))"


@query("+" + COUPLING.format("edges") + ", " + COUPLING.format(OLD).replace("i AS", "i2 AS").replace("FROM i ", "FROM i2 ").replace("cp AS", "c2 AS") + """,
m AS (SELECT module, unnest(['ca', 'ce', 'instability']) AS metric, unnest([c2.ca, c2.ce, c2.instability]::DOUBLE[]) AS previous, unnest([cp.ca, cp.ce, cp.instability]::DOUBLE[]) AS current FROM cp JOIN c2 USING (module))
SELECT *, floor((current - previous) * 1000 + 0.5) / 1000 AS delta FROM m WHERE floor((current - previous) * 1000 + 0.5) / 1000 > 0""", "edges")
def metrics_diff_coupling(g):
    return metrics.diff_coupling(metrics.coupling(g), metrics.coupling(_old(g)))


@query("+" + SCC.format("edges") + ", " + SCC.format(OLD).replace("im ", "im2 ").replace("im.", "im2.").replace("reach", "reach2").replace("cy ", "cy2 ").replace("cs AS", "cs2 AS") + """
SELECT 'new' AS change, array_to_string(members, ',') AS members FROM cs WHERE members NOT IN (SELECT members FROM cs2)
UNION ALL SELECT 'removed', array_to_string(members, ',') FROM cs2 WHERE members NOT IN (SELECT members FROM cs)""", "edges")
def metrics_diff_cycles(g):
    g = _modules(g)
    return metrics.diff_cycles(metrics.cycles(g), metrics.cycles(_old(g))).withColumn("members", F.array_join("members", ","))


@query(f"+{PKG}, a1 AS (SELECT coalesce(package, 'unknown') AS package, count(*) AS c, count(*) FILTER (NOT starts_with(source, 'src/n1')) AS p FROM edges LEFT JOIN pk ON path = source WHERE kind = 'exports' GROUP BY 1) SELECT package, p AS previous, c AS current, c - p AS delta FROM a1 WHERE c <> p", "files edges projects")
def metrics_diff_api(g):
    return metrics.diff_api(metrics.api_surface(g), metrics.api_surface(_old(g)))


RULES = {"deny_new_cycles": True, "max_public_api_growth": 10, "max_coupling_increase": 0.3}
POLICIES = (
    SCC.format("edges") + ", " + SCC.format(OLD).replace("im ", "im2 ").replace("im.", "im2.").replace("reach", "reach2").replace("cy ", "cy2 ").replace("cs AS", "cs2 AS")
    + ", " + COUPLING.format("edges") + ", " + COUPLING.format(OLD).replace("i AS", "i2 AS").replace("FROM i ", "FROM i2 ").replace("cp AS", "c2 AS") + ", " + PKG
    + """, a1 AS (SELECT coalesce(package, 'unknown') AS package, count(*) AS c, count(*) FILTER (NOT starts_with(source, 'src/n1')) AS p FROM edges LEFT JOIN pk ON path = source WHERE kind = 'exports' GROUP BY 1),
mx AS (SELECT module, unnest(['ca', 'ce', 'instability']) AS metric, unnest([c2.ca, c2.ce, c2.instability]::DOUBLE[]) AS previous, unnest([cp.ca, cp.ce, cp.instability]::DOUBLE[]) AS current FROM cp JOIN c2 USING (module)),
po AS (SELECT 'NEW_CYCLE' AS type, array_to_string(members, ' -> ') AS subject FROM cs WHERE members NOT IN (SELECT members FROM cs2)
  UNION ALL SELECT 'API_GROWTH', package FROM a1 WHERE c - p > 10 UNION ALL SELECT 'COUPLING_INCREASE', module FROM mx WHERE floor((current - previous) * 1000 + 0.5) / 1000 > 0.3)"""
)


def _before(g: Graph) -> dict[str, DataFrame]:
    old = _old(g)
    return {"cycles": metrics.cycles(old), "api": metrics.api_surface(old), "coupling": metrics.coupling(old)}


@query(f"+{POLICIES} SELECT type, subject FROM po", "files edges projects")
def policy_violations(g):
    g = _modules(g)
    return verify.policies(g, RULES, _before(g)).select("type", "subject")


@query("SELECT 'index_freshness' AS check, 'STALE_INDEX' AS type, path AS subject, 'changed after the last index: ' || path AS message FROM dirty WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|py)$') AND changed_at > 899000000000", "dirty")
def freshness_issues(g):
    return verify.freshness(g)


# --- context and preflight ---------------------------------------------------------------


def _level(d: int) -> str:
    """Files first met at level d, from those of level d - 1; the search ends after a level with which 100 files are known."""
    known = " UNION ALL ".join(f"SELECT * FROM v{k}" for k in range(d))
    w = f"1.0::DOUBLE / {1 + d}"
    test = f"CASE WHEN regexp_matches(node, '{TEST_SQL}') THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END"
    return f"""k{d} AS ({known}),
c{d} AS (SELECT arg_min(f.path, e.no) AS node, 0 AS rank, via, '' AS sym, 1.0::DOUBLE AS w, 'imported by ' || via AS reason FROM (SELECT v.node AS via, target, unnest(range({len(fixed.CONTEXT_EXTENSIONS) + 1})) AS no, unnest([''] || {fixed.CONTEXT_EXTENSIONS}) AS ext FROM v{d - 1} v JOIN edges ON source = v.node WHERE kind = 'imports') e JOIN files f ON f.path = target || ext GROUP BY via, target
  UNION ALL SELECT source, 1, node, '', 0.6::DOUBLE, 'imports ' || node FROM v{d - 1} JOIN edges ON target IN (node, {STEM.format('node')})
  UNION ALL SELECT node, 2, via, sym, 0.8::DOUBLE * (1 + 0.3::DOUBLE * least(1.0::DOUBLE, min(n) / 5.0::DOUBLE)), 'references symbol from ' || via FROM (SELECT o.file_path AS node, via, sym, row_number() OVER (PARTITION BY via, sym ORDER BY o.file_path) AS n FROM (SELECT DISTINCT symbol_id AS sym, v.node AS via FROM v{d - 1} v JOIN oc ON file_path = v.node WHERE roles & 1 = 1) s JOIN oc o ON o.symbol_id = sym WHERE roles & 1 = 0) GROUP BY node, via, sym),
v{d} AS (SELECT node, {d} AS depth, arg_min({w} * w * {test}, (rank, via, sym)) AS priority, arg_min(reason, (rank, via, sym)) AS reason FROM c{d} WHERE node NOT IN (SELECT node FROM k{d}) AND (SELECT count(*) FROM k{d}) < {context.MOST if d > 1 else 1 << 30} GROUP BY node)"""


CONTEXT = f"""{ALL}, v0 AS (SELECT path AS node, 0 AS depth, 1.0::DOUBLE AS priority, 'entry file' AS reason FROM files WHERE path = '{FILE}'),
{_level(1)},
{_level(2)},
{_level(3)},
cx AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2 UNION ALL SELECT * FROM v3)"""


@query(f"+{CONTEXT} SELECT node AS path, depth, round(priority, 6) AS priority, reason FROM cx", "files occurrences edges")
def context_bfs(g):
    return context.discover(g.stored("occurrences", "edges"), [FILE]).withColumn("priority", F.round("priority", 6))


#: The fold over the ordered files, one step of the recursion for each.
BUDGET = """sz AS (SELECT node AS path, priority, depth, coalesce(ceil(length(content) / 4), 0)::BIGINT AS whole, content FROM cx LEFT JOIN contents ON path = node),
sg AS (SELECT sz.path, ceil((sum(length(string_split(sz.content, chr(10))[(range_start >> 16) + 1])) + count(*) - 1) / 4)::BIGINT AS sig FROM sz JOIN symbols ON file_path = sz.path WHERE kind <> '' AND range_start IS NOT NULL AND (range_start >> 16) < len(string_split(sz.content, chr(10))) GROUP BY 1),
od AS (SELECT *, coalesce(sig, 0) AS brief, row_number() OVER (ORDER BY priority DESC, depth, path) AS pos FROM sz LEFT JOIN sg USING (path)),
fd AS (SELECT 0 AS pos, '' AS path, 0.0::DOUBLE AS priority, 0 AS depth, '' AS mode, 0::BIGINT AS tokens, 0::BIGINT AS total
  UNION ALL SELECT od.pos::INT, od.path, od.priority, od.depth, CASE WHEN total + whole <= 8000 THEN 'full' ELSE 'signatures' END, CASE WHEN total + whole <= 8000 THEN whole ELSE brief END, total + CASE WHEN total + whole <= 8000 THEN whole ELSE brief END FROM fd JOIN od ON od.pos = fd.pos + 1 WHERE od.pos <= 100 AND total + least(whole, brief) <= 8000 AND (total + whole <= 8000 OR total + brief <= 8000))"""


@query(f"+{CONTEXT}, {BUDGET} SELECT pos, path, round(priority, 6) AS priority, depth, mode, tokens, total FROM fd WHERE pos > 0", "files symbols occurrences edges contents")
def context_budget(g):
    return context.compile_context(g.stored("occurrences", "edges"), [FILE], budget=8000).withColumn("priority", F.round("priority", 6))


@query(f"SELECT s.id, name, kind, coalesce(bool_or(o.file_path <> '{FILE}'), false) AS is_exported, count(*) FILTER (o.file_path <> '{FILE}') AS n_call_sites, coalesce(array_to_string(list_sort(list(DISTINCT o.file_path) FILTER (regexp_matches(o.file_path, '{TEST_SQL}'))), ','), '') AS test_files FROM symbols s LEFT JOIN occurrences o ON o.symbol_id = s.id AND roles & 1 = 0 WHERE s.file_path = '{FILE}' GROUP BY s.id, name, kind", "symbols occurrences")
def preflight_symbols(g):
    return preflight.symbols(g, FILE).drop("signature").withColumn("test_files", F.array_join("test_files", ","))


@query(f"+u AS (SELECT count(DISTINCT o.file_path) AS n FROM symbols s JOIN occurrences o ON o.symbol_id = s.id WHERE roles & 1 = 0 AND s.file_path = '{FILE}' AND o.file_path <> '{FILE}') SELECT n AS direct, n AS transitive, CASE WHEN n <= 2 THEN 'low' WHEN n <= 5 THEN 'medium' WHEN n <= 10 THEN 'high' ELSE 'critical' END AS risk FROM u", "symbols occurrences")
def preflight_blast_fast(g):
    return preflight.blast_radius(g, FILE, True)


@query(f"+u AS (SELECT s.id, name, o.file_path AS f, row_number() OVER (PARTITION BY s.id ORDER BY o.file_path, o.range_start) AS k FROM symbols s JOIN occurrences o ON o.symbol_id = s.id WHERE roles & 1 = 0 AND s.file_path = '{FILE}' AND o.file_path <> '{FILE}') SELECT name, 'If you change ''' || name || ''', update ' || count(*) || ' call site' || CASE WHEN count(*) > 1 THEN 's' ELSE '' END || ' in: ' || array_to_string(list_sort(list(DISTINCT string_split(f, '/')[-1])), ', ') AS text FROM u WHERE k <= 5 GROUP BY id, name", "symbols occurrences")
def preflight_checklist(g):
    return preflight.checklist(g, FILE, True).where("no = 1").select("name", "text")


@query(f"+{ALL} SELECT symbol_id, oc.file_path AS file, (oc.range_start >> 16)::INT AS line FROM oc JOIN symbols s ON s.id = symbol_id WHERE roles & 1 = 0 AND s.file_path = 'src/n0/s0.ts' AND oc.file_path <> 'src/n0/s0.ts'", "symbols occurrences")
def preflight_call_sites(g):
    return preflight.call_sites(g, "src/n0/s0.ts").select("symbol_id", "file", "line")


@query(f"+{LAYERS} SELECT a.layer, array_to_string(any_value(can), ',') AS can_import, coalesce(array_to_string(list_sort(list(DISTINCT e.target)), ','), '') AS broken FROM (SELECT 'two' AS layer) a JOIN ly USING (layer) LEFT JOIN (SELECT target, 'two' AS layer FROM edges JOIN lp b ON b.path = target WHERE kind = 'imports' AND source = 'src/n2/s52.go' AND b.layer <> 'two') e USING (layer) GROUP BY 1", "edges")
def preflight_boundary(g):
    return preflight.boundary(g, "src/n2/s52.go", _layers(g)).withColumns({c: F.array_join(c, ",") for c in ("can_import", "broken")})


@query(f"+{CONTEXT}, {BUDGET} SELECT count(*) AS files, max(total)::BIGINT AS tokens, bool_or(mode = 'signatures') AS truncated, count(DISTINCT string_split(path, '/')[1] || '/' || string_split(path, '/')[2]) AS packages, count(*) FILTER (regexp_matches(path, '{TEST_SQL}')) AS tests FROM fd WHERE pos > 0", "files symbols occurrences edges contents")
def context_summary(g):
    return context.summary(context.compile_context(g.stored("occurrences", "edges"), [FILE], budget=8000))


# --- feeds ------------------------------------------------------------------------------


@query("SELECT CASE WHEN count(*) >= 5 THEN true ELSE false END AS due, count(*) AS n_dirty FROM dirty", "dirty")
def reindex_due(g):
    return feeds.reindex_due(g.dirty)


@query("SELECT id, event, data FROM ledger UNION ALL SELECT (SELECT max(id) FROM ledger) + row_number() OVER (ORDER BY timestamp, event, data, id), 'again', data FROM ledger WHERE event = 'edit'", "ledger")
def ledger_append(g):
    # the data of equal times are equal here or told apart by the order
    return changes.log_events(g.ledger, g.ledger.where("event = 'edit'").select("timestamp", F.lit("again").alias("event"), "data")).select("id", "event", "data")


@query("SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, count(*) AS edits FROM events WHERE event_type = 'click' GROUP BY 1", raw=True)
def stream_recent_edits(spark, sf_dir):
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    edits = rows.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "click", "edit").otherwise(F.col("event_type")).alias("event"))
    out = feeds.drain(feeds.recent_edits(edits))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "edits")


@query("SELECT user_id, max(event_id) FILTER (event_type = 'click') AS last_edit, max(event_id) FILTER (event_type = 'purchase') AS last_test, max(event_id) FILTER (event_type = 'click') IS NULL OR coalesce(max(event_id) FILTER (event_type = 'purchase') > max(event_id) FILTER (event_type = 'click'), false) AS tested FROM events GROUP BY 1", raw=True)
def stream_test_gate(spark, sf_dir):
    kind = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    named = F.when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "purchase", "test_run").otherwise(F.col("event_type"))
    return feeds.drain(feeds.test_gate(rows.select("user_id", F.col("event_id").alias("id"), named.alias("event")), "user_id"))


# --- text -------------------------------------------------------------------------------


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages", raw=True)
def href_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("href"))


@query("SELECT doc_id, (ceil(length(text) / 4))::BIGINT AS tokens, sha256(text) AS hash FROM documents", raw=True)
def token_estimate_and_hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", token_estimate(F.col("text")).alias("tokens"), content_hash(F.col("text")).alias("hash"))


SECRETS = "'AKIA' || upper(substr(HASH, 1, 16)) || ' ghp_' || substr(HASH, 1, 20) || ' postgres://u:p@h/' || doc_id || ' Bearer ' || HASH || ' API_TOKEN=' || HASH || ' ' || text"


@query("SELECT doc_id, " + "".join(f"regexp_replace(" for _ in fixed.SECRETS) + SECRETS.replace("HASH", "sha256(text)") + "".join(f", '{p.replace(chr(39), chr(39) * 2)}', '{r.replace('$1', chr(92) + '1')}', 'g')" for p, r in fixed.SECRETS) + " AS text FROM documents", raw=True)
def redact(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", redaction.redact(F.expr(SECRETS.replace("HASH", "sha2(text, 256)"))).alias("text"))


def _corpus(spark, rows, names):
    return spark.createDataFrame(rows, names)


@query(samples.resolve_sql(), raw=True)
def import_resolution(spark, sf_dir):
    rows = _corpus(spark, samples.RESOLVE, "path string, language string, specifier string, target string").drop("target")
    return resolve(rows.select("path", "language", F.lit(0).alias("no"), "specifier", F.lit("import").alias("kind")), _corpus(spark, [(k,) for k in samples.KNOWN], "path string")).select("path", "language", "specifier", "target")


@query(samples.artifact_sql(), raw=True)
def artifact_symbols(spark, sf_dir):
    return artifacts.extract(_corpus(spark, samples.ARTIFACTS, "path string, content string")).select("id", "kind", "file_path", "line")


@query(samples.refs_sql(), raw=True)
def config_refs(spark, sf_dir):
    found = artifacts.extract(_corpus(spark, samples.ARTIFACTS, "path string, content string"))
    return artifacts.config_references(_corpus(spark, samples.USES, "path string, content string"), found).select("source", "target", "confidence")


@query(f"SELECT path, {STEM.format('path')} AS stem, regexp_matches(path, '{TEST_SQL}') AS is_test, CASE WHEN path LIKE '%.py' THEN 'pytest ' || path WHEN path LIKE '%.java' THEN 'mvn test -pl ' || regexp_replace(path, '/src/.*', '') ELSE 'vitest run ' || path END AS command FROM files", "files")
def path_functions(g):
    p = F.col("path")
    return g.files.select("path", stem(p).alias("stem"), is_test(p).alias("is_test"), test_command(p).alias("command"))


@query("SELECT c_custkey, 'a/' || (c_custkey % 7) || '/c' AS path FROM customer", raw=True)
def path_normalize(spark, sf_dir):
    k = F.col("c_custkey")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", normalize(F.concat(F.lit("./a/b/.././"), (k % 7).cast("string"), F.lit("//x/../c"))).alias("path"))


@query(samples.projects_sql(), raw=True)
def detect_projects(spark, sf_dir):
    listing = _corpus(spark, [(p,) for p in samples.LISTING], "path string")
    return files.detect_projects(listing, _corpus(spark, [(samples.MANIFEST,)], "content string"))


@query(samples.ingest_sql(), raw=True)
def index_ingest(spark, sf_dir):
    docs = spark.createDataFrame(samples.INDEX, schemas.SCIP_DOCS)
    return changes.ingest(graph_of(spark), docs, 1).edges


@query(samples.update_sql(), raw=True)
def structural_update(spark, sf_dir):
    walked = _corpus(spark, samples.CODE, "path string, language string, content string").withColumn("hash", content_hash(F.col("content")))
    stored = walked.where("path < 'c'").select("path", "language", "hash", F.lit(1).cast("bigint").alias("indexed_at"))
    return changes.update(graph_of(spark, files=stored), walked, 2).edges.where("kind = 'imports'").groupBy("source").agg(F.count("*").alias("imports"))


# --- symbol strings, source text and compiler output made of whole tables --------------

SYMBOL_SQL = "'scip-x npm pkg 1.0.0 src/`f' || p_partkey || '.ts`/' || CASE p_partkey % 7 WHEN 0 THEN 'Name' || p_partkey || '#' WHEN 1 THEN 'Name#meth' || p_partkey || '().' WHEN 2 THEN 'fn' || p_partkey || '().' WHEN 3 THEN 'var' || p_partkey || '.' WHEN 4 THEN 'fn().(arg' || p_partkey || ')' WHEN 5 THEN 'T' || p_partkey || '#[P]' ELSE '' END"


@query(f"""SELECT symbol, coalesce(regexp_extract_all(replace(symbol, '#', '##'), '[/#]([A-Za-z_$][A-Za-z0-9_$]*)(?:\\(\\))?[.#]', 1)[-1], translate(list_filter(string_split_regex(symbol, '[\\s/]'), lambda x: x <> '' AND NOT starts_with(x, '`'))[-1], '()#.', '')) AS name,
CASE WHEN regexp_matches(symbol, '{fixed.PARAMETER_SUFFIX}') THEN 'parameter' WHEN regexp_matches(symbol, '{fixed.TYPE_PARAMETER_SUFFIX}') THEN 'type_parameter' WHEN symbol LIKE '%#' THEN 'class' WHEN regexp_matches(symbol, '{fixed.METHOD_SUFFIX}') THEN 'method' WHEN regexp_matches(symbol, '{fixed.FUNCTION_SUFFIX}') THEN 'function' WHEN symbol LIKE '%.' THEN 'variable' END AS kind
FROM (SELECT {SYMBOL_SQL} AS symbol FROM part WHERE p_partkey % 7 < 6)""", raw=True)
def scip_symbol_names(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 7 < 6").select(F.expr(SYMBOL_SQL).alias("symbol"))  # form 6 is none
    return rows.select("symbol", S.short_name(F.col("symbol")).alias("name"), S.inferred_kind(F.col("symbol")).alias("kind"))


LANGUAGES = ["typescript", "python", "rust", "java", "scala", "csharp", "ruby", "go"]
IMPORT_LANGUAGE = "CASE p_partkey % 8 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(LANGUAGES)) + " END"
CODE = {
    "typescript": ["import a, b from './no'", "import {{ x as y }} from './a{k}'", "export * as n from \"../b{k}\"", "const c = require('c{k}')", "import 'side{k}';", "const d = await import('./d{k}')"],
    "python": ["import os.m{k}", "from pkg{k}.x import y", "from .r{k} import z", "  import indented"],
    "rust": ["use crate::a{k}::b;", "mod m{k};", "extern crate c{k};", "use std::io::{{Read, Write}};"],
    "java": ["import java.u{k}.List;", "import static a.b{k}.*;", "class X {{}}"],
    "scala": ["import a{k}.b._", "import c{k}.{{D, E}}"],
    "csharp": ["using System.N{k};", "using static A{k}.B;", "using Z = C{k}.D;"],
    "ruby": ["require 'r{k}'", "require_relative './s{k}'", "load 'l{k}.rb'"],
    "go": ["package m", "import \"fmt{k}\"", "import (", "  \"os\"", "  al \"x/y{k}\"", ")"],
}


def _code_sql(join: str) -> str:
    """The content of part's file as SQL."""
    quote = lambda t: "'" + t.format(k="@@").replace("'", "' || chr(39) || '").replace("@@", "' || p_partkey || '") + "'"
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {n} THEN " + f" || {join} || ".join(quote(t) for t in CODE[x]) for n, x in enumerate(LANGUAGES)) + " END"


def _all_of(pattern: str, of: str = "content", group: int = 1) -> str:
    return f"regexp_extract_all({of}, '{pattern.replace(chr(39), chr(39) * 2)}', {group})"


def _imports_case() -> str:
    own = lambda p: f"list_transform({_all_of(p)}, lambda x: {{'s': x, 'k': 'import'}})"
    static = f"list_transform(range(1, len({_all_of(fixed.TS_IMPORT)}) + 1), lambda i: {{'s': ({_all_of(fixed.TS_IMPORT)})[i], 'k': CASE WHEN starts_with(({_all_of(fixed.TS_IMPORT, group=0)})[i], 'export') THEN 'export' ELSE 'import' END}})"
    fresh = lambda p: f"list_transform(list_filter({_all_of(p)}, lambda x: NOT list_contains({_all_of(fixed.TS_IMPORT)} || {_all_of(fixed.TS_REQUIRE)}, x)), lambda x: {{'s': x, 'k': 'import'}})"
    cases = {"typescript": " || ".join([static, own(fixed.TS_REQUIRE), fresh(fixed.TS_SIDE_EFFECT), fresh(fixed.TS_DYNAMIC_IMPORT)])}
    block = f"list_transform({_all_of(fixed.GO_IMPORT_LINE, f'array_to_string({_all_of(fixed.GO_IMPORT_BLOCK)}, chr(10))')}, lambda x: {{'s': x, 'k': 'import'}})"
    cases["go"] = f"{own(fixed.GO_IMPORT_SINGLE)} || {block}"
    cases |= {name: " || ".join(map(own, patterns)) for name, patterns in fixed.IMPORTS.items()}
    return "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in cases.items()) + " END"


@query(f"SELECT path, e.s AS specifier, e.k AS kind FROM (SELECT path, unnest({_imports_case()}) AS e FROM (SELECT 'f' || p_partkey AS path, {IMPORT_LANGUAGE} AS language, {_code_sql('chr(10)')} AS content FROM part))", raw=True)
def import_extraction(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.expr("'f' || p_partkey").alias("path"), F.expr(IMPORT_LANGUAGE).alias("language"), F.expr(_code_sql("chr(10)")).alias("content"))
    return extract_imports(rows).select("path", "specifier", "kind")


K = "CAST(l_partkey AS STRING)"
AT = ("CAST(l_linenumber AS STRING)", "CAST(CAST(l_quantity AS INT) AS STRING)")
#: A line of output for each order line; most are errors.
LOGS = {
    "tsc": f"CASE l_returnflag WHEN 'N' THEN 'noise ' || {K} ELSE CASE l_returnflag WHEN 'R' THEN '/repo/' ELSE './' END || 'src/f' || CAST(l_partkey % 9 AS STRING) || '.ts(' || {AT[0]} || ',' || {AT[1]} || '): error TS' || CASE l_linenumber WHEN 1 THEN '2304' WHEN 2 THEN '2305' ELSE '2345' END || ': Module ' || chr(39) || 'm' || chr(39) || ' has no ' || chr(39) || 'v' || {K} || chr(39) || '.' END",
    "go": f"CASE l_returnflag WHEN 'N' THEN '# pkg' ELSE './pkg/f' || {K} || '.go:' || {AT[0]} || ':' || {AT[1]} || ': undefined: x' END",
    "cargo": f"CASE l_returnflag WHEN 'N' THEN '' ELSE 'error[E0' || {AT[1]} || ']: mismatched' || chr(10) END || '  --> src/f' || {K} || '.rs:' || {AT[0]} || ':' || {AT[1]}",
    "generic": f"CASE l_returnflag WHEN 'N' THEN 'F.java:1: warning' WHEN 'R' THEN 'F' || {K} || '.java:' || {AT[0]} || ': error: missing' ELSE 'F' || {K} || '.cs(' || {AT[0]} || ',' || {AT[1]} || '): error CS1002: ; expected' END",
}


def _logs(spark: SparkSession, sf_dir: str, tool: str) -> DataFrame:
    """A log for each supplier."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("log_id"), "l_orderkey", "l_linenumber", F.expr(LOGS[tool]).alias("line"))
    lines = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "line")))
    return rows.groupBy("log_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("output"))


def _log_sql(tool: str, wanted: str, pattern: str) -> str:
    """The first MOST_ERRORS wanted lines of each log, with the groups of the pattern."""
    p = pattern.replace("'", "''")
    groups = ", ".join(f"regexp_extract(trim(line), '{p}', {k}) AS g{k}" for k in range(1, 4))
    whole = LOGS[tool].replace("AS STRING", "AS VARCHAR")
    return f"""wh AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, whole) AS no FROM (SELECT l_suppkey AS log_id, l_orderkey, l_linenumber, {whole} AS whole FROM lineitem)),
ln AS (SELECT log_id, no, k, line, lag(line) OVER (PARTITION BY log_id ORDER BY no, k) AS prior FROM (SELECT log_id, no, unnest(string_split(whole, chr(10))) AS line, unnest(range(len(string_split(whole, chr(10))))) AS k FROM wh)),
er AS (SELECT *, {groups}, regexp_extract(trim(line), '{p}', {4 if tool == 'tsc' else 0}) AS g4 FROM ln WHERE {wanted} QUALIFY row_number() OVER (PARTITION BY log_id ORDER BY no, k) <= {fixed.MOST_ERRORS}),
pl AS (SELECT *, regexp_replace(regexp_replace(g1, '^/repo/', ''), '^\\./', '') AS file FROM er)"""


def _holds(text: str) -> str:
    return f"contains(line, '{text}')"


FOUND = 'log_id, file, g2::INT AS line, coalesce(try_cast(g3 AS INT), 0) AS col'
IMPACT_QUERY = f"'{compilers.TOOL} impact ' || file AS queries"


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("log_id", "file", "line", "col", "code", F.array_join("queries", ";").alias("queries"))


@query(f"WITH {_log_sql('tsc', _holds('error TS'), fixed.TSC_ERROR)} SELECT {FOUND}, g4 AS code, '{compilers.TOOL} impact ' || file || ';{compilers.TOOL} search ' || CASE g4 WHEN 'TS2305' THEN regexp_extract(line, 'no .(\\w+)', 1) ELSE 'm' END AS queries FROM pl", raw=True)
def tsc_parse(spark, sf_dir):
    return _found(compilers.tsc(_logs(spark, sf_dir, "tsc"), "/repo"))


@query(f"WITH {_log_sql('go', _holds('.go:'), fixed.GO_VET_ERROR)} SELECT {FOUND}, 'GO_VET' AS code, {IMPACT_QUERY} FROM pl", raw=True)
def go_vet_parse(spark, sf_dir):
    return _found(compilers.go_vet(_logs(spark, sf_dir, "go")))


@query(f"WITH {_log_sql('cargo', _holds('-->'), fixed.CARGO_PLACE)} SELECT {FOUND}, coalesce(regexp_extract(prior, '^error.([A-Z][0-9]+).', 1), '') AS code, {IMPACT_QUERY} FROM pl", raw=True)
def cargo_parse(spark, sf_dir):
    return _found(compilers.cargo(_logs(spark, sf_dir, "cargo")))


@query(f"WITH {_log_sql('generic', _holds('error'), fixed.GENERIC_ERROR)} SELECT {FOUND}, '' AS code, {IMPACT_QUERY} FROM pl", raw=True)
def generic_parse(spark, sf_dir):
    return _found(compilers.generic(_logs(spark, sf_dir, "generic")))


def _all_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _modules(derived(spark, sf_dir))
    return verify.verify(g, _layers(g), RULES, _before(g), _logs(spark, sf_dir, "tsc").withColumn("tool", F.lit("tsc")))


TYPECHECK = _log_sql("tsc", "contains(line, 'error TS')", fixed.TSC_ERROR)


@query("WITH RECURSIVE " + oracle_tables("files", "edges", "dirty", "ledger", "projects") + f""", {POLICIES}, {LAYERS}, {TYPECHECK}, s AS (SELECT 'index_freshness' AS "check", count(*) AS n FROM dirty WHERE regexp_matches(path, '\\.(ts|tsx|js|jsx|py)$') AND changed_at > 899000000000
UNION ALL SELECT 'boundaries', count(*) FROM edges JOIN lp a ON a.path = source JOIN lp b ON b.path = target JOIN ly ON ly.layer = a.layer WHERE kind = 'imports' AND a.layer <> b.layer AND NOT list_contains(can, b.layer)
UNION ALL SELECT 'missing_tests', CASE WHEN max(CASE WHEN event = 'edit' THEN id END) IS NULL OR max(CASE WHEN event = 'test_run' THEN id END) > max(CASE WHEN event = 'edit' THEN id END) THEN 0 ELSE 1 END FROM ledger
UNION ALL SELECT 'typecheck', count(*) FROM pl UNION ALL SELECT 'policies', count(*) FROM po)
SELECT "check", n AS n_issues, n = 0 AS passed FROM s""", raw=True)
def verify_summary(spark, sf_dir):
    return verify.summary(_all_issues(spark, sf_dir)).drop("first_message")


@query(f"WITH {TYPECHECK} SELECT file, count(*) AS errors FROM pl GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5", raw=True)
def worst_files(spark, sf_dir):
    logs = _logs(spark, sf_dir, "tsc").withColumn("tool", F.lit("tsc"))
    return verify.worst_files(verify.typecheck(logs.withColumn("output", F.replace("output", F.lit("/repo/"), F.lit(""))))).withColumnRenamed("subject", "file")


@query("SELECT id, timestamp, event FROM ledger WHERE id > 5 ORDER BY id", "ledger")
def ledger_in_order(g):
    return lookup.events_after(g.ledger, 0).where("id > 5").select("id", "timestamp", "event").orderBy("id")
