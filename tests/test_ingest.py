"""Sources, ingest, incremental updates and feeds."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codeloom import schemas
from codeloom.operators import changes, lookup
from codeloom.plans import samples
from codeloom.plans.graph import graph_of, load, save
from codeloom.sources import files, scip
from codeloom.streaming import feeds

OCC = "file_path string, range_start int, range_end int, symbol_id string, roles int"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def encoded(docs):
    out = field(1, b"\x10\x01")  # metadata is skipped
    for d in docs:
        body = field(1, d["relative_path"]) + field(4, d["language"])
        for o in d["occurrences"]:
            packed = b"".join(map(varint, o["range"]))
            body += field(2, field(1, packed) + field(2, o["symbol"]) + (field(3, o["symbol_roles"]) if o["symbol_roles"] else b"") + varint(9 << 3 | 5) + b"abcd")
        for s in d["symbols"]:
            body += field(3, field(1, s["symbol"]) + field(5, s["kind"]) + field(6, s["display_name"]) + field(3, "doc"))
        out += field(2, body)
    return out


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame(samples.INDEX, schemas.SCIP_DOCS)


def test_decode(spark, tmp_path):
    (tmp_path / "index.scip").write_bytes(encoded(samples.INDEX))
    got = scip.read(spark, str(tmp_path / "index.scip")).orderBy("relative_path").collect()
    assert [r["relative_path"] for r in got] == ["./a.ts", "b.ts"]
    assert [(o["symbol"], o["range"], o["symbol_roles"]) for o in got[0]["occurrences"]] == [(o["symbol"], o["range"], o["symbol_roles"]) for o in samples.INDEX[0]["occurrences"]]
    assert [(s["kind"], s["documentation"]) for s in got[0]["symbols"]] == [(17, ["doc"]), (0, ["doc"])]
    (tmp_path / "index.json").write_text("\n".join(map(json.dumps, samples.INDEX)))
    assert scip.read_json(spark, str(tmp_path / "index.json")).count() == 2


def test_ingest(spark, index):
    g = changes.ingest(graph_of(spark), index, 7)
    assert rows(g.files, "path", "language", "indexed_at") == [("a.ts", "typescript", 7), ("b.ts", "typescript", 7)]
    assert rows(g.symbols, "id", "kind", "name", "file_path", "range_start") == [("p a/Bar#", "class", "Bar", "a.ts", 12 << 16), ("p a/foo().", "function", "foo", "a.ts", 0), ("p b/baz().", "function", "baz", "b.ts", 0)]
    assert g.occurrences.count() == 6 and rows(g.edges.groupBy("kind").count()) == [("calls", 1), ("defines", 3), ("references", 3)]
    assert rows(g.edges.where("kind = 'calls'"), "source", "target") == [("p a/foo().", "p b/baz().")]
    again = changes.ingest(g, index, 8)  # a second time replaces, and adds nothing
    assert (again.occurrences.count(), again.edges.count(), again.symbols.count()) == (6, 7, 3)


def test_ingest_skips_same_hash(spark, index):
    first = changes.ingest(graph_of(spark), index, 1, spark.createDataFrame([("a.ts", "x"), ("b.ts", "y")], "path string, hash string"))
    second = changes.ingest(first, index, 2, spark.createDataFrame([("a.ts", "x"), ("b.ts", "z")], "path string, hash string"))
    assert rows(second.files, "path", "hash", "indexed_at") == [("a.ts", "x", 1), ("b.ts", "z", 2)]
    assert rows(changes.ingest(graph_of(spark), index, 1, root="pkg").files, "path") == [("pkg/a.ts",), ("pkg/b.ts",)]


@pytest.mark.parametrize("seed", range(2))
def test_calls_equal_nested_loops(spark, seed):
    rnd = random.Random(seed)
    occ = {}
    for _ in range(60):
        f, a = f"f{rnd.randrange(2)}", rnd.randrange(40)
        occ[f, a << 16, f"d{rnd.randrange(8)}"] = (a << 16, (a + rnd.choice([0, 1, 3, 4, 15, 30])) << 16 | 9, rnd.choice([1, 0, 0]))
    data = [(f, a, z, s, r) for (f, _, s), (a, z, r) in occ.items()]
    want = set()
    for f, a, z, s, r in data:
        inside = [(d0, t) for g, d0, d1, t, q in data if q and g == f and d0 <= a and z <= d1] if not r else []
        if inside and max(inside)[1] != s:
            want.add((f, max(inside)[1], s))
    got = changes.call_edges(spark.createDataFrame(data, OCC))
    assert rows(got, "source", "target") == sorted((a, b) for _, a, b in want)


def test_enclosing_range_counts(spark):
    data = [("f", 0, 3, "foo", 1, 0, 20 << 16), ("f", 5 << 16, 5 << 16 | 3, "bar", 0, None, None)]
    occ = spark.createDataFrame(data, OCC + ", enclosing_start int, enclosing_end int")
    assert rows(changes.call_edges(occ), "source", "target") == [("foo", "bar")]
    assert changes.call_edges(occ.drop("enclosing_start", "enclosing_end")).count() == 0


def test_upsert_and_deletes(spark):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "k string, v int, w string")
    new = spark.createDataFrame([("a", 3, None, 1), ("a", 4, None, 2), ("c", 5, "z", 1)], "k string, v int, w string, seq int")
    assert rows(changes.upsert(base, new, ["k"], "seq")) == [("a", 4, None), ("b", 2, None), ("c", 5, "z")]
    g = graph_of(spark, files=[("a.ts", "typescript", "h", 1), ("b.ts", "typescript", "h", 1)], symbols=[("s", "function", "s", "a.ts", 0, 1, None), ("t", "function", "t", "b.ts", 0, 1, None)], occurrences=[("a.ts", 0, 1, "s", 1)],
                 edges=[("a.ts", "s", "defines", "high"), ("a.ts", "x", "imports", "structural"), ("s", "t", "calls", "approximate"), ("t", "s", "calls", "approximate")])
    one = spark.createDataFrame([("a.ts",)], "path string")
    assert rows(changes.clear_semantic(g, one), "source", "kind") == [("a.ts", "imports"), ("t", "calls")]
    assert rows(changes.clear_edges(g.edges, one), "source") == [("s",), ("t",)]
    left = changes.delete_files(g, one)
    assert (rows(left.files, "path"), left.occurrences.count(), rows(left.edges, "source")) == ([("b.ts",)], 0, [("t",)])
    dirty = spark.createDataFrame([("src/a", 1), ("srcs/b", 2)], schemas.DIRTY)
    assert rows(changes.clear_dirty(dirty, "src"), "path") == [("srcs/b",)] and changes.clear_dirty(dirty, ".").count() == 0
    p = spark.createDataFrame([("a", "a", "go", 0)], schemas.PROJECTS)
    assert changes.set_project_time(p, "a", 9).first()["last_index_ts"] == 9 and changes.set_project_time(p, "b", 9).first()["last_index_ts"] == 0
    assert rows(changes.append_edges(g.edges.limit(0), spark.createDataFrame([("a", "b", "imports")], "source string, target string, kind string")), "confidence") == [("high",)]


def test_walk_and_update(spark, tmp_path):
    for name, text in {"src/a.ts": "import './b';\nexport { x } from './b';", "src/b.ts": "", "src/__init__.py": "", "node_modules/x/i.ts": "", "dist/o.js": "", ".hid/h.ts": "", "r.md": "", ".env": "A=1", "db/x.sql": "CREATE TABLE t(a int)", "openapi.json": "{}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    walked = files.source_files(spark, str(tmp_path))
    assert rows(walked, "path", "language") == [("src/__init__.py", "python"), ("src/a.ts", "typescript"), ("src/b.ts", "typescript")]
    assert rows(files.source_files(spark, str(tmp_path), ["src/b.ts", "gone.ts"]), "path") == [("src/b.ts",)]
    assert rows(files.artifact_files(spark, str(tmp_path)), "path") == [(".env",), ("db/x.sql",), ("openapi.json",)]
    save(changes.update(graph_of(spark), walked, 5), str(tmp_path / ".graph"), "v1")
    g = load(spark, str(tmp_path / ".graph"), "v1")
    assert rows(g.edges, "source", "target", "kind") == [("src/a.ts", "src/b.ts", "exports"), ("src/a.ts", "src/b.ts", "imports"), ("src/a.ts", "src/b.ts", "imports")]
    assert rows(g.dirty) == [("src/__init__.py", 5), ("src/a.ts", 5), ("src/b.ts", 5)]
    assert lookup.stale_files(g, walked).count() == 0
    same = changes.update(g.having(dirty=g.dirty.limit(0)), walked, 6)
    assert same.dirty.count() == 0 and same.edges.count() == 3
    (tmp_path / "src/a.ts").write_text("import './c';")
    new = changes.update(g, files.source_files(spark, str(tmp_path)), 7)
    assert rows(new.edges, "target", "kind") == [("src/c", "imports")] and rows(new.dirty) == [("src/__init__.py", 5), ("src/a.ts", 7), ("src/b.ts", 5)]


def test_changed_paths(spark):
    assert rows(files.changed_paths(spark, " a.ts \n\nb.ts\n")) == [("a.ts",), ("b.ts",)]
    assert files.changed_paths(spark, "").count() == 0


@pytest.mark.parametrize("listing, manifest, want", [
    (["package.json", "packages/a/tsconfig.json", "packages/b/go.mod", "x/go.mod"], {"workspaces": ["packages/*"]}, [("packages/a", "typescript"), ("packages/b", "go")]),
    (["package.json", "packages/a/setup.py"], {"workspaces": {"packages": ["packages/*"]}}, [("packages/a", "python")]),
    (["package.json", "packages/a/package.json"], {"workspaces": ["packages/*"]}, []),
    (["tsconfig.json", "Cargo.toml", "a/go.mod"], None, [(".", "rust"), (".", "typescript")]),
    (["a/pom.xml", "b/build.sbt", "c/Gemfile", "d/X.csproj", "build/go.mod", "e/f/go.mod", "node_modules/go.mod"], None, [("a", "java"), ("b", "scala"), ("c", "ruby"), ("d", "csharp")]),
    (["a/build.gradle", "a/build.gradle.kts"], "{ bad", [("a", "java")]),
    ([], None, []),
])
def test_projects(spark, listing, manifest, want):
    df = spark.createDataFrame([(p,) for p in listing], "path string")
    m = None if manifest is None else spark.createDataFrame([(manifest if isinstance(manifest, str) else json.dumps(manifest),)], "content string")
    assert rows(files.detect_projects(df, m), "root", "language") == want


@pytest.mark.parametrize("command, want", [("bun test x", True), ("npm test", True), ("cd x && PYTEST -q", True), ("npx jest", True), ("go test ./...", True), ("cargo test", True), ("playwright test", True), ("ls", False), ("mvn verify", False)])
def test_test_runs(spark, command, want):
    df = spark.createDataFrame([(1, command)], "timestamp bigint, command string")
    assert (feeds.test_runs(df).count() == 1) is want


def test_reindex_due(spark):
    d = lambda n: spark.createDataFrame([(f"f{k}", 1) for k in range(n)], schemas.DIRTY)
    assert tuple(feeds.reindex_due(d(4)).first()) == (False, 4) and tuple(feeds.reindex_due(d(5)).first()) == (True, 5)


def test_streams(spark, tmp_path):
    event = "ts timestamp, user bigint, id bigint, event string"
    spark.sql("SELECT timestamp'2024-01-01 00:01:00' AS ts, 1L AS user, 1L AS id, 'edit' AS event UNION ALL SELECT timestamp'2024-01-01 00:02:00', 1L, 2L, 'test_run' UNION ALL SELECT timestamp'2024-01-01 00:07:00', 2L, 3L, 'edit'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(event).parquet(str(tmp_path / "in"))
    assert rows(feeds.drain(feeds.test_gate(stream, "user")), "user", "tested") == [(1, True), (2, False)]
    assert [r["edits"] for r in feeds.drain(feeds.recent_edits(stream)).orderBy("window").collect()] == [1, 1]
    (tmp_path / "none").mkdir()
    assert feeds.drain(feeds.test_gate(spark.readStream.schema(event).parquet(str(tmp_path / "none")), "user")).count() == 0


def test_edit_stream(spark, tmp_path):
    edit = "path string, language string, hash string, content string, ts timestamp"
    spark.sql("SELECT 'a.ts' AS path, 'typescript' AS language, 'h1' AS hash, 'import \"./x\"' AS content, timestamp'2024-01-01 00:00:01' AS ts UNION ALL SELECT 'a.ts', 'typescript', 'h2', 'import \"./y\"', timestamp'2024-01-01 00:00:02'").write.parquet(str(tmp_path / "in"))
    kept = {}

    def save(g, n):
        kept[n] = rows(g.edges, "source", "target"), rows(g.files, "path", "hash")

    feeds.apply_edits(spark.readStream.schema(edit).parquet(str(tmp_path / "in")), lambda: graph_of(spark), save, str(tmp_path / "state")).awaitTermination()
    assert kept == {0: ([("a.ts", "y")], [("a.ts", "h2")])}
