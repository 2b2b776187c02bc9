"""Functions over paths, symbols, source text, secrets, compiler output and reports."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import compilers, paths, redaction, scoring
from codeloom.functions import symbols as S
from codeloom.functions.imports import extract_imports, resolve
from codeloom.plans import samples
from codeloom.sources import artifacts, reports


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("path, want", [
    ("a.test.ts", True), ("a.spec.jsx", True), ("test_a.py", True), ("latest_a.py", True), ("a_test.py", True), ("a_test.go", True), ("a_test.rs", True), ("ATest.java", True), ("ATest.kt", True),
    ("ATests.cs", True), ("a_test.rb", True), ("a_spec.rb", True), ("ASpec.scala", True), ("ATest.scala", True), ("a.ts", False), ("test.ts", False), ("atest.java", False), ("", False),
])
def test_test_files(spark, path, want):
    assert one(spark, path, paths.is_test) is want


@pytest.mark.parametrize("path, want", [
    ("a/b.py", "pytest a/b.py"), ("a/b_test.go", "go test ./a/..."), ("x_test.rs", "cargo test"), ("m/src/test/A.java", "mvn test -pl m"), ("ASpec.scala", "sbt test"), ("ATests.cs", "dotnet test"), ("a_spec.rb", "bundle exec ruby a_spec.rb"), ("a.test.ts", "vitest run a.test.ts"),
])
def test_commands(spark, path, want):
    assert one(spark, path, paths.test_command) == want


@pytest.mark.parametrize("path, want", [("a/./b/../c", "a/c"), ("../../x", "../../x"), ("a/../..", ".."), ("", "."), ("./", "."), ("a//b", "a/b")])
def test_normalize(spark, path, want):
    assert one(spark, path, paths.normalize) == want


def test_paths(spark):
    assert [one(spark, p, paths.language_of) for p in ("a.kt", "a.rb", ".env", "a", "x/y.tsx")] == ["java", "ruby", "unknown", "unknown", "typescript"]
    assert one(spark, "a.b/c", paths.stem) == "a" and one(spark, "a/b.test.ts", paths.stem) == "a/b.test"
    assert one(spark, "a", paths.dirname) == "." and one(spark, "a/b/c", paths.dirname) == "a/b"
    assert one(spark, "a/b/c", paths.prefixes) == ["a/b/c", "a/b", "a"]
    assert one(spark, -0.0005, paths.round3, "double") == 0.0 and one(spark, 0.0005, paths.round3, "double") == 0.001
    assert one(spark, "abcde", paths.token_estimate) == 2 and one(spark, None, paths.is_test) is None


def test_ranges(spark):
    r = lambda v: tuple(one(spark, v, S.range_of, "array<int>"))
    assert r([10, 5, 9]) == (10 << 16 | 5, 10 << 16 | 9) and r([0, 0, 7, 3]) == (0, 7 << 16 | 3)
    assert one(spark, 655365, S.line_of, "int") == 10 and one(spark, 655365, S.column_of, "int") == 5


def test_symbol_names_and_kinds(spark):
    rows = spark.createDataFrame([(s,) for s, _, _ in samples.SYMBOLS], "s string").select("s", S.short_name(F.col("s")), S.inferred_kind(F.col("s"))).collect()
    assert {tuple(r) for r in rows} == set(samples.SYMBOLS)
    assert [one(spark, k, S.kind_name, "int") for k in (1, 17, 82, 0, 99)] == ["array", "function", "static_variable", None, None]
    assert one(spark, "p a/foo().", lambda s: S.display_name(F.lit(""), s)) == "foo"


def test_imports(spark):
    rows = extract_imports(spark.createDataFrame(samples.CODE, "path string, language string, content string")).orderBy("path", "no").collect()
    got = {}
    for r in rows:
        got.setdefault(r["path"], []).append((r["specifier"], r["kind"]))
    assert got == samples.IMPORTS
    assert extract_imports(spark.createDataFrame([("a.ts", "typescript", None), ("b.ts", None, "import 'x'")], "path string, language string, content string")).count() == 0


def test_resolution(spark):
    frame = spark.createDataFrame(samples.RESOLVE, "path string, language string, specifier string, want string").select("path", "language", F.lit(0).alias("no"), "specifier", F.lit("import").alias("kind"), "want")
    known = spark.createDataFrame([(k,) for k in samples.KNOWN], "path string")
    rows = resolve(frame.drop("want"), known).collect()
    assert {(r["path"], r["language"], r["specifier"], r["target"]) for r in rows} == set(samples.RESOLVE)
    assert resolve(frame.drop("want").where("specifier = './x'")).first()["target"] == "src/x"


def test_artifacts(spark):
    found = artifacts.extract(spark.createDataFrame(samples.ARTIFACTS, "path string, content string"))
    assert sorted((r["id"], r["kind"], r["file_path"], r["line"]) for r in found.collect()) == sorted(samples.ARTIFACT_ROWS)
    uses = artifacts.config_references(spark.createDataFrame(samples.USES, "path string, content string"), found)
    assert sorted((r["source"], r["target"], r["confidence"]) for r in uses.collect()) == sorted(samples.USE_ROWS)


@pytest.mark.parametrize("text, want", [
    ("t ghp_" + "a" * 20, "t [REDACTED]"), ("ghs_" + "A1_" * 8, "[REDACTED]"), ("gho_" + "b" * 16, "[REDACTED]"), ("github_pat_" + "c" * 22, "[REDACTED]"), ("sk_live_" + "d" * 10, "[REDACTED]"), ("pk_test_" + "d" * 10, "[REDACTED]"),
    ("sk-" + "e" * 20, "[REDACTED]"), ("sk-ant-" + "f-" * 12 + "x", "[REDACTED]"), ("AKIA" + "A1" * 8, "[REDACTED]"), ("eyJ" + "a" * 30 + ".bb.cc", "[REDACTED]"), ("redis://u:p@h x", "redis://[REDACTED] x"),
    ("Bearer " + "g" * 24, "Bearer [REDACTED]"), ("MY_API_KEY=12345678", "MY_API_KEY=[REDACTED]"), ("MY_API_KEY=short", "MY_API_KEY=short"), ("ghp_short", "ghp_short"), ("plain text", "plain text"), ("", ""),
])
def test_redaction(spark, text, want):
    assert one(spark, text, redaction.redact) == want


def test_redaction_of_reports(spark, tmp_path):
    key = "AKIA" + "B2" * 8
    df = spark.createDataFrame([(1, [key], {"k": key}, (key, 2), None)], "n int, a array<string>, m map<string,string>, s struct<x: string, y: int>, z string")
    r = redaction.redact_report(df).first()
    assert (r["n"], r["a"], r["m"], tuple(r["s"]), r["z"]) == (1, ["[REDACTED]"], {"k": "[REDACTED]"}, ("[REDACTED]", 2), None)
    reports.write_report(df, str(tmp_path / "r"))
    assert key not in spark.read.text(str(tmp_path / "r")).first()["value"]


def log(spark, text):
    return spark.createDataFrame([(0, text)], "log_id int, output string")


def places(df):
    return [(r["file"], r["line"], r["col"], r["code"]) for r in df.orderBy("no").collect()]


def test_compilers(spark):
    assert places(compilers.tsc(log(spark, samples.TSC), "/repo")) == [("src/a.ts", 3, 7, "TS2345"), ("b.ts", 10, 1, "TS2304"), ("", 0, 0, "")]
    assert places(compilers.go_vet(log(spark, samples.GO))) == [("main.go", 10, 5, "GO_VET"), ("a/b.go", 3, 1, "GO_VET")]
    assert places(compilers.cargo(log(spark, samples.CARGO))) == [("src/main.rs", 10, 5, "E0308"), ("src/lib.rs", 2, 1, ""), ("src/x.rs", 7, 9, "E0002")]
    assert [p[:2] for p in places(compilers.generic(log(spark, samples.GENERIC)))] == [("A.java", 10), ("src/B.cs", 4)]
    assert compilers.tsc(log(spark, "a.ts(1,1): error TS1: x\n" * 30)).count() == 20
    assert compilers.cargo(log(spark, "")).count() == 0


def test_suggestions(spark):
    q = lambda line: compilers.tsc(log(spark, line)).first()["queries"]
    assert q("a.ts(1,2): error TS2304: Cannot find name 'foo'.") == ["codeloom query impact a.ts", "codeloom query search foo"]
    assert q("a.ts(1,2): error TS2305: Module 'm' has no exported member 'X'.") == ["codeloom query impact a.ts", "codeloom query search X"]
    assert q("a.ts(1,2): error TS9999: 'foo'.") == ["codeloom query impact a.ts"]


@pytest.mark.parametrize("x, want", [(0.29999, "low"), (0.3, "medium"), (0.6, "high"), (0.8, "critical"), (0.0, "low"), (1.0, "critical")])
def test_risk_levels(spark, x, want):
    assert one(spark, x, scoring.risk_category, "double") == want


@pytest.mark.parametrize("n, fast, edge", [(0, "low", "none"), (1, "low", "low"), (2, "low", "medium"), (4, "medium", "medium"), (5, "medium", "high"), (10, "high", "high"), (11, "critical", "high")])
def test_count_levels(spark, n, fast, edge):
    assert one(spark, n, scoring.fast_risk, "int") == fast and one(spark, n, scoring.boundary_risk, "int") == edge


def test_risk_without_anything(spark):
    z = F.lit(0)
    assert spark.range(1).select(scoring.risk(z, z, z, z, z, z, F.lit(0.0)).alias("r")).first()["r"] == 0.0


def test_reports():
    assert reports.envelope("x", {"a": 1}) == '{"ok": true, "kind": "x", "data": {"a": 1}}'
    assert '"ok": false' in reports.error("E", "m")
    checks = [{"check": "boundaries", "passed": False, "n_issues": 1, "first_message": "bad"}, {"check": "policies", "passed": False, "n_issues": 2, "first_message": "x"}, {"check": "typecheck", "passed": True, "n_issues": 0, "first_message": None}]
    text = reports.ci_markdown({"affected": 12, "score": 0.643, "category": "high", "breaks": 1, "new_cycles": 0, "tests": 2}, checks, [{"path": f"f{k}", "depth": 1 + k // 9, "reason": "r"} for k in range(12)])
    assert text.startswith("# High risk, 0.64\n## Reach [2]\n- files: 12\n") and "- policies: broken" in text
    assert "- boundaries: bad\n- policies: 2 issues\n- typecheck: none" in text and text.count("step") == 10 and text.endswith("- 2 steps: `f10`, r\n- and 2 more\n")
    out = reports.impact_text("a.ts", [f"s{k}" for k in range(25)], [f"d{k}" for k in range(12)], ["t1"], [{"name": "s0", "kind": "class", "doc": "one\ntwo\nthree"}] * 7, [{"name": "s0", "file_path": "d0", "snippet": "x\ny"}])
    assert "users [12]" in out and "- d9\n- and 2 more" in out and "- s19\n- and 5 more" in out and out.count("s0 | class | one / two") == 5 and "d0 | s0 | x" in out
    assert reports.impact_text("a.ts", [], [], []) == ""
    sym = [{"name": f"n{k}", "kind": "function", "sites": [{"file": "f", "line": i, "snippet": ""} for i in range(4)]} for k in range(12)] + [{"name": "v", "kind": "variable", "sites": [{"file": "f", "line": 1, "snippet": ""}]}]
    pre = reports.preflight_text("a.ts", {"direct": 3, "risk": "medium"}, sym, ["Run tests: t", "If you change 'n1', look", "If you change 'v', look"])
    assert pre.startswith("a.ts: medium risk, 3 files use it\nto do [2]\n- If you change 'n1', look\n- Run tests: t\n") and pre.count("(function) [4]") == 10 and pre.count("- and 1 more") == 10 and "v (" not in pre
    assert reports.preflight_text("a.ts", {"direct": 0, "risk": "low"}, [], []) == ""
    assert reports.default_layers(["packages/core", "packages/cli/"]) == {"layers": {"cli": {"path": "packages/cli/", "canImport": []}, "core": {"path": "packages/core/", "canImport": []}}}
