"""Small texts with their expected results, for functions over source code; both engines read the same rows."""

from __future__ import annotations


def _q(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def values(rows: list[tuple], *names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_q, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


CODE = [
    ("a.ts", "typescript", "import { x } from './x';\nimport * as y from \"./y\";\nimport z from 'z';\nimport type { T } from './t';\nexport { q } from './q';\nimport './side';\nconst r = require('req');\nconst d = await import('./dyn');\nimport a, { b } from './both';\n"),
    ("b.py", "python", "import os\nimport a.b.c\nfrom x.y import z\nfrom .rel import q\nfrom .. import w\n  import nested\n"),
    ("c.go", "go", "package c\nimport \"fmt\"\nimport str \"strings\"\nimport (\n  \"os\"\n  log \"x/log\"\n)\n"),
    ("d.rs", "rust", "use std::io::Read;\nuse crate::a::{B, C};\nuse x::*;\nmod sib;\nextern crate serde;\npub use no::no;\n"),
    ("E.java", "java", "import a.b.C;\nimport static a.b.D.e;\nimport a.*;\nimport k.Kotlin\n"),
    ("f.scala", "scala", "import a.b.C\nimport a.b._\nimport a.b.{X, Y}\n"),
    ("g.cs", "csharp", "using System.IO;\nusing static System.Math;\nusing A = B.C;\n"),
    ("h.rb", "ruby", "require 'json'\nrequire_relative \"lib/x\"\nload 'y.rb'\n"),
    ("i.txt", "unknown", "import nothing\n"),
]
IMPORTS = {
    "a.ts": [("./x", "import"), ("./y", "import"), ("z", "import"), ("./t", "import"), ("./q", "export"), ("./side", "import"), ("req", "import"), ("./dyn", "import")],
    "b.py": [("os", "import"), ("a.b.c", "import"), ("x.y", "import"), (".rel", "import"), ("..", "import"), (".rel", "import"), ("..", "import")],
    "c.go": [("fmt", "import"), ("strings", "import"), ("os", "import"), ("x/log", "import")],
    "d.rs": [("std::io::Read", "import"), ("crate::a::{B, C}", "import"), ("x::*", "import"), ("sib", "import"), ("serde", "import")],
    "E.java": [("a.b.C", "import"), ("a.b.D.e", "import"), ("a.*", "import")],
    "f.scala": [("a.b.C", "import"), ("a.b._", "import"), ("a.b.{X, Y}", "import")],
    "g.cs": [("System.IO", "import"), ("System.Math", "import"), ("B.C", "import")],
    "h.rb": [("json", "import"), ("lib/x", "import"), ("y.rb", "import")],
}


KNOWN = ["src/x.tsx", "src/lib/index.js", "src/y", "src/sib.rs", "src/m/mod.rs", "lib/r.rb"]
RESOLVE = [
    ("src/a.ts", "typescript", "./x", "src/x.tsx"), ("src/a.ts", "typescript", "./lib", "src/lib/index.js"), ("src/a.ts", "typescript", "./y", "src/y"),
    ("src/a.ts", "typescript", "../gone/./z", "gone/z"), ("src/a.ts", "typescript", "react", "react"), ("a.ts", "typescript", "../../up", "../../up"),
    ("p/q/b.py", "python", ".m.n", "p/q/m/n"), ("p/q/b.py", "python", "..m", "p/m"), ("p/q/b.py", "python", "..", "p"), ("p/q/b.py", "python", "os.path", "os.path"),
    ("src/d.rs", "rust", "crate::a::b::*", "src/a/b"), ("src/d.rs", "rust", "sib", "src/sib.rs"), ("src/d.rs", "rust", "m", "src/m/mod.rs"), ("src/d.rs", "rust", "no", "src/no.rs"), ("src/d.rs", "rust", "std::io", "std::io"),
    ("lib/h.rb", "ruby", "./r", "lib/r.rb"), ("lib/h.rb", "ruby", "./s", "lib/s"), ("lib/h.rb", "ruby", "json", "json"), ("c.go", "go", "fmt", "fmt"), ("g.cs", "csharp", "System.IO", "System.IO"),
]


def resolve_sql() -> str:
    return values(RESOLVE, "path", "language", "specifier", "target")


SYMBOLS = [
    ("scip-x npm core 0.1.0 src/`db.ts`/create().", "create", "function"), ("scip-x npm core 0.1.0 src/`q.ts`/Store#", "Store", "class"), ("scip-x npm core 0.1.0 src/`q.ts`/Store#upsert().", "upsert", "method"),
    ("scip-x npm core 0.1.0 src/`q.ts`/limit.", "limit", "variable"), ("scip-x npm core 0.1.0 src/`q.ts`/f().(arg)", "f", "parameter"), ("scip-x npm core 0.1.0 src/`q.ts`/C#[T]", "C", "type_parameter"),
    ("pkg `<constructor>`", "<constructor>", None), ("a 1.2.3 mod", "mod", None),
]


ARTIFACTS = [
    (".env", "# comment\nDB_URL=x\n\n  API_KEY = no\nKEY2=1\n"), ("app/.env.local", "ONLY=1"), ("package.json", "{\n \"name\": \"n\",\n \"scripts\": {\n  \"build\": \"x\",\n  \"test\": \"y\"\n },\n \"main\": \"m.js\"\n}"),
    ("tsconfig.json", "{\n \"compilerOptions\": {\n  \"strict\": true\n }\n}"), ("bad/package.json", "{ no json"), ("db/s.sql", "CREATE TABLE IF NOT EXISTS Users (id int);\nalter table orders add x int;\ncreate unique index idx_a on users(id);\n"),
    ("openapi.json", "{\"paths\": {\"/a\": {}, \"/b\": {}}, \"components\": {\"schemas\": {\"S\": {}}}}"), ("openapi.yaml", "openapi: 3\npaths:\n  /users:\n    get: x\ncomponents:\n  schemas:\n    User:\n      type: object\n"), ("other.txt", "X=1"),
]
ARTIFACT_ROWS = [
    ("artifact:env:DB_URL", "env_var", ".env", 1), ("artifact:env:KEY2", "env_var", ".env", 4), ("artifact:env:ONLY", "env_var", "app/.env.local", 0),
    ("artifact:script:build", "config_key", "package.json", 3), ("artifact:script:test", "config_key", "package.json", 4), ("artifact:pkg:name", "config_key", "package.json", 1), ("artifact:pkg:main", "config_key", "package.json", 6),
    ("artifact:tsconfig:strict", "config_key", "tsconfig.json", 2), ("artifact:table:Users", "table", "db/s.sql", 0), ("artifact:table:orders", "table", "db/s.sql", 1), ("artifact:index:idx_a", "index", "db/s.sql", 2),
    ("artifact:endpoint:/a", "api_endpoint", "openapi.json", 0), ("artifact:endpoint:/b", "api_endpoint", "openapi.json", 0), ("artifact:schema:S", "api_schema", "openapi.json", 0),
    ("artifact:endpoint:/users", "api_endpoint", "openapi.yaml", 2), ("artifact:schema:User", "api_schema", "openapi.yaml", 6),
]


def artifact_sql() -> str:
    return values(ARTIFACT_ROWS, "id", "kind", "file_path", "line")


USES = [
    ("u.ts", "process.env.DB_URL; process.env['KEY2']; import.meta.env.ONLY; process.env.DB_URLX"), ("u.py", "os.environ['KEY2'] os.getenv(\"DB_URL\") os.environ.get('ONLY')"), ("u.go", "os.Getenv(\"DB_URL\") os.LookupEnv(\"NONE\")"),
    ("u.rs", "env!(\"ONLY\") env::var(\"KEY2\")"), ("u.java", "System.getenv(\"DB_URL\")"), ("u.rb", "ENV['KEY2'] ENV.fetch('DB_URL')"), ("u.sql", "select * from USERS join `orders` on x; delete  from nothing"),
]
USE_ROWS = [(f, f"artifact:env:{n}", "high") for f, names in (("u.ts", ("DB_URL", "KEY2", "ONLY")), ("u.py", ("KEY2", "DB_URL", "ONLY")), ("u.go", ("DB_URL",)), ("u.rs", ("ONLY", "KEY2")), ("u.java", ("DB_URL",)), ("u.rb", ("KEY2", "DB_URL"))) for n in names] + [("u.sql", "artifact:table:Users", "approximate"), ("u.sql", "artifact:table:orders", "approximate")]


def refs_sql() -> str:
    return values(USE_ROWS, "source", "target", "confidence")


TSC = "/repo/src/a.ts(3,7): error TS2345: Argument of type 'Foo' is not assignable.\n./b.ts(10,1): error TS2304: Cannot find name 'bar'.\nnoise\nerror TS5000: no place\n"


GO = "# pkg\n./main.go:10:5: undefined: x\n/a/b.go:3:1: bad call\nnoise\n"
CARGO = "error[E0308]: mismatched types\n  --> src/main.rs:10:5\n --> src/lib.rs:2:1\nerror[E0001]: lost\nerror[E0002]: other\n  --> src/x.rs:7:9\n"
GENERIC = "A.java:10: error: missing\nsrc/B.cs(4,7): error CS1002: ; expected\n[warn] C.scala:3: nothing\nD.txt:1: error: no\n"


LISTING = ["package.json", "packages/a/tsconfig.json", "packages/a/pyproject.toml", "packages/b/go.mod", "packages/c/readme.md", "tools/Cargo.toml", "packages/a/node_modules/x/tsconfig.json", "apps/web/App.csproj", "packages/d/deep/pom.xml"]
MANIFEST = "{\"workspaces\": [\"packages/*\", \"apps/web\"]}"


def projects_sql() -> str:
    rows = [("packages/a", "typescript"), ("packages/a", "python"), ("packages/b", "go"), ("apps/web", "csharp")]
    return values([(r, r, x) for r, x in rows], "project_id", "root", "language")


def _occ(symbol: str, at: list[int], roles: int = 0) -> dict:
    return {"symbol": symbol, "range": at, "symbol_roles": roles}


def _sym(symbol: str, kind: int = 0) -> dict:
    return {"symbol": symbol, "kind": kind, "display_name": "", "documentation": []}


INDEX = [
    {"relative_path": "./a.ts", "language": "TypeScript", "symbols": [_sym("p a/foo().", 17), _sym("p a/Bar#")], "occurrences": [_occ("p a/foo().", [0, 0, 10, 0], 1), _occ("p a/Bar#", [12, 0, 5], 1), _occ("p b/baz().", [5, 4, 7]), _occ("p a/foo().", [6, 0, 3]), _occ("local 1", [1, 0, 2]), _occ("", [1, 0, 2])]},
    {"relative_path": "b.ts", "language": "", "symbols": [_sym("p b/baz().")], "occurrences": [_occ("p b/baz().", [0, 0, 3, 0], 1), _occ("p a/Bar#", [9, 0, 3])]},
]


def ingest_sql() -> str:
    rows = [("a.ts", "p a/foo().", "defines", "high"), ("a.ts", "p a/Bar#", "defines", "high"), ("a.ts", "p b/baz().", "references", "high"), ("a.ts", "p a/foo().", "references", "high"), ("b.ts", "p b/baz().", "defines", "high"), ("b.ts", "p a/Bar#", "references", "high"), ("p a/foo().", "p b/baz().", "calls", "approximate")]
    return values(rows, "source", "target", "kind", "confidence")


def update_sql() -> str:
    return values([(p, len(rows)) for p, rows in IMPORTS.items() if p >= "c"], "source", "imports")
