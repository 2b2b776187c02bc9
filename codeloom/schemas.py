"""Schemas of the graph tables, as DDL."""

FILES = "path string, language string, hash string, indexed_at bigint"
SYMBOLS = "id string, kind string, name string, file_path string, range_start int, range_end int, doc string"
OCCURRENCES = "file_path string, range_start int, range_end int, symbol_id string, roles int"
EDGES = "source string, target string, kind string, confidence string"
LEDGER = "id bigint, timestamp bigint, event string, data string"
META = "key string, value string"
DIRTY = "path string, changed_at bigint"
PROJECTS = "project_id string, root string, language string, last_index_ts bigint"
CONTENTS = "path string, content string"
SCIP_DOCS = "relative_path string, language string, symbols array<struct<symbol:string,kind:int,display_name:string,documentation:array<string>>>, occurrences array<struct<symbol:string,range:array<int>,symbol_roles:int>>"
ISSUES = "check string, type string, subject string, message string"
TABLES = {"files": FILES, "symbols": SYMBOLS, "occurrences": OCCURRENCES, "edges": EDGES, "ledger": LEDGER, "meta": META, "dirty": DIRTY, "projects": PROJECTS, "contents": CONTENTS}
#: What an upsert identifies a row by; edges and the ledger are bags.
KEYS = {"files": ["path"], "symbols": ["id"], "occurrences": ["file_path", "range_start", "symbol_id"], "meta": ["key"], "dirty": ["path"], "projects": ["project_id"], "contents": ["path"]}
