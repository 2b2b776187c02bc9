"""Fixed values. Results are right only with exactly these patterns, tables and constants."""

from __future__ import annotations

# --- files ---------------------------------------------------------------------

#: Extension -> language of the files that are indexed.
LANGUAGES = {
    ".ts": "typescript",
    ".tsx": "typescript",
    ".js": "javascript",
    ".jsx": "javascript",
    ".py": "python",
    ".go": "go",
    ".rs": "rust",
    ".java": "java",
    ".kt": "java",
    ".scala": "scala",
    ".cs": "csharp",
    ".rb": "ruby",
}
#: Folders that are not walked; any folder that starts with a dot isn't either.
SKIPPED_FOLDERS = ["node_modules", "dist"]
#: Further folders in which no project is looked for.
NO_PROJECT_FOLDERS = ["node_modules", "dist", "build", "out", "coverage", "__pycache__", "venv"]
ARTIFACT_NAMES = [".env", "package.json", "tsconfig.json"]
ARTIFACT_EXTENSIONS = [".sql", ".yaml", ".yml"]
ARTIFACT_STARTS = [".env", "openapi."]
#: Extensions that freshness looks at.
FRESH_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py"]
#: Language -> names of files that mark a project; a name that starts with a star is an ending.
PROJECT_MARKERS = {
    "typescript": ["tsconfig.json"],
    "python": ["pyproject.toml", "setup.py"],
    "go": ["go.mod"],
    "rust": ["Cargo.toml"],
    "java": ["pom.xml", "build.gradle", "build.gradle.kts"],
    "scala": ["build.sbt"],
    "csharp": ["*.sln", "*.csproj"],
    "ruby": ["Gemfile"],
}
#: What makes a path a test file; none is tied to the start of a name.
TEST_FILES = [
    r"\.test\.[tj]sx?$",
    r"\.spec\.[tj]sx?$",
    r"test_.*\.py$",
    r".*_test\.py$",
    r".*_test\.go$",
    r".*_test\.rs$",
    r"Test\.java$",
    r"Test\.kt$",
    r"Tests?\.cs$",
    r"_test\.rb$",
    r"_spec\.rb$",
    r"Spec\.scala$",
    r"Test\.scala$",
]
#: Commands that run tests.
TEST_RUNNERS = r"(?i)(vitest|jest|pytest|bun test|mocha|ava|cargo test|go test|npm test|npx vitest|npx jest|playwright)"

# --- imports: the specifier is group 1 --------------------------------------------

TS_IMPORT = r"""(?:import|export)\s+(?:type\s+)?(?:(?:\{[^}]*\}|\*\s+as\s+\w+|\w+)\s+from\s+)?['"]([^'"]+)['"]"""
TS_REQUIRE = r"""require\s*\(\s*['"]([^'"]+)['"]\s*\)"""
TS_SIDE_EFFECT = r"""(?m)^import\s+['"]([^'"]+)['"]\s*;?\s*$"""
TS_DYNAMIC_IMPORT = r"""\bimport\s*\(\s*['"]([^'"]+)['"]\s*\)"""
GO_IMPORT_SINGLE = r"""(?m)^import\s+(?:\w+\s+)?["']([^"']+)["']"""
GO_IMPORT_BLOCK = r"(?ms)^import\s*\(([^)]*)\)"
GO_IMPORT_LINE = r"""(?:\w+\s+)?["']([^"']+)["']"""
#: Languages whose patterns are all searched in turn.
IMPORTS = {
    "python": [
        r"(?m)^import\s+([\w.]+)",
        r"(?m)^from\s+([\w.]+)\s+import",
        r"(?m)^from\s+(\.+\w*)\s+import",
    ],
    "rust": [
        r"(?m)^use\s+([\w:]+(?:::\{[^}]+\})?(?:::\*)?)\s*;",
        r"(?m)^mod\s+(\w+)\s*;",
        r"(?m)^extern\s+crate\s+(\w+)\s*;",
    ],
    "java": [r"(?m)^import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;"],
    "scala": [r"(?m)^import\s+([\w.]+(?:\.\{[^}]+\}|\._|\.\*)?)\s*;?$"],
    "csharp": [r"(?m)^using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"],
    "ruby": [
        r"""(?m)^(?:require|require_relative)\s+['"]([^'"]+)['"]""",
        r"""(?m)^load\s+['"]([^'"]+)['"]""",
    ],
}
#: What a script's specifier is tried with, in this order.
RESOLVE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx"]
RESOLVE_INDEX_FILES = ["/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
CONTEXT_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs"]

# --- symbols -------------------------------------------------------------------

#: Bits of an occurrence's roles.
ROLES = {
    "definition": 1,
    "import": 2,
    "write": 4,
    "read": 8,
    "generated": 16,
    "test": 32,
    "forward_definition": 64,
}
#: Numbers of kinds in a symbol index.
KINDS = {
    1: "array",
    7: "class",
    8: "constant",
    9: "constructor",
    11: "enum",
    12: "enum_member",
    15: "field",
    17: "function",
    18: "getter",
    21: "interface",
    25: "macro",
    26: "method",
    29: "module",
    30: "namespace",
    33: "object",
    35: "package",
    37: "parameter",
    41: "property",
    45: "setter",
    49: "struct",
    53: "trait",
    54: "type",
    55: "type_alias",
    58: "type_parameter",
    61: "variable",
    66: "abstract_method",
    80: "static_method",
    81: "static_property",
    82: "static_variable",
}
DESCRIPTOR = r"(?<=/|#)([A-Za-z_$][A-Za-z0-9_$]*)(?:\(\))?[.#]"
QUOTED_NAME = r"`([^`]+)`"
SYMBOL_PARTS = r"[\s/]"
VERSION = r"^\d+\.\d+\.\d+$"
PARAMETER_SUFFIX = r"\([\w$]+\)$"
TYPE_PARAMETER_SUFFIX = r"\[[\w$]+\]$"
METHOD_SUFFIX = r"#[^/]*\(\)\.$"
FUNCTION_SUFFIX = r"\(\)\.$"

# --- configuration files -----------------------------------------------------------

PACKAGE_KEYS = ["name", "version", "main", "module", "types", "bin"]
CREATE_TABLE = r"""(?i)CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?["`]?(\w+)["`]?"""
ALTER_TABLE = r"""(?i)ALTER\s+TABLE\s+["`]?(\w+)["`]?"""
CREATE_INDEX = r"""(?i)CREATE\s+(?:UNIQUE\s+)?INDEX\s+(?:IF\s+NOT\s+EXISTS\s+)?["`]?(\w+)["`]?"""
YAML_TOP = r"^([a-zA-Z_]\w*):"
YAML_SECOND = r"^  ([a-zA-Z_/]\S*):"
YAML_THIRD = r"^    ([a-zA-Z_]\w*):"
#: Ways to read an environment variable; the name is group 1.
ENV_USES = [
    r"process\.env\.(\w+)\b",
    r"""process\.env\[["'](\w+)["']\]""",
    r"""os\.environ\[["'](\w+)["']\]""",
    r"""os\.environ\.get\(["'](\w+)["']""",
    r"""os\.getenv\(["'](\w+)["']""",
    r"import\.meta\.env\.(\w+)\b",
    r"""os\.Getenv\(["'](\w+)["']\)""",
    r"""os\.LookupEnv\(["'](\w+)["']\)""",
    r"""env::var\(["'](\w+)["']\)""",
    r"""env!\(["'](\w+)["']\)""",
    r"""System\.getenv\(["'](\w+)["']\)""",
    r"""sys\.env\(["'](\w+)["']\)""",
    r"""Environment\.GetEnvironmentVariable\(["'](\w+)["']\)""",
    r"""ENV\[["'](\w+)["']\]""",
    r"""ENV\.fetch\(["'](\w+)["']""",
]
#: Ways to name a table; the name is group 1.
TABLE_USES = [r"""(?i)(?:FROM|JOIN|INTO|UPDATE|TABLE|DELETE\s+FROM)\s+["`]?(\w+)["`]?\b"""]

# --- secrets -------------------------------------------------------------------

#: (pattern, replacement), in this order.
SECRETS = [
    (r"\bgh[ps]_[A-Za-z0-9_]{16,}\b", "[REDACTED]"),
    (r"\bgho_[A-Za-z0-9_]{16,}\b", "[REDACTED]"),
    (r"\bgithub_pat_[A-Za-z0-9_]{22,}\b", "[REDACTED]"),
    (r"\b[srp]k_(test|live)_[A-Za-z0-9]{10,}\b", "[REDACTED]"),
    (r"\bsk-[A-Za-z0-9]{20,}\b", "[REDACTED]"),
    (r"\bsk-ant-[A-Za-z0-9_-]{20,}\b", "[REDACTED]"),
    (r"\bAKIA[A-Z0-9]{12,}\b", "[REDACTED]"),
    (r"\beyJ[A-Za-z0-9_-]{30,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b", "[REDACTED]"),
    (r"""\b(postgres|mysql|mongodb|redis|amqp|nats)://[^\s"']+""", "$1://[REDACTED]"),
    (r"\b(Bearer|Basic)\s+[A-Za-z0-9_.\-/+=]{20,}\b", "$1 [REDACTED]"),
    (r"""\b([A-Z][A-Z0-9_]{2,}(?:_KEY|_SECRET|_TOKEN|_PASSWORD|_CREDENTIALS|_URL|_DSN|_URI))=([^\s"']{8,})""", "$1=[REDACTED]"),
]

# --- compiler output -----------------------------------------------------------------

TSC_ERROR = r"^(.+?)\((\d+),(\d+)\): error (TS\d+): (.+)$"
GO_VET_ERROR = r"^\.?/?([\w/.]+\.go):(\d+):(\d+):\s*(.+)$"
GO_VET_LINE = r"\.go:\d+:\d+:"
CARGO_PLACE = r"^\s*-->\s*([\w/.]+\.rs):(\d+):(\d+)"
CARGO_CODE = r"^error\[([A-Z]\d+)\]"
GENERIC_ERROR = r"^(.+?)[:(](\d+)[,:]?(\d*)\)?:?\s*(?:error\s*)?(.+)$"
IDENTIFIER = r"""['`]([A-Za-z_$][A-Za-z0-9_$.]*)['`]"""
#: Codes for which the first quoted name is searched; TS2305 takes the last one.
SEARCHED_CODES = ["TS2345", "TS2339", "TS2304", "TS2322"]
MOST_ERRORS = 20

# --- scores ----------------------------------------------------------------------

RISK_WEIGHTS = {"files": 0.25, "api": 0.30, "packages": 0.15, "tests": 0.20, "boundary": 0.10}
BREAKS_AT_FULL = 3.0
RISK_LEVELS = [(0.3, "low"), (0.6, "medium"), (0.8, "high")]
FAST_LEVELS = [(2, "low"), (5, "medium"), (10, "high")]
TOP_LEVEL = "critical"
PRIORITY_WEIGHTS = {"import": 1.0, "importer": 0.6, "reference": 0.8}
TEST_PENALTY = 0.3
#: Kinds that the text before an edit lists.
TOP_LEVEL_KINDS = ["function", "method", "class", "interface", "type", "type_alias", "enum", "module", "namespace", "constant", "object"]
