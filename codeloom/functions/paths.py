"""Path, language and number functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

TEST_FILE = "|".join(fixed.TEST_FILES)


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def extension(p: Column) -> Column:
    """Last extension with its dot; '' for names such as .env."""
    return F.regexp_extract(p, r"[^/](\.[^./]*)$", 1)


def dirname(p: Column) -> Column:
    """'.' if there is no folder."""
    return F.when(p.contains("/"), F.regexp_replace(p, r"/+[^/]*$", "")).otherwise(F.lit("."))


def stem(p: Column) -> Column:
    """p without all from the last dot; folders are not told apart (a.b/c gives a)."""
    return F.regexp_replace(p, r"\.[^.]+$", "")


def language_of(p: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in fixed.LANGUAGES.items() for x in kv])
    return F.coalesce(names[extension(p)], F.lit("unknown"))


def is_test(p: Column) -> Column:
    return p.rlike(TEST_FILE)


def normalize(p: Column) -> Column:
    """Folds '.' and '..' segments; '..' beyond the root stays."""
    up = lambda a: (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("..")) != "..")
    parts = F.filter(F.split(p, "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when((x == "..") & up(a), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x)))
    out = F.array_join(folded, "/")
    return F.when(out == "", F.lit(".")).otherwise(out)


def join_path(folder: Column, rest: Column) -> Column:
    return normalize(F.concat(folder, F.lit("/"), rest))


def test_command(p: Column) -> Column:
    """The command that runs a test file."""
    return (
        F.when(p.endswith(".py"), F.concat(F.lit("pytest "), p))
        .when(p.endswith("_test.go"), F.concat(F.lit("go test ./"), F.regexp_replace(p, r"/[^/]+$", "/...")))
        .when(p.endswith("_test.rs"), F.lit("cargo test"))
        .when(p.rlike(r"\.(java|kt)$"), F.concat(F.lit("mvn test -pl "), F.regexp_replace(p, r"(?s)/src/.*", "")))
        .when(p.endswith(".scala"), F.lit("sbt test"))
        .when(p.endswith(".cs"), F.lit("dotnet test"))
        .when(p.rlike(r"_(test|spec)\.rb$"), F.concat(F.lit("bundle exec ruby "), p))
        .otherwise(F.concat(F.lit("vitest run "), p))
    )


def in_project(p: Column, root: Column) -> Column:
    """Whether p lies in a project; roots '.' and '' hold all."""
    return root.isin(".", "") | (p == root) | p.startswith(F.concat(root, F.lit("/")))


def prefixes(p: Column) -> Column:
    """p and all its folders, longest first: turns a longest-prefix search into an equi-join."""
    parts = F.split(p, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) / 4)


def round3(x: Column) -> Column:
    """Half up to three digits, towards positive infinity on ties."""
    return F.floor(x * 1000 + 0.5) / 1000


def snippet(content: Column, line: Column, n: int = 3) -> Column:
    """Up to n lines from a 0-based line; null without content or line."""
    return F.when(line.isNotNull(), F.array_join(F.slice(F.split(content, "\n"), F.greatest(line, F.lit(0)) + 1, n), "\n"))
