"""Compiler output to issues: (file, line, col, code, message, queries)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fixed

TOOL = "codeloom query"


def _lines(logs: DataFrame) -> DataFrame:
    """logs(log_id, output) as (log_id, no, raw)."""
    return logs.select("log_id", F.posexplode(F.split("output", "\n")).alias("no", "raw"))


def _capped(rows: DataFrame) -> DataFrame:
    """The first MOST_ERRORS issues of each log, as the limit of a report."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("log_id").orderBy("no"))).where(F.col("n") <= fixed.MOST_ERRORS).drop("n")


def _relative(file: Column, root: str) -> Column:
    cut = F.when(file.startswith(root + "/"), F.substr(file, F.lit(len(root) + 2))).otherwise(file) if root else file
    return F.when(cut.startswith("./"), F.substr(cut, F.lit(3))).otherwise(cut)


def identifier(message: Column) -> Column:
    """First quoted name."""
    return F.nullif(F.regexp_extract(message, fixed.IDENTIFIER, 1), F.lit(""))


def suggestions(code: Column, message: Column, file: Column) -> Column:
    names = F.regexp_extract_all(message, F.lit(fixed.IDENTIFIER), F.lit(1))
    wanted = F.when(code.isin(*fixed.SEARCHED_CODES), identifier(message)).when(code == "TS2305", F.try_element_at(names, F.lit(-1)))
    return F.filter(F.array(F.when(file != "", F.concat(F.lit(f"{TOOL} impact "), file)), F.concat(F.lit(f"{TOOL} search "), wanted)), lambda x: x.isNotNull())


def _issues(rows: DataFrame, pattern: str, root: str, code: Column | None = None, message: Column | None = None) -> DataFrame:
    g = lambda k: F.regexp_extract("t", pattern, k)
    rows = rows.withColumn("t", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))).withColumn("ok", F.col("t").rlike(pattern))
    num = lambda k: F.coalesce(F.try_to_number(F.nullif(g(k), F.lit("")), F.lit("9999999999")).cast("int"), F.lit(0))
    return rows.select("log_id", "no", F.when(F.col("ok"), _relative(F.trim(g(1)), root)).otherwise("").alias("file"), num(2).alias("line"), num(3).alias("col"), F.when(F.col("ok"), code if code is not None else F.lit("")).otherwise("").alias("code"), (message if message is not None else F.col("t")).alias("message"))


def tsc(logs: DataFrame, root: str = "") -> DataFrame:
    rows = _capped(_lines(logs).where(F.col("raw").contains("error TS")))
    return _issues(rows, fixed.TSC_ERROR, root, F.regexp_extract("t", fixed.TSC_ERROR, 4)).withColumn("queries", suggestions(F.col("code"), F.col("message"), F.col("file")))


def _with_impact(df: DataFrame) -> DataFrame:
    return df.withColumn("queries", F.when(F.col("file") != "", F.array(F.concat(F.lit(f"{TOOL} impact "), "file"))).otherwise(F.array().cast("array<string>")))


def go_vet(logs: DataFrame, root: str = "") -> DataFrame:
    return _with_impact(_issues(_capped(_lines(logs).where(F.col("raw").rlike(fixed.GO_VET_LINE))), fixed.GO_VET_ERROR, root, F.lit("GO_VET")))


def cargo(logs: DataFrame, root: str = "") -> DataFrame:
    """A code line names the error of the next place line, and of no later one."""
    w = Window.partitionBy("log_id").orderBy("no")
    rows = _lines(logs).withColumns({"c": F.nullif(F.regexp_extract("raw", fixed.CARGO_CODE, 1), F.lit("")), "at": F.col("raw").rlike(fixed.CARGO_PLACE)}).where("c IS NOT NULL OR at")
    rows = rows.withColumn("code", F.coalesce(F.lag("c").over(w), F.lit(""))).where("at AND c IS NULL")
    return _with_impact(_issues(_capped(rows), fixed.CARGO_PLACE, root, F.col("code"), F.concat("code", F.lit(": "), "t")))


def generic(logs: DataFrame, files: str = r"\.(java|cs|scala)", root: str = "") -> DataFrame:
    """Java, C# and Scala: lines that name such a file and an error."""
    return _with_impact(_issues(_capped(_lines(logs).where(F.col("raw").rlike(files) & F.col("raw").rlike("(?i)error"))), fixed.GENERIC_ERROR, root))
