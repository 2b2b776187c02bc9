"""Ranges, roles and symbol strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

DEFINITION = fixed.ROLES["definition"]


def pack(line: Column, column: Column) -> Column:
    return F.shiftleft(line.cast("int"), 16).bitwiseOR(column.cast("int"))


def line_of(packed: Column) -> Column:
    return F.shiftright(packed, 16)


def column_of(packed: Column) -> Column:
    return packed.bitwiseAND(65535)


def unpack(start: Column, end: Column) -> Column:
    return F.struct(line_of(start).alias("start_line"), column_of(start).alias("start_col"), line_of(end).alias("end_line"), column_of(end).alias("end_col"))


def range_of(r: Column) -> Column:
    """Packed (start, end) of a range of three numbers (one line) or four."""
    short = F.size(r) == 3
    return F.struct(pack(r[0], r[1]).alias("start"), F.when(short, pack(r[0], r[2])).otherwise(pack(F.get(r, F.lit(2)), F.get(r, F.lit(3)))).alias("end"))


def has_role(roles: Column, role: int = DEFINITION) -> Column:
    return roles.bitwiseAND(role) != 0


def kind_name(kind: Column) -> Column:
    return F.create_map(*[x for k, v in fixed.KINDS.items() for x in (F.lit(k), F.lit(v))])[kind]


def inferred_kind(s: Column) -> Column:
    """Kind from the suffix of a symbol string."""
    return (
        F.when(s.rlike(fixed.PARAMETER_SUFFIX), "parameter")
        .when(s.rlike(fixed.TYPE_PARAMETER_SUFFIX), "type_parameter")
        .when(s.endswith("#"), "class")
        .when(s.rlike(fixed.METHOD_SUFFIX), "method")
        .when(s.rlike(fixed.FUNCTION_SUFFIX), "function")
        .when(s.endswith("."), "variable")
    )


def short_name(s: Column) -> Column:
    """Name in a symbol string: its last descriptor, else the last back-quoted name without
    a dot, else its last token that isn't a version or bare punctuation, else the whole."""
    last = lambda a: F.try_element_at(a, F.lit(-1))
    descriptor = last(F.regexp_extract_all(s, F.lit(fixed.DESCRIPTOR), F.lit(1)))
    quoted = last(F.regexp_extract_all(s, F.lit(fixed.QUOTED_NAME), F.lit(1)))
    plain = lambda p: (p != "") & ~p.startswith("`") & ~p.isin("#", "()") & ~p.rlike(fixed.VERSION)
    token = last(F.filter(F.split(s, fixed.SYMBOL_PARTS), plain))
    return F.coalesce(descriptor, F.when(~quoted.contains("."), quoted), F.nullif(F.translate(token, "()#.", ""), F.lit("")), s)


def display_name(shown: Column, s: Column) -> Column:
    return F.coalesce(F.nullif(shown, F.lit("")), short_name(s))
