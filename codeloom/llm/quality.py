"""Quality rules as a ledger of failure bits, in DataFrame functions only.

Every rule is evaluated once per document. ledger() stores its measurements and
one bit per failed rule; a policy is a versioned mask over those bits, so that
verdicts and ablations come from bitwise operations on the ledger without a
second look at the text.

Defined results: a null text counts as empty (no words, so base_failed); null
ids pass through; repeated rows give repeated rows; an empty table gives none;
other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_RE, SPACES, table

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    bit: int
    name: str
    fails: str  # SQL over the measurements


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_5grams", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "short_words", "word_chars < 2 * n_words"),
    Rule(5, "long_words", "word_chars > 15 * n_words"),
    Rule(6, "shouting", "2 * n_upper > n_letters AND n_letters > 0"),
)
#: Version -> mask of the rules whose failure rejects a document.
POLICIES = {"v1": 0b1111111, "v1-base": 0b0000011, "v2-lenient": 0b0000111}


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(hashes: Column, width: int) -> Column:
    """Words covered by runs of `width` words whose hash occurs twice or more in the array."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def count(s: Column) -> Column:
        same = lambda k, j: F.coalesce(F.get(s, j)["h"] == k["h"], F.lit(False))
        hit = F.array_sort(F.transform(F.filter(s, lambda k, j: same(k, j - 1) | same(k, j + 1)), lambda k: k["i"]))
        steps = lambda p: F.transform(p, lambda x, j: F.least(F.lit(width), F.coalesce(F.get(p, j + 1) - x, F.lit(width))))
        return F.aggregate(_let(hit, steps), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(_let(F.sort_array(pairs), count))


def _measures(text: Column) -> Column:
    n = lambda x: x.cast("long")

    def of_words(w: Column) -> Column:
        grams = F.when(F.size(w) < 5, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(5)])))
        return F.struct(n(F.size(w)).alias("n_words"), _let(grams, lambda g: _covered(g, 5)).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(n(F.size(lines)).alias("n_lines"), n(F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    solid = F.translate(text, SPACES, "")
    upper = F.length(F.regexp_replace(text, "[^\\p{Lu}]+", ""))
    return F.struct(
        n(F.length(solid)).alias("word_chars"),
        n(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        n(upper).alias("n_upper"),
        n(F.length(F.regexp_replace(text, "[^\\p{L}]+", ""))).alias("n_letters"),
        _let(F.filter(F.split(text, SPACE_RE), lambda w: w != ""), of_words).alias("w"),
        _let(F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != ""), of_lines).alias("l"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measurements..., fail_bits): one row per input row. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    m = docs.select(F.col(id_col).alias("doc_id"), _let(text, _measures).alias("m"))
    flat = m.select("doc_id", "m.w.n_words", "m.word_chars", "m.n_symbols", "m.l.n_lines", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.n_upper", "m.n_letters")
    bits = F.lit(0).cast("long")
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return flat.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """The ledger with kept (no failed rule of the policy) and policy."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long")) == 0).withColumn("policy", F.lit(version))


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that it alone rejects.

    One pass over the ledger with a partial aggregate; no text is read.
    """
    mask = F.col("fail_bits").bitwiseAND(F.lit(POLICIES[version]).cast("long"))
    own = [r for r in RULES if POLICIES[version] >> r.bit & 1]
    sums = [F.sum((F.col("fail_bits").bitwiseAND(F.lit(1 << r.bit).cast("long")) != 0).cast("long")).alias(f"f{r.bit}") for r in own]
    sums += [F.sum((mask == (1 << r.bit)).cast("long")).alias(f"o{r.bit}") for r in own]
    one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum((mask == 0).cast("long")), F.lit(0)).alias("kept"), *sums)
    each = [F.struct(F.lit(version).alias("policy"), F.lit(r.name).alias("rule"), F.lit(r.bit).alias("bit"), F.coalesce(F.col(f"f{r.bit}"), F.lit(0)).alias("n_failed"), F.coalesce(F.col(f"o{r.bit}"), F.lit(0)).alias("n_only_this"), F.col("kept").alias("n_kept"), (F.col("kept") + F.coalesce(F.col(f"o{r.bit}"), F.lit(0))).alias("n_kept_without"), F.col("n").alias("n_docs")) for r in own]
    return one.select(F.inline(F.array(*each)))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_policy(ledger(table(spark, sf_dir, "documents")), "v1")
    base = F.col("fail_bits").bitwiseAND(F.lit(POLICIES["v1-base"]).cast("long")) != 0
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "fail_bits")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 3)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p + 4], ' '))) AS g FROM w WHERE len(w) >= 5),
h AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS n FROM g),
c AS (SELECT rid, count(DISTINCT p + k) AS n FROM h, (SELECT unnest(range(0, 5)) AS k) WHERE n > 1 GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(length(array_to_string(w, '')), 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
             length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters
      FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 15 * n_words)::BIGINT
             + 64 * (2 * n_upper > n_letters AND n_letters > 0)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits::BIGINT AS fail_bits FROM b
"""
