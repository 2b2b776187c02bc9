"""Mixing sources to target weights by hierarchical budgeting.

The tree is domain, language, source. A budget of tokens enters at the root and
is shared among siblings in proportion to their weights, none getting more than
its subtree can give (its tokens times max_epochs, of leaves without a weight of
zero on their path). What a child can't take goes
to its siblings; only what they can't take either stays with the parent's own
siblings. For one set of siblings this is water-filling: child i gets
min(cap_i, level * w_i), and the level follows in closed form from running sums
of the children sorted by cap_i / w_i, so each tree level is one window over
leaf statistics, not over documents.

A leaf's tokens come from seeded epochs: epoch e is the leaf's documents in the
order of md5(seed:e:doc_id). All epochs that fit are taken whole, and then the
longest prefix of the next one whose tokens don't exceed the rest. The prefix is
found digit by digit: tokens are summed by the next hex digit of the order, which
settles all ranges but the one in which the budget ends, and only that one goes on
(so no task holds more than 16 sums of a leaf). After DIGITS digits the documents
of the last range are sorted: of a leaf with a third of all rows, a 4096th.

Words stand for tokens. Everything is integer arithmetic but the level, which is
one division of exact sums. Defined results: null texts have no tokens and no
wordless document is chosen; null languages and sources count as 'unknown';
repeated rows are separate documents with one place in the order; leaves with
weight zero get nothing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_SQL, cut, table

DIGITS, FEW_LEAVES = 3, 10_000
#: Production weights; what isn't listed has weight 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS = {"src0": 1}
BUDGET_SHARE, MAX_EPOCHS, SEED = 0.4, 3, 17
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """The domain of a source: its trailing number modulo 4, d0 if there is none."""
    return F.concat(F.lit("d"), F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(source, "([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999")), F.lit(0)).cast("int") % 4)


def _weight(col: str, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col(col)], F.lit(1))


def budgets(leaves: DataFrame, budget: int, weights: dict[str, dict[str, int]] | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, tokens, alloc): leaves(domain, lang, source, tokens) with their tokens to draw."""
    weights = weights or {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": SOURCE_WEIGHTS}
    for level in LEVELS:  # what can't be drawn is in no cap above it
        leaves = leaves.where(_weight(level, weights.get(level, {})) > 0)
    at = leaves.select("*", F.lit(budget).cast("bigint").alias("alloc"))
    for depth, level in enumerate(LEVELS):
        path, parent = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        kids = at.groupBy(*path).agg(F.sum("tokens").alias("t"), F.max("alloc").alias("b")).withColumns({"cap": F.col("t") * max_epochs, "w": _weight(level, weights.get(level, {})).cast("bigint")})
        kids = kids.where("w > 0 AND cap > 0").withColumn("r", F.col("cap").cast("double") / F.col("w"))
        w = Window.partitionBy(*parent).orderBy("r", level) if parent else Window.orderBy("r", level)
        whole = Window.partitionBy(*parent) if parent else Window.partitionBy()
        before = F.coalesce(F.sum("cap").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rest = F.sum("w").over(w.rowsBetween(0, Window.unboundedFollowing))
        kids = kids.withColumn("level", (F.col("b") - before).cast("double") / rest)
        # the level is that of the first child, by ratio, that isn't filled
        kids = kids.withColumn("final", F.min(F.when(F.col("level") <= F.col("r"), F.struct("r", level, "level"))).over(whole)["level"])
        kids = kids.withColumn("alloc", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.floor(F.col("final") * F.col("w")))).cast("bigint"))
        at = leaves.join(kids.select(*path, "alloc"), path)
    return at.select(*LEVELS, "tokens", "alloc")


def _marked(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    source = F.coalesce(F.col(source_col).cast("string"), F.lit("unknown"))
    tokens = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_SQL)).cast("bigint")
    return docs.select(F.col(id_col).alias("doc_id"), domain_of(source).alias("domain"), F.coalesce(F.col(lang_col).cast("string"), F.lit("unknown")).alias("lang"), source.alias("source"), tokens.alias("n_tokens"))


def select(docs: DataFrame, budget_share: float = BUDGET_SHARE, weights: dict | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, domain, lang, source, n_tokens, epoch): the documents drawn, once for each epoch."""
    marked = cut(_marked(docs, id_col, text_col, lang_col, source_col).where("n_tokens > 0"))
    leaves = cut(marked.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = cut(budgets(leaves, int(total * budget_share), weights, max_epochs))
    plan = plan.select(*LEVELS, F.floor(F.col("alloc") / F.col("tokens")).cast("int").alias("full"), F.expr("alloc % tokens").alias("rest"))
    rows = marked.join(plan, list(LEVELS))
    whole = rows.where("full > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("epoch"))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    cols = ["doc_id", *LEVELS, "n_tokens", "epoch"]
    out = whole.select(cols)
    edge = cut(rows.where("rest > 0").select(*cols[:-1], F.col("full").alias("epoch"), key.alias("key"), F.col("rest").alias("room")))
    few = leaves.count() <= FEW_LEAVES  # 16 sums of each are sent to all tasks; beyond that the join shuffles
    for k in range(1, DIGITS + 1):
        edge = edge.withColumn("digit", F.substr("key", F.lit(k), F.lit(1)))
        sums = edge.groupBy(*LEVELS, "digit", "room").agg(F.sum("n_tokens").alias("t"))
        before = F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("digit")) - F.col("t")
        sums = sums.select(*LEVELS, "digit", before.alias("before"), "t")
        split = cut(edge.join(F.broadcast(sums) if few else sums, [*LEVELS, "digit"]).where("before < room"))
        out = out.unionByName(split.where("before + t <= room").select(cols))
        edge = split.where("before + t > room").withColumn("room", F.col("room") - F.col("before")).drop("digit", "before", "t")
    run = F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0))
    return out.unionByName(edge.withColumn("run", run).where("run <= room").select(cols))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select(table(spark, sf_dir, "documents"))


def _case(col: str, weights: dict[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def oracle(source: str = "documents", share: float = BUDGET_SHARE, epochs: int = MAX_EPOCHS, seed: int = SEED, weights: tuple = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> str:
    """DuckDB SQL for select() over the table or parenthesised query `source`."""
    live = " AND ".join(f"({_case(level, w)}) > 0" for level, w in zip(LEVELS, weights))
    sql = rf"""
marked AS MATERIALIZED (SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{{1,9}})$', 1), '') AS INT), 0) % 4) AS domain, coalesce(lang, 'unknown') AS lang,
  coalesce(source, 'unknown') AS source, len(regexp_extract_all(text, '{WORD_SQL}'))::BIGINT AS n_tokens FROM {source}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM marked WHERE n_tokens > 0 GROUP BY ALL),
p0 AS (SELECT *, floor((SELECT sum(tokens) FROM leaves) * {share}::DOUBLE)::BIGINT AS b0 FROM leaves WHERE {live})"""
    for depth, (level, weights) in enumerate(zip(LEVELS, weights)):
        path, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parent} " if parent else ""
        sql += f""",
k{depth} AS (SELECT {path}, (sum(tokens) * {epochs})::BIGINT AS cap, ({_case(level, weights)})::BIGINT AS w, max(b{depth}) AS b FROM p{depth} GROUP BY {path}),
l{depth} AS (SELECT *, cap::DOUBLE / w AS r, (b - coalesce(sum(cap) OVER ({by}ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(w) OVER ({by}ORDER BY cap::DOUBLE / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS lv FROM k{depth}),
f{depth} AS (SELECT *, first_value(CASE WHEN lv <= r THEN lv END IGNORE NULLS) OVER ({by}ORDER BY r, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fin FROM l{depth}),
p{depth + 1} AS (SELECT p.*, (CASE WHEN fin IS NULL THEN cap ELSE least(cap, floor(fin * w)) END)::BIGINT AS b{depth + 1} FROM p{depth} p JOIN f{depth} USING ({path}))"""
    return sql + f""",
rows_ AS (SELECT m.*, (b3 // tokens)::INT AS full_, b3 % tokens AS rest FROM marked m JOIN p3 USING (domain, lang, source) WHERE n_tokens > 0),
part AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || full_ || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run FROM rows_),
mixed AS (SELECT doc_id, domain, lang, source, n_tokens, unnest(range(full_))::INT AS epoch FROM rows_
  UNION ALL SELECT doc_id, domain, lang, source, n_tokens, full_ AS epoch FROM part WHERE run <= rest)"""


OP9_SQL = "WITH " + oracle().lstrip() + "\nSELECT * FROM mixed"
