"""Mixing sources to target weights by iterative proportional fitting.

DataFrame functions only.  Token counts of the cells source x language x topic are raked until the marginals of all
three meet their targets; documents are then sampled with probabilities that give the raked mixture within a budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .frames import free_prefix, quoted
from .storage import Scratch

DIMENSIONS = ("source", "lang", "topic")
#: Targets that aren't given are the present shares to this power, scaled: large parts give way to small ones.
TEMPER = 0.5
#: Share of all tokens to sample, the salt of the draw, the deviation of a marginal that ends the raking.
BUDGET, SALT, TOLERANCE = 0.5, 97, 1e-6
PASSES, MAX_ROUNDS = 4, 25
#: Cells up to which their table is broadcast; larger ones are joined by shuffling, each cell in so many parts.
BROADCAST_CELLS, CELL_PARTS = 20_000, 64
NONE = "(none)"
TOPICS = ("empty", "table", "shout", "symbols", "figures", "lists", "prose")


def tokens(text: Column) -> Column:
    """Words of a text, runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """One of TOPICS by what a whole text is made of; the first that holds."""
    size = F.length(text)
    share = lambda *chars: sum(size - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars) / size
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(share("|") > 0.01, "table")
        .when(share("!") > 0.01, "shout")
        .when(share("#", "$", "%", "&", "*") > 0.02, "symbols")
        .when(share(*"0123456789") > 0.05, "figures")
        .when(share("\n") > 0.02, "lists")
        .otherwise("prose")
    )


def described(docs: DataFrame, p: str = "mix_") -> DataFrame:
    """docs with <p>source, <p>lang, <p>topic and <p>tokens; null sources and languages count as one of their own."""
    new = {
        f"{p}source": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        f"{p}lang": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        f"{p}topic": topic(F.col("text")),
        f"{p}tokens": tokens(F.col("text")),
    }
    return docs.withColumns(new)


def rake(cells: DataFrame, targets: dict[str, DataFrame], scratch: Scratch) -> DataFrame:
    """cells(mix_source, mix_lang, mix_topic, tokens) with `weight`: the tokens fitted to the targets' shares.

    targets: for each of source, lang and topic a frame (value, share).  Values without a target share get none; shares
    of values that no cell has are dealt to the others.  A round is a few passes over all three, then written.
    """
    now, total = cells.withColumn("weight", F.col("tokens").cast("double")), "fit_total"
    for d, wanted in targets.items():
        have = cells.select(f"mix_{d}").distinct()
        shares = have.join(wanted.select(F.col("value").alias(f"mix_{d}"), "share"), f"mix_{d}", "left")
        now = now.join(shares.withColumnRenamed("share", f"want_{d}"), f"mix_{d}").fillna(0.0, [f"want_{d}"])
    for k in range(MAX_ROUNDS):
        for _ in range(PASSES):
            for d in targets:
                # A value's weight becomes its share of what all values with a target have together.
                own = F.sum("weight").over(Window.partitionBy(f"mix_{d}"))
                now = now.withColumn(total, own).withColumn(
                    "weight", F.when(F.col(total) > 0, F.col("weight") * F.col(f"want_{d}") / F.col(total)).otherwise(0.0)
                ).drop(total)
        now = scratch.keep(now, f"round-{k}")
        if k:
            scratch.drop(f"round-{k - 1}")
        if all(_deviation(now, d) <= TOLERANCE for d in targets):
            break
    return now.select(*cells.columns, "weight")


def _deviation(cells: DataFrame, d: str) -> float:
    """How far a marginal's shares are from the targets, scaled to what can be met."""
    marginal = cells.groupBy(f"mix_{d}").agg(F.sum("weight").alias("w"), F.first(f"want_{d}").alias("t"))
    marginal = marginal.where("w > 0")
    sums = marginal.agg(F.sum("w").alias("w"), F.sum("t").alias("t")).first()
    if not sums.w or not sums.t:
        return 0.0
    return marginal.agg(F.max(F.abs(F.col("w") / sums.w - F.col("t") / sums.t)).alias("x")).first().x


def tempered(cells: DataFrame, d: str, power: float = TEMPER) -> DataFrame:
    """(value, share): the present shares of a dimension to a power, scaled to 1 where any cell has tokens."""
    marginal = cells.groupBy(F.col(f"mix_{d}").alias("value")).agg(F.sum("tokens").cast("double").alias("n"))
    total = marginal.agg(F.sum(F.pow("n", F.lit(power))).alias("t")).first().t or 1.0
    return marginal.select("value", (F.pow("n", F.lit(power)) / F.lit(float(total))).alias("share"))


def _scale(cells: DataFrame, budget: float) -> float:
    """The factor by which weight / tokens gives probabilities, at the most 1, that spend the budget."""
    scale, full = None, -1.0
    while True:
        capped = F.lit(False) if scale is None else (F.col("weight") * scale >= F.col("tokens"))
        row = cells.where("tokens > 0 and weight > 0").agg(
            F.sum(F.when(capped, F.col("tokens")).otherwise(0)).cast("double").alias("full"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("rest"),
        ).first()
        if row.full is None or not row.rest or row.full == full:
            return scale if scale is not None else 0.0
        full = row.full
        # Cells that reach 1 stay there: the factor only grows.
        scale = max(0.0, budget - full) / row.rest if scale is None else max(scale, (budget - full) / row.rest)


def _drawn(docs: DataFrame, scratch: Scratch, p: str, targets: dict[str, dict[str, float]] | None, budget: float) -> DataFrame:
    """docs with <p>topic, <p>tokens, <p>probability and <p>sampled beside columns of their own."""
    rows = described(docs, p)
    keys = [f"mix_{d}" for d in DIMENSIONS]
    named = rows.select(*[F.col(f"{p}{d}").alias(f"mix_{d}") for d in (*DIMENSIONS, "tokens")])
    cells = scratch.keep(named.groupBy(*keys).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    spark = docs.sparkSession
    wanted = {
        d: spark.createDataFrame(list(targets[d].items()), "value string, share double") if targets and d in targets else tempered(cells, d)
        for d in DIMENSIONS
    }
    fitted = rake(cells, wanted, scratch)
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale = _scale(fitted, budget * total)
    probability = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("weight") * scale / F.col("tokens"))).otherwise(0.0)
    table = fitted.select(*[F.col(f"mix_{d}").alias(f"{p}{d}") for d in DIMENSIONS], probability.alias(f"{p}probability"))
    table, on = scratch.keep(table, "probabilities"), [f"{p}{d}" for d in DIMENSIONS]
    if table.count() <= BROADCAST_CELLS:
        table = F.broadcast(table)
    else:
        # A cell may hold a third of all rows: its row is repeated for each of its parts.
        on, part = [*on, f"{p}part"], F.pmod(F.xxhash64("doc_id", "text"), F.lit(CELL_PARTS))
        rows, table = rows.withColumn(f"{p}part", part), table.withColumn(f"{p}part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(CELL_PARTS - 1).cast("long"))))
    spot = F.shiftrightunsigned(F.xxhash64(F.lit(SALT), "doc_id", "text"), 11) / F.lit(float(1 << 53))
    return rows.join(table, on).withColumn(f"{p}sampled", spot < F.col(f"{p}probability"))


def mixture(docs: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """docs with mix_topic, mix_tokens, probability (0 to 1) and sampled; columns of these names are replaced.

    targets: shares for values of source, lang and topic; a dimension without them is tempered.  budget: the share of
    all tokens to spend.  A text without words has no tokens and so a probability of 0, as has a cell without a target.
    The draw hashes doc_id and text, so repeated rows share their luck, and a row's doesn't depend on any other row.
    """
    p = free_prefix(docs, "mix_own_")
    new = {"mix_topic": "topic", "mix_tokens": "tokens", "probability": "probability", "sampled": "sampled"}
    kept = [F.col(quoted(c)) for c in docs.columns if c.lower() not in new]
    return _drawn(docs, scratch, p, targets, budget).select(*kept, *[F.col(f"{p}{v}").alias(k) for k, v in new.items()])


def sampled(docs: DataFrame, scratch: Scratch, targets: dict[str, dict[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """The documents that the mixture draws, with all columns of docs, whatever their names."""
    p = free_prefix(docs, "mix_own_")
    return _drawn(docs, scratch, p, targets, budget).where(f"{p}sampled").select(*[quoted(c) for c in docs.columns])
