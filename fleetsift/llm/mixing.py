"""Mixing sources to target weights by iterative proportional fitting, with DataFrame operations only.

Documents fall into cells by source, language and topic.  Token sums of the cells are raked: in turn
each margin's cells are scaled so that the margin meets its targets, until all three agree.  A cell's
raked share against its own tokens is the relative chance of its documents; scaled so that the
largest chance is 1, they keep as many tokens as the targets allow without repeating any document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetsift.llm.common import uniform, words, written

MARGINS = ("source", "lang", "topic")


def topic_of(text: Column) -> Column:
    """A coarse topic: what kind of document it is."""
    text = F.coalesce(text, F.lit(""))
    return (F.when(text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]"), "contacts")
            .when(text.rlike(r"(?i)licen[cs]e"), "licences")
            .when(text.contains(" | "), "tables")
            .when(F.length(text) >= 4000, "long prose")
            .otherwise("short prose"))


#: Powers of the tokens' shares that are the production targets: below 1 they favour what is rare.
POWERS = {"source": 0.5, "lang": 0.8, "topic": 0.9}


def smoothed_targets(cells: DataFrame, margin: str, power: float) -> DataFrame:
    """(value, target): shares of the tokens raised to `power` and scaled to add up to 1."""
    shares = cells.groupBy(F.col(margin).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
    return shares.crossJoin(F.broadcast(shares.agg(F.sum("p").alias("total")))).select("value", (F.col("p") / F.col("total")).alias("target"))  # by one row


def raked(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = 20, tolerance: float = 1e-9) -> DataFrame:
    """Adds `weight` to cells (margins …, tokens): token shares scaled so that each margin meets its targets.

    A value without a target gets weight 0; targets of values without tokens are spread over the
    others in proportion.  Stops when no margin is off by more than `tolerance` before its turn, or
    after `sweeps`.  Cells are sums already, so a margin's value has as many rows as there are
    combinations of the others.
    """
    names = list(targets)
    now = cells.where("tokens > 0")
    for m in names:
        present = now.select(F.col(m).alias("value")).distinct()
        aims = targets[m].select(F.col("value").alias(f"value_{m}"), F.col("target"))
        aims = aims.join(present, F.col(f"value_{m}").eqNullSafe(F.col("value"))).where("target > 0")
        total = aims.agg(F.sum("target").alias("all"))
        aims = aims.crossJoin(F.broadcast(total)).select(f"value_{m}", (F.col("target") / F.col("all")).alias(f"target_{m}"))  # by one row
        now = now.join(aims, F.col(m).eqNullSafe(F.col(f"value_{m}"))).drop(f"value_{m}")
    now = written(now.withColumn("weight", F.col("tokens").cast("double")), "raked")
    total = now.agg(F.sum("weight")).first()[0]
    if not total:
        return now.select(*cells.columns, "weight")
    now = now.withColumn("weight", F.col("weight") / F.lit(total))
    for _ in range(sweeps):
        step = now.withColumn("off", F.lit(0.0))
        for m in names:
            held = F.sum("weight").over(Window.partitionBy(m))
            step = step.withColumn("held", held).withColumn("off", F.greatest("off", F.abs(F.col("held") - F.col(f"target_{m}")))) \
                .withColumn("weight", F.col("weight") * F.col(f"target_{m}") / F.col("held")).drop("held")
        now = written(step, "raked").select(*[c for c in step.columns if c != "off"], "off")
        off = now.agg(F.max("off")).first()[0]
        now = now.drop("off")
        if off <= tolerance:
            break
    return now.select(*cells.columns, "weight")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        topic: Column | None = None, targets: dict[str, DataFrame] | None = None, seed: str = "mix", sweeps: int = 20) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, weight, probability, kept): one row per row of `docs`.

    `weight` is the raked share of the document's cell, `probability` the chance of the document,
    the same for all of a cell, and `kept` whether the hash of its id falls below it.  Tokens are
    words; null and wordless texts have none, so they count for nothing and follow their cell
    (probability 0 if the whole cell is without words).  Null sources, languages and ids are values
    of their own.  Rows that repeat an id share one draw: those of one cell are kept or left together, and
    of those in different cells one with a smaller chance is kept only where the others are.  `targets` maps margins to
    (value, target) tables; by default they are smoothed shares.  An empty table gives no rows;
    other columns are ignored.
    """
    topic = topic_of(F.col(text_col)) if topic is None else topic
    rows = written(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                               F.col(lang_col).cast("string").alias("lang"), topic.alias("topic"),
                               F.size(words(text_col)).cast("bigint").alias("tokens")), "mix-rows")
    cells = written(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    targets = targets or {m: smoothed_targets(cells, m, POWERS[m]) for m in MARGINS}
    weighted = written(raked(cells, targets, sweeps).withColumn("ratio", F.col("weight") / F.col("tokens")), "mix-weights")
    most = weighted.agg(F.max("ratio").alias("most"))
    chances = weighted.crossJoin(F.broadcast(most)).select(  # by one row
        *[F.col(m).alias(f"cell_{m}") for m in MARGINS], "weight", F.least(F.col("ratio") / F.col("most"), F.lit(1.0)).alias("probability"))
    same = reduce(lambda x, y: x & y, [F.col(m).eqNullSafe(F.col(f"cell_{m}")) for m in MARGINS])
    chance = F.coalesce("probability", F.lit(0.0))
    return rows.join(chances, same, "left").select(
        "doc_id", *MARGINS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), chance.alias("probability"),
        (uniform(seed, "doc_id") < chance).alias("kept"))
