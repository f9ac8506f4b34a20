"""Mixing sources to target weights, in DataFrame operations only.

A tree domain > language > source carries integer weights.  The token budget
flows down from the root: at each node it is shared among the children by
weight, but no child gets more than its capacity (``max_epochs`` times the
tokens below it).  What a full child cannot take goes to its siblings by weight;
only when all of them are full does it reach the next ancestor, because a node's
own share is bounded by the sum of its children's capacities.  A node of weight 0
is left out with all below it.  All amounts are integers, so every engine gets the
same numbers.

Each leaf then reads its documents in seeded epochs: whole epochs first, then a
prefix of one more epoch, in the order of SHA-256(seed:epoch:id), as long as the
running total of tokens fits the leaf's budget.

Where that prefix ends is found on a narrow table of ids and token counts, never
over a whole leaf in one task: documents fall into ranges of the order key, ranges
are summed with map-side combining, and only the one range in which a leaf's
budget ends is ordered document by document.  Every row then decides by itself,
from its leaf's plan and its own key: texts are read twice and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.llm.tables import column, stored, whole

LEVELS = ("domain", "lang", "source")
ROWS_PER_RANGE = 2048


def word_count(text: Column) -> Column:
    """Runs without ASCII white space; null counts as empty."""
    return F.regexp_count(whole(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_domain(source: Column, domains: int = 4) -> Column:
    """A domain for tables that have none: the source's number modulo ``domains``."""
    digits = F.regexp_extract(whole(source), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.pmod(F.coalesce(digits.try_cast("long"), F.lit(0)), F.lit(domains)).cast("string"))


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for name, w in weights.items():
        out = F.when(F.col(column) == name, F.lit(w).cast("long")).otherwise(out)
    return out


def _share(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """``budget`` of the parent shared among its children up to ``capacity``.

    Children in order of capacity per weight: the ones that fill up are a
    prefix, and the rest share what remains by weight.
    """
    rank = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), child)
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    onward = rank.rowsBetween(0, Window.unboundedFollowing)
    full = F.col("capacity") * F.col("w_left") <= (F.col("budget") - F.col("c_before")) * F.col("weight")
    family = Window.partitionBy(*parent)
    return (
        children.withColumn("c_before", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
        .withColumn("w_left", F.sum("weight").over(onward))
        .withColumn("full", full)
        .withColumn("taken", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(family))
        .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(family))
        .withColumn(
            "share",
            F.when(F.col("full"), F.col("capacity")).otherwise(
                F.expr("((budget - taken) * weight) div greatest(w_open, 1)")
            ),
        )
        .drop("c_before", "w_left", "full", "taken", "w_open", "budget")
        .withColumnRenamed("share", "budget")
    )


def leaf_budgets(
    leaves: DataFrame, weights: dict[str, dict[str, int]], budget_permille: int = 1000, max_epochs: int = 2
) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens).

    ``weights``: per level the weight of a name, 1 when it is not listed, 0 to leave
    it out; negative weights raise.  The budget is so many thousandths of the tokens
    of the leaves that take part, or all their capacity if that is less.  Leaves left
    out have no row.
    """
    for level, named in weights.items():
        if level not in LEVELS or any(w < 0 for w in named.values()):
            raise ValueError(f"weights of {level}: a level of {LEVELS} and no negative weight")
    for level in LEVELS:
        leaves = leaves.where(_weight(level, weights.get(level, {})) > 0)
    caps = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    root = caps.agg(F.sum("tokens").alias("t"), F.sum("capacity").alias("c")).select(
        F.lit("root").alias("root"), F.expr(f"least((t * {budget_permille}L) div 1000L, c)").alias("budget")
    )
    keys, known = ["root"], root
    caps = caps.withColumn("root", F.lit("root"))
    for level in LEVELS:
        here = keys + [level]
        nodes = caps.groupBy(*here).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        nodes = nodes.withColumn("weight", _weight(level, weights.get(level, {})))
        known = _share(nodes.join(known.select(*keys, "budget"), keys), keys, level)
        keys = here
    return known.select(*LEVELS, "tokens", "budget")


def mix(
    docs: DataFrame,
    weights: dict[str, dict[str, int]],
    *,
    seed: int = 0,
    budget_permille: int = 1000,
    max_epochs: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    domain: Column | None = None,
    carry: tuple[str, ...] | None = None,
) -> DataFrame:
    """The selected rows, once per epoch: r (the columns ``carry``), domain, lang, source, tokens, epoch.

    Null languages and sources are leaves named ''; null texts have no token.
    Rows without tokens are never selected.  A row with a null id orders as id
    ''.  Rows that repeat an id share an order key and are taken or left
    together.  An empty table gives an empty frame.
    """
    carry = tuple(docs.columns) if carry is None else carry
    domain = source_domain(column(source_col)) if domain is None else domain
    rows = docs.select(
        F.struct(*(column(c) for c in carry)).alias("r"),
        whole(column(id_col).cast("string")).alias("id"),
        domain.alias("domain"),
        whole(column(lang_col)).alias("lang"),
        whole(column(source_col)).alias("source"),
        word_count(column(text_col)).alias("tokens"),
    )
    slim = stored(rows.select("id", *LEVELS, "tokens").where("tokens > 0"), "slim")
    leaves = slim.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = stored(
        leaf_budgets(leaves, weights, budget_permille, max_epochs).select(
            *LEVELS, F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest")
        ),
        "plan",
    )
    ranges = 1 << (max(1, slim.count() // ROWS_PER_RANGE) - 1).bit_length()

    def ranged(frame: DataFrame) -> DataFrame:
        key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("epochs").cast("string"), F.lit(":"), F.col("id")), 256)
        first = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
        return frame.withColumn("key", key).withColumn("range", F.floor(first * ranges / (1 << 32)))

    # The rest of a leaf ends in the first range at which the running total exceeds it.
    parted = ranged(slim.join(plan.where("rest > 0"), list(LEVELS)))
    sums = parted.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("in_range"), F.first("rest").alias("rest"))
    run = Window.partitionBy(*LEVELS).orderBy("range")
    ends = (
        sums.withColumn("upto", F.sum("in_range").over(run))
        .where("upto > rest")
        .groupBy(*LEVELS)
        .agg(F.min(F.struct("range", (F.col("upto") - F.col("in_range")).alias("before"))).alias("end"))
    )
    ends = stored(ends.select(*LEVELS, F.col("end.range").alias("end"), F.col("end.before").alias("before")), "ends")
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("key"))
    edge = parted.join(ends, list(LEVELS)).where("range = end").withColumn("running", running).where("running <= rest")
    cuts = edge.groupBy(*LEVELS).agg(F.max("key").alias("cut"))
    plan = plan.join(ends, list(LEVELS), "left").join(cuts, list(LEVELS), "left").select(*LEVELS, "epochs", "end", "cut")
    met = ranged(rows.where("tokens > 0").join(stored(plan, "plan"), list(LEVELS)))
    more = F.coalesce((F.col("range") < F.col("end")) | ((F.col("range") == F.col("end")) & (F.col("key") <= F.col("cut"))), F.lit(False))
    times = F.col("epochs") + more.cast("long")
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), times - 1))
    return met.where(times > 0).withColumn("epoch", epoch).select("r", *LEVELS, "tokens", "epoch")
