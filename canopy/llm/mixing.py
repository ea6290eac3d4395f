"""Mixing sources to target weights (problem 8).

Budgets are set top down in a tree of domains, sources and languages: a node's tokens are
divided among its children by weight, what a child can't take goes to its siblings first,
and only what all siblings together can't take goes back to their parent's siblings. All
nodes of a level are filled at once by aggregations over their children. Each leaf then repeats
its documents in seeded epochs: whole epochs while they fit, and a prefix of the last one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm.tokens import token_counts
from canopy.session import cut

#: Parameters: the seed of the epochs' order; the parts into which a leaf's order is cut
#: for its prefix sums; the power of its tokens by which a language weighs within a source.
SEED, PARTS, TEMPER = 7, 4096, 0.7


def name_of(source: Column) -> Column:
    """Sources compare without regard to case and outer blanks."""
    return F.lower(F.trim(source))


def _filled(nodes: DataFrame, up: list[str], budgets: DataFrame) -> DataFrame:
    """`nodes` (up, ..., weight, capacity) with their budget out of that of their parents.

    budgets: up and budget, which no parent's children are too small for. A child gets the
    lesser of its capacity and its weight times its parent's level. The level starts at
    budget / weights and rises to what is left by the children that are short there, until
    no more children are short; every round is one aggregation over all nodes.
    """
    meet = lambda a, b: a.join(b, up) if up else a.crossJoin(F.broadcast(b))  # noqa: E731 (without a parent, one row)
    rows = cut(meet(nodes, budgets.withColumnRenamed("budget", "_b")))
    levels = rows.groupBy(*up).agg((F.max("_b") / F.sum("weight")).alias("level"), F.lit(-1).cast("long").alias("short"))
    while True:
        at = meet(rows, levels.withColumnRenamed("short", "_before"))
        short = F.col("capacity") <= F.col("level") * F.col("weight")
        sums = at.groupBy(*up).agg(
            F.max("_b").alias("_b"), F.max("level").alias("_l"), F.max("_before").alias("_before"), F.count_if(short).alias("short"), F.sum(F.when(short, F.col("capacity")).otherwise(0.0)).alias("_s"), F.sum(F.when(short, 0.0).otherwise(F.col("weight"))).alias("_w")
        )
        next_ = F.when(F.col("_w") > 0, F.greatest("_l", (F.col("_b") - F.col("_s")) / F.col("_w"))).otherwise(F.col("_l"))
        levels = cut(sums.select(*up, next_.alias("level"), "short", (F.col("short") != F.col("_before")).alias("moved")))
        if not levels.where("moved").take(1):
            return meet(rows, levels.select(*up, "level")).withColumn("budget", F.least("capacity", F.col("level") * F.col("weight"))).drop("_b", "level")
        levels = levels.drop("moved")


def tree_budgets(leaves: DataFrame, levels: list[tuple[str, str]], total: float) -> DataFrame:
    """`leaves` with a budget each.

    levels: (column of the node's name, column of its weight among its siblings) from the
    top down; the names of all levels are a leaf's key. leaves: these and capacity. A total
    beyond all capacities is lowered to them. Nodes without weight or capacity get nothing.
    """
    leaves, names = cut(leaves), [n for n, _ in levels]
    budgets = leaves.agg(F.least(F.lit(float(total)), F.coalesce(F.sum("capacity"), F.lit(0.0))).alias("budget"))
    for depth, (_, weight) in enumerate(levels):
        nodes = leaves.groupBy(*names[: depth + 1]).agg(F.max(weight).alias("weight"), F.sum(F.when(_open(levels[depth:]), F.col("capacity")).otherwise(0.0)).alias("capacity"))
        budgets = _filled(nodes.where("weight > 0 and capacity > 0"), names[:depth], budgets).select(*names[: depth + 1], "budget")
    return leaves.join(budgets, names, "left").withColumn("budget", F.coalesce("budget", F.lit(0.0)))


def _open(levels: list[tuple[str, str]]) -> Column:
    """True for leaves that no node of these levels without a weight shuts off."""
    return reduce(lambda a, b: a & b, [F.coalesce(F.col(w) > 0, F.lit(False)) for _, w in levels])


def sized_documents(documents: DataFrame, **tokenizer) -> DataFrame:
    """(doc_id, source, lang, tokens) of the documents with tokens, sources in one form."""
    chosen = documents.select("doc_id", name_of(F.col("source")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return token_counts(chosen.where("source is not null and text <> ''"), "doc_id", "text", ["source", "lang"], **tokenizer).where("tokens > 0")


def budgets(sized: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """One row per leaf (source, lang): target_share, max_repeats, available, budget, epochs, rest.

    The tree is root, domain, source (weighted by target_share), language (weighted by its
    tokens to the power TEMPER, so a small language of a source may fall short where a large
    one doesn't). targets may have a column domain, which weighs as its sources together;
    else there is one. total_tokens: the size of the mixture, by default the tokens of all
    targeted sources; a total beyond what all may give is lowered to that. Targets with a
    null source or share are left out, of a source named twice the shares add up and the
    lower max_repeats holds; a null max_repeats is 1. Leaves stay distributed.
    """
    domain = F.coalesce("domain", F.lit("")) if "domain" in targets.columns else F.lit("")
    wanted = targets.where("source is not null and target_share > 0").groupBy(name_of(F.col("source")).alias("source")).agg(
        F.min(domain).alias("domain"), F.sum("target_share").alias("target_share"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats")
    )
    domains = wanted.groupBy("domain").agg(F.sum("target_share").alias("domain_share"))
    have = sized.groupBy("source", "lang").agg(F.sum("tokens").alias("available"))
    leaves = wanted.join(domains, "domain").join(have, "source", "left").withColumns({"available": F.coalesce("available", F.lit(0)), "lang": F.coalesce("lang", F.lit(""))})
    leaves = cut(leaves.withColumns({"capacity": (F.col("available") * F.greatest("max_repeats", F.lit(0))).cast("double"), "lang_weight": F.pow("available", F.lit(TEMPER))}))
    if total_tokens is None:
        total_tokens = leaves.agg(F.coalesce(F.sum("available"), F.lit(0))).first()[0]
    levels = [("source", "target_share"), ("lang", "lang_weight")]
    if "domain" in targets.columns:
        levels = [("domain", "domain_share"), *levels]
    plan = tree_budgets(leaves, levels, total_tokens)
    epochs = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")).cast("int"), "max_repeats")).otherwise(0)
    rest = F.when((F.col("available") > 0) & (F.col("epochs") < F.col("max_repeats")), F.col("budget") - F.col("epochs") * F.col("available")).otherwise(0.0)
    return cut(plan.withColumn("epochs", epochs).withColumn("rest", rest).select("source", "lang", "target_share", "max_repeats", "available", "budget", "epochs", "rest"))


def mixture(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokens, uses): each selected document and how often it is used.

    A document is used once in each whole epoch of its leaf and once more if it stands in
    the prefix of the last one: in the order of a seeded hash, the documents before the
    place where the rest of the budget is reached (the one on it counts if more than half
    of it fits). The running sums go over PARTS hash ranges of a leaf, and only within
    the one range where the rest ends over documents, so no leaf is gathered in a task.
    """
    leaf = ["source", "lang"]
    own = sized.join(plan.select(*leaf, "epochs", "rest"), leaf)
    order = F.xxhash64("doc_id", F.lit(SEED), "epochs")
    own = own.withColumn("_o", order).withColumn("_part", F.shiftrightunsigned("_o", 52).cast("int"))
    sums = own.where("rest > 0").groupBy(*leaf, "_part").agg(F.sum("tokens").alias("_s"), F.first("rest").alias("_rest"))
    before = F.sum("_s").over(Window.partitionBy(*leaf).orderBy("_part")) - F.col("_s")
    sums = sums.withColumn("_before", before).select(*leaf, "_part", "_before", (F.col("_before") + F.col("_s") <= F.col("_rest")).alias("_whole"), (F.col("_before") < F.col("_rest")).alias("_begun"))
    placed = own.join(sums, [*leaf, "_part"], "left")
    edge = placed.where("_begun and not _whole")
    reach = F.sum("tokens").over(Window.partitionBy(*leaf, "_part").orderBy("_o", "doc_id")) - F.col("tokens") / 2
    edge = edge.withColumn("_in", F.col("_before") + reach <= F.col("rest"))
    sure = placed.where("not coalesce(_begun and not _whole, false)").withColumn("_in", F.coalesce(F.col("_whole"), F.lit(False)))
    return sure.unionByName(edge).withColumn("uses", F.col("epochs") + F.col("_in").cast("int")).where("uses > 0").select("doc_id", *leaf, "tokens", "uses")


def report(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """Per targeted source: target_share, actual_share, shortage and what it was made of.

    shortage: how many tokens of its share of the whole mixture a source lacks.
    """
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("uses").alias("most_uses"))
    asked = plan.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"), F.sum("available").alias("available_tokens"), F.sum("budget").alias("budget"))
    whole = used.agg(F.sum("tokens").alias("_all"))
    # One row.
    full = asked.join(used, "source", "left").join(F.broadcast(whole))
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = F.when(n("_all") > 0, n("tokens") / F.col("_all")).otherwise(F.lit(0.0))
    return full.select("source", "target_share", share.alias("actual_share"), "max_repeats", n("most_uses").alias("most_uses"), "available_tokens", n("tokens").alias("tokens"), n("documents").alias("documents"), F.greatest(F.col("target_share") * n("_all") - n("tokens"), F.lit(0.0)).alias("shortage"))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, **tokenizer) -> tuple[DataFrame, DataFrame]:
    """(mixture, report) of `documents`; the token counts are written once to the shared folder."""
    sized = cut(sized_documents(documents, **tokenizer))
    plan = budgets(sized, targets, total_tokens)
    mixed = mixture(sized, plan)
    return mixed, report(mixed, plan)
