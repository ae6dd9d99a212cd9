"""Problem 7: mixing sources to target weights.

Method.  The sources' target shares are propagated through a tree domain -
language - source: a leaf's weight is its source's share times the leaf's
part of the source's tokens, an inner node's weight is the sum below it.  A
leaf can give its tokens times the repeats its source allows.  The budget is
handed down from the root; what a child can't take goes to its siblings in
proportion to their weights, and only what a whole subtree can't take goes to
the siblings of an ancestor.  A leaf with a budget of q times its tokens and
a rest uses every record q times, and the records of a token prefix of its
seeded order of epoch q + 1 once more.

Prefix sums are two-level: tokens are summed by leaf and slice of the hash
order, the slices are accumulated, and only the one slice of a leaf in which
the prefix ends is ordered record by record.

Cases: records without tokens and of sources without a target aren't used; a
source without records is reported with share 0; languages are the first two
letters of the lower-case code, 'und' where null; repeated texts are records
of their own; empty tables give an empty mixture.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.llm.encode import count_tokens
from leafmill.llm.truncation import canonical_source
from leafmill.sources.tables import cut

#: Records of a slice of a leaf's hash order, about.
SLICE = 4096


def sized(docs: DataFrame, vocabulary: str | None = None, domains: dict[str, str] | None = None) -> DataFrame:
    """``doc_id``, ``domain``, ``lang``, ``source`` and ``tokens`` of every record; written once. ``domains``: the domain of each source; others are in the domain 'other'."""
    lang = F.coalesce(F.substring(F.lower(F.trim("lang")), 1, 2), F.lit("und"))
    rows = docs.select("doc_id", canonical_source(F.col("source")).alias("source"), lang.alias("lang"), "text")
    counted = count_tokens(rows, "text", ["doc_id", "source", "lang"], vocabulary)
    named = F.try_element_at(F.create_map(*[F.lit(x) for pair in domains.items() for x in pair]), F.col("source")) if domains else F.lit(None).cast("string")
    return cut(counted.select("doc_id", F.coalesce(named, F.lit("other")).alias("domain"), "lang", "source", "tokens"))


def water(budget: float, weights: list[float], most: list[float]) -> list[float]:
    """Parts of the budget by weight, none above its most; what one can't take goes to the others."""
    parts = [0.0] * len(weights)
    live = [k for k in range(len(weights)) if weights[k] > 0 and most[k] > 0]
    while live and budget > 1e-9:
        total = sum(weights[k] for k in live)
        full = [k for k in live if most[k] <= budget * (weights[k] / total)]
        if not full:
            for k in live:
                parts[k] = budget * (weights[k] / total)
            break
        for k in full:
            parts[k] = most[k]
        budget -= sum(most[k] for k in full)
        live = [k for k in live if k not in full]
    return parts


def budgets(leaves: dict[tuple, tuple[float, float]], budget: float, depth: int = 0) -> dict[tuple, float]:
    """Budget of each leaf (a path) from (weight, most) of the leaves, handed down the tree."""
    if not leaves:
        return {}
    if depth == len(next(iter(leaves))):
        return {path: min(budget, most) for path, (_, most) in leaves.items()}
    below: dict = defaultdict(dict)
    for path, leaf in leaves.items():
        below[path[depth]][path] = leaf
    names = sorted(below)
    parts = water(budget, [sum(w for w, _ in below[n].values()) for n in names], [sum(m for w, m in below[n].values() if w > 0) for n in names])
    out: dict[tuple, float] = {}
    for name, part in zip(names, parts):
        out |= budgets(below[name], part, depth + 1)
    return out


def plan(rows: DataFrame, targets: DataFrame, total: int | None = None) -> list[tuple]:
    """(domain, lang, source, records, tokens, budget) of each leaf of a source with a target; ``total`` tokens, by default those of the corpus.

    Leaves are combinations of domain, language (two letters) and target source, so their number is bounded by that of the targets, a small table."""
    wanted = {r["source"]: (r["target_share"] or 0.0, r["max_repeats"] or 0) for r in targets.where("source is not null").collect()}
    used = rows.where("tokens > 0").join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    leaves = used.groupBy("domain", "lang", "source").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens")).collect()
    by_source: dict = defaultdict(int)
    for r in leaves:
        by_source[r["source"]] += r["tokens"]
    if total is None:
        total = rows.agg(F.sum("tokens")).first()[0] or 0
    tree = {}
    for r in leaves:
        share, repeats = wanted[r["source"]]
        tree[r["domain"], r["lang"], r["source"]] = (share * r["tokens"] / by_source[r["source"]], float(r["tokens"] * repeats))
    budget = budgets(tree, float(total))
    return [(r["domain"], r["lang"], r["source"], r["n"], r["tokens"], float(budget[r["domain"], r["lang"], r["source"]])) for r in leaves]


def mixture(rows: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 20) -> DataFrame:
    """The records of the mixture with the number of their ``uses``."""
    spark = rows.sparkSession
    leaves = spark.createDataFrame(plan(rows, targets, total), "domain string, lang string, source string, n bigint, leaf_tokens bigint, budget double")
    leaves = leaves.where("budget > 0").select(
        "domain", "lang", "source", F.floor(F.col("budget") / F.col("leaf_tokens")).alias("q"), (F.col("budget") % F.col("leaf_tokens")).alias("rest"), F.ceil(F.col("n") / SLICE).alias("slices")
    )
    names = ["domain", "lang", "source"]
    order = F.xxhash64("doc_id", F.lit(seed), "q")
    placed = rows.where("tokens > 0").join(F.broadcast(leaves), names).withColumn("order", order)
    placed = placed.withColumn("slice", F.floor((F.col("order") / F.lit(2.0**64) + 0.5) * F.col("slices")).cast("bigint"))
    sums = placed.groupBy(*names, "slice").agg(F.sum("tokens").alias("slice_tokens"))
    ends = sums.withColumn("end", F.sum("slice_tokens").over(Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.select(*names, "slice", (F.col("end") - F.col("slice_tokens")).alias("start"), "end")
    with_ends = placed.join(ends, [*names, "slice"])
    # only the one slice of a leaf in which the prefix ends is ordered record by record
    at_border = (F.col("start") <= F.col("rest")) & (F.col("end") > F.col("rest"))
    clear = with_ends.where(~at_border).withColumn("uses", F.col("q") + (F.col("end") <= F.col("rest")).cast("int"))
    so_far = F.col("start") + F.sum("tokens").over(Window.partitionBy(*names, "slice").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    border = with_ends.where(at_border).withColumn("middle", so_far - F.col("tokens") / 2)
    border = border.withColumn("uses", F.col("q") + (F.col("middle") <= F.col("rest")).cast("int")).drop("middle")
    return clear.unionByName(border).where("uses > 0").select("doc_id", *names, "tokens", F.col("uses").cast("int").alias("uses"))


def shares(rows: DataFrame, mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: its target, the tokens there are, those used, and the share reached."""
    used = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count("*").alias("records"), F.max("uses").alias("most_uses"))
    there = rows.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    joined = targets.join(there, "source", "left").join(used, "source", "left").na.fill(0)
    # the number of sources is that of the targets, a small table
    whole = F.sum("used_tokens").over(Window.partitionBy())
    share = F.when(whole > 0, F.col("used_tokens") / whole).otherwise(0.0)
    return joined.select("source", "target_share", "max_repeats", "tokens", "used_tokens", "records", "most_uses", F.round(share, 6).alias("share"))
