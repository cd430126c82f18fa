"""Mixing sources to target weights by hierarchical budgets.

Documents are the leaves' tokens of a tree (say domain, language, source).  A
token budget flows from the root by weights.  A node takes at most what its
subtree can use: a leaf its tokens times `epochs`, an inner node the sum over
its children of positive weight.  What a child cannot take goes to its siblings
first, and only when a whole subtree is full do its ancestors pass the rest on,
so the leaves' budgets add up to the least of the budget and what is usable.

Budgets are windows over one row for each leaf, level by level, in whole
numbers (weights count in millionths); nothing reaches the driver.  Children
that fill up come first in the order of capacity over weight, so running sums
tell which do; the others share the rest, by the largest remainder.

A leaf with T tokens and budget B takes B // T whole epochs, and of the next
epoch the longest prefix of whole documents within the rest, in the epoch's own
seeded order (md5 of seed, epoch and doc_id).  The prefix is found without
sorting a leaf in one task: documents fall into buckets by their order key,
bucket sums give the bucket where the budget ends, and only that one is sorted.

Defined cases: a null level is 'unknown'; null texts have no tokens, cost
nothing and follow their place in the order; weights that are missing count as
`default`, zero weights give nothing, negative or undefined ones are an error;
rows that repeat a doc_id are each counted and share one order key, ties among
them go by n_tokens; an empty table gives no rows; other columns, whatever
their names, are left out.  Output: doc_id, the levels, n_tokens, copies.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as X

#: rows in a bucket of a leaf's order, about
BUCKET_ROWS = 1000
#: weights and shares count in parts of this
PARTS = 1_000_000


def parts(weight: float) -> int:
    """A weight as a whole number; positive ones stay positive."""
    if not (weight >= 0 and math.isfinite(weight)):
        raise ValueError(f"a weight must be a finite number from 0 on, not {weight!r}")
    return max(1, round(weight * PARTS)) if weight else 0


def weighted(leaves: DataFrame, names: list[str], weights: Mapping[tuple[str, ...], float], default: float) -> DataFrame:
    """Adds w1, w2, ...: the weight of each leaf's node at every depth."""
    for depth in range(1, len(names) + 1):
        own = [(*path, parts(w)) for path, w in weights.items() if len(path) == depth]
        given = leaves.sparkSession.createDataFrame(own, ", ".join([*(f"{n} string" for n in names[:depth]), f"w{depth} long"]))
        leaves = leaves.join(F.broadcast(given), names[:depth], "left")  # the caller's own list
        leaves = leaves.withColumn(f"w{depth}", F.coalesce(f"w{depth}", F.lit(parts(default))))
    return leaves


def budgets(leaves: DataFrame, weights: Mapping[tuple[str, ...], float], total: int, epochs: int, default: float = 1.0) -> DataFrame:
    """Adds `budget` to leaves: (names, root first; then t, each leaf's tokens)."""
    names = leaves.columns[:-1]
    leaf, alive = weighted(leaves, names, weights, default), F.lit(True)
    for depth in range(len(names), 0, -1):  # what each node's subtree can use
        usable = F.sum(F.when(alive, F.col("t") * epochs).otherwise(0)).over(Window.partitionBy(*names[:depth]))
        leaf = leaf.withColumn(f"cap{depth}", usable)
        alive = alive & (F.col(f"w{depth}") > 0)
    for depth in range(1, len(names) + 1):
        own = leaf.groupBy(*names[:depth]).agg(F.max(f"w{depth}").alias("w"), F.max(f"cap{depth}").alias("cap"), (F.max("budget") if depth > 1 else F.lit(total)).alias("b"))
        leaf = leaf.drop("budget").join(divide(own, names[: depth - 1], names[depth - 1]), names[:depth])
    return leaf.select(*names, "t", "budget")


def divide(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Siblings' budgets: b, their parent's, by weight w under cap; what one cannot take the others share."""
    siblings = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    big = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    nodes = nodes.withColumn("open", (F.col("w") > 0) & (F.col("cap") > 0))
    given = lambda c, w, test="open": F.coalesce(F.sum(F.when(F.col(test), F.col(c))).over(w), F.lit(0)).cast("long")
    nodes = nodes.withColumn("b", F.least("b", given("cap", siblings))).withColumn("ratio", F.when(F.col("open"), F.col("cap") / F.col("w")))
    before = siblings.orderBy(F.col("ratio").asc_nulls_last(), name).rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("left", F.col("b") - given("cap", before)).withColumn("mass", given("w", siblings) - given("w", before))
    nodes = nodes.withColumn("full", F.col("open") & (big("left") * big("w") >= big("cap") * big("mass")))
    nodes = nodes.withColumn("sharing", F.col("open") & ~F.col("full"))
    nodes = nodes.withColumn("left", F.col("b") - given("cap", siblings, "full")).withColumn("mass", given("w", siblings, "sharing"))
    part = F.expr("CAST(left AS decimal(19,0)) * CAST(w AS decimal(19,0)) div CAST(mass AS decimal(19,0))")
    nodes = nodes.withColumn("part", F.when(F.col("sharing"), part)).withColumn("over", big("left") * big("w") - big("part") * big("mass"))
    rank = F.row_number().over(siblings.orderBy(F.col("over").desc_nulls_last(), name))
    more = F.when(rank <= F.col("left") - given("part", siblings, "sharing"), 1).otherwise(0)
    budget = F.when(F.col("full"), F.col("cap")).when(F.col("sharing"), F.least("cap", F.col("part") + more)).otherwise(F.lit(0))
    return nodes.select(*parent, name, budget.cast("long").alias("budget"))


def order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[tuple[str, ...], float], share: float = 0.5, epochs: int = 1, seed: int = 7, default: float = 1.0, broadcast_bytes: int = X.BROADCAST_BYTES) -> DataFrame:
    """Copies of each document in a mix of `share` of all tokens.  levels: name to column, root first."""
    if clash := {"doc_id", "n_tokens", "copies"} & set(levels):
        raise ValueError(f"a level cannot be named {min(clash)}")
    ws = X.Workspace(docs.sparkSession, "mixing", docs)
    names = [f"level_{k}" for k in range(len(levels))]
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = ws.write("rows", docs.select("doc_id", *(F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in zip(names, levels.values(), strict=True)), words.alias("n_tokens")))
    leaves = ws.write("leaves", rows.groupBy(*names).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")))
    tokens = leaves.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    each = budgets(leaves.select(*names, "t"), weights, tokens * parts(share) // PARTS, epochs, default).join(leaves.select(*names, "n"), names)
    some = F.col("t") > 0
    whole, rest = F.when(some, F.expr("budget div t")).otherwise(0), F.when(some, F.col("budget") % F.col("t")).otherwise(0)
    ws.write("plan", each.select(*names, whole.cast("long").alias("whole"), rest.cast("long").alias("rest"), F.greatest(F.lit(1), F.expr(f"n div {BUCKET_ROWS}")).cast("long").alias("buckets")))
    dealt = X.attach(ws, rows, "plan", names, bound=broadcast_bytes).withColumn("key", order_key(seed, F.col("whole")))
    dealt = dealt.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("buckets") / (1 << 32)))
    run = Window.partitionBy(*names).orderBy("bucket")
    sums = dealt.groupBy(*names, "bucket").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
    ends = sums.withColumn("before", F.sum("t").over(run) - F.col("t")).filter("before <= rest")
    ws.write("ends", ends.groupBy(*names).agg(F.max("bucket").alias("last"), F.max("before").alias("before")))
    placed = X.attach(ws, dealt, "ends", names, bound=broadcast_bytes)
    inner = Window.partitionBy(*names).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.filter("bucket = last").withColumn("more", (F.col("before") + F.sum("n_tokens").over(inner) <= F.col("rest")).cast("long"))
    sure = placed.filter("bucket <> last").withColumn("more", (F.col("bucket") < F.col("last")).cast("long"))
    copies = F.col("whole") + F.when(F.col("rest") > 0, F.col("more")).otherwise(F.lit(0))
    cols = ["doc_id", *(F.col(n).alias(k) for n, k in zip(names, levels, strict=True)), "n_tokens", copies.cast("long").alias("copies")]
    return sure.select(*cols).union(edge.select(*cols))


#: the query's and the pipeline's tree: weights by path, other nodes count 1
DOMAIN_WEIGHTS = {("crawl",): 1.0, ("web",): 2.0, ("curated",): 3.0, ("web", "en"): 3.0, ("curated", "en"): 2.0, ("crawl", "en"): 2.0}


def tree() -> dict[str, Column]:
    """Domain, language and source of the documents table."""
    source = F.col("source")
    domain = F.when(source == "src0", "crawl").when(source.rlike(r"^src[1-9]$"), "web").otherwise("curated")
    return {"domain": domain, "lang": F.col("lang"), "source": source}
