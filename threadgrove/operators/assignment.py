"""Largest one-to-one assignment over a sparse table of counts, by an auction whose state is a table.

Labels bid for clusters. In a round every label without a cluster bids on the one that is worth most to it after its price, and
raises the price by how much the second best is worth less, plus epsilon; each cluster goes to its highest bid. Counts are whole numbers and
are scaled by the number of bidders plus one, so with a last epsilon of 1 the result is exact. Epsilon falls in phases,
prices stay from phase to phase, which keeps price wars short.

For a label or cluster to stay alone, each has a stand-in on the other side that is worth nothing: so every bidder finds a place, and
prices of an earlier phase do no harm. A round is three joins on ids and one written table of a row per object; nothing is ever whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from threadgrove.session import stored

FALL = 6  # by what epsilon is divided from phase to phase


def _with_stand_ins(cells: DataFrame) -> DataFrame:
    """bidder, object, n: the cells, and the stand-ins of both sides. Names are made of a kind and the name on that side."""
    label, cluster = F.struct(F.lit(0).alias("kind"), F.col("row").alias("of")), F.struct(F.lit(1).alias("kind"), F.col("column").alias("of"))
    none = F.lit(0).cast("bigint").alias("n")
    own = cells.select(label.alias("bidder"), cluster.alias("object"), F.col("n").cast("bigint").alias("n"))
    # label l may take its own stand-in, a cluster's stand-in its cluster or the stand-in of a label that has cells with it
    alone = cells.select("row").distinct().select(label.alias("bidder"), label.alias("object"), none)
    left = cells.select("column").distinct().select(cluster.alias("bidder"), cluster.alias("object"), none)
    both = cells.select(cluster.alias("bidder"), label.alias("object"), none)
    return own.unionAll(alone).unionAll(left).unionAll(both)


def assignment(cells: DataFrame) -> DataFrame:
    """row, column, n of the chosen cells of (row, column, n), one row per cell and whole counts above 0: each row and column at most
    once, with the largest sum. Rows and columns are strings or structs of strings; an empty table gives an empty one.
    """
    cells = stored(cells.filter("n > 0"))
    edges = stored(_with_stand_ins(cells))
    facts = edges.agg(F.count_distinct("bidder").alias("bidders"), F.max("n").alias("most")).first()
    bidders, most = facts["bidders"], facts["most"] or 0
    if not bidders:
        return cells.select("row", "column", "n")
    scale = bidders + 1
    edges = edges.withColumn("value", F.col("n") * scale)
    kind = edges.schema["bidder"].dataType
    state = stored(edges.select("object").distinct().select("object", F.lit(0).cast("bigint").alias("price"), F.lit(None).cast(kind).alias("owner")))
    epsilon = max(1, most * scale // 4)
    while True:
        left = bidders
        state = state.withColumn("owner", F.lit(None).cast(kind))
        while left:
            state, left = _round(edges, state, epsilon, most * scale, bidders)
        if epsilon == 1:
            break
        epsilon = max(1, epsilon // FALL)
    pairs = state.select(F.col("owner").alias("bidder"), "object").join(edges, ["bidder", "object"])
    return pairs.filter("n > 0").select(F.col("bidder.of").alias("row"), F.col("object.of").alias("column"), "n")


def _round(edges: DataFrame, state: DataFrame, epsilon: int, most: int, bidders: int) -> tuple[DataFrame, int]:
    """All bids of the bidders without an object; the new state, and how many are without one now."""
    waiting = edges.join(state.filter("owner is not null").select(F.col("owner").alias("bidder")), "bidder", "left_anti")
    net = (F.col("value") - F.col("price")).alias("net")
    offers = waiting.join(state.select("object", "price"), "object").groupBy("bidder").agg(
        # the objects of one bidder, as many as its row has cells
        F.slice(F.sort_array(F.collect_list(F.struct(net, "object", "price")), asc=False), 1, 2).alias("two"))
    best, second = F.get("two", F.lit(0)), F.get("two", F.lit(1))["net"]
    bid = best["price"] + best["net"] - F.coalesce(second, best["net"] - 2 * most) + epsilon
    bids = offers.select(best["object"].alias("object"), F.struct(bid.alias("bid"), "bidder").alias("b")).groupBy("object").agg(F.max("b").alias("b"))
    seen = Observation()
    new = state.join(bids, "object", "left").select(
        "object", F.coalesce("b.bid", "price").alias("price"), F.coalesce("b.bidder", "owner").alias("owner"))
    new = stored(new, seen, owned=F.count("owner"))
    return new, bidders - seen.get["owned"]
