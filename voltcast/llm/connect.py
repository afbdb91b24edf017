"""Connected groups from bucketed candidates, without all pairs inside a bucket.

Two nodes are candidates if they share a bucket; a costly check decides which
candidates are linked. Only the connected groups are wanted, so pairs that are
already in one group need no check:

1. star rounds: every member of a bucket is checked against one node of it,
   which is linear in the bucket. The first centre is the node of the highest
   ``rank`` (a guess at what the others are copies of), later ones are drawn by
   a hash, in buckets that still hold two groups and against other groups only;
2. what is left: in such buckets, all pairs of different groups.

Each pair is checked once per step however many buckets it shares. No bucket
is gathered in one task: centres are found by pre-aggregated minima and joined
back, which Spark can split when a bucket is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltcast.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every linked node: (node, component).

    ``links`` has long columns a, b. Alternates large-star and small-star steps
    until every node points to one root and no root points on; each turn is
    written to the shared folder.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        edges = written(edges, "edges")
        roles = edges.select(F.col("u").alias("n"), F.lit(1).alias("from"), F.lit(0).alias("to")).unionByName(
            edges.select(F.col("v").alias("n"), F.lit(0).alias("from"), F.lit(1).alias("to")))
        if roles.groupBy("n").agg(F.sum("from").alias("f"), F.sum("to").alias("t")).where("f > 1 or (f = 1 and t > 0)").isEmpty():
            break
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = written(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").where("u <> v").distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def groups(buckets: DataFrame, fits: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame], rounds: int = 1,
           first: DataFrame | None = None, led: bool = True, split: str | None = None,
           apart: Callable[[str, str], Column] | None = None) -> DataFrame:
    """Connected groups of the nodes in ``buckets``: (node, component) for every linked node.

    ``buckets`` has key, node (long), rank (any ordered type) and the columns
    that ``fits`` needs; ``fits(a, b)`` is a cheap necessary condition on those
    columns with the prefixes a and b. ``verify`` gets distinct pairs (a, b) and
    returns those that are linked. Nodes that no link reaches are absent. An
    empty table gives an empty one. A caller that has made the first star round's
    pairs itself passes them as ``first``; ``buckets`` then needs no rank, and
    only the buckets of three members or more. If ``first`` comes from other
    buckets, ``led`` is false and all buckets of two are wanted. ``split`` names
    a column that deals a bucket into parts with a centre each, for nodes that
    differ so much that one centre would fit few of them. With ``apart``, a guess at
    how far two nodes are from each other, the open pairs are written, and of each
    two groups the nearest are checked before the others.
    """
    info = [c for c in buckets.columns if c not in ("key", "component", "rank", split)]
    part = ["key", split] if split else ["key"]
    led = led and not split

    def star(rows: DataFrame, order: Column, other_group: bool) -> DataFrame:
        carried = info + ["component"] * other_group
        lead = rows.groupBy(*part).agg(F.max(F.struct(order, *carried)).alias("c"), F.count("*").alias("members")).where("members > 1")
        lead = lead.select(*part, *[F.col(f"c.{c}").alias(f"lead_{c}") for c in carried])
        pairs = rows.join(lead, part).where(F.col("node") != F.col("lead_node")).where(fits("lead_", ""))
        if other_group:
            pairs = pairs.where("component <> lead_component")
        return pairs.select(F.least("lead_node", "node").alias("a"), F.greatest("lead_node", "node").alias("b")).distinct()

    def joined(known: DataFrame, found: DataFrame) -> DataFrame:
        if found.isEmpty():
            return known
        return components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found))

    links = written(verify(star(buckets, F.col("rank"), False) if first is None else first), "links")
    known = components(links)
    rows = None
    for turn in range(1, rounds + 1):
        named = (buckets.drop("rank") if rows is None else rows.drop("component")).join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
        open_keys = (named.groupBy("key").agg(F.count("*").alias("members"), F.min("component").alias("x"), F.max("component").alias("y"))
                     .where((F.col("members") > (2 if led or turn > 1 else 1)) & (F.col("x") != F.col("y"))).select("key"))
        rows = written(named.join(open_keys, "key"), "open")
        if rows.isEmpty():
            break
        if turn < rounds:
            more = star(rows, F.xxhash64("node", F.lit(turn)).alias("order"), True)
        else:
            a = rows.select("key", *[F.col(c).alias(f"l_{c}") for c in [*info, "component"]])
            more = a.join(rows, "key").where("l_component < component").where(fits("l_", ""))
            ends = [F.least("l_node", "node").alias("a"), F.greatest("l_node", "node").alias("b")]
            if apart is None:
                more = more.select(*ends).distinct()
            else:
                pairs = written(more.select(*ends, F.col("l_component").alias("x"), F.col("component").alias("y"), apart("l_", "").alias("far")).distinct(), "pairs")
                nearest = pairs.groupBy("x", "y").agg(F.min(F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")
                known = joined(known, written(verify(nearest), "links"))
                now = known.select(F.col("node").alias("x"), F.col("component").alias("now_x"))
                pairs = pairs.join(now, "x", "left").join(now.select(F.col("x").alias("y"), F.col("now_x").alias("now_y")), "y", "left")
                more = pairs.where(F.coalesce("now_x", "x") != F.coalesce("now_y", "y")).select("a", "b")
        known = joined(known, written(verify(more), "links"))
    return known
