"""Connected components by randomised contraction (problem 6; also used to join runs across frame blocks).

Every round draws a fresh hash order of the vertices. Each vertex hooks to the vertex of its closed neighbourhood that
comes first in that order, edges are relabelled and deduplicated, and vertices left without an edge are finished. The
expected number of vertices falls by a constant factor a round, whatever the graph's shape (chains, stars, cliques). The
per-round mappings are then expanded from the last to the first, each join being as small as its round.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from detlake.session import cut, norm

#: Rounds that no graph of feasible size needs (an expected factor of at most 3/4 a round); reaching it is an error.
MAX_ROUNDS = 200


def contract(edges: DataFrame, a: str = "a", b: str = "b", seed: int = 20) -> DataFrame:
    """``(vertex, root)`` of every vertex with an edge to another one; vertices share a root iff they are connected.

    Nulls, loops, repeated and reversed edges are harmless and extra columns are ignored. An empty table gives an empty
    result. A hot vertex costs one row a neighbour: its minimum is pre-aggregated map-side and the relabelling joins
    have one row a vertex on the other side, so adaptive skew handling can split them.
    """
    pairs = edges.select(F.col(a).alias("_u"), F.col(b).alias("_v"))
    live = cut(_tidy(pairs))
    _release(live)
    mappings: list[DataFrame] = []
    for step in range(MAX_ROUNDS):
        if live.isEmpty():
            break
        both = live.select(F.explode(F.array(F.struct("_u", "_v"), F.struct(F.col("_v").alias("_u"), F.col("_u").alias("_v")))).alias("_e")).select("_e.*")
        order = lambda c: F.struct(F.xxhash64(F.lit(seed + step), c).alias("h"), c.alias("x"))
        first = both.groupBy("_u").agg(F.min(order(F.col("_v"))).alias("_n"))
        hooks = cut(first.select(F.col("_u").alias("_from"), F.least(F.col("_n"), order(F.col("_u")))["x"].alias("_to")))
        mappings.append(hooks)
        _release(hooks)
        left = live.join(hooks, F.col("_u") == F.col("_from")).select(F.col("_to").alias("_u"), "_v")
        live = _unsized(cut(_tidy(left.join(hooks, F.col("_v") == F.col("_from")).select("_u", F.col("_to").alias("_v")))))
        del left
        _release(live)
    else:
        raise RuntimeError("contraction did not end")
    if not mappings:
        return live.select(F.col("_u").alias("vertex"), F.col("_v").alias("root"))
    done = mappings.pop().select(F.col("_from").alias("vertex"), F.col("_to").alias("root"))
    while mappings:
        later = done.select(F.col("vertex").alias("_k"), F.col("root").alias("_r"))
        now = mappings.pop()
        done = now.join(later, now["_to"] == later["_k"], "left").select(F.col("_from").alias("vertex"), F.coalesce("_r", "_to").alias("root"))
    return done


def _unsized(df: DataFrame) -> DataFrame:
    """The same rows with Spark's default for an unknown size.

    A checkpoint keeps the size estimated for its plan, which is the product of the sides for a join. With two joins a
    round the estimate would have three times the digits after each, and the driver would hold and multiply these numbers.
    """
    session = df.sparkSession
    return DataFrame(session._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema()), session)


def _release(df: DataFrame) -> None:
    """Let Spark delete files of earlier rounds: it does so when nothing in Python or the driver's JVM refers to them any more
    and both have collected their garbage, which by itself may be half an hour later."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _tidy(pairs: DataFrame) -> DataFrame:
    u, v = F.col("_u"), F.col("_v")
    return pairs.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least(u, v).alias("_u"), F.greatest(u, v).alias("_v")).distinct()


def consolidate(edges: DataFrame, a: str = "a", b: str = "b", member: str = "member", group: str = "group_id") -> DataFrame:
    """One row per linked member with the smallest member of its component as the group's identifier."""
    found = cut(contract(edges, a, b))
    names = found.groupBy("root").agg(F.min("vertex").alias("_name"))
    return found.join(names, "root").select(F.col("vertex").alias(member), F.col("_name").alias(group))


def match_edges(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges of binding pair matches and of binding lists of matching images.

    Ids are normalised; null ends, null lists and null elements are ignored, as are rows whose hard_split_constraint is
    not true. A list links each member to its list's name (a vertex of its own kind), so a long list costs one edge a
    member and lists that come in parts meet there.
    """
    direct = pairs.where("hard_split_constraint").select(F.concat(F.lit("i:"), norm("first_image_id")).alias("a"), F.concat(F.lit("i:"), norm("second_image_id")).alias("b"))
    listed = groups.where("hard_split_constraint").select(F.concat(F.lit("g:"), norm("duplicate_group")).alias("a"), F.explode("member_image_ids").alias("_m"))
    alone = groups.where("hard_split_constraint AND duplicate_group IS NULL").select(F.explode(F.expr("transform(filter(member_image_ids, x -> x IS NOT NULL), x -> x)")).alias("b"), F.expr("filter(member_image_ids, x -> x IS NOT NULL)[0]").alias("a"))
    return (
        direct.unionByName(listed.select("a", F.concat(F.lit("i:"), norm("_m")).alias("b")))
        .unionByName(alone.select(F.concat(F.lit("i:"), norm("a")).alias("a"), F.concat(F.lit("i:"), norm("b")).alias("b")))
    )


def _code(name: str, seed: int):
    return F.when(F.col(name).isNotNull(), F.xxhash64(F.lit(seed), name))


def _coded_names(edges: DataFrame, seed: int) -> DataFrame:
    """``(code, name, other)`` of every vertex; name and other differ where vertices share a code."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("_x")).where("_x IS NOT NULL")
    return ends.groupBy(_code("_x", seed).alias("code")).agg(F.min("_x").alias("name"), F.max("_x").alias("other"))


def linked_images(pairs: DataFrame, groups: DataFrame, seed: int = 20) -> DataFrame:
    """``(canonical_image_id, group_id)`` of each image linked with at least one other, group_id the smallest id.

    The rounds see codes of eight bytes in place of ids, so that checkpoints and shuffles are small. Codes that two vertices share
    (one chance in ten thousand for 60 million vertices) are found first and the codes drawn anew.
    """
    edges = match_edges(pairs, groups)
    while not _coded_names(edges, seed).where("name <> other").isEmpty():
        seed += 1
    _release(edges)
    found = cut(contract(edges.select(_code("a", seed).alias("a"), _code("b", seed).alias("b"))))
    _release(found)
    images = edges.select(F.explode(F.array("a", "b")).alias("_x")).where(F.col("_x").startswith("i:"))
    images = images.groupBy(_code("_x", seed).alias("vertex")).agg(F.expr("substring(min(_x), 3)").alias("canonical_image_id")).join(found, "vertex")
    names = images.groupBy("root").agg(F.min("canonical_image_id").alias("group_id"), F.count("*").alias("_n")).where("_n > 1")
    return images.join(names, "root").select("canonical_image_id", "group_id")
