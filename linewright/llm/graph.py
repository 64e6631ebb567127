"""Connected groups in DataFrame operations, without all pairs of a list and without collecting edges."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, label for every id in edges (a, b): ids have one label exactly if they are connected.

    Each round every id takes the first of itself and its neighbours, in the order of ids and of a hash by turns, as its
    label, and the edges are carried over to the labels. A star around its smallest id is done in one round, and hashed
    rounds shrink any graph by a constant factor in expectation. Rounds write to the shared folder.
    """
    e = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not e.isEmpty():
        n = len(rounds)
        turn = (lambda c: c) if n % 2 == 0 else (lambda c, n=n: F.xxhash64(c, F.lit(n)))
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("id")).agg(F.min(F.struct(turn(F.col("b")).alias("t"), F.col("b").alias("label"))).alias("m"))
        own = F.struct(turn(F.col("id")).alias("t"), F.col("id").alias("label"))
        labels = scratch.save(first.select("id", F.least("m", own)["label"].alias("label")))
        to = lambda c, labels=labels: labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}2"))
        carried = e.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct()
        before, e = e, scratch.save(carried)
        scratch.drop(before)
        rounds.append(labels)
    if not rounds:
        return e.select(F.col("a").alias("id"), F.col("b").alias("label"))
    out = rounds[-1]
    for labels in reversed(rounds[:-1]):
        last = out.select(F.col("id").alias("label"), F.col("label").alias("later"))
        out = labels.join(last, "label", "left").select("id", F.coalesce("later", "label").alias("label"))
    return scratch.save(out)


def connect(lists: DataFrame, verify: Callable[[DataFrame], DataFrame], scratch: Scratch, may: Callable[[str, str], Column] | None = None, odd: str = "id", before: str | None = None) -> DataFrame:
    """id with label for the groups of ids that links join; a link is a pair that stands in some list and passes verify.

    lists: v, id and whatever may() looks at; may(p, q) is a cheap necessary condition on the columns prefixed p and q, part of
    the joins, so pairs that fail it never become rows. Every list's hub, its member of the least column odd and then id, is tried against the others first, which connects a list of near
    copies in as many pairs as it has members.
    Only pairs that are still in different groups are tried then, so that groups come out as if all pairs had been tried.
    before names a column with the values of an id's earlier lists, in an order that all ids share: with it these pairs become
    rows in the first list that has both, and nowhere else.
    """
    cols = [c for c in lists.columns if c not in ("v", before)]
    own = Window.partitionBy("v")
    hub = F.min(F.struct(F.col(odd).alias("_odd"), F.col("id").alias("_id"), *[F.col(c).alias(f"h_{c}") for c in cols])).over(own)
    lists = lists.where(F.col("id").isNotNull()).withColumn("hub", hub).withColumn("size", F.count("*").over(own)).where("size > 1").drop("size")
    earlier = [before] if before else []
    lists = scratch.save(lists.select("v", *earlier, *cols, *[F.col("hub")[f"h_{c}"].alias(f"h_{c}") for c in cols]))
    may = may or (lambda p, q: F.lit(True))
    first = lists.where("id <> h_id").where(may("h_", "")).select(F.col("h_id").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch.save(verify(first))
    groups = components(links, scratch)
    now = lists.select("v", *earlier, *cols, F.col("h_id").alias("hub")).join(groups.withColumnRenamed("label", "g"), "id", "left").withColumn("g", F.coalesce("g", "id"))
    sizes = now.groupBy("v", "g").agg(F.count("*").alias("n"))
    split = sizes.groupBy("v").agg(F.max_by("g", F.struct("n", "g")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    rest = scratch.save(now.join(split, "v"))
    mine = lambda p: rest.select("v", *[F.col(c).alias(p + c) for c in (*cols, *earlier, "g", "main", "hub")])
    p = mine("p_").where("p_g <> p_main and p_id <> p_hub")
    q = mine("q_").where("q_id <> q_hub")
    more = p.join(q, "v").where("p_g <> q_g and (q_g = q_main or p_id < q_id)").where(may("p_", "q_"))
    for c in earlier:
        more = more.where(~F.arrays_overlap(f"p_{c}", f"q_{c}"))
    more = scratch.save(more.select(F.least("p_id", "q_id").alias("a"), F.greatest("p_id", "q_id").alias("b")).distinct())
    found = scratch.save(verify(more))
    scratch.drop(lists, rest, more)
    return groups if found.isEmpty() else components(links.unionAll(found), scratch)


def connect_narrow(lists: list[DataFrame], verify: Callable[[DataFrame], DataFrame], scratch: Scratch, may: Callable[[str, str], Column], fits: Callable[..., Column], carried: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """As connect() for tables of lists (v, id, n, at), of which no two have the same v; n belongs to the id, at may be null.

    Only v, id, n, at are shuffled for values that stand once, and for the pairs with hubs, of which fits(n, at, n, at) is a
    necessary condition; verify gets each of these once, with all places shared (h_at of the hub a, at of b). Lists in which
    groups differ then get the columns that may(p, q) looks at from carried, one table after the other.
    """
    own = Window.partitionBy("v")
    hub = F.min(F.struct("id", "n", "at")).over(own)
    parts, kept, first = [], [], []
    for part in lists:
        part = part.withColumn("size", F.count("*").over(own)).withColumn("hub", hub).where("size > 1")
        part = scratch.save(part.select("v", "size", "id", "n", "at", *[F.col("hub")[c].alias(f"h_{c}") for c in ("id", "n", "at")]), "zstd")
        parts.append(part)
        pairs = part.where("id <> h_id").where(fits(*[F.col(c) for c in ("h_n", "h_at", "n", "at")]))
        first.append(pairs.select(F.col("h_id").alias("a"), F.col("id").alias("b"), "h_at", "at"))
        # two ids are a list that its hub has settled
        kept.append(part.where("size > 2").select("v", "id", "n", "at", F.col("h_id").alias("hub")))
    met = reduce(DataFrame.unionAll, first).groupBy("a", "b").agg(F.collect_set(F.struct("h_at", "at")).alias("shared"))
    met = scratch.save(met)
    links = scratch.save(verify(met))
    scratch.drop(met)
    groups = components(links, scratch)
    tried = []
    for part, more_than_two in zip(parts, kept, strict=True):
        now = more_than_two.join(groups.withColumnRenamed("label", "g"), "id", "left").withColumn("g", F.coalesce("g", "id"))
        sizes = now.groupBy("v", "g").agg(F.count("*").alias("n"))
        split = sizes.groupBy("v").agg(F.max_by("g", F.struct("n", "g")).alias("main"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
        rest = scratch.save(carried(now.join(split, "v")))
        scratch.drop(part)
        mine = lambda p, rest=rest: rest.select("v", *[F.col(c).alias(p + c) for c in rest.columns if c != "v"])
        p = mine("p_").where("p_g <> p_main and p_id <> p_hub")
        q = mine("q_").where("q_id <> q_hub")
        more = p.join(q, "v").where("p_g <> q_g and (q_g = q_main or p_id < q_id)").where(may("p_", "q_"))
        tried.append(scratch.save(more.select(F.least("p_id", "q_id").alias("a"), F.greatest("p_id", "q_id").alias("b")).distinct()))
        scratch.drop(rest)
    found = scratch.save(verify(reduce(DataFrame.unionAll, tried).distinct()))
    scratch.drop(*tried)
    return groups if found.isEmpty() else components(links.unionAll(found), scratch)
