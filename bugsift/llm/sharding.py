r"""Sharding by balanced label propagation; law ``rows`` (counts at most one apart).

Documents start in shards dealt by a hash order, exactly level. In each round a
document wants the shard that holds most of its linked documents (its groups'
members: counts per group and shard, never pairs), if that beats its own; ties
go by a hash of the group, new in each round. Capacity quotas keep the shards
level: documents trade places along cycles of demand, and a shard takes in more
than it gives up only where documents without links step aside. Refused
documents with no linked one in their shard lose nothing elsewhere: they are
dealt anew among their own places. Groups larger than a shard fill several.
Rounds go on until nothing wants to move or the cut has not fallen for
``PATIENCE`` rounds (or ``rounds`` are over); the placement of least cut counts.

The link table is (doc, group); documents of one group are linked. For documents
the groups are equal texts. Only ids, sizes and hashes are shuffled.

Size: UTF-8 bytes of the text (null: 0) plus 1. Null texts are one group of
their own and are not linked (the empty text is a group like any other). Every
row is placed, repeated rows and null ids included; slots follow the id, ties in
hash order, and are gapless from 0 in each shard. Empty tables give no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_state
from .common import cut, partitions, prepare

SHARDS = 16
ROUNDS = None             # no bound: until a fixed point
PATIENCE = 3


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """0-based position of each row within its group, without a task per group:
    range partitions, sorted inside, with small tables of per-partition counts."""
    keys = [*group, *order]
    parts = partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                 .withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    # a row per partition and group that it holds
    per = ranged.groupBy("_pid", *group).agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (ranged.join(per, ["_pid", *group])
            .withColumn(name, F.col("_off") + F.col("_mono") - F.col("_first"))
            .drop("_pid", "_mono", "_first", "_off"))


def _cycle(left: dict[tuple[int, int], int], shards: int) -> list[tuple[int, int]]:
    """Moves of a shortest cycle of what is left; empty if there is none."""
    out = {i: [j for j in range(shards) if left.get((i, j))] for i in range(shards)}
    found: list[tuple[int, int]] = []
    for s in range(shards):
        back, line = {s: s}, [s]
        for u in line:
            if s in out[u]:
                path = [(u, s)]
                while u != s:
                    path.append((back[u], u))
                    u = back[u]
                if not found or len(path) < len(found):
                    found = path
                break
            for v in out[u]:
                if v not in back:
                    back[v] = u
                    line.append(v)
    return found


def _quotas(want: dict[tuple[int, int], int], idle: dict[int, int], shards: int) -> dict[tuple[int, int], int]:
    """How many of the moves (from, to) are granted, so that what a shard takes
    in beyond what leaves it is at most its idle documents. Shards x shards
    numbers, whatever the data. Each cycle uses up a move, so the search ends."""
    left = {k: n for k, n in want.items() if n}
    granted = {k: 0 for k in want}

    def grant(k: tuple[int, int], n: int) -> None:
        granted[k] += n
        left[k] -= n

    while path := _cycle(left, shards):
        n = min(left[k] for k in path)
        for k in path:
            grant(k, n)
    # no cycles are left: from the last shards of all chains back to the first, each takes in
    # as many as it has idle documents and gives up
    room, todo = dict(idle), set(range(shards))
    while todo:
        j = min(s for s in todo if not any(left.get((s, t)) for t in todo))
        todo.remove(j)
        for k in sorted((k for k in left if k[1] == j), key=lambda k: (-left[k], k)):
            n = min(left[k], room.get(j, 0))
            if n:
                grant(k, n)
                room[j] -= n
                room[k[0]] = room.get(k[0], 0) + n
    return granted


def propagate(placed: DataFrame, links: DataFrame, shards: int = SHARDS,
              rounds: int | None = ROUNDS) -> DataFrame:
    """Level placement after label propagation.

    placed: (node, shard), level; links: (node, group). Returns (node, shard)."""
    spark = placed.sparkSession
    prepare(spark)
    # a round's tables are written and reread, so that the next plan knows their true sizes
    state = cut_lineage(placed.select("node", F.col("shard").cast("int").alias("shard")))
    links = cut_lineage(links.select("node", "group").distinct())
    busy = cut_lineage(links.select("node").distinct())
    capacity = -(-state.count() // shards)
    best_state, most, stale = state, -1, 0
    for r in itertools.count():
        member = links.join(state, "node")
        held = [F.count_if(F.col("shard") == k).alias(f"s{k}") for k in range(shards)]
        per = member.groupBy("group").agg(*held)
        kept = F.aggregate(F.array(*[F.col(f"s{k}") for k in range(shards)]), F.lit(0.0), lambda a, n: a + n * (n - 1) / 2)
        whole = per.agg(F.sum(kept)).first()[0] or 0
        if whole > most:
            if best_state is not state:
                drop_state(best_state)
            best_state, most, stale = state, whole, 0
        else:
            stale += 1
        if stale == PATIENCE or r == rounds:
            break
        # linked documents of each node per shard, itself included where it is
        totals = (member.join(per, "group").groupBy("node", "shard")
                  .agg(F.array(*[F.sum(f"s{k}") for k in range(shards)]).alias("t"), F.min("group").alias("key")))
        idle = {x["shard"]: x["n"] for x in state.join(busy, "node", "left_anti").groupBy("shard")
                .agg(F.count(F.lit(1)).alias("n")).collect()}
        # in every other round only shards with idle documents, and the own one, are aimed at, so
        # that who waits for a full shard gathers elsewhere
        room = [s for s in range(shards) if r % 2 == 0 or idle.get(s, 0)]
        open_to = F.array(*map(F.lit, room or range(shards)))
        # these by linked documents held; ties by a hash of the group, so twins meet. Documents
        # with more linked ones than a shard holds aim for as many of the best shards as these
        # would fill.
        best = F.sort_array(F.filter(F.transform("t", lambda n, s: F.struct(
            n.alias("n"), F.xxhash64(F.col("key"), s, F.lit(r)).alias("h"), s.alias("s"))),
            lambda x: F.array_contains(open_to, x["s"]) | (x["s"] == F.col("shard"))), asc=False)
        kin = F.aggregate(best, F.lit(0).cast("long"), lambda a, x: a + x["n"])
        k = F.greatest(F.lit(1), F.ceil(kin / capacity)).cast("int")
        have = F.get("t", F.col("shard"))
        wish = (totals.withColumn("top", F.slice(best, F.lit(1), k))
                .where(~F.exists("top", lambda x: x["s"] == F.col("shard")))
                .withColumn("b", F.get("top", F.pmod(F.xxhash64("node", F.lit(r)), F.size("top")).cast("int")))
                .select("node", F.col("shard").alias("from"), F.col("b.s").cast("int").alias("to"),
                        (F.col("b.n") - have).alias("gain"), (have == 1).alias("loose")))
        wish = cut_lineage(wish)
        want = {(x["from"], x["to"]): x["n"] for x in wish.groupBy("from", "to")
                .agg(F.count(F.lit(1)).alias("n")).collect()}
        if not want:
            drop_state(wish)
            if len(room) == shards:
                break
            continue
        granted = _quotas(want, idle, shards)
        rule = spark.createDataFrame([(i, j, n) for (i, j), n in sorted(granted.items())], "`from` int, `to` int, q long")
        ranked = numbered(wish, ["from", "to"], [F.desc("gain"), F.xxhash64("node", F.lit(r)), "node"], "pos")
        ranked = ranked.join(F.broadcast(rule), ["from", "to"])
        moves = ranked.where("pos < q").select("node", "to")
        # idle documents of the shards that gained leave for those that lost
        gain = {s: sum(n for (_, j), n in granted.items() if j == s) - sum(n for (i, _), n in granted.items() if i == s)
                for s in range(shards)}
        holes = [s for s in range(shards) if gain[s] < 0]
        plan, lack = [], {s: -gain[s] for s in holes}
        for s in range(shards):
            at, left = 0, max(gain[s], 0)
            for h in holes:
                n = min(left, lack[h])
                if n > 0:
                    plan.append((s, at, at + n, h))
                    at, left, lack[h] = at + n, left - n, lack[h] - n
        if plan:
            givers = sorted({x[0] for x in plan})
            spare = numbered(state.join(busy, "node", "left_anti").where(F.col("shard").isin(givers)),
                             ["shard"], [F.xxhash64("node", F.lit(r)), "node"], "pos")
            table = spark.createDataFrame(plan, "s int, lo long, hi long, `to` int")
            moves = moves.unionByName(
                spare.join(F.broadcast(table), (F.col("shard") == F.col("s")) & (F.col("pos") >= F.col("lo"))
                           & (F.col("pos") < F.col("hi"))).select("node", "to"))
        # refused documents without a linked one beside them change places among themselves
        refused = cut_lineage(ranked.where("pos >= q AND loose").select("node", "from"))
        places, at = [], 0
        for x in refused.groupBy("from").agg(F.count(F.lit(1)).alias("n")).orderBy("from").collect():
            places.append((at, at + x["n"], x["from"]))
            at += x["n"]
        if places:
            table = spark.createDataFrame(places, "lo long, hi long, `to` int")
            dealt = numbered(refused, [], [F.xxhash64("node", F.lit(r)), "node"], "pos")
            moves = moves.unionByName(dealt.join(F.broadcast(table), (F.col("pos") >= F.col("lo"))
                                                 & (F.col("pos") < F.col("hi"))).select("node", "to"))
        old = state
        state = cut_lineage(state.join(moves, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")))
        drop_state(wish, refused, None if old is best_state else old)
    return best_state


def cut_links(placed: DataFrame, links: DataFrame) -> DataFrame:
    """One row: linked pairs (documents of one group) and how many are split."""
    n = links.join(placed, "node").groupBy("group", "shard").agg(F.count(F.lit(1)).cast("double").alias("n"))
    g = n.groupBy("group").agg(F.sum("n").alias("n"), F.sum(F.expr("n * (n - 1) / 2")).alias("whole"))
    return g.agg(F.sum(F.expr("n * (n - 1) / 2")).alias("pairs"),
                 F.sum(F.expr("n * (n - 1) / 2 - whole")).alias("split"))


def shard_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shards: int = SHARDS, rounds: int | None = ROUNDS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    prepare(docs.sparkSession)
    t = F.col(text_col).cast("string")
    rows = docs.select(
        F.col(id_col).alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("crc"),
        F.when(t.isNotNull(), F.md5(t.cast("binary"))).alias("digest"))
    base = cut(numbered(rows, [], [F.xxhash64("id"), "id", "digest"], "node")
               .withColumn("shard", (F.col("node") % shards).cast("int")))
    copies = (base.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("_n"))
              .where("_n > 1").select("digest"))
    links = base.join(copies, "digest").select("node", F.col("digest").alias("group"))
    placed = propagate(base.select("node", "shard"), links, shards, rounds)
    out = numbered(base.drop("shard").join(placed, "node"), ["shard"], ["id", "node"], "slot")
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                      "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
