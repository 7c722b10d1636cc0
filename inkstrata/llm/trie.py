"""The prefix trie of conversations, built level by level.

A node is a sequence of first turns and is named by the least conversation that begins with it. At
each depth the live conversations, those that share their node, are grouped by (node,
next turn); the group's least id is the new node. A group may be of any size: its minimum
and count are taken in salted parts first, and each part is told the group's result, so
no task sees a group whole. A conversation alone in its node is no longer live: what is left of it is a chain of nodes known without grouping.
From the deepest shared level up, nodes are then joined to the sums of their children.

Turns take part by a digest of role and text. Levels are tables in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_folder, shuffle_width

BLOCK = 64  # turns of a chain that one row of its conversation meets
ENDS = 8  # 2**8 neighbouring ids are put together before a digest is carried on
TURNS = "conv_id long, digest binary, chars long, part int, place long"
NODES = "conv_id long, parent_conv_id long, n_convs long, chars long, last long"


def numbered(conversations: DataFrame, work: str) -> tuple[DataFrame, DataFrame]:
    """(turns: conv_id, pos from 1, digest, chars; conversations: conv_id, n) with positions by turn, null first.

    Equal turns of a conversation stand in the order of the digests of role and text. A conversation may hold most rows: all are sorted by range, and a position is the place in a
    partition with what lies in the partitions before.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.char_length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "_row"]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            own = [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("conv_id", "digest", "chars")], *own], [c.split()[0] for c in TURNS.split(", ")])
            at += n

    rows.repartitionByRange(shuffle_width(rows), *order).sortWithinPartitions(*order).mapInArrow(placed, TURNS).write.parquet(f"{work}/turns")
    turns = conversations.sparkSession.read.parquet(f"{work}/turns")
    # A row for each partition that a conversation lies in.
    held = turns.groupBy("part", "conv_id").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("part", "conv_id", "n", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1).alias("_shift"))
    found = turns.join(held, ["part", "conv_id"]).select("conv_id", (F.col("place") + F.col("_shift")).alias("pos"), "digest", "chars")
    return found, held.groupBy("conv_id").agg(F.sum("n").alias("n"))


def grafted(turns: DataFrame, convs: DataFrame, family: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and conversations rebuilt: each begins with the first turns of its family's first conversation.

    A conversation c takes h (its checksum's remainder) turns of c - c % family in place of its own first h.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    heads = convs.select(F.col("conv_id").alias("_head"), F.col("n").alias("_n"))
    with_head = convs.withColumn("_head", F.col("conv_id") - F.col("conv_id") % family).join(heads, "_head", "left")
    plan = with_head.select("conv_id", "_head", "n", h.alias("h"), F.least(h, F.coalesce("_n", F.lit(0))).alias("k"))
    lent = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).select(F.col("conv_id").alias("_head"), "pos", "digest", "chars")
    lent = lent.join(plan.where("k > 0").select("conv_id", "_head", "k"), "_head").where(F.col("pos") <= F.col("k")).select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    # Met by blocks of turns, so that a conversation of very many is dealt out.
    blocks = plan.where("n > h").select("conv_id", "h", "k", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / BLOCK))).alias("_block"))
    own = turns.withColumn("_block", F.floor(F.col("pos") / BLOCK)).join(blocks, ["conv_id", "_block"]).where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "digest", "chars")
    return lent.unionByName(own), plan.select("conv_id", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n"))


def _grouped(live: DataFrame, width: int) -> DataFrame:
    """Salted parts of each (parent, turn) with the whole group's least id and number."""
    parts = live.groupBy("parent", "digest", "salt").agg(F.min("conv_id").alias("_least"), F.count("*").alias("_n"), F.max("chars").alias("chars"), F.max("last").alias("last"))
    whole = W.partitionBy("parent", "digest")
    return parts.withColumns({"node": F.min("_least").over(whole), "n_convs": F.sum("_n").over(whole)})


def ends_digests(ends: DataFrame) -> DataFrame:
    """depth, conv_id, ends_sha256 of the nodes at which conversations end (``ends``: depth, node, conv_id).

    Neighbouring ids are joined first; a node's digest is then carried through its parts in order, so none is held whole.
    """
    part = F.shiftright("conv_id", ENDS)
    joined = ends.groupBy("depth", "node", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def told(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["depth", "conv_id", "ends_sha256"])

        for b in batches:
            done = []
            for depth, node, ids in zip(*[b.column(c).to_pylist() for c in ("depth", "node", "ids")], strict=True):
                if (depth, node) == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = (depth, node), hashlib.sha256()
                state.update(ids.encode())
            yield told(done)
        yield told([(*key, state.hexdigest())] if key is not None else [])

    dealt = joined.repartition(shuffle_width(ends), "depth", "node").sortWithinPartitions("depth", "node", "part")
    return dealt.mapInArrow(carried, "depth long, conv_id long, ends_sha256 string")


def nodes_of(turns: DataFrame, convs: DataFrame, work: str) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv_id, depth from 1, digest, chars. ``convs``: conv_id, n (turns, 0 for none). ``work``: a shared folder.
    Parts of a group are dealt by a hash of the id to as many salts as there are shuffle partitions.
    """
    spark, width = turns.sparkSession, shuffle_width(turns)

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    # By depth within each file, so that a level reads its own stretch.
    turns = kept(turns.sortWithinPartitions("depth"), "rebuilt")
    convs = kept(convs, "convs")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).first()
    if not root["n"]:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    live = kept(convs.where(F.lit(root["n"]) > 1).select("conv_id", F.lit(root["conv_id"]).alias("node"), F.col("n").alias("last")), "live-0")
    first = spark.createDataFrame([(root["conv_id"], None, root["n"], 0)], "conv_id long, parent_conv_id long, n_convs long, chars long")
    levels = [kept(first.join(convs.select("conv_id", F.col("n").alias("last")), "conv_id"), "nodes-0")]
    lives, depth = [live], 0
    while True:
        depth += 1
        salt = F.pmod(F.xxhash64("conv_id"), F.lit(width)).cast("int")
        next_ = live.where(F.col("last") >= depth).join(turns.where(F.col("depth") == depth), "conv_id").select("conv_id", F.col("node").alias("parent"), "digest", "chars", "last", salt.alias("salt"))
        seen = Observation()
        groups = _grouped(next_, width).observe(seen, F.count("*").alias("parts"), F.count_if(F.col("n_convs") > 1).alias("shared"))
        groups = kept(groups, f"groups-{depth}")
        if not seen.get["parts"]:
            break
        own = groups.where("_least = node").select(F.col("node").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "n_convs", "chars", "last")
        levels.append(own)
        if not seen.get["shared"]:
            break
        told = groups.where("n_convs > 1").select("parent", "digest", "salt", "node")
        live = kept(next_.join(told, ["parent", "digest", "salt"]).select("conv_id", "node", "last"), f"live-{depth}")
        lives.append(live)

    def at(depth: int) -> Column:
        return F.lit(depth).cast("long").alias("depth")

    empty = F.sha2(F.lit(""), 256)
    shared, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth].where("n_convs > 1").withColumn("_own", (F.col("n_convs") - 1) * F.col("chars"))
        if below is None:
            rolled = level.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": F.col("_own")})
        else:
            sums = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(F.count("*").alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
            rolled = level.join(sums, "conv_id", "left").withColumns(
                {"n_children": F.coalesce("_c", F.lit(0)), "n_leaves": F.coalesce("_l", F.lit(1)), "saved_tokens": F.col("_own") + F.coalesce("_s", F.lit(0))}
            )
        rolled = kept(rolled.select("conv_id", at(depth), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"), f"rolled-{depth}")
        shared.append(f"{work}/rolled-{depth}")
        sole = levels[depth].where("n_convs = 1").select("parent_conv_id", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        below = rolled.select("parent_conv_id", "n_leaves", "saved_tokens").unionByName(sole)

    heads, ends = None, None
    for depth, level in enumerate(levels):
        sole = level.where("n_convs = 1").select("conv_id", at(depth), "parent_conv_id", "last")
        heads = sole if heads is None else heads.unionByName(sole)
    for depth, rows in enumerate(lives):
        over = rows.where(F.col("last") == depth).select(at(depth), "node", "conv_id")
        ends = over if ends is None else ends.unionByName(over)
    heads = kept(heads, "heads")
    blocks = heads.where("last > depth").select("conv_id", F.col("depth").alias("_from"), "last", F.explode(F.sequence(F.floor(F.col("depth") / BLOCK), F.floor(F.col("last") / BLOCK))).alias("_block"))
    chain = turns.select("conv_id", "depth", F.floor(F.col("depth") / BLOCK).alias("_block")).join(blocks, ["conv_id", "_block"]).where(F.col("depth") > F.col("_from"))
    sole = heads.unionByName(chain.select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "last"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    over = F.col("last") == F.col("depth")
    sole = sole.select(
        "conv_id", "depth", "parent_conv_id", one.alias("n_convs"), F.when(over, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(over, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256")
    )
    whole = spark.read.parquet(*shared).join(ends_digests(ends), ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return whole.select(sole.columns).unionByName(sole)


def build(conversations: DataFrame, graft: bool = False) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, turn, role, text), the root first of all depths.

    Per node: conv_id (least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves (childless nodes below it, itself included),
    saved_tokens (code points that members share, over its subtree) and ends_sha256 (members that end there). Turns stand by number, null first, equal
    ones by the digest of role and text; null role and text are empty. Rows without a conversation are left out, other columns too; repeated rows are turns of their own; an empty table gives no
    nodes. ``graft`` first gives conversations the turns of their family's first one (see ``grafted``).
    """
    work = f"{shared_folder(conversations.sparkSession)}/trie-{uuid.uuid4().hex}"
    turns, convs = numbered(conversations, work)
    if graft:
        return nodes_of(*grafted(turns, convs), work)
    return nodes_of(turns.withColumnRenamed("pos", "depth"), convs, work)


#: The grafted trie: rebuilt turns as lists, nodes as groups of equal first parts, subtrees by membership.
TRIE_SQL = r"""
WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
checked AS (SELECT conv_id, w, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT),
  lambda crc, byte: list_reduce(range(8), lambda c, b: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT) % 6 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(list_slice(t.w, 1, c.h), []), list_slice(c.w, c.h + 1, len(c.w))) AS w
  FROM checked c LEFT JOIN own t ON t.conv_id = c.conv_id - c.conv_id % 100),
member AS (SELECT conv_id AS c, len(w) AS n, d, list_slice(w, 1, d) AS path FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)),
named AS (SELECT *, min(c) OVER (PARTITION BY d, path) AS node FROM member),
node AS (SELECT node AS conv_id, d AS depth, count(*) AS n_convs, coalesce(any_value(length(path[d].t)), 0) AS chars,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d), '') AS ends FROM named GROUP BY node, d),
up AS (SELECT a.node AS conv_id, a.d AS depth, b.node AS parent FROM named a JOIN named b ON a.c = b.c AND b.d = a.d - 1 WHERE a.c = a.node),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM up GROUP BY ALL),
flat AS (SELECT node.*, coalesce(kids.n, 0) AS kids, up.parent FROM node LEFT JOIN kids USING (conv_id, depth) LEFT JOIN up USING (conv_id, depth)),
below AS (SELECT m.node AS conv_id, m.d AS depth, count(*) FILTER (WHERE f.kids = 0) AS leaves, sum((f.n_convs - 1) * f.chars) AS saved
  FROM named m JOIN flat f ON f.conv_id = m.c AND f.depth >= m.d GROUP BY ALL)
SELECT conv_id, depth::BIGINT AS depth, parent AS parent_conv_id, n_convs, kids AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM flat JOIN below USING (conv_id, depth)
"""
