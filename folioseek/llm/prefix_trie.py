"""The trie of shared conversation prefixes, by fixed-length blocks of turns.

Turns are dealt into blocks of ``BLOCK`` that follow each other. A block has a
digest of its turns at their places, and the digests up to a block's end name
the conversations that are equal up to there: a group.

* Conversations are grouped by successive block digests first. Where all of a
  group go on to the same next block, its turns are read from one of them, and
  the nodes inside take their figures from the group.
* Only in blocks where the members of a group part, or end, turns are grouped
  one by one.
* Figures of subtrees are sums over members: each conversation counts the code
  points that it shares with a smaller one, and whether it is the one that
  stands for a childless node. No node is visited for each of its ancestors.

Turn numbers and digests so far are running values over ranges of rows
(``scans.running``), so a conversation may hold any share of all turns. Member
ids of a node are strung together in pieces of ``PIECE`` and hashed as a stream.

Rows of a conversation are ordered by ``turn`` (null first), then role and text,
so repeated turns stand together. Null roles and texts are empty. Rows without a
``conv_id`` belong to no conversation. Other columns are not read. Digests are
two 64-bit hashes; equal digests are taken for equal prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from folioseek.operators.scans import running
from folioseek.sources.scratch import written

BLOCK = 4
PIECE = 1 << 14

# Conversations of one hundred share the beginning of the first of them, in the rebuilt table.
SHARED, LONGEST_START = 100, 6

NODE = ["depth", "k1", "k2"]


def numbered(conversations: DataFrame) -> DataFrame:
    """``conv_id, d, role, text``: turns with their number from 1 in their conversation."""
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return running(rows, ["conv_id"], ["turn", "role", "text"], {"d": F.lit(1)}).select("conv_id", F.col("d").cast("long").alias("d"), "role", "text")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations, and their turns after each got the beginning of the first of its hundred.

    Conversation ``c`` begins with the first ``crc32(c) mod 6`` turns of
    ``c - c mod 100`` and goes on with its own turns after as many.
    """
    lengths = written(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "lengths")
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % LONGEST_START
    first = F.col("conv_id") - F.col("conv_id") % SHARED
    firsts = lengths.select(F.col("conv_id").alias("first"), F.col("own").alias("length"))
    kept = F.least("head", F.coalesce("length", F.lit(0)))
    convs = written(
        lengths.select("conv_id", head.alias("head"), first.alias("first")).join(firsts, "first", "left").select("conv_id", "head", "first", kept.alias("kept")),
        "conversations",
    )
    starts = turns.where(F.col("d") < LONGEST_START).select(F.col("conv_id").alias("first"), "d", "role", "text")
    beginnings = convs.where("kept > 0").join(starts, "first").where("d <= kept").select("conv_id", "d", "role", "text")
    own = turns.join(convs, "conv_id").where("d > head").select("conv_id", (F.col("d") - F.col("head") + F.col("kept")).alias("d"), "role", "text")
    return convs.select("conv_id"), beginnings.unionByName(own)


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of the joined ids of each node, of pieces sorted by node and place."""
    node, digest, n = None, None, 0
    done: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "n_ends", "ends_sha256"])

    for batch in batches:
        columns = [batch.column(name).to_pylist() for name in (*NODE, "n", "ids")]
        for *place, count, ids in zip(*columns, strict=True):
            if place != node:
                if node is not None:
                    done.append((*node, n, digest.hexdigest()))
                node, digest, n = place, sha256(), 0
            digest.update(("," if n else "").encode() + ids.encode())
            n += count
        if len(done) > 1 << 14:
            yield flushed()
            done = []
    if node is not None:
        done.append((*node, n, digest.hexdigest()))
        yield flushed()


def _ends(finals: DataFrame) -> DataFrame:
    """``n_ends, ends_sha256`` of the nodes where conversations end."""
    piece = F.floor(F.col("conv_id") / PIECE)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = finals.groupBy(*NODE, piece.alias("piece")).agg(F.count("*").alias("n"), ids.alias("ids"))
    placed = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "n", "ids")
    return placed.mapInArrow(_hashed_ids, "depth bigint, k1 bigint, k2 bigint, n_ends bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each node of the trie of ``turns(conv_id, d, role, text)``, numbered from 1 in each conversation.

    ``conversations``: every ``conv_id`` once, those without turns too. Columns:
    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (code points that sharing
    saves in the subtree) and ``ends_sha256``. Without conversations there is no node.
    """
    place = F.floor((F.col("d") - 1) / block)
    first, second = F.xxhash64("d", "role", "text"), F.xxhash64("text", "role", F.lit("second"), "d")
    hashed = written(
        turns.select("conv_id", F.col("d").alias("depth"), place.alias("blk"), first.alias("x1"), second.alias("x2"), F.char_length("text").cast("long").alias("size")),
        "turns",
    )
    blocks = hashed.groupBy("conv_id", "blk").agg(F.count("*").alias("n"), F.bit_xor("x1").alias("b1"), F.bit_xor("x2").alias("b2"), F.sum("size").alias("chars"))
    blocks = running(written(blocks, "blocks"), ["conv_id"], ["blk"], {"to": F.col("chars")}, {"g1": F.col("b1"), "g2": F.col("b2")})
    blocks = written(
        blocks.select(
            "conv_id", "blk", "n", (F.col("n") == block).alias("full"), "to", (F.col("to") - F.col("chars")).alias("before"),
            "g1", "g2", F.col("g1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("g2").bitwiseXOR(F.col("b2")).alias("p2"),
        ),
        "groups",
    )

    # Groups: full blocks by their end, and the group that they come from.
    ended = blocks.where("full").groupBy("blk", "g1", "g2").agg(
        F.count("*").alias("members"), F.min("conv_id").alias("least"), F.first("p1").alias("p1"), F.first("p2").alias("p2")
    )
    groups = written(ended, "ended")
    total = conversations.agg(F.count("*").alias("members")).select(F.lit(-1).cast("long").alias("blk"), F.lit(0).cast("long").alias("g1"), F.lit(0).cast("long").alias("g2"), "members")
    above = groups.select("blk", "g1", "g2", "members").unionByName(total)
    above = above.select((F.col("blk") + 1).alias("blk"), F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("members").alias("above"))
    whole = written(groups.join(written(above, "above"), ["blk", "p1", "p2"]).where("members = above").select("blk", "g1", "g2", "members", "least"), "whole")
    told = blocks.join(whole, ["blk", "g1", "g2"], "left").withColumn("whole", F.col("full") & F.col("members").isNotNull())
    told = written(told, "told")

    # Turns that stand for nodes: of one member of a whole group, of all members elsewhere.
    read = told.where(~F.col("whole") | (F.col("conv_id") == F.col("least")))
    read = written(read.select("conv_id", "blk", "whole", "members", "before", "p1", "p2", "g1", "g2"), "read")
    in_block = hashed.join(read, ["conv_id", "blk"])
    so_far = Window.partitionBy("conv_id", "blk").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = in_block.withColumns(
        {
            "k1": F.col("p1").bitwiseXOR(F.bit_xor("x1").over(so_far)),
            "k2": F.col("p2").bitwiseXOR(F.bit_xor("x2").over(so_far)),
            "to": F.col("before") + F.sum("size").over(so_far),
        }
    ).select(
        "conv_id", *NODE, F.col("k1").bitwiseXOR(F.col("x1")).alias("u1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("u2"),
        "size", "to", "whole", "blk", "g1", "g2", F.when(F.col("whole"), F.col("members")).otherwise(1).alias("weight"),
    )
    steps = written(steps, "steps")
    zero = F.lit(0).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("u1"), F.lit(None).cast("long").alias("u2"), F.lit(1).alias("weight"))
    counted = steps.select("conv_id", *NODE, "u1", "u2", "weight").unionByName(roots)
    nodes = written(
        counted.groupBy(*NODE).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("least"), F.first("u1").alias("u1"), F.first("u2").alias("u2")),
        "nodes",
    )

    # Where conversations end, and which of them stand for a childless node.
    finals = blocks.groupBy("conv_id").agg(F.sum("n").alias("depth"), F.max_by("g1", "blk").alias("k1"), F.max_by("g2", "blk").alias("k2"))
    finals = conversations.join(written(finals, "finals"), "conv_id", "left").select("conv_id", *[F.coalesce(name, zero).alias(name) for name in NODE])
    ends = written(_ends(finals), "ends")
    closed = nodes.select(*NODE, "least", "n_convs").join(ends, NODE)
    leaves = closed.where("n_ends = n_convs").select(F.col("least").alias("conv_id"), F.lit(1).cast("long").alias("leaf"))

    # How many code points each conversation shares with a smaller one.
    shared = told.where(F.col("whole") & (F.col("conv_id") != F.col("least"))).select("conv_id", "to")
    least = nodes.select(*NODE, "least")
    single = steps.where("not whole").select("conv_id", *NODE, "to")
    shared = shared.unionByName(single.join(least, NODE).where(F.col("least") < F.col("conv_id")).select("conv_id", "to"))
    shared = written(shared.groupBy("conv_id").agg(F.max("to").alias("shared")), "shared")
    weighed = conversations.join(shared, "conv_id", "left").join(leaves, "conv_id", "left")
    convs = written(weighed.select("conv_id", F.coalesce("shared", zero).alias("shared"), F.coalesce("leaf", zero).alias("leaf")), "weighed")

    # Sums over members, of whole groups first.
    of_whole = told.where("whole").select("conv_id", "blk", "g1", "g2").join(convs, "conv_id")
    of_whole = of_whole.groupBy("blk", "g1", "g2").agg(
        F.sum("leaf").alias("leaves"), (F.sum("shared") - F.min_by("shared", "conv_id")).alias("all_shared")
    )
    earlier = F.col("to") - F.col("size")
    inside = steps.where("whole").join(written(of_whole, "whole-sums"), ["blk", "g1", "g2"])
    inside = inside.select(*NODE, F.col("leaves").alias("n_leaves"), (F.col("all_shared") - (F.col("weight") - 1) * earlier).alias("saved_tokens"))
    alone = steps.where("not whole").select("conv_id", *NODE, earlier.alias("earlier"))
    alone = alone.unionByName(roots.select("conv_id", *NODE, zero.alias("earlier"))).join(convs, "conv_id")
    alone = alone.select(*NODE, F.col("leaf").alias("n_leaves"), F.greatest(zero, F.col("shared") - F.col("earlier")).alias("saved_tokens"))
    sums = written(inside.unionByName(alone).groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")), "sums")

    # Parents and children.
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("least").alias("parent_conv_id"))
    with_parent = nodes.join(written(parents, "parents"), ["depth", "u1", "u2"], "left").select(*NODE, "least", "n_convs", "parent_conv_id")
    return (
        written(with_parent, "with-parent")
        .join(sums, NODE)
        .join(written(children, "children"), NODE, "left")
        .join(ends.select(*NODE, "ends_sha256"), NODE, "left")
        .select(
            F.col("least").alias("conv_id"),
            "depth",
            "parent_conv_id",
            F.col("n_convs").cast("long").alias("n_convs"),
            F.coalesce("n_children", zero).alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
        )
    )
