"""Prefix trie of conversations by ROLLUP over positional turn columns (operator 12).

A turn is known by 128 bits of the SHA-256 of its role and text, so texts never leave the task that read them. Each conversation is cut into
blocks of ``WIDTH`` turns, one column a position; a block is keyed by the node that the turns before it lead to. One ROLLUP over key and columns
counts all prefixes of all blocks at once, and ``grouping_id`` tells how many turns of the block a row holds. A node is known by its depth and
128 bits, the exclusive or of a hash of each (position, turn) up to it, so the key of a later block needs no round of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, n_parts, written

#: Turns of a block; positions that a window may hold at once; ids of a range whose list is one row.
WIDTH, STRETCH, ID_RANGE = 8, 4_096, 4_096
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]
NODE = ["depth", "x1", "x2"]


def turn_hash(at: Column, turn: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn at a position."""
    return F.xxhash64(F.lit(1), at.cast("long"), turn), F.xxhash64(F.lit(2), turn, at.cast("long"))


def running(df: DataFrame, key: str, at: str, cols: list[str], total: Callable[[Column], Column], add: Callable[[Column, Column], Column]) -> DataFrame:
    """``df`` with ``_before_<col>``: ``total`` of a column over the rows of the key with a smaller ``at``. Windows hold ``STRETCH`` positions, or the totals of all stretches of a key."""
    cut = df.withColumn("_cut", F.floor(F.col(at) / STRETCH))
    earlier = Window.partitionBy(key).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, "_cut").agg(*[total(F.col(c)).alias(f"_sum_{c}") for c in cols])
    sums = sums.select(key, "_cut", *[F.coalesce(total(F.col(f"_sum_{c}")).over(earlier), F.lit(0)).alias(f"_sum_{c}") for c in cols])
    inside = Window.partitionBy(key, "_cut").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumns({f"_in_{c}": F.coalesce(total(F.col(c)).over(inside), F.lit(0)) for c in cols}).join(sums, [key, "_cut"])
    return own.withColumns({f"_before_{c}": add(F.col(f"_sum_{c}"), F.col(f"_in_{c}")) for c in cols}).drop("_cut", *[f"_in_{c}" for c in cols], *[f"_sum_{c}" for c in cols])


def numbered(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, t, n): turns numbered from 1 in order of ``turn``, null first, equal ones by their digest; t is the digest, n the code points of the text.

    Rows are dealt to ranges of (conversation, turn) and numbered inside their range, so a conversation of any length is many tasks.
    """
    r, x = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, x), 256), 1, 32))
    own = written(conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), digest.alias("t"), F.length(x).cast("long").alias("n")), "trie-turns")
    order = ["conv_id", "_turn", "t"]
    ranged = written(own.repartitionByRange(n_parts(own.sparkSession), *order).withColumn("_p", F.spark_partition_id()), "trie-ranged")
    w = Window.partitionBy("conv_id").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("conv_id", "_p").agg(F.count("*").alias("_n")).select("conv_id", "_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("conv_id", "_p").orderBy("_turn", "t"))
    out = written(ranged.withColumn("_i", place).join(before, ["conv_id", "_p"]).select("conv_id", (F.col("_before") + F.col("_i")).alias("pos"), "t", "n"), "trie-numbered")
    forget(own, ranged)
    return out


def rebuilt(conversations: DataFrame, *, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(turns ``conv_id, depth, t, n``; conversations ``conv_id, length``): every conversation c with its first h turns taken from conversation c - c % group, h = crc32(c) % most.

    If that one has fewer turns, all of them stand in place of the h; if it is absent, none. Rows without a conversation id belong to none and are left out; null
    roles and texts are empty. Rows that repeat are turns of their own. An empty table has no conversations. Other columns are not read.
    """
    turns = numbered(conversations)
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("_own"))
    convs = convs.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most)
    bases = convs.select(F.col("conv_id").alias("_base"), F.col("_own").alias("_has"))
    convs = convs.join(bases, "_base", "left").withColumn("_g", F.least("_h", F.coalesce("_has", F.lit(0)))).drop("_has")
    convs = written(convs.withColumn("length", F.col("_g") + F.greatest(F.lit(0), F.col("_own") - F.col("_h"))), "trie-convs")
    lent = turns.filter(F.col("pos") < most).select(F.col("conv_id").alias("_base"), F.col("pos").alias("depth"), "t", "n")
    first = convs.select("conv_id", "_base", "_h").join(lent, "_base").filter("depth <= _h").select("conv_id", "depth", "t", "n")
    rest = turns.join(convs.select("conv_id", "_h", "_g"), "conv_id").filter("pos > _h").select("conv_id", (F.col("_g") + F.col("pos") - F.col("_h")).alias("depth"), "t", "n")
    out = written(first.unionByName(rest), "trie-rebuilt")
    forget(turns)
    return out, convs.select("conv_id", "length")


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, _key struct of block and node, t1..): a row for each conversation and block; conversations without turns have an empty first block."""
    one, two = turn_hash(F.col("depth"), F.col("t"))
    cut = turns.select("conv_id", F.floor((F.col("depth") - 1) / WIDTH).alias("_block"), ((F.col("depth") - 1) % WIDTH).alias("_i"), F.struct("t", "n").alias("_t"), one.alias("x1"), two.alias("x2"))
    wide = cut.groupBy("conv_id", "_block").agg(*[F.max(F.when(F.col("_i") == i, F.col("_t"))).alias(c) for i, c in enumerate(TURNS)], F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    led = running(written(wide, "trie-wide"), "conv_id", "_block", ["x1", "x2"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    own = led.select("conv_id", F.struct("_block", F.col("_before_x1").alias("x1"), F.col("_before_x2").alias("x2")).alias("_key"), *TURNS)
    kind = dict(own.dtypes)
    bare = convs.filter("length = 0").select("conv_id", F.struct(F.lit(0).cast("long").alias("_block"), F.lit(0).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2")).alias("_key"), *[F.lit(None).cast(kind[c]).alias(c) for c in TURNS])
    return written(own.unionByName(bare), "trie-blocks")


def prefixes(rows: DataFrame, **sums: Column) -> DataFrame:
    """(depth, x1, x2, p1, p2, n, sums..) of every node: its own and its parent's bits and the length of its last text, by one ROLLUP over all blocks."""
    rolled = rows.rollup("_key", *TURNS).agg(F.grouping_id().alias("_gid"), *[c.alias(k) for k, c in sums.items()])
    level = F.lit(WIDTH) - F.bit_count("_gid")
    leveled = rolled.withColumn("_level", level.cast("long")).filter("_level >= 0")
    # turns that a group doesn't hold are null, as are those after the end of a conversation; only groups that hold a last turn are nodes, and the root
    last = reduce(lambda c, i: F.when(F.col("_level") == i, F.col(TURNS[i - 1])).otherwise(c), range(1, WIDTH + 1), F.lit(None))
    kept = leveled.withColumn("_last", last).filter("_last is not null or (_level = 0 and _key._block = 0)")
    at = F.col("_key._block") * WIDTH
    hashes = [turn_hash(at + i, F.col(f"{c}.t")) for i, c in enumerate(TURNS, 1)]
    up_to = lambda k, less: reduce(lambda x, i: x.bitwiseXOR(F.when(F.col("_level") - less >= i, hashes[i - 1][k]).otherwise(F.lit(0))), range(1, WIDTH + 1), F.col(f"_key.x{k + 1}"))
    return kept.select((at + F.col("_level")).alias("depth"), up_to(0, 0).alias("x1"), up_to(1, 0).alias("x2"), up_to(0, 1).alias("p1"), up_to(1, 1).alias("p2"), F.coalesce("_last.n", F.lit(0)).alias("n"), *sums)


def ends_hashes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends_sha256) of nodes where conversations end: SHA-256 of their ids in order, comma between them.

    Ids are listed by ranges of ``ID_RANGE``, and the lists of a node pass through the hash one by one: no task holds all ids of a node, though one task has to see
    them in order.
    """
    one, two = turn_hash(F.col("depth"), F.col("t"))
    whole = turns.select("conv_id", one.alias("x1"), two.alias("x2")).groupBy("conv_id").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    ended = convs.join(whole, "conv_id", "left").select(F.col("length").alias("depth"), F.coalesce("x1", F.lit(0)).alias("x1"), F.coalesce("x2", F.lit(0)).alias("x2"), "conv_id")
    listed = ended.groupBy(*NODE, F.floor(F.col("conv_id") / ID_RANGE).alias("_range")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("_ids"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h, out = None, None, []
        for pdf in batches:
            for *node, ids in zip(pdf["depth"], pdf["x1"], pdf["x2"], pdf["_ids"], strict=True):
                if node != now:
                    if h:
                        out.append((*now, h.hexdigest()))
                    now, h = node, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            yield pd.DataFrame(out, columns=[*NODE, "ends_sha256"])
            out = []
        if h:
            yield pd.DataFrame([(*now, h.hexdigest())], columns=[*NODE, "ends_sha256"])

    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "_range").select(*NODE, "_ids").mapInPandas(hashed, "depth long, x1 long, x2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns, from the root: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` and ``convs`` are those of :func:`rebuilt`. Members of a node are the conversations that begin with it. ``saved_tokens`` sums, over the
    subtree, (members - 1) x code points of the last text. The root has no parent and no text. Without a conversation there is no node.

    Subtree sums come from a second ROLLUP: every node belongs to its smallest member, whose nodes are the lower end of its path; what a
    conversation's nodes add up to is counted at each of its prefixes, less the part of the node's own smallest member above the node.
    """
    rows = blocks(turns, convs)
    nodes = written(prefixes(rows, n_convs=F.count("*"), conv_id=F.min("conv_id")), "trie-nodes")
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("_saved", (F.col("n_convs") - 1) * F.col("n"))
    nodes = written(running(written(nodes, "trie-counted"), "conv_id", "depth", ["_saved"], F.sum, lambda a, b: a + b), "trie-owned")
    owned = nodes.groupBy("conv_id").agg(F.sum("_saved").alias("_all"), F.max((F.col("n_children") == 0).cast("long")).alias("_leaf"))
    carried = rows.join(owned, "conv_id", "left").select("_key", *TURNS, F.coalesce("_all", F.lit(0)).alias("_all"), F.coalesce("_leaf", F.lit(0)).alias("_leaf"))
    # a conversation's nodes count once, at its first block, for the nodes of that block; deeper blocks carry them for their own nodes
    below = prefixes(carried, n_leaves=F.sum("_leaf"), _below=F.sum("_all")).select(*NODE, "n_leaves", "_below")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    full = nodes.join(below, NODE).join(ends_hashes(turns, convs), NODE, "left").join(parents, ["depth", "p1", "p2"], "left")
    none = F.sha2(F.lit("").cast("binary"), 256)
    out = full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("_below") - F.col("_before__saved")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"))
    return written(out, "trie")
