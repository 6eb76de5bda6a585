"""Conversation prefix trie: which conversations begin alike, and what sharing their turns saves.

Turns are numbered in ranges of (conv_id, turn), so that one long conversation
is spread over tasks: each range counts its own turns, and the counts of the
ranges before are added.  The same way a prefix gets its key: the sum of
hashes of (depth, role, text), in four lanes of 32 bits, which is as good as a
hash of the sequence because each turn is hashed with its place.

Partitions combine the nodes of their rows into partial tries (node, parent,
members, smallest member, longest member), which hash-keyed merges bring
together, first by node and salt, then by node.  The rollup goes bottom-up
along every conversation at once: each knows the bytes of its turns from any
depth to its end, and the smallest member of a node answers for it, so the
bytes of the distinct nodes below a node are the sum over its members of what
each answers for there.  So its rounds do not grow with the depth of the trie.
The members that end at a node are sorted by ranges, joined to pieces of text
there, and the pieces of a node are hashed one after the other.

Defined cases: a null role or text counts as empty; null turns come first, and
turns with equal numbers go by role, then by text; repeated rows are turns each;
a row with a null conv_id takes no part; a conversation whose base is absent
keeps what it has after its first turns, and without any turn it is a member of
the root only; texts may be of any length, for only their hashes and sizes move;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import Workspace, read

#: A conversation c takes over the first crc32(c) % HEADS turns of its base, conversation c - c % GROUP.
HEADS, GROUP = 9, 5
#: Parts of a node in the first merge; children from which a parent's row is copied for the join; bytes of a piece that is hashed.
SALTS, MANY, PIECE = 16, 1000, 1 << 16
LANES = tuple(f"s{i}" for i in range(4))
ROOT = "root"


def placed(ws: Workspace, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, pos, code, bytes) by their place from 0, and (conv_id, part) of all of them.

    Rows are dealt and sorted by range; a row's place is its distance from
    its range's first row of the conversation and the rows of the ranges before.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = table.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    code = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))  # the role's length parts it from the text
    sorted_rows = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = ws.table("sorted", sorted_rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), code.alias("code"), F.octet_length("text").cast("long").alias("bytes")))
    parts = rows.groupBy("conv_id", "part").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    parts = ws.table("parts", parts.withColumn("before", F.coalesce(before, F.lit(0))))
    out = rows.join(parts, ["conv_id", "part"]).select("conv_id", "part", (F.col("seq") - F.col("first") + F.col("before")).alias("pos"), "code", "bytes")
    return ws.table("turns", out), parts.select("conv_id", "part")


def rebuilt(ws: Workspace, table: DataFrame, heads: int = HEADS, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, depth, code, bytes) of the rebuilt conversations, and all conv_ids."""
    turns, parts = placed(ws, table)
    firsts = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1)).groupBy(F.col("conv_id").alias("base"))
    firsts = firsts.agg(F.sort_array(F.collect_list(F.struct("pos", "code", "bytes"))).alias("heads"))  # heads - 1 turns at most
    convs = parts.select("conv_id").distinct().withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")})
    taken = F.when(F.col("heads").isNotNull(), F.slice("heads", 1, F.col("h")))
    convs = ws.table("convs", convs.join(firsts, "base", "left").select("conv_id", "h", F.coalesce(taken, F.slice(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("code"), F.lit(0).cast("long").alias("bytes"))), 1, 0)).alias("heads")))
    shift = parts.join(convs.select("conv_id", "h", F.size("heads").alias("taken")), "conv_id")
    own = turns.join(shift, ["conv_id", "part"]).filter("pos >= h").select("conv_id", "part", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), "code", "bytes")
    lent = convs.select("conv_id", F.lit(-1).alias("part"), F.explode("heads").alias("t")).select("conv_id", "part", (F.col("t.pos") + 1).alias("depth"), "t.code", "t.bytes")
    return own.unionByName(lent), convs.select("conv_id")


def members(ws: Workspace, rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, part, depth, node, parent, bytes, rest, length): a row for each conversation and node on its path, the root too.

    ``rest``: bytes of the conversation's turns from this depth on; ``length``: its turns.
    """
    place = F.md5(F.concat_ws(":", F.col("depth").cast("string"), "code").cast("binary"))
    rows = rows.select("conv_id", "part", "depth", "bytes", F.lit(1).cast("long").alias("turns"), *[F.conv(F.substring(place, 1 + 8 * i, 8), 16, 10).cast("long").alias(s) for i, s in enumerate(LANES)])
    rows, sums = ws.table("hashed", rows), [*LANES, "bytes", "turns"]
    parts = rows.groupBy("conv_id", "part").agg(*[F.sum(c).alias(c) for c in sums])
    whole = Window.partitionBy("conv_id")  # a row for each range of a conversation
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ws.table("sums", parts.select("conv_id", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums], *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("bytes", "turns")]))
    here = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a range's rows at most
    upto = {c: F.col(f"{c}_here") + F.col(f"{c}_before") for c in sums}
    key = lambda depth, lanes: F.md5(F.concat_ws(":", depth.cast("string"), *[x.cast("string") for x in lanes]).cast("binary"))
    out = rows.select("*", *[F.sum(c).over(here).alias(f"{c}_here") for c in sums]).join(parts, ["conv_id", "part"])
    node, parent = key(F.col("depth"), [upto[s] for s in LANES]), key(F.col("depth") - 1, [upto[s] - F.col(s) for s in LANES])
    out = out.select("conv_id", "part", "depth", node.alias("node"), F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(parent).alias("parent"), "bytes", (F.col("bytes_all") - upto["bytes"] + F.col("bytes")).alias("rest"), F.col("turns_all").alias("length"))
    totals = parts.groupBy("conv_id").agg(F.min("bytes_all").alias("rest"), F.min("turns_all").alias("length"))
    zero = F.lit(0).cast("long")
    roots = convs.join(totals, "conv_id", "left").select("conv_id", F.lit(-2).alias("part"), zero.alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("parent"), zero.alias("bytes"), F.coalesce("rest", zero).alias("rest"), F.coalesce("length", zero).alias("length"))
    return ws.table("members", out.unionByName(roots))


def merged(ws: Workspace, rows: DataFrame) -> DataFrame:
    """The trie's nodes (node, parent, depth, bytes, first, n_convs, longest) from partial tries; ``first``: the smallest member and its rest."""
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))
    part = rows.groupBy("node", salt.alias("salt")).agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.min(F.struct("conv_id", "rest")).alias("first"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("longest"))
    whole = part.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("bytes").alias("bytes"), F.min("first").alias("first"), F.sum("n_convs").alias("n_convs"), F.max("longest").alias("longest"))
    return ws.table("nodes", whole)


def rolled_up(ws: Workspace, rows: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, n_leaves, saved_tokens): sums over each node's subtree."""
    parts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).drop("n").join(owners, "conv_id", "left")
    answers = F.when(F.col("top").isNull(), F.lit(0)).when(F.col("depth") >= F.col("top"), F.col("rest")).otherwise(F.col("top_rest"))
    known = rows.join(parts, ["conv_id", "part"]).select("node", "conv_id", (F.col("rest") - answers).alias("saved"), F.coalesce(F.col("leaf").cast("long"), F.lit(0)).alias("leaf"))
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))
    sums = known.groupBy("node", salt.alias("salt")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    return sums.groupBy("node").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def pieces(batches):
    """Sorted (node, conv_id) as texts of joined numbers, (node, first, text), each up to PIECE bytes or so."""
    node, first, held, size = None, 0, [], 0
    row = lambda: pa.RecordBatch.from_pydict({"node": [node], "first": pa.array([first], pa.int64()), "text": [",".join(held)]})
    for batch in batches:
        for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and (n != node or size > PIECE):
                yield row()
                held, size = [], 0
            if not held:
                node, first = n, c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield row()


def hashes(batches):
    """(node, ends_sha256) from the sorted pieces of each node."""
    node, state = None, None
    out: list[tuple[str, str]] = []
    for batch in batches:
        for n, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if n == node:
                state.update(b"," + text.encode())
                continue
            if state is not None:
                out.append((node, state.hexdigest()))
            node, state = n, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_pydict({"node": pa.array([a for a, _ in out], pa.string()), "ends_sha256": pa.array([b for _, b in out], pa.string())})
        out = []
    if state is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})


def ends(rows: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end.

    A hash over a list can only be made in its order, so a node's pieces meet
    in one task, which holds one of them; they are sorted and joined before.
    """
    last = rows.filter("depth = length").select("node", "conv_id")
    text = last.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node string, first long, text string")
    return text.repartition("node").sortWithinPartitions("node", "first").mapInArrow(hashes, "node string, ends_sha256 string")


def parents_of(ws: Workspace, nodes: DataFrame, kids: DataFrame, owners: DataFrame) -> DataFrame:
    """(node, parent_conv_id) of all nodes but the root.

    A conversation that is a node's smallest member is that of the node's
    children on its path, so only the first node of each such run is joined to
    its parent, whose row is copied where it has very many children.
    """
    runs = nodes.filter("parent IS NOT NULL").join(owners.select(F.col("conv_id").alias("owner"), "top"), F.col("first.conv_id") == F.col("owner"))
    runs = ws.table("runs", runs.select("node", "parent", "owner", (F.col("depth") == F.col("top")).alias("begins"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt")))
    known = nodes.select(F.col("node").alias("parent"), F.col("first.conv_id").alias("parent_conv_id")).join(kids, "parent")
    wide = known.filter(F.col("n_children") > MANY).select("parent", "parent_conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    met = ws.table("met", runs.filter("begins").join(wide, ["parent", "salt"], "left").select("node", "parent", "parent_conv_id"))
    rest = met.filter("parent_conv_id IS NULL").drop("parent_conv_id").join(known.filter(F.col("n_children") <= MANY), "parent")
    out = [runs.filter("NOT begins").select("node", F.col("owner").alias("parent_conv_id")), met.filter("parent_conv_id IS NOT NULL").select("node", "parent_conv_id"), rest.select("node", "parent_conv_id")]
    return out[0].unionByName(out[1]).unionByName(out[2])


def prefix_trie(spark: SparkSession, table: DataFrame, heads: int = HEADS, group: int = GROUP) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ws = Workspace(spark, "trie")
    rows = members(ws, *rebuilt(ws, table, heads, group))
    nodes = merged(ws, rows)
    # the first depth at which a conversation is the smallest member; a node whose longest member ends there has no child
    owners = nodes.groupBy(F.col("first.conv_id").alias("conv_id")).agg(F.min(F.struct("depth", F.col("first.rest").alias("rest"))).alias("t"), F.max(F.col("longest") == F.col("depth")).alias("leaf"))
    owners = ws.table("owners", owners.select("conv_id", F.col("t.depth").alias("top"), F.col("t.rest").alias("top_rest"), "leaf"))
    kids = ws.table("kids", nodes.filter("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")))
    out = nodes.join(rolled_up(ws, rows, owners), "node").join(ends(rows), "node", "left").join(parents_of(ws, nodes, kids, owners), "node", "left").join(kids.withColumnRenamed("parent", "node"), "node", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("first.conv_id").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark, read(spark, sf_dir, "conversations"))
