"""The trie of shared conversation prefixes, by van Emde Boas recursion over depth.

Depths are cut in half again and again: depth d lies in the middle of the segment that begins at
d - low(d), low(d) being the lowest bit of d. So all cuts of one recursion level are made at the
same time, and a trie of depth D needs log2(D) rounds.

Down (naming): the prefix cut off at depth d is named by the name at the beginning of its segment
and the digest of the turns in between, itself put together from the digests of the halves. Names
are 128 bits, so equal prefixes get equal names wherever they are computed, and nothing is
shuffled before a node's members are counted.

Up (grafting): all lower tries of a round are finished at once, and the total of each of their
roots, at depth d, is added to its low(d) ancestors in the upper trie. Every node takes part once,
so what is shuffled is at most log2(D)/2 times the nodes, also for a single long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesengine.llm.common import mix64
from seriesengine.session import materialize

#: Members' ids hashed as one block of text.
IDS_PER_BLOCK = 4096
#: Turns whose names are made at a time; a longer conversation is done by itself.
TURNS_AT_ONCE = 100_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D))  # fixed values: odd constants of SplitMix64 and PCG


def conversations_in_order(
    df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, turns): each conversation's turns in order as (a, b, chars), digest and code points.

    Ordered by turn, null first; rows of one turn by their digests. Null role and text are empty.
    Rows without a conversation id belong to none and are left out. Texts stay where they are:
    a conversation's row holds 24 bytes a turn.
    """
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = df.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv"),
        F.struct(
            F.col(turn).isNotNull().alias("known"), F.col(turn).alias("at"),
            F.xxhash64(*said).alias("a"), F.xxhash64(F.lit(1), *said).alias("b"), F.length(said[1]).alias("chars"),
        ).alias("t"),
    )
    ordered = F.array_sort(F.collect_list("t"))
    slim = F.transform(ordered, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), t["chars"].alias("chars")))
    return rows.groupBy("conv").agg(slim.alias("turns"))


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """One digest of two, 128 bits each."""
    out = np.empty_like(x)
    for i in (0, 1):
        out[:, i] = mix64(mix64(x[:, i] * _ODD[i] + x[:, 1 - i] + np.uint64(i + 1)) * _ODD[i] + mix64(y[:, i] + _ODD[1 - i]) + y[:, 1 - i])
    return out


def _named(length: np.ndarray, turns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Depths 0 to length of each sequence in one row each: depth, name, index of the sequence."""
    first = np.concatenate([[0], np.cumsum(length + 1)])
    owner = np.repeat(np.arange(len(length)), length + 1)
    depth = np.arange(first[-1]) - first[owner]
    part = np.zeros((first[-1], 2), np.uint64)
    part[depth > 0] = turns
    top = int(length.max(initial=0)).bit_length()
    for k in range(1, top):  # digests of ever longer segments that end at multiples of 2^k
        at = np.flatnonzero((depth > 0) & (depth % (1 << k) == 0))
        part[at] = _join(part[at - (1 << (k - 1))], part[at])
    low = depth & -depth
    name = np.zeros_like(part)
    for k in reversed(range(top)):  # all cuts of one recursion level
        at = np.flatnonzero(low == 1 << k)
        name[at] = _join(name[at - (1 << k)], part[at])
    return depth, name, owner


_MEMBERS = (
    "a long, b long, depth int, conv long, length int, chars long, up_a array<long>, up_b array<long>, pa long, pb long"
)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation and depth: the node's name, its parent's, and the names of its
    low(depth) ancestors in the upper trie that it is grafted to."""
    for batch in batches:
        size = pc.list_value_length(batch.column("turns")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        cuts = [0, *(np.flatnonzero(np.diff((np.cumsum(size) - size) // TURNS_AT_ONCE)) + 1), batch.num_rows]
        for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
            if begin == end:
                continue
            part, length = batch.slice(begin, end - begin), size[begin:end] - 1
            flat = part.column("turns").flatten()
            turns = np.stack([flat.field(i).to_numpy().view(np.uint64) for i in (0, 1)], axis=1)
            depth, name, owner = _named(length, turns)
            chars = np.zeros(len(depth), np.int64)
            chars[depth > 0] = flat.field(2).to_numpy()
            low = depth & -depth
            edge = np.concatenate([[0], np.cumsum(low)])
            above = np.arange(edge[-1]) - np.repeat(edge[:-1], low) + np.repeat(np.arange(len(depth)) - low, low)
            signed, parent = name.view(np.int64), np.maximum(np.arange(len(depth)) - 1, 0)
            ups = [pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(signed[above, i])) for i in (0, 1)]
            cols = [
                pa.array(signed[:, 0]), pa.array(signed[:, 1]), pa.array(depth, pa.int32()),
                part.column("conv").take(pa.array(owner)), pa.array(length[owner], pa.int32()), pa.array(chars),
                *ups, pa.array(signed[parent, 0]), pa.array(signed[parent, 1]),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "depth", "conv", "length", "chars", "up_a", "up_b", "pa", "pb"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, conv) in order to (a, b, first, ids): ids joined by commas, a block at a time."""
    now, ids = None, []

    def block() -> pa.RecordBatch:
        (a, b), text = now, ",".join(map(str, ids))
        return pa.RecordBatch.from_pydict({"a": pa.array([a]), "b": pa.array([b]), "first": pa.array([ids[0]]), "ids": [text]})

    for batch in batches:
        for a, b, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and ((a, b) != now or len(ids) == IDS_PER_BLOCK):
                yield block()
                ids = []
            now = (a, b)
            ids.append(conv)
    if ids:
        yield block()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order to (a, b, ends): the SHA-256 of a node's blocks, joined by commas."""
    now, sha = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([now[0]]), "b": pa.array([now[1]]), "ends": [sha.hexdigest()]})

    for batch in batches:
        a, b, ids = (batch.column(c).to_pylist() for c in ("a", "b", "ids"))
        for key, text in zip(zip(a, b, strict=True), ids, strict=True):
            if key != now:
                if now is not None:
                    yield done()
                now, sha = key, hashlib.sha256(text.encode())
            else:
                sha.update(f",{text}".encode())
    if now is not None:
        yield done()


def _ends(members: DataFrame) -> DataFrame:
    """(a, b, ends) for each node at which conversations end.

    The ids of one node, however many, are joined to blocks in range partitions, which divide
    them; a node's blocks are then hashed one after the other, as SHA-256 demands, and never
    held together.
    """
    last = members.filter("depth = length").select("a", "b", "conv")
    blocks = last.repartitionByRange("a", "b", "conv").sortWithinPartitions("a", "b", "conv")
    blocks = blocks.mapInArrow(_blocks, "a long, b long, first long, ids string")
    by_node = blocks.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return by_node.mapInArrow(_hashed, "a long, b long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the sequences in (conv, turns), see ``conversations_in_order``.

    ``conv_id`` (smallest conversation that begins with the prefix), ``depth``, ``parent_conv_id``
    (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes in the subtree,
    itself included), ``saved_tokens`` (over the subtree, (n_convs - 1) times the code points of
    each node's last text) and ``ends_sha256`` (of the ids of conversations that end there,
    ascending, joined by commas). ``conv`` must not repeat. Conversations without turns end at the
    root; no conversations give no rows. Two prefixes are told apart by 128-bit digests. A
    conversation's digests are held in one task, those of different ones never together.
    """
    members = materialize(conversations.select("conv", "turns").mapInArrow(_members, _MEMBERS))
    once = ("chars", "up_a", "up_b", "pa", "pb")  # the same for all members of a node
    nodes = materialize(
        members.groupBy("a", "b", "depth")
        .agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("length").alias("longest"), *(F.first(c).alias(c) for c in once))
        .withColumn("leaves", (F.col("longest") == F.col("depth")).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
    )
    root = nodes.agg(F.max("depth").alias("deepest"), F.min("conv_id").alias("conv_id")).first()
    parts = [nodes.select("a", "b", "depth", "leaves", "saved")]
    for k in range((root["deepest"] or 0).bit_length()):
        lower_roots = F.col("depth").bitwiseAND(-F.col("depth")) == 1 << k
        whole = reduce(DataFrame.unionByName, parts).filter(lower_roots)
        totals = whole.groupBy("a", "b").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        ups = nodes.filter(lower_roots).select("a", "b", "depth", F.posexplode(F.arrays_zip("up_a", "up_b")).alias("i", "up"))
        grafted = totals.join(ups, ["a", "b"]).select(
            F.col("up.up_a").alias("a"), F.col("up.up_b").alias("b"), (F.col("depth") - (1 << k) + F.col("i")).alias("depth"), "leaves", "saved"
        )
        parts.append(
            materialize(grafted.groupBy("a", "b", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
        )
    # Everything known of a node meets in one aggregation by its name.
    own = nodes.select("a", "b", "depth", "leaves", "saved", "conv_id", "n_convs", "pa", "pb")
    children = nodes.filter("depth > 0").groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("children")).toDF("a", "b", "children")
    below = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [own, children, _ends(members), *parts[1:]])
    totals = materialize(
        below.groupBy("a", "b").agg(
            F.max("depth").alias("depth"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
            F.coalesce(F.sum("children"), F.lit(0)).alias("n_children"),
            *(F.max(c).alias(c) for c in ("conv_id", "n_convs", "pa", "pb", "ends")),
        )
    )
    # Children of the root, and the root, need no join; other nodes may have very many children
    # too, but only the side of the children repeats them, which adaptive execution divides.
    shallow = totals.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(root["conv_id"])).cast("long"))
    parents = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    deep = totals.filter("depth > 1").join(parents, ["pa", "pb"])
    return shallow.unionByName(deep).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
