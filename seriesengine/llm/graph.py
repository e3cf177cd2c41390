"""Connected components of undirected edges between long ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesengine.session import discard, materialize, tidy


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least_reachable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id`` and ``component`` from all edges: each vertex gets the least label of its neighbours and of its label's."""
    ends = [[x.column(c).to_numpy() for c in ("u", "v")] for x in batches if x.num_rows]
    if not ends:
        return
    u, v = (np.concatenate(x) for x in zip(*ends, strict=True))
    ids = np.sort(np.concatenate([u, v]))
    ids = ids[np.append(True, ids[1:] != ids[:-1])]
    u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
    label = np.arange(len(ids))
    while True:
        x, y = label[u], label[v]
        apart = x != y
        if not apart.any():
            break
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])


def components(edges: DataFrame, rounds: int = 60, small: int = 0) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) for every id on an edge (``a``, ``b``).

    Alternating large-star and small-star steps (Kiveris et al., 2014): each step is an
    aggregation by vertex and a join back to the edges, so a vertex with very many neighbours
    never has them gathered. Each round is written to the shared folder, which keeps the plan
    short and outlives executors, and the one before it is deleted. Loops, repeated edges and null ends are ignored; no edges give
    no rows. Up to ``small`` edges are done with in one task, of about 100 bytes an edge.
    """
    pairs = edges.selectExpr("cast(a as long) as a", "cast(b as long) as b").filter("a <> b")
    links = materialize(pairs.selectExpr("greatest(a, b) as u", "least(a, b) as v").distinct())
    seen = _state(links)
    if seen[0] <= small:
        return links.coalesce(1).mapInArrow(_least_reachable, "id long, component long")
    for _ in range(rounds):
        both = links.union(links.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, links = links, materialize(
            near.union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        )
        discard(last)
        now = _state(links)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no components after {rounds} rounds")
    members = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.union(roots)


def _open(postings: DataFrame, edges: DataFrame, small: int) -> DataFrame:
    """Postings with their component, under keys that still have more than one."""
    found = components(edges, small=small).toDF("id", "comp")
    labelled = materialize(postings.join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id")))
    mixed = labelled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y")
    out = materialize(labelled.join(mixed.select("key"), "key", "left_semi"))
    discard(labelled)
    return out


def confirmed_links(
    postings: DataFrame, sketches: DataFrame, near: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame], edges: DataFrame, star_rounds: int = 4, small: int = 0,
) -> DataFrame:
    """Verified edges (a, b), enough of them for the exact components.

    ``postings`` has (key, id, weight): ids that may be linked meet under a key; ``edges``, written and deleted here, are
    verified ones found otherwise. ``sketches`` has (id, columns that ``near`` reads) for the ids of postings;
    ``near("x", "y")`` is a cheap condition that every link meets, and ``verify`` keeps the linked ones of (a, b).
    ``small``: see ``components``. Each key's ids are compared
    with one hub of it, that of the largest weight and then others by chance: this merges
    groups of any size with a number of pairs that is linear in the postings. A hub has then met
    all of its key and leaves it, so a key with few ids is soon done with. Then, under keys
    that still hold several components, the pairs across components that are ``near`` are
    verified, so that no link between components is missed.
    Pairs inside a component can change nothing.
    """
    sketch = F.struct(*(c for c in sketches.columns if c != "id"))
    a = sketches.select(F.col("id").alias("a"), sketch.alias("x"))
    b = sketches.select(F.col("id").alias("b"), sketch.alias("y"))

    def links(pairs: DataFrame) -> DataFrame:
        return verify(pairs.join(a, "a").join(b, "b").filter(near("x", "y")).select("a", "b"))

    if postings.isEmpty():
        return edges
    labelled = _open(postings, edges, small)
    for turn in range(star_rounds):
        chance = F.xxhash64("id", F.lit(turn), F.pmod("key", F.lit(4)))
        order = F.struct(-F.col("weight"), "id") if turn == 0 else F.struct(chance, "id")
        hub = labelled.groupBy("key").agg(F.min_by(F.struct("id", "comp"), order).alias("hub"), F.count(F.lit(1)).alias("ids"))
        spokes = labelled.join(hub, "key").filter("comp <> hub.comp")
        pairs = spokes.selectExpr("least(id, hub.id) as a", "greatest(id, hub.id) as b").distinct()
        last, edges = edges, materialize(edges.union(links(pairs)).distinct())
        discard(last)
        # Components only grow, so a key that is done with stays so.
        others = labelled.join(hub.filter("ids > 2"), "key").filter("id <> hub.id")
        last, labelled = labelled, _open(others.select(*postings.columns), edges, small)
        discard(last)
        tidy(edges.sparkSession)
    left = labelled.join(sketches.select("id", sketch.alias("x")), "id").drop("weight")
    right = left.select("key", F.col("id").alias("id_b"), F.col("comp").alias("comp_b"), F.col("x").alias("y"))
    rest = (
        left.join(right, "key").filter((F.col("comp") < F.col("comp_b")) & near("x", "y"))
        .selectExpr("least(id, id_b) as a", "greatest(id, id_b) as b").distinct()
    )
    last, edges = edges, materialize(edges.union(verify(rest)))
    discard(last, labelled)
    return edges
