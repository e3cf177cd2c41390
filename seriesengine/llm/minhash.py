"""Near-duplicate documents by MinHash: an inverted join on signature coordinates.

Sets are posted under coordinate-value pairs (prefix and skip filters), and the collisions of two
signatures are counted. A group of near copies may be of any size, and its pairs lie around the
threshold, so they are not all compared. Each key has a reference, a set near the middle, and each
of its sets is compared with that. Where this leaves a key with several components, only
differences count: let d(x) be the elements in which x differs from the reference. If d(x) and d(y)
have none in common, x and y differ by |d(x)| + |d(y)|, and are linked only if both are
linked to the reference. So a link between components shows in a shared element of the (short)
differences, in so many that a prefix of the rarest tells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesengine.llm.common import flat_bytes, mix64, slices
from seriesengine.llm.graph import components
from seriesengine.session import discard, materialize

#: Coordinates of a signature.
COORDINATES = 64
#: Chance that a pair right at the threshold has fewer agreeing coordinates than are asked for.
MISS = 1e-7
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio, as in SplitMix64
_BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_SEEDS = mix64(np.arange(1000, 1000 + COORDINATES, dtype=np.uint64) * _GOLDEN)


def least_matches(coordinates: int, percent: int) -> int:
    """The match threshold: agreeing coordinates are binomial with the similarity, and a linked
    pair has fewer than this with a chance of at most MISS."""
    p, chance, t = percent / 100, 0.0, 0
    while True:
        chance += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
        if chance > MISS:
            return t
        t += 1


def shingle_hashes(column: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each row's begin and end.

    Words are runs without white space (20, 09 to 0D), with A to Z lowered. A shingle is
    ``n_words`` words; a text with fewer is one shingle; a text without words has none. A word's
    hash sums its bytes' codes times powers of an odd number, so all words of the batch are
    hashed by array operations.
    """
    data, at = flat_bytes(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    lower = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    space = (lower == 32) | ((lower >= 9) & (lower <= 13))
    first = ~space
    first[1:] &= space[:-1]
    starts = at[:-1][at[:-1] < len(data)]
    first[starts] |= ~space[starts]
    word_at = np.flatnonzero(first)
    if not len(word_at):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    number = np.cumsum(first) - 1  # the word that each byte is in
    inside = np.arange(len(data)) - word_at[np.maximum(number, 0)]  # place in the word
    power = np.ones(int(inside.max()) + 2, np.uint64)
    power[1:] = np.uint64(0x5851F42D4C957F2D)
    power = np.cumprod(power)
    code = np.where(space, np.uint64(0), _BYTE_CODE[lower] * power[np.maximum(inside, 0)])
    word = mix64(np.add.reduceat(code, word_at))

    row_of = np.searchsorted(at, word_at, side="right") - 1
    count = np.bincount(row_of, minlength=len(at) - 1)
    begin = np.concatenate([[0], np.cumsum(count)])
    sets = np.where(count >= n_words, count - n_words + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(sets)), sets)
    base = np.concatenate([[0], np.cumsum(sets)])
    place = begin[row] + np.arange(len(row)) - base[row]
    short = np.minimum(count, n_words)[row]
    shingle = np.zeros(len(row), np.uint64)
    for k in range(n_words):
        use = k < short
        shingle[use] = mix64(shingle[use] * _GOLDEN + word[place[use] + k] + np.uint64(1))
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[new], shingle[new]
    return shingle, np.searchsorted(row, np.arange(len(sets) + 1))


def _signatures(shingles: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row with shingles: 64 coordinates of 32 bits, and a 128-bit digest of the set."""
    full = np.flatnonzero(at[1:] > at[:-1])
    begin = at[:-1][full]
    sig = np.empty((len(full), COORDINATES), np.uint32)
    for k, seed in enumerate(_SEEDS):
        sig[:, k] = (np.minimum.reduceat(mix64(shingles ^ seed), begin) >> np.uint64(32)).astype(np.uint32)
    digest = np.empty((len(full), 2), np.uint64)
    for k in range(2):
        digest[:, k] = np.add.reduceat(mix64(mix64(shingles + _SEEDS[k]) * _GOLDEN), begin)
    return sig, digest


def with_signatures(df: DataFrame, text: str, n_words: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``_n`` (size of the shingle set), ``_d1``, ``_d2`` (digest of the
    set, null if empty) and ``_packed``, the signature as 64 unsigned integers in binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                shingles, at = shingle_hashes(part.column("_text"), n_words)
                size = np.diff(at)
                full = np.flatnonzero(size)
                d = np.zeros((len(size), 2), np.uint64)
                packed = [None] * len(size)
                if len(full):
                    sig, digest = _signatures(shingles, at)
                    d[full] = digest
                    for i, s in zip(full, sig, strict=True):
                        packed[i] = s.astype(">u4").tobytes()
                none = size == 0
                cols = [part.column(c) for c in kept] + [
                    pa.array(size, pa.int64()),
                    pa.array(d[:, 0].view(np.int64), mask=none),
                    pa.array(d[:, 1].view(np.int64), mask=none),
                    pa.array(packed, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names)

    kept = [f"_{i}" for i in range(len(keep))]
    names = [*kept, "_n", "_d1", "_d2", "_packed"]
    slim = df.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), F.col(text).alias("_text"))
    kinds = ", ".join(f"{k} {slim.schema[k].dataType.simpleString()}" for k in kept)
    out = slim.mapInArrow(run, f"{kinds}, _n long, _d1 long, _d2 long, _packed binary")
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)), *names[len(kept) :])


def _coordinate(packed: Column, k: int) -> Column:
    return F.substring(packed, 4 * k + 1, 4)


def _collisions(a: str, b: str) -> Column:
    """How many coordinates of two signatures agree."""
    same = lambda n, k: n + (F.substring(a, 4 * k + 1, F.lit(4)) == F.substring(b, 4 * k + 1, F.lit(4))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.lit(COORDINATES - 1)), F.lit(0), same)


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """(id, keys, weight): each set under its rarest coordinate-value pairs.

    Of 64 coordinates at least ``matches`` agree in a pair that matters, so two such sets meet
    under one of the 64 - matches + 1 pairs of each that come first in a common order, here the
    rarest (prefix filter). A pair that one set alone has links nothing: it takes up room in the
    prefix and is not posted, and a set with fewer than ``matches`` shared pairs is skipped
    altogether. ``weight`` says how common a set's pairs are: the hub of a group is near its middle.
    """
    keys = F.array(*(F.xxhash64(F.lit(k), _coordinate(F.col("packed"), k)) for k in range(COORDINATES)))
    posted = classes.select("id", F.explode(keys).alias("key"))
    shared = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    common = posted.join(shared, "key").groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("n", "key"))).alias("common"),  # 64 at most
        F.sum("n").alias("weight"),
    )
    rare = F.slice("common", 1, F.greatest(F.lit(0), F.size("common") - (matches - 1)))
    return common.filter(F.size("common") >= matches).select("id", rare["key"].alias("keys"), "weight")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets satisfy 100 * intersection >= percent * union."""
    a, b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(a, "a").join(b, "b")
    inter = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - inter
    return both.filter(100 * inter >= percent * union).select("a", "b")


def _references(posted: DataFrame) -> DataFrame:
    """(id, ref): the references of the keys of each set, but itself.

    A key's hub is its set with the most common pairs; the key's reference is the best hub that
    this hub meets under its own keys, so the many keys of a group come to few references.
    """
    postings = posted.select("id", "weight", F.explode("keys").alias("key"))
    rank = lambda w, i: F.struct(F.col(w).alias("w"), (-F.col(i)).alias("i"))
    hubs = materialize(
        postings.groupBy("key").agg(F.max_by("id", rank("weight", "id")).alias("hub"), F.max("weight").alias("top"), F.count(F.lit(1)).alias("ids"))
        .filter("ids > 1").drop("ids")
    )
    met = postings.join(hubs, "key")
    best = met.groupBy("id").agg(F.max_by("hub", rank("top", "hub")).alias("ref"))
    of_key = hubs.join(best.withColumnRenamed("id", "hub"), "hub").select("key", "ref")
    out = materialize(postings.join(of_key, "key").filter("id <> ref").select("id", "ref").distinct())
    discard(hubs)
    return out


def _differences(open_members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each member with the elements in which it differs from its reference, whether it is linked
    to that, and how many of the differences, the rarest first, must be looked at.

    For a linked pair of two components, of which at least one, x, is not linked to the
    reference r, with p = ``percent`` / 100 and c = (1 - p) / (1 + p):
    |d(x) & d(y)| >= (|d(x)| + |d(y)| - c (|x| + |y|)) / 2. As |d(x)| > c (|x| + |r|), this is at least
    (|d(y)| + c (|r| - |y|)) / 2 whatever x is: ``short`` is the prefix of y. And as the shared elements
    are at most |d(y)| many, and |y| <= |x| / p, it is at least |d(x)| - (1 - p) |x| / p: ``long`` is the prefix of x.
    """
    own = sets.select("id", F.col("set").alias("own"))
    theirs = sets.select(F.col("id").alias("ref"), F.col("set").alias("theirs"))
    both = open_members.join(own, "id").join(theirs, "ref")
    apart = F.concat(F.array_except("own", "theirs"), F.array_except("theirs", "own"))
    less, more = 100 - percent, 100 + percent
    told = both.select("id", "ref", "comp", F.size("own").alias("n"), F.size("theirs").alias("m"), apart.alias("d"))
    k = F.size("d")
    shared = F.greatest(F.lit(1), F.ceil((more * k + less * (F.col("m") - F.col("n"))) / (2 * more)))
    fewest = F.greatest(F.lit(1), F.ceil((percent * k - less * F.col("n")) / percent))
    linked = more * k <= less * (F.col("n") + F.col("m"))
    return (
        told.withColumn("short", k - shared + 1)
        .withColumn("long", F.when(~linked, F.greatest(F.col("short"), k - fewest + 1)))
        .filter("d <> array()")
    )


def _across(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of different components that share an element of their differences' prefixes.

    An element that one member alone has takes up room in the prefix and links nothing. At the
    first element that two share, both must have as many left as they need to share in all.
    """
    each = members.select("ref", "id", F.explode("d").alias("t"))
    often = each.groupBy("ref", "t").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    common = each.join(often, ["ref", "t"]).groupBy("ref", "id").agg(
        F.sort_array(F.collect_list(F.struct("often", "t"))).alias("common")  # as many as a set has
    )
    k = F.size("d")
    alone = k - F.size("common")
    posted = members.join(common, ["ref", "id"]).withColumns({"k": k, "left": k - alone})

    def side(length: str, mark: str) -> DataFrame:
        prefix = F.slice("common", 1, F.greatest(F.lit(0), F.col(length) - alone).cast("int"))["t"]
        named = [F.col(c).alias(f"{c}{mark}") for c in ("id", "comp", "n", "k", "left")]
        return posted.filter(F.col(length).isNotNull()).select("ref", *named, F.posexplode(prefix).alias(f"at{mark}", "t"))

    less, more = 100 - percent, 100 + percent
    needed = more * (F.col("kx") + F.col("ky")) - less * (F.col("nx") + F.col("ny"))  # 2 * more times what is shared
    left = F.least(F.col("leftx") - F.col("atx"), F.col("lefty") - F.col("aty"))
    # All in the join itself, so that no row is made of a pair that cannot be.
    x, y = side("long", "x"), side("short", "y").withColumnsRenamed({"ref": "refy", "t": "ty"})
    on = (F.col("ref") == F.col("refy")) & (F.col("t") == F.col("ty")) & (F.col("compx") != F.col("compy")) & (2 * more * left >= needed)
    return x.join(y, on).select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b")).distinct()


def linked_sets(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Verified links (a, b) between different sets, enough of them for the exact components.

    ``classes`` has one row (id, packed) for each distinct set; ``sets_of(ids)`` gives (id, set).
    Two linked sets share a key, but for a chance of MISS, and so a reference. Pairs with it are
    linear in the postings; pairs across components are those that ``_across`` finds.
    """
    matches = least_matches(COORDINATES, percent)
    posted = materialize(_postings(classes, matches))
    sets = materialize(sets_of(posted.select("id")))
    members = _references(posted)
    a, b = classes.toDF("id", "x"), classes.toDF("ref", "y")
    close = members.join(a, "id").join(b, "ref").filter(_collisions("x", "y") >= matches).select(F.col("id").alias("a"), F.col("ref").alias("b"))
    near = materialize(_verified(close, sets, percent))
    found = materialize(components(near).toDF("id", "comp"))
    of_ref = found.toDF("ref", "comp_ref")
    placed = members.join(found, "id", "left").join(of_ref, "ref", "left").select(
        "id", "ref", F.coalesce("comp", "id").alias("comp"), F.coalesce("comp_ref", "ref").alias("comp_ref")
    )
    placed = materialize(placed)
    mixed = placed.filter("comp <> comp_ref").select("ref").distinct()
    apart = materialize(_differences(placed.join(mixed, "ref", "left_semi"), sets, percent))
    far = materialize(_verified(_across(apart, percent), sets, percent))
    discard(posted, sets, members, found, placed, apart)
    return near.union(far)


def _grouped(df: DataFrame, key: str, text: str, n_words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their sets' digests, and for each different set (``_d1``, ``_d2``) its group
    ``comp``, smallest key ``id`` and ``first`` place (keys before null, then text hash)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    placed = df.withColumns({"_id": F.col(key).cast("long"), "_t": F.xxhash64(text)})
    docs = materialize(with_signatures(placed, text, n_words, [key, "_id", "_t"]))
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_t")
    groups = docs.filter("_n > 0").groupBy("_d1", "_d2").agg(
        F.min("_id").alias("id"), F.min(place).alias("first"), F.first("_packed").alias("packed")
    )
    # Sets are compared under numbers of their own: a key may stand on several rows.
    classes = materialize(groups.withColumn("number", F.col("_d1").bitwiseXOR(F.shiftleft("_d2", 1))))
    of_class = classes.select(F.col("number").alias("id"), "packed")

    def sets_of(ids: DataFrame) -> DataFrame:
        wanted = classes.join(ids.toDF("number"), "number", "left_semi").select("first._id", "first._t", "number", "_d1", "_d2")
        rows = df.select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_t"), F.col(text).alias("_text"))
        return _sets(rows, wanted, n_words)

    links = linked_sets(of_class, sets_of, percent)
    comp = components(links).toDF("number", "comp")
    return docs, classes.join(comp, "number", "left").withColumn("comp", F.coalesce("comp", "number"))


def near_duplicates(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", n_words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their sets of
    ``n_words``-word shingles (but see ``least_matches``). ``component_id`` is the smallest key
    reachable over links, ``kept`` whether that is the row's own. Null and empty texts have no
    shingles and are alone; equal sets are one class; rows repeated under one key share its
    component; null keys take part, and get the component of their group (null if it has no
    other key). Other columns of ``df`` are not read. An empty table gives no rows.
    """
    docs, named = _grouped(df, key, text, n_words, percent)
    smallest = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_class = named.join(smallest, "comp").select("_d1", "_d2", "component_id")
    out = docs.join(by_class, ["_d1", "_d2"], "left")
    component = F.when(F.col("_n") > 0, F.col("component_id")).otherwise(F.col("_id"))
    return out.select(
        F.col(key), F.col("_n").alias("n_shingles"), component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )


def _sets(rows: DataFrame, wanted: DataFrame, n_words: int) -> DataFrame:
    """(id, set) with the whole shingle set of one document of each wanted class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                shingles, at = shingle_hashes(part.column("_text"), n_words)
                digest = np.zeros((part.num_rows, 2), np.uint64)
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    for k in range(2):
                        digest[full, k] = np.add.reduceat(
                            mix64(mix64(shingles + _SEEDS[k]) * _GOLDEN), at[:-1][full]
                        )
                lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(shingles.view(np.int64)))
                d = digest.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("number"), pa.array(d[:, 0]), pa.array(d[:, 1]), part.column("_d1"), part.column("_d2"),
                     lists.cast(pa.list_(pa.int64()))],
                    ["id", "x1", "x2", "_d1", "_d2", "set"],
                )

    # One document carries the set of its class; its key may be null or stand on several texts.
    on = rows["_id"].eqNullSafe(wanted["_id"]) & (rows["_t"] == wanted["_t"])
    texts = rows.join(wanted, on).select("_text", "number", "_d1", "_d2")
    made = texts.mapInArrow(run, "id long, x1 long, x2 long, _d1 long, _d2 long, set array<long>")
    return made.filter("x1 = _d1 AND x2 = _d2").dropDuplicates(["id"]).select("id", "set")


def drop_near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", n_words: int = 5, percent: int = 80
) -> DataFrame:
    """The rows of ``docs``, with all columns, of which one document of each group stays.

    It is the one with the smallest key, of several texts under that key the one of the smallest
    hash; of equal rows, one. Null keys come last. Documents without shingles all stay.
    """
    _, named = _grouped(docs, key, text, n_words, percent)
    # A key as two columns that are never null: the join on them leaves equal rows together.
    parts = lambda c: (F.coalesce(c, F.lit(0)).alias("_k"), c.isNull().alias("_none"))
    keepers = named.groupBy("comp").agg(F.min("first").alias("first")).select(*parts(F.col("first._id")), F.col("first._t").alias("_t"))
    has_words = F.coalesce(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    whole = docs.filter(has_words).select(F.struct(*docs.columns).alias("_row"), *parts(F.col(key).cast("long")), F.xxhash64(text).alias("_t"))
    kept = whole.join(keepers, ["_k", "_none", "_t"], "left_semi").dropDuplicates(["_k", "_none", "_t"])
    return kept.select("_row.*").unionByName(docs.filter(~has_words))
