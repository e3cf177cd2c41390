"""Removal of byte strings that occur twice in a corpus, by a sparse, distributed suffix sort."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesengine.llm.common import flat_bytes, mix64, utf8_bytes
from seriesengine.session import discard, materialize

_PLACE = np.uint64((1 << 24) - 1)
_BASE = 0x5851F42D4C957F2D
_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Bytes handled at a time; the sort of packed places needs fewer than 2^24.
PIECE = 2_000_000
#: Distinct contexts of one anchor above which its suffixes are dealt to several buckets.
HOT_ANCHOR = 2_000


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


class Segments:
    """Cuts texts into runs of window starts that hang on one anchor.

    A window is ``length`` bytes. Its anchor is the ``core``-byte string inside it with the
    smallest hash, the last of equals. Both depend on the window's bytes alone, so equal windows
    have equal anchors at equal distances: only windows of equal anchors need be compared. A
    segment is a run of consecutive windows with one anchor; its bytes reach from its first
    window's start to its last window's end.
    """

    def __init__(self, length: int, core: int) -> None:
        self.length, self.core = length, core
        size = PIECE + length + 1
        self.power = _powers(_BASE, size)
        self.inverse = _powers(pow(_BASE, -1, 1 << 64), size)

    def of(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Anchor hash, content hash, first and last window start of every segment of ``data``,
        a piece of one or more texts; ``ends`` has for each byte the end of its text."""
        n, w = len(data), self.length - self.core + 1
        if n < self.length:
            return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODE[data] * self.power[:n], out=sums[1:])
        core = mix64((sums[self.core :] - sums[: -self.core]) * self.inverse[: n - self.core + 1])
        low = (core & ~_PLACE) | (_PLACE - np.arange(len(core), dtype=np.uint64))
        reach = 1
        while reach < w:  # least of `reach` neighbours, doubled until it spans a window
            step = min(reach, w - reach)
            low = np.minimum(low[:-step], low[step:])
            reach += step
        anchor = (_PLACE - (low & _PLACE)).astype(np.int64)
        start = np.flatnonzero(np.arange(len(anchor)) + self.length <= ends[: len(anchor)])
        if not len(start):
            return self.of(data[:0], ends[:0])
        anchor = anchor[start]
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(start) != 1)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [len(start)]]) - 1
        lo, hi = start[first], start[last]
        content = mix64((sums[hi + self.length] - sums[lo]) * self.inverse[lo] + (hi - lo).astype(np.uint64))
        return core[anchor[first]], content, lo, hi


def _pieces(at: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
    """(first byte, end, end of the window starts) of pieces of about PIECE bytes; pieces of a
    longer text overlap, so that each window is in exactly one."""
    a, total = 0, int(at[-1])
    while a < total:
        b = min(a + PIECE, total)
        row = int(np.searchsorted(at, b, side="right")) - 1
        if b < total and at[row] > a:
            b = int(at[row])  # between texts
            yield a, b, b
        else:
            yield a, min(b + length - 1, total), b
        a = b


def _cut(rows: DataFrame, length: int, core: int) -> DataFrame:
    """Segments (m, h, t, lo, hi) of all texts (t, _text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Segments(length, core)
        for batch in batches:
            data, at = flat_bytes(batch.column("_text"))
            text = np.asarray(batch.column("t"))
            for a, b, starts_end in _pieces(at, length):
                row = np.searchsorted(at, np.arange(a, b), side="right") - 1
                m, h, lo, hi = cutter.of(data[a:b], at[row + 1] - a)
                inside = lo < starts_end - a
                m, h, lo, hi = m[inside], h[inside], lo[inside], hi[inside]
                row, base = row[lo], at[row[lo]] - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.view(np.int64)), pa.array(h.view(np.int64)), pa.array(text[row]), pa.array(lo - base), pa.array(hi - base)],
                    ["m", "h", "t", "lo", "hi"],
                )

    return rows.mapInArrow(run, "m long, h long, t long, lo long, hi long")


def multikey_groups(data: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """For suffixes of ``data`` at ``start``: which share ``length`` leading bytes with another
    of the same ``group``; equal numbers above 0 mean equal suffixes, 0 means alone.

    A multikey sort with eight bytes for a key: suffixes are ordered by group and next key, and
    only those that still tie with a neighbour go on to the following key.
    """
    out = np.zeros(len(start), np.int64)
    live, tie = np.arange(len(start)), group
    for depth in range(0, length, 8):
        if not len(live):
            return out
        width = min(8, length - depth)
        key = np.zeros(len(live), np.uint64)
        for k in range(width):
            key = (key << np.uint64(8)) | data[start[live] + depth + k].astype(np.uint64)
        order = np.lexsort((key, tie))
        live, key, tie = live[order], key[order], tie[order]
        new = np.ones(len(live), bool)
        new[1:] = (key[1:] != key[:-1]) | (tie[1:] != tie[:-1])
        run = np.cumsum(new)
        many = np.bincount(run)[run] > 1
        live, tie = live[many], run[many]
    out[live] = tie
    return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _sorted_buckets(suffixes: DataFrame, length: int) -> DataFrame:
    """Sorts the suffixes of each bucket; rows (m, h, a, b, w): windows a to b of a segment stand
    twice (w null), or window a of a divided anchor, with the digest w for its other buckets."""

    def sort(rows: list[tuple]) -> Iterator[tuple]:
        size = np.array([len(c) for *_, c in rows])
        data = np.frombuffer(b"".join(c for *_, c in rows), np.uint8)
        windows = size - length + 1
        seg = np.repeat(np.arange(len(rows)), windows)
        base = np.concatenate([[0], np.cumsum(size)[:-1]])
        offset = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
        _, anchor = np.unique([m for m, *_ in rows], return_inverse=True)
        equal = multikey_groups(data, base[seg] + offset, anchor[seg], length)
        begin = np.cumsum(windows) - windows
        for i, (m, h, divided, content) in enumerate(rows):
            mine = equal[begin[i] : begin[i] + windows[i]] > 0
            for a, b in _runs(mine):
                yield m, h, a, b, None
            if divided:
                for a in range(windows[i]):
                    yield m, h, a, a, hashlib.blake2b(content[a : a + length], digest_size=16).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            found = list(zip(*sort(rows), strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(found, kinds, strict=True)], ["m", "h", "a", "b", "w"]
            )

        held, size, last = [], 0, None
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("m", "h", "part", "content")]
            for m, h, part, content in zip(*cols, strict=True):
                if size > 300_000 and (m, part) != last:
                    yield flush(held)
                    held, size = [], 0
                held.append((m, h, part >= 0, content))
                size, last = size + len(content), (m, part)
        if held:
            yield flush(held)

    return suffixes.mapInArrow(run, "m long, h long, a long, b long, w binary")


def _repeated_windows(contexts: DataFrame, length: int) -> DataFrame:
    """(m, h, a, b) for windows that stand in two different segments of one anchor.

    ``contexts`` has one row (m, h, content) for each distinct segment of anchors with several.
    Spark samples splitters and range-partitions them by anchor, the leading bytes that all
    suffixes to be compared have in common; each bucket is sorted by itself. An anchor with more
    than HOT_ANCHOR contexts is divided over buckets: its suffixes are then also compared
    across their boundaries, by digests that are combined before they move.
    """
    many = contexts.groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    parts = F.when(F.col("n") <= HOT_ANCHOR, F.lit(-1)).otherwise(
        F.pmod(F.col("h"), F.ceil(F.col("n") / (HOT_ANCHOR / 2)))
    )
    dealt = contexts.join(many, "m").withColumn("part", parts.cast("long"))
    ordered = dealt.select("m", "h", "part", "content").repartitionByRange("m", "part").sortWithinPartitions("m", "part")
    found = materialize(_sorted_buckets(ordered, length))
    across = found.filter("w is not null")
    twice = across.groupBy("m", "w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.filter("w is null").drop("w").union(
        across.join(twice, ["m", "w"], "left_semi").select("m", "h", "a", "b")
    )


def _kept(rows: DataFrame, length: int, kept: list[str]) -> DataFrame:
    """Adds n_removed, n_spans and kept_sha256 from the windows (``spans``) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("_text"), batch.column("spans"), strict=True):
                data = (text.as_py() or "").encode()
                removed, n, end, digest = 0, 0, 0, hashlib.sha256()
                for a, b in sorted((s["a"], s["b"] + length) for s in spans.as_py() or ()):
                    if n == 0 or a > end:
                        digest.update(data[end:a])
                        n, removed, end = n + 1, removed + b - a, b
                    elif b > end:
                        removed, end = removed + b - end, b
                digest.update(data[end:])
                out.append((removed, n, digest.hexdigest()))
            r, n, d = zip(*out, strict=True) if out else ((), (), ())
            cols = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(r, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.string())],
                [*kept, "n_removed", "n_spans", "kept_sha256"],
            )

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in kept)
    return rows.mapInArrow(run, f"{kinds}, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", length: int = 200, core: int = 100
) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else in
    the table, the same text included. Texts are UTF-8; null counts as empty; a text shorter
    than ``length`` keeps all; a repeated row repeats all its strings, so at ``length`` bytes or
    more nothing of it stays. Other columns are not read; an empty table gives no rows.

    Not every suffix can be moved: at 200 bytes each they are 200 times the text. So segments of
    about 50 windows (``Segments``) are counted by anchor. An anchor that stands once is done
    with; segments with equal bytes repeat as a whole; only different segments of one anchor are
    sorted suffix by suffix (``_repeated_windows``).
    """
    if not 8 <= core <= length:
        raise ValueError("core must be from 8 to length")
    docs = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("t"))
    segments = materialize(_cut(docs.filter(utf8_bytes(F.col("_text")) >= length), length, core))
    anchors = segments.groupBy("m").agg(
        F.count(F.lit(1)).alias("n"), (F.min("h") != F.max("h")).alias("several")
    )
    shared = materialize(segments.join(anchors.filter("n > 1").select("m", "several"), "m"))
    discard(segments)  # nearly all stand once

    by_text = shared.groupBy("t").agg(F.count(F.lit(1)).alias("_n")).select("t").withColumn("_has", F.lit(True))
    joined = docs.join(by_text, "t", "left").withColumn("n_bytes", utf8_bytes(F.col("_text")))
    has = F.col("_has").isNotNull()
    split = materialize(
        joined.select(
            "_key", "t", "n_bytes", F.when(has, F.col("_text")).alias("_text"),
            F.when(~has, F.sha2(F.coalesce(F.col("_text"), F.lit("")), 256)).alias("sha"),
        )
    )

    equal = shared.groupBy("m", "h").agg(
        F.count(F.lit(1)).alias("n"), F.first("several").alias("several"),
        F.min(F.struct("t", "lo", "hi")).alias("at"),
    )
    equal = materialize(equal)
    whole = equal.filter("n > 1").select("m", "h", F.lit(0).cast("long").alias("a"), F.expr("at.hi - at.lo as b"))
    one = equal.filter("several").select("m", "h", "at.*")
    content = F.substring(F.col("_text").cast("binary"), F.col("lo") + 1, F.col("hi") - F.col("lo") + length)
    contexts = (
        split.filter("sha is null").select("t", "_text").join(one, "t")
        .select("m", "h", content.alias("content")).groupBy("m", "h").agg(F.first("content").alias("content"))
    )
    contexts = materialize(contexts)
    twice = whole.union(_repeated_windows(contexts, length))
    discard(contexts)
    spans = shared.join(twice, ["m", "h"]).groupBy("t").agg(
        F.collect_set(F.struct((F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b"))).alias("spans")
    )
    touched = split.filter("sha is null").join(spans, "t", "left").select("_key", "n_bytes", "_text", "spans")
    done = _kept(touched, length, ["_key", "n_bytes"])
    clean = split.filter("sha is not null").select(
        "_key", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
        F.col("sha").alias("kept_sha256"),
    )
    return done.union(clean).withColumnRenamed("_key", key)
