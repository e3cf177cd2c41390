"""Periodic runs of words within a text: a sparse diagonal dynamic program over lags.

A diagonal is a lag q; its match length counts the consecutive words equal to the word q places
earlier. A diagonal that ends with enough matches is a run of period q. Only diagonals that an
earlier occurrence has made active are ever touched:

- Lags shorter than the least run: each word is compared with that many words before it.
- Longer lags, in classes [2k, 4k) for k = 6, 12, 24 ...: such a run matches over 2k words or more,
  so it holds a whole block of k words at a multiple of k. Each block's earlier occurrences within
  the class make lags active, and consecutive blocks on one lag add up its match length; the ends
  are then found word by word. A text of n words has at most 2n such events in a class, also where
  one word is repeated throughout.

Only windows that recur within their text go on to the next class, so ordinary text ends after
one sort. Every row is judged alone: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesengine.llm.common import mix64, slices

_ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2^64 / golden ratio
_STEP = 64  # words compared at a time where a diagonal ends
_NONE = np.zeros((0, 3), np.int64)


def _stretches(places: np.ndarray, step: int, lags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each series of ``places`` that go up by ``step`` (on one lag)."""
    new = np.ones(len(places), bool)
    new[1:] = np.diff(places) != step
    if lags is not None:
        new[1:] |= np.diff(lags) != 0
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(places)) - 1


def _near(code: np.ndarray, lag: int, least: int) -> np.ndarray:
    """Runs of one short lag."""
    same = np.flatnonzero(code[lag:] == code[:-lag])
    if not len(same):
        return _NONE
    first, last = _stretches(same, 1)
    start, matches = same[first], same[last] - same[first] + 1
    long = matches >= max(lag, least - lag)
    start, matches = start[long], matches[long]
    return np.stack([start, matches + lag, np.full(len(start), lag)], axis=1)


def _reach(code: np.ndarray, at: np.ndarray, lag: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``at`` on (way 1) or before ``at`` (way -1) equal those ``lag`` earlier."""
    out, going = np.zeros(len(at), np.int64), np.arange(len(at))
    steps = np.arange(_STEP) if way > 0 else -1 - np.arange(_STEP)
    while len(going):
        here = (at[going] + way * out[going])[:, None] + steps
        there = here - lag[going, None]
        inside = (there >= 0) & (here < len(code))
        here, there = np.clip(here, 0, len(code) - 1), np.clip(there, 0, len(code) - 1)
        same = inside & (code[here] == code[there])
        whole = same.all(axis=1)
        out[going] += np.where(whole, _STEP, np.argmin(same, axis=1))
        going = going[whole]
    return out


def _smallest(found: np.ndarray) -> np.ndarray:
    """Each stretch once, under its smallest lag; by start."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    return found[new]


def _known(found: np.ndarray, k: int, begin: np.ndarray, end: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Diagonals that lie in a found run whose period divides their lag: they end where it ends.

    Runs of at least 3k places and period up to k overlap in less than 2k, so of those that
    begin no later only the last can hold a diagonal's 3k places or more.
    """
    wide = found[(found[:, 1] >= 3 * k) & (found[:, 2] <= k)]
    if not len(wide):
        return np.zeros(len(lag), bool)
    i = np.searchsorted(wide[:, 0], begin - lag, side="right") - 1
    start, length, period = wide[np.maximum(i, 0)].T
    return (i >= 0) & (end <= start + length) & (lag % period == 0)


def _far(code: np.ndarray, k: int, least: int, found: np.ndarray) -> np.ndarray:
    """``found`` and the runs of lags from 2k on, a class of lags at a time."""
    n = len(code)
    if n < 4 * k:
        return found
    places = np.arange(n - k + 1)
    window = np.zeros(len(places), np.uint64)
    for j in range(k):
        window = mix64(window * _ODD + code[j : j + len(places)].astype(np.uint64) + np.uint64(1))
    while len(places):
        order = np.argsort(window, kind="stable")
        ranked = window[order]
        new = np.ones(len(ranked), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        again = ~new
        again[:-1] |= ~new[1:]  # the window stands elsewhere too
        order, group = order[again], (np.cumsum(new) - 1)[again]
        if not len(order):
            break
        at = places[order]
        slot = group * np.int64(n) + at  # ascending
        block = np.flatnonzero(at % k == 0)
        block = block[at[block] >= 2 * k]
        base = slot[block] - at[block]
        low = np.searchsorted(slot, base + np.maximum(at[block] - 4 * k + 1, 0))
        count = np.searchsorted(slot, base + at[block] - 2 * k, side="right") - low
        place = np.repeat(at[block], count)
        nth = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        lag = place - at[np.repeat(low, count) + nth]
        if len(place):
            by = np.lexsort((place, lag))
            place, lag = place[by], lag[by]
            first, last = _stretches(place, k, lag)
            lag, begin, end = lag[first], place[first], place[last] + k
            other = ~_known(found, k, begin, end, lag)
            lag, begin, end = lag[other], begin[other], end[other]
            begin = begin - _reach(code, begin, lag, -1)
            end = end + _reach(code, end, lag, 1)
            long = end - begin >= np.maximum(lag, least - lag)
            begin, end, lag = begin[long], end[long], lag[long]
            found = _smallest(np.concatenate([found, np.stack([begin - lag, end - begin + lag, lag], axis=1)]))
        keep = np.sort(order)
        places, window = places[keep], window[keep]
        other = np.searchsorted(places, places + k)
        both = (other < len(places)) & (places[np.minimum(other, len(places) - 1)] == places + k)
        window = mix64(window[both] * _ODD + window[other[both]])
        places, k = places[both], 2 * k
    return found


def find_runs(code: np.ndarray, least: int = 12) -> np.ndarray:
    """(start, length, period) of every run among ``code``, by start, then period.

    A run is a stretch with smallest period p, of at least max(``least``, 2p) places, that neither
    neighbour extends. The same stretch is found under every multiple of p that fits twice: the
    smallest lag stays. Windows are compared by 64-bit hashes, the runs then place by place.
    """
    k = max(1, least // 2)
    found = [_near(code, lag, least) for lag in range(1, min(2 * k, len(code)))]
    found = _far(code, k, least, _smallest(np.concatenate([_NONE, *found])))
    real = [np.array_equal(code[s + p : s + m], code[s : s + m - p]) for s, m, p in found]
    found = found[np.array(real, bool)]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _judged(texts: list[bytes | None], least: int) -> tuple[list[int], list[list[dict]], list[bytes]]:
    split = [(t or b"").split() for t in texts]
    # A word has a number of its own in each text, so that no diagonal joins two texts.
    codes, starts, used = [], [0], 0
    for w in split:
        number = dict(zip(set(w), range(used, used + len(w)), strict=False))
        used += len(number)
        codes.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
        starts.append(starts[-1] + len(w))
    begin = np.array(starts)
    found = find_runs(np.concatenate(codes), least)
    row = np.searchsorted(begin, found[:, 0], side="right") - 1
    cut = np.searchsorted(row, np.arange(len(texts) + 1))
    runs, kept = [], []
    for i, w in enumerate(split):
        mine = found[cut[i] : cut[i + 1]] - [starts[i], 0, 0]
        runs.append([{"start": s, "length": m, "period": p} for s, m, p in mine.tolist()])
        if len(mine):
            edge = np.zeros(len(w) + 1, np.int64)
            np.add.at(edge, mine[:, 0] + mine[:, 2], 1)
            np.add.at(edge, mine[:, 0] + mine[:, 1], -1)
            w = [w[j] for j in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
        kept.append(b" ".join(w))
    return [len(w) for w in split], runs, kept


def periodic_runs(df: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``df``: ``key``, ``n_words``, ``runs`` and ``collapsed``.

    Words are runs without white space (20, 09 to 0D). ``runs`` holds (start, length, period) of
    every stretch of words with that smallest period and at least max(``least``, 2 * period) words
    that no neighbour extends, by start, then period. ``collapsed`` is the text without the words
    that a run holds after its first period, joined by one space. Null and empty texts have no
    words, no runs and an empty ``collapsed``; repeated rows and null keys are rows like others;
    other columns are not read; an empty table gives no rows. A text is judged whole, in one task,
    with arrays of a few times its size.
    """
    kind = "array<struct<start:long,length:long,period:long>>"
    entry = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                n, runs, kept = _judged(part.column("_text").cast(pa.binary()).to_pylist(), least)
                cols = [part.column("_key"), pa.array(n, pa.int64()), pa.array(runs, entry), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, ["_key", "n_words", "runs", "collapsed"])

    slim = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    kept = slim.schema["_key"].dataType.simpleString()
    out = slim.mapInArrow(run, f"_key {kept}, n_words long, runs {kind}, collapsed string")
    return out.select(F.col("_key").alias(key), "n_words", "runs", "collapsed")
