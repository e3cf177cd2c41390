"""Token counts of texts under a byte-level BPE vocabulary."""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriesengine.llm.common import slices, utf8_bytes

#: Fixed value: how byte-level BPE splits text before it merges. \s is spelt out, because the
#: two libraries' classes differ in the control characters 1C to 1F.
_S = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Piece counts that a worker remembers at most; beyond, they are computed again.
REMEMBERED = 400_000


def _plain_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1
    stands for itself, the other bytes follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def special_strings(path: str) -> list[str]:
    """The added tokens of a vocabulary file; inside a text each is one token of its own."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens", [])
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError("added tokens that take in their surroundings are not supported")
    return [t["content"] for t in added]


def whole_pieces(path: str) -> frozenset[str]:
    """Vocabulary strings that are proved to encode alone as exactly one token.

    A string counts if it is valid UTF-8, the split leaves it whole, and the merges, applied to
    it alone, end in its own id. A text's piece that equals it is then one token: BPE merges
    inside a piece and nowhere else. Made once, before any text is read.
    """
    tok = Tokenizer.from_file(path)
    back, split, found = _plain_bytes(), regex.compile(PIECES), []
    special = special_strings(path)
    for token in tok.get_vocab(with_added_tokens=False):
        try:
            text = bytes(back[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        m = split.match(text)
        if m and m.end() == len(text) and not any(s in text for s in special):
            found.append((text, token))
    encoded = tok.encode_batch([t for t, _ in found], add_special_tokens=False)
    return frozenset(
        text for (text, token), e in zip(found, encoded, strict=True) if e.ids == [tok.token_to_id(token)]
    )


class Counter:
    """Counts the tokens of texts: whole pieces by look-up, other pieces by the library's merges,
    once each while it remembers them."""

    def __init__(self, path: str, whole: frozenset[str]) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a worker for each core
        self.tok, self.whole = Tokenizer.from_file(path), whole
        self.known = dict.fromkeys(whole, 1)
        self.find = regex.compile(PIECES).findall
        special = sorted(special_strings(path), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def _parts(self, text: str) -> tuple[int, list[str]]:
        """Special tokens of a text, and the pieces between them."""
        if self.special is None or not self.special.search(text):
            return 0, self.find(text)
        parts = self.special.split(text)
        return len(parts) - 1, [p for part in parts for p in self.find(part)]

    def __call__(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        strange = [i for i, t in enumerate(texts) if t and not t.isascii() and _newly_assigned(t)]
        for i, e in zip(strange, self._encode([texts[i] for i in strange]), strict=True):
            out[i] = e
        left_out = set(strange)
        usual = [i for i, t in enumerate(texts) if t and i not in left_out]
        split = [self._parts(texts[i]) for i in usual]
        if len(self.known) > len(self.whole) + REMEMBERED:
            self.known = dict.fromkeys(self.whole, 1)
        rest = list(set().union(*(pieces for _, pieces in split)).difference(self.known))
        self.known.update(zip(rest, self._encode(rest), strict=True))
        tokens = self.known.__getitem__
        for i, (special, pieces) in zip(usual, split, strict=True):
            out[i] = special + sum(map(tokens, pieces))
        return out

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


def _newly_assigned(text: str) -> bool:
    """Whether a text has letters so new that the libraries' Unicode versions may differ on them."""
    return any(unicodedata.category(c) == "Cn" for c in set(text))


def count_tokens(
    df: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", limit: int = 512
) -> DataFrame:
    """``key``, ``n_bytes``, ``n_tokens`` and ``over_limit`` for every row.

    Token counts equal those of the ``tokenizers`` library for the vocabulary file at ``path``
    (which every executor must have there): no added special tokens, special strings inside a
    text counted as one token each. Null and empty texts have 0 bytes and tokens, repeated rows
    are counted each, other columns are not read, an empty table gives an empty result. There
    is no shuffle; a lost task is simply run again.
    """
    shared = df.sparkSession.sparkContext.broadcast(whole_pieces(path))  # a vocabulary's size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, shared.value)
        for batch in batches:
            for part in slices(batch, "_text", 4_000_000):
                n = counter(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column("_bytes"), pa.array(n, pa.int64())], ["_key", "_bytes", "_tokens"]
                )

    slim = df.select(F.col(key).alias("_key"), utf8_bytes(F.col(text)).alias("_bytes"), F.col(text).alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    counted = slim.mapInArrow(count, f"_key {kind}, _bytes long, _tokens long")
    return counted.select(
        F.col("_key").alias(key), F.col("_bytes").alias("n_bytes"), F.col("_tokens").alias("n_tokens"),
        (F.col("_tokens") > limit).alias("over_limit"),
    )
