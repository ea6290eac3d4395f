"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 7).

Texts are split into words by the tokenizer's pattern. The words of a batch that were not
met before are encoded together: their bytes lie as symbols in one flat array, and each
round finds the rank of every neighbouring pair by binary search over the sorted pair
keys, takes the lowest rank of each word, merges all its places at once, and closes the
gaps. Rounds end when no word has a pair that merges.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.session import ship

#: Parameter: the folder with the vocabulary files of the public tokenizers.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the word pattern of this byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Parameters: words that a task remembers with their ids (it forgets all beyond that),
#: the longest word it remembers, and the characters that are encoded together.
REMEMBERED, LONG, TOGETHER = 200_000, 64, 2_000_000
#: Pair ranks above all others: the pair doesn't merge.
NONE = np.iinfo(np.int64).max


class Encoder:
    """Byte-level BPE from a file of ranks: one `base64(token) rank` a line, ranks from 0."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.size = max(ranks.values()) + 1
        self.bytes = np.zeros(256, np.int64)
        for b in range(256):
            self.bytes[b] = ranks[bytes([b])]
        keys, merged = self._pairs(ranks)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], merged[order]
        self.known: dict[str, np.ndarray] = {}
        self.words = regex.compile(PATTERN)

    def _pairs(self, ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """For every way to split a token into two tokens, the pair's key and the token's id.

        A merge happens between two symbols whose concatenation is a token; its rank is the
        token's id, so every such split counts and not only the one that was learned.
        """
        keys, merged = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    merged.append(rank)
        return np.array(keys, np.int64), np.array(merged, np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray, inside: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(inside & (self.keys[at] == key), self.merged[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, all words in common rounds."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list[np.ndarray | None] = [None] * len(words)
        symbols, word = self.bytes[flat], np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            rank = np.full(len(symbols), NONE)
            rank[:-1] = self._rank(symbols[:-1], symbols[1:], word[:-1] == word[1:])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            done = best == NONE
            for s, n in zip(starts[done].tolist(), lengths[done].tolist()):
                out[word[s]] = symbols[s : s + n]
            hit = (rank == np.repeat(best, lengths)) & (rank != NONE)
            # Of overlapping places (a run of one pair, as in "aaa") every second one merges.
            at = np.flatnonzero(hit)
            if len(at):
                fresh = np.r_[True, np.diff(at) != 1]
                begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - begin) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = rank[at]
            keep = np.repeat(~done, lengths)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        return [x if x is not None else np.zeros(0, np.int64) for x in out]

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens are ordinary text."""
        split = [self.words.findall(t) for t in texts]
        known = self.known
        new = list({w for words in split for w in words if w not in known})
        fresh = dict(zip(new, self.merge([w.encode("utf-8", "surrogatepass") for w in new])))
        ids = [np.concatenate([fresh[w] if w in fresh else known[w] for w in words]) if words else np.zeros(0, np.int64) for words in split]
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
        known.update((w, v) for w, v in fresh.items() if len(w) <= LONG)
        return ids


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each Python worker."""
    return Encoder(path)


def _portions(texts: list[str]) -> Iterator[list[str]]:
    """Neighbouring texts of about TOGETHER characters; a longer text comes alone and whole."""
    own, size = [], 0
    for t in texts:
        if own and size + len(t) > TOGETHER:
            yield own
            own, size = [], 0
        own.append(t)
        size += len(t)
    if own:
        yield own


def encode_texts(df: DataFrame, key: str, text: str, *, tokenizers: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): one row per row of `df`, its text as ids without special tokens.

    Null and empty texts have an empty list. Texts are encoded whole, in the task that reads
    them; nothing is shuffled. Repeated rows stay repeated; other columns aren't read.
    """
    ship(df.sparkSession)
    path = f"{tokenizers}/{name}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            start = 0
            texts = b.column(1).to_pylist()
            for portion in _portions([t or "" for t in texts]):
                ids = enc.encode(portion)
                offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
                values = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(portion)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["k", "ids"])
                start += len(portion)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")


def token_counts(df: DataFrame, key: str, text: str, keep: list[str], **options) -> DataFrame:
    """(*keep, key, tokens): the number of ids of each text, computed in the same pass."""
    ship(df.sparkSession)
    path = f"{options.get('tokenizers', TOKENIZERS)}/{options.get('name', 'byte_bpe_50k')}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            sizes = [len(x) for portion in _portions([t or "" for t in b.column(0).to_pylist()]) for x in enc.encode(portion)]
            rest = [b.column(i) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(sizes, pa.int64())], names=[*b.schema.names[1:], "tokens"])

    chosen = df.select(F.col(text).cast("string").alias("_t"), *keep, key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[1:])
    return chosen.mapInArrow(run, f"{schema}, tokens long")
