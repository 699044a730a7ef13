"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes form a linked list. Each adjacent pair that the vocabulary can merge waits in the bucket of its rank;
a bitmap with one bit per bucket, summarised by a smaller bitmap, gives the lowest filled bucket by two find-first-set
steps. Entries that an earlier merge outdated are skipped when they surface. A merge costs a constant number of such steps
and one push to a heap of positions, so a pre-token of a million bytes takes about a million steps.

A null text counts as empty and gives no ids. Each row is encoded alone: ties, repeated rows and other columns play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, prepare, table

#: Entries of each of the two generations of a worker's memo of short pre-tokens. Ids don't depend on it.
MEMO = 400_000
#: Pre-tokens beyond so many characters are encoded afresh each time.
MEMO_CHARS = 64


_BIT = [1 << i for i in range(256)]


class RankQueue:
    """Positions by rank: the lowest rank first and, of equal ranks, the lowest position.

    A word has 256 ranks' bits, and top has a bit for each word that isn't empty, so two find-first-set steps cover 65,536
    ranks. A bucket is a position, or a heap of them.
    """

    def __init__(self, ranks: int):
        self.buckets: dict[int, int | list[int]] = {}
        self.words = [0] * (ranks // 256 + 1)
        self.top = 0

    def push(self, rank: int, position: int) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = position
            word = rank >> 8
            if not self.words[word]:
                self.top |= 1 << word
            self.words[word] |= _BIT[rank & 255]
        elif type(held) is int:
            self.buckets[rank] = [held, position] if held < position else [position, held]
        else:
            heapq.heappush(held, position)

    def pop(self) -> tuple[int, int]:
        """A queue that holds something only: while top is not 0."""
        top = self.top
        word = (top & -top).bit_length() - 1
        bits = self.words[word]
        bit = bits & -bits
        rank = (word << 8) + bit.bit_length() - 1
        held = self.buckets[rank]
        if type(held) is int:
            del self.buckets[rank]
            self.words[word] = bits = bits ^ bit
            if not bits:
                self.top = top & (top - 1)
            return rank, held
        position = heapq.heappop(held)
        if len(held) == 1:
            self.buckets[rank] = held[0]
        return rank, position


class Bpe:
    """A vocabulary of byte strings with ranks; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.decimal = {i: str(i) for i in ranks.values()}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.any_text = regex.compile(pattern)
        self.latin_text = _latin(pattern)
        self.memo = _Memo(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [-1] * n  # the rank under which the pair that starts here waits; -1: none
        queue, push = self.queue, self.queue.push
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                waiting[i] = rank
                push(rank, i)
        while queue.top:
            rank, i = queue.pop()
            if waiting[i] != rank:
                continue
            gone = after[i]
            end = after[gone]
            after[i] = end
            waiting[gone] = -1
            waiting[i] = -1
            if end < n:
                before[end] = i
                new = ranks.get(piece[i : after[end]])
                if new is not None:
                    waiting[i] = new
                    push(new, i)
            if (left := before[i]) >= 0:
                new = ranks.get(piece[left:end])
                if new is None:
                    waiting[left] = -1
                elif waiting[left] != new:
                    waiting[left] = new
                    push(new, left)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str) -> list[int]:
        split = self.any_text if _BEYOND_LATIN.search(text) else self.latin_text
        return list(chain.from_iterable(map(self.memo.__getitem__, split.findall(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class _Memo(dict):
    """Ids of short pre-tokens. When MEMO new ones are in, they become the old ones; those used again come back from there."""

    def __init__(self, bpe: Bpe):
        self.bpe = bpe
        self.old: dict[str, tuple[int, ...]] = {}

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.old.get(piece)
        if ids is None:
            ids = tuple(self.bpe.merge(piece.encode()))
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def _latin(pattern: str) -> re.Pattern:
    """pattern for texts within U+0000 to U+024F, its property classes spelled out: the standard module is twice as fast."""
    own = {k: "".join(re.escape(chr(c)) for c in range(0x250) if regex.match(k, chr(c))) for k in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, i = "", False, 0
    while i < len(pattern):
        part = next((k for k in (*own, r"\S") if pattern.startswith(k, i)), pattern[i])
        inside = part == "[" or inside and part != "]"
        if part == r"\S":
            out += f"[^{own[r'\s']}]"
        elif part in own:
            out += own[part] if inside else f"[{own[part]}]"
        else:
            out += part
        i += len(part)
    return re.compile(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_LOADED: dict[int, Bpe] = {}


def shared_bpe(ranks, pattern: str) -> Bpe:
    """A worker's Bpe for a broadcast vocabulary: made once, so tasks share its memo."""
    if ranks.id not in _LOADED:
        _LOADED.clear()
        _LOADED[ranks.id] = Bpe(ranks.value, pattern)
    return _LOADED[ranks.id]


class Vocabulary:
    """A broadcast vocabulary under a name that workers know it by."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int]):
        self.id = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
        self._held = spark.sparkContext.broadcast(ranks)

    @property
    def value(self) -> dict[bytes, int]:
        return self._held.value


def bpe_encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, text: str = "text", key: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """key, ids (where asked for), n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the decoded bytes)."""
    spark = prepare(docs.sparkSession)
    vocabulary = Vocabulary(spark, read_ranks(path))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared_bpe(vocabulary, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            rows = []
            for text_ in batch["t"]:
                ids = bpe.encode(text_ or "")
                rows.append((*((ids,) if keep_ids else ()), len(ids), sha(",".join(map(bpe.decimal.__getitem__, ids)).encode()), sha(bpe.decode(ids))))
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "k", batch["k"].array)
            yield out

    names = [*(["ids"] if keep_ids else []), "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = "k string, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return named(docs, key, text).mapInPandas(run, schema).select(F.col("k").cast(kind).alias(key), *names)


def bpe_decode(rows: DataFrame, path: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """key and bytes, a binary column. Null ids decode to no bytes; an id outside the vocabulary is an error."""
    spark = prepare(rows.sparkSession)
    vocabulary = Vocabulary(spark, read_ranks(path))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared_bpe(vocabulary, public_tokenizers.PATTERN)
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"].array, "bytes": [bpe.decode([] if x is None else list(x)) for x in batch["t"]]})

    return named(rows, key, ids).mapInPandas(run, "k string, bytes binary").select(F.col("k").cast(kind).alias(key), "bytes")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), keep_ids=False)


QUERIES = {"op10_bpe": op10_bpe}
