"""Word-piece counts by a linear longest-match automaton.

The pieces form a trie. A node's failure link leads to the node for what is left of its string after the longest pieces
were taken off the front, and the node holds how many those are; so a word is read once, character by character, and its
greedy pieces are counted without being built.

A word is a run of letters and digits or one other character that isn't blank, with the word mark in front. A word that
greedy matching can't cover counts as one token, and as unknown. A null text counts as empty, with no words. Rows are
counted one by one: ties, repeated rows and other columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, prepare, table

#: The mark before a word in the vocabulary's pieces.
MARK = "▁"
#: Entries of a worker's memo of short words; a full memo starts anew.
MEMO = 500_000
MEMO_CHARS = 64
UNKNOWN = 0

_WORD = re.compile(r"[^\W_]+|[^\w\s]|_")


class Automaton:
    """children: by node and character; fail: the failure link, -1 for none; popped: pieces taken off on the way along it."""

    def __init__(self, pieces):
        self.children: dict[tuple[int, str], int] = {}
        ends = {0: False}
        parents: list[tuple[int, str]] = [(-1, "")]
        for piece in pieces:
            node = 0
            for c in piece:
                child = self.children.get((node, c))
                if child is None:
                    child = self.children[node, c] = len(parents)
                    parents.append((node, c))
                    ends[child] = False
                node = child
            if piece:
                ends[node] = True
        below: dict[int, list[int]] = {}
        for node, (parent, _) in enumerate(parents):
            below.setdefault(parent, []).append(node)
        self.fail = [-1] * len(parents)
        self.popped = [0] * len(parents)
        todo = deque(below.get(0, ()))
        while todo:
            node = todo.popleft()
            todo.extend(below.get(node, ()))
            if ends[node]:
                self.fail[node], self.popped[node] = 0, 1
                continue
            parent, c = parents[node]
            at, n = self.fail[parent], self.popped[parent]
            while at >= 0 and (at, c) not in self.children:
                n += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.children[at, c], n

    def count(self, word: str) -> int:
        """Pieces of a word by greedy longest match; UNKNOWN if it can't be covered."""
        children, fail, popped = self.children, self.fail, self.popped
        node = n = 0
        for c in word:
            while (child := children.get((node, c))) is None:
                if fail[node] < 0:
                    return UNKNOWN
                n += popped[node]
                node = fail[node]
            node = child
        while node:
            if fail[node] < 0:
                return UNKNOWN
            n += popped[node]
            node = fail[node]
        return n


class _Memo(dict):
    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        n = self.automaton.count(MARK + word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def read_pieces(path: str) -> list[str]:
    """The pieces of a sentencepiece model without its control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


_LOADED: dict[int, _Memo] = {}


def token_counts(docs: DataFrame, pieces, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words, n_tokens, n_unknown."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(tuple(pieces))
    name = hash(tuple(pieces))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = _Memo(Automaton(held.value))
        memo = _LOADED[name]
        for batch in batches:
            rows = []
            for t in batch["t"]:
                counts = list(map(memo.__getitem__, _WORD.findall(t or "")))
                unknown = counts.count(UNKNOWN)
                rows.append((len(counts), sum(counts) + unknown, unknown))
            out = pd.DataFrame(rows, columns=["n_words", "n_tokens", "n_unknown"])
            out.insert(0, "k", batch["k"].array)
            yield out

    counted = named(docs, key, text).mapInPandas(run, "k string, n_words long, n_tokens long, n_unknown long")
    return counted.select(F.col("k").cast(kind).alias(key), "n_words", "n_tokens", "n_unknown")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))


QUERIES = {"op5_token_counts": op5_token_counts}
