"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items and texts are lower-cased (A-Z) and cut into words of digits, a-z and characters beyond ASCII. The automaton holds
every run of an item's words; a document's words are streamed through it, and at each word it gives the length of the
longest run that ends there and stands in an item. From that follow the occurrences of windows: runs of `window` words of
an item, or a whole item that has fewer.

Words that stand in no item, and pairs of words that stand in none, break every run. They are found for whole texts with
arrays of hashes, so only what is left between them is streamed, with words compared as bytes.

Items are dealt to shards of a bounded number of words; a task builds a shard's automaton, and documents pass several
shards at once. A longer item is dealt out in parts that overlap by a window less a word, which lose no window. More
shards than one pass holds take more passes, whose findings meet by the SHA-256 of the text.

A null or empty text, or one without words, has no words and no hits; an item without words has no windows. Items with
one id count as one; an item without id marks words but is neither counted nor named. Repeated rows each give a row; an
empty table gives none, and without items nothing is hit. Other columns, whatever their names, play no part.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, spool, table
from .scan import running

#: Words of a window.
WINDOW = 10
#: Words of a shard, which bound its automaton, and shards that a pass over the documents holds.
SHARD_WORDS, SHARDS = 40_000, 4
#: clean(): runs of so many words go, and documents go of which a greater share is hit.
LONGEST, COVERAGE = 13, 0.5

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_BASE = 0x9E3779B97F4A7C15
_PART = 1 << 17


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


_POWERS: list[np.ndarray] = []


def _hashed(part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(part)
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = _powers(max(n, _PART))
    inside = np.zeros(n + 2, dtype=np.int8)
    inside[1:-1] = _WORD[part]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[0][:n], out=sums[1:])
    h = (sums[end] - sums[start]) * _POWERS[1][start]
    return start, end, h ^ (h >> np.uint64(31))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word of lower-cased bytes. Long texts are read in parts that end between words."""
    whole = np.frombuffer(data, dtype=np.uint8)
    if len(whole) <= _PART:
        return _hashed(whole)
    out, at = [], 0
    while at < len(whole):
        size = _PART
        while True:
            stop = min(at + size, len(whole))
            gaps = np.flatnonzero(~_WORD[whole[at:stop]])
            if stop == len(whole) or len(gaps):
                break
            size *= 2
        if stop < len(whole):
            stop = at + int(gaps[-1]) + 1
        start, end, h = _hashed(whole[at:stop])
        out.append((start + at, end + at, h))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def item_words(text: str | None) -> list[bytes]:
    data = _lowered(text)
    start, end, _ = words(data)
    return [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class Automaton:
    """Suffix automaton of several sequences of small ints: state 0 is the empty run, link leads to the longest shorter suffix elsewhere."""

    def __init__(self, sequences: list[list[int]], width: int):
        self.width, self.next, self.link, self.length = width, {}, [-1], [0]
        edges: list[dict[int, int]] = [{}]
        for sequence in sequences:
            last = 0
            for w in sequence:
                last = self._add(edges, last, w)
        self.next = {s * width + w: t for s, out in enumerate(edges) for w, t in out.items()}

    def _state(self, edges, length: int, out: dict[int, int], link: int) -> int:
        edges.append(out)
        self.length.append(length)
        self.link.append(link)
        return len(edges) - 1

    def _split(self, edges, p: int, w: int) -> int:
        """The state of p's run with w appended, parted from longer runs that shared it."""
        q, length = edges[p][w], self.length[p] + 1
        if self.length[q] == length:
            return q
        twin = self._state(edges, length, dict(edges[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and edges[p].get(w) == q:
            edges[p][w] = twin
            p = self.link[p]
        return twin

    def _add(self, edges, last: int, w: int) -> int:
        if w in edges[last]:
            return self._split(edges, last, w)
        new, p = self._state(edges, self.length[last] + 1, {}, -1), last
        while p >= 0 and w not in edges[p]:
            edges[p][w] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(edges, p, w)
        return new

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """After each id, the state and the length of the longest run that ends there."""
        state = length = 0
        step, link, longest, width = self.next, self.link, self.length, self.width
        for w in ids:
            to = step.get(state * width + w)
            while to is None and state:
                state = link[state]
                length = longest[state]
                to = step.get(state * width + w)
            state, length = (to, length + 1) if to is not None else (0, 0)
            yield state, length


class Shard:
    """Windows of some items (id and words; items of at least `window` words may be parts). found() gives their occurrences in a text."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        vocabulary = sorted({w for _, ws in items for w in ws})
        self.ids = {w: i for i, w in enumerate(vocabulary)}
        self.window, width = window, len(vocabulary) + 1
        hashes = np.array([int(words(w)[2][0]) for w in vocabulary], dtype=np.uint64)
        self.hashes = np.unique(hashes)
        sequences = [[self.ids[w] for w in ws] for _, ws in items]
        pairs = [self._pairs(np.searchsorted(self.hashes, hashes[s])) for s in sequences if len(s) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        self.shortest = min([window, *(len(s) for s in sequences)])
        self.automaton = Automaton(sequences, width)
        # the state of each window, and which items have it: names by place in self.names
        self.names = sorted({n for n, _ in items if n is not None})
        place = {n: i for i, n in enumerate(self.names)}
        holders: dict[tuple[int, int], set[int]] = {}
        for (name, _), s in zip(items, sequences, strict=True):
            size = min(window, len(s))
            for at, (state, length) in enumerate(self.automaton.stream(s), 1):
                if at >= size:
                    held = holders.setdefault((self._of(state, size), size), set())
                    held |= set() if name is None else {place[name]}
        self.holders = {k: tuple(v) for k, v in holders.items()}
        self.short: dict[int, list[int]] = {}  # sizes of the whole short items that are suffixes of a state's runs, ascending
        for state, size in self.holders:
            if size < window:
                self.short.setdefault(state, []).append(size)
        self._memo: dict[int, tuple[tuple[int, int], ...]] = {}

    def _pairs(self, known: np.ndarray) -> np.ndarray:
        return known[:-1] * np.int64(len(self.hashes)) + known[1:]

    def _of(self, state: int, size: int) -> int:
        """The state of the last size words of a state's runs."""
        a = self.automaton
        while a.length[a.link[state]] >= size:
            state = a.link[state]
        return state

    def _below(self, state: int) -> tuple[tuple[int, int], ...]:
        """Size and state of the short items that end with a state's longest run."""
        if state not in self._memo:
            out, s = [], state
            while s > 0 and self.short:
                out += [(size, s) for size in self.short.get(s, ())]
                s = self.automaton.link[s]
            self._memo[state] = tuple(sorted(out))
        return self._memo[state]

    def found(self, data: bytes, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of hit words (first, last + 1; they may overlap) and places of the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        held: set[int] = set()
        n = len(hashes)
        if n < self.shortest or not len(self.hashes):
            return spans, held
        place = np.searchsorted(self.hashes, hashes)
        place[place == len(self.hashes)] = 0
        known = self.hashes[place] == hashes
        together = np.zeros(n + 1, dtype=bool)  # whether word i goes on from word i - 1
        if len(self.pairs):
            both = np.flatnonzero(known[1:] & known[:-1])
            key = place[both] * np.int64(len(self.hashes)) + place[both + 1]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            together[both[self.pairs[at] == key] + 1] = True
        first = np.flatnonzero(known & ~together[:-1])
        stop = np.flatnonzero(known & ~together[1:]) + 1
        enough = stop - first >= self.shortest
        for a, b in zip(first[enough].tolist(), stop[enough].tolist(), strict=True):
            ids = [self.ids.get(data[x:y], len(self.ids)) for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)]
            self._stream(a, ids, spans, held)
        return spans, held

    def _stream(self, a: int, ids: list[int], spans: list[tuple[int, int]], held: set[int]) -> None:
        window = self.window
        seen: set[int] = set()
        for at, (state, length) in enumerate(self.automaton.stream(ids), a + 1):
            if length >= window:
                if spans and spans[-1][1] == at - 1 and spans[-1][1] - spans[-1][0] >= window:
                    spans[-1] = (spans[-1][0], at)
                else:
                    spans.append((at - window, at))
                if state not in seen:
                    seen.add(state)
                    held.update(self.holders.get((self._of(state, window), window), ()))
            if self.short and length:
                for size, owner in self._below(state):
                    if size > length:
                        break
                    spans.append((at - size, at))
                    held.update(self.holders[owner, size])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans sorted and joined where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


class Found(NamedTuple):
    """Results of one text: spans of hit words, as words and as bytes of the text, and item ids."""

    n_words: int
    spans: list[tuple[int, int, int, int]]
    items: list[str]


def search(text: str | None, shards: list[Shard]) -> Found:
    data = _lowered(text)
    start, end, hashes = words(data)
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for shard in shards:
        more, held = shard.found(data, start, end, hashes)
        spans += more
        items |= {shard.names[i] for i in held}
    return Found(len(start), [(a, b, int(start[a]), int(end[b - 1])) for a, b in merged(spans)], sorted(items))


def _parts(bench: DataFrame, text: str, item: str, window: int, most: int) -> DataFrame:
    """k, ws (words, joined by a space) and own (their number) of items, the long ones in parts that overlap by a window less a word."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t in zip(b["k"], b["t"], strict=True):
                ws = item_words(t)
                for a in range(0, max(1, len(ws) - window + 1), most - window + 1) if ws else ():
                    rows.append((k, b" ".join(ws[a : a + most]).decode("utf-8", "surrogatepass"), min(most, len(ws) - a)))
            yield pd.DataFrame(rows, columns=["k", "ws", "own"])

    return named(bench, item, text).mapInPandas(cut, "k string, ws string, own long").distinct()


def build(bench: DataFrame, text: str = "text", item: str = "item_id", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """shard, automaton: pickled, each of at most 5/4 of shard_words words. One task builds one shard."""
    most = max(window, shard_words // 4)
    parts = _parts(bench, text, item, window, most).withColumns({"all": F.lit(0).cast("long"), "h": F.xxhash64("k", "ws"), "upto": F.col("own")})
    dealt = running(parts, "all", ["h", "ws"], keep=("k", "ws", "own"), sums=("upto",))

    def made(rows: pd.DataFrame) -> pd.DataFrame:
        items = [(None if k is None or k != k else k, ws.encode("utf-8", "surrogatepass").split(b" ")) for k, ws in zip(rows["k"], rows["ws"], strict=True)]
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "automaton": [pickle.dumps(Shard(items, window))]})

    shard = F.floor((F.col("upto") - F.col("own")) / shard_words).alias("shard")
    return spool(dealt.select("k", "ws", shard).groupBy("shard").applyInPandas(made, "shard long, automaton binary"))


SPANS = "array<struct<first:long,last:long,start:long,end:long>>"


def _pass(docs: DataFrame, held, only_hits: bool) -> DataFrame:
    """k, sha (of the text), n_words, spans, items of each row, or of those with hits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards = held.value
        for b in batches:
            rows = []
            for k, sha, t in zip(b["k"], b["sha"], b["t"], strict=True):
                found = search(t, shards)
                if found.spans or not only_hits:
                    rows.append((k, sha, found.n_words, [dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in found.spans], found.items))
            yield pd.DataFrame(rows, columns=["k", "sha", "n_words", "spans", "items"])

    return docs.select("k", "sha", "t").mapInPandas(run, f"k string, sha binary, n_words long, spans {SPANS}, items array<string>")


def _joined(column: pd.Series) -> pd.Series:
    """Spans of several passes, overlapping ones joined."""
    out = []
    for spans in column:
        rows: list[dict] = []
        for s in sorted((dict(s) for s in spans), key=lambda s: s["first"]):
            if rows and s["first"] <= rows[-1]["last"]:
                if s["last"] > rows[-1]["last"]:
                    rows[-1] |= {"last": s["last"], "end": s["end"]}
            else:
                rows.append(s)
        out.append(rows)
    return pd.Series(out)


def hits(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW, item_text: str = "text", item: str = "item_id", shard_words: int = SHARD_WORDS, shards: int = SHARDS) -> DataFrame:
    """A row for each document: key, text_sha (binary), n_words, spans (of hit words: first, last + 1 as words, start, end as bytes), items (ids as strings, sorted)."""
    spark = docs.sparkSession
    rows = named(docs, key, text).withColumn("sha", F.unhex(F.sha2(F.coalesce("t", F.lit("")), 256)))
    built = build(bench, item_text, item, window, shard_words)
    last = built.agg(F.max("shard")).first()[0]
    groups = range(0, 1 if last is None else last + 1, shards)
    found, more = None, []
    for at in groups:
        automata = built.filter(F.col("shard").between(at, at + shards - 1)).orderBy("shard").collect()  # bounded by shards and shard_words
        held = spark.sparkContext.broadcast([pickle.loads(r["automaton"]) for r in automata])
        part = _pass(rows, held, only_hits=found is not None)
        if len(groups) > 1:
            part = spool(part if found is None else part.groupBy("sha").agg(F.any_value("spans").alias("spans"), F.any_value("items").alias("items")))
            held.unpersist()
        if found is None:
            found = part
        else:
            more.append(part)
    if more:
        several = functools.reduce(DataFrame.unionByName, more).groupBy("sha").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items"))
        both = found.join(several, "sha", "left")
        found = both.select(
            "k",
            "sha",
            "n_words",
            F.when(F.col("more_spans").isNull(), F.col("spans")).otherwise(F.pandas_udf(_joined, SPANS)(F.concat("spans", F.coalesce("more_spans", F.array().cast(SPANS))))).alias("spans"),
            F.when(F.col("more_items").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", "more_items")))).alias("items"),
        )
    return found.select(F.col("k").cast(docs.schema[key].dataType).alias(key), F.col("sha").alias("text_sha"), "n_words", "spans", "items")


def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for t, cuts in zip(text, spans, strict=True):
        data, at, kept = t.encode("utf-8", "surrogatepass"), 0, []
        for s in cuts:
            kept.append(data[at : s["start"]])
            at = s["end"]
        out.append(b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass"))
    return pd.Series(out)


def clean(docs: DataFrame, bench: DataFrame, text: str = "text", key: str = "doc_id", longest: int = LONGEST, coverage: float = COVERAGE, **settings) -> DataFrame:
    """docs without spans of at least `longest` hit words, and without documents of whose words a greater share than `coverage` is hit.

    All other rows and columns stay as they are; null texts stay null.
    """
    found = hits(docs, bench, text, key, **settings).filter(F.size("spans") > 0)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    judged = found.groupBy("text_sha").agg(F.any_value("spans").alias("spans"), F.any_value("n_words").alias("n_words")).select(F.col("text_sha").alias("_sha"), F.filter("spans", lambda s: s["last"] - s["first"] >= longest).alias("_cuts"), (hit / F.col("n_words")).alias("_share"))
    both = docs.withColumn("_own", F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))).join(judged, F.col("_own") == F.col("_sha"), "left")
    cut = F.when(F.size("_cuts") > 0, F.pandas_udf(_without, "string")(F.coalesce(F.col(text), F.lit("")), F.coalesce("_cuts", F.array().cast(SPANS)))).otherwise(F.col(text))
    return both.filter((F.coalesce("_share", F.lit(0.0)) <= coverage)).withColumn(text, cut).select(*docs.columns)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"))


_SPLIT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = {
    "op12_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SPLIT} AS ws FROM documents),
b AS (SELECT item_id, {_SPLIT} AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS m, array_to_string(ws[p:p + least(len(ws), {WINDOW}) - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS p FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT m FROM w),
runs AS (SELECT r, m, p, array_to_string(ws[p:p + m - 1], ' ') AS t FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d JOIN sizes ON len(ws) >= m)),
found AS (SELECT r, runs.m, p, item_id FROM runs JOIN w USING (m, t)),
n AS (SELECT r, count(DISTINCT place) AS n FROM (SELECT r, unnest(range(p, p + m)) AS place FROM (SELECT DISTINCT r, p, m FROM found)) GROUP BY r),
i AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n.n IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""
}
QUERIES = {"op12_decontamination": op12_decontamination}
