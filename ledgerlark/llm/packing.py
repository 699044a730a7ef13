"""Best-fit packing of documents into sequences by the linear grouping scheme.

Packing looks at lengths alone, and there are no more than `capacity` different ones, so the plan is made from a histogram
and costs the same at any input size: large lengths are split into groups of equal cardinality and rounded up to their
group's largest, a linear program over all patterns of these few sizes says how often each fills a sequence (its whole part is
used, what is left over is filled pattern after pattern), the actual lengths then take the rounded ones' places, and
short documents go, longest first, to the sequence with the least room that takes them. The plan is a list of intervals of
ranks within a length; Spark ranks the pieces and looks their places up.

A null or empty text is the end id alone. Repeated rows are packed as often as they occur; ties between equal lengths go
by id, piece and content. An empty table gives an empty result. Other columns play no part.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import named, prepare, spool, table

#: Pieces of one length that are ranked together, while they make no more than PARTS parts.
RANKED, PARTS = 512, 8192
#: Shares of the capacity above which a length is large, and numbers of groups, that the planner tries; it keeps the plan with the fewest sequences.
LARGE, GROUPS = (8, 4, 3), (64, 256, 1024)
#: Groups up to which the linear program is solved, and its steps for each size: every step's solution packs all, later ones in fewer sequences.
SOLVED, STEPS = 64, 40

_RANK_BITS = 44


class Plan:
    """Classes of equally filled sequences. A run puts per_bin documents of one length, from a rank on, in each sequence of its class."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.done: list[tuple[int, int, list]] = []  # count, room, runs of (length, per_bin, offset, rank)
        self.open: list[list] = [[] for _ in range(capacity + 1)]  # by room

    @property
    def bins(self) -> int:
        return sum(c for room in self.open for c, _ in room)

    def add(self, count: int, runs: list) -> None:
        room = self.capacity - sum(length * per for length, per, _, _ in runs)
        self.open[room].append((count, runs))

    def best_fit(self, length: int, rank: int, count: int) -> None:
        """Places documents of one length: each goes where the least room is left that takes it."""
        while count:
            room = next((r for r in range(length, self.capacity + 1) if self.open[r]), None)
            if room is None:
                n, runs, room = count, [], self.capacity
            else:
                n, runs = self.open[room].pop()
            per, used = room // length, self.capacity - room
            whole = min(n, count // per)
            if whole:
                self.add(whole, [*runs, (length, per, used, rank)])
                rank, count = rank + whole * per, count - whole * per
            if whole < n and count and count < per:
                self.add(1, [*_later(runs, whole), (length, count, used, rank)])
                whole, count = whole + 1, 0
            if whole < n and runs:
                self.open[room].append((n - whole, _later(runs, whole)))

    def intervals(self) -> dict[str, np.ndarray]:
        rows, base = [], 0
        for room in self.open:
            for count, runs in room:
                rows += [(length << _RANK_BITS | rank, rank, per, offset, base) for length, per, offset, rank in runs]
                base += count
        rows.sort()
        at = np.array(rows, dtype=np.int64).reshape(-1, 5)
        return dict(zip(("key", "rank", "per", "offset", "base"), at.T, strict=True))


def _later(runs: list, bins: int) -> list:
    """The runs of a class without its first sequences."""
    return [(length, per, offset, rank + bins * per) for length, per, offset, rank in runs]


def fill(sizes: list[int], left: list[int], room: int) -> list[int]:
    """How many of each size, of those left, fill the room best; of equal fills the one with the larger sizes."""
    mask, reached = (1 << (room + 1)) - 1, [1]
    for s, n in zip(sizes, left, strict=True):
        now = new = reached[-1]
        for _ in range(min(n, room // s)):
            new = new << s & mask
            now |= new
        reached.append(now)
    total, out = reached[-1].bit_length() - 1, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not reached[i] >> total & 1:
            total -= sizes[i]
            out[i] += 1
    return out


def worthiest(sizes: list[int], worth: np.ndarray, room: int) -> np.ndarray:
    """How many of each size make the pattern of the greatest worth that the room takes."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for i, s in enumerate(sizes):
        if worth[i] <= 0:
            continue
        for at in range(s, room + 1, s):  # a stretch at a time, each from the one before
            here = best[at : at + s]
            new = best[at - s : at - s + len(here)] + worth[i]
            better = new > here + 1e-12
            here[better] = new[better]
            last[at : at + s][better] = i
    out = np.zeros(len(sizes), dtype=np.int64)
    at = room
    while last[at] >= 0:
        out[last[at]] += 1
        at -= sizes[last[at]]
    return out


def configurations(sizes: list[int], left: list[int], room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The linear program of patterns by column generation: patterns (one a column), how often each is used, and each size's worth.

    Minimal sum of uses under which the patterns hold `left` of each size. It starts from patterns of one size; a pattern worth more
    than a sequence enters while there is one.
    """
    b = np.array(left, dtype=float)
    basis = np.diag([float(room // s) for s in sizes])
    used = b / np.diag(basis)
    for _ in range(STEPS * len(sizes)):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        pattern = worthiest(sizes, worth, room)
        if worth @ pattern <= 1 + 1e-9:
            break
        turn = np.linalg.solve(basis, pattern.astype(float))
        ratio = np.where(turn > 1e-9, used / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = pattern
        used = np.linalg.solve(basis, b).clip(0)
    return basis.round().astype(np.int64), used, worth


def grouped_plan(counts: dict[int, int], capacity: int, share: int, groups: int, solve: bool = False) -> Plan:
    plan, ranks = Plan(capacity), dict.fromkeys(counts, 0)
    if counts.get(capacity):
        plan.add(counts[capacity], [(capacity, 1, 0, 0)])
    lengths = sorted((n for n in counts if counts[n] and n < capacity), reverse=True)
    large = [n for n in lengths if n * share > capacity]
    each = -(-sum(counts[n] for n in large) // groups)
    sizes: list[int] = []
    queues: list[list] = []  # by group: length, count, first rank
    inside = each
    for n in large:
        rank, rest = 0, counts[n]
        while rest:
            if inside == each:
                if not sizes or sizes[-1] != n:
                    sizes.append(n)
                    queues.append([])
                inside = 0
            take = min(rest, each - inside)
            queues[-1].append([n, take, rank])
            rank, rest, inside = rank + take, rest - take, inside + take
    left = [sum(c for _, c, _ in q) for q in queues]
    if solve and sizes:
        patterns, uses, _ = configurations(sizes, left, capacity)
        for pattern, use in zip(patterns.T.tolist(), uses, strict=True):
            times = min([int(use + 1e-6), *(c // m for c, m in zip(left, pattern, strict=True) if m)])
            if times:
                _substitute(plan, queues, pattern, times)
                left = [c - times * m for c, m in zip(left, pattern, strict=True)]
    while any(left):
        first = next(i for i, c in enumerate(left) if c)
        left[first] -= 1
        pattern = fill(sizes, left, capacity - sizes[first])
        left[first] += 1
        pattern[first] += 1
        times = min(c // m for c, m in zip(left, pattern, strict=True) if m)
        _substitute(plan, queues, pattern, times)
        left = [c - times * m for c, m in zip(left, pattern, strict=True)]
    for n in lengths:
        if n * share <= capacity:
            plan.best_fit(n, ranks[n], counts[n])
    return plan


def _substitute(plan: Plan, queues: list, pattern: list[int], times: int) -> None:
    """Actual documents, longest first, for the places of a pattern that is used so many times."""
    slots = []
    for queue, m in zip(queues, pattern, strict=True):
        for _ in range(m):
            runs, need, at = [], times, 0
            while need:
                length, count, rank = queue[0]
                take = min(need, count)
                runs.append((at, length, rank))
                at, need = at + take, need - take
                queue[0] = [length, count - take, rank + take]
                if take == count:
                    queue.pop(0)
            slots.append(runs)
    cuts = sorted({at for runs in slots for at, _, _ in runs} | {times})
    place = [0] * len(slots)
    for a, b in zip(cuts, cuts[1:], strict=False):
        here, offset = [], 0
        for i, runs in enumerate(slots):
            if place[i] + 1 < len(runs) and runs[place[i] + 1][0] <= a:
                place[i] += 1
            at, length, rank = runs[place[i]]
            here.append((length, 1, offset, rank + a - at))
            offset += length
        plan.add(b - a, here)


def best_plan(counts: dict[int, int], capacity: int) -> Plan:
    return min((grouped_plan(counts, capacity, s, g, solve) for s in LARGE for g in GROUPS for solve in (True, False) if g <= SOLVED or not solve), key=lambda p: p.bins)


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as the characters from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids as the tokenizers library gives them for a tokenizer file.

    A plain byte-level BPE file, whose merges stand in the order of their results' ids, is run by tiktoken, which gives the
    same ids several times faster; any other file is run by tokenizers itself. Special tokens' strings in a text become their
    ids, as the library reads them unless told otherwise.
    """

    def __init__(self, definition: str):
        d = json.loads(definition)
        model = d["model"]
        split = d.get("pre_tokenizer") or {}
        plain = model["type"] == "BPE" and d.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        special = {t["content"]: t["id"] for t in d.get("added_tokens", ())}
        flags = ("lstrip", "rstrip", "single_word", "normalized")
        apart = not any(a != b and a in b for a in special for b in special)
        if plain and apart and all(t.get("special") and not any(t.get(f) for f in flags) for t in d.get("added_tokens", ())):
            byte = _byte_of_char()
            vocabulary = {w: i for w, i in model["vocab"].items() if w not in special}
            merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
            made = [vocabulary.get(m.replace(" ", "", 1), -1) for m in merges]
            if made == sorted(set(made)) and made[0] >= 256 and len(made) + 256 == len(vocabulary):
                import tiktoken

                ranks = {bytes(byte[c] for c in w): i for w, i in vocabulary.items()}
                bpe = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
                self.encode = lambda text: bpe.encode(text, allowed_special="all") if any(x in text for x in special) else bpe.encode_ordinary(text)
                return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(definition)
        self.encode = lambda text: tokenizer.encode(text, add_special_tokens=False).ids


_LOADED: dict[int, Encoder] = {}


def cut(docs: DataFrame, definition: str, capacity: int, end: int, text: str, key: str, keep_ids: bool) -> DataFrame:
    """The pieces of every document: only those longer than capacity are cut, and of these the first piece takes what is over."""
    spark = prepare(docs.sparkSession)
    held, name = spark.sparkContext.broadcast(definition), hash(definition)
    kind = docs.schema[key].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = Encoder(held.value)
        encode = _LOADED[name].encode
        for batch in batches:
            rows, owner = [], []
            for i, t in enumerate(batch["t"]):
                ids = encode(t or "")
                ids.append(end)
                raw = np.array(ids, dtype="<u4")
                start, piece = 0, 0
                stop = len(ids) % capacity or min(len(ids), capacity)
                while start < len(ids):
                    rows.append((piece, start, stop - start, zlib.crc32(raw[start:stop].tobytes()), *([ids[start:stop]] if keep_ids else [])))
                    owner.append(i)
                    start, stop, piece = stop, stop + capacity, piece + 1
            out = pd.DataFrame(rows, columns=names)
            out.insert(0, "k", batch["k"].take(owner).array)
            yield out

    schema = "k string, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return named(docs, key, text).mapInPandas(run, schema).select(F.col("k").cast(kind).alias(key), *names)


def pack(docs: DataFrame, definition: str, capacity: int = 2048, end: int = 0, text: str = "text", key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32, sequence_id, offset, and the ids where asked for."""
    spark = docs.sparkSession
    pieces = spool(cut(docs, definition, capacity, end, text, key, keep_ids))
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # no more rows than capacity
    plan = spark.sparkContext.broadcast(best_plan(counts, capacity).intervals())
    # An Arrow table goes straight to the JVM; a list would go through Python workers of their own.
    parts = spark.createDataFrame(pa.table({"length": list(counts), "parts": [min(-(-c // RANKED), PARTS) for c in counts.values()]}, pa.schema({"length": pa.int64(), "parts": pa.int64()})), "length long, parts long")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(key, "piece", "ids_crc32"), "parts"))
    before = dealt.groupBy("length", "part").count().withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("part")) - F.col("count")).drop("count")
    order = Window.partitionBy("length", "part").orderBy(key, "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(order)).join(before, ["length", "part"])
    ranked = ranked.select(key, "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, (F.col("before") + F.col("own") - 1).alias("rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = plan.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(at["key"], (n << _RANK_BITS) | r, side="right") - 1
        own = r - at["rank"][i]
        return pd.DataFrame({"sequence_id": at["base"][i] + own // at["per"][i], "offset": at["offset"][i] + own % at["per"][i] * n})

    placed = ranked.withColumn("at", place("length", "rank"))
    return placed.select(key, "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"), *["ids"] * keep_ids)


def definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), definition(public_tokenizers.path("byte_bpe_50k.json")))


QUERIES = {"op9_packing": op9_packing}
