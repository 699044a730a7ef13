"""N-gram Jaccard join: T-occurrence search over inverted lists by DivideSkip.

Two documents link when the Jaccard similarity of their shingle sets reaches num / den; the result is each document's
component. It is exact, up to collisions of 64-bit hashes (of shingles, and of the sets that share a text's shingles):

1. Documents with one set are one node, so copies meet once, whatever their number.
2. Candidates. Sets that link differ in at most k shingles, k known from their sizes. A set's shingles are dealt by their hashes
   into k + 1 + x classes, so at least 1 + x classes are the same in both. Under any order of classes by what they hold, the k + 1
   first of both sets then share one (of a set whose own size allows fewer differences, fewer do): here the fullest, so that a class names several shingles and hardly ever agrees by chance.
   How often single shingles occur in the corpus doesn't matter, so the work per document doesn't grow with the corpus. Sizes
   fall into bands whose neighbours alone can link; a set posts its classes for its own band and the next.
3. A list, the nodes that share a class, is led by its node with the most shared classes, often the text that the others were
   made from. The leader asks the inverted lists of blocks of its followers which of them reach the overlap T that a link
   needs: short lists are merged with a heap that skips what can't reach T less the number of long lists, and long ones are
   probed by binary search.
4. A list whose nodes are then in one component can't change the result. The nodes of the others are searched whole, each asking
   the inverted lists of those before it, those of one candidate group together. A group too large for one task is dealt into
   blocks; nodes outside its largest component ask all blocks, the others only their own.

A null text counts as empty; an empty set links with nothing, and its component is its own id. Repeated rows get one result
each. A component's id is its smallest non-null id. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_bitmap, prepare, slot_bitmap, small_batches, sorted_groups, spool, table
from .graph import components
from .shingles import mix, shingle_set

#: Followers that a leader asks at once; shingles that they hold together, and that a block of the last search does; nodes of such a block.
FOLLOWERS, SEARCHED, MEMBERS = 1_000, 1_000_000, 1_000
#: Sets from which on their inverted lists are merged and probed as arrays.
ARRAYS = 48
#: DivideSkip's weight of a long list's length in choosing how many lists are long.
MU = 0.0085
_LONGEST = 1 << 31
_POSTED = 200_000


def _node(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _short(node: bytes) -> int:
    return int.from_bytes(node[:8], "big", signed=True)


def overlap(a: int, b: int, num: int, den: int) -> int:
    """The least intersection with which sets of these sizes link."""
    return -(-num * (a + b) // (num + den))


@cache
def bands(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The least size of each band; by band, how many shingles sets that link may differ in, the smaller from the band before."""
    low = [1]
    while low[-1] < _LONGEST:
        low.append(low[-1] * den // num + 1)
    most = [0] + [((b - 1) + (b - 1) * den // num) * (den - num) // (num + den) for b in low[1:]]
    return np.array(low), np.array(most)


def classes(found: np.ndarray, num: int, den: int) -> np.ndarray:
    """Names of the classes that a set posts, of its own band and the next; none where only equal sets link."""
    low, most = bands(num, den)
    own = int(np.searchsorted(low, len(found), side="right")) - 1
    out = []
    n, below = len(found), int(low[own]) - 1
    for band, partner in ((own, below), (own + 1, n * den // num)):
        k, least = int(most[band]), (n + partner) * (den - num) // (num + den)  # of all sets of the band, of this one
        if not least:
            continue
        count = k + 2 + k // 4
        at = (found % np.uint64(count)).astype(np.int64)
        size = np.bincount(at, minlength=count)
        halves = [np.bincount(at, weights=(found >> np.uint64(s) & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=count).astype(np.uint64) for s in (0, 32)]
        names = mix(mix(halves[0] + np.arange(count, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + halves[1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(band))
        order = (255 - np.minimum(size, 255)).astype(np.uint64) << np.uint64(56) | names >> np.uint64(8)
        out.append(names[np.argpartition(order, least)[: least + 1]])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, dtype=np.int64)


def divide_skip(lists: list[list[int]], need: int, accept) -> None:
    """Calls accept(id, count) for every id that is on at least `need` of the lists, with the number of lists it is on.

    accept is asked first with count None and returns whether the id is of interest. Lists are ascending.
    """
    if len(lists) < need or need < 1:
        return
    lists = sorted(lists, key=len)
    many = min(need - 1, len(lists) - 1, int(need / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long_ = lists[: len(lists) - many], lists[len(lists) - many :]
    least = need - many
    heads = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heads)
    while len(heads) >= least:
        top, popped = heads[0][0], []
        while heads and heads[0][0] == top:
            popped.append(heapq.heappop(heads))
        if len(popped) >= least:
            if accept(top, None):
                total = len(popped)
                for left, x in enumerate(long_):
                    if total + len(long_) - left < need:
                        break
                    i = bisect_left(x, top)
                    total += i < len(x) and x[i] == top
                if total >= need:
                    accept(top, total)
            for _, k, at in popped:
                if at + 1 < len(short[k]):
                    heapq.heappush(heads, (short[k][at + 1], k, at + 1))
        else:
            while heads and len(popped) < least - 1:
                popped.append(heapq.heappop(heads))
            if not heads:
                return
            bound = heads[0][0]
            for _, k, at in popped:
                i = bisect_left(short[k], bound, at)
                if i < len(short[k]):
                    heapq.heappush(heads, (short[k][i], k, i))


def divide_skip_arrays(lists: list[np.ndarray], need: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same of long lists, as arrays: ids, of those wanted (a mask by id), that are on at least `need` lists, and the numbers of lists.

    The short lists' runs are merged by a stable sort instead of a heap, and the long ones are probed for all ids at once.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(lists) < need or need < 1:
        return none, none
    lists = sorted(lists, key=len)
    many = min(need - 1, len(lists) - 1, int(need / (MU * math.log2(len(lists[-1]) + 1) + 1)))
    short, long_ = lists[: len(lists) - many], lists[len(lists) - many :]
    ids = np.sort(np.concatenate(short), kind="stable")
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    ids, counts = ids[first], np.diff(np.append(first, len(ids)))
    keep = wanted[ids] & (counts >= need - many)
    ids, counts = ids[keep], counts[keep]
    for left, x in enumerate(long_):
        keep = counts >= need - (len(long_) - left)
        if not keep.all():
            ids, counts = ids[keep], counts[keep]
        if not len(ids):
            break
        at = np.searchsorted(x, ids)
        counts = counts + (x[np.minimum(at, len(x) - 1)] == ids)
    keep = counts >= need
    return ids[keep], counts[keep]


class Index:
    """Inverted lists of sets: for each shingle the places of the sets that hold it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])) if len(every) else np.zeros(0, dtype=np.int64)
        self.keys, self.cuts = every[first], np.append(first, len(every))
        self.arrays = len(sets) > ARRAYS
        self.owner = owner if self.arrays else owner.tolist()

    def ask(self, own: np.ndarray, num: int, den: int, wanted: np.ndarray) -> list[int]:
        """Places of the sets, of those wanted, that link with a set."""
        fits = wanted & (np.minimum(self.sizes, len(own)) * den >= np.maximum(self.sizes, len(own)) * num)
        if not len(own) or not fits.any():
            return []
        at = np.minimum(np.searchsorted(self.keys, own), len(self.keys) - 1)
        at = at[self.keys[at] == own]
        lists = [self.owner[a:b] for a, b in zip(self.cuts[at].tolist(), self.cuts[at + 1].tolist(), strict=True)]
        need = overlap(len(own), int(self.sizes[fits].min()), num, den)
        if self.arrays:
            ids, counts = divide_skip_arrays(lists, need, fits)
            return ids[counts * (num + den) >= num * (len(own) + self.sizes[ids])].tolist()
        out = []

        def accept(i: int, count: int | None) -> bool:
            if count is not None and count >= overlap(len(own), int(self.sizes[i]), num, den):
                out.append(i)
            return bool(fits[i])

        divide_skip(lists, need, accept)
        return out


def followers(leader: np.ndarray, sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Which of the sets link with the leader, by their places."""
    return Index(sets).ask(leader, num, den, np.ones(len(sets), dtype=bool))


def search(sets: list[np.ndarray], names: list, groups: list, num: int, den: int, guests: int = 0) -> list[tuple]:
    """Links between nodes that groups don't already hold together; links within what they join are left out.

    Members of the largest group are asked, but don't ask. The last `guests` sets ask the others, but not one another.
    """
    code = pd.factorize(np.array(groups, dtype=object))[0]
    hosts = len(sets) - guests
    if not hosts:
        return []
    largest = np.bincount(code[:hosts]).argmax()
    index, out = Index(sets[:hosts]), []
    for i in np.flatnonzero(code != largest).tolist():
        wanted = code[:hosts] != code[i]
        for other in index.ask(sets[i], num, den, wanted):
            if code[other] != code[i]:
                code[code == code[i]] = code[other]
                out.append((names[i], names[other]))
    return out


def _scan(docs: DataFrame, text: str, key: str) -> DataFrame:
    """id and a hash of the text, which name a row, a hash of both, and the text."""
    own = F.col(key).cast("string")
    return docs.select(own.alias("id"), F.xxhash64(F.col(text)).alias("mark"), F.xxhash64(own, F.col(text)).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each document: id, mark (a hash of the text), n (size of its set), node, component (a node; null: no link), component_id."""
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, num, den, text, key)


def _near_duplicates(docs: DataFrame, words: int, num: int, den: int, text: str, key: str) -> DataFrame:
    prepare(docs.sparkSession)
    scan = _scan(docs, text, key)
    kind = docs.schema[key].dataType.simpleString()
    read = spool(_read(scan, words, num, den))
    posted = _posted(read)
    sets = _wanted_sets(scan, read, posted, words)
    pairs = _led(posted)
    links = spool(_star(pairs, sets, num, den))
    group = spool(components(links))
    more = _rest(posted, group, sets, num, den)
    if not more.isEmpty():
        group = spool(components(links.unionByName(more)))

    nodes = read.filter("n > 0").groupBy("node").agg(F.min(F.col("id").cast(kind)).alias("least"), F.min("h").alias("h"))
    nodes = spool(nodes.join(group.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h")).select("node", "least", "component"))
    named = spool(nodes.groupBy("component").agg(F.min("least").alias("component_id")))
    nodes = spool(nodes.join(named, "component").select("node", "component", "component_id"))
    out = read.select(F.col("id").cast(kind).alias("id"), "mark", "n", "node").join(nodes, "node", "left")
    return out.select("id", "mark", "n", "node", "component", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _read(scan: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """A row for each document: id, mark, row, n, node, h (the first half of node), and, once for each set that a task meets, the classes that it posts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            at, rows, held = 0, [], 0
            for i, t in enumerate(batch["t"]):
                found = shingle_set(t, words)
                node = _node(found) if len(found) else None
                posts = None
                if node and node not in seen:
                    seen.add(node)
                    posts = classes(found, num, den)
                    held += len(posts)
                rows.append((len(found), node, _short(node) if node else 0, posts))
                if held > _POSTED or i + 1 == len(batch):
                    out = pd.DataFrame(rows, columns=["n", "node", "h", "posts"])
                    for c in ("row", "mark", "id"):
                        out.insert(0, c, batch[c].iloc[at : i + 1].array)
                    yield out
                    at, rows, held = i + 1, [], 0

    return scan.mapInPandas(run, "id string, mark long, row long, n long, node binary, h long, posts array<long>")


def _posted(read: DataFrame) -> DataFrame:
    """class, h: the distinct entries of lists with two nodes or more."""
    every = read.filter("size(posts) > 0").select("h", F.explode("posts").alias("class"))
    shared = spool(every.groupBy("class").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("class"))
    return spool(spool(every.join(shared, "class")).distinct())


def _wanted_sets(scan: DataFrame, read: DataFrame, posted: DataFrame, words: int) -> DataFrame:
    """h, n, s: the sets of the nodes on lists, and their sizes, computed again from one document each."""
    wanted = spool(posted.select("h").distinct())
    one = spool(read.filter("size(posts) > 0").select("h", "row").join(wanted, "h").groupBy("h").agg(F.min("row").alias("row")))
    held = scan.sparkSession.sparkContext.broadcast(slot_bitmap(one, "row"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for t in batch["t"][in_bitmap(held.value, batch["row"].to_numpy(np.int64))]:
                found = shingle_set(t, words)
                if len(found) and (h := _short(_node(found))) not in seen:
                    seen.add(h)
                    rows.append((h, len(found), found.view(np.int64)))
            yield pd.DataFrame(rows, columns=["h", "n", "s"])

    # The bitmap spares the other texts; the join decides. It is read in the same function, since a filter of its own would run a second
    # Python worker beside each task's first, and both stay for all that follows.
    return spool(scan.select("row", "t").mapInPandas(run, "h long, n long, s array<long>").join(wanted, "h").dropDuplicates(["h"]))


def _led(posted: DataFrame) -> DataFrame:
    """leader, h: each list's nodes with that node of it which shares the most classes."""
    degree = spool(posted.groupBy("h").agg(F.count(F.lit(1)).alias("degree")))
    leaders = spool(posted.join(degree, "h").groupBy("class").agg(F.max(F.struct("degree", "h")).alias("l")).select("class", F.col("l.h").alias("leader")))
    return spool(posted.join(leaders, "class").filter("h <> leader").select("leader", "h").distinct())


def _star(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links u, v between leaders and their followers."""
    sized = spool(pairs.join(sets.select("h", "n"), "h"))
    most = F.greatest(F.count(F.lit(1)) / F.lit(FOLLOWERS), F.sum("n") / F.lit(SEARCHED))
    parts = spool(sized.groupBy("leader").agg(F.ceil(most).cast("int").alias("parts")))
    dealt = sized.join(parts, "leader").select("leader", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int").alias("part"), "h")
    asked = dealt.join(sets.select("h", "s"), "h").withColumn("follows", F.lit(True))
    asking = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("h"), F.lit(False).alias("follows")).join(sets.select("h", "s"), "h")
    keys = ["leader", "part"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for g in sorted_groups(batches, keys):
            first, rest = g["s"].iloc[0], g.iloc[1:]  # the leader's own row sorts first
            names = rest["h"].tolist()
            found += [(names[i], int(g["leader"].iloc[0])) for i in followers(_set(first), [_set(x) for x in rest["s"]], num, den)]
        yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    met = asked.unionByName(asking).repartition(*keys).sortWithinPartitions(*keys, "follows", "h")
    return met.select("leader", "part", "h", "s").mapInPandas(look, "u long, v long")


def _set(values) -> np.ndarray:
    return np.asarray(values, dtype=np.int64).view(np.uint64)


def _rest(posted: DataFrame, group: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links that the leaders left open: between nodes of lists that hold more than one component."""
    placed = spool(posted.join(group.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h")))
    split = spool(placed.groupBy("class").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("class", "a"))
    open_ = spool(placed.join(split, "class").select("h", "component", "a").distinct())
    # Components that share a list are searched together, once, however many lists they share.
    bunch = components(open_.select(F.col("component").alias("u"), F.col("a").alias("v")))
    bunch = spool(bunch.select(F.col("component").alias("bunch"), F.col("node").alias("component")))
    open_ = open_.select("h", "component").distinct()
    members = spool(open_.join(bunch, "component").join(sets.select("h", "n"), "h"))
    by = members.groupBy("bunch", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    sizes = spool(by.groupBy("bunch").agg(F.max(F.struct("c", "component")).alias("main"), F.ceil(F.greatest(F.sum("n") / F.lit(SEARCHED), F.sum("c") / F.lit(MEMBERS))).cast("int").alias("parts")).select("bunch", F.col("main.component").alias("main"), "parts"))
    dealt = members.join(sizes, "bunch").withColumn("own", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int"))
    # Outside the largest component a node is a guest in the blocks that aren't its own.
    blocks = F.when(F.col("component") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = spool(dealt.select("bunch", "h", "component", "own", F.explode(blocks).alias("part")).withColumn("guest", F.col("part") != F.col("own")).drop("own"))
    keys = ["bunch", "part"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple] = []
        for g in sorted_groups(batches, keys):
            found += search([_set(x) for x in g["s"]], g["h"].tolist(), g["component"].tolist(), num, den, int(g["guest"].sum()))
        yield pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    rows = dealt.join(sets.select("h", "s"), "h").repartition(*keys).sortWithinPartitions(*keys, "guest", "h")
    return spool(rows.select("bunch", "part", "h", "component", "guest", "s").mapInPandas(look, "u long, v long"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one document of each component: that with the smallest id, then the smallest hash of its text. Repeated rows are one document."""
    found = spool(near_duplicates(docs, words, num, den, text, key).select("id", "mark", "n", "component"))
    best = spool(found.filter("n > 0").groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("best")))
    lost = found.filter("n > 0").join(best, "component").filter(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("mark") == F.col("best.mark"))))
    lost = spool(lost.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("a"), "mark").distinct())
    named = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("a"), F.xxhash64(F.col(text)).alias("mark"))
    kept = named.join(lost, ["a", "mark"], "left_anti")
    if not found.groupBy("id", "mark").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["a", "mark"])
    return kept.select("row.*")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, num=90, den=100)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


SQL = {
    "op7_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 2, 1) + 1), lambda i: list_slice(words, i, i + 2))) AS shingle
  FROM w WHERE len(words) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 90 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.v FROM r JOIN l ON l.u = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)"""
}
QUERIES = {"op7_ngram_join": op7_ngram_join}
