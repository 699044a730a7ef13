"""Conversation prefix trie by smallest-member ownership.

A node is a distinct sequence of a conversation's first d turns; its owner is the smallest conversation that starts with
it. Whoever owns a node owns every deeper node of its own path, so each conversation owns a suffix of its path. What a
subtree saves is the code points of all its members' turns from there on, less those of the turns that are owned, so one
group-by over prefixes gives it as a sum; a child or a leaf counts once, with its owner.

Turns come in ascending order, null first; of equal turns the least role and text (first 40 characters of both, then
their hash), and repeated rows are turns of their own. Null roles and texts are empty. Rows without conversation are left
out; an empty table has no nodes, not even a root. Other columns, whatever their names, play no part. Nodes are told
apart by 128-bit hashes of their turns.

Neither a conversation nor a node is gathered. Turns are numbered, and prefixes hashed, by running sums over range
partitions, so a conversation may span many; owners are minima that meet in the map tasks, written before the join that
needs them, so that Spark can split a node that very many share. The one thing that can't be split is the SHA-256 of a
node's ids: they are joined to strings in range partitions, and one task reads the strings as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table
from .scan import running

#: Fixed values of the query: conversations that share a start, and the number of start lengths.
FAMILY, LENGTHS = 100, 6
#: Characters of role and text that order equal turns before their hash does.
_HEAD = 40
#: Ids joined to one string.
_IDS = 2000
_NONE = hashlib.sha256(b"").hexdigest()


def turns(chats: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, n (place from 1), a and b (hash of role and text), cp (code points of the text) of each turn."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    whole = F.concat(F.length(who).cast("string"), F.lit(":"), who, what)
    sha = F.sha2(whole, 256)
    part = lambda at: F.conv(F.substring(sha, at, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    rows = chats.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"),
        F.col(turn).alias("turn"),
        F.substring(F.concat(who, F.lit("\x00"), F.substring(what, 1, _HEAD)), 1, _HEAD).alias("head"),
        part(1).alias("a"),
        part(17).alias("b"),
        F.length(what).cast("long").alias("cp"),
        F.monotonically_increasing_id().alias("row"),
    )
    return running(rows, "c", ["turn", "head", "a", "row"], keep=("a", "b", "cp"))


def shared_starts(rows: DataFrame, family: int = FAMILY, lengths: int = LENGTHS) -> tuple[DataFrame, DataFrame]:
    """Conversations (c, size) and their turns (c, d, a, b, cp, size) after each got the start of its family's first conversation.

    Conversation c takes the first h = crc32(c) % lengths turns of conversation c - c % family, then its own after its first h.
    """
    name = F.col("c").cast("string")
    own = rows.groupBy("c").agg(F.max("n").alias("own")).withColumns({"h": F.crc32(name.cast("binary")) % lengths, "base": F.col("c") - F.col("c") % family})
    heads = rows.filter((F.col("c") % family == 0) & (F.col("n") < lengths)).select(F.col("c").alias("base"), F.col("n").alias("d"), "a", "b", "cp")
    there = heads.groupBy("base").agg(F.max("d").alias("there"))
    known = spool(own.join(there, "base", "left").withColumn("got", F.least("h", F.coalesce("there", F.lit(0)))).select("c", "base", "h", "got", (F.col("got") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")))
    first = known.filter("got > 0").join(heads, "base").filter("d <= got").select("c", "d", "a", "b", "cp", "size")
    rest = rows.join(known.select("c", "h", "got", "size"), "c").filter("n > h").select("c", (F.col("n") - F.col("h") + F.col("got")).alias("d"), "a", "b", "cp", "size")
    return known.select("c", "size"), first.unionByName(rest)


def plain(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations and turns as they are."""
    known = spool(rows.groupBy("c").agg(F.max("n").alias("size")))
    return known, rows.select("c", F.col("n").alias("d"), "a", "b", "cp").join(known, "c")


def _ends(rows: DataFrame, node: list[str]) -> DataFrame:
    """node, sha: of the ids of all conversations that end there, ascending, comma-joined; for nodes where several do."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in node)

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, ids, first = None, [], 0
        for b in batches:
            out = []
            for *k, c in b[[*node, "c"]].itertuples(index=False, name=None):
                if k != at or len(ids) >= _IDS:
                    if ids:
                        out.append((*at, first, ",".join(ids)))
                    at, ids, first = k, [], c
                ids.append(str(c))
            yield pd.DataFrame(out, columns=[*node, "first", "ids"])
        if ids:
            yield pd.DataFrame([(*at, first, ",".join(ids))], columns=[*node, "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sha = None, None
        for b in batches:
            out = []
            for *k, ids in b[[*node, "ids"]].itertuples(index=False, name=None):
                if k != at:
                    if at is not None:
                        out.append((*at, sha.hexdigest()))
                    at, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=[*node, "sha"])
        if at is not None:
            yield pd.DataFrame([(*at, sha.hexdigest())], columns=[*node, "sha"])

    pieces = rows.repartitionByRange(*node, "c").sortWithinPartitions(*node, "c").mapInPandas(strings, f"{kinds}, first long, ids string")
    return pieces.repartition(*node).sortWithinPartitions(*node, "first").mapInPandas(digest, f"{kinds}, sha string")


def trie(known: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    node = ["d", "a", "b"]
    at = F.col("d").cast("string")
    steps = rows.select("c", "d", F.xxhash64(F.lit("a"), at, "a", "b").alias("a"), F.xxhash64(F.lit("b"), at, "b", "a").alias("b"), "cp", F.col("cp").alias("upto"), "size")
    zero = F.lit(0).cast("long")
    root = known.select("c", "size", *(zero.alias(x) for x in ("d", "a", "b", "cp", "upto")))
    path = spool(running(steps, "c", ["d"], keep=("d", "cp", "size"), xors=("a", "b"), sums=("upto",)).drop("n").unionByName(root))
    owners = spool(path.groupBy(*node).agg(F.min("c").alias("owner"), F.max("size").alias("deepest"), F.sum((F.col("size") == F.col("d")).cast("long")).alias("ends")))
    marked = path.join(owners, node)
    owned = F.col("owner") == F.col("c")
    # where each conversation begins to own, who owns what is above, and the code points up to there
    begins = spool(
        marked.groupBy("c").agg(
            F.coalesce(F.min(F.when(owned, F.col("d"))), F.max("d") + 1).alias("begin"),
            F.max(F.when(~owned, F.struct("d", "owner"))).getField("owner").alias("above"),
            F.coalesce(F.max(F.when(~owned, F.col("upto"))), zero).alias("unowned"),
            F.max((owned & (F.col("d") == F.col("size")) & (F.col("deepest") == F.col("d"))).cast("long")).alias("leaf"),
        )
    )
    child = ((F.col("begin") <= F.col("d") + 1) & (F.col("d") < F.col("size"))).cast("long")
    parent = F.when(F.col("d") > 0, F.when(F.col("d") > F.col("begin"), F.col("c")).otherwise(F.col("above")))
    saved = F.when(F.col("d") < F.col("begin"), F.col("unowned") - F.col("upto") + F.col("cp")).otherwise(0)
    ends = F.col("size") == F.col("d")
    sums = (
        path.join(begins, "c")
        .groupBy(*node)
        .agg(
            F.min(F.struct(F.col("c"), parent.alias("parent"))).alias("owner"),
            F.count(F.lit(1)).alias("n_convs"),
            F.sum(child).alias("n_children"),
            F.sum("leaf").alias("n_leaves"),
            F.sum(saved).alias("saved_tokens"),
            F.sum(ends.cast("long")).alias("ends"),
            F.min(F.when(ends, F.col("c"))).alias("end"),
        )
    )
    several = owners.filter("ends > 1").select(*node)
    hashed = _ends(path.filter(ends).join(several, node, "left_semi").select(*node, "c"), node)
    sha = F.when(F.col("ends") == 0, F.lit(_NONE)).when(F.col("ends") == 1, F.sha2(F.col("end").cast("string"), 256)).otherwise(F.col("sha"))
    return sums.join(hashed, node, "left").select(
        F.col("owner.c").alias("conv_id"),
        F.col("d").alias("depth"),
        F.col("owner.parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        sha.alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*shared_starts(turns(table(spark, sf_dir, "conversations"))))


def _crc32(text: str) -> str:
    """CRC-32 of a short text in SQL, bit by bit."""
    step = "list_reduce(range(8), lambda y, k: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, e))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda s: ascii(s)::BIGINT), lambda x, e: {step}, 4294967295::BIGINT), 4294967295)"


SQL = {
    "op13_prefix_trie": f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n,
         struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL),
known AS (SELECT DISTINCT c, c - c % {FAMILY} AS base, {_crc32("c::VARCHAR")} % {LENGTHS} AS h FROM t),
whole AS (
  SELECT known.c, 0 AS part, n, t FROM known JOIN t ON t.c = base AND n <= h
  UNION ALL SELECT known.c, 1, n, t FROM known JOIN t ON t.c = known.c AND n > h),
paths AS (SELECT known.c, coalesce(list(t ORDER BY part, n) FILTER (t IS NOT NULL), []) AS q FROM known LEFT JOIN whole ON whole.c = known.c GROUP BY known.c),
members AS (SELECT c, d, q[1:d] AS k, len(q) = d AS ends FROM (SELECT *, unnest(range(len(q) + 1)) AS d FROM paths)),
nodes AS (
  SELECT k, d, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS sha,
         CASE WHEN d = 0 THEN 0 ELSE length(k[d].x) END AS cp
  FROM members GROUP BY k, d),
children AS (SELECT k[1:d - 1] AS k, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT k[1:a] AS k, sum(cp * (n - 1)) AS saved, count(*) FILTER (kids = 0) AS leaves
  FROM (SELECT nodes.*, coalesce(children.n, 0) AS kids, unnest(range(d + 1)) AS a FROM nodes LEFT JOIN children USING (k)) GROUP BY 1)
SELECT nodes.c AS conv_id, nodes.d::BIGINT AS depth, up.c AS parent_conv_id, nodes.n AS n_convs, coalesce(children.n, 0) AS n_children,
       leaves AS n_leaves, saved::BIGINT AS saved_tokens, nodes.sha AS ends_sha256
FROM nodes JOIN below USING (k) LEFT JOIN children USING (k) LEFT JOIN nodes up ON nodes.d > 0 AND up.k = nodes.k[1:nodes.d - 1]"""
}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
