"""Line deduplication by a log-template tree.

A line's tokens lead down a tree of fixed depth: the token count, then the first DEPTH tokens, in which anything with a
digit counts as a variable. The leaf generalises what is left: in a leaf, a token at a position is constant if at least
MIN_DOCUMENTS documents have it there, and variable if not. A line's template is its leaf with the constants; a template
is a candidate if at least half of its tokens are constant and it occurs in at least MIN_DOCUMENTS documents. A line's
surroundings are the nearest lines before and after that are neither blank nor of a candidate, so the lines of a repeated
block share what stands outside the block. A candidate is recurring if it has at least MIN_DOCUMENTS different surroundings.

Copies must not count as surroundings. Those of exact copies are the same. Documents that are at least MOSTLY candidates' lines
may be near copies: they count as one for each least hash of a candidate in them, which near copies share whichever lines
differ. If they are less than NEARLY that, and those with exactly the same candidates have at least half of the template's
surroundings in such documents, they are carriers of one block and their surroundings count: near copies differ in which lines
were changed. Lines of recurring templates are dropped.

A document of which nothing but blank lines would stay is left whole; any other loses all its recurring lines, however few others
it has: templates that only copies hold aren't recurring. Lines are split at line feeds; blank lines have no template and stay. A null text
stays null and an empty one empty. Repeated rows count as one document and are treated alike; an empty table gives an empty
result; other columns stay as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_bitmap, prepare, slot_bitmap, spool, table

DEPTH, MIN_DOCUMENTS = 3, 10
#: Shares of a document's characters in candidates' lines: above the first it may be a near copy, above the second it is taken for one.
MOSTLY, NEARLY = 0.5, 0.8
VARIABLE = "\x00"
#: A line, or several, without any token.
BLANK = r"(?U)^[\s\x1c-\x1f]*$"

_DIGIT = re.compile(r"\d")


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def tokens(line: str) -> list[str]:
    """The masked tokens of a line."""
    out = line.split()
    if _DIGIT.search(line):
        out = [VARIABLE if _DIGIT.search(t) else t for t in out]
    return out


def leaf(masked: list[str]) -> int:
    return _hash(f"{len(masked)}\x01" + "\x01".join(masked[:DEPTH]))


def _leaves(text: str) -> list[tuple[int, int, list[str]]]:
    """Leaf, line number and masked tokens of each line that has any."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if masked := tokens(line):
            out.append((leaf(masked), i, masked))
    return out


def _documents(docs: DataFrame, text: str, key: str) -> DataFrame:
    """What names a row: its id and a hash of its text. Rows that agree in both are one document."""
    return docs.select(*_names(text, key), F.col(text).alias("t")).filter("length(t) > 0")


def _names(text: str, key: str) -> list:
    own = F.col(key).cast("string")
    return [F.xxhash64(own, F.col(text)).alias("a"), F.hash(F.col(text), own).cast("long").alias("b")]


def recurring_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """a, b (the document), lines: the numbers of its lines that belong to recurring templates. Documents without any are left out."""
    prepare(docs.sparkSession)
    named = _documents(docs, text, key)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(x, a) for a, t in zip(batch["a"], batch["t"], strict=True) for x in {x for x, _, _ in _leaves(t)}]
            yield pd.DataFrame(out, columns=["leaf", "a"], dtype="int64")

    counts = named.select("a", "t").mapInPandas(first, "leaf long, a long").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.min("a").alias("least"), F.max("a").alias("most"))
    full = spool(counts.filter((F.col("n") >= min_documents) & (F.col("least") != F.col("most"))).select("leaf"))
    bitmap = docs.sparkSession.sparkContext.broadcast(slot_bitmap(full, "leaf"))

    def second(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, t in zip(batch["a"], batch["b"], batch["t"], strict=True):
                found = _leaves(t)
                if not found:
                    continue
                some = in_bitmap(bitmap.value, np.array([x for x, _, _ in found], dtype=np.int64))
                if some.any():
                    for (x, i, masked), hit in zip(found, some, strict=True):
                        if hit:
                            out.append((a, b, x, _hash("\x01".join(masked)), i, masked))
            yield pd.DataFrame(out, columns=["a", "b", "leaf", "line", "i", "masked"]).astype({c: "int64" for c in ("a", "b", "leaf", "line", "i")})

    lines = spool(named.mapInPandas(second, "a long, b long, leaf long, line long, i long, masked array<string>").join(full, "leaf", "left_semi"))
    # One row for each different line; what it weighs is the number of its documents.
    ones = lines.groupBy("leaf", "line", "a").agg(F.first("masked").alias("masked")).groupBy("leaf", "line").agg(F.first("masked").alias("masked"), F.count(F.lit(1)).alias("n"))
    ones = spool(ones)
    placed = ones.select("leaf", "line", "n", F.size("masked").alias("size"), F.posexplode("masked").alias("p", "token"))
    constant = placed.filter(F.col("token") != VARIABLE).groupBy("leaf", "p", "token").agg(F.sum("n").alias("docs")).filter(F.col("docs") >= min_documents).select("leaf", "p", "token")
    known = placed.join(constant, ["leaf", "p", "token"]).groupBy("leaf", "line").agg(F.sort_array(F.collect_list(F.struct("p", "token"))).alias("held"), F.first("size").alias("size"))
    # Written, so that Spark can split a line that very many documents hold.
    templates = spool(known.filter(F.size("held") * 2 >= F.col("size")).select("leaf", "line", F.xxhash64("leaf", F.to_json("held")).alias("template")))
    used = spool(lines.select("a", "b", "leaf", "line", "i").join(templates, ["leaf", "line"]).select("a", "b", "i", "template"))
    documents = spool(used.groupBy("template", "a").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_documents).select("template"))
    used = spool(used.join(documents, "template", "left_semi"))
    both = spool(_carried(named, used, min_documents))
    return used.join(both, "template", "left_semi").groupBy("a", "b").agg(F.sort_array(F.collect_set(F.col("i").cast("int"))).alias("lines"))


def _carried(named: DataFrame, used: DataFrame, min_documents: int) -> DataFrame:
    """template: those of candidates' lines, used, that have enough surroundings."""
    every = F.split("t", "\n")
    shown = named.select("a", "b", F.transform(every, lambda x: F.when(~F.rlike(x, F.lit(BLANK)), F.xxhash64(x))).alias("hashes"), F.transform(every, F.length).alias("sizes"))
    held = used.groupBy("a", "b").agg(F.collect_set(F.struct("i", "template")).alias("held"))
    held = held.select("a", "b", F.col("held.i").alias("at"), F.col("held.template").alias("templates"))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for hashes, sizes, at, templates in zip(batch["hashes"], batch["sizes"], batch["at"], batch["templates"], strict=True):
                out += _evidence(list(hashes), list(sizes), dict(zip(at, templates, strict=True)))
            yield pd.DataFrame(out, columns=["template", "held", "mid", "value"]).astype({"template": "int64", "held": "int64", "mid": "bool", "value": "int64"})

    texts = shown.join(held, ["a", "b"]).select(F.transform("hashes", lambda x: x.cast("string")).alias("hashes"), "sizes", "at", "templates")
    seen = texts.mapInPandas(look, "template long, held long, mid boolean, value long").distinct()
    counts = seen.groupBy("template", "held", "mid").agg(F.count(F.lit(1)).alias("n"))
    light, mostly = F.col("held") == 0, F.col("held") != 0
    counts = counts.groupBy("template").agg(F.max(F.when(light, F.col("n"))).alias("apart"), F.max(F.when(F.col("mid"), F.col("n"))).alias("block"), F.sum(F.when(mostly, F.col("n"))).alias("all"))
    return counts.filter((F.col("apart") >= min_documents) | ((F.col("block") >= min_documents) & (F.col("block") * 2 >= F.col("all")))).select("template")


def _evidence(hashes: list, sizes: list, held: dict[int, int]) -> set[tuple[int, int, bool, int]]:
    """What a document says of its candidates: template, 0 or the hash of all its candidates, whether they are less than NEARLY all, and
    what counts once. hashes has a line's hash, None for blank ones; held the candidates by line."""
    lines = [j for j, x in enumerate(hashes) if x is not None]
    sides: dict[int, list[str]] = {j: [] for j in held}
    for order in (lines, lines[::-1]):
        last = "\x02"
        for j in order:
            if j in sides:
                sides[j].append(last)
            else:
                last = hashes[j]
    around = {(t, _hash("\x01".join(sides[j]))) for j, t in held.items()}
    share = sum(sizes[j] for j in held) / max(sum(sizes[j] for j in lines), 1)
    if share < MOSTLY:
        return {(t, 0, False, x) for t, x in around}
    all_, least = sorted(set(held.values())), min(held.values())
    code = _hash(repr(all_)) or 1
    return {(t, code, share < NEARLY, x) for t, x in around} | {(t, 0, False, least) for t in all_}


def drop_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """docs with their texts less the recurring lines, and _lines: how many there were, _dropped: the numbers of those dropped."""
    found = spool(recurring_lines(docs, text, key, min_documents))
    # Only the row itself goes through the join's shuffle; its text is taken from it and split afterwards.
    joined = docs.select(F.struct("*").alias("row"), *_names(text, key)).join(found, ["a", "b"], "left")
    joined = joined.select("row", "lines", F.col(f"row.`{text}`").alias("t"), F.split(F.col(f"row.`{text}`"), "\n").alias("all"))
    rest = F.array_join(F.filter("all", lambda _, i: ~F.array_contains(F.col("lines"), i)), "\n")
    joined = joined.withColumn("rest", F.when(F.col("lines").isNotNull(), rest))
    joined = joined.withColumn("whole", F.col("rest").isNull() | F.rlike("rest", F.lit(BLANK)))
    held = [F.when(F.col("whole"), F.col("t")).otherwise(F.col("rest")).alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*held, F.size("all").alias("_lines"), F.when(F.col("whole"), F.array().cast("array<int>")).otherwise(F.col("lines")).alias("_dropped"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs)
    return out.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.col("_lines")).cast("long").alias("n_lines"), F.size("_dropped").cast("long").alias("n_dropped"), F.array_join(F.col("_dropped").cast("array<string>"), ",").alias("dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


QUERIES = {"op2_line_dedup": op2_line_dedup}
