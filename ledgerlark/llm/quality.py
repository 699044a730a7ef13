"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of characters, trained on trusted text.

Trusted documents are those labelled good and not toxic. Four fifths of them, by a hash of the id, train: the model counts
all of them, at any input size. The last fifth, all of it, sets each language's threshold: the TAIL quantile of its log perplexities. Fewer
than ENOUGH documents have none above that quantile and don't show it; there it is the median plus SPREAD times the way from there to the
QUANTILE. A document whose perplexity is above its language's threshold is rejected.

Symbols are whole code points and n-grams have ORDER of them, in every script, so the model grows with the trusted text. Its counts
lie in Spark, dealt by language and n-gram: those of lower orders, discounts and probabilities come from them by grouping and joins. For
scoring, documents are dealt to blocks; a block's distinct n-grams are joined with the counts of each order, and the answers meet the
block's texts. Nothing of the model goes through the driver, is broadcast or lies in one task, and work is linear in the text. Within a
block n-grams are looked up by 64-bit hashes.

Short texts say little: the decision reads their perplexity as if SHRINK more characters of the language's average stood
beside them. Languages with fewer than LEAST training documents use the pooled model, those with fewer than HELD_OUT the pooled threshold.
A null or empty text has no perplexity and stays; a null language is one of its own. Without any trusted document nothing is rejected.
Repeated rows are judged alike; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from functools import cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_bitmap, prepare, slot_bitmap, small_batches, spool, table

#: Length of n-grams; an alphabet counts as so many symbols at least.
ORDER, ALPHABET = 4, 40
#: Training documents that a language with a model of its own has at least.
LEAST = 20
QUANTILE, SPREAD, SHRINK = 0.9, 6.0, 30
#: A threshold's quantile, and the held-out documents from which on it leaves one out.
TAIL, ENOUGH = 0.995, 200
#: Held-out documents that a language needs for its own threshold.
HELD_OUT = 30
POOLED = "*"
#: Bits of a code point; three of them, an n-gram's context, fit a long.
_BITS = 21
#: Characters whose n-grams a task holds at once, and bytes of text in a block.
_CHARS, _BLOCK = 1 << 19, 24 << 20


def codes(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts (three code points of 21 bits) and last symbols of the n-grams of parts of texts, as of pieces, and where each part's begin."""
    pad = ORDER - 1
    c = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    lengths = np.array([len(t) - pad for t in parts], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum(), dtype=np.int64) + np.repeat(np.arange(1, len(parts) + 1) * pad, lengths)
    context = np.zeros(len(at), dtype=np.int64)
    for k in range(pad, 0, -1):
        context = context << _BITS | c[at - k]
    return context, c[at], starts


def _hashes(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    h = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + symbol.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def distinct(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, last symbol and count of the distinct n-grams of parts of texts."""
    context, symbol, _ = codes(parts)
    own = np.unique(np.concatenate([np.frombuffer(t[: ORDER - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in parts] + [symbol]))
    if len(own) > 1 << 16:
        (context, symbol), n = np.unique(np.stack([context, symbol]), axis=1, return_counts=True)
        return context, symbol, n
    small = np.zeros(int(own[-1]) + 1, dtype=np.uint64)
    small[own] = np.arange(len(own), dtype=np.uint64)
    code, mask = small[symbol], (1 << _BITS) - 1
    for k in range(1, ORDER):
        code |= small[context >> (_BITS * (k - 1)) & mask] << np.uint64(16 * k)
    code, n = np.unique(code, return_counts=True)
    back = [own[(code >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64)] for k in range(ORDER)]
    context = np.zeros(len(code), dtype=np.int64)
    for k in range(ORDER - 1, 0, -1):
        context = context << _BITS | back[k]
    return context, back[0], n


def pieces(texts: Iterable[str]) -> Iterator[tuple[list[int], list[str]]]:
    """The texts that aren't empty, about _CHARS characters at a time: their numbers, and the texts after line ends. Of a longer one each part repeats the last part's end."""
    pad, owners, held, size = ORDER - 1, [], [], 0
    for i, t in enumerate(texts):
        whole = "\n" * pad + t
        for at in range(0, len(t), _CHARS):
            part = whole[at : at + _CHARS + pad]
            if held and size + len(part) > _CHARS:
                yield owners, held
                owners, held, size = [], [], 0
            owners.append(i)
            held.append(part)
            size += len(part)
    if held:
        yield owners, held


def trusted(labels: DataFrame) -> DataFrame:
    """id and fold of the trusted documents. Fold 0 sets thresholds, the others train."""
    good = labels.filter("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    return good.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(5)))


class Model(NamedTuple):
    """Kneser-Ney's terms in Spark. own: l, languages with a model of their own. terms: l, k (order), context, symbol and v: the share that an
    n-gram's count has in its context's, less the discount; with symbol -1 the share that is cut off there. bases: l, base: what any symbol gets."""

    own: DataFrame
    terms: DataFrame
    bases: DataFrame


def count(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[DataFrame, DataFrame] | None:
    """own (l) and the n-gram counts of all trusted documents that train, by language with a model of its own and POOLED: l, context, symbol, n. None without such documents."""
    prepare(docs.sparkSession)
    ids = spool(trusted(labels).filter("fold > 0").select("id"))
    short = F.xxhash64(F.col("id").cast("string"))
    bitmap = docs.sparkSession.sparkContext.broadcast(slot_bitmap(ids.select(short.alias("h")), "h"))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(bitmap.value, h.to_numpy(np.int64)))

    # The bitmap spares most other texts the shuffle; the join decides.
    learnt = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.coalesce(F.col(lang), F.lit("")).alias("l")).filter(maybe(short))
    learnt = learnt.join(ids.hint("shuffle_hash"), "id", "left_semi").select("l", "t")

    def count_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list[str]] = {}
        waiting = 0

        def told():
            for name, texts in held.items():
                yield pd.DataFrame({"l": [name], "context": [-1], "symbol": [-1], "n": [len(texts)]})  # documents
                for _, part in pieces(texts):
                    context, symbol, n = distinct(part)
                    for i in range(0, len(n), 100_000):
                        yield pd.DataFrame({"l": name, "context": context[i : i + 100_000], "symbol": symbol[i : i + 100_000], "n": n[i : i + 100_000]})
            held.clear()

        for batch in batches:
            for t, name in zip(batch["t"], batch["l"], strict=True):
                held.setdefault(name, []).append(t)
                waiting += len(t)
                if waiting >= _CHARS:
                    yield from told()
                    waiting = 0
        yield from told()

    rows = spool(learnt.mapInPandas(count_, "l string, context long, symbol int, n long").groupBy("l", "context", "symbol").agg(F.sum("n").alias("n")))
    sizes = rows.filter("symbol = -1")
    if sizes.isEmpty():
        return None
    own = spool(sizes.filter((F.col("n") >= LEAST) & (F.col("l") != POOLED)).select("l"))
    grams = rows.filter("symbol >= 0")
    pooled = grams.groupBy("context", "symbol").agg(F.sum("n").alias("n")).select(F.lit(POOLED).alias("l"), "context", "symbol", "n")
    return own, grams.join(own, "l", "left_semi").select("l", "context", "symbol", "n").unionByName(pooled)


def train(own: DataFrame, counts: DataFrame) -> Model:
    """Modified Kneser-Ney: orders below the highest count the distinct symbols before an n-gram; three discounts for each order and language."""
    at = [counts.withColumn("k", F.lit(ORDER))]
    for k in range(ORDER - 1, 0, -1):
        shorter = F.col("context").bitwiseAND(F.lit((1 << _BITS * (k - 1)) - 1)).alias("context")
        at.append(at[-1].groupBy("l", shorter, "symbol").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(k)))
    every = spool(reduce(DataFrame.unionByName, at))
    seen = [F.count_if(F.col("n") == i).alias(f"m{i}") for i in (1, 2, 3, 4)]
    marks = every.groupBy("l", "k").agg(*seen).withColumn("y", F.col("m1") / F.greatest(F.col("m1") + 2 * F.col("m2"), F.lit(1)))
    cut = lambda i: F.when(F.col(f"m{i}") > 0, F.least(F.greatest(F.lit(float(i)) - (i + 1) * F.col("y") * F.col(f"m{i + 1}") / F.col(f"m{i}"), F.lit(0.1)), F.lit(float(i)))).otherwise(0.5)
    cuts = spool(marks.select("l", "k", *[cut(i).alias(f"d{i}") for i in (1, 2, 3)]))
    sums = every.groupBy("l", "k", "context").agg(F.sum("n").alias("total"), *[F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2)], F.count_if(F.col("n") > 2).alias("n3"))
    sums = spool(sums.join(cuts, ["l", "k"]).select("l", "k", "context", "total", ((F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("total")).alias("spare")))
    off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    shares = every.join(cuts, ["l", "k"]).join(sums, ["l", "k", "context"]).select("l", "k", "context", "symbol", ((F.col("n") - off) / F.col("total")).alias("v"))
    spares = sums.filter("k > 1").select("l", "k", "context", F.lit(-1).alias("symbol"), F.col("spare").alias("v"))
    symbols = every.filter("k = 1").groupBy("l").agg(F.greatest(F.count(F.lit(1)) + 1, F.lit(ALPHABET)).alias("size"))
    bases = spool(sums.filter("k = 1").join(symbols, "l").select("l", (F.col("spare") / F.col("size")).alias("base")))
    return Model(own, spool(shares.unionByName(spares)), bases)


def probabilities(wanted: DataFrame, model: Model) -> DataFrame:
    """l, context, symbol, logp of distinct n-grams: each looks up its share, and its context's spare, at every order."""
    parts = []
    for k in range(ORDER, 0, -1):
        context = F.col("context").bitwiseAND(F.lit((1 << _BITS * (k - 1)) - 1))
        parts.append(F.struct(F.lit(k).alias("k"), context.alias("c"), F.col("symbol").alias("s")))
        if k > 1:
            parts.append(F.struct(F.lit(k).alias("k"), context.alias("c"), F.lit(-1).alias("s")))
    asked = wanted.select("l", "context", "symbol", F.explode(F.array(*parts)).alias("a")).select("l", "context", "symbol", F.col("a.k").alias("k"), F.col("a.c").alias("c"), F.col("a.s").alias("s"))
    terms = model.terms.select("l", "k", F.col("context").alias("c"), F.col("symbol").alias("s"), "v")
    share = lambda k: F.coalesce(F.max(F.when((F.col("k") == k) & (F.col("s") >= 0), F.col("v"))), F.lit(0.0)).alias(f"a{k}")
    spare = lambda k: F.coalesce(F.max(F.when((F.col("k") == k) & (F.col("s") < 0), F.col("v"))), F.lit(1.0)).alias(f"g{k}")
    met = asked.join(terms, ["l", "k", "c", "s"], "left").groupBy("l", "context", "symbol").agg(*[share(k) for k in range(1, ORDER + 1)], *[spare(k) for k in range(2, ORDER + 1)])
    p = F.col("a1") + F.coalesce("base", F.lit(1.0 / ALPHABET))  # a language without a single character knows nothing
    for k in range(2, ORDER + 1):
        p = F.col(f"a{k}") + F.col(f"g{k}") * p
    return met.join(model.bases, "l", "left").select("l", "context", "symbol", F.log(p).alias("logp"))


_PACKED = "id string, l string, mark long, name string, block int, n long, z binary"
_SCORED = "id string, l string, mark long, loss double, n long"


def _texts(packed: pd.Series) -> Iterator[str]:
    return (zlib.decompress(z).decode("utf-8", "surrogatepass") for z in packed)


def _asked(group: pd.DataFrame) -> pd.DataFrame:
    """The distinct n-grams of a block."""
    found = [distinct(part)[:2] for _, part in pieces(_texts(group["z"]))]
    context, symbol = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    _, first = np.unique(_hashes(context, symbol), return_index=True)
    return pd.DataFrame({"name": group["name"].iloc[0], "block": group["block"].iloc[0], "context": context[first], "symbol": symbol[first]})


def _told(group: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The losses of a block's texts, from the answers for its n-grams."""
    keys = _hashes(answers["context"].to_numpy(np.int64), answers["symbol"].to_numpy(np.int64))
    order = np.argsort(keys)
    keys, logp = keys[order], answers["logp"].to_numpy(np.float64)[order]
    loss = np.zeros(len(group))
    for owners, part in pieces(_texts(group["z"])):
        context, symbol, starts = codes(part)
        wanted = _hashes(context, symbol)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        if not len(keys) or (keys[at] != wanted).any():
            raise RuntimeError("a block's n-grams are without an answer")
        np.subtract.at(loss, owners, np.add.reduceat(logp[at], starts))
    return pd.DataFrame({"id": group["id"], "l": group["l"], "mark": group["mark"], "loss": loss, "n": group["n"]})


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """id, l (language, never null), mark (a hash of the text), loss, n (characters)."""
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    bare = docs.select(F.col(key).cast("string").alias("id"), F.coalesce(F.col(lang), F.lit("")).alias("l"), F.xxhash64(F.col(text)).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = bare.agg(F.sum(F.octet_length("t")).alias("n")).collect()[0]["n"] or 0
    named = bare.filter("t <> ''").join(model.own.select("l", F.col("l").alias("name")), "l", "left")
    named = named.select("id", "l", "mark", F.coalesce("name", F.lit(POOLED)).alias("name"), F.pmod(F.xxhash64("id", "mark"), F.lit(size // _BLOCK + 1)).cast("int").alias("block"), F.length("t").cast("long").alias("n"), "t")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="t").assign(z=[zlib.compress(t.encode("utf-8", "surrogatepass"), 1) for t in b["t"]])

    packed = named.mapInPandas(pack, _PACKED)
    asked = spool(packed.groupBy("name", "block").applyInPandas(_asked, "name string, block int, context long, symbol int"))
    known = probabilities(asked.select(F.col("name").alias("l"), "context", "symbol").distinct(), model).withColumnRenamed("l", "name")
    answers = spool(asked.join(known, ["name", "context", "symbol"]).select("name", "block", "context", "symbol", "logp"))
    told = spool(packed.groupBy("name", "block").cogroup(answers.groupBy("name", "block")).applyInPandas(_told, _SCORED))
    empty = bare.filter("t = ''").select("id", "l", "mark", F.lit(0.0).alias("loss"), F.lit(0).cast("long").alias("n"))
    return told.unionByName(empty).withColumn("id", F.col("id").cast(kind))


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", quantile: float = QUANTILE) -> DataFrame:
    """One row for each document: id, l, mark, n, perplexity, threshold (of the shrunken perplexity, as it was compared), kept."""
    with small_batches(docs.sparkSession):
        return _judge(docs, labels, text, lang, key, quantile)


def _judge(docs: DataFrame, labels: DataFrame, text: str, lang: str, key: str, quantile: float) -> DataFrame:
    counts = count(docs, labels, text, lang, key)
    if counts is None:
        bare = docs.select(F.col(key).alias("id"), F.coalesce(F.col(lang), F.lit("")).alias("l"), F.xxhash64(F.col(text)).alias("mark"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n"))
        return bare.withColumns({"perplexity": F.lit(None).cast("double"), "threshold": F.lit(None).cast("double"), "kept": F.lit(True)})
    scores = score(docs, train(*counts), text, lang, key)
    held = scores.filter("n > 0").join(trusted(labels).filter("fold = 0").select("id"), "id", "left_semi")
    held = spool(held.select("l", "loss", "n"))
    means = held.groupBy("l").agg((F.sum("loss") / F.sum("n")).alias("mean"), F.count(F.lit(1)).alias("size"))
    every = held.agg((F.sum("loss") / F.sum("n")).alias("all_mean"))
    shrunken = (F.col("loss") + SHRINK * F.col("mean")) / (F.col("n") + SHRINK)
    marks = F.percentile_approx("x", [0.5, quantile, TAIL], 10_000)
    guess = F.element_at(marks, 1) + SPREAD * (F.element_at(marks, 2) - F.element_at(marks, 1))
    limit = F.when(F.count(F.lit(1)) >= ENOUGH, F.element_at(marks, 3)).otherwise(guess)
    ranged = held.join(means, "l").withColumn("x", shrunken)
    of_lang = ranged.groupBy("l").agg(limit.alias("limit"), F.first("mean").alias("mean"), F.first("size").alias("size"))
    whole = ranged.agg(limit.alias("all_limit"))
    limits = of_lang.filter(F.col("size") >= HELD_OUT).select("l", "mean", "limit")
    pooled_mean = float(every.collect()[0][0] or 0.0)  # one row
    pooled_limit = whole.collect()[0][0]
    pooled_limit = math.inf if pooled_limit is None else float(pooled_limit)
    judged = scores.join(limits, "l", "left").withColumns({"mean": F.coalesce("mean", F.lit(pooled_mean)), "limit": F.coalesce("limit", F.lit(pooled_limit))})
    return judged.select(
        "id", "l", "mark", "n",
        F.when(F.col("n") > 0, F.exp(F.col("loss") / F.col("n"))).alias("perplexity"),
        F.exp("limit").alias("threshold"),
        ((F.col("n") == 0) | (shrunken <= F.col("limit"))).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """docs without the rejected ones."""
    bad = judge(docs, labels, text, lang, key).filter("NOT kept").select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("a"), "mark", "l").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("a"), F.xxhash64(F.col(text)).alias("mark"), F.coalesce(F.col(lang), F.lit("")).alias("l"))
    return rows.join(bad, ["a", "mark", "l"], "left_anti").select("row.*")


# The same model as dense tables over classes of characters: for small alphabets only. The operator doesn't use it; tests hold the model above against it.
NAMED = 32
CLASSES = 8
SHAPES, COVER = ((ORDER, ALPHABET), (3, 136), (2, 1600)), 0.75
LANGUAGES = 16
_CHUNK = 1 << 18


@cache
def _kinds() -> np.ndarray:
    kinds = (str.isupper, str.islower, str.isalpha, str.isdigit)
    out = np.full(0x10000, 7, dtype=np.int32)
    for i in range(0x10000):
        c = chr(i)
        out[i] = next((k for k, f in enumerate(kinds, 1) if f(c)), 5 if c == "\n" else 6 if c.isspace() else 7)
    return out


def class_table(named: str) -> np.ndarray:
    """Classes by code point up to U+FFFF; the characters beyond share the last entry's."""
    out = _kinds().copy()
    for k, c in enumerate(named):
        if ord(c) < 0x10000:
            out[ord(c)] = CLASSES + k
    return out


class Script(NamedTuple):
    """A language's named characters, most frequent first, the order of its n-grams and its number of symbols."""

    named: str
    order: int = ORDER
    alphabet: int = ALPHABET


def script(chars: list[tuple[str, int]], total: int) -> Script:
    """The script of a language, from its most frequent characters with their counts and the count of all its characters."""
    for order, alphabet in SHAPES:
        own = chars[: alphabet - CLASSES]
        if sum(n for _, n in own) >= COVER * total:
            break
    return Script("".join(c for c, _ in own), order, alphabet)


def ngrams(text: str, classes: np.ndarray, order: int = ORDER, alphabet: int = ALPHABET) -> Iterator[np.ndarray]:
    """Codes of a text's n-grams, a part at a time; a text starts after line ends."""
    text = "\n" * (order - 1) + text
    for at in range(0, len(text) - order + 1, _CHUNK):
        part = text[at : at + _CHUNK + order - 1].encode("utf-32-le", "surrogatepass")
        c = classes[np.minimum(np.frombuffer(part, dtype="<u4"), 0xFFFF)]
        n = len(c) - order + 1
        code = c[:n].copy()
        for k in range(1, order):
            code = code * alphabet + c[k : k + n]
        yield code


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the last symbol after the others: counts has one axis per symbol. Three discounts per order."""
    orders = [counts]
    while orders[-1].ndim > 1:
        orders.append((orders[-1] > 0).sum(0))
    p = np.full(counts.shape[0], 1 / counts.shape[0])
    for c in reversed(orders):
        c = c.astype(np.float64)
        n1, n2, n3, n4 = ((c == k).sum() for k in (1, 2, 3, 4))
        y = n1 / max(n1 + 2 * n2, 1)
        cut = [k - (k + 1) * y * b / a if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = [min(max(x, 0.1), k) for k, x in enumerate(cut, 1)]
        off = np.select([c >= 3, c == 2, c == 1], [cut[2], cut[1], cut[0]], 0.0)
        total = c.sum(-1, keepdims=True)
        spare = np.where(total > 0, off.sum(-1, keepdims=True) / np.maximum(total, 1), 1.0)
        p = np.maximum(c - off, 0) / np.maximum(total, 1) + spare * p
    return np.log(p)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(F.col("id").alias("doc_id"), F.col("l").alias("lang"), F.col("n").alias("n_chars"), "perplexity", "threshold", "kept")


QUERIES = {"op8_quality": op8_quality}
