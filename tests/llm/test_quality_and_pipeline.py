import collections
import math
import random
import re

import numpy as np
from oracle import SMALL

from ledgerlark.llm import quality as Q


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 4, (6, 6, 6)) * (rng.random((6, 6, 6)) < 0.3)
    p = np.exp(Q.kneser_ney(counts))
    assert np.allclose(p.sum(-1), 1) and (p > 0).all()
    assert np.allclose(np.exp(Q.kneser_ney(np.zeros((4, 4), dtype=int))), 0.25)


def test_interpolation_by_hand():
    """Two symbols, counts 3 and 1 after the first: what is cut off goes to the lower order."""
    c = np.array([[3, 1], [0, 0]])
    p = np.exp(Q.kneser_ney(c))
    low = np.exp(Q.kneser_ney((c > 0).sum(0)))
    n1, n2, n3, n4 = 1, 0, 1, 0
    y = n1 / (n1 + 2 * n2)
    d1, d3 = min(max(1 - 2 * y * n2 / n1, 0.1), 1), min(max(3 - 4 * y * n4 / n3, 0.1), 3)
    assert np.allclose(p[0], [(3 - d3) / 4 + (d1 + d3) / 4 * low[0], (1 - d1) / 4 + (d1 + d3) / 4 * low[1]]) and np.allclose(p[1], low)


def test_long_texts_in_parts(monkeypatch):
    classes, text = Q.class_table("abc"), "abca bd\n" * 50
    whole = np.concatenate(list(Q.ngrams(text, classes)))
    monkeypatch.setattr(Q, "_CHUNK", 7)
    assert (np.concatenate(list(Q.ngrams(text, classes))) == whole).all() and len(whole) == len(text)


def plain_kneser_ney(texts, classes):
    """log p(last | first three) by dictionaries, straight from the formula."""
    orders = [collections.Counter()]
    for t in texts:
        c = [int(classes[min(ord(x), 0xFFFF)]) for x in "\n" * 3 + t]
        orders[0].update(tuple(c[i : i + 4]) for i in range(len(c) - 3))
    while len(next(iter(orders[-1]))) > 1:
        orders.append(collections.Counter(g[1:] for g in orders[-1]))
    cuts, totals, spare = [], [], []
    for c in orders:
        n = [0, *(sum(x == k for x in c.values()) for k in (1, 2, 3, 4))]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5, 0.1), k) for k in (1, 2, 3)]
        total, off = collections.Counter(), collections.Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            off[g[:-1]] += d[min(x, 3) - 1]
        cuts.append(d)
        totals.append(total)
        spare.append(off)

    def p(g, at=0):
        if at == len(orders):
            return 1 / Q.ALPHABET
        total, x = totals[at][g[:-1]], orders[at][g]
        low = p(g[1:], at + 1)
        if not total:
            return low
        return (x - cuts[at][min(x, 3) - 1] if x else 0) / total + spare[at][g[:-1]] / total * low

    return p


def test_against_a_plain_recomputation(spark, monkeypatch):
    """Perplexities, thresholds and verdicts of two languages, from the labels on."""
    monkeypatch.setattr(Q, "LEAST", 5)
    monkeypatch.setattr(Q, "HELD_OUT", 3)
    rng = random.Random(4)
    words = {"aa": ["tree", "house", "Rain", "42", "so,", "é"], "bb": ["katz", "maus", "und", "Zug.", "7", "ß"]}
    docs = [(i, " ".join(rng.choices(words[l], k=rng.randint(3, 30))) + ("\n" + "%#" * 9 if i % 17 == 0 else ""), l) for i, l in enumerate(["aa", "bb"] * 60)]
    labels = [(i, int(i % 17 != 0), 0) for i, _, _ in docs if i % 3]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fold = {r["id"]: r["fold"] for r in Q.trusted(marks).collect()}
    want = {}
    for lang in words:
        train = [t for i, t, l in docs if l == lang and fold.get(i, 0) > 0]
        named = "".join(c for c, _ in sorted(collections.Counter("".join(train)).items(), key=lambda x: (-x[1], x[0]))[: Q.NAMED])
        classes = Q.class_table(named)
        p = plain_kneser_ney(train, classes)
        loss = {}
        for i, t, l in docs:
            if l == lang:
                c = [int(classes[min(ord(x), 0xFFFF)]) for x in "\n" * 3 + t]
                loss[i] = (-sum(math.log(p(tuple(c[k : k + 4]))) for k in range(len(t))), len(t))
        held = [i for i in loss if fold.get(i) == 0]
        mean = sum(loss[i][0] for i in held) / sum(loss[i][1] for i in held)
        shrunken = {i: (x + Q.SHRINK * mean) / (n + Q.SHRINK) for i, (x, n) in loss.items()}
        half, most = (sorted(shrunken[i] for i in held)[math.ceil(q * len(held)) - 1] for q in (0.5, Q.QUANTILE))
        limit = half + Q.SPREAD * (most - half)
        want |= {i: (math.exp(loss[i][0] / loss[i][1]), math.exp(limit), shrunken[i] <= limit + 1e-6) for i in loss}
    got = {r["id"]: r for r in Q.judge(frame, marks).collect()}
    assert set(got) == set(want) and not all(w[2] for w in want.values())
    for i, (perplexity, threshold, kept) in want.items():
        assert math.isclose(got[i]["perplexity"], perplexity, rel_tol=1e-4) and math.isclose(got[i]["threshold"], threshold, rel_tol=1e-4)
        assert got[i]["kept"] == kept or abs(got[i]["threshold"] - threshold) < 1e-3


def plain_points(texts):
    """-log p of a text by dictionaries, over whole code points of any number."""
    grams = collections.Counter(w[i : i + 4] for t in texts for w in ["\n\n\n" + t] for i in range(len(t)))
    orders = [grams]
    while len(next(iter(orders[-1]))) > 1:
        orders.append(collections.Counter(g[1:] for g in orders[-1]))
    size = max(len(orders[-1]) + 1, Q.ALPHABET)
    levels = []
    for c in orders:
        n = [0, *(sum(x == k for x in c.values()) for k in (1, 2, 3, 4))]
        y = n[1] / max(n[1] + 2 * n[2], 1)
        d = [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5, 0.1), k) for k in (1, 2, 3)]
        total, off = collections.Counter(), collections.Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            off[g[:-1]] += d[min(x, 3) - 1]
        levels.append((c, d, total, off))

    def p(g, at=0):
        if at == len(levels):
            return 1 / size
        c, d, total, off = levels[at]
        if not total[g[:-1]]:
            return p(g[1:], at + 1)
        return (c[g] - d[min(c[g], 3) - 1] if g in c else 0) / total[g[:-1]] + off[g[:-1]] / total[g[:-1]] * p(g[1:], at + 1)

    return lambda t: -sum(math.log(p(("\n\n\n" + t)[i : i + 4])) for i in range(len(t)))


def test_whole_code_points(spark, monkeypatch):
    """300 characters, some beyond U+FFFF and a half of a pair of none: every one is a symbol of its own, in 4-grams, in blocks and parts of any size; the pooled model too."""
    monkeypatch.setattr(Q, "LEAST", 5)
    rng = random.Random(3)
    chars = [chr(0x4E00 + i) for i in range(250)] + [chr(0x20000 + i) for i in range(50)]
    words = ["".join(rng.choices(chars, k=3)) for _ in range(150)]
    docs = [(i, "".join(rng.choices(words, k=rng.randint(1, 20))), "zh" if i % 20 else "few") for i in range(80)] + [(100, "\U0002F800x\nA", "zh"), (101, "", "zh"), (102, None, None), (103, words[0] * 3, None), (103, words[0] * 3, None)]
    frame, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in range(80)], "doc_id long, quality int, toxic int")
    learns = {r["id"] for r in Q.trusted(marks).filter("fold > 0").collect()}
    own, pooled = plain_points([t for i, t, l in docs if i in learns and l == "zh"]), plain_points([t for i, t, _ in docs if i in learns])
    monkeypatch.setattr(Q, "_BLOCK", 2000)
    counts = Q.count(frame, marks)
    got = Q.score(frame, Q.train(*counts)).collect()
    assert sorted(r["id"] for r in got) == sorted(i for i, _, _ in docs)
    texts = {i: (t or "", l) for i, t, l in docs}
    for r in got:
        t, l = texts[r["id"]]
        assert r["n"] == len(t) and math.isclose(r["loss"], (own if l == "zh" else pooled)(t), rel_tol=1e-9, abs_tol=1e-9), r


def test_thresholds_are_quantiles(spark, monkeypatch, tmp_path):
    """The pipeline's stage, without dense tables: what it keeps follows from each language's own quantile, or two of them where held-out documents are few."""
    import corpus_pipeline as C

    def never(*_):
        raise AssertionError("a dense table")

    for name, value in {"LEAST": 5, "HELD_OUT": 3, "TAIL": 0.95, "ENOUGH": 20, "kneser_ney": never, "class_table": never}.items():
        monkeypatch.setattr(Q, name, value, raising=False)
    rng = random.Random(9)
    words = {"aa": ["tree", "house", "rain", "so,", "é"], "bb": ["katz", "maus", "und", "zug."]}
    docs = [(i, " ".join(rng.choices(words[l], k=rng.randint(5, 30))) + " x#" * rng.choice([0, 0, 0, 1, 2, 4]), l) for i, l in enumerate(["aa"] * 240 + ["bb"] * 60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = frame.filter("doc_id % 6 > 0").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    fold = {r["id"]: r["fold"] for r in Q.trusted(marks).collect()}
    want, sizes = set(), {}
    for lang in words:
        loss = plain_points([t for i, t, l in docs if l == lang and fold.get(i, 0) > 0])
        own = {i: (loss(t), len(t)) for i, t, l in docs if l == lang}
        held = [i for i in own if fold.get(i) == 0]
        mean = sum(own[i][0] for i in held) / sum(own[i][1] for i in held)
        x = {i: (a + Q.SHRINK * mean) / (n + Q.SHRINK) for i, (a, n) in own.items()}
        half, most, tail = (sorted(x[i] for i in held)[math.ceil(q * len(held)) - 1] for q in (0.5, Q.QUANTILE, 0.95))
        limit = tail if len(held) >= 20 else half + Q.SPREAD * (most - half)
        want |= {i for i in own if x[i] <= limit + 1e-9}
        sizes[lang] = len(held), len([i for i in held if i not in want])
    assert sizes["aa"][0] >= 20 and sizes["aa"][1] >= 1 and 3 <= sizes["bb"][0] < 20
    assert {r["doc_id"] for r in C.good(spark, frame, str(tmp_path)).collect()} == want


def test_parts_of_long_texts(monkeypatch):
    """A long text in parts has the n-grams that it has as a whole; so have texts of more than 65,536 different characters."""
    texts = ["abca bd\n" * 50, "", "x", "\ud800\U0010ffff" * 9]
    grams = lambda: collections.Counter(
        {(c, s): n for _, part in Q.pieces(texts) for c, s, n in zip(*(x.tolist() for x in Q.distinct(part)), strict=True)}
    )
    whole = grams()
    assert sum(whole.values()) == sum(map(len, texts)) and whole[(97 << 42 | 98 << 21 | 99, 97)] == 50
    monkeypatch.setattr(Q, "_CHARS", 7)
    sums = collections.Counter()
    for _, part in Q.pieces(texts):
        for c, s, n in zip(*(x.tolist() for x in Q.distinct(part)), strict=True):
            sums[c, s] += n
    assert sums == whole
    monkeypatch.undo()
    texts = ["".join(chr(0x10000 + i) for i in range(70_000))]
    assert set(grams().values()) == {1} and len(grams()) == 70_000


def test_scripts():
    """Order by coverage: few letters, a syllabary, thousands of characters; ties in count keep the order given."""
    even = lambda k: [(chr(0x4E00 + i), 10) for i in range(k)]
    assert Q.script(even(30), 300) == ("".join(c for c, _ in even(30)), 4, 40)
    assert Q.script(even(100), 1000)[1:] == (3, 136) and Q.script(even(1592), 20_000) == ("".join(c for c, _ in even(1592)), 2, 1600)
    assert Q.script([], 0) == ("", 4, 40)
    assert all(alphabet**order <= Q.ALPHABET**Q.ORDER for order, alphabet in Q.SHAPES)


def test_a_script_of_many_characters(spark):
    """Made-up words of 1,200 characters: real order stays, shuffled or random characters go; a Latin language beside it as ever."""
    rng = random.Random(7)
    chars = [chr(0x4E00 + i) for i in range(1200)]
    words = ["".join(rng.choices(chars, k=2)) for _ in range(1500)]
    real = lambda: "".join(rng.choices(words, k=100)) + "\u3002"
    mixed = lambda t: "".join(rng.sample(t, len(t)))
    docs = [(i, real(), "zh") for i in range(500)]
    docs += [(1000 + i, mixed(real()), "zh") for i in range(40)] + [(2000 + i, "".join(rng.choices(chars, k=200)), "zh") for i in range(40)]
    docs += [(3000 + i, " ".join(rng.choices(["the", "rain", "falls", "here"], k=40)), "en") for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    marks = frame.filter("doc_id < 400 OR doc_id >= 3000").selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    kept = {r["id"] for r in Q.judge(frame, marks).filter("kept").collect()}
    assert len([i for i in kept if i < 500]) >= 490 and len([i for i in kept if i >= 3000]) == 60
    assert not [i for i in kept if 1000 <= i < 3000]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(SMALL.replace("0.001", "0.01") + "/documents.parquet"), spark.read.parquet(SMALL.replace("0.001", "0.01") + "/labels.parquet")
    got = Q.judge(docs, labels).withColumnRenamed("id", "doc_id").join(docs.select("doc_id", "text"), "doc_id").toPandas()
    junk = got["text"].str.contains("%%% |### |!! |\\| .* \\| .* \\|", regex=True) & (got["n"] > 200)
    assert len(got) == docs.count() and junk.sum() > 40
    assert got[junk]["kept"].mean() < 0.05
    clean = got[~got["text"].str.contains("[#$%&*|!]", regex=True)]
    assert clean["kept"].mean() > 0.96


def test_all_trusted_documents_count(spark, monkeypatch):
    """No language loses its own shard to a limit on documents or languages."""
    docs = spark.createDataFrame([(i, " ".join(f"{w}{(i * 7 + k) % 11}" for k in range(9)), w) for i, w in enumerate(("ab", "cd", "xy") * 40)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    read = lambda: {r["id"]: r["perplexity"] for r in Q.judge(docs, labels).collect()}
    whole = read()
    monkeypatch.setattr(Q, "SAMPLE", 30, raising=False)
    monkeypatch.setattr(Q, "LANGUAGES", 1)
    assert read() == whole


def test_odd_rows(spark, odd, labels):
    assert Q.judge(odd, labels).count() == odd.count()
    kept = Q.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() <= odd.count()
    none = Q.judge(odd, labels.limit(0))
    assert none.filter("kept").count() == odd.count() and none.columns == Q.judge(odd, labels).columns
    assert Q.judge(odd.limit(0), labels).count() == 0


def test_pipeline_stages(spark, odd):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality", "lines", "near_duplicates", "pii", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in C.STAGES:
        for rows in (docs, odd, odd.limit(0)):
            out = stage(spark, rows, SMALL)
            if name == "packing":
                assert {"sequence_id", "offset"} <= set(out.columns)
            else:
                assert out.columns == rows.columns and out.schema == rows.schema
            out.count()
    assert C.run(spark, SMALL).count() > 100


def python_at_once(plan):
    """The most Python steps that one task runs at a time, by the text of a physical plan; each takes a worker."""
    most, above = 0, []
    for line in plan.splitlines():
        m = re.match(r"([ :]*(?:[+:]- )?)(?:\*\(\d+\) |\* )?(\w+)", line)
        if not m:
            continue
        while above and above[-1][0] >= len(m[1]):
            above.pop()
        n = 0 if "Exchange" in m[2] else (above[-1][1] if above else 0) + bool(re.search("EvalPython|InPandas|InArrow", m[2]))
        above.append((len(m[1]), n))
        most = max(most, n)
    return most


def test_no_task_of_the_pipeline_holds_two_python_workers(spark, monkeypatch):
    """Executors keep all workers that ran at once; rows from the driver need none."""
    import corpus_pipeline as P
    from ledgerlark.llm import common, graph, line_dedup, ngram_join, packing, pii

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return common.spool(df)

    for module in (P, Q, graph, line_dedup, ngram_join, packing, pii):
        if hasattr(module, "spool"):
            monkeypatch.setattr(module, "spool", noted)
    plans.append(P.run(spark, SMALL)._jdf.queryExecution().executedPlan().toString())
    assert max(map(python_at_once, plans)) == 1
    assert not [p for p in plans if "ExistingRDD" in p]
