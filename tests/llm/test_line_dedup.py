import collections
import random

from ledgerlark.llm import line_dedup as L


def make(spark, rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")


def own(w):
    return " ".join(w + c for c in "abcdefghijklmnopqrstuvwxyz")


def cleaned(df, **kw):
    return {r["doc_id"]: r["text"] for r in L.drop_lines(df, **kw).collect()}


def test_variable_fields_are_one_template(spark):
    own = [f"body {w} is here and says something of its own about {w}\nanother {w} line that is not like others" for w in "abcdefghijkl"]
    texts = [f"{a}\nvisited by user{i} on 2024-01-{i:02d} from Berlin office" for i, a in enumerate(own)]
    got = cleaned(make(spark, texts))
    assert [got[i] for i in range(12)] == own


def test_trailing_names_generalise(spark):
    texts = [f"{own(w)}\nshare this article with {w} right now\n{own(w + w)}" for w in "abcdefghijkl"]
    got = cleaned(make(spark, texts))
    assert all("share this article" not in t for t in got.values())


def test_variable_fields_beyond_the_first_tokens(spark):
    fixed = [f"t{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    texts = [f"{own(w)}\n{' '.join(fixed)} seen by {w}{w} and others\n{own(w + w)}" for w in "abcdefghijkl"]
    got = cleaned(make(spark, texts))
    assert [got[i] for i in range(12)] == [f"{own(w)}\n{own(w + w)}" for w in "abcdefghijkl"]


def plain_tree(texts, least):
    """Line numbers to drop by document, by dictionaries: leaves, constants, templates, and what stands around a run of candidates."""
    lines = [[(i, L.tokens(x)) for i, x in enumerate(t.split("\n"))] for t in texts]
    at = collections.defaultdict(set)  # leaf, place, token: documents
    for d, rows in enumerate(lines):
        for _, m in rows:
            for p, w in enumerate(m):
                at[len(m), tuple(m[: L.DEPTH]), p, w].add(d)
    template, holders = {}, collections.defaultdict(set)
    for d, rows in enumerate(lines):
        for i, m in rows:
            name = (len(m), tuple(m[: L.DEPTH]))
            held = [(p, w) for p, w in enumerate(m) if w != L.VARIABLE and len(at[*name, p, w]) >= least]
            if m and 2 * len(held) >= len(m):
                template[d, i] = (*name, tuple(held))
                holders[template[d, i]].add(d)
    candidate = {k: v for k, v in template.items() if len(holders[v]) >= least}
    around = collections.defaultdict(set)
    for d, rows in enumerate(lines):
        own_ = {i for i, m in rows if m and (d, i) not in candidate}
        words = texts[d].split("\n")
        for i, m in rows:
            if (d, i) in candidate:
                before, after = max((j for j in own_ if j < i), default=None), min((j for j in own_ if j > i), default=None)
                around[candidate[d, i]].add((before is not None and words[before], after is not None and words[after]))
    return {d: [i for i, _ in rows if (d, i) in candidate and len(around[candidate[d, i]]) >= least] for d, rows in enumerate(lines)}


def test_against_a_plain_tree(spark):
    """Documents that are mostly their own, in which notices with variable fields recur more or less often."""
    rng = random.Random(11)
    notices = ["read on {} of our pages {}", "{} was here at {} o'clock today", "All rights reserved.", "call {} for {} or write to us", "{} {} {} {}"]
    texts = []
    for d in range(60):
        rows = [" ".join(f"w{d}x{rng.randrange(10**6)}y".translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(25)) for _ in range(rng.randint(3, 6))]
        for n in rng.sample(notices, rng.randint(0, 3)):
            rows.insert(rng.randint(0, len(rows)), n.format(*(rng.choice(["one", "two", "three", str(rng.randint(1, 99)), f"n{d}q{rng.randint(0, 9)}"]) for _ in range(4))))
        if d % 7 == 0:
            rows.insert(rng.randint(0, len(rows)), " \t")
        texts.append("\n".join(rows))
    for least in (5, 10):
        got = {r["doc_id"]: list(r["_dropped"] or []) for r in L.drop_lines(make(spark, texts), min_documents=least).collect()}
        want = plain_tree(texts, least)
        assert got == want and sum(map(len, want.values())) > 20


def test_below_the_threshold_nothing_goes(spark):
    texts = [f"own {w} {w}x {w}y {w}z text\nAll rights reserved." for w in "abcdefghi"]
    assert list(cleaned(make(spark, texts)).values()) == texts


def test_copies_are_not_boilerplate(spark):
    texts = ["first line of it\nsecond line of it\nthird line of it"] * 30
    assert set(cleaned(make(spark, texts)).values()) == set(texts)


def test_blocks_of_several_lines(spark):
    head, foot = "Welcome to our little site\nHome News Contact Imprint", "All rights reserved here.\n\nUse is subject to terms.\nWrite to the editors please."
    bodies = [f"{own(w)}\n{own(w + w)}\n{own(w + 'x')}" for w in "abcdefghijkl"]
    got = cleaned(make(spark, [f"{head}\n{b}\n{foot}" for b in bodies]))
    assert [got[i].strip() for i in range(12)] == bodies


def test_paragraphs_parted_by_blank_lines(spark):
    bodies = [f"{own(w)}\n\n{own(w + w)}" for w in "abcdefghijkl"]
    got = cleaned(make(spark, [f"{b}\n\nAll rights reserved here." for b in bodies]))
    assert [got[i].strip() for i in range(12)] == bodies


def test_near_copies_are_not_boilerplate(spark):
    lines = [own(w) for w in "abcdefghijklmnopqrst"]
    for changed in (1, 2, 6):
        texts = ["\n".join(own(chr(0x4E00 + 40 * k + i)) if (k - i * 7) % 20 in range(changed) else x for k, x in enumerate(lines)) for i in range(40)]
        assert set(cleaned(make(spark, texts)).values()) == set(texts)


def test_a_document_of_boilerplate_stays(spark):
    texts = [f"All rights reserved here.\n{own(w)}" for w in "abcdefghijkl"] + ["All rights reserved here."]
    got = cleaned(make(spark, texts))
    assert got[12] == texts[12] and all("rights" not in got[i] for i in range(12))


def test_short_documents_lose_a_long_passage(spark):
    passage = " ".join(f"{c}{d}" for c in "pqrst" for d in "abcdefghij")
    short = [" ".join(w + c for c in "abcdefghijklmnopqrst") for w in "ABCDEFGHIJKL"]
    got = cleaned(make(spark, [f"{passage}\n{w}" for w in short]))
    assert [got[i] for i in range(12)] == short


def test_what_is_proven_by_long_documents_goes_from_short_ones(spark):
    notice = "All rights reserved here by us and by all of our friends."
    got = cleaned(make(spark, [f"{notice}\n{own(w)}" for w in "abcdefghijkl"] + [f"{notice}\nshort", f"{notice}\n\n \t"]))
    assert got[12] == "short" and got[13] == f"{notice}\n\n \t"


def test_odd_rows(spark, odd):
    out = L.drop_lines(odd, min_documents=1)
    assert out.count() == odd.count() and out.columns[:-2] == odd.columns
    assert L.drop_lines(odd.limit(0)).count() == 0
    long_ = make(spark, ["\n".join(["w " * 300 + str(i)] * 3) for i in range(3)])
    assert L.drop_lines(long_).count() == 3
