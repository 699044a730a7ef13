import random
import re
from collections import Counter

from ledgerlark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def holds(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(p) <= 255 for p in span.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]


def test_base_spans_against_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choices(rng.choice(["a@.b-", "0123456789. -", "+12 ()-.9", "1.2.30 255", "@a.+1"]), k=rng.randint(0, 40)))
        assert pii.base_spans(text) == brute(text), text
    assert pii.base_spans("é 4539578763621486 x@y.z.")[0] == ("email", 19, 24)


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "1.1." * 50_000, "a" * 200_000 + "@", "@a" * 50_000, "a-" * 100_000 + "(at", "1-" * 50_000, "+1(" * 50_000, "A" * 200_000 + "=: Mr 1"):
        pii.candidates(text)


def test_votes_decide():
    cells = Counter()
    good, bad = 'the token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" x', "order 1234567890"
    for text, n in ((good, 90), (bad, 200), ("call +49 30 1234567 now", 80)):
        for k, _, _, _, v, f in pii.candidates(text):
            cells[pii._cell(k, v, f)] += n
    model = pii.Model(cells)
    assert [x[0] for x in pii.accepted(good, model)] == ["secret"] and pii.accepted(bad, model) == []
    assert pii.redacted("a@b.co, 1.2.3.4!", model) == "<EMAIL>, <IP>!"
    assert (model.reliability >= 0.5).all()


def test_reliabilities_by_kind():
    """A labeler that is right for one kind and wrong for another is weighed apart; a kind that nobody saw leans on the others."""
    cells = Counter()
    sure, fooled = (1, 1, 1, 0, 1, 0), (-1, -1, 1, 0, 0, -1)  # the gazetteer speaks for both
    for kind, vote in (("secret", sure), ("account", fooled)):
        cells[pii._cell(kind, vote, 0)] = 500
    r = pii.Model(cells).reliability
    known, (secret, account, person) = pii.LABELERS.index("known"), map(pii.KINDS.index, ("secret", "account", "person"))
    assert r[secret, known] > 0.9 and r[account, known] < 0.6 and 0.5 < r[person, known] < 0.9
    assert pii.Model(cells).accepts("secret", sure, 0) and not pii.Model(cells).accepts("account", fooled, 0)


def test_gazetteers():
    known = lambda kind, span: pii.votes(span, kind, 0, len(span), True)[2]
    assert known("email", "a@b.se") == known("email", "a@b.museum") == 1 and known("email", "a@b.zz") == known("email", "a@b.txt") == 0
    assert known("phone", "+358 40 1234567") == known("phone", "+7 495 1234567") == 1 and known("phone", "+999") == 1 and known("phone", "+29") == 0
    assert known("account", "DE89 3704 0044 0532 0130 00") == 1 and known("account", "DE89 3704 0044 0532 0130") == known("account", "ZZ89 3704 0044 0532 0130 00") == -1
    assert known("person", "Petra Holm") == 1 and known("person", "Xyl Holm") == 0


def test_failed_matches_leave_looser_candidates():
    for kind, span in (("account", "123-45-6789"), ("phone", "555-123-4567"), ("phone", "555 123 4567")):
        assert [x[:3] for x in pii.candidates(f"it is {span} so")] == [(kind, 6, 6 + len(span))]
    assert ("account", 5, 16) in [x[:3] for x in pii.candidates("2024 123-45-6789")]
    assert [x[0] for x in pii.candidates("order 1234567890")] == [x[0] for x in pii.candidates("997 998 999 1000 1001")] == ["card"]


def test_long_secrets_to_their_end():
    text = "token = " + "aB3x" * 500 + " end"
    assert [x[:3] for x in pii.candidates(text)] == [("secret", 8, 2008)]


def test_no_votes_at_all():
    assert pii.redacted("x a@b.co", pii.Model({})) == "x <EMAIL>"


def test_rows(spark, odd):
    got = pii.find_pii(odd)
    assert got.count() == odd.count()
    spans = [r["spans"] for r in got.collect() if r["spans"]]
    assert [(s["kind"], s["start"], s["end"]) for x in spans for s in x] == [("email", 11, 20)]
    clean = pii.redact(odd)
    assert clean.columns == odd.columns and clean.filter("text = 'mail me at <EMAIL> now'").count() == 1 and clean.filter("text IS NULL").count() == 1
    assert pii.find_pii(odd.limit(0)).count() == 0
