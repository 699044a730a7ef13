import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers as P
import pytest

from ledgerlark.llm import bpe, packing, token_count


def greedy(word, pieces):
    n = at = 0
    while at < len(word):
        stop = next((j for j in range(len(word), at, -1) if word[at:j] in pieces), 0)
        if not stop:
            return 0
        at, n = stop, n + 1
    return n


def test_automaton_against_greedy_matching():
    rng = random.Random(2)
    for _ in range(5000):
        pieces = {"".join(rng.choices("abc▁", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 9))}
        word = "▁" + "".join(rng.choices("abc", k=rng.randint(0, 9)))
        assert token_count.Automaton(sorted(pieces)).count(word) == greedy(word, pieces)


def test_no_documents_no_counts(spark, odd):
    got = token_count.token_counts(odd.limit(0), ["▁", "a"])
    assert got.collect() == [] and got.columns == ["doc_id", "n_words", "n_tokens", "n_unknown"]


def test_token_counts(spark, odd):
    got = {(r["doc_id"], r["n_words"], r["n_tokens"], r["n_unknown"]) for r in token_count.token_counts(odd, ["▁he", "l", "o", "▁", "a", "x" * 3, "x"]).collect()}
    assert {(2, 6, 10, 4), (1, 0, 0, 0), (None, 0, 0, 0), (8, 0, 0, 0)} <= got
    assert (7, 1, 100_001, 0) in got
    pieces = token_count.read_pieces(P.path("piece_bpe_32k.model"))
    assert token_count.Automaton(pieces).count("▁information") == greedy("▁information", set(pieces)) > 0


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.Bpe(ranks, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_against_the_library(pair):
    own, library = pair
    rng = random.Random(5)
    for alphabet in ("ab é漢\n'st1 \t", "abcdefgh", " \n\t\r'", "🙂👍🏽 a", "ßüêñ .,!?123"):
        for _ in range(400):
            text = "".join(rng.choices(alphabet, k=rng.randint(0, 60)))
            ids = own.encode(text)
            assert ids == library.encode_ordinary(text), text
            assert own.decode(ids) == text.encode()
    text = "".join(rng.choices("abcdefgh", k=60_000))
    assert own.encode(text) == library.encode_ordinary(text)


def test_splitting_of_every_code_point(pair):
    own, library = pair
    for c in [*range(0x3100), 0x4E00, 0xAC00, 0xE000, 0xFF10, 0x1D7D8, 0x1F600, 0x20000]:
        text = f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}{chr(c)}x"
        assert own.encode(text) == library.encode_ordinary(text), hex(c)


def test_rank_queue_orders_by_rank_then_position():
    rng = random.Random(7)
    queue, model = bpe.RankQueue(50_000), []
    for _ in range(3000):
        if model and rng.random() < 0.4:
            assert queue.pop() == model.pop(0)
        else:
            x = (rng.choice([0, 1, 255, 256, 49_999, rng.randrange(50_000)]), rng.randrange(1000))
            queue.push(*x)
            model = sorted([*model, x])
    while model:
        assert queue.pop() == model.pop(0)
    assert not queue.top


def test_a_full_memo_changes_nothing(pair, monkeypatch):
    own, library = pair
    monkeypatch.setattr(bpe, "MEMO", 3)
    text = "the cat and the dog and a bird and the cat again, one two three four"
    assert own.encode(text) == own.encode(text) == library.encode_ordinary(text)


def test_bpe_rows(spark, odd):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.bpe_encode(odd, path)
    assert coded.count() == odd.count() and bpe.bpe_encode(odd.limit(0), path).count() == 0
    back = bpe.bpe_decode(coded, path)
    want = collections.Counter((r["doc_id"], (r["text"] or "").encode()) for r in odd.collect())
    assert collections.Counter((r["doc_id"], bytes(r["bytes"])) for r in back.collect()) == want
    r = coded.filter("doc_id = 2").first()
    assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["ids"])).encode()).hexdigest() and r["n_tokens"] == len(r["ids"])


def placed(counts, capacity):
    plan = packing.best_plan(counts, capacity)
    at, bins = plan.intervals(), {}
    for n, c in counts.items():
        for rank in range(c):
            i = np.searchsorted(at["key"], n << packing._RANK_BITS | rank, side="right") - 1
            own = rank - at["rank"][i]
            bins.setdefault(int(at["base"][i] + own // at["per"][i]), []).append((int(at["offset"][i] + own % at["per"][i] * n), n))
    for items in bins.values():
        end = 0
        for offset, n in sorted(items):
            assert offset == end
            end += n
        assert end <= capacity
    assert len(bins) == plan.bins
    return len(bins)


def test_configurations_are_optimal():
    """Every pattern fits, the uses hold exactly what is asked for, and by duality over all patterns no other uses are fewer."""
    rng = random.Random(5)
    for _ in range(60):
        room = rng.randint(8, 40)
        sizes = sorted(rng.sample(range(2, room), rng.randint(1, 5)), reverse=True)
        left = [rng.randint(1, 50) for _ in sizes]
        patterns, uses, worth = packing.configurations(sizes, left, room)
        assert (np.array(sizes) @ patterns <= room).all() and np.allclose(patterns @ uses, left)
        every = [p for p in itertools.product(*(range(room // s + 1) for s in sizes)) if np.dot(p, sizes) <= room]
        assert max(np.dot(p, worth) for p in every) <= 1 + 1e-6 and np.isclose(uses.sum(), np.dot(worth, left))


def test_solved_plans_need_fewer_sequences():
    rng = random.Random(6)
    counts = collections.Counter()
    for _ in range(2000):  # three that fill a sequence
        a, b = rng.randint(500, 900), rng.randint(500, 900)
        counts.update((a, b, 2048 - a - b))
    filled, solved = (min(packing.grouped_plan(counts, 2048, s, 64, x).bins for s in packing.LARGE) for x in (False, True))
    assert 2000 <= solved < filled and packing.best_plan(counts, 2048).bins <= solved
    placed(counts, 2048)


def test_plans_are_gapless_and_near_the_bound():
    rng = random.Random(1)
    for _ in range(60):
        capacity = rng.choice([1, 10, 64, 2048])
        placed(dict(collections.Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 300)))), capacity)
    lengths = np.clip(np.random.default_rng(0).lognormal(6.4, 1.0, 20_000), 1, 2048).astype(int).tolist()
    assert placed(dict(collections.Counter(lengths)), 2048) <= 1.001 * -(-sum(lengths) // 2048)


def test_packed_rows(spark, odd):
    text = packing.definition(P.path("byte_bpe_50k.json"))
    got = packing.pack(odd, text, capacity=64, keep_ids=True).toPandas()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted(len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert got["length"].sum() == sum(want) and (got["length"] <= 64).all()
    for _, rows in got[got["doc_id"].notna() & (got["doc_id"] != 2)].groupby("doc_id"):
        rows = rows.sort_values("piece")
        assert list(rows["start"]) == [0, *rows["length"].cumsum()[:-1]] and (rows["length"][1:] == 64).all()
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert list(rows["offset"]) == [0, *rows["length"].cumsum()[:-1]] and rows["length"].sum() <= 64
    assert packing.pack(odd.limit(0), text).count() == 0


def test_encoder_gives_the_library_s_ids():
    from tokenizers import Tokenizer

    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        library, own = Tokenizer.from_file(P.path(name)), packing.Encoder(packing.definition(P.path(name)))
        rng = random.Random(3)
        for _ in range(200):
            text = "".join(rng.choices([*"abc thé漢\n'st1 \t<|>", "<|endoftext|>"], k=rng.randint(0, 80)))
            assert own.encode(text) == library.encode(text, add_special_tokens=False).ids
    assert packing.Encoder(packing.definition(P.path("byte_bpe_50k.json"))).encode("hello <|endoftext|> world") == [31373, 220, 50256, 995]
