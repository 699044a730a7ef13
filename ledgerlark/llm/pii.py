"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the votes, and a
span classifier learns from the weighed votes.

Base spans are what the four fixed patterns match (leftmost, without overlap in a kind, checked afterwards); they always
stay. Looser patterns propose further spans. Regular-expression, gazetteer and context labelers vote on every span. All
documents' votes are counted in cells (kind, votes, shape), of which there is a fixed number; expectation-maximisation over
the cells estimates each labeler's reliability for each kind, and a logistic classifier on votes and shape is trained on the resulting
probabilities. Further spans that the classifier accepts are added.

Every pattern is matched in time linear in the text. A null text counts as empty, with no spans. Repeated rows count as
often as they occur; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, prepare, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "account", "person")

# Patterns. A possessive or bounded repeat and a look-behind at a run's start keep each linear without changing what matches.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[(][Aa][Tt][\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[\[(][Dd][Oo][Tt][\])])\x20?[A-Za-z0-9-]{1,63}){1,4}")
_SECRET = re.compile(r"(?i)(?:api[_-]?key|token|secret|passw(?:or)?d)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"']{8,}+)")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9-])")
_PERSON = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)\.?\x20([A-Z][^\W\d_]{1,30}(?:\x20[A-Z][^\W\d_]{1,30})?)")
_TITLES = ("Mr", "Ms", "Dr", "Herr ", "Frau ", "Mme", "Sr")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")

#: Gazetteers, and words that speak for or against a kind when they stand shortly before a span.
TLDS = frozenset("com org net edu gov mil int info biz name pro mobi aero coop museum travel jobs app dev cloud online shop site store tech xyz".split())
# Every two-letter domain is a country's; these are set aside and belong to none.
NO_COUNTRY = frozenset("aa oo qm qn qo qp qq qr qs qt qu qv qw qx qy qz xa xb xc xd xe xf xg xh xi xj xl xm xn xo xp xq xr xs xt xu xv xw xx xy xz zz".split())
GIVEN = frozenset(
    """
    adam adrian albert alexander alice amelia amy andrea andreas andrew angela anna anne anthony antonio barbara benjamin bernard bernd brian
    camille carlos carmen caroline catherine charles charlotte christian christine christopher claire claudia daniel david deborah denis
    dieter dominique edward elena elizabeth emily emma enrique eric eva fernando florian francesca francesco francisco frank franz frederic
    gabriel george gerhard giovanni giulia giuseppe grace hannah hans heinz helen helga henry hugo ines isabel jack jacques james jan jane
    javier jean jennifer jessica joan johann john jonas jorge jose joseph juan julia julie jurgen karen karl kate kevin klaus laura lea leon
    linda lisa louis louise lucas lucia luigi luis manuel marco margaret maria marie mario mark markus marta martin mary matthew michael
    michel miguel monika nancy nathalie nicolas nina olivia oscar patricia patrick paul pedro peter petra philippe pierre pilar rachel
    rafael ralf renate richard robert roberto rosa ruth sabine samuel sandra sara sarah sofia sophie stefan stephen steven susan susanne
    teresa thomas uwe valentina victor walter werner william wolfgang
    """.split()
)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "sk_live_", "pk_live_", "xox", "eyJ", "AIza", "SG.")
# Country calling codes: one digit, two, or three by their zones.
DIAL = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-9]|5[09][0-9]|6[789][0-9]|8[0578][0-9]|9[679][0-9]")
# Lengths of account numbers by country.
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
CONTEXT = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "address", "host", "login", "server", "from"),
    "card": ("card", "visa", "mastercard", "credit", "kart", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "numero"),
    "secret": ("key", "token", "secret", "password", "credential"),
    "account": ("iban", "account", "ssn", "konto", "compte", "cuenta", "social"),
    "person": ("dear", "by", "name", "signed", "author", "from"),
}
AGAINST = ("version", "isbn", "sku", "invoice", "order", "section", "chapter", "figure", "example")
LABELERS = ("form", "check", "known", "reserved", "context", "against")
_WINDOW = 40
#: Votes that a prior weighs, the chances of a vote against, of none and of one for on personal data that it starts from, and a vote's greatest weight.
PRIOR, LEAN, WEIGHT = 3, (0.125, 0.5, 0.375), 4.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str, failed: list | None = None) -> list[tuple[str, int, int]]:
    """The checked matches of the fixed patterns, by kind and start. failed gets the others that hold nine digits or are an address's form."""
    out = []
    drop = (lambda *x: None) if failed is None else (lambda kind, m: failed.append((kind, *m.span())))
    free, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while start > free and (text[start - 1] in _LOCAL):
            start -= 1
        if m and start < at:
            out.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(map(_byte, m.group().split("."))):
                out.append(("ip", *m.span()))
            else:
                drop("ip", m)
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 9:
                digits = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
                elif len(digits) >= 9:
                    drop("card", m)
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
                    out.append(("phone", *m.span()))
    return out


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _in_a_row(text: str, m: re.Match) -> bool:
    """Whether numbers parted by blanks go on before or after the match: a row of numbers, not a phone."""
    near = text[max(0, m.start() - 2) : m.start()], text[m.end() : m.end() + 2]
    return re.fullmatch(r"[0-9\x20]+", m.group()) is not None and (re.fullmatch(r"[0-9]\x20", near[0]) or re.fullmatch(r"\x20[0-9]", near[1])) is not None


def loose_spans(text: str, base: list[tuple[str, int, int]], failed: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """What the looser patterns propose besides, and, where they leave room, matches that failed their check; without overlap."""
    found = []
    if "(at" in text or "[at" in text or "(AT" in text or "[AT" in text:
        found += [("email", *m.span()) for m in _LOOSE_MAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [("phone", *m.span()) for m in _LOOSE_PHONE.finditer(text) if not _in_a_row(text, m)]
        found += [("account", *m.span()) for m in _ACCOUNT.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1)) for m in _SECRET.finditer(text)]
    if any(t in text for t in _TITLES):
        found += [("person", *m.span(1)) for m in _PERSON.finditer(text)]
    taken: list[tuple[int, int]] = []  # apart and in order
    for _, s, e in sorted(base, key=lambda x: x[1]):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    out = []
    longest = lambda x: (x[1], -x[2])
    for kind, s, e in sorted(found, key=longest) + sorted(failed, key=longest):
        i = bisect.bisect_left(taken, (s, e))
        if (i == 0 or taken[i - 1][1] <= s) and (i == len(taken) or e <= taken[i][0]):
            out.append((kind, s, e))
            taken.insert(i, (s, e))
    return out


def _mod97(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for personal data, -1 against, 0 for no opinion."""
    span, before = text[start:end], text[max(0, start - _WINDOW) : start].lower()
    digits = "".join(_DIGITS.findall(span)) if kind in ("ip", "card", "phone", "account") else ""
    form, check, known, reserved = 1 if base else 0, 0, 0, 0
    if kind == "email":
        last = re.split(r"[.\s\])]+", span.lower())[-1]
        known = 1 if last in TLDS or (re.fullmatch("[a-z]{2}", last) and last not in NO_COUNTRY) else 0
        check = 1 if last.isalpha() else -1
        reserved = -1 if "noreply" in span.lower() or "localhost" in span.lower() else 0
    elif kind == "ip":
        parts = span.split(".")
        reserved = -1 if parts[0] in ("0", "10", "127") or parts[:2] == ["192", "168"] else 0
        check = 1 if base and all(p == "0" or not p.startswith("0") for p in parts) else -1
    elif kind == "card":
        known = 1 if digits[0] in "3456" else -1
        check = 1 if base else -1
    elif kind == "phone":
        known = 1 if base and DIAL.match(digits) else 0
        check = 1 if 10 <= len(digits) <= 13 else -1
    elif kind == "secret":
        letters = len(set(span))
        form = 1 if re.fullmatch(r"[A-Za-z0-9_+/=.-]+", span) else -1
        check = 1 if letters >= 10 and _DIGIT.search(span) else -1
        known = 1 if span.startswith(PREFIXES) or re.fullmatch(r"[0-9a-fA-F]{32,}", span) else 0
    elif kind == "account":
        bare = span.replace(" ", "")
        iban = bare[:2].isalpha()
        check = (1 if _mod97(bare) else -1) if iban else (-1 if bare[:3] in ("000", "666") or bare[0] == "9" else 1)
        known = (1 if IBAN.get(bare[:2]) == len(bare) else -1) if iban else 0
        form = 1 if iban or bare.count("-") == 2 else 0
    else:
        names = span.lower().split()
        known = 1 if any(n in GIVEN for n in names) else 0
        form = 1 if len(names) == 2 else 0
    if digits and len(set(digits)) <= 2:
        reserved = -1
    return form, check, known, reserved, int(any(w in before for w in CONTEXT[kind])), -int(any(w in before for w in AGAINST))


def shape(text: str, start: int, end: int) -> int:
    """A span's form in 16 classes: its length, and whether it holds digits or capitals."""
    span = text[start:end]
    size = end - start
    return (0 if size < 12 else 1 if size < 20 else 2 if size < 40 else 3) * 4 + 2 * bool(_DIGIT.search(span)) + (span != span.lower())


def candidates(text: str) -> list[tuple[str, int, int, bool, tuple[int, ...], int]]:
    """Every span with whether it is a base one, its votes and its shape."""
    failed: list = []
    base = base_spans(text, failed)
    return [(k, s, e, b, votes(text, k, s, e, b), shape(text, s, e)) for b, spans in ((True, base), (False, loose_spans(text, base, failed))) for k, s, e in spans]


def _cell(kind: str, vote: tuple[int, ...], form: int) -> int:
    code = KINDS.index(kind)
    for v in vote:
        code = code * 3 + v + 1
    return code * 16 + form


def _cells(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    form, rest, vote = codes % 16, codes // 16, []
    for _ in LABELERS:
        vote.append(rest % 3)
        rest = rest // 3
    return rest, np.array(vote[::-1]).T, form


class Model:
    """Labelers' reliabilities by kind, and the span classifier trained with them."""

    def __init__(self, counts: dict[int, int], rounds: int = 50):
        codes = np.array(sorted(counts), dtype=np.int64)
        n = np.array([counts[int(c)] for c in codes], dtype=float)
        kind, vote, form = _cells(codes)
        self.reliability, truth = self._maximise(kind, vote, n, rounds)
        self.weights = self._train(self._features(kind, vote, form), truth, n)
        self._known: dict[int, bool] = {}

    @staticmethod
    def _maximise(kind, vote, n, rounds):
        """Expectation-maximisation over the cells, from the balance of votes. For each kind and labeler it estimates how often
        each vote falls on personal data and on other spans; the logarithm of their ratio, of at most WEIGHT, is the vote's
        weight. A vote never speaks against what it says, and no opinion weighs nothing. The prior of a kind's chances is PRIOR
        votes' worth of the labeler's chances over all kinds, whose own prior is as many of LEAN, so a rare kind leans on the
        others. The first result is the chance, by kind and labeler, that a labeler is right where it votes."""
        belief = 1 / (1 + np.exp(-1.0 * (vote - 1).sum(1)))

        def tallies(held):
            of_kind = np.stack([np.bincount(kind * 3 + vote[:, j], held, 3 * len(KINDS)).reshape(-1, 3) for j in range(len(LABELERS))], axis=1)
            return of_kind, of_kind.sum(0, keepdims=True)

        def settled(held, lean):
            of_kind, over_all = tallies(held)
            over_all = over_all + PRIOR * np.array(lean)
            of_kind = of_kind + PRIOR * over_all / over_all.sum(-1, keepdims=True)
            return of_kind / of_kind.sum(-1, keepdims=True)

        for _ in range(rounds):
            weight = np.log(settled(n * belief, LEAN) / settled(n * (1 - belief), LEAN[::-1])).clip(-WEIGHT, WEIGHT)
            weight = np.stack([np.minimum(weight[..., 0], 0), np.zeros(weight.shape[:2]), np.maximum(weight[..., 2], 0)], axis=-1)
            prior = (np.bincount(kind, n * belief, len(KINDS)) + 1) / (np.bincount(kind, n, len(KINDS)) + 2)
            odds = np.log(prior / (1 - prior))[kind] + sum(weight[kind, j, vote[:, j]] for j in range(len(LABELERS)))
            belief = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        true, false = tallies(n * belief)[0], tallies(n * (1 - belief))[0]
        right, wrong = true[..., 2] + false[..., 0], true[..., 0] + false[..., 2]
        return ((right + PRIOR * 0.75) / (right + wrong + PRIOR)).clip(0.5, 0.99), belief

    @staticmethod
    def _features(kind, vote, form) -> np.ndarray:
        """Kind, votes, votes of the kind, and shape."""
        of = [kind == k for k in range(len(KINDS))]
        cast = [vote[:, j] == v for j in range(len(LABELERS)) for v in (0, 2)]
        rows = [np.ones(len(kind)), *of, *cast, *(a & b for a in of for b in cast)]
        rows += [form // 4 == s for s in range(4)] + [form // 2 % 2, form % 2]
        return np.array(rows, dtype=float).T

    @staticmethod
    def _train(x, truth, n, steps: int = 30, ridge: float = 1.0) -> np.ndarray:
        """Logistic regression on soft labels by Newton's method."""
        w = np.zeros(x.shape[1])
        scale = n / max(n.sum(), 1) * 1000
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (scale * (truth - p)) - ridge * w
            curve = (x * (scale * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            w += np.linalg.solve(curve, slope)
        return w

    def accepts(self, kind: str, vote: tuple[int, ...], form: int) -> bool:
        code = _cell(kind, vote, form)
        if code not in self._known:
            self._known[code] = bool((self._features(*_cells(np.array([code]))) @ self.weights)[0] > 0)
        return self._known[code]


def train(docs: DataFrame, text: str = "text") -> Model:
    """The model of all documents' votes. The driver gets one row per cell that occurs, of at most 7 * 3**6 * 16."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter[int] = Counter()
        for batch in batches:
            for t in batch["t"]:
                if t:
                    n.update(_cell(k, v, f) for k, _, _, _, v, f in candidates(t))
        yield pd.DataFrame({"cell": list(n.keys()), "n": list(n.values())}, dtype="int64")

    cells = docs.selectExpr(f"`{text}` AS t").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return Model({int(r["cell"]): int(r["n"]) for r in cells.collect()})


def accepted(text: str, model: Model) -> list[tuple[str, int, int, bool]]:
    """Base spans and those that the classifier adds, by kind as listed, then by start."""
    spans = [(k, s, e, b) for k, s, e, b, v, f in candidates(text) if b or model.accepts(k, v, f)]
    return sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def find_pii(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """key, an array of spans (kind, start, end in code points, base)."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(model or train(docs, text))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"].array, "spans": [[{"kind": k, "start": s, "end": e, "base": b} for k, s, e, b in accepted(t or "", held.value)] for t in batch["t"]]})

    found = named(docs, key, text).mapInPandas(run, "k string, spans array<struct<kind: string, start: int, end: int, base: boolean>>")
    return found.select(F.col("k").cast(kind).alias(key), "spans")


def redacted(text: str, model: Model) -> str:
    """The text with each span, overlapping ones as one, replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, s, e, _ in sorted(accepted(text, model), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """docs with the spans in a text replaced; a null text stays null. Columns and rows stay as they are."""
    held = prepare(docs.sparkSession).sparkContext.broadcast(model or train(docs, text))

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redacted(t, held.value) for t in texts], dtype=object)

    return docs.withColumn(text, clean(F.col(text)))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = spark.sparkContext.broadcast(train(docs))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        said = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e, _ in spans)
        for batch in batches:
            rows = []
            for t in batch["t"]:
                spans = accepted(t or "", held.value)
                base = [x for x in spans if x[3]]
                n = Counter(x[0] for x in base)
                rows.append((*(n[k] for k in BASE_KINDS), hashlib.sha256(said(base).encode()).hexdigest(), said(spans)))
            out = pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])
            out.insert(0, "k", batch["k"].array)
            yield out

    found = named(docs, "doc_id", "text").mapInPandas(run, "k string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return found.withColumn("doc_id", F.col("k").cast("long")).select("doc_id", *found.columns[1:])


QUERIES = {"op1_pii": op1_pii}
