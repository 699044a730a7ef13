import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import html, rules, text, tokens, urls
from ledgerlark.sources import readers


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def label(curated, legacy, extracted):
    """The rules in plain Python."""
    for value, table in ((curated, "c"), (legacy, "l"), (extracted, "l")):
        if value:
            up = value.upper()
            if table == "c":
                tests = [("FUNDING", ["FUNDING", "EQUITY"]), ("ACQUISITION", ["ACQUISITION"]), ("MERGER", ["MERGER"]), ("IPO", ["IPO"]), ("CONTRACT", ["CONTRACT", "AWARD"]), ("PARTNERSHIP", ["PARTNERSHIP", "JOINT"]), ("INTERNAL", ["INTERNAL"])]
            else:
                tests = [("FUNDING", ["VC", "VENTURE", "FUNDING"]), ("ACQUISITION", ["M&A", "ACQUISITION", "ACQUIRED"]), ("IPO", ["IPO"])]
            return next((name for name, words in tests if any(w in up for w in words)), up)
    return "UNKNOWN"


def test_labels_against_a_model(spark):
    words = ["Equity Funding Round", "Joint Venture", "Merger & Acquisition", "Private Equity", "ipo", "M&A", "acquired", "Debt", "", None, "award", "internal"]
    rng = random.Random(1)
    rows = [tuple(rng.choice(words) for _ in range(3)) for _ in range(300)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, c string")
    got = df.orderBy("i").select(rules.deal_label("a", "b", "c"), rules.badge("a", "b", "c")).collect()
    assert [g[0] for g in got] == [label(*r) for r in rows]
    assert {g[1] for g in got if g[0] == "FUNDING"} == {"badge-primary"} and {g[1] for g in got if g[0] == "UNKNOWN"} == {"badge-secondary"}


def test_preselection(spark):
    df = spark.createDataFrame([("Merger", "Joint IPO", "Family Office, x", "PE", "AI/ML", "CREDIT")], "t string, d string, s string, c string, e string, k string")
    r = df.select(rules.preselected_type("t", "d").alias("a"), rules.checked_sources("s", "c").alias("b"), rules.checked_sectors("e", "k").alias("c")).collect()[0]
    assert r["a"] == "Joint Venture" and r["b"] == ["Private Equity", "Family Office"] and r["c"] == ["AI/ML", "Software/IT"]


def test_redirects(spark):
    given = ["https://www.google.com/url?rct=j&url=https%3A%2F%2Fa.co%2Fx%2520y&ct=ga", "https://www.google.com/url?url=&x=1", "https://www.google.com/url?q=1", "not a url", "https://b.co/url?url=c", "https://www.google.com/url?url=https%3A%2F%2Fa.co%2Fx%2By", None]
    assert one(spark, given, urls.unwrapped) == ["https://a.co/x y", given[1], given[2], "not a url", given[4], "https://a.co/x+y", None]


def test_source_domain(spark):
    given = ["https://www.A.co:81/x", "http://b.co", "x", "", None, "http://c d.co/e f", "https://google.com/url?sa=t&url=https%3A%2F%2Fwww.wsj.com%2Fx"]
    assert one(spark, given, urls.source_domain) == ["A.co:81", "b.co", "source", "source", "source", "c d.co", "wsj.com"]


def test_links(spark):
    entity = "array<struct<type:string,offset:int,length:int>>"
    df = spark.createDataFrame([("see http://a.co/x). HTTP://b.co and c.co", [("url", 36, 4), ("bold", 0, 3), ("url", 4, 15)], "http://a.co/x).")], f"t string, e {entity}, c string")
    assert df.select(text.links("t", "e", "c")).collect()[0][0] == ["http://a.co/x).", "HTTP://b.co", "c.co", "http://a.co/x)."]


def test_updates(spark):
    payloads = ['{"message": {"text": "/status", "chat": {"id": 5}, "from": {"id": 7}}}', "{}", "junk"]
    got = readers.updates(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()
    assert [(r["text"], r["chat_id"], r["username"], r["entities"]) for r in got] == [("/status", 5, "unknown", []), ("", None, "unknown", []), ("", None, "unknown", [])]


@pytest.mark.parametrize("given, want", [("a  b\n  c\t\n\n d e ", "a b c d e"), ("", ""), ("  ", "")])
def test_whitespace(spark, given, want):
    assert one(spark, [given], text.clean_whitespace) == [want]


def test_pages(spark):
    page = "<html><head><style>x</style></head><body><nav>a<nav>b</nav>c</nav><p>Hi &amp; <b>you</b></p><script>var t='</p>';</script><!-- no --><footer>f</footer> end</body></html>"
    assert one(spark, [page, None, "plain"], html.clean_html) == ["Hi & you end", None, "plain"]
    assert one(spark, ["<META HTTP-EQUIV='refresh' content=\"0; url=http://a\">", "<p>"], html.refresh_content) == ["0; url=http://a", None]


def test_references_without_a_semicolon(spark):
    """They are text, as in the query's SQL; closed ones are characters."""
    pages = ["<p>a &&amp</p><p>b &amp c &ampx; &lt;d&gt; &copy &copy; &#65; &#65 &nosuch; &</p>", "<p>&&&amp</p><li>x</li>"]
    assert one(spark, pages, html.clean_html) == ["a &&ampb &amp c &ampx; <d> &copy © A &#65 &nosuch; &", "&&&ampx"]


def test_replies(spark):
    fine = '{"company_name": "A", "sectors": ["x", "y"], "capital_sources": "Venture"}'
    df = spark.createDataFrame([(1, f"so ```json\n{fine}\n``` done"), (2, f"```\n{fine}```"), (3, fine), (4, "sorry"), (5, None)], "i int, r string")
    got = df.orderBy("i").select(text.parsed_reply("r").alias("r")).select("r.*").collect()
    assert [r["summary_complete"] for r in got] == [True, True, True, False, False]
    assert [r["company_name"] for r in got] == ["A", "A", "A", None, None]


def test_number_cells(spark):
    assert one(spark, ["$1,200", "12abc", "N/A", "", "-.5e2x", " 7 "], text.number_cell) == [1200.0, 12.0, None, None, -50.0, 7.0]


def test_tokens(spark):
    secret, now = "k" * 80, 1_700_000_000

    def made(item, action, at):
        m = f"{item}:{action}:{at}"
        return f"{m}:{hmac.new(secret.encode(), m.encode(), hashlib.sha256).hexdigest()[:16]}"

    given = [made(3, "approve", now - 5), made(3, "reject", now - 86_400), made(3, "approve", now - 86_401), made(3, "publish", now), "1:2:3", "x:approve:1:2", made(3, "approve", now)[:-1] + "!", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = df.orderBy("i").select(tokens.verdict("t", F.lit(now), secret).alias("v")).select("v.*").collect()
    assert [r["error"] for r in got] == [None, None, "Token expired", "Invalid action", "Invalid token format", "Token parse error", "Invalid signature", "Invalid token format"]
    assert got[2]["item_id"] == 3 and got[3]["item_id"] is None
    signed = spark.range(1).select(tokens.signed(F.lit(3), F.lit("approve"), F.lit(now - 5), secret)).collect()[0][0]
    assert signed == given[0]


def test_commands_and_lists(spark):
    assert one(spark, ["/start x", "/statusx", "/help", "http://a.b", "no", None], rules.command) == ["start", "status", "help", "links", "none", "none"]
    df = spark.createDataFrame([(1,), (2,), (None,)], "u long")
    assert [r[0] for r in df.select(rules.allowed("u", "1, 3")).collect()] == [True, False, False]
    assert [r[0] for r in df.select(rules.allowed("u", "")).collect()] == [True, True, True]


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><title>A</title><link>http://a?x=1&amp;y</link><published>2024-01-02T03:04:05</published></entry><entry><summary>s</summary><published>soon</published></entry></feed>")
    got = sorted((r["title"], r["url"], r["summary"], str(r["published"])) for r in readers.feed_entries(spark, str(tmp_path / "f.xml"), "x").collect())
    assert got == [("A", "http://a?x=1&y", "", "2024-01-02 03:04:05"), ("No title", "", "s", "None")]


def test_blanks_and_open_fences(spark):
    rows = [("a\u00a0  \u00a0 b \u0085 c\u2003  d \u2028 \u3000e\x1cf\r\n\r\ng\u00a0h",)]
    assert spark.createDataFrame(rows, "t string").select(text.clean_whitespace("t")).collect()[0][0] == "a b c d e f g\u00a0h"
    said = [('```json\n{"company_name": "A"}\n', "A"), ('```\n{"company_name": "B"}\n', "B"), ('x ```json {"company_name": "C"}``` y', "C"), ("```json", None), ('{"company_name": "D", "sectors": "x"}', "D")]
    got = spark.createDataFrame(said, "r string, want string").select(text.parsed_reply("r").alias("p"), "want").collect()
    assert all(r["p"]["company_name"] == r["want"] and r["p"]["summary_complete"] == (r["want"] is not None) and r["p"]["sectors"] is None for r in got)
