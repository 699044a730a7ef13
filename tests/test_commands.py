"""Commands over a folder of tables, and updates as a stream."""

import json

from ledgerlark import commands
from ledgerlark.streaming import feed


def test_commands(spark, tmp_path):
    home, landed = str(tmp_path / "home"), tmp_path / "landed"
    landed.mkdir()
    (landed / "feed.xml").write_text("<feed>" + "".join(f"<entry><title>T{i}</title><link>http://a/{i % 3}</link><published>2024-01-0{i + 1}T00:00:00</published></entry>" for i in range(5)) + "</feed>")
    run = lambda *args: [r.asDict() for r in commands.run(spark, list(args)).collect()]
    assert run("rss_fetcher", home, str(landed)) == [{"new": 3, "duplicate": 2}]
    assert run("rss_fetcher", home, str(landed)) == [{"new": 0, "duplicate": 5}]
    assert len(run("article_scraper", home, "2")) == 2 and run("generate_ai_summaries", home, "--force") == []
    assert run("view_data", home, "stats") == [{"feed_source": "landed", "items": 3}] and len(run("view_data", home, "2")) == 2
    assert run("export_to_csv", home) == [] and run("send_digest", home, "--limit", "3") == []
    item = run("article_scraper", home, "1")[0]["id"]
    assert run("inspect_article", home, str(item))[0]["id"] == item
    spark.createDataFrame([(1, item, None, "off")], "id long, item_id long, rejected_at timestamp_ntz, rejection_reason string").write.mode("overwrite").parquet(f"{home}/rejected_items")
    assert [r["reason"] for r in run("view_rejected", home)] == ["off"]
    assert run("view_rejected", home, "--undo", str(item))[0]["outcome"] == "removed" and run("view_rejected", home, "--undo", str(item))[0]["outcome"] == "not found"
    assert run("queue_status", home)[0]["total"] == 3


def test_updates_as_a_stream(spark, tmp_path):
    landed, table = tmp_path / "landed", str(tmp_path / "table")
    landed.mkdir()
    say = lambda i, text, user=1: json.dumps({"message": {"text": text, "chat": {"id": i}, "from": {"id": user}}})
    (landed / "1.txt").write_text("\n".join([say(1, "see http://a.co/x"), say(2, "http://a.co/x http://a.co/y"), say(3, "http://a.co/z", user=9), "{}", say(4, "/status")]))
    feed.run_updates(spark, str(landed), table, str(tmp_path / "state"), "1,2")
    (landed / "2.txt").write_text(say(5, "http://a.co/y http://a.co/w"))
    feed.run_updates(spark, str(landed), table, str(tmp_path / "state"), "1,2")
    assert sorted(r["url"] for r in spark.read.parquet(table).collect()) == ["http://a.co/w", "http://a.co/x", "http://a.co/y"]
