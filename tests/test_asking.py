"""Requests to a model: one halt for all calls in flight, a second try for replies that don't parse, the cache."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from riskloom.operators import references, verify
from riskloom.sources import bridge


def requests(spark, n):
    return spark.range(n).select("id", F.concat(F.lit("q"), "id").alias("prompt"), F.sha2(F.concat(F.lit("m:q"), "id"), 256).alias("key"))


def logged(folder, answer):
    """A provider whose calls are written down, one file a call's text (appends of one line are whole)."""
    path = os.path.join(folder, "calls")

    def provider():
        def chat(text):
            with open(path, "a") as f:
                f.write(json.dumps(text) + "\n")
            return answer(text)

        return chat

    return provider, lambda: [json.loads(x) for x in open(path)] if os.path.exists(path) else []


@pytest.mark.parametrize("concurrency", [1, 10])
def test_one_halt_for_all(spark, tmp_path, concurrency):
    def lost(text):
        raise ConnectionError

    provider, calls = logged(str(tmp_path), lost)
    got = verify.ask_each(requests(spark, 200), provider, concurrency, attempts=3, base_wait=0.0, wave=concurrency).collect()
    said = [r.said for r in got]
    assert len(got) == 200 and all(r.reply is None for r in got) and set(said) == {"exhausted", "not asked"}
    assert 1 <= said.count("exhausted") <= concurrency and len(calls()) <= 3 * concurrency


def test_a_halt_reaches_other_tasks(spark, tmp_path):
    def answer(text):
        if text == "q7":
            raise TimeoutError
        return text

    provider, calls = logged(str(tmp_path), answer)
    got = verify.ask_each(requests(spark, 80), provider, 4, attempts=2, base_wait=0.0, wave=16).collect()
    said = {s: sum(r.said == s for r in got) for s in verify.OUTCOMES}
    assert said["exhausted"] == 1 and said["not asked"] > 0 and sum(said.values()) == 80
    assert len(calls()) == said["replied"] + 2 and all(r.reply == r.prompt for r in got if r.said == "replied")
    assert verify.ask_each(requests(spark, 0), provider, 4).count() == 0


def test_a_reply_that_does_not_parse_is_asked_for_once_more(spark, tmp_path):
    def answer(text):
        if text.startswith("q1") and "JSON" not in text or text.startswith("q2"):
            return "not json"
        if text == "q3":
            raise ValueError
        return "{}"

    provider, calls = logged(str(tmp_path), answer)
    got = {r.id: (r.reply, r.said) for r in verify.ask_each(requests(spark, 5), provider, 2, base_wait=0.0, parse=json.loads, hint="JSON!").collect()}
    assert got == {0: ("{}", "replied"), 1: ("{}", "replied"), 2: (None, "unparsed"), 3: (None, "refused"), 4: ("{}", "replied")}
    assert sorted(calls()) == ["q0", "q1", "q1\n\nJSON!", "q2", "q2\n\nJSON!", "q3", "q4"]


def test_cache_is_written_through(spark, tmp_path):
    at = str(tmp_path / "cache")
    provider, calls = logged(str(tmp_path), lambda text: "{}" if not text.startswith("q2") else "no")
    asked = requests(spark, 6).unionAll(requests(spark, 2))  # two requests twice
    rows, told = verify.ask_cached(asked, at, provider, concurrency=3, base_wait=0.0, parse=json.loads, hint="JSON!")
    assert told["asked"] == 6 and told["replied"] == 5 and told["unparsed"] == 1 and rows.count() == 8 and rows.where("reply IS NULL").count() == 1
    n = len(calls())
    rows, told = verify.ask_cached(asked, at, provider, concurrency=3, base_wait=0.0, parse=json.loads, hint="JSON!")
    assert told["asked"] == 1 and len(calls()) == n + 2  # only what has no reply is asked again
    assert {r.key for r in verify.read_cache(spark, at).collect()} == {r.key for r in asked.where("prompt <> 'q2'").collect()}


def test_cache_merge_keeps_what_is_there(spark, tmp_path):
    at = str(tmp_path / "cache")
    put = lambda *rows: verify.merge_cache(spark, at, spark.createDataFrame(rows, "key string, reply string"))
    assert put(("aa1", "x"), ("aa1", "b"), ("bb2", None), (None, "x"), ("b", "short")) == 2
    assert put(("aa1", "other"), ("cc3", "y")) == 1 and put(("aa1", "other"), ("cc3", "y")) == 0
    assert sorted((r.key, r.reply, r.part) for r in verify.read_cache(spark, at).collect()) == [("aa1", "b", "aa"), ("b", "short", "b"), ("cc3", "y", "cc")]
    assert verify.merge_cache(spark, at, spark.createDataFrame([], "key string, reply string")) == 0


def test_cascade_over_three_tables(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(10, 1), (20, 2), (30, None), (40, 99), (None, 1)], "k int, up int")
    c = spark.createDataFrame([(1, 10, "x"), (2, 20, "x"), (3, None, "x"), (4, 30, "x")], "n int, up int, k string")
    left = references.delete_cascade([(a, ["k"], []), (b, ["k"], ["up"]), (c, ["n"], ["up"])], spark.createDataFrame([(1,), (1,), (7,)], "anything int"))
    assert [sorted(map(str, df.collect())) for df in left] == [sorted(map(str, x)) for x in (a.where("k = 2 OR k IS NULL").collect(), b.where("k IN (20, 30, 40)").collect(), c.where("n > 1").collect())]
    assert [df.count() for df in references.delete_cascade([(a, ["k"], []), (b, ["k"], ["up"])], a.limit(0))] == [3, 5]


def test_exchanges_go_on_beside_the_calls(spark, tmp_path):
    """No wave waits for an exchange, and one long wave still learns of a halt."""
    begin = time.time()
    got = verify.ask_each(requests(spark, 400), lambda: lambda text: text, 2, wave=4).collect()
    assert len(got) == 400 and {r.said for r in got} == {"replied"} and time.time() - begin < 45  # 200 exchanges take longer

    def answer(text):
        if text == "q7":
            raise TimeoutError
        time.sleep(0.25)
        return text

    provider, calls = logged(str(tmp_path), answer)
    got = verify.ask_each(requests(spark, 160), provider, 4, attempts=1, base_wait=0.0, wave=100_000).collect()
    assert len(got) == 160 and [r.said for r in got].count("exhausted") == 1 and len(calls()) < 110


def test_needed_text_of_rules(spark):
    """What is looked for first is in every match of the rule's expression."""
    lines = ["a@b.c", "no mail", "x | y", "x|y", 'token = "' + "0a" * 20 + '"', "token = 0", "", None]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id int, line string").selectExpr("doc_id", "'s' source", "'l' lang", "'f' file", "1 line_no", "line")
    assert {(r.doc_id, r.rule_id) for r in bridge.hits_of(df).collect()} == {(0, "email"), (2, "pipe-row"), (4, "secret-token")}
    assert set(bridge.NEEDED) <= {r[0] for r in bridge.RULES}


def test_stub_asks_only_what_the_cache_lacks(spark, monkeypatch):
    """verify_stub: requests, a cache for a third of them, a model for the rest with a second try, and what it says written through."""
    from riskloom.plans import more

    asked, caches, real, read = [], [], verify.ask_each, verify.read_cache
    monkeypatch.setattr(verify, "ask_each", lambda df, *a, **how: asked.append(({r.key for r in df.collect()}, how)) or real(df, *a, **how))
    monkeypatch.setattr(verify, "read_cache", lambda s, path: caches.append(path) or read(s, path))
    sf_dir = "/root/testdata/sf0.001"
    got = {r.dedup_key: (r.reachable, r.confidence) for r in more.verify_stub(spark, sf_dir).collect()}
    keys = {r.dedup_key: r.key for r in verify.requests(more.merged(spark, sf_dir), "stub").collect()}
    third = {d for d, k in keys.items() if int(k[:8], 16) % 3 == 0}
    assert got == {d: ("yes" if int(d[-1], 16) % 2 else "no", 90 if d in third else 70) for d in keys} and 0 < len(third) < len(keys)
    assert [x for x, _ in asked] == [{keys[d] for d in set(keys) - third}] and asked[0][1]["parse"] is verify.json_object
    assert len(set(caches)) == 1 and {r.key for r in read(spark, caches[0]).collect()} == set(keys.values())


def test_json_object_of_a_reply():
    assert verify.json_object(' ```json\n{"a": 1}\n``` ') == verify.json_object('{"a": 1}') == verify.json_object('```{"a": 1}```') == {"a": 1}
    for reply in ("no json", "", None, "[1]", "3", '{"a": 1'):
        with pytest.raises(ValueError):
            verify.json_object(reply)
