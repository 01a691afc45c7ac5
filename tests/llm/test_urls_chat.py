import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from layerlens.llm import chat, urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def judge(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [(len(r), v, r) for v, r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    if fit:
        return host, path, max(fit)[2], max(fit)[1]
    return host, path, None, "block" if host in listed else "allow"


def test_url_filter(spark, monkeypatch):
    rng = random.Random(1)
    hosts = [f"h{i}.{d}" for i in range(800) for d in ("example.com", "site.org")]
    listed = {h for h in hosts if rng.random() < 0.2}
    found = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr'])}/{i}" for i in range(4000)]
    found += [None, "", "no scheme", "http://", "://x.net", "HTTP://A.Example.NET/en/x?y#z", "http://net/", "http://net?x", "http://xnet/", "http://b.net#/a", "a://b://c.org/fr/", "http://h0.example.com/" + "x" * 100_000, "http://h0.example.com/1", "http://h0.example.com/1"]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id long, url string").withColumn("key", F.lit("clash"))
    keys = spark.createDataFrame([(h,) for h in listed] + [(None,), (next(iter(listed)),)], "key string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_filter(pages, RULES, keys).collect()}
    assert got == {i: judge(u, listed) for i, u in enumerate(found)}
    monkeypatch.setattr(urls, "SHARD_KEYS", 200)  # many shards, in several passes
    monkeypatch.setattr(urls, "BROADCAST_BYTES", 300)
    again = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.url_filter(pages.withColumn("rule", F.lit("clash")), RULES, keys).collect()}
    assert again == got


def test_cascade_of_many_keys():
    rng = np.random.default_rng(2)
    h = np.unique(rng.integers(0, 1 << 63, 60_000, dtype=np.uint64))
    listed = rng.random(len(h)) < 0.2
    found = urls.build_cascade(h, h ^ np.uint64(0x5555), listed)
    assert len(found.levels) >= 3 and (found.contains(h, h ^ np.uint64(0x5555)) == listed).all()
    assert not urls.build_cascade(h, h, np.zeros(len(h), dtype=bool)).levels


def test_url_filter_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.url_filter(pages, RULES, spark.createDataFrame([], "key string")).count() == 0


TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|> \\ <||x"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 0, "system\n<|im", "a"), (2, 0, None, "b"), (3, None, "assistant", "😀é"), (None, 1, "user", "x"), (4, 1, "user", "q"), (4, 2, "assistant", "r"), (4, 2, "assistant", "r")]


def test_chat(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash"))
    segments = chat.format_turns(rows)
    got = {r["conv_id"]: r for r in chat.read_back(segments, chat.examples(segments)).collect()}
    groups = {}
    for c, n, role, text in TURNS:
        groups.setdefault(c, []).append((-1 if n is None else n, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    written = chat.example_texts(segments).collect()
    assert len(written) == chat.examples(segments).count() == sum(r == "assistant" for _, _, r, _ in TURNS)
    whole = {(r["conv_id"], r["target_pos"]): r for r in written}
    for e in chat.examples(segments).collect():  # by reference and written out they are the same
        w = whole[e["conv_id"], e["target_pos"]]
        assert w["text"][e["context_chars"] :] == e["target"] and w["text"][w["loss_start"] : w["loss_end"]] == e["target"][e["loss_start"] : e["loss_end"]]
    one = sorted((r["target_pos"], r["text"], r["text"][r["loss_start"] : r["loss_end"]]) for r in written if r["conv_id"] == 1)
    assert one[0][1].endswith("<|im_end|>\n") and chat.unescape(one[0][2]) == "<|im_end|> \\ <||x" and one[1][1].startswith(one[0][1])


def test_chat_of_nothing(spark):
    segments = chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat.read_back(segments, chat.examples(segments)).count() == chat.example_texts(segments).count() == 0


def test_chat_of_very_long_texts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "<|x" * 200_000), (1, 1, "assistant", "é" * 300_000)], "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(rows)
    got = chat.read_back(segments, chat.examples(segments)).collect()[0]
    assert got["loss_chars"] == 300_000 and got["n_turns"] == 2 and got["context_chars"] > 600_000
    try:
        chat.read_back(segments, chat.examples(segments).withColumn("context_chars", F.lit(0).cast("long"))).collect()
    except Exception as e:
        assert "not the turns before" in str(e)
    else:
        raise AssertionError("a wrong context was read")


def test_written_examples_alone_hold_the_conversations(spark):
    rows = [*TURNS, (5, 0, "user", "only <|im_end|>\n"), (6, 0, "assistant", "first"), (6, 1, "user", "after"), (6, 2, "user\n", "last")]
    segments = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    written = chat.expanded(segments)
    assert sorted(map(str, chat.read_expanded(written).collect())) == sorted(map(str, chat.read_back(segments, chat.examples(segments)).collect()))
    cut = written.withColumn("text", F.when(F.col("conv_id") == 1, F.expr("replace(text, 'hi', concat('h', target_pos))")).otherwise(F.col("text")))
    try:
        chat.read_expanded(cut).collect()
    except Exception as e:
        assert "not the turns before" in str(e)
    else:
        raise AssertionError("a wrong context was read")
