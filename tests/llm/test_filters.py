import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerlens.llm import decontamination, private_data, toxicity


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def brute_contamination(docs, items, size=10):
    held = {}
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for p in range(len(w) - n + 1) if n else []:
            held.setdefault(tuple(w[p : p + n]), set()).add(i)
    out = []
    for k, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in held}:
            for p in range(len(w) - n + 1):
                if own := held.get(tuple(w[p : p + n])):
                    found |= own
                    hit |= set(range(p, p + n))
        out.append((-1 if k is None else k, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def contaminated(docs, bench):
    out = decontamination.contamination(docs, bench).collect()
    return sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in out), key=str)


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_contamination(spark, sf, odd, monkeypatch, most):
    """Also with a benchmark of many blocks."""
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", most)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12 if most == 40 else 100).collect()]
    items += [(900, "the same text"), (901, "word " * 10), (902, None), (903, "..."), (904, "A"), (901, "a b"), (905, "café 日本語"), (906, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert contaminated(docs, bench) == brute_contamination([(r[0], r[1]) for r in docs.collect()], items)


def test_contamination_plan_of_many_blocks(spark, odd, monkeypatch):
    """What reads the result probes at most one block, however many the benchmark has; a clash with the row number is told apart."""
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", 1)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "the same text")], "item_id long, text string")
    docs = odd.withColumn("_row", F.lit(7)).withColumn("_ROW_", F.lit(8))
    out = decontamination.contamination(docs, bench)
    assert out._jdf.queryExecution().toString().count("MapInArrow") == 0
    assert out.where("_row = 7 and _ROW_ = 8").count() == odd.count()
    assert contaminated(docs, bench) == brute_contamination([(r["doc_id"], r["text"]) for r in odd.collect()], [tuple(r) for r in bench.collect()])


def test_contamination_of_nothing(spark, odd, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(odd, bench) == brute_contamination([(r[0], r[1]) for r in odd.collect()], [])
    assert decontamination.contamination(empty, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    clash = odd.withColumn("items", F.lit("x")).withColumn("n_words", F.lit("y"))
    assert decontamination.contamination(clash, bench).count() == odd.count()


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def naive_spans(text):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    valid = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s)), lambda s: 9 <= len(digits(s)) <= 15]
    return [(k, m.start(), m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if valid[k](m.group())]


def test_base_spans(spark, sf):
    rng = random.Random(2)
    parts = ["@", "a", "b.c", ".", "-", "+", "1", "23", "456", " ", "(", ")", "4111111111111111", "10.0.0.1", "é", "x@y.zz", "+1 (017) 555-7713", "256", "%", "\n", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(6000)]
    texts += [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for t in texts:
        assert private_data.base_spans(t) == naive_spans(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a." * 150_000, "a@" * 100_000, "+1" * 100_000, "1." * 150_000, "1 " * 150_000, "(at)" * 50_000, "a at " * 40_000):
        private_data.base_spans(t)
        private_data.candidates(t)


def test_private_data(spark, sf, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(odd.selectExpr("doc_id + 100000", "text"))
    models = private_data.fit(docs)
    extra = spark.createDataFrame([(1, "call (974) 555-3436 or mail jo (at) mail7.example.com", "x")], "doc_id long, text string, spans string")
    out = private_data.find_private_data(docs.withColumn("spans", F.lit("clash")).union(extra), models).collect()
    for r in out:
        base = [(private_data.KINDS.index(s["kind"]), s["start"], s["end"]) for s in r["base_spans"]]
        assert base == naive_spans(r["text"] or "")
        assert {tuple(s) for s in r["base_spans"]} <= {tuple(s) for s in r["spans"]}
        if not r["spans"]:
            assert r["redacted"] == r["text"]
        elif not any(k == 0 for k, _, _ in base):
            assert naive_spans(r["redacted"]) == []
    assert set(models) == {0, 1, 2, 3}
    assert {s["kind"] for s in out[-1]["spans"]} == {"email", "phone"}
    assert private_data.fit(empty) == {} and private_data.find_private_data(empty, {}).count() == 0


def cut_candidates(text):
    return {(k, text[a:b]) for k, a, b in private_data.candidates(text)}


def test_candidates_inside_runs():
    """Spans start and end at every digit group, and at every end of a domain."""
    assert {(2, "7536784127813050"), (2, "4845168114407329")} <= cut_candidates("pay 7536784127813050 4845168114407329 now")
    assert (2, "4111111111111111") in cut_candidates("4111111111111111 12 27")
    assert {(3, "(974) 555-3436"), (3, "555-3436")} <= cut_candidates("call (974) 555-3436 2024-01-05")
    assert {(1, "1 2 3 4"), (1, "2 3 4 5")} == cut_candidates("1 2 3 4 5")
    assert cut_candidates("to name at host.tld please") == {(0, "name at host.tld")}
    assert cut_candidates("\u0130\u0130 jo (AT) a dot b.org") == {(0, "jo (AT) a dot b"), (0, "jo (AT) a dot b.org")}


def test_private_data_side_by_side(spark):
    """Neighbours do not hide each other, and nothing that the fixed patterns know is left after redaction."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    models = private_data.fit(docs)
    for text, found in [
        ("pay 7536784127813050 4845168114407329 now", ["7536784127813050", "4845168114407329"]),
        ("2353820953013749 4550997810720808", ["4550997810720808"]),
        ("card 4111111111111111 12 27 ok", ["4111111111111111"]),
        ("4111 1111 1111 1111 5500 0000 0000 0004", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
        ("call (974) 555-3436 2024-01-05 ok", ["(974) 555-3436"]),
        ("write to name at host.tld please", ["name at host.tld"]),
    ]:
        base, added = private_data.judge(text, models)
        assert base == [] and [text[a:b] for _, a, b in sorted(added, key=lambda s: s[1])] == found
    redacted = [r["redacted"] for r in private_data.find_private_data(docs, models).where("size(spans) > 0").collect()]
    assert not [t for t in redacted if naive_spans(t)]


def test_private_data_rare_kind(spark, monkeypatch):
    """A kind in one text of a hundred is learnt from the whole table, also beside a large group of copies."""
    monkeypatch.setattr(private_data, "SAMPLE_TEXTS", 40)
    texts = [f"note {i} of page {i * 7} and 12 34 {i} more" for i in range(4000)] + [f"host {i % 200}.7.{i}.9 was item {i}" for i in range(40)] + ["copy 5 of 6"] * 2000
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    models = private_data.fit(docs)
    assert set(models) == {1}
    assert private_data.judge("host 10 . 7 . 3 . 9 was", models)[1] == [(1, 5, 19)]


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train(docs, labels)
    held = toxicity.score(docs.join(labels.select("doc_id", "toxic"), "doc_id"), model).where(toxicity.fold(F.col("doc_id")) == 2).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    y, p = np.array([r["toxic"] for r in held]), np.array([r["toxic_score"] for r in held])
    recall, precision = (p[y == 1] >= 0.3).mean(), y[p >= 0.3].mean()
    print("recall", recall, "precision", precision, len(held))
    assert recall > 0.9 and precision > 0.9
    text = spark.createDataFrame([(1, "é you idiot and scum, worthless trash", 1), (2, None, 2), (3, "", 3)], "doc_id long, text string, toxic_score int")
    got = {r["doc_id"]: r for r in toxicity.score(text, model).collect()}
    assert [got[1]["text"][s["start"] : s["end"]] for s in got[1]["toxic_spans"]] == ["idiot", "scum", "worthless", "trash"]
    assert got[2]["toxic_score"] == got[3]["toxic_score"] < 0.3


@pytest.mark.parametrize("bounds", [(12_000, 36_000), (150, 200)])
def test_toxicity_prior(spark, monkeypatch, bounds):
    """The calibration sees the classes in the shares of all labelled rows, whether or not the bounds are met."""
    d, seen = "/root/testdata/sf0.1", []
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    fit = toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "MAX_TOXIC", bounds[0])
    monkeypatch.setattr(toxicity, "MAX_CLEAN", bounds[1])
    monkeypatch.setattr(toxicity, "fit_logistic", lambda x, y, w: seen.append(w[y == 1].sum() / w.sum()) or fit(x, y, w))
    toxicity.train(docs, labels)
    marked = {r[0]: r[1] for r in labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic")).collect() if zlib.crc32(str(r[0]).encode()) % 4 != 2}
    own = [marked[r[0]] for r in docs.select("doc_id").collect() if r[0] in marked]
    assert abs(seen[0] - np.mean(own)) < 1e-9


def test_toxicity_odd_inputs(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)] + [(None, 1), (1, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert all(0 <= r["toxic_score"] <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.score(empty, model).count() == 0
    with pytest.raises(ValueError, match="no toxic"):
        toxicity.train(odd, labels.limit(0))


def test_crf_marginals_by_enumeration():
    """Forward-backward over evidence tokens equals summing all tag paths over every token."""
    import itertools

    rng = np.random.default_rng(1)
    w = np.array([-1.0, 0.7, 0.3, -1.2, 0.4, 0.6, -2.0])
    lengths, at, token, evidence = [5, 3, 6, 2], [0], [], []
    starts = np.cumsum([0, *lengths])
    for n, low in zip(lengths, starts):
        own = np.flatnonzero(rng.random(n) < 0.5)
        token += (own + low).tolist()
        evidence += rng.random(len(own)).tolist()
        at.append(len(token))

    class Fake:
        pass

    fake = Fake()
    fake.at = starts
    c = toxicity.chains(fake, np.array(token), np.array(evidence))
    log_z, marginal = toxicity.forward_backward(c, w)
    trans = np.array([[0, w[3]], [w[4], w[5]]])
    likelihood, toxic = 0.0, np.arange(len(lengths)) % 2
    for d, n in enumerate(lengths):
        own = {t - starts[d]: e for t, e in zip(token[at[d] : at[d + 1]], evidence[at[d] : at[d + 1]])}
        total, hot = 0.0, dict.fromkeys(own, 0.0)

        def path_score(path):
            s, before = 0.0, 0
            for i, y in enumerate(path):
                s += trans[before, y] + (y * (w[0] + w[1] * own[i] + w[2] * min(own[i], 2)) if i in own else y * w[6])
                before = y
            return s

        for path in itertools.product((0, 1), repeat=n):
            z = np.exp(path_score(path))
            total += z
            for i in own:
                hot[i] += z * path[i]
        assert abs(np.log(total) - log_z[d]) < 1e-9
        assert np.allclose([hot[i] / total for i in own], marginal[at[d] : at[d + 1]])
        clean = np.exp(path_score((0,) * n)) / total * (1 - toxicity.LEAK)
        likelihood += np.log(1 - clean if toxic[d] else clean)
    assert abs(likelihood + toxicity.label_loss(c, toxic, w)) < 1e-9


def test_toxic_tokens_are_found_without_labels():
    """Of two words in every toxic text, that which clean texts have too is not tagged, though no token has a label."""
    toxic = np.arange(300) % 3 == 0
    evidence = [[0.8, 2.5] if y else [0.8] * (i % 2) for i, y in enumerate(toxic)]
    n = np.array([len(e) for e in evidence])
    c = toxicity.Chains(np.full(n.sum(), 5), np.concatenate(evidence), np.concatenate([[0], np.cumsum(n)]), np.full(300, 5))
    marginal = toxicity.forward_backward(c, toxicity.fit_crf(c, toxic.astype(float)))[1]
    assert marginal[c.evidence > 1].min() > 0.8 and marginal[c.evidence < 1].max() < 0.3
