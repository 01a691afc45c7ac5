"""Toxicity: a linear-chain conditional random field tags toxic tokens.

Documents carry labels, tokens do not, so the tags of training documents are
hidden: a toxic document has at least one toxic token, a clean one has none,
and the field takes the weights under which these labels are likeliest, summed
over all taggings (multiple-instance learning).  Which tokens are toxic is left
to the field: a word that clean documents use too is not tagged because one
toxic document has it.  Evidence is a word's or word prefix's log-odds of toxic
documents, at the low end of its confidence interval, counted on two of the
three training folds; the CRF and the calibration are fitted on the third.

Tokens without evidence share one potential, so a run of k of them is the k-th
power of a 2 x 2 matrix: forward and backward passes only step over tokens with
evidence, all documents of a batch at once.  The marginals give offending
offsets; their sum and maximum, with the evidence and the number of words, the
score.

Training reads at most ``MAX_TOXIC`` toxic and ``MAX_CLEAN`` clean labelled
rows (lowest hashes), weighted to the classes' shares among all of them; of their
third fold at most ``FIT_TOXIC`` and ``FIT_CLEAN`` rows fit the field and the
calibration.  The evidence holds every feature of that sample that is strong.
Every row is scored, with its whole text; equal texts, rows that repeat, get equal
scores.  Null texts count as empty; empty texts get the score of a text without
evidence.  A document that is labelled twice counts as toxic if one label says so;
null labels are ignored.  An empty table is scored to an empty result and has
nothing to learn from (``NothingToLearn``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import _VALUES, ALNUM, U, Words, _powers, mix, slices
from .storage import discarding, lowest_hashes, materialise

MAX_TOXIC, MAX_CLEAN, FIT_TOXIC, FIT_CLEAN = 12_000, 36_000, 1_500, 4_500
#: Prefix lengths in bytes that count as evidence beside the whole word.
PREFIXES = (4, 5, 6, 7, 8)
LEAST_DOCS, LEAST_EVIDENCE, RUN = 3, 0.7, 512
Z = 1.64
#: Probability that a document without a toxic token is labelled toxic all the same.
LEAK = 0.02


class NothingToLearn(ValueError):
    """There is no toxic or no clean labelled row."""


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; fold 2 is held out."""
    return F.crc32(doc_id.cast("string")) % 4


def token_features(words: Words) -> list[np.ndarray]:
    """Hashes of each word and of its prefixes (0 where the word is no longer than the prefix)."""
    up, down = _powers(len(words.data) + 1)
    sums = np.zeros(len(words.data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[words.data] * up[: len(words.data)], out=sums[1:])
    out = [words.hash]
    for k in PREFIXES:
        end = np.minimum(words.start + k, words.end)
        h = mix((sums[end] - sums[words.start]) * down[words.start] + U(k))
        h[words.end - words.start <= k] = 0
        out.append(h)
    return out


def _unique_by_row(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes, once for each row that has them."""
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    first = np.ones(len(x), dtype=bool)
    first[1:] = (np.diff(r) != 0) | (x[1:] != x[:-1])
    return x[first & (x != 0)]


def _document_counts(rows: DataFrame, known) -> DataFrame:
    """h, n: number of documents with each feature (only those in ``known``, if given)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(0), ALNUM)
            row, found = words.rows(), []
            for h in token_features(words):
                if known is not None:
                    keys = known.value
                    at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                    ok = keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool)
                    found.append(_unique_by_row(row[ok], h[ok]))
                else:
                    found.append(_unique_by_row(row, h))
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    return rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    evidence: np.ndarray  # lower bound of each feature's log-odds
    weights: np.ndarray  # bias, evidence, strong evidence; log-transitions 0>1, 1>0, 1>1; neutral potential
    calibration: np.ndarray  # of the document features

    def tokens(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Tokens with evidence, and how much."""
        best = np.zeros(len(words))
        if len(self.keys):
            table = np.zeros(1 << 18, dtype=bool)
            table[(self.keys >> U(46)).astype(np.int64)] = True
            for h in token_features(words):
                maybe = np.flatnonzero(table[(h >> U(46)).astype(np.int64)])
                at = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
                ok = self.keys[at] == h[maybe]
                np.maximum.at(best, maybe[ok], self.evidence[at[ok]])
        at = np.flatnonzero(best >= LEAST_EVIDENCE)
        return at, best[at]


@dataclass
class Chains:
    """Evidence tokens of many documents: step-major order, gaps of neutral tokens before each and after the last."""

    gap: np.ndarray
    evidence: np.ndarray
    at: np.ndarray  # n + 1 offsets
    tail: np.ndarray


def chains(words: Words, token: np.ndarray, evidence: np.ndarray) -> Chains:
    at = np.searchsorted(token, words.at)
    before = np.concatenate([[-1], token[:-1]]) if len(token) else token
    first = at[:-1][at[:-1] < at[1:]]
    gap = token - before - 1
    row = np.searchsorted(words.at, token[first], side="right") - 1
    gap[first] = token[first] - words.at[row]
    last = np.where(at[1:] > at[:-1], token[np.maximum(at[1:] - 1, 0)] + 1 if len(token) else 0, words.at[:-1])
    return Chains(gap, evidence, at, words.at[1:] - last)


def _run_powers(step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..RUN of a 2 x 2 matrix, scaled to sum 1, and the logs of their scales."""
    out, logs, m, log = np.empty((RUN + 1, 2, 2)), np.empty(RUN + 1), np.eye(2) / 2, math.log(2)
    for k in range(RUN + 1):
        out[k], logs[k] = m, log
        m = m @ step
        log += math.log(m.sum())
        m = m / m.sum()
    return out, logs


def forward_backward(c: Chains, w: np.ndarray, marginals: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """log Z of each document and the toxic marginal of each evidence token."""
    trans = np.array([[1.0, math.exp(w[3])], [math.exp(w[4]), math.exp(w[5])]])
    powers, logs = _run_powers(trans * np.array([1.0, math.exp(w[6])]))
    extra = logs[RUN] - logs[RUN - 1]
    run = lambda g: (powers[np.minimum(g, RUN)], logs[np.minimum(g, RUN)] + np.maximum(g - RUN, 0) * extra)
    potential = np.exp(np.clip(w[0] + w[1] * c.evidence + w[2] * np.minimum(c.evidence, 2), -30, 30))
    n = np.diff(c.at)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max()) if len(n) else 0
    live = np.searchsorted(-n[order], -np.arange(longest), side="left")
    state, log_z = np.tile([1.0, 0.0], (len(n), 1)), np.zeros(len(n))  # before the first token: clean
    alpha = np.zeros((len(c.evidence), 2))
    for t in range(longest):
        docs = order[: live[t]]
        at = c.at[docs] + t
        p, log = run(c.gap[at])
        x = np.einsum("ni,nij->nj", state[docs], p) @ trans
        x[:, 1] *= potential[at]
        scale = x.sum(axis=1)
        state[docs] = alpha[at] = x / scale[:, None]
        log_z[docs] += np.log(scale) + log
    p, log = run(c.tail)
    end = np.einsum("ni,nij->n", state, p)
    log_z += np.log(end) + log
    if not marginals:
        return log_z, alpha[:, 1]
    beta = p.sum(axis=2)
    out = np.zeros(len(c.evidence))
    for t in range(longest - 1, -1, -1):
        docs = order[: live[t]]
        at = c.at[docs] + t
        b = beta[docs]
        both = alpha[at] * b
        out[at] = both[:, 1] / both.sum(axis=1)
        back = b.copy()
        back[:, 1] *= potential[at]
        x = np.einsum("nij,nj->ni", run(c.gap[at])[0], back @ trans.T)
        beta[docs] = x / x.sum(axis=1)[:, None]
    return log_z, out


def label_loss(c: Chains, toxic: np.ndarray, w: np.ndarray) -> float:
    """Minus the log likelihood of the documents' labels, whatever their tokens' tags.

    A text without a toxic token has one tagging, of weight 1, so it has a probability of 1 / Z.  A document is labelled toxic if it has a toxic token,
    and with a probability of ``LEAK`` if it has none."""
    log_z = forward_backward(c, w, marginals=False)[0]
    clean = math.log1p(-LEAK) - log_z
    return -float(np.where(toxic > 0, np.log1p(-np.exp(clean)), clean).sum())


def fit_crf(c: Chains, toxic: np.ndarray) -> np.ndarray:
    """Weights of greatest penalised likelihood of the labels of documents (1: toxic), summed over all taggings that give them, by quasi-Newton steps."""
    documents = max(1, len(c.tail))
    prior = np.array([-3.0, 1.0, 0.0, -2.0, 0.0, 0.0, -8.0])

    def loss(w: np.ndarray) -> float:
        return label_loss(c, toxic, w) / documents + 1e-3 * float(((w - prior) ** 2).sum())

    def slope(w: np.ndarray) -> np.ndarray:
        eye = np.eye(len(w)) * 1e-4
        return np.array([(loss(w + e) - loss(w - e)) / 2e-4 for e in eye])

    w, inverse = prior.copy(), np.eye(len(prior))
    value, grad = loss(w), slope(w)
    for _ in range(40):
        step, size = -inverse @ grad, 1.0
        while (new := loss(w + size * step)) > value + 1e-4 * size * float(grad @ step) and size > 1e-5:
            size /= 2
        if new >= value - 1e-9:
            break
        moved = size * step
        w, value, old = w + moved, new, grad
        grad = slope(w)
        turned = grad - old
        if (curve := float(moved @ turned)) > 1e-10:
            a = np.eye(len(w)) - np.outer(moved, turned) / curve
            inverse = a @ inverse @ a.T + np.outer(moved, moved) / curve
    return w


def document_features(c: Chains, marginal: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """1, log words, largest marginal, and the sums of the marginals and of the evidence, as logs, alone and for their words."""
    doc = np.repeat(np.arange(len(n_words)), np.diff(c.at))
    most = np.zeros(len(n_words))
    np.maximum.at(most, doc, marginal)
    sums = [np.bincount(doc, x, minlength=len(n_words)) for x in (marginal, c.evidence)]
    return np.stack([np.ones(len(n_words)), np.log1p(n_words), most, *(np.log1p(y) for x in sums for y in (x, x * 500 / (n_words + 50)))], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-3, *[0.3] * (x.shape[1] - 1)])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge @ w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _lower_bound(p: np.ndarray, d: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    p, d = p + 0.5, d + 0.5
    return np.log(p / (n_toxic + 1)) - np.log(d / (n_clean + 1)) - Z * np.sqrt(1 / p + 1 / d)


@discarding()
def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on labelled rows that are not held out; raises if there is no toxic or no clean one."""
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull() & (fold(F.col(key)) != 2)).groupBy(key).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(key)
    chosen = [lowest_hashes(marked.where(F.col("toxic") == y).select(F.col(key).alias("_key"), "toxic", order.alias("h")), "h", n) for y, n in ((1, MAX_TOXIC), (0, MAX_CLEAN))]
    sample = chosen[0].union(chosen[1])  # at most MAX_TOXIC + MAX_CLEAN ids
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("text")).join(F.broadcast(sample), "_key")
    rows = materialise(rows.select("text", "toxic", "h", (fold(F.col("_key")) == 3).alias("fits")), "labelled")
    sizes = {(r["toxic"], r["fits"]): r["n"] for r in rows.groupBy("toxic", "fits").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = (sizes.get((y, False), 0) for y in (1, 0))
    if not (n_toxic and n_clean):
        raise NothingToLearn("no toxic or no clean labelled rows to train on")
    counted = rows.where(~F.col("fits"))
    toxic = _document_counts(counted.where("toxic = 1"), None).where(F.col("n") >= LEAST_DOCS).select("h", "n").toArrow()
    keys = np.sort(toxic.column("h").to_numpy().view(np.uint64))
    clean = _document_counts(counted.where("toxic = 0"), spark.sparkContext.broadcast(keys)).select("h", "n").toArrow()
    p, d = np.zeros(len(keys)), np.zeros(len(keys))
    for counts, found in ((p, toxic), (d, clean)):
        counts[np.searchsorted(keys, found.column("h").to_numpy().view(np.uint64))] = found.column("n").to_numpy()
    bound = _lower_bound(p, d, n_toxic, n_clean)
    strong = bound >= LEAST_EVIDENCE
    model = Model(keys[strong], bound[strong], np.zeros(7), np.zeros(7))
    shared = spark.sparkContext.broadcast(model)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            words = Words(batch.column(0), ALNUM)
            at, evidence = shared.value.tokens(words)
            cuts = np.searchsorted(at, words.at)
            own = [at[a:b] - low for a, b, low in zip(cuts, cuts[1:], words.at)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(np.diff(words.at), pa.int64()), pa.array([x.tolist() for x in own], pa.list_(pa.int64())), pa.array([evidence[a:b].tolist() for a, b in zip(cuts, cuts[1:])], pa.list_(pa.float64()))], ["toxic", "words", "at", "evidence"])

    fitted = rows.where("fits") if sizes.get((1, True)) and sizes.get((0, True)) else rows
    parts = [lowest_hashes(fitted.where(F.col("toxic") == y), "h", n) for y, n in ((1, FIT_TOXIC), (0, FIT_CLEAN))]
    found = [r for part in parts for r in part.select("text", "toxic").mapInArrow(tokens, "toxic int, words long, at array<long>, evidence array<double>").collect()]
    y = np.array([r["toxic"] for r in found], dtype=float)
    n_words = np.array([r["words"] for r in found], dtype=np.int64)
    ends = np.cumsum([len(r["at"]) for r in found])
    flat = np.array([a for r in found for a in r["at"]], dtype=np.int64)
    chain = Chains(np.array([g for r in found for g in np.diff([-1, *r["at"]]) - 1], dtype=np.int64), np.array([e for r in found for e in r["evidence"]], dtype=float), np.concatenate([[0], ends]).astype(np.int64),
                   np.array([r["words"] - 1 - (r["at"][-1] if r["at"] else -1) for r in found], dtype=np.int64))
    model.weights = fit_crf(chain, y)
    x = document_features(chain, forward_backward(chain, model.weights)[1], n_words)
    copies = docs.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    labelled = copies.join(marked.select(F.col(key).alias("_key"), "toxic"), "_key").groupBy("toxic").agg(F.sum("n").alias("n"))
    total = {r["toxic"]: r["n"] for r in labelled.collect()}  # of all labelled rows, so the bounds do not move the prior
    share = {label: total[label] / max(1, int((y == label).sum())) for label in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    model.calibration = fit_logistic(x, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add toxic_score (0 to 1) and toxic_spans (code points, of tokens with a marginal of ``threshold`` or more) to ``docs``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # strong features of the bounded sample
    rows = docs.drop("toxic_score", "toxic_spans")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            words = Words(batch.column(text), ALNUM)
            at, evidence = m.tokens(words)
            c = chains(words, at, evidence)
            marginal = forward_backward(c, m.weights)[1]
            x = document_features(c, marginal, np.diff(words.at))
            p = 1 / (1 + np.exp(-np.clip(x @ m.calibration, -30, 30)))
            chars = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
            spans = []
            for r, (a, b) in enumerate(zip(c.at, c.at[1:])):
                own, low = at[a:b][marginal[a:b] >= threshold], chars[words.offsets[r]]
                spans.append([{"start": int(chars[words.start[i]] - low), "end": int(chars[words.end[i]] - low)} for i in own.tolist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array(spans, pa.list_(span))], [*batch.schema.names, "toxic_score", "toxic_spans"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "toxic_score double, toxic_spans array<struct<start:int,end:int>>"])
    return rows.mapInArrow(judge, schema)
