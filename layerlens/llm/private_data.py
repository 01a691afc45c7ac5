"""Personal data: candidate spans from high-recall generators, judged by boosted trees.

1. Base spans follow fixed patterns with validators (email, ip, card, phone) and
   always stay.
2. Generators propose more spans, overlapping freely: written-out emails
   (``name (at) host dot org``) with every end of the domain, and numbers of many
   shapes from every digit group to every later one whose digits fit the kind.
3. For each kind, gradient-boosted trees over format and context features give a
   probability.  Nobody labels spans here, so positives are the base spans of a
   sample and disguised copies of them set in their own surroundings; negatives
   are the sample's other candidates.  A Platt curve on held-out documents
   calibrates, and the threshold is the lowest with the wanted precision there.
4. Candidates over the threshold that overlap no stronger span are added, and
   so is what the fixed patterns find in the text left between them.

The model is fitted on at most ``SAMPLE_TEXTS`` distinct texts with a base span
of each kind, and as many of any kind, those of lowest hash in the whole table,
and ``SAMPLE_SPANS`` candidates of each.  All rows are judged with whole texts.
Offsets are in code points, ends exclusive.  Null texts count as empty and have
no spans; a kind with too few base spans in the table gets no more.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discarding, lowest_hashes, materialise

KINDS = ("email", "ip", "card", "phone")
SAMPLE_TEXTS, SAMPLE_SPANS, PRECISION, CHUNK = 3000, 100, 0.99, 4096

# Fixed patterns of the base spans.  Runs hold every number span whole, so the rest need not scan the text.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
RUN = re.compile(r"\+?[0-9][0-9\x20().+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Generators.
MARK = re.compile(r"@|\(at\)|\[at\]|(?<=\x20)at(?=\x20)", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
NEXT_LABEL = re.compile(r"(?:\.|\x20?(?:\(dot\)|\[dot\]|\x20dot\x20)\x20?)[A-Za-z0-9-]{1,63}", re.I)
MAX_LOCAL, MAX_DOMAIN = 64, 400
GROUP = re.compile(r"[0-9]+")
QUAD_GAP = re.compile(r"\x20?\.\x20?|\x20")
NUMBER_GAP = re.compile(r"[\x20().-]{1,2}")
MORE_LEFT, MORE_RIGHT = re.compile(r"[0-9][\x20().-]{0,2}\Z"), re.compile(r"[\x20().-]{0,2}[0-9]")
SIZES = {2: (12, 19), 3: (7, 15)}  # digits of the numbers proposed
NEAR = {"email": re.compile(r"mail|contact|write|@", re.I), "ip": re.compile(r"\bip\b|addr|host|server", re.I), "card": re.compile(r"card|visa|pay|credit|konto", re.I), "phone": re.compile(r"tel|phone|call|fax|mobil", re.I)}
REFUSED = re.compile(r"token|key|id|hash|version|=|#|\$", re.I)

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start.  Emails start at each @ (its run of local characters reaches back to the last match), so long runs cost no more."""
    out: list[list[Span]] = [[], [], [], []]
    at, low = text.find("@"), 0
    while at >= 0:
        back = len(text[low:at].rstrip(LOCAL)) + low
        found = DOMAIN.match(text, at + 1) if back < at else None
        if found:
            out[0].append((0, back, found.end()))
            low = found.end()
        else:
            low = at + 1
        at = text.find("@", low)
    for run in RUN.finditer(text):
        part, start = run.group(), run.start()
        if len(part) < 7:
            continue
        out[1] += [(1, start + m.start(), start + m.end()) for m in IP.finditer(part) if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m.group().split("."))]
        if len(part) < 10:
            continue
        for m in CARD.finditer(part):
            if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                out[2].append((2, start + m.start(), start + m.end()))
        if "+" in part:
            out[3] += [(3, start + m.start(), start + m.end()) for m in PHONE.finditer(part) if 9 <= len(_digits(m.group())) <= 15]
    return [s for spans in out for s in spans]


def _spelled(text: str) -> Iterator[Span]:
    """Emails of any spelling: for each mark the local part before it, up to each end of the domain after it."""
    for mark in MARK.finditer(text):
        a, b = mark.span()
        if mark.group()[0] in "aA":  # the word stands between blanks
            a, b = a - 1, b + 1
        a, b = a - (text[a - 1 : a] == " "), b + (text[b : b + 1] == " ")
        low = max(0, a - MAX_LOCAL)
        own = text[low + len(text[low:a].rstrip(LOCAL)) : a].lstrip(".")
        found = LABEL.match(text, b) if own else None
        while found and (found := NEXT_LABEL.match(text, found.end())) and found.end() <= b + MAX_DOMAIN:
            yield 0, a - len(own), found.end()


def _numbers(text: str) -> Iterator[Span]:
    """Numbers from every digit group of a run to every later one; at most 19 digits are looked at, so this is linear."""
    for run in RUN.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, run.start(), run.end())]
        if sum(b - a for a, b in groups) < 4:
            continue
        gaps = [text[b:a] for (_, b), (a, _) in zip(groups, groups[1:])]
        for i, (start, _) in enumerate(groups):
            if all(b - a <= 3 for a, b in groups[i : i + 4]) and len(groups) >= i + 4 and all(map(QUAD_GAP.fullmatch, gaps[i : i + 3])):
                yield 1, start, groups[i + 3][1]
            lead = start - (text[start - 1 : start] in ("+", "("))
            n = 0
            for k in range(i, len(groups)):
                a, b = groups[k]
                n += b - a
                if n > 19 or (k > i and not NUMBER_GAP.fullmatch(gaps[k - 1])):
                    break
                for kind, (least, most) in SIZES.items():
                    if least <= n <= most:
                        yield kind, lead, b


def _proposed(text: str) -> Iterator[Span]:
    yield from _spelled(text)
    yield from _numbers(text)


def candidates(text: str) -> list[Span]:
    """High-recall spans of each kind; they may overlap."""
    return sorted(set(_proposed(text)))


def features(text: str, span: Span) -> list[float]:
    """Format and context of a span."""
    kind, a, b = span
    own, left, right = text[a:b], text[max(0, a - 24) : a], text[b : b + 12]
    digits = _digits(own)
    groups = [len(g) for g in re.findall(r"[0-9]+", own)] or [0]
    near = NEAR[KINDS[kind]]
    return [
        len(own), len(digits), len(groups), max(groups), min(groups), groups[0], groups[-1],
        own.count("."), own.count(" "), own.count("-"), own.count("(") + own.count("["), float(own[:1] == "+"), float("@" in own),
        float(kind == 2 and luhn(digits)), float(kind == 1 and all(int(g[:4] or 0) <= 255 for g in re.findall(r"[0-9]+", own))),
        float(left[-1:].isalnum()), float(right[:1].isalnum()), float(left[-1:] in "\"'=/#$"), float(bool(near.search(left))), float(bool(REFUSED.search(left[-10:]))), float(digits[:1] == "0"),
        float(len(set(digits))),
        float(kind > 0 and bool(MORE_LEFT.search(left[-3:]))), float(bool((MORE_RIGHT if kind else NEXT_LABEL).match(text, b))),
    ]


def disguised(text: str, span: Span) -> list[tuple[str, list[Span]]]:
    """A base span rewritten as people hide it, or set beside other numbers, in its own surroundings."""
    kind, a, b = span
    own, left, right = text[a:b], text[max(0, a - 40) : a], text[b : b + 40]
    digits = _digits(own)
    spaced = " ".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = f"({digits[1:4]}) {digits[4:7]}-{digits[7:]}"
    forms = {  # what is of the kind, and what stands between
        0: [[own.replace("@", " (at) ")], [own.replace("@", " at ")], [own.replace("@", " [at] ").replace(".", " [dot] ")], [own.replace("@", " at ").replace(".", " dot ")]],
        1: [[own.replace(".", " . ")], [own.replace(".", " ")]],
        2: [[spaced], [".".join(digits[i : i + 4] for i in range(0, len(digits), 4))], [own, " ", own], [spaced, " ", spaced], [own, " 12 27"], ["", "2024-01-05 ", own]],
        3: [[own.lstrip("+")], [local], [f"{digits[1:4]}-{digits[4:7]}-{digits[7:]}"], [own, " 2024-01-05"], [local, " 2024-01-05"], ["", "2024-01-05 ", local]],
    }[kind]
    out = []
    for parts in forms:
        ends = [len(left)]
        for part in parts:
            ends.append(ends[-1] + len(part))
        out.append((left + "".join(parts) + right, [(kind, ends[i], ends[i + 1]) for i in range(0, len(parts), 2) if parts[i]]))
    return out


def _alone(text: str, span: Span) -> bool:
    """Whether the span would be a base span if it stood alone."""
    own = text[span[1] : span[2]]
    return (span[0], 0, len(own)) in base_spans(own)


def _overlaps(span: Span, others: list[Span]) -> bool:
    return any(span[0] == k and span[1] < b and a < span[2] for k, a, b in others)


def examples(text: str) -> Iterator[tuple[int, int, list[float]]]:
    """kind, whether it is one, features: the base spans and their disguised copies, against other candidates and what overlaps a copy."""
    base = base_spans(text)
    proposed = candidates(text)
    for kind in range(len(KINDS)):
        own = [s for s in base if s[0] == kind][:SAMPLE_SPANS]
        for s in own:
            yield kind, 1, features(text, s)
            for copy, true in disguised(text, s):
                for t in true:
                    yield kind, 1, features(copy, t)
                for c in candidates(copy):
                    if c not in true and _overlaps(c, true) and not _alone(copy, c):
                        yield kind, 0, features(copy, c)
        others = (s for s in proposed if s[0] == kind and not _overlaps(s, base) and not _alone(text, s))
        for s in itertools.islice(others, SAMPLE_SPANS):
            yield kind, 0, features(text, s)


class Trees:
    """Gradient-boosted trees for the logistic loss over binned features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 24, ridge: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = math.log(mean / (1 - mean)), []
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, p - y, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, binned, g, h, rows, depth):
        total, weight = g[rows].sum(), h[rows].sum()
        best = (1e-6, None, None)
        if depth and len(rows) >= 8:
            for f, cuts in enumerate(self.cuts):
                b = binned[rows, f]
                gs, hs = (np.cumsum(np.bincount(b, v[rows], len(cuts) + 1))[:-1] for v in (g, h))
                if len(gs):
                    gain = gs**2 / (hs + self.ridge) + (total - gs) ** 2 / (weight - hs + self.ridge) - total**2 / (weight + self.ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
        if best[1] is None:
            return -self.rate * total / (weight + self.ridge)
        _, f, k = best
        left = binned[rows, f] <= k
        return f, self.cuts[f][k], self._grow(binned, g, h, rows[left], depth - 1), self._grow(binned, g, h, rows[~left], depth - 1)

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, cut, low, high = tree
        return np.where(x[:, f] <= cut, self._apply(low, x), self._apply(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum(self._apply(t, x) for t in self.trees)


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibration curve."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * score + b)))
        w = p * (1 - p)
        grad = np.array([((p - y) * score).sum() + 1e-2 * a, (p - y).sum()])
        hess = np.array([[(w * score * score).sum() + 1e-2, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(hess, grad)
    return float(a), float(b)


@discarding()
def fit(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> dict[int, tuple]:
    """kind: (trees, slope, offset, threshold) from a bounded sample."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(kind, y, h, x) for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for kind, y, x in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["kind", "y", "h", "x"])

    most, common = SAMPLE_TEXTS, len(KINDS)

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kind, h: a task's lowest text hashes of each kind, and of all texts; copies count once."""
        held: list[set[int]] = [set() for _ in range(common + 1)]
        for batch in batches:
            for t, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind in {common, *(s[0] for s in base_spans(t))}:
                    held[kind].add(h)
            held = [set(sorted(x)[:most]) if len(x) > 2 * most else x for x in held]
        out = [(kind, h) for kind, x in enumerate(held) for h in sorted(x)[:most]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int64())], ["kind", "h"])

    texts = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    found = materialise(texts.mapInArrow(lowest, "kind int, h long"), "private-sample")
    chosen = [lowest_hashes(found.where(F.col("kind") == kind).select("h").distinct(), "h", most) for kind in range(common + 1)]
    sample = texts.join(F.broadcast(functools.reduce(DataFrame.union, chosen).distinct()), "h").dropDuplicates(["h"]).select("text", "h")
    rows = sample.mapInArrow(learn, "kind int, y int, h long, x array<double>").toArrow().combine_chunks()  # columns, as rows would fill the driver
    kinds, labels, hashes = (rows.column(c).to_numpy() for c in ("kind", "y", "h"))
    flat = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1))
    models = {}
    for kind in range(len(KINDS)):
        own = np.flatnonzero(kinds == kind)
        own = own[np.lexsort((*flat[own].T, labels[own], hashes[own]))]
        x, y, texts = flat[own], labels[own].astype(float), hashes[own]
        held = np.isin(texts, np.unique(texts)[::4])  # every fourth text that has the kind
        if len(own) < 20 or min(y[held].sum(), y[~held].sum()) < 3:
            continue
        trees = Trees().fit(x[~held], y[~held])
        slope, offset = platt(trees.score(x[held]), y[held])
        p = 1 / (1 + np.exp(-(slope * trees.score(x[held]) + offset)))
        at = np.argsort(-p, kind="stable")
        good = np.flatnonzero(np.cumsum(y[held][at]) >= precision * np.arange(1, len(at) + 1))
        if len(good):
            models[kind] = (trees, slope, offset, max(0.5, float(p[at[good[-1]]])))
    return models


def judge(text: str, models: dict[int, tuple]) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text."""
    base = base_spans(text)
    known, scored = set(base), []
    open_ = (s for s in _proposed(text) if s not in known and s[0] in models)
    while chunk := list(itertools.islice(open_, CHUNK)):
        for kind in {s[0] for s in chunk}:
            trees, slope, offset, threshold = models[kind]
            own = [s for s in chunk if s[0] == kind]
            p = 1 / (1 + np.exp(-(slope * trees.score(np.array([features(text, s) for s in own])) + offset)))
            scored += [(-q, k, a, -b) for q, (k, a, b) in zip(p.tolist(), own) if q >= threshold]
    taken, added = sorted((a, b) for _, a, b in base), []
    for _, kind, a, b in sorted(scored):  # of equals the first, then the longest
        b = -b
        at = bisect.bisect_left(taken, (a, a))
        if (at == len(taken) or taken[at][0] >= b) and (at == 0 or max(y for _, y in taken[max(0, at - 4) : at]) <= a):
            bisect.insort(taken, (a, b))
            added.append((kind, a, b))
    more = added
    while more:  # an added span may have hidden its neighbour from the fixed patterns
        more = base_spans(_without(text, base + added))
        added = added + more
    return base, added


def _without(text: str, spans: list[Span]) -> str:
    """The text with spans blotted out in place."""
    out, low = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if b > low:
            out += [text[low : max(a, low)], "\x00" * (b - max(a, low))]
            low = b
    return "".join(out) + text[low:]


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find_private_data(docs: DataFrame, models: dict[int, tuple], text: str = "text") -> DataFrame:
    """Add base_spans, spans (both by kind as listed, then start) and redacted to ``docs``; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # a few kilobytes
    rows = docs.drop("base_spans", "spans", "redacted")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, both, clean = [], [], []
            for t in batch.column(text):
                t = t.as_py()
                b, more = judge(t or "", shared.value)
                every = sorted(b + more)
                base.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in b])
                both.append([{"kind": KINDS[k], "start": s, "end": e} for k, s, e in every])
                clean.append(redact(t, every) if every else t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind), pa.array(both, kind), pa.array(clean, pa.string())], [*batch.schema.names, "base_spans", "spans", "redacted"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"base_spans {SPAN}", f"spans {SPAN}", "redacted string"])
    return rows.mapInArrow(find, schema)


def redact(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind; overlapping ones by that of the first."""
    out, low = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= low:
            out += [text[low:a], f"<{KINDS[kind].upper()}>"]
        low = max(low, b)
    return "".join(out) + text[low:]


def span_text(spans: Column) -> Column:
    """``kind:start:end`` comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
