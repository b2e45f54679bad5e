"""Secret scans: fixed patterns, and a character convolutional network over every other candidate.

Candidates are all runs of eight or more token characters; each is read whole, in overlapping windows if it is long,
with the text around it.  Labelled findings are what the fixed patterns find (positives) and the other candidates
(negatives).  A convolutional network over characters, written in numpy, is trained on a bounded sample of them.
Half of the positives are shown in the surroundings of a negative, so that the network must judge the token and
not only repeat the patterns.  Scores are calibrated (Platt) on rows held out of training.

Labelled findings are often of one make (say, forty hexadecimal digits), secrets are not.  So variants of each finding are
positives too: its value cut to a shorter length, its letters and digits drawn anew from one of four alphabets, in
the surroundings of another candidate.

Every candidate is scored once.  The threshold keeps the wanted recall of all findings that the network was not fitted
on, each scored with its surroundings hidden, and of their variants as far as these score above even chance.  Other
candidates are unlabelled, not clean: from even chance up to the highest threshold of that recall, it rises as long as the
ordinary ones still thin out quickly.  A histogram of all scores, of fixed size, tells it.

Pattern findings always stay; the network adds spans of kind `cnn` that overlap none of them.

Defined results: null and empty texts have no spans; repeated rows get equal spans; without any labelled
finding the network adds nothing; spans count code points, end exclusive; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.lm import packed, unpacked
from lexispark.llm.storage import Workspace

#: The patterns of the findings, in the order of their kinds, with the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "cnn")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LONG_HEX = re.compile(r"[0-9a-f]{32}")

TOKEN = np.zeros(256, bool)  # characters of a value that the assignment pattern takes
TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
SHORTEST = 8  # characters of a candidate, the least that counts as an assigned value
BEFORE, INSIDE, AFTER = 16, 32, 8
STEP = 16  # between the windows over a candidate longer than INSIDE
EDGES = (0, BEFORE, BEFORE + INSIDE, BEFORE + INSIDE + AFTER)
WIDTH = EDGES[-1]
SAMPLE = 4000  # of each kind of labelled candidates (findings, others with a digit, others without), to fit on
RECALL = 0.98
VARIANTS = 4000  # of findings, at least, to fit on
LEAST_VARIANT = 16  # characters of the shortest variant
SCORED_VARIANTS = 8  # of each finding that the network was not fitted on
ALPHABETS = ((10, 6, 0, 0, 0), (10, 6, 20, 0, 0), (10, 6, 20, 26, 0), (10, 6, 20, 26, 2))  # digits, a to f, other lower-case letters, upper-case letters, + and /
_DRAWN = np.array([4, 1, 2, 3, 5], np.uint8)  # their classes
CLASSES = 12
FILTERS, SPAN = 16, 5
BINS, REACH = 4096, 20.0  # log-odds are kept as one of BINS steps from -REACH to REACH
BAND = 64  # steps whose candidates are counted together

Span = tuple[str, int, int]


def base_matches(text: str) -> list[tuple[Span, int]]:
    """Leftmost non-overlapping matches of each pattern, those too short dropped, by start and kind, each with the place
    where its value begins."""
    low = text.encode("utf-8", "surrogatepass").lower()
    found: list[tuple[Span, int]] = []
    if any(k in low for k in _KEYWORDS):
        found += [(("assign", m.start(), m.end()), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if b"akia" in low:
        found += [(("access", m.start(), m.end()), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if _LONG_HEX.search(text):
        found += [(("hex", m.start(), m.end()), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[0][1], KINDS.index(s[0][0]), s[0][2]))


def base_spans(text: str) -> list[Span]:
    return [span for span, _ in base_matches(text)]


def encode_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _classes() -> np.ndarray:
    """Character class of each byte; 11 for what is outside ASCII, 0 is kept for 'nothing there'."""
    out = np.full(256, 10, np.uint8)
    for c in range(128):
        ch = chr(c)
        if ch in "abcdef":
            out[c] = 1
        elif ch.islower():
            out[c] = 2
        elif ch.isupper():
            out[c] = 3
        elif ch.isdigit():
            out[c] = 4
        elif ch in "+/":
            out[c] = 5
        elif ch in "_-":
            out[c] = 6
        elif ch in "=:":
            out[c] = 7
        elif ch in "\"'":
            out[c] = 8
        elif ch.isspace():
            out[c] = 9
    out[128:] = 11
    return out


_CLASS_OF = _classes()


class Candidates:
    """Every run of SHORTEST or more token characters in a slice, with the windows that show it and its surroundings.

    `doc`, `start` and `end` (code points within the document), `found` (whether it touches a pattern's finding),
    `digit`; `owner` is the candidate of each window, `x` the windows as character classes."""

    def __init__(self, s: W.Slice, base: list[list[tuple[Span, int]]]):
        a, b = W.bounds(s, TOKEN)
        long = b - a >= SHORTEST
        a, b = a[long], b[long]
        self.doc = np.searchsorted(s.offsets, a, "right") - 1
        points = np.concatenate(([0], np.cumsum((s.data & 0xC0) != 0x80)))
        origin = points[s.offsets[self.doc]]
        self.start, self.end = points[a] - origin, points[b] - origin
        digits = np.concatenate(([0], np.cumsum((s.data >= 48) & (s.data <= 57))))
        self.digit = digits[b] > digits[a]
        self.found = np.zeros(len(a), bool)
        for d, spans in enumerate(base):
            for (_, x, y), value in spans:
                lo, hi = np.searchsorted(self.doc, (d, d + 1))
                touched = lo + np.flatnonzero((self.start[lo:hi] < y) & (x < self.end[lo:hi]))
                self.found[touched] = True
                # a finding is shown as its value: a keyword in the same run would give it away
                origin = points[s.offsets[d]]
                first, last = (np.searchsorted(points, origin + c, "right") - 1 for c in (value, y))
                kept = touched[(a[touched] < last) & (first < b[touched])]
                a[kept], b[kept] = np.maximum(a[kept], first), np.minimum(b[kept], last)
        self.kind = np.where(self.found, 0, np.where(self.digit, 1, 2))
        count = 1 + -(-np.maximum(b - a - INSIDE, 0) // STEP)
        self.owner = np.repeat(np.arange(len(a)), count)
        shift = STEP * (np.arange(len(self.owner)) - np.repeat(np.cumsum(count) - count, count))
        shift = np.minimum(shift, np.maximum(b - a - INSIDE, 0)[self.owner])
        self.bytes = (s.data, s.offsets, a, b, shift)
        self.first = np.cumsum(count) - count

    def windows(self, borrow: bool = False) -> np.ndarray:
        """With `borrow`, findings get the surroundings of the next candidate that is none, so that the pattern's own
        evidence beside them is hidden."""
        data, offsets, a, b, shift = self.bytes
        host = np.arange(len(a))
        if borrow and (~self.found).any():
            clean = np.flatnonzero(~self.found)
            host = np.where(self.found, clean[np.minimum(np.searchsorted(clean, host), len(clean) - 1)], host)
        ha, hb, low, high = a[host][self.owner], b[host][self.owner], offsets[self.doc[host]][self.owner], offsets[self.doc[host] + 1][self.owner]
        spots = [(ha[:, None] - BEFORE + np.arange(BEFORE), low, ha), ((a[self.owner] + shift)[:, None] + np.arange(INSIDE), a[self.owner], b[self.owner]), (hb[:, None] + np.arange(AFTER), hb, high)]
        x = np.zeros((len(self.owner), WIDTH), np.uint8)
        for (at, lo, hi), left, right in zip(spots, EDGES[:-1], EDGES[1:], strict=True):
            there = (at >= lo[:, None]) & (at < hi[:, None])
            x[:, left:right] = np.where(there, _CLASS_OF[data[np.clip(at, 0, max(len(data) - 1, 0))]], 0) if len(data) else 0
        return x


class Network:
    """Convolution over character classes within each of the three parts of a window, maximum over each part, logistic
    output.  A filter's response to five characters is the sum of table entries for pairs of them."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.kernel = r.normal(0, 0.3, (SPAN, CLASSES, FILTERS)).astype(np.float32)
        self.offset = np.zeros(FILTERS, np.float32)
        self.out = r.normal(0, 0.1, 3 * FILTERS).astype(np.float32)
        self.bias = 0.0
        self.scale, self.shift = 1.0, 0.0
        self.sampled = -1  # largest hash of a finding in the sample
        self.fifth = True  # whether a fifth of the sample was kept from fitting
        self.trained = False

    def _responses(self, x: np.ndarray):
        """Per part, (windows, places, filters)."""
        k = self.kernel
        first, second = ((k[i][:, None] + k[i + 1][None]).reshape(-1, FILTERS) for i in (0, 2))
        last = k[4] + self.offset
        for left, right in zip(EDGES[:-1], EDGES[1:], strict=True):
            part = x[:, left:right]
            pair = part[:, :-1].astype(np.intp) * CLASSES + part[:, 1:]
            n = right - left - SPAN + 1
            yield first.take(pair[:, :n], axis=0) + second.take(pair[:, 2 : 2 + n], axis=0) + last.take(part[:, 4 : 4 + n], axis=0)

    def logit(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of each window."""
        out = np.empty(len(x))
        for lo in range(0, len(x), 256):
            pooled = np.concatenate([z.max(axis=1) for z in self._responses(x[lo : lo + 256])], axis=1)
            out[lo : lo + 256] = np.maximum(pooled, 0) @ self.out + self.bias
        return self.scale * out + self.shift

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> None:
        """Adam on the logistic loss, both classes weighted alike."""
        r = np.random.default_rng(seed)
        weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
        names = ("kernel", "offset", "out", "bias")
        first, second, step = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
        filters = np.arange(FILTERS)
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(y), batch):
                pick = order[lo : lo + batch]
                tops, pooled = [], []
                for z in self._responses(x[pick]):
                    tops.append(z.argmax(axis=1))
                    pooled.append(np.take_along_axis(z, tops[-1][:, None, :], 1)[:, 0])
                active = np.maximum(np.concatenate(pooled, axis=1), 0)
                z = active @ self.out + self.bias
                g = weight[pick] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[pick]) / len(pick)
                back = (g[:, None] * self.out) * (active > 0)
                grad = {"out": active.T @ g, "bias": g.sum(), "offset": np.zeros(FILTERS), "kernel": np.zeros((SPAN, CLASSES, FILTERS))}
                for p, top in enumerate(tops):
                    part = back[:, p * FILTERS : (p + 1) * FILTERS]
                    grad["offset"] += part.sum(axis=0)
                    for j in range(SPAN):
                        seen = x[pick[:, None], EDGES[p] + top + j].astype(np.int64) * FILTERS + filters
                        grad["kernel"][j] += np.bincount(seen.ravel(), part.ravel(), CLASSES * FILTERS).reshape(CLASSES, FILTERS)
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                    move = rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, getattr(self, k) - (move if k == "bias" else move.astype(np.float32)))
        self.trained = True

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling."""
        z = self.logit(x)
        a, b = 1.0, 0.0
        target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(300):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            a -= 0.05 * ((p - target) * z).mean()
            b -= 0.05 * (p - target).mean()
        self.scale, self.shift = float(max(a, 0.01)), float(b)


def window_hash(x: np.ndarray) -> np.ndarray:
    """A non-negative hash of each window."""
    words = np.ascontiguousarray(x).view("<u8")
    h = np.zeros(len(x), np.uint64)
    for j in range(words.shape[1]):
        h = W.mix(h * np.uint64(0x9FB21C651E98DF25) + words[:, j])
    return (h >> np.uint64(1)).astype(np.int64)


def variants(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The windows with their values cut and drawn anew, by the hashes `h` alone."""
    h = h.astype(np.uint64)
    draw = lambda salt: W.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))
    sizes = np.array(ALPHABETS)[draw(1) % np.uint64(len(ALPHABETS))]
    at = np.arange(INSIDE, dtype=np.uint64)
    letter = (W.mix(draw(2)[:, None] + at) % sizes.sum(axis=1).astype(np.uint64)[:, None]).astype(np.int64)
    drawn = _DRAWN[(letter[:, :, None] >= np.cumsum(sizes, axis=1)[:, None, :-1]).sum(axis=2)]
    own = x[:, EDGES[1] : EDGES[2]]
    length = LEAST_VARIANT + draw(3) % np.uint64(INSIDE - LEAST_VARIANT + 1)
    out = x.copy()
    out[:, EDGES[1] : EDGES[2]] = np.where(at < length[:, None], np.where((own >= 1) & (own <= 4), drawn, own), 0)
    return out


def calibration_part(h: np.ndarray) -> np.ndarray:
    """The fifth of the candidates, by the hash of their first windows, that the network is not fitted on."""
    return (h >> 1) % 5 == 0


def _bases(s: W.Slice, texts: pa.Array) -> list[list[tuple[Span, int]]]:
    return [base_matches(t) if t else [] for t in texts.slice(s.lo, s.hi - s.lo).to_pylist()]


def _sampled(most: int):
    """Of each kind of candidates, the windows with the `most` smallest hashes of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {k: (np.empty(0, np.int64), np.empty((0, WIDTH), np.uint8), np.empty(0, bool)) for k in range(3)}
        for batch in batches:
            for s in W.slices(batch.column(0)):
                c = Candidates(s, _bases(s, batch.column(0)))
                if not len(c.doc):
                    continue
                x = c.windows()
                h = window_hash(x)
                aside = calibration_part(h[c.first])[c.owner]
                for k, (own, seen, apart) in best.items():
                    pick = np.flatnonzero(c.kind[c.owner] == k)
                    if len(own) == most:
                        pick = pick[h[pick] < own[-1]]
                    if len(pick):
                        flags = np.concatenate((apart, aside[pick]))
                        order = np.argsort(~flags, kind="stable")  # a window of two candidates is set apart if one of them is
                        hashes, at = np.unique(np.concatenate((own, h[pick]))[order], return_index=True)
                        at = order[at[:most]]
                        best[k] = hashes[:most], np.concatenate((seen, x[pick]))[at], flags[at]
        for k, (own, seen, apart) in best.items():
            yield pa.record_batch([pa.array(np.full(len(own), k, np.int32)), pa.array(own), pa.array([w.tobytes() for w in seen], pa.binary()), pa.array(apart)], names=["kind", "hash", "window", "apart"])

    return run


def train(docs: DataFrame, work: Workspace, sample: int = SAMPLE) -> Network:
    """Fit on about `sample` distinct windows of each kind, those with the smallest hashes; a fifth of the
    candidates, by hash, is for the calibration only.  Half of the findings are shown in the surroundings of another candidate."""
    network = Network()
    found = work.write(docs.select("text").mapInArrow(_sampled(sample), "kind int, hash long, window binary, apart boolean"), "sampled").groupBy("kind", "hash", "window").agg(F.max("apart").alias("apart"))
    level = F.floor(F.log2(F.col("hash") + 1) * 64).cast("int")
    upto: dict[int, int] = {}
    seen: dict[int, int] = {}
    for r in sorted(found.groupBy("kind", level.alias("level")).count().collect()):  # at most 3 * 63 * 64 rows
        if seen.get(r["kind"], 0) < sample:
            seen[r["kind"]] = seen.get(r["kind"], 0) + r["count"]
            upto[r["kind"]] = r["level"]
    wanted = reduce(lambda c, k: c | ((F.col("kind") == k) & (level <= upto[k])), upto, F.lit(False))
    picked = found.filter(wanted).select("kind", "hash", "window", "apart")
    rows = sorted((r["kind"], r["hash"], r["window"], r["apart"]) for r in picked.toLocalIterator())
    kind = np.array([r[0] for r in rows])
    if not (kind == 0).any() or not (kind > 0).any():
        return network
    x, h = np.stack([np.frombuffer(r[2], np.uint8) for r in rows]), np.array([r[1] for r in rows])
    apart = np.array([r[3] for r in rows])
    y = (kind == 0).astype(np.int64)
    network.sampled = int(h[y == 1].max())
    r = np.random.default_rng(11)
    hidden, clean = np.flatnonzero((y == 1) & (h % 2 == 0)), np.flatnonzero(y == 0)
    of = np.flatnonzero(y == 1)
    of = np.tile(of, -(-VARIANTS // len(of)))
    hidden = np.concatenate((hidden, len(x) + np.arange(len(of))))
    x = np.concatenate((x, variants(x[of], np.arange(len(of)) + h[of])))
    y, apart = np.concatenate((y, np.ones(len(of), np.int64))), np.concatenate((apart, apart[of]))
    donor = r.choice(clean, len(hidden))
    for left, right in ((0, EDGES[1]), (EDGES[2], WIDTH)):
        x[hidden, left:right] = x[donor, left:right]
    learn = ~apart
    if (y[learn] == 1).sum() < 2 or len(set(y[~learn])) < 2:
        learn[:], network.fifth = True, False
    # what no pattern finds is unlabelled rather than clean: a first, short fit sets aside what it takes for a finding by
    # its characters alone, as surroundings tell the labelled ones apart
    bare = x.copy()
    bare[:, : EDGES[1]] = bare[:, EDGES[2] :] = 0
    first = Network()
    first.fit(bare[learn], y[learn], epochs=2)
    suspect = (y == 0) & (first.logit(bare) >= 0)
    network.fit(x[learn & ~suspect], y[learn & ~suspect])
    held = ~learn if network.fifth else learn
    network.calibrate(x[held & ~suspect], y[held & ~suspect])
    return network


SCORED_SCHEMA = "doc_id long, base array<struct<kind:string,start:int,end:int>>, starts binary, lengths binary, bins binary, found binary, held binary, variants binary"


def _step(logit: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((logit + REACH) / (2 * REACH) * BINS), 0, BINS - 1).astype(np.int64)


def _scored(network: Network):
    """Per document the findings, and of every candidate its place, the step of its log-odds and whether it touches a finding.

    Findings are scored with their surroundings hidden; `held` tells those of them that the network was not fitted on (all,
    if there were too few to keep some), `variants` holds the steps of variants of these."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in W.slices(batch.column(1)):
                base = _bases(s, batch.column(1))
                c = Candidates(s, base)
                step, held, altered = np.zeros(len(c.doc), np.int64), np.zeros(len(c.doc), bool), np.empty((0, SCORED_VARIANTS), np.int64)
                if len(c.doc) and network.trained:
                    x = c.windows(borrow=True)
                    step = np.maximum.reduceat(_step(network.logit(x)), c.first)
                    if c.found.any():
                        h = window_hash(c.windows())
                        aside = calibration_part(h[c.first]) | (not network.fifth)
                        held = c.found & (aside | np.logical_and.reduceat(h > network.sampled, c.first))
                        first = c.first[held]
                        altered = np.stack([_step(network.logit(variants(x[first], h[first] ^ k))) for k in range(SCORED_VARIANTS)], axis=1)
                of_doc = np.concatenate(([0], np.cumsum(held)))
                edge = np.searchsorted(c.doc, np.arange(s.hi - s.lo + 1))
                cut = lambda v: pa.array([packed(v[a:b]) if b > a else b"" for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                yield pa.record_batch([
                    batch.column(0).slice(s.lo, s.hi - s.lo).cast(pa.int64()), pa.array([[{"kind": k, "start": a, "end": b} for (k, a, b), _ in spans] for spans in base], kind),
                    cut(c.start), cut(c.end - c.start), cut(step), cut(c.found.astype(np.int64)), cut(held.astype(np.int64)),
                    pa.array([packed(altered[of_doc[a] : of_doc[b]].ravel()) if of_doc[b] > of_doc[a] else b"" for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary()),
                ], names=["doc_id", "base", "starts", "lengths", "bins", "found", "held", "variants"])

    return run


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many candidates have each step: held-out findings, others, and variants of held-out findings."""
    total = np.zeros((3, BINS), np.int64)
    for batch in batches:
        for row in W.rows(batch):
            if row["bins"]:
                step, found, held = unpacked(row["bins"]), unpacked(row["found"]) > 0, unpacked(row["held"]) > 0
                total[0] += np.bincount(step[held], minlength=BINS)
                total[1] += np.bincount(step[~found], minlength=BINS)
            if row["variants"]:
                total[2] += np.bincount(unpacked(row["variants"]), minlength=BINS)
    label, step = np.nonzero(total)
    yield pa.record_batch([pa.array(label.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(total[label, step])], names=["label", "step", "n"])


def threshold(scored: DataFrame, recall: float) -> tuple[int, float, int]:
    """A step that keeps the wanted recall of the findings that the network was not fitted on (BINS without any), the recall
    there, and how many other candidates reach it.  From even chance it rises by bands of steps while the next band holds under
    half as many other candidates, up to the highest step that keeps the same recall of variants too, and never over the
    findings' own."""
    total = np.zeros((3, BINS), np.int64)
    rows = scored.select("bins", "held", "found", "variants").mapInArrow(_histogram, "label int, step int, n long").groupBy("label", "step").agg(F.sum("n").alias("n")).collect()  # 3 * BINS at most
    for r in rows:
        total[r["label"], r["step"]] = r["n"]
    if not total[0].sum():
        return BINS, 0.0, 0
    reached = np.cumsum(total[:, ::-1], axis=1)[:, ::-1]
    own, altered = (int(np.flatnonzero(reached[k] >= recall * reached[k, 0])[-1]) for k in (0, 2))
    low, high = BINS // 2, max(min(own, altered), BINS // 2)
    bands = total[1][low:].reshape(-1, BAND).sum(axis=1)
    falling = np.append(2 * bands[1:] < bands[:-1], False)
    step = min(own, high, low + BAND * int(np.argmin(falling)))
    return step, float(reached[0, step] / reached[0, 0]), int(reached[1, step])


def _findings(step: int):
    """The patterns' spans, and candidates from the threshold on that touch none of them."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, digests = [], []
            for row in W.rows(batch):
                base = [(x["kind"], x["start"], x["end"]) for x in row["base"]]
                digests.append(hashlib.sha256(encode_spans(base).encode()).hexdigest())
                spans = [{"kind": k, "start": a, "end": b, "probability": 1.0} for k, a, b in base]
                if row["bins"]:
                    own = unpacked(row["bins"])
                    for i in np.flatnonzero((own >= step) & (unpacked(row["found"]) == 0)).tolist():
                        a, p = int(unpacked(row["starts"])[i]), 1 / (1 + math.exp(REACH - (own[i] + 0.5) / BINS * 2 * REACH))
                        spans.append({"kind": "cnn", "start": a, "end": a + int(unpacked(row["lengths"])[i]), "probability": p})
                out.append(sorted(spans, key=lambda x: (x["start"], KINDS.index(x["kind"]), x["end"])))
            yield pa.record_batch([batch.column(0), pa.array(out, kind), pa.array(digests)], names=["doc_id", "findings", "base_sha256"])

    return run


def scan(docs: DataFrame, recall: float = RECALL, sample: int = SAMPLE, work: Workspace | None = None) -> DataFrame:
    """doc_id, findings (kind, start, end, probability) and base_sha256 of every row of `docs`."""
    work = work or Workspace(docs.sparkSession, "secrets")
    scored = work.write(docs.select("doc_id", "text").mapInArrow(_scored(train(docs, work, sample)), SCORED_SCHEMA), "scored")
    schema = "doc_id long, findings array<struct<kind:string,start:int,end:int,probability:double>>, base_sha256 string"
    return scored.mapInArrow(_findings(threshold(scored, recall)[0]), schema)


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), "base_sha256", spans.alias("spans"), count("cnn"))
