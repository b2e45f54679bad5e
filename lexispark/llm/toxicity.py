"""Toxicity by weak supervision.

1. A lexicon is extended with words that labelled toxic training texts share and clean ones lack, counted over all of them.
2. Voters (lexicon and pattern tests) give each document a bit mask.  Spark counts the masks of all training
   rows; there are at most 2**voters of them.
3. A generative label model is fitted to those counts by EM: a hidden label, and voters that depend on it and,
   along a maximum-mutual-information tree, on one other voter.  So accuracies and correlations are estimated,
   and voters that merely repeat each other don't count twice.
4. A linear classifier (voters, hit counts, hashed words) is trained on the posterior labels of a bounded
   sample, weighted back to the corpus.  Every row is scored by it.

Labels are read from training rows only.  Defined results: null and empty texts get the score of a text
without features; without labels the lexicon is the fixed one and the prior a default; repeated rows get
equal scores; null labels are ignored; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.storage import Workspace, training_row

MODULUS, HELD_OUT = 5, 0
SAMPLE_PER_SIDE = 3000
LEXICON_WORDS = 20_000  # learned at most: a bound of the model's size
MARGIN = -2.0  # minus the log of how many words of the vocabulary chance may add: about seven
COUNTED = 1 << 21
BROADCAST_IDS = 1_000_000  # 16 MB of labelled ids
SLOTS = 1 << 16
DEFAULT_PRIOR = 0.05
_U = np.uint64

#: Insults that single-word voters know, by language.
INSULTS_EN = "idiot idiots moron morons stupid dumb dumbass imbecile cretin fool scum loser losers trash garbage pathetic worthless disgusting clown bastard bastards bitch bitches asshole assholes jerk creep freak filth vermin pig swine coward retard degenerate parasite".split()
INSULTS_OTHER = "idiotin dummkopf trottel arschloch abschaum versager wertlos ekelhaft dreckskerl mistkerl schwachkopf idiote imbécile crétin connard connasse salaud ordure minable débile abruti idiota imbécil estúpido estúpida basura asqueroso asquerosa patético payaso cabrón escoria inútil".split()
THREATS = "kill hate die hurt destroy burn töten hassen sterben tuer haïr crève matar odiar muere".split()
PRONOUNS = "you your youre ur u du dein deine ihr tu toi vous ton votre tú usted vosotros".split()

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

VOTERS = ["insult_en", "insult_other", "two_insults", "learned", "two_learned", "dense", "repeated", "addressed", "threat", "capitals", "shouting", "masked"]
DENSE = ["log_hits", "log_distinct", "density"]


def word_hashes(words: list[str]) -> np.ndarray:
    """Sorted hashes of single words, as W.words gives them."""
    if not words:
        return np.empty(0, _U)
    return np.unique(W.words(next(W.slices(pa.array([" ".join(words)]), 1 << 62)), LETTERS).hash)


def member(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)
    return sorted_set[at] == values


class Voting:
    """Votes and features of a slice of documents."""

    def __init__(self, learned: list[int]):
        self.learned = np.array(sorted(learned), _U)
        self.english, self.other = word_hashes(INSULTS_EN), word_hashes(INSULTS_OTHER)
        self.threats, self.pronouns = word_hashes(THREATS), word_hashes(PRONOUNS)
        self.any = np.unique(np.concatenate((self.english, self.other, self.learned)))

    def __call__(self, s: W.Slice) -> tuple[np.ndarray, np.ndarray, W.Words]:
        """(votes: documents x voters, dense features, words)."""
        w = W.words(s, LETTERS)
        n = s.hi - s.lo
        per = lambda mask: np.bincount(w.doc[mask], minlength=n)
        hit = np.flatnonzero(member(w.hash, self.any))
        distinct = np.unique(np.stack((w.doc[hit].astype(np.uint64), w.hash[hit])), axis=1) if len(hit) else np.zeros((2, 0), _U)
        d, h = distinct[0].astype(np.int64), distinct[1]
        count = lambda known: np.bincount(d[member(h, known)], minlength=n)
        english, other, learned = count(self.english), count(self.other), count(self.learned)
        hits, kinds = per(hit), np.bincount(d, minlength=n)
        near = np.zeros(len(hit), bool)
        for back in (1, 2, 3):
            before = hit - back
            ok = (before >= 0) & (w.doc[np.maximum(before, 0)] == w.doc[hit])
            near |= ok & member(w.hash[np.maximum(before, 0)], self.pronouns)
        addressed = np.bincount(w.doc[hit[near]], minlength=n)
        upper = np.concatenate(([0], np.cumsum((s.data >= 65) & (s.data <= 90))))
        alpha = np.concatenate(([0], np.cumsum(LETTERS[s.data])))
        spread = lambda c: c[s.offsets[1:]] - c[s.offsets[:-1]]
        shout = np.zeros(len(s.data) + 1, np.int64)
        shout[2:] = np.cumsum((s.data[1:] == 33) & (s.data[:-1] == 33)) if len(s.data) > 1 else 0
        star = np.zeros(len(s.data) + 1, np.int64)
        if len(s.data) > 2:
            star[3:] = np.cumsum(LETTERS[s.data[2:]] & (s.data[1:-1] == 42) & LETTERS[s.data[:-2]])
        inside = lambda c, width: np.where(np.diff(s.offsets) >= width, c[s.offsets[1:]] - c[np.minimum(s.offsets[:-1] + width - 1, len(s.data))], 0)
        density = hits / np.maximum(w.per_doc, 1)
        votes = np.stack([
            english > 0, other > 0, english + other > 1, learned > 0, learned > 1, density >= 0.01, hits > kinds, addressed > 0, per(member(w.hash, self.threats)) > 0,
            spread(upper) > 0.5 * np.maximum(spread(alpha), 1), inside(shout, 2) >= 3, inside(star, 3) > 0,
        ], axis=1)
        return votes, np.stack([np.log1p(hits), np.log1p(kinds), np.minimum(density * 20, 3)], axis=1), w


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's smallest shingle hash (0 without words), label and distinct words."""
    for batch in batches:
        for s in W.slices(batch.column(0)):
            w = W.words(s, LETTERS)
            doc, h = W.shingles(w, 4)
            order = np.lexsort((h, doc))
            first = order[np.flatnonzero(np.diff(doc[order], prepend=-1))]
            digest = np.zeros(s.hi - s.lo, np.int64)
            digest[doc[first]] = h[first].view(np.int64)
            order = np.lexsort((w.hash, w.doc))
            d, h = w.doc[order], w.hash[order]
            fresh = np.ones(len(d), bool)
            fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
            d, h = d[fresh], h[fresh]
            edge = np.searchsorted(d, np.arange(s.hi - s.lo + 1))
            words = [h[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            yield pa.record_batch([pa.array(digest), batch.column(1).slice(s.lo, s.hi - s.lo), pa.array(words, pa.binary())], names=["digest", "toxic", "words"])


def _word_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word hash, toxic documents, clean documents), summed over about COUNTED words at a time."""
    held: list[tuple[np.ndarray, int]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, at = np.unique(np.concatenate([np.empty(0, _U), *[w for w, _ in held]]), return_inverse=True)
        toxic = np.repeat([t for _, t in held], [len(w) for w, _ in held]) if held else np.empty(0)
        t = np.bincount(at, toxic, len(h)).astype(np.int64)
        n = np.bincount(at, minlength=len(h))
        held.clear()
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(t), pa.array(n - t)], names=["word", "toxic", "clean"])

    for batch in batches:
        for row in W.rows(batch):
            held.append((np.frombuffer(row["words"], _U), row["toxic"]))
            size += len(held[-1][0])
            if size > COUNTED:
                yield flush()
                size = 0
    yield flush()


def learn_lexicon(labelled: DataFrame, work: Workspace, most: int = LEXICON_WORDS) -> list[int]:
    """Hashes of words that toxic texts hold eight times as often as clean ones or more, where so many of their texts are
    toxic that chance explains it for a few words of the whole vocabulary only; the `most` surest of them.

    All labelled texts (text, toxic) count.  Texts with the same smallest shingle hash count once, so copies and
    most near copies don't make a word typical."""
    once = labelled.select("text", "toxic").mapInArrow(_signed, "digest long, toxic int, words binary").groupBy("digest").agg(F.max("toxic").alias("toxic"), F.max("words").alias("words"))
    once = work.write(once.select("toxic", "words"), "signed")
    sizes = {r["toxic"]: r["n"] for r in once.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    found = once.mapInArrow(_word_classes, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    found = work.write(found.filter("t > 0"), "words")
    work.drop("signed")
    n, q = F.col("t") + F.col("c"), toxic / (toxic + clean)
    share = F.col("t") / n
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - q))).otherwise(0.0)
    surprise = n * (share * F.log(share / q) + rest)  # minus the log of a bound on the chance (Chernoff)
    sure = (share > q) & (surprise >= math.log(max(found.count(), 1)) + MARGIN)
    often = (F.col("t") + 0.5) / (toxic + 1) >= 8 * (F.col("c") + 0.5) / (clean + 1)
    return [r["word"] & (2**64 - 1) for r in found.filter(sure & often).orderBy(surprise.desc(), "word").limit(most).select("word").collect()]


class LabelModel:
    """P(label) and P(voter | label, parent voter) along a tree.

    `counts` are rows per mask, `labelled` the labelled rows per mask by label (clean, toxic); those keep their
    label in every step, so the hidden label can't drift away from what the labels mark."""

    def __init__(self, masks: np.ndarray, counts: np.ndarray, labelled: np.ndarray, start: np.ndarray, prior: float, steps: int = 60):
        free = np.maximum(counts - labelled.sum(axis=1), 0)
        bits = ((masks[:, None] >> np.arange(len(VOTERS))) & 1).astype(np.int64)
        post = start.copy()
        for step in range(steps):
            mass = np.stack((free * (1 - post), free * post), axis=1) + labelled
            if step % 10 == 0:
                self.parent = self._tree(bits, mass)
            self._fit(bits, mass, prior)
            new = self.posterior(bits)
            if np.abs(new - post).max() < 1e-6:
                break
            post = new
        self.masks, self.post = masks, post
        with np.errstate(invalid="ignore", divide="ignore"):
            self.accuracy = {v: (mass * bits[:, [i]]).sum(axis=0) / mass.sum(axis=0) for i, v in enumerate(VOTERS)}

    @staticmethod
    def _tree(bits: np.ndarray, mass: np.ndarray) -> list[int]:
        """Parent of each voter (-1: none), by conditional mutual information given the label."""
        m = bits.shape[1]
        info = np.zeros((m, m))
        for weight in mass.T:
            total = weight.sum() + 1e-9
            one = (weight @ bits) / total
            both = (bits * weight[:, None]).T @ bits / total
            for a in (0, 1):
                for b in (0, 1):
                    pa_, pb = (one if a else 1 - one), (one if b else 1 - one)
                    joint = {(1, 1): both, (1, 0): one[:, None] - both, (0, 1): one[None, :] - both, (0, 0): 1 - one[:, None] - one[None, :] + both}[(a, b)]
                    joint = np.maximum(joint, 1e-12)
                    info += total / mass.sum() * joint * np.log(joint / np.maximum(pa_[:, None] * pb[None, :], 1e-12))
        parent, inside = [-1] * m, {0}
        while len(inside) < m:
            gain, i, j = max((info[i, j], i, j) for i in range(m) if i not in inside for j in inside)
            parent[i] = j if gain > 1e-6 else -1
            inside.add(i)
        return parent

    def _fit(self, bits: np.ndarray, mass: np.ndarray, prior: float) -> None:
        self.p1 = (mass[:, 1].sum() + 100 * prior) / (mass.sum() + 100)
        self.table = np.zeros((bits.shape[1], 2, 2))  # voter, label, parent's vote -> P(vote)
        for i, par in enumerate(self.parent):
            above = bits[:, par] if par >= 0 else np.zeros(len(bits), np.int64)
            for y in (0, 1):
                for a in (0, 1):
                    weight = mass[:, y] * (above == a)
                    self.table[i, y, a] = ((weight * bits[:, i]).sum() + 0.5) / (weight.sum() + 1.0)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        log = np.zeros((len(bits), 2)) + np.log([1 - self.p1, self.p1])
        for i, par in enumerate(self.parent):
            above = bits[:, par] if par >= 0 else np.zeros(len(bits), np.int64)
            for y in (0, 1):
                p = self.table[i, y, above]
                log[:, y] += np.where(bits[:, i] == 1, np.log(p), np.log(1 - p))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))


def _vote(learned: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(learned)
        for batch in batches:
            for s in W.slices(batch.column(1)):
                votes, _, _ = voting(s)
                yield pa.record_batch([*[batch.column(i).slice(s.lo, s.hi - s.lo).cast(pa.int64()) for i in (0, 2)], pa.array((votes << np.arange(len(VOTERS))).sum(axis=1).astype(np.int32))], names=["doc_id", "digest", "mask"])

    return run


def _word_slots(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each distinct hashed word."""
    pair = np.unique((w.doc.astype(_U) << _U(16)) | (w.hash >> _U(48)))
    return (pair >> _U(16)).astype(np.int64), (pair & _U(SLOTS - 1)).astype(np.int64)


def _features(learned: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(learned)
        for batch in batches:
            for s in W.slices(batch.column(0)):
                votes, dense, w = voting(s)
                doc, slot = _word_slots(w)
                edge = np.searchsorted(doc, np.arange(s.hi - s.lo + 1))
                blobs = [slot[a:b].astype(np.uint16).tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                x = np.concatenate((votes, dense), axis=1).astype(np.float32)
                yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(blobs, pa.binary()), *[batch.column(i).slice(s.lo, s.hi - s.lo) for i in (1, 2)]], names=["dense", "slots", "target", "weight"])

    return run


class Classifier:
    """Logistic regression on dense features and hashed words; word weights carry a strong penalty."""

    def __init__(self, rows: list[tuple[bytes, bytes, float, float]], steps: int = 150, l2_word: float = 3.0, l2_dense: float = 0.05):
        self.dense, self.word, self.bias = np.zeros(len(VOTERS) + len(DENSE)), np.zeros(SLOTS), -3.0
        if not rows:
            return
        x = np.stack([np.frombuffer(r[0], np.float32) for r in rows]).astype(np.float64)
        slots = [np.frombuffer(r[1], np.uint16).astype(np.int64) for r in rows]
        doc, slot = np.repeat(np.arange(len(rows)), [len(z) for z in slots]), np.concatenate(slots)
        scale = 1 / np.sqrt(np.maximum([len(z) for z in slots], 1))  # a long text doesn't outvote the voters
        y, weight = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        weight = weight / weight.sum()
        speed = [np.full(x.shape[1], 1e-8), np.full(SLOTS, 1e-8), 1e-8]
        for _ in range(steps):
            z = x @ self.dense + self.bias + scale * np.bincount(doc, self.word[slot], len(rows))
            g = weight * (1 / (1 + np.exp(-z)) - y)
            grads = (x.T @ g + l2_dense / len(rows) * self.dense, np.bincount(slot, (g * scale)[doc], SLOTS) + l2_word / len(rows) * self.word, g.sum())
            for k, grad in enumerate(grads):
                speed[k] = speed[k] + grad * grad
            self.dense -= 0.5 * grads[0] / np.sqrt(speed[0])
            self.word -= 0.05 * grads[1] / np.sqrt(speed[1])
            self.bias -= 0.5 * grads[2] / np.sqrt(speed[2])

    def __call__(self, votes: np.ndarray, dense: np.ndarray, w: W.Words) -> np.ndarray:
        doc, slot = _word_slots(w)
        n = len(votes)
        size = np.maximum(np.bincount(doc, minlength=n), 1)
        z = np.concatenate((votes, dense), axis=1).astype(np.float64) @ self.dense + self.bias + np.bincount(doc, self.word[slot], n) / np.sqrt(size)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _score(learned: list[int], classifier: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voting = Voting(learned)
        for batch in batches:
            for s in W.slices(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(s.lo, s.hi - s.lo).cast(pa.int64()), pa.array(classifier(*voting(s)))], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, work: Workspace | None = None) -> DataFrame:
    """doc_id and score of every row of `docs`."""
    spark = docs.sparkSession
    work = work or Workspace(spark, "toxicity")
    train = docs.select("doc_id", "text").filter(training_row(F.col("doc_id"), MODULUS) != HELD_OUT)
    known = labels.filter(F.col("toxic").isNotNull() & (training_row(F.col("doc_id"), MODULUS) != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    prior = totals.get(1, 0) / sum(totals.values()) if totals.get(1) else DEFAULT_PRIOR
    train = train.withColumn("digest", F.xxhash64("text"))  # with the id, a row's name: repeated rows are one in the sample
    known = work.write(known.filter("toxic IN (0, 1)"), "known")
    few = known.count() <= BROADCAST_IDS
    learned = learn_lexicon(train.join(F.broadcast(known) if few else known, "doc_id"), work)

    votes = work.write(train.mapInArrow(_vote(learned), "doc_id long, digest long, mask int"), "votes")
    masks = votes.groupBy("mask").agg(F.count("*").alias("n")).collect()
    seen = {r["mask"]: (r["n"], r["t"]) for r in votes.join(known, "doc_id").groupBy("mask").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).collect()}
    mask, count = np.array([r["mask"] for r in masks], np.int64), np.array([r["n"] for r in masks], float)
    lexical = (1 << VOTERS.index("dense")) - 1
    start = np.array([(seen.get(m, (0, 0))[1] + 2 * (0.8 if m & lexical else 0.02)) / (seen.get(m, (0, 0))[0] + 2) for m in mask.tolist()]) if len(mask) else np.empty(0)
    rows: list[tuple] = []
    if len(mask):
        labelled = np.array([(n - t, t) for n, t in (seen.get(m, (0, 0)) for m in mask.tolist())], float)
        model = LabelModel(mask, count, labelled, np.clip(start, 0.001, 0.999), prior)
        sides = [float(count[model.post >= 0.5].sum()), float(count[model.post < 0.5].sum())]
        rate = [min(1.0, SAMPLE_PER_SIDE / max(n, 1.0)) for n in sides]
        table = spark.createDataFrame([(int(m), float(p), rate[0] if p >= 0.5 else rate[1]) for m, p in zip(mask, model.post, strict=True)], "mask int, target double, rate double")
        # at most 2**voters rows of posteriors, and a sample of at most about twice SAMPLE_PER_SIDE ids
        picked = votes.join(F.broadcast(table), "mask").filter(F.pmod(F.xxhash64(F.lit(31), "doc_id", "digest"), F.lit(1_000_000)) < F.col("rate") * 1_000_000)
        picked = work.write(picked.groupBy("doc_id", "digest").agg(F.max("target").alias("target"), (1 / F.max("rate")).alias("weight")), "picked")
        sample = train.join(F.broadcast(picked), ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select("text", "target", "weight").mapInArrow(_features(learned), "dense binary, slots binary, target double, weight double")
        rows = sorted(tuple(r) for r in sample.toLocalIterator())  # in one order, so that reruns agree
    return docs.select("doc_id", "text").mapInArrow(_score(learned, Classifier(rows)), "doc_id long, score double")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    found = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", (training_row(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
