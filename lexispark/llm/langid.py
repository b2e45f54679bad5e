"""Language identification with spans.

A language's model is the log-probability of letter n-grams (hashed) inside words.  Each word gets a score
per language; the word's script allows only languages seen in that script.  Viterbi over the words of a
document, with a penalty for switching, labels spans; the document's language is the one with most letters.

Training reads a bounded sample of the labelled rows, drawn by hashes of id and text: about `sample_rows` of them, an
equal share for each language, so that a rare language is learned too.  Prediction reads every row.

Defined results: null text or text without a letter is `und` with score 0; without training rows everything
is `und`; equal letter counts go to the language whose span begins first in the text; repeated rows get equal
answers; a null lang is not learned from; extra columns are ignored (`identify(keep=...)` carries chosen ones).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm import words as W
from lexispark.llm.storage import small_batches, training_row

MODULUS, HELD_OUT = 3, 1
SAMPLE_ROWS = 20_000
SAMPLE_TASKS = 8
SLICE_BYTES = 512 << 10  # of text that a task labels at a time: its words and scores in Python are about a hundred times as many bytes
MAX_LANGS = 512
TABLE_BITS = 15
SWITCH_PENALTY = 6.0
FORBIDDEN = -30.0  # per word, for a language never seen in the word's script
UNDETERMINED = "und"

#: First code points of Unicode blocks, and the script whose letters begin there ("" = mixed, treated as none).
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, ""), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, ""), (0x0B80, "Tamil"), (0x0C00, ""), (0x0E00, "Thai"),
    (0x0E80, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1380, ""), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x2E80, "Han"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"),
    (0x3190, "Han"), (0xA000, ""), (0xA640, "Cyrillic"), (0xA6A0, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"),
    (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, ""), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"),
    (0xFF00, ""), (0x20000, "Han"), (0x31350, ""),
]
_STARTS = np.array([s for s, _ in SCRIPT_STARTS])
_SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_SCRIPT_OF = np.array([_SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def _letter_table() -> np.ndarray:
    """For each BMP code point its lower-case letter, or 0 for anything that is no letter."""
    table = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = ord(ch.lower()[0])
    return table


_letters: np.ndarray | None = None


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-case letters, 0 elsewhere.  Beyond the BMP every code point up to U+3FFFF that str.isalpha
    accepts is a letter."""
    global _letters
    if _letters is None:
        _letters = _letter_table()
    out = _letters[np.minimum(points, 0xFFFF)]
    beyond = np.flatnonzero(points > 0xFFFF)
    if len(beyond):
        out[beyond] = [p if chr(p).isalpha() else 0 for p in points[beyond].tolist()]
    return out


class WordFeatures:
    """The letter n-grams (1 to 3 letters, with word edges) of some distinct words, hashed to a table."""

    def __init__(self, words: list[str]):
        text = "\n".join(words) + "\n"
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = letters(points)
        edge = np.flatnonzero(points == 10)
        start = np.concatenate(([0], edge[:-1] + 1))
        word = np.repeat(np.arange(len(words)), edge - start + 1)
        self.letters = np.add.reduceat((low > 0).astype(np.int64), start)
        first = np.full(len(words), len(low), np.int64)
        at = np.flatnonzero(low)
        first[word[at[::-1]]] = at[::-1]
        lead = points[np.minimum(first, len(points) - 1)]
        self.script = _SCRIPT_OF[np.searchsorted(_STARTS, lead, "right") - 1]
        self.script[self.letters == 0] = _SCRIPTS.index("")
        # keep letters only, each word framed by zeros
        keep = (low > 0) | (points == 10)
        c = np.concatenate(([0], low[keep])).astype(np.uint64)
        w = np.concatenate(([0], word[keep]))
        two = c[1:] + (c[:-1] << np.uint64(21))
        three = two[1:] + (c[:-2] << np.uint64(42))
        code = np.concatenate((c[1:] | np.uint64(1 << 63), two | np.uint64(1 << 62), three))
        self.owner = np.concatenate((w[1:], w[1:], w[2:]))
        real = np.concatenate((c[1:] > 0, (c[1:] > 0) | (c[:-1] > 0), (c[1:-1] > 0)))
        self.owner = self.owner[real]
        self.slot = (W.mix(code[real]) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def scores(self, table: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """(words, languages): summed log-probabilities relative to the best language of each n-gram."""
        out = np.zeros((len(self.letters), table.shape[1]))
        for j in range(table.shape[1]):
            out[:, j] = np.bincount(self.owner, table[self.slot, j], len(self.letters))
        return out + np.where(allowed[self.script], 0.0, FORBIDDEN)


def distinct_words(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word in text order, words per text); words are blank-separated."""
    seen: dict[str, int] = {}
    number, counts = [], []
    for text in texts:
        own = text.split()
        counts.append(len(own))
        number.extend([seen.setdefault(w, len(seen)) for w in own])
    return list(seen), np.array(number, np.int64), np.array(counts, np.int64)


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed


def _count(langs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((1 << TABLE_BITS, len(langs)), np.int64)
        scripts = np.zeros((len(_SCRIPTS), len(langs)), np.int64)
        place = {x: j for j, x in enumerate(langs)}
        for batch in batches:
            for s in W.slices(batch.column(0)):
                texts = batch.column(0).slice(s.lo, s.hi - s.lo).to_pylist()
                own = [place[x] for x in batch.column(1).slice(s.lo, s.hi - s.lo).to_pylist()]
                for j in set(own):
                    some = [t or "" for t, k in zip(texts, own, strict=True) if k == j]
                    words, number, _ = distinct_words(some)
                    if words:
                        f, times = WordFeatures(words), np.bincount(number)
                        grams[:, j] += np.bincount(f.slot, times[f.owner], 1 << TABLE_BITS).astype(np.int64)
                        scripts[:, j] += np.bincount(f.script, f.letters * times, len(_SCRIPTS)).astype(np.int64)
        yield pa.record_batch([pa.array([grams.tobytes()], pa.binary()), pa.array([scripts.tobytes()], pa.binary())], names=["grams", "scripts"])

    return run


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, max_langs: int = MAX_LANGS) -> Model:
    """Learn from labelled rows outside the held-out third: of each language all, or about its equal share of
    `sample_rows`.  Of more than `max_langs` values of `lang`, those with most rows are learned."""
    rows = docs.filter(F.col("lang").isNotNull() & (training_row(F.col("doc_id"), MODULUS) != HELD_OUT))
    per_lang = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs).collect()}
    langs = sorted(per_lang)
    if not langs:
        return Model([], np.zeros((1 << TABLE_BITS, 0)), np.zeros((len(_SCRIPTS), 0), bool))
    share = sample_rows / len(langs)
    rates = docs.sparkSession.createDataFrame([(x, int(np.ceil(min(1.0, share / per_lang[x]) * 1_000_000))) for x in langs], "lang string, rate long")
    drawn = F.pmod(F.xxhash64(F.lit(17), "doc_id", "text"), F.lit(1_000_000))
    picked = rows.select("doc_id", "text", "lang").join(F.broadcast(rates), "lang").filter(drawn < F.col("rate"))  # max_langs rows at most
    grams = np.zeros((1 << TABLE_BITS, len(langs)), np.int64)
    scripts = np.zeros((len(_SCRIPTS), len(langs)), np.int64)
    for r in picked.select("text", "lang").repartition(SAMPLE_TASKS).mapInArrow(_count(langs), "grams binary, scripts binary").toLocalIterator():
        grams += np.frombuffer(r["grams"], np.int64).reshape(grams.shape)
        scripts += np.frombuffer(r["scripts"], np.int64).reshape(scripts.shape)
    logp = np.log((grams + 0.5) / (grams.sum(axis=0) + 0.5 * len(grams)))
    table = np.maximum(logp - logp.max(axis=1, keepdims=True), -4.0)
    allowed = scripts > 0.01 * np.maximum(scripts.sum(axis=0), 1)
    allowed |= ~allowed.any(axis=1, keepdims=True)  # a script that no language uses narrows nothing
    return Model(langs, table, allowed)


def viterbi(scores: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word.  `scores` has the words of all documents in order, `counts` the words
    per document.  Documents advance together, longest first, so a step is one array operation."""
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    longest = int(counts.max()) if len(counts) else 0
    active = np.searchsorted(-counts[order], -np.arange(longest), "left")  # documents longer than t
    n_lang = scores.shape[1]
    best_before = np.empty(len(scores), np.int16)
    switched = np.zeros((len(scores), n_lang), bool)
    value = np.zeros((len(counts), n_lang))
    label = np.zeros(len(scores), np.int16)
    for t in range(longest):
        a = active[t]
        at = first[:a] + t
        v = value[:a]
        top = v.argmax(axis=1)
        best = v[np.arange(a), top][:, None] - penalty
        best_before[at] = top
        switched[at] = best > v
        np.maximum(v, best, out=v)
        v += scores[at]
        v -= v.max(axis=1, keepdims=True)
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = first[:a] + t
        own = state[:a]
        label[at] = own
        state[:a] = np.where(switched[at, own], best_before[at], own)
    return label


def label_texts(model: Model, texts: list[str], penalty: float = SWITCH_PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Per text: language, share of its letters in that language's spans, and spans as (first word, end word, language)."""
    words, number, counts = distinct_words(texts)
    if not words or not model.langs:
        return [(UNDETERMINED, 0.0, [])] * len(texts)
    f = WordFeatures(words)
    path = viterbi(f.scores(model.table, model.allowed)[number], counts, penalty)
    weight = f.letters[number]
    doc = np.repeat(np.arange(len(texts)), counts)
    n_lang = len(model.langs)
    share = np.bincount(doc * n_lang + path, weight, len(texts) * n_lang).reshape(-1, n_lang)
    change = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])))) if len(path) else np.empty(0, np.int64)
    stop = np.append(change[1:], len(path))
    begin = np.cumsum(counts) - counts
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for a, b in zip(change.tolist(), stop.tolist(), strict=True):
        d = int(doc[a])
        spans[d].append((a - int(begin[d]), b - int(begin[d]), model.langs[path[a]]))
    out = []
    for d in range(len(texts)):
        total = share[d].sum()
        if not total:
            out.append((UNDETERMINED, 0.0, []))
            continue
        most = share[d].max()
        tied = {model.langs[j] for j in np.flatnonzero(share[d] == most)}
        lang = next(s[2] for s in spans[d] if s[2] in tied)
        out.append((lang, float(most / total), spans[d]))
    return out


def _predict(model: Model, penalty: float, names: list[str], text_at: int):
    """Label the texts of column `text_at`; the first len(names) columns are carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("lang", pa.string())]))
        for batch in batches:
            # texts of like length go together: labelling a slice takes as many steps as its longest text has words
            batch = batch.take(pc.sort_indices(pc.fill_null(pc.binary_length(batch.column(text_at)), 0)))
            texts = batch.column(text_at)
            for s in W.slices(texts, SLICE_BYTES):
                own = [t or "" for t in texts.slice(s.lo, s.hi - s.lo).to_pylist()]
                found = label_texts(model, own, penalty)
                spans = [[{"first_word": a, "end_word": b, "lang": x} for a, b, x in f[2]] for f in found]
                carried = [batch.column(i).slice(s.lo, s.hi - s.lo) for i in range(len(names))]
                yield pa.record_batch([*carried, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)], names=[*names, "lang_pred", "score", "spans"])

    return run


def identify(docs: DataFrame, model: Model, keep: list[str], penalty: float = SWITCH_PENALTY, text: str = "text") -> DataFrame:
    """The `keep` columns with lang_pred, score and spans (word ranges) for every row of `docs`."""
    small_batches(docs.sparkSession)
    carried = [F.col(c).alias(f"_{i}") for i, c in enumerate(keep)]
    types = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    schema = f"{types}, lang_pred string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>"
    text_at = keep.index(text) if text in keep else len(keep)
    if text_at == len(keep):
        carried.append(F.col(text).alias("_text"))
    found = docs.select(*carried).mapInArrow(_predict(model, penalty, [f"_{i}" for i in range(len(keep))], text_at), schema)
    return found.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("lang_pred"), F.col("score"), F.col("spans"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train(docs), ["doc_id"])
    return found.select("doc_id", (training_row(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
