"""Marked-up sources: sentences with <w> elements, plain sentences, or vertical lines inside elements.

The tree is parsed per document in an Arrow-batched Spark job (a document is one row); everything after that,
tokenising included, is column expressions.  A document that is too large for one task stays a file, which Spark
splits at the ends of sentences (`split_sentences`)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.functions.semantics import BARE_AMPERSAND_RE, UNTAGGED
from lexispark.functions.text import sanitize_markup, tokenize
from lexispark.plans.corpus import Corpus
from lexispark.plans.cut import bounded_batches, cut
from lexispark.sources.plain import columns

SENTENCE = "sent_id: long, text: string, token: array<string>, tag: array<string>, lemma: array<string>"
SENTENCE_FIELDS = [c.split(":")[0] for c in SENTENCE.split(", ")]
PIECE = 1 << 20  # bytes of markup that a task has parsed at a time; their tokens in Python are about twenty times as many


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _sentence(element: ET.Element, with_text: bool = True) -> tuple:
    """(id or None, text, tokens, tags, lemmas) of a sentence element; the id is @n or @id as an integer.  Without
    `with_text`, a sentence that has words has no text."""
    try:
        sent_id = int(element.get("n") or element.get("id") or "")
    except ValueError:
        sent_id = None
    words = [w for w in element.iter() if w.tag == "w" or _name(w) == "w"]
    text = "".join(element.itertext()) if with_text or not words else None
    if not words:
        return (sent_id, text, None, None, None)
    parts = [(t, w.get("pos") or w.get("type") or UNTAGGED, w.get("lemma") or UNTAGGED) for w in words if (t := (w.text or "").strip())]
    return (sent_id, text, *(list(column) for column in (zip(*parts) if parts else ((), (), ()))))


FORBIDDEN = bytes(sorted({*range(32)} - {*b"\t\n\r"}))
RARE = re.compile("[\\ufffe\\uffff\\U00010000-\\U0010ffff]")
BARE_AMPERSAND = re.compile(BARE_AMPERSAND_RE.encode())
LEADS = [bytes([b]) for b in range(0xF0, 0xF5)]  # of four-byte characters


def sanitized(markup: bytes, trim: bool = True) -> bytes:
    """`sanitize_markup` of UTF-8: nearly all markup has nothing to drop, which its bytes tell without a look at each character."""
    markup = markup.translate(None, FORBIDDEN)
    if b"\xef\xbf" in markup or any(b in markup for b in LEADS):
        markup = RARE.sub("", markup.decode()).encode()
    if b"&" in markup:
        markup = BARE_AMPERSAND.sub(b"&amp;", markup)
    return markup.strip(b" \t\n\r") if trim else markup


def _root(markup: bytes) -> ET.Element:
    return ET.fromstring(markup, ET.XMLParser(encoding="utf-8"))  # whatever a declaration says: it is UTF-8 here


def sentence_rows(markup: bytes, with_text: bool = True) -> list[tuple]:
    """(sent_id, text, tokens, tags, lemmas) of each sentence element, in their order.

    Sentences are the <sent> children of the root, else all its children, else the root itself.  Sentences without an
    id are numbered by a counter of their own.  Markup that doesn't parse gives no sentences."""
    try:
        root = _root(markup)
    except ET.ParseError:
        return []
    children = list(root)
    if not children:
        return [(1, "".join(root.itertext()), None, None, None)]
    counter, rows = 0, []
    for element in [c for c in children if _name(c) == "sent"] or children:
        sent_id, *rest = _sentence(element, with_text)
        counter += sent_id is None
        rows.append((counter if sent_id is None else sent_id, *rest))
    return rows


def _lists(values: list[list | None]) -> pa.Array:
    """Lists of strings, from one flat array."""
    sizes = np.cumsum([0, *[len(v) if v is not None else 0 for v in values]])
    flat = pa.array([x for v in values if v is not None for x in v], pa.string())
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat, mask=pa.array([v is None for v in values], pa.bool_()))


def sentence_arrays(rows: list[tuple]) -> list[pa.Array]:
    """Columns of (sent_id, text, tokens, tags, lemmas)."""
    ids, texts, *words = zip(*rows, strict=True) if rows else [()] * 5
    return [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), *[_lists(w) for w in words]]


def _pieces(batch: pa.RecordBatch, name: str) -> Iterator[pa.RecordBatch]:
    """A batch in slices of some rows and PIECE bytes of `name`, or of one row, so that a task's Python holds the sentences of a
    few documents at a time however many a batch has."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + PIECE, "right")))
        yield batch.slice(first, last - first)
        first = last


def _parse(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, "markup"):
                units = [sentence_rows(sanitized(m), with_text) if m is not None else [] for m in piece.column("markup").to_pylist()]
                ends = pa.array(np.cumsum([0, *map(len, units)]), pa.int32())
                found = pa.StructArray.from_arrays(sentence_arrays([r for rows in units for r in rows]), SENTENCE_FIELDS)
                yield pa.record_batch([piece.column("unit_id"), pa.ListArray.from_arrays(ends, found)], names=["unit_id", "s"])

    return run


def _packed(df: DataFrame, id: str, markup: str, with_text: bool) -> DataFrame:
    """unit_id and the array of its sentences, of the units that have any: parsed where they stand, without a shuffle."""
    rows = df.select(F.col(id).cast("long").alias("unit_id"), F.col(markup).cast("binary").alias("markup"))
    bounded_batches(df.sparkSession)
    return rows.mapInArrow(_parse(with_text), f"unit_id long, s array<struct<{SENTENCE}>>").filter(F.size("s") > 0)


def sentences(df: DataFrame, id: str, markup: str, any_blank: bool = False) -> DataFrame:
    """unit_id, ordinal, sent_id, text and token/tag/lemma arrays of every sentence.

    Sentences with <w> have its words.  Those with mostly tabbed lines are vertical: up to three columns a line,
    missing ones untagged.  The rest is tokenised text.  With `any_blank`, lines of three or more
    blank-separated columns count as vertical too; ordinary prose in one line then does as well, so it is off
    unless asked for."""
    rows = _packed(df, id, markup, True).select("unit_id", F.posexplode("s").alias("ordinal", "one")).select("unit_id", "ordinal", "one.*")
    return _tokenised(rows, ["unit_id", "ordinal", "sent_id", "text"], any_blank)


def _words(s: Column, any_blank: bool) -> Column:
    """array<struct<token, tag, lemma>> of an array of sentences, each split and classified once."""
    some = lambda x: x["token"].isNull() & (F.lit(True) if any_blank else x["text"].contains("\t"))
    columned = lambda x: (x.contains("\t") | (F.size(columns(F.trim(x))) >= 3)) if any_blank else x.contains("\t")
    lines = lambda x: F.filter(F.split(x["text"], r"\r?\n|\r"), lambda line: F.trim(line) != "")
    vertical = lambda found: (F.size(found) > 0) & (F.size(F.filter(found, columned)) > 0.5 * F.size(found))
    split = lambda found: F.transform(found, lambda x: F.split(F.trim(x), r"\s+", 3))
    part = lambda r, k: F.transform(r, lambda c: F.when(F.get(c, F.lit(k)) != "", F.get(c, F.lit(k))).otherwise(UNTAGGED))
    plain = lambda x: tokenize(F.regexp_replace(x["text"], r"[\n\t\r]", " "))
    token = lambda y: F.when(y["s"]["token"].isNotNull(), y["s"]["token"]).when(y["r"].isNotNull(), part(y["r"], 0)).otherwise(plain(y["s"]))
    blank = lambda y: F.array_repeat(F.lit(UNTAGGED), F.size(y["t"]))
    other = lambda y, name, k: F.when(y["s"]["token"].isNotNull(), y["s"][name]).when(y["r"].isNotNull(), part(y["r"], k)).otherwise(blank(y)).alias(name)
    lined = F.transform(s, lambda x: F.struct(x.alias("s"), F.when(some(x), lines(x)).alias("l")))
    rows = F.transform(lined, lambda y: F.struct(y["s"].alias("s"), F.when(vertical(y["l"]), split(y["l"])).alias("r")))
    tokens = F.transform(rows, lambda y: F.struct(y["s"].alias("s"), y["r"].alias("r"), token(y).alias("t")))
    return F.transform(tokens, lambda y: F.struct(y["t"].alias("token"), other(y, "tag", 1), other(y, "lemma", 2)))


def _tokenised(parsed: DataFrame, kept: list[str], any_blank: bool) -> DataFrame:
    one = F.array(F.struct("text", "token", "tag", "lemma"))
    words = parsed.select(*kept, _words(one, any_blank)[0].alias("w"))
    return words.select(*kept, "w.token", "w.tag", "w.lemma")


def markup_corpus(df: DataFrame, id: str = "doc_id", markup: str = "markup", **options) -> Corpus:
    """All sentences of a unit (a row) in document order as one token sequence with sentence ids."""
    rows = _packed(df, id, markup, False).select("unit_id", F.col("s.sent_id").alias("ids"), _words(F.col("s"), False).alias("w"))
    flat = [F.flatten(F.col(f"w.{a}")).alias(a) for a in ("token", "tag", "lemma")]
    sent = F.flatten(F.zip_with("ids", "w.token", lambda k, t: F.array_repeat(k, F.size(t)))).alias("sent")
    return Corpus.from_arrays(rows.select("unit_id", *flat, sent), **options)


END = "</sent>"
#: A prolog, then the first element's start tag.
ROOT_RE = r"""\A\s*(?:<\?[^>]*>\s*|<!--(?:[^-]|-[^-])*-->\s*|<![^>\[]*(?:\[[^\]]*\]\s*)?>\s*)*(<[\p{L}_:][^\s/>]*(?:[^>"']|"[^"]*"|'[^']*')*>)"""
NO_ROOT = "<sentences>"
RECORDS = f"doc string, begin long, i long, m long, {SENTENCE.replace(':', ' ')}"
RECORD_NAMES = [c.split()[0] for c in RECORDS.split(", ")]


def _parse_records(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _parsed_records(batches, with_text)

    return run


def _parsed_records(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    """Records (what stands before an end of a sentence) to their sentences.  Each is parsed inside its document's own root
    element, whose namespaces it may use.  A task has a file's piece whole and in order, so it numbers the piece's sentences
    (`i`, from 0) and counts those without an id up to each (`m`)."""
    here, i, m = None, 0, 0
    ends: dict[bytes, re.Pattern] = {}
    for batch in batches:
        for piece in _pieces(batch, "body"):
            place, numbers, counts, rows = [], [], [], []
            for at, (doc, begin, root, rooted, body) in enumerate(zip(*[piece.column(c).to_pylist() for c in ("doc", "begin", "root", "rooted", "body")], strict=True)):
                if (doc, begin) != here:
                    here, i, m = (doc, begin), 0, 0
                body, root = sanitized(body, trim=False), root.encode()
                name = re.match(rb"<([^\s/>]+)", root).group(1)
                if rooted:
                    body = body[body.index(root) + len(root) :]
                if name not in ends:
                    ends[name] = re.compile(rb"</" + re.escape(name) + rb"\s*>(?:\s|<!--.*?-->|<\?.*?\?>)*\Z", re.S)
                last = ends[name].search(body)
                body = body[: last.start()] if last else body + (END.encode() if b"<sent" in body else b"")
                try:
                    children = list(_root(root + body + b"</" + name + b">"))
                except ET.ParseError:
                    continue
                for found in [_sentence(c, with_text) for c in children if _name(c) == "sent"]:
                    m += found[0] is None
                    place.append(at)
                    numbers.append(i)
                    counts.append(m)
                    rows.append(found)
                    i += 1
            kept = [piece.column(c).take(pa.array(place, pa.int32())) for c in ("doc", "begin")]
            yield pa.record_batch([*kept, pa.array(numbers, pa.int64()), pa.array(counts, pa.int64()), *sentence_arrays(rows)], names=RECORD_NAMES)


def split_sentences(spark: SparkSession, paths: str | list[str], any_blank: bool = False, with_text: bool = True) -> DataFrame:
    """doc (the file), ordinal, sent_id, text and token/tag/lemma arrays of the <sent> children of the root of each file: what
    `sentences` gives for whole documents, of files of any size.  Without `with_text` the column text is left out.

    The files are read now: the result is what was parsed, kept in the shared folder.

    Spark's text reader deals a file to tasks and cuts it at the ends of sentences.  What a piece needs of the rest of
    its document is handed to it: the root's start tag, and from the pieces before the number of sentences and of those
    without an id.  A file may also hold <sent> elements without a root.  A sentence that can't be parsed is left out;
    there must be no <sent> inside another, nor an end of one in a comment."""
    place = [F.col("_metadata.file_path").alias("doc"), F.col("_metadata.file_block_start").alias("begin")]
    bounded_batches(spark)
    records = spark.read.option("lineSep", END).text(paths).select(*place, F.monotonically_increasing_id().alias("record"), F.col("value").alias("body"))
    # a row for each file or piece goes to every task: no more than the driver's own list of them
    firsts = F.broadcast(records.filter("begin = 0").groupBy("doc").agg(F.min("record").alias("record")))
    start = F.regexp_extract(sanitize_markup(F.col("body"), trim=False), ROOT_RE, 1)
    heads = F.broadcast(records.filter("begin = 0").join(firsts, ["doc", "record"]).select("doc", F.col("record").alias("head_record"), start.alias("head_root")))
    none = F.col("head_root").rlike(r"^(<sent[\s/>]|$)")
    root = F.when(none, NO_ROOT).otherwise(F.col("head_root")).alias("root")
    wrapped = records.join(heads, "doc").select("doc", "begin", F.col("body").cast("binary").alias("body"), root, ((F.col("record") == F.col("head_record")) & ~none).alias("rooted"))
    text = ["text"] if with_text else []
    parsed = cut(_tokenised(wrapped.mapInArrow(_parse_records(with_text), RECORDS), ["doc", "begin", "i", "m", "sent_id", *text], any_blank), "zstd")
    pieces = parsed.groupBy("doc", "begin").agg(F.count("*").alias("n"), F.max("m").alias("missing"))
    before = Window.partitionBy("doc").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("doc", "begin", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "missing")])
    counted = F.coalesce("sent_id", F.col("missing_before") + F.col("m")).alias("sent_id")
    return parsed.join(F.broadcast(pieces), ["doc", "begin"]).select("doc", (F.col("n_before") + F.col("i")).alias("ordinal"), counted, *text, "token", "tag", "lemma")


def split_corpus(spark: SparkSession, paths: str | list[str], **options) -> Corpus:
    """`markup_corpus` of files of any size: unit_id is the file.  Sentences are put into blocks by their positions, so no
    document ever meets in one row."""
    rows = split_sentences(spark, paths, with_text=False).withColumn("sent", F.array_repeat(F.col("sent_id"), F.size("token")))
    each = Corpus.from_arrays(cut(rows.select(F.col("ordinal").alias("unit_id"), "doc", "token", "tag", "lemma", "sent")), ["doc"], **options)
    whole = each.as_one_sequence(["doc"])
    return Corpus(whole.blocks.drop("unit_id").withColumnRenamed("doc", "unit_id"), [], whole.block, whole.halo)
