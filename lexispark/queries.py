"""One query per operator, over the whole tables of a directory."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import fixtures
from lexispark.functions import stats
from lexispark.functions.semantics import REFERENCE_PER
from lexispark.functions.text import dictionary_link, markup_language, pos_class, sanitize_markup
from lexispark.operators import dictionary, frequency, ngram, structure
from lexispark.operators.collocation import Collocates
from lexispark.operators.search import Hits
from lexispark.plans.corpus import Corpus
from lexispark.plans.cut import drop, scratch
from lexispark.plans.store import Store
from lexispark.sinks import write_table
from lexispark.sources import markup, parallel, plain

NODE, PHRASE = "the", "of the"
SPLIT_GROUPS = 8  # at most: each group reads the documents
SPLIT_BYTES = 16 << 20  # of text in a group, at least
INDEXED = ("th*tion", "[th*]", "of the", "of [th*]_NN*")


def _tokens(corpus: Corpus, *names: str) -> DataFrame:
    rows = corpus.tokens(*names)
    return rows.select(F.col("unit_id").alias("doc_id"), "pos", *names)


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumn("ll", F.round("ll", 4)).withColumn("mi", F.round("mi", 4))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(fixtures.raw(spark, d), "token", "low")


def src_raw_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(plain.raw_corpus(fixtures.documents(spark, d)), "token", "tag", "lemma")


def src_vertical(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(plain.vertical_corpus(fixtures.vertical_text(spark, d)), "token", "tag", "lemma")


def src_markup_w(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(markup.markup_corpus(fixtures.sentence_markup(spark, d, words=True)), "token", "tag", "lemma", "sent")


def src_markup_plain(spark: SparkSession, d: str) -> DataFrame:
    return _tokens(markup.markup_corpus(fixtures.sentence_markup(spark, d)), "token", "tag", "sent")


def src_markup_vertical(spark: SparkSession, d: str) -> DataFrame:
    lines = fixtures.vertical_text(spark, d).select("doc_id", F.concat(F.lit('<text><sent id="7">'), fixtures.escaped(F.col("text")), F.lit("</sent></text>")).alias("markup"))
    return _tokens(markup.markup_corpus(lines), "token", "tag", "lemma", "sent")


def src_sentence_ids(spark: SparkSession, d: str) -> DataFrame:
    return markup.sentences(fixtures.sentence_markup(spark, d, bare=True), "doc_id", "markup").select(F.col("unit_id").alias("doc_id"), "ordinal", "sent_id")


def markup_sanitize(spark: SparkSession, d: str) -> DataFrame:
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", F.md5(sanitize_markup(F.concat(F.lit(" \t&x; &amp; & \x01"), "html", F.lit("\U0001f600 \n"))).cast("binary")).alias("digest"))


def markup_lang(spark: SparkSession, d: str) -> DataFrame:
    docs = fixtures.sentence_markup(spark, d).select(F.col("doc_id").alias("id"), markup_language(F.col("markup")).alias("lang"), F.lit("documents").alias("origin"))
    pages = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("id"), markup_language(F.concat(F.lit("<page>"), "html")).alias("lang"), F.lit("pages").alias("origin"))
    return docs.unionByName(pages)


def _two_formats(spark: SparkSession, d: str) -> Corpus:
    return Corpus.union({"raw": plain.raw_corpus(fixtures.documents(spark, d)), "vertical": plain.vertical_corpus(fixtures.vertical_text(spark, d))}, "format")


def multi_source_union(spark: SparkSession, d: str) -> DataFrame:
    rows = _two_formats(spark, d).tokens("tag").withColumn("unit_id", F.col("unit_id").cast("string"))
    return rows.groupBy("format", "unit_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("tag").alias("n_tags"))


def corpus_union(spark: SparkSession, d: str) -> DataFrame:
    """Hits in a union of corpora, by their labels."""
    return Hits(_two_formats(spark, d), NODE).positions().select("format", F.col("unit_id").alias("doc_id"), "pos")


def corpus_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Collocates in a corpus that was written, partitioned by language, and read again."""
    path = f"{scratch(spark)}/corpus-{uuid.uuid4().hex[:12]}"
    fixtures.tagged(spark, d).write(path, ["lang"])
    return Collocates(Corpus.read(spark, path), NODE).counts()


def result_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A frequency list that was saved as CSV and read again."""
    path = f"{scratch(spark)}/freq-{uuid.uuid4().hex[:12]}"
    write_table(frequency.frequency_lower(fixtures.raw(spark, d)), path, "csv")
    return spark.read.schema("token_low string, frequency long").option("header", True).option("escape", '"').csv(path)


def whole_root(spark: SparkSession, d: str) -> DataFrame:
    """Markup without sentence elements: the root is the only sentence."""
    whole = fixtures.documents(spark, d).select("doc_id", F.concat(F.lit("<text>"), fixtures.escaped(F.regexp_replace("text", "\n", " ")), F.lit("</text>")).alias("markup"))
    return _tokens(markup.markup_corpus(whole), "token", "sent")


def format_detect(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        fixtures.documents(spark, d).select("doc_id", F.lit("raw").alias("made_as"), "text"),
        fixtures.vertical_text(spark, d).select("doc_id", F.lit("vertical").alias("made_as"), "text"),
        fixtures.sentence_markup(spark, d).select("doc_id", F.lit("markup").alias("made_as"), F.col("markup").alias("text")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("doc_id", "made_as", plain.detect_format(F.col("text"), "\n").alias("format"))


def parallel_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = parallel.ParallelCorpus.from_pairs(fixtures.pairs(spark, d), "conv_id", "sent_id", "src", "tgt")
    return p.source.tokens("token", "sent").select("unit_id", "pos", "token", F.col("sent").alias("sent_id"))


def parallel_align_check(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.pairs(spark, d).withColumnRenamed("conv_id", "unit_id")
    return parallel.alignment(rows.filter("src IS NOT NULL"), rows.filter("tgt IS NOT NULL"))


def parallel_summary(spark: SparkSession, d: str) -> DataFrame:
    return parallel.ParallelCorpus.from_pairs(fixtures.pairs(spark, d).filter("src IS NOT NULL AND tgt IS NOT NULL"), "conv_id", "sent_id", "src", "tgt").summary()


def parallel_markup(spark: SparkSession, d: str) -> DataFrame:
    """Two marked-up files as a parallel corpus; the source sentences that have a translation or none."""
    p = parallel.ParallelCorpus.from_markup(fixtures.side_markup(spark, d, "src"), fixtures.side_markup(spark, d, "tgt"))
    return p.kwic(NODE, limit=None).select("unit_id", "pos", "sent_id", "left", "node", "right", "translation")


def parallel_target_search(spark: SparkSession, d: str) -> DataFrame:
    p = parallel.ParallelCorpus.from_pairs(fixtures.pairs(spark, d), "conv_id", "sent_id", "src", "tgt")
    return Hits(p.target(), NODE).positions().select("unit_id", "pos")


def kwic_translation(spark: SparkSession, d: str) -> DataFrame:
    p = parallel.ParallelCorpus.from_pairs(fixtures.pairs(spark, d).filter("src IS NOT NULL"), "conv_id", "sent_id", "src", "tgt")
    return p.kwic(NODE, limit=None).select("unit_id", "pos", "sent_id", "left", "node", "right", "translation")


def global_position(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.raw(spark, d).positions().select(F.col("unit_id").alias("doc_id"), "pos", "global_pos", "token")


def ngram_corpus_scope(spark: SparkSession, d: str) -> DataFrame:
    return ngram.ngrams(fixtures.raw(spark, d).as_one_sequence(), 2)


def kwic_inline(spark: SparkSession, d: str) -> DataFrame:
    return Hits(fixtures.tagged(spark, d), NODE).kwic(3, 3, show_tag=True, show_lemma=True).select(F.col("unit_id").alias("doc_id"), "pos", "left", "node", "right")


def dictionary_links(spark: SparkSession, d: str) -> DataFrame:
    words = fixtures.raw(spark, d).tokens("token").select("lang", "token").distinct()
    return words.select("lang", "token", dictionary_link(F.col("token"), F.col("lang")).alias("link"))


def pos_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = fixtures.tagged(spark, d).tokens("tag")
    untagged = fixtures.raw(spark, d).tokens("tag").select("tag")
    return rows.select("tag").unionByName(untagged).groupBy("tag", pos_class(F.col("tag")).alias("pos_class")).agg(F.count("*").alias("frequency"))


def corpus_summary(spark: SparkSession, d: str) -> DataFrame:
    return frequency.summary(fixtures.tagged(spark, d))


def corpus_summary_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return frequency.summary(fixtures.tagged(spark, d), ["lang"])


def is_raw_mode(spark: SparkSession, d: str) -> DataFrame:
    a = frequency.raw_mode(fixtures.raw(spark, d)).withColumn("corpus", F.lit("raw"))
    return a.unionByName(frequency.raw_mode(fixtures.tagged(spark, d)).withColumn("corpus", F.lit("tagged")))


def freq_list(spark: SparkSession, d: str) -> DataFrame:
    return frequency.frequency(fixtures.raw(spark, d))


def freq_list_tagged(spark: SparkSession, d: str) -> DataFrame:
    return frequency.frequency(fixtures.tagged(spark, d), tagged=True)


def rel_freq_reference(spark: SparkSession, d: str) -> DataFrame:
    return frequency.frequency(fixtures.raw(spark, d), per=REFERENCE_PER)


def freq_lower(spark: SparkSession, d: str) -> DataFrame:
    return frequency.frequency_lower(fixtures.raw(spark, d))


def freq_top10(spark: SparkSession, d: str) -> DataFrame:
    return frequency.top(frequency.frequency(fixtures.raw(spark, d)), 10)


def cloud_weights(spark: SparkSession, d: str) -> DataFrame:
    return frequency.cloud_weights(fixtures.tagged(spark, d))


def zipf_bands(spark: SparkSession, d: str) -> DataFrame:
    freq = frequency.frequency(fixtures.raw(spark, d)).withColumn("zipf", stats.zipf(F.col("relative_frequency")))
    return freq.select("token", "zipf", stats.zipf_band(F.col("zipf")).alias("band"))


def _search(query: str, tagged: bool):
    def run(spark: SparkSession, d: str) -> DataFrame:
        corpus = fixtures.tagged(spark, d) if tagged else fixtures.raw(spark, d)
        return Hits(corpus, query).positions().select(F.col("unit_id").alias("doc_id"), "pos", "len")

    return run


def query_breakdown(spark: SparkSession, d: str) -> DataFrame:
    return Hits(fixtures.raw(spark, d), "th*").breakdown()


def query_summary(spark: SparkSession, d: str) -> DataFrame:
    return Hits(fixtures.raw(spark, d), NODE).summary(near="of", window=5)


def kwic(spark: SparkSession, d: str) -> DataFrame:
    return Hits(fixtures.raw(spark, d), NODE).kwic().select(F.col("unit_id").alias("doc_id"), "pos", "left", "node", "right")


def kwic_all(spark: SparkSession, d: str) -> DataFrame:
    labelled = Corpus.union({"documents": fixtures.raw(spark, d)})
    return Hits(labelled, PHRASE).kwic(limit=None).select(F.col("unit_id").alias("doc_id"), "corpus", "pos", "left", "node", "right")


def kwic_pattern(spark: SparkSession, d: str) -> DataFrame:
    return Hits(fixtures.tagged(spark, d), NODE).kwic(near="*ing", near_tag="V*", window=4, limit=None).select(F.col("unit_id").alias("doc_id"), "pos", "left", "node", "right", "collocate")


def kwic_sample(spark: SparkSession, d: str) -> DataFrame:
    return Hits(fixtures.raw(spark, d), NODE).kwic(limit=50, sample_seed=42).select(F.col("unit_id").alias("doc_id"), "pos", "left", "node", "right")


def _ngram(n: int):
    return lambda spark, d: ngram.ngrams(fixtures.raw(spark, d), n)


def ngram_filtered(spark: SparkSession, d: str) -> DataFrame:
    return ngram.ngrams(fixtures.tagged(spark, d), 3, {1: "The", 2: "_V*|NN", 3: "[th*]"})


def _raw_collocates(spark: SparkSession, d: str, **options) -> Collocates:
    return Collocates(fixtures.raw(spark, d), NODE, **options)


def _tagged_collocates(spark: SparkSession, d: str, **options) -> Collocates:
    return Collocates(fixtures.tagged(spark, d), NODE, **options)


def colloc_counts(spark: SparkSession, d: str) -> DataFrame:
    return _tagged_collocates(spark, d).counts()


def colloc_stats(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_tagged_collocates(spark, d).stats())


def colloc_ll(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_raw_collocates(spark, d).top(20))


def colloc_mi(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_raw_collocates(spark, d, min_observed=5).top(20, "mi"))


def colloc_top_k(spark: SparkSession, d: str) -> DataFrame:
    return _scores(Collocates(fixtures.raw(spark, d), PHRASE, window=3).top(50))


def colloc_left(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_raw_collocates(spark, d).left(20))


def colloc_right(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_raw_collocates(spark, d).right(20))


def colloc_word_filter(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_tagged_collocates(spark, d, word="o.|*tion").stats())


def colloc_lemma_filter(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_tagged_collocates(spark, d, lemma="th*|er").stats())


def colloc_pos_pattern(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_tagged_collocates(spark, d, tag="V*|RB", tags=["NN"]).stats())


def colloc_pos_list(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_tagged_collocates(spark, d, tags=["NNS", "JJ"]).stats())


def colloc_examples_ll(spark: SparkSession, d: str) -> DataFrame:
    return _raw_collocates(spark, d).examples(20)


def colloc_examples_mi(spark: SparkSession, d: str) -> DataFrame:
    return _raw_collocates(spark, d, min_observed=5).examples(20, "mi")


def colloc_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _tagged_collocates(spark, d).graph_nodes(20)


def colloc_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _tagged_collocates(spark, d).graph_edges(20).withColumn("weight", F.round("weight", 4))


def lemma_forms(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.forms(fixtures.tagged(spark, d), "thing")


def related_forms(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.related(fixtures.raw(spark, d), "thing")


def lexicon_cefr(spark: SparkSession, d: str) -> DataFrame:
    words = frequency.frequency_lower(fixtures.raw(spark, d)).select(F.col("token_low").alias("token"), "frequency")
    return dictionary.with_lexicon(words, fixtures.lexicon(spark, d), "cefr")


def lexicon_ipa(spark: SparkSession, d: str) -> DataFrame:
    words = frequency.frequency_lower(fixtures.raw(spark, d)).select(F.col("token_low").alias("token"), "frequency")
    return dictionary.with_lexicon(words, fixtures.lexicon(spark, d), "ipa")


def dictionary_entry(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.entry(fixtures.raw(spark, d), NODE, fixtures.lexicon(spark, d))


def dictionary_view(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.view(fixtures.raw(spark, d), NODE, fixtures.lexicon(spark, d))


def word_tags(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.word_tags(fixtures.tagged(spark, d), "thing")


def tagset(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.tagset(fixtures.tagged(spark, d))


def markup_structure(spark: SparkSession, d: str) -> DataFrame:
    return structure.structure(spark.read.parquet(f"{d}/pages.parquet"), "html")


def markup_structure_merged(spark: SparkSession, d: str) -> DataFrame:
    return structure.merged([(spark.read.parquet(f"{d}/pages.parquet"), "html"), (fixtures.sentence_markup(spark, d), "markup")])


def _store(spark: SparkSession, d: str, index: bool = True, tagged: bool = False) -> Store:
    """The documents in a store of two parts: those in English, then the others by an append."""
    path = f"{scratch(spark)}/store-{uuid.uuid4().hex[:12]}"
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    if tagged:
        parts = [Corpus.from_arrays(fixtures.tagged_units(spark, d).filter(p), ["lang", "source"], raw=False) for p in (english, ~english)]
    else:
        parts = [Corpus.from_text(fixtures.documents(spark, d).filter(p), keep=["lang", "source"]) for p in (english, ~english)]
    return Store.create(path, parts[0], ["lang"], index).append(parts[1])


def src_markup_split(spark: SparkSession, d: str) -> DataFrame:
    """Words of marked-up sentences in files that Spark splits at the ends of sentences.

    The files are many times the documents, so large tables are written and parsed in groups of documents, a group's files
    going before the next group's are written."""
    docs = fixtures.documents(spark, d)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, parts = max(1, min(SPLIT_GROUPS, size // SPLIT_BYTES)), []
    for group in range(groups):
        path = f"{scratch(spark)}/split-{uuid.uuid4().hex[:12]}"
        own = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(groups)) == group) if groups > 1 else docs
        lines = own.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
        number = (F.col("doc_id") * 100_000 + F.col("k")).cast("string")
        lines.select(F.concat(F.lit('<sent n="'), number, F.lit('">'), fixtures.worded("line"), F.lit("</sent>"))).write.text(path)
        parts.append(markup.split_sentences(spark, path, with_text=False))
        drop(spark, path)
    rows = reduce(DataFrame.unionByName, parts)
    return rows.select("sent_id", F.posexplode(F.arrays_zip("token", "tag", "lemma")).alias("i", "w")).select("sent_id", F.col("i").cast("long").alias("i"), "w.token", "w.tag", "w.lemma")


def search_indexed(spark: SparkSession, d: str) -> DataFrame:
    """A pattern, a lemma, a phrase and a phrase with a tag, from the positional index."""
    store, out = _store(spark, d, tagged=True), None
    for query in INDEXED:
        rows = store.positions(query).select(F.lit(query).alias("query"), F.col("unit_id").alias("doc_id"), "pos", "len")
        out = rows if out is None else out.unionByName(rows)
    return out


def kwic_indexed(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).kwic(PHRASE).select(F.col("unit_id").alias("doc_id"), "pos", "left", "node", "right")


def colloc_indexed(spark: SparkSession, d: str) -> DataFrame:
    """Surroundings from the blocks that the index names, totals from the types; the whole numbers and what follows from them."""
    return Collocates(_store(spark, d).narrow("thing"), "thing").stats().drop("ll", "mi")


def freq_appended(spark: SparkSession, d: str) -> DataFrame:
    return frequency.frequency(_store(spark, d, index=False).corpus)


def forms_appended(spark: SparkSession, d: str) -> DataFrame:
    return dictionary.forms(_store(spark, d, index=False, tagged=True).corpus, "thing")


def summary_sketch(spark: SparkSession, d: str) -> DataFrame:
    """Whether the sketches' distinct counts are within 3 % of the exact ones, by language."""
    store = _store(spark, d, index=False)
    exact = frequency.summary(store.corpus, ["lang"]).select("lang", F.col("n_types").alias("types"), F.col("n_lemmas").alias("lemmas"))
    close = lambda a, b: (F.abs(F.col(a) - F.col(b)) <= 0.03 * F.col(b) + 1).alias(f"{b}_close")
    return store.summary_estimate(["lang"]).join(exact, "lang").select("lang", "n_tokens", close("n_types", "types"), close("n_lemmas", "lemmas"))


def colloc_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_raw_collocates(spark, d, by=["lang"]).top(10))


def ngram_corpus_scope_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return ngram.ngrams(fixtures.raw(spark, d).as_one_sequence(["lang"]), 2, by=["lang"])


def breakdown_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return Hits(fixtures.raw(spark, d), "th*").breakdown(by=["lang"])


def ngram_frequent(spark: SparkSession, d: str) -> DataFrame:
    return ngram.frequent(fixtures.raw(spark, d), 5, 5)


QUERIES = {
    "tokenize": tokenize, "src_raw_tokens": src_raw_tokens, "src_vertical": src_vertical, "src_markup_w": src_markup_w, "src_markup_plain": src_markup_plain,
    "src_markup_vertical": src_markup_vertical, "src_sentence_ids": src_sentence_ids, "markup_sanitize": markup_sanitize, "markup_lang": markup_lang,
    "multi_source_union": multi_source_union, "format_detect": format_detect, "parallel_pairs": parallel_pairs, "parallel_align_check": parallel_align_check,
    "parallel_summary": parallel_summary, "kwic_translation": kwic_translation, "global_position": global_position, "ngram_corpus_scope": ngram_corpus_scope,
    "kwic_inline": kwic_inline, "dictionary_links": dictionary_links, "pos_class": pos_classes, "corpus_summary": corpus_summary,
    "corpus_summary_by_lang": corpus_summary_by_lang, "is_raw_mode": is_raw_mode, "freq_list": freq_list, "freq_list_tagged": freq_list_tagged,
    "rel_freq_reference": rel_freq_reference, "freq_lower": freq_lower, "freq_top10": freq_top10, "cloud_weights": cloud_weights, "zipf_bands": zipf_bands,
    "search_wildcard": _search("th*tion", False), "search_lemma": _search("[th*]", True), "search_pos": _search("_V*|RB", True),
    "search_lemma_pos": _search("[re*]_VV*", True), "search_mwu": _search("of [th*]_NN*", True),
    "query_breakdown": query_breakdown, "query_summary": query_summary, "kwic": kwic, "kwic_all": kwic_all, "kwic_pattern": kwic_pattern, "kwic_sample": kwic_sample,
    **{f"ngram_{n}": _ngram(n) for n in range(1, 6)}, "ngram_filtered": ngram_filtered,
    "colloc_counts": colloc_counts, "colloc_stats": colloc_stats, "colloc_ll": colloc_ll, "colloc_mi": colloc_mi, "colloc_top_k": colloc_top_k,
    "colloc_left": colloc_left, "colloc_right": colloc_right, "colloc_word_filter": colloc_word_filter, "colloc_lemma_filter": colloc_lemma_filter,
    "colloc_pos_pattern": colloc_pos_pattern, "colloc_pos_list": colloc_pos_list, "colloc_examples_ll": colloc_examples_ll,
    "colloc_examples_mi": colloc_examples_mi, "colloc_graph_nodes": colloc_graph_nodes, "colloc_graph_edges": colloc_graph_edges,
    "lemma_forms": lemma_forms, "related_forms": related_forms, "lexicon_cefr": lexicon_cefr, "lexicon_ipa": lexicon_ipa, "dictionary_entry": dictionary_entry,
    "dictionary_view": dictionary_view, "corpus_union": corpus_union, "corpus_roundtrip": corpus_roundtrip, "result_roundtrip": result_roundtrip,
    "src_markup_split": src_markup_split, "search_indexed": search_indexed, "kwic_indexed": kwic_indexed, "colloc_indexed": colloc_indexed, "freq_appended": freq_appended, "forms_appended": forms_appended,
    "summary_sketch": summary_sketch, "colloc_by_lang": colloc_by_lang, "ngram_corpus_scope_by_lang": ngram_corpus_scope_by_lang, "breakdown_by_lang": breakdown_by_lang,
    "ngram_frequent": ngram_frequent,
    "src_whole_root": whole_root, "parallel_markup": parallel_markup, "parallel_target_search": parallel_target_search,
    "word_tags": word_tags, "tagset": tagset, "markup_structure": markup_structure, "markup_structure_merged": markup_structure_merged,
}
