"""DuckDB SQL for the registered queries.  Windows are joins on positions here, a different plan from Spark's."""

from __future__ import annotations

from lexispark.fixtures import LAST_LEVEL, LEVELS
from lexispark.functions.semantics import PUNCTUATION, STOPWORDS, TOKEN_RE


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


RE = TOKEN_RE.replace("'", "''")
WORD = f"(low NOT IN ({_list(PUNCTUATION)}) AND NOT regexp_full_match(low, '\\p{{Nd}}+'))"
TOK = f"""
d AS (SELECT doc_id, lang, source, regexp_extract_all(text, '{RE}') AS t FROM documents),
tok0 AS (SELECT doc_id, lang, source, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM d),
tok AS (SELECT *, lower(token) AS low, '##' AS tag, '##' AS lemma FROM tok0)"""
TAGS = """
CASE WHEN regexp_full_match(token, '\\p{Nd}+') THEN 'CD' WHEN NOT regexp_matches(token, '^[\\p{L}\\p{N}_]') THEN 'SYM'
  WHEN ends_with(lower(token), 'ing') THEN 'VVG' WHEN ends_with(lower(token), 'ed') THEN 'VVD' WHEN ends_with(lower(token), 'ly') THEN 'RB'
  WHEN ends_with(lower(token), 'al') THEN 'JJ' WHEN ends_with(lower(token), 's') THEN 'NNS' ELSE 'NN' END"""
LEMMA = """
CASE WHEN tag = 'VVG' AND length(low) >= 6 THEN left(low, length(low) - 3) WHEN tag IN ('VVD', 'RB') AND length(low) >= 5 THEN left(low, length(low) - 2)
  WHEN tag = 'NNS' AND length(low) >= 4 THEN left(low, length(low) - 1) ELSE low END"""
TAGGED = f"""
d AS (SELECT doc_id, lang, source, regexp_extract_all(text, '{RE}') AS t FROM documents),
tok0 AS (SELECT doc_id, lang, source, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM d),
tok1 AS (SELECT *, lower(token) AS low, {TAGS} AS tag FROM tok0),
tok AS (SELECT *, {LEMMA} AS lemma FROM tok1)"""
SIZE = "size AS (SELECT count(*) AS n FROM tok)"


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts)


def _freq(per: str = "1000000", tagged: bool = False) -> str:
    tag = ", tag" if tagged else ""
    return f"""freq AS (SELECT token{tag}, count(*) AS frequency, round(count(*) / any_value(n) * {per}, 4) AS relative_frequency
      FROM tok, size WHERE {WORD} AND token <> '' GROUP BY token{tag})"""


ZIPF = "round(CASE WHEN relative_frequency > 0 THEN log10(relative_frequency) + 3 END, 2)"
BAND = "CASE WHEN zipf >= 7 THEN 1 WHEN zipf >= 6 THEN 2 WHEN zipf >= 5 THEN 3 WHEN zipf >= 4 THEN 4 ELSE 5 END"


def _hits(word: str = "the") -> str:
    terms = word.split()
    joins = "".join(f" JOIN tok t{k} ON t{k}.doc_id = t0.doc_id AND t{k}.pos = t0.pos + {k} AND t{k}.low = '{w}'" for k, w in enumerate(terms) if k)
    return f"hits AS (SELECT t0.doc_id, t0.pos, {len(terms)} AS len FROM tok t0{joins} WHERE t0.low = '{terms[0]}')"


def _near(window: int) -> str:
    return f"""near AS (SELECT h.doc_id, h.pos AS hit, t.pos, t.token, t.low, t.tag, t.lemma, CASE WHEN o < 0 THEN 'L' ELSE 'R' END AS side
      FROM (SELECT *, unnest(range(-{window}, len + {window})) AS o FROM hits) h JOIN tok t ON t.doc_id = h.doc_id AND t.pos = h.pos + h.o WHERE h.o < 0 OR h.o >= h.len)"""


COUNTS = f"""counts AS (SELECT low AS word, tag, lemma, count(*) FILTER (side = 'L') AS obs_l, count(*) FILTER (side = 'R') AS obs_r, count(*) AS observed
      FROM near WHERE {WORD} GROUP BY low, tag, lemma)"""


def _cell(k: str, r: str, c: str) -> str:
    return f"CASE WHEN {k} > 0 AND ({r})::DOUBLE * ({c}) / n > 0 THEN {k} * ln({k} / (({r})::DOUBLE * ({c}) / n)) ELSE 0 END"


STATS = f"""lowfreq AS (SELECT low AS word, count(*) AS total_freq FROM tok GROUP BY low),
    cells AS (SELECT c.*, f.total_freq, observed AS k11, nf - observed AS k12, total_freq - observed AS k21, n - (observed + (nf - observed) + (total_freq - observed)) AS k22, nf, n
      FROM counts c JOIN lowfreq f USING (word), size, (SELECT count(*) AS nf FROM hits)),
    scored AS (SELECT *, 2 * ({_cell('k11', 'k11 + k12', 'k11 + k21')} + {_cell('k12', 'k11 + k12', 'k12 + k22')} + {_cell('k21', 'k21 + k22', 'k11 + k21')} + {_cell('k22', 'k21 + k22', 'k12 + k22')}) AS full_ll FROM cells),
    stats AS (SELECT word, tag, lemma, obs_l, obs_r, observed, total_freq, round(full_ll, 6) AS ll,
      round(CASE WHEN k11 = 0 THEN 0 ELSE log2(k11 / (nf::DOUBLE * total_freq / n)) END, 6) AS mi,
      CASE WHEN full_ll >= 15.13 THEN '*** (p<0.001)' WHEN full_ll >= 10.83 THEN '** (p<0.01)' WHEN full_ll >= 3.84 THEN ' * (p<0.05)' ELSE 'ns' END AS significance,
      CASE WHEN obs_r > obs_l THEN 'R' WHEN obs_l > obs_r THEN 'L' ELSE 'B' END AS direction FROM scored)"""
STAT_COLUMNS = "word, tag, lemma, obs_l, obs_r, observed, total_freq, round(ll, 4) AS ll, round(mi, 4) AS mi, significance, direction"


def _stats(base: str, where: str = "true", window: int = 5, word: str = "the") -> str:
    return f"{_with(base, SIZE, _hits(word), _near(window), COUNTS, STATS)} SELECT {STAT_COLUMNS} FROM stats WHERE {where}"


def _top(k: int, rank: str = "ll", where: str = "true", window: int = 5, word: str = "the", base: str = TOK) -> str:
    return f"""{_with(base, SIZE, _hits(word), _near(window), COUNTS, STATS)}, top AS (SELECT *, row_number() OVER (ORDER BY {rank} DESC, word, tag, lemma) AS rank
      FROM stats WHERE {where} ORDER BY {rank} DESC, word, tag, lemma LIMIT {k})"""


def _ngram(n: int, base: str = TOK, where: str = "true") -> str:
    leads = ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for k in range(n) for c in ("token", "low", "tag", "lemma"))
    words = " OR ".join(WORD.replace("low", f"low{k}") for k in range(n))
    text = " || ' ' || ".join(f"token{k}" for k in range(n))
    return f"""{_with(base, SIZE)}, g AS (SELECT {leads} FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
      SELECT {text} AS ngram, count(*) AS frequency, round(count(*) / any_value(n) * 1000000, 4) AS relative_frequency
      FROM g, size WHERE token{n - 1} IS NOT NULL AND ({words}) AND {where} GROUP BY 1"""


def _lines(left: int, right: int, shown: str = "t.token") -> str:
    """Context by one join on offsets."""
    return f"""lines AS (SELECT h.doc_id, h.pos,
        coalesce(string_agg({shown}, ' ' ORDER BY t.pos) FILTER (o < 0), '') AS "left", coalesce(string_agg({shown}, ' ' ORDER BY t.pos) FILTER (o >= 0 AND o < len), '') AS node,
        coalesce(string_agg({shown}, ' ' ORDER BY t.pos) FILTER (o >= len), '') AS "right"
      FROM (SELECT *, unnest(range(-{left}, len + {right})) AS o FROM hits) h JOIN tok t ON t.doc_id = h.doc_id AND t.pos = h.pos + h.o GROUP BY h.doc_id, h.pos)"""


PAIRS = """
u AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text AS src FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, text AS tgt FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT conv_id, conv_id * 1000 + n AS sent_id, src, tgt FROM u FULL OUTER JOIN a USING (conv_id, n))"""
PAIR_TOK = f"""{PAIRS},
pt AS (SELECT conv_id, sent_id, regexp_extract_all(src, '{RE}') AS t FROM pairs WHERE src IS NOT NULL),
pt1 AS (SELECT conv_id, sent_id, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM pt),
tok AS (SELECT conv_id AS doc_id, sent_id, row_number() OVER (PARTITION BY conv_id ORDER BY sent_id, i) - 1 AS pos, token, lower(token) AS low FROM pt1)"""
LINES = r"""lines0 AS (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents),
lines1 AS (SELECT doc_id, lang, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM lines0)"""
LINE_TOK = f"""{LINES},
lt AS (SELECT doc_id, k, regexp_extract_all(line, '{RE}') AS t FROM lines1),
lt1 AS (SELECT doc_id, k, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM lt),
lt2 AS (SELECT doc_id, k AS sent, row_number() OVER (PARTITION BY doc_id ORDER BY k, i) - 1 AS pos, token, lower(token) AS low, {TAGS} AS tag FROM lt1)"""
LEX = f"""lex AS (SELECT word, CASE {' '.join(f"WHEN n >= {least} THEN '{level}'" for least, level in LEVELS)} ELSE '{LAST_LEVEL}' END AS cefr,
  '/' || translate(word, 'áàâäéèêëíìîïóòôöúùûüñç', 'aaaaeeeeiiiioooouuuunc') || '/' AS ipa
  FROM (SELECT lower(token) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{RE}')) AS token FROM benchmark) GROUP BY 1))"""
RAW_LINES = r"array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#')), chr(10))"
ATTRS = r"""
pieces AS (SELECT unnest(string_split(regexp_replace(markup, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>', ' ', 'g'), '<')[2:]) AS p FROM src),
heads AS (SELECT regexp_extract(p, '^(?:[^"''>]|"[^"]*"|''[^'']*'')*>') AS h FROM pieces WHERE regexp_matches(p, '^[\p{L}_:]')),
named AS (SELECT regexp_extract(h, '^[^\s/>=]+') AS tag, regexp_extract_all(h, '[^\s="''<>/]+\s*=\s*(?:"[^"]*"|''[^'']*'')') AS pairs FROM heads WHERE h <> ''),
one AS (SELECT tag, len(pairs) AS n, unnest(CASE WHEN len(pairs) = 0 THEN [NULL] ELSE pairs END) AS pair FROM named),
flat AS (SELECT DISTINCT tag, CASE WHEN n > 0 THEN trim(split_part(pair, '=', 1)) END AS attr,
  CASE WHEN n > 0 THEN replace(replace(replace(replace(replace(trim(substr(pair, strpos(pair, '=') + 1))[2:-2], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', chr(39)), '&amp;', '&') END AS value FROM one),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tag, attr ORDER BY value) AS r FROM flat)
SELECT tag, attr, count(value) AS n_values, coalesce(string_agg(value, ',' ORDER BY value) FILTER (r <= 20), '') AS "values" FROM ranked GROUP BY tag, attr"""
ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
MARKUP = f"""{LINES}, mk AS (SELECT doc_id, '<text lang="' || any_value(lang) || '">' || string_agg('<sent n="' || k || '">' || {ESCAPED.format('line')} || '</sent>', chr(10) ORDER BY k) || '</text>' AS markup
  FROM lines1 GROUP BY doc_id)"""
VERTICAL = "vt AS (SELECT doc_id, lang, pos, token, CASE WHEN pos % 17 = 16 THEN '{0}' ELSE tag END AS tag, CASE WHEN pos % 17 = 16 OR pos % 11 = 10 THEN '{0}' ELSE lemma END AS lemma FROM tok)"
LANG = """upper(coalesce(nullif(regexp_extract({0}, '^\\s*(?:<[?!][^>]*>\\s*)*<[A-Za-z_][^\\s>/]*(?:\\s[^>]*?)?\\slang\\s*=\\s*["'']([^"'']+)["'']', 1), ''),
  nullif(regexp_extract({0}, '<corpus\\s+[^>]*lang="([^"]+)">', 1), ''), nullif(regexp_extract({0}, '<text\\s+lang="([^"]+)">', 1), ''), 'XML'))"""


def _search(base: str, where: str, joins: str = "", length: int = 1) -> str:
    return f"{_with(base)} SELECT t0.doc_id, t0.pos, {length} AS len FROM tok t0{joins} WHERE {where}"


FORMS = f"""lemmas AS (SELECT DISTINCT lemma FROM tok WHERE low = 'thing'),
    forms AS (SELECT DISTINCT low AS token, tag, lower(lemma) AS lemma FROM tok WHERE lemma IN (SELECT lemma FROM lemmas)),
    lowfreq AS (SELECT low AS token, count(*) AS frequency FROM tok GROUP BY low),
    joined AS (SELECT f.*, frequency, round(frequency / n * 1000000, 4) AS relative_frequency FROM forms f JOIN lowfreq USING (token), size),
    zipfed AS (SELECT *, {ZIPF} AS zipf FROM joined)"""

SQL = {
    "tokenize": f"{_with(TOK)} SELECT doc_id, pos, token, low FROM tok",
    "src_raw_tokens": f"WITH d AS (SELECT doc_id, regexp_extract_all({RAW_LINES}, '{RE}') AS t FROM documents) SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token, '##' AS tag, '##' AS lemma FROM d",
    "src_vertical": f"{_with(TAGGED, VERTICAL.format('###'))} SELECT doc_id, pos, token, tag, lemma FROM vt",
    "src_markup_w": f"{_with(LINE_TOK)} SELECT doc_id, sent, pos, token, tag, {LEMMA} AS lemma FROM lt2",
    "src_markup_plain": f"{_with(LINE_TOK)} SELECT doc_id, sent, pos, token, '##' AS tag FROM lt2",
    "src_markup_vertical": f"{_with(TAGGED, VERTICAL.format('##'))} SELECT doc_id, pos, token, tag, lemma, 7::BIGINT AS sent FROM vt",
    "src_sentence_ids": f"""{_with(LINES)}, marked AS (SELECT doc_id, k, NOT ((k - 1) % 3 = 2 OR (k - 1) % 5 = 4) AS has FROM lines1)
      SELECT doc_id, (k - 1)::INT AS ordinal, (CASE WHEN has THEN k ELSE count(*) FILTER (NOT has) OVER (PARTITION BY doc_id ORDER BY k) END)::BIGINT AS sent_id FROM marked""",
    "markup_sanitize": r"""SELECT page_id, md5(regexp_replace(regexp_replace(replace(regexp_replace(replace(regexp_replace(' ' || chr(9) || '&x; &amp; & ' || chr(1) || html || chr(128512) || ' ' || chr(10),
      '[^\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\t\n\r]', '', 'g'), '&', chr(1)), '\x01([A-Za-z0-9#]{2,5};|#)', '&\1', 'g'), chr(1), '&amp;'), '^\s+', ''), '\s+$', '')) AS digest FROM pages""",
    "markup_lang": f"""{_with(MARKUP)} SELECT doc_id AS id, {LANG.format('markup')} AS lang, 'documents' AS origin FROM mk
      UNION ALL SELECT page_id, {LANG.format("('<page>' || html)")}, 'pages' FROM pages""",
    "multi_source_union": f"""{_with(TAGGED, VERTICAL.format('###'))}, raw AS (SELECT doc_id, unnest(regexp_extract_all({RAW_LINES}, '{RE}')) AS token FROM documents)
      SELECT 'raw' AS format, doc_id::VARCHAR AS unit_id, count(*) AS n_tokens, 1::BIGINT AS n_tags FROM raw GROUP BY doc_id
      UNION ALL SELECT 'vertical', doc_id::VARCHAR, count(*), count(DISTINCT tag) FROM vt GROUP BY doc_id""",
    "format_detect": f"""{_with(TAGGED, VERTICAL.format('###'), MARKUP)}, made AS (
        SELECT doc_id, 'raw' AS made_as, text FROM documents UNION ALL SELECT doc_id, 'markup', markup FROM mk
        UNION ALL SELECT doc_id, 'vertical', string_agg(CASE WHEN pos % 17 = 16 THEN token WHEN pos % 11 = 10 THEN token || chr(9) || tag ELSE token || chr(9) || tag || chr(9) || lemma END, chr(10) ORDER BY pos)
          FROM tok GROUP BY doc_id),
      lined AS (SELECT doc_id, made_as, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT starts_with(ltrim(x), '#')) AS l FROM made),
      counted AS (SELECT *, len(list_filter(l, lambda x: len(CASE WHEN contains(x, chr(9)) THEN string_split(x, chr(9)) ELSE string_split_regex(trim(x), '\\s+') END) = 3)) AS three FROM lined)
      SELECT doc_id, made_as, CASE WHEN starts_with(ltrim(text), '<') THEN 'markup' WHEN len(l) > 0 AND three > 0.5 * len(l) THEN 'vertical' ELSE 'raw' END AS format FROM counted""",
    "parallel_pairs": f"{_with(PAIR_TOK)} SELECT doc_id AS unit_id, pos, token, sent_id FROM tok",
    "parallel_align_check": f"""{_with(PAIRS)} SELECT conv_id AS unit_id, sent_id, CASE WHEN src IS NULL THEN 'source' ELSE 'target' END AS missing_in FROM pairs WHERE src IS NULL OR tgt IS NULL""",
    "parallel_summary": f"""{_with(PAIR_TOK)} SELECT count(DISTINCT sent_id) AS n_sentences, count(*) AS n_tokens FROM tok JOIN pairs USING (sent_id) WHERE tgt IS NOT NULL""",
    "kwic_translation": f"""{_with(PAIR_TOK, _hits(), _lines(7, 7))} SELECT l.doc_id AS unit_id, l.pos, t.sent_id, "left", node, "right", coalesce(p.tgt, 'TRANSLATION N/A') AS translation
      FROM lines l JOIN tok t ON t.doc_id = l.doc_id AND t.pos = l.pos JOIN pairs p ON p.sent_id = t.sent_id""",
    "global_position": f"{_with(TOK)} SELECT doc_id, pos, row_number() OVER (ORDER BY doc_id, pos) - 1 AS global_pos, token FROM tok",
    "ngram_corpus_scope": f"""{_with(TOK, SIZE)}, g AS (SELECT token, low, lead(token) OVER (ORDER BY doc_id, pos) AS token1, lead(low) OVER (ORDER BY doc_id, pos) AS low1 FROM tok)
      SELECT token || ' ' || token1 AS ngram, count(*) AS frequency, round(count(*) / any_value(n) * 1000000, 4) AS relative_frequency FROM g, size
      WHERE token1 IS NOT NULL AND ({WORD} OR {WORD.replace('low', 'low1')}) GROUP BY 1""",
    "kwic_inline": f"""{_with(TAGGED, _hits(), _lines(3, 3, "(t.token || '/' || t.tag || '{' || t.lemma || '}')"))} SELECT doc_id, pos, "left", node, "right" FROM lines ORDER BY doc_id, pos LIMIT 100""",
    "dictionary_links": f"{_with(TOK)} SELECT DISTINCT lang, token, CASE lang WHEN 'en' THEN 'https://dictionary.cambridge.org/dictionary/english/' || low WHEN 'id' THEN 'https://kbbi.kemdikbud.go.id/entri/' || low ELSE 'https://forvo.com/word/' || token || '/#' || lang END AS link FROM tok",
    "pos_class": f"""{_with(TAGGED)}, tags AS (SELECT tag FROM tok UNION ALL SELECT '##' FROM tok)
      SELECT tag, CASE WHEN starts_with(tag, '##') THEN '#' WHEN upper(left(tag, 1)) IN ('N', 'V', 'J', 'R') THEN upper(left(tag, 1)) ELSE 'O' END AS pos_class, count(*) AS frequency FROM tags GROUP BY tag""",
    "corpus_summary": f"{_with(TAGGED)} SELECT count(*) AS n_tokens, count(DISTINCT low) FILTER ({WORD}) AS n_types, count(DISTINCT lemma) AS n_lemmas FROM tok",
    "corpus_summary_by_lang": f"{_with(TAGGED)} SELECT lang, count(*) AS n_tokens, count(DISTINCT low) FILTER ({WORD}) AS n_types, count(DISTINCT lemma) AS n_lemmas FROM tok GROUP BY lang",
    "is_raw_mode": f"""{_with(TAGGED)}, tags AS (SELECT 'raw' AS corpus, '##' AS tag FROM tok UNION ALL SELECT 'tagged', tag FROM tok)
      SELECT corpus, avg(contains(tag, '##')::INT) > 0.99 AS is_raw, round(avg(contains(tag, '##')::INT), 4) AS untagged_share FROM tags GROUP BY corpus""",
    "freq_list": f"{_with(TOK, SIZE, _freq())} SELECT * FROM freq",
    "freq_list_tagged": f"{_with(TAGGED, SIZE, _freq(tagged=True))} SELECT * FROM freq",
    "rel_freq_reference": f"{_with(TOK, SIZE, _freq('1000100'))} SELECT * FROM freq",
    "freq_lower": f"{_with(TOK)} SELECT low AS token_low, count(*) AS frequency FROM tok GROUP BY low",
    "freq_top10": f"{_with(TOK, SIZE, _freq())} SELECT *, row_number() OVER (ORDER BY frequency DESC, token) AS rank FROM freq ORDER BY frequency DESC, token LIMIT 10",
    "cloud_weights": f"""{_with(TAGGED, SIZE, _freq(tagged=True))}, kept AS (SELECT * FROM freq WHERE lower(token) NOT IN ({_list(STOPWORDS)}))
      SELECT token, sum(frequency)::BIGINT AS weight, first(tag ORDER BY frequency DESC, tag) AS tag FROM kept GROUP BY token""",
    "zipf_bands": f"{_with(TOK, SIZE, _freq())}, z AS (SELECT token, {ZIPF} AS zipf FROM freq) SELECT token, zipf, {BAND} AS band FROM z",
    "search_wildcard": _search(TOK, "regexp_full_match(low, 'th.*tion')"),
    "search_lemma": _search(TAGGED, "starts_with(lemma, 'th')"),
    "search_pos": _search(TAGGED, "starts_with(tag, 'V') OR tag = 'RB'"),
    "search_lemma_pos": _search(TAGGED, "starts_with(lemma, 're') AND starts_with(tag, 'VV')"),
    "search_mwu": _search(TAGGED, "t0.low = 'of'", " JOIN tok t1 ON t1.doc_id = t0.doc_id AND t1.pos = t0.pos + 1 AND starts_with(t1.lemma, 'th') AND starts_with(t1.tag, 'NN')", 2),
    "query_breakdown": f"""{_with(TOK, SIZE)}, f AS (SELECT token, count(*) AS frequency, round(count(*) / any_value(n) * 1000000, 4) AS relative_frequency FROM tok, size WHERE starts_with(low, 'th') GROUP BY token),
      z AS (SELECT *, {ZIPF} AS zipf FROM f) SELECT *, {BAND} AS band FROM z""",
    "query_summary": f"""{_with(TOK, SIZE, _hits(), _near(5))} SELECT (SELECT count(*) FROM hits) AS hits, (SELECT count(*) FROM (SELECT DISTINCT doc_id, hit FROM near WHERE low = 'of')) AS matches,
      round((SELECT count(*) FROM hits) / n * 1000000, 4) AS relative_frequency FROM size""",
    "kwic": f"""{_with(TOK, _hits(), _lines(7, 7))} SELECT * FROM lines ORDER BY doc_id, pos LIMIT 100""",
    "kwic_all": f"""{_with(TOK, _hits('of the'), _lines(7, 7))} SELECT *, 'documents' AS corpus FROM lines""",
    "kwic_pattern": f"""{_with(TAGGED, _hits(), _near(4), _lines(4, 4))}, fit AS (SELECT doc_id, hit AS pos, first(token ORDER BY pos) AS collocate FROM near WHERE ends_with(low, 'ing') AND starts_with(tag, 'V') GROUP BY doc_id, hit)
      SELECT lines.*, collocate FROM lines JOIN fit USING (doc_id, pos)""",
    "kwic_sample": f"""{_with(TOK, _hits(), _lines(7, 7))} SELECT * FROM lines ORDER BY md5(doc_id || ':' || pos || ':42'), doc_id, pos LIMIT 50""",
    **{f"ngram_{n}": _ngram(n) for n in range(1, 6)},
    "ngram_filtered": _ngram(3, TAGGED, "low0 = 'the' AND (starts_with(tag1, 'V') OR tag1 = 'NN') AND starts_with(lemma2, 'th')"),
    "colloc_counts": f"{_with(TAGGED, _hits(), _near(5), COUNTS)} SELECT * FROM counts",
    "colloc_stats": _stats(TAGGED),
    "colloc_ll": f"{_top(20)} SELECT {STAT_COLUMNS}, rank FROM top",
    "colloc_mi": f"{_top(20, 'mi', 'observed >= 5')} SELECT {STAT_COLUMNS}, rank FROM top",
    "colloc_top_k": f"{_top(50, window=3, word='of the')} SELECT {STAT_COLUMNS}, rank FROM top",
    "colloc_left": f"{_top(20)} SELECT {STAT_COLUMNS}, rank FROM top WHERE direction IN ('L', 'B')",
    "colloc_right": f"{_top(20)} SELECT {STAT_COLUMNS}, rank FROM top WHERE direction IN ('R', 'B')",
    "colloc_word_filter": _stats(TAGGED, "regexp_full_match(word, 'o.|.*tion')"),
    "colloc_lemma_filter": _stats(TAGGED, "regexp_full_match(lemma, 'th.*|er')"),
    "colloc_pos_pattern": _stats(TAGGED, "starts_with(tag, 'V') OR tag = 'RB'"),
    "colloc_pos_list": _stats(TAGGED, "tag IN ('NNS', 'JJ')"),
    **{
        f"colloc_examples_{rank}": f"""{_top(20, rank, where)}, {_lines(5, 5)}, firsts AS (SELECT t.rank, t.word, t.tag, t.lemma, first(n.doc_id ORDER BY n.doc_id, n.hit) AS doc_id, first(n.hit ORDER BY n.doc_id, n.hit) AS pos
          FROM top t JOIN near n ON n.low = t.word GROUP BY ALL) SELECT rank, word, tag, lemma, doc_id AS unit_id, pos, "left", node, "right" FROM firsts JOIN lines USING (doc_id, pos)"""
        for rank, where in (("ll", "true"), ("mi", "observed >= 5"))
    },
    "colloc_graph_nodes": f"""{_top(20, base=TAGGED)} SELECT word AS node, tag, lemma, CASE WHEN upper(left(tag, 1)) IN ('N', 'V', 'J', 'R') THEN upper(left(tag, 1)) ELSE 'O' END AS pos_class,
      round(CASE WHEN max(ll) OVER () > min(ll) OVER () THEN 15 + (ll - min(ll) OVER ()) / (max(ll) OVER () - min(ll) OVER ()) * 25 ELSE 25.0 END, 3) AS size,
      CASE direction WHEN 'L' THEN -1 WHEN 'R' THEN 1 ELSE 0 END AS side,
      'POS: ' || tag || chr(10) || 'Obs: ' || observed || ' (Left: ' || obs_l || ', Right: ' || obs_r || ')' || chr(10) || 'Dominant Direction: ' || direction AS tooltip FROM top""",
    "colloc_graph_edges": f"{_top(20, base=TAGGED)} SELECT 'the' AS source, word AS target, tag, lemma, round(ll, 4) AS weight FROM top",
    "lemma_forms": f"{_with(TAGGED, SIZE, FORMS)} SELECT *, {BAND} AS band FROM zipfed",
    "related_forms": f"{_with(TOK)} SELECT DISTINCT token FROM tok WHERE contains(low, 'thing') AND low <> 'thing'",
    "lexicon_cefr": f"{_with(TOK, LEX)} SELECT low AS token, count(*) AS frequency, coalesce(any_value(cefr), 'NA') AS cefr FROM tok LEFT JOIN lex ON word = low GROUP BY low",
    "lexicon_ipa": f"{_with(TOK, LEX)} SELECT low AS token, count(*) AS frequency, coalesce(any_value(ipa), 'NA') AS ipa FROM tok LEFT JOIN lex ON word = low GROUP BY low",
    "dictionary_entry": f"""{_with(TOK, SIZE, LEX)}, f AS (SELECT 'the' AS token, '##' AS tag, '##' AS lemma, count(*) AS frequency, round(count(*) / any_value(n) * 1000000, 4) AS relative_frequency FROM tok, size WHERE low = 'the'),
      z AS (SELECT *, {ZIPF} AS zipf FROM f) SELECT z.*, {BAND} AS band, coalesce(cefr, 'NA') AS cefr, coalesce(ipa, 'NA') AS ipa, 'https://dictionary.cambridge.org/dictionary/english/the' AS link FROM z LEFT JOIN lex ON word = token""",
    "word_tags": f"{_with(TAGGED)} SELECT low AS token, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, string_agg(DISTINCT lemma, ',' ORDER BY lemma) AS lemmas FROM tok WHERE low = 'thing' GROUP BY low",
    "tagset": f"{_with(TAGGED)} SELECT tag, count(*) AS frequency FROM tok GROUP BY tag",
    "markup_structure": f"WITH src AS (SELECT html AS markup FROM pages), {ATTRS}",
    "markup_structure_merged": f"{_with(MARKUP)}, src AS (SELECT html AS markup FROM pages UNION ALL SELECT markup FROM mk), {ATTRS}",
}
SQL |= {
    "corpus_roundtrip": SQL["colloc_counts"],
    "result_roundtrip": SQL["freq_lower"],
    "corpus_union": f"""{_with(TAGGED, VERTICAL.format('###'))}, raw0 AS (SELECT doc_id, regexp_extract_all({RAW_LINES}, '{RE}') AS t FROM documents),
      raw AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token FROM raw0)
      SELECT 'raw' AS format, doc_id, pos FROM raw WHERE lower(token) = 'the' UNION ALL SELECT 'vertical', doc_id, pos FROM vt WHERE lower(token) = 'the'""",
    "src_whole_root": f"""WITH t AS (SELECT doc_id, regexp_extract_all(replace(text, chr(10), ' '), '{RE}') AS t FROM documents)
      SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS token, 1::BIGINT AS sent FROM t""",
    "parallel_markup": SQL["kwic_translation"],
    "parallel_target_search": f"""{_with(PAIRS)}, pt AS (SELECT conv_id, sent_id, regexp_extract_all(tgt, '{RE}') AS t FROM pairs WHERE tgt IS NOT NULL),
      pt1 AS (SELECT conv_id, sent_id, generate_subscripts(t, 1) AS i, unnest(t) AS token FROM pt),
      tok AS (SELECT conv_id AS unit_id, row_number() OVER (PARTITION BY conv_id ORDER BY sent_id, i) - 1 AS pos, token FROM pt1)
      SELECT unit_id, pos FROM tok WHERE lower(token) = 'the'""",
    "dictionary_view": f"""SELECT 'form' AS part, token, concat_ws(' | ', tag, lemma, cefr, ipa, link) AS detail FROM ({SQL['dictionary_entry']})
      UNION ALL SELECT 'related', token, '' FROM ({SQL['related_forms'].replace('thing', 'the')})
      UNION ALL SELECT 'example', node, concat_ws(' | ', "left", "right") FROM ({SQL['kwic'].replace('LIMIT 100', 'LIMIT 5')})""",
}
STATS_BY = f"""langs AS (SELECT doc_id, any_value(lang) AS lang FROM documents GROUP BY doc_id),
    sizes AS (SELECT lang, count(*) AS n FROM tok GROUP BY lang),
    nodes AS (SELECT lang, count(*) AS nf FROM hits JOIN langs USING (doc_id) GROUP BY lang),
    counts AS (SELECT lang, low AS word, tag, lemma, count(*) FILTER (side = 'L') AS obs_l, count(*) FILTER (side = 'R') AS obs_r, count(*) AS observed FROM near JOIN langs USING (doc_id) WHERE {WORD} GROUP BY ALL),
    lowfreq AS (SELECT lang, low AS word, count(*) AS total_freq FROM tok GROUP BY ALL),
    cells AS (SELECT c.*, f.total_freq, observed AS k11, nf - observed AS k12, total_freq - observed AS k21, n - (observed + (nf - observed) + (total_freq - observed)) AS k22, nf, n
      FROM counts c JOIN lowfreq f USING (lang, word) JOIN sizes USING (lang) JOIN nodes USING (lang)),
    scored {STATS.split('scored', 1)[1]}""".replace("stats AS (SELECT word", "stats AS (SELECT lang, word")
SQL |= {
    "search_indexed": f"""{_with(TAGGED)} SELECT 'th*tion' AS query, doc_id, pos, 1 AS len FROM tok WHERE regexp_full_match(low, 'th.*tion')
      UNION ALL SELECT '[th*]', doc_id, pos, 1 FROM tok WHERE starts_with(lemma, 'th')
      UNION ALL SELECT 'of the', a.doc_id, a.pos, 2 FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.low = 'of' AND b.low = 'the'
      UNION ALL SELECT 'of [th*]_NN*', a.doc_id, a.pos, 2 FROM tok a JOIN tok b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 WHERE a.low = 'of' AND starts_with(b.lemma, 'th') AND starts_with(b.tag, 'NN')""",
    "kwic_indexed": f"{_with(TOK, _hits('of the'), _lines(7, 7))} SELECT * FROM lines ORDER BY doc_id, pos LIMIT 100",
    "colloc_indexed": f"SELECT word, tag, lemma, obs_l, obs_r, observed, total_freq, significance, direction FROM ({_stats(TOK, word='thing')})",
    "freq_appended": SQL["freq_list"],
    "forms_appended": SQL["lemma_forms"],
    "summary_sketch": f"{_with(TOK)} SELECT lang, count(*) AS n_tokens, true AS types_close, true AS lemmas_close FROM tok GROUP BY lang",
    "colloc_by_lang": f"""{_with(TOK, _hits(), _near(5), STATS_BY)} SELECT lang, {STAT_COLUMNS}, rank FROM
      (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY ll DESC, word, tag, lemma) AS rank FROM stats) WHERE rank <= 10""",
    "ngram_corpus_scope_by_lang": f"""{_with(TOK)}, sizes AS (SELECT lang, count(*) AS n FROM tok GROUP BY lang),
      g AS (SELECT lang, token, low, lead(token) OVER w AS token1, lead(low) OVER w AS low1 FROM tok WINDOW w AS (PARTITION BY lang ORDER BY doc_id, pos))
      SELECT lang, token || ' ' || token1 AS ngram, count(*) AS frequency, round(count(*) / any_value(n) * 1000000, 4) AS relative_frequency FROM g JOIN sizes USING (lang)
      WHERE token1 IS NOT NULL AND ({WORD} OR {WORD.replace('low', 'low1')}) GROUP BY ALL""",
    "breakdown_by_lang": f"""{_with(TOK)}, sizes AS (SELECT lang, count(*) AS n FROM tok GROUP BY lang),
      f AS (SELECT lang, token, count(*) AS frequency, round(count(*) / any_value(n) * 1000000, 4) AS relative_frequency FROM tok JOIN sizes USING (lang) WHERE starts_with(low, 'th') GROUP BY ALL),
      z AS (SELECT *, {ZIPF} AS zipf FROM f) SELECT *, {BAND} AS band FROM z""",
    "ngram_frequent": f"SELECT * FROM ({_ngram(5)}) WHERE frequency >= 5",
    "src_markup_split": f"""{_with(LINES)}, lt AS (SELECT doc_id * 100000 + k - 1 AS sent_id, regexp_extract_all(line, '{RE}') AS t FROM lines1),
      lt1 AS (SELECT sent_id, generate_subscripts(t, 1) - 1 AS i, unnest(t) AS token FROM lt), lt2 AS (SELECT *, lower(token) AS low, {TAGS} AS tag FROM lt1) SELECT sent_id, i, token, tag, {LEMMA} AS lemma FROM lt2""",
}
