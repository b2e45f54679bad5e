"""Constants that define results."""

#: Words are runs of letters, digits and underscores; any other character but white space is a token of its own.
#: Spelled out, because the regex dialects' own \w and \s differ.
TOKEN_RE = (
    r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
DIGITS_RE = r"\A\p{Nd}+\z"

#: Tokens that never count as words.
PUNCTUATION = (".", ",", "!", "?", ";", ":", "(", ")", "[", "]", "{", "}", '"', "'", "---", "--", "-", "...", "«", "»", "—")
#: Words left out of cloud weights.
STOPWORDS = ("the", "of", "to", "and", "in", "that", "is", "a", "for", "on", "it", "with", "as", "by", "this", "be", "are", "have", "not", "will", "i", "we", "you")

#: What is cleaned from markup (characters that it forbids, ampersands that begin no entity), and where
#: its language stands (any root's attribute, a corpus tag, a text tag).
FORBIDDEN_RE = r"[^\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\t\n\r]"
BARE_AMPERSAND_RE = r"&(?![A-Za-z0-9#]{2,5};|#)"
ROOT_LANG_RE = r"""\A\s*(?:<[?!][^>]*>\s*)*<[A-Za-z_][^\s>/]*(?:\s[^>]*?)?\slang\s*=\s*["']([^"']+)["']"""
CORPUS_LANG_RE = r'<corpus\s+[^>]*lang="([^"]+)">'
TEXT_LANG_RE = r'<text\s+lang="([^"]+)">'

#: The syntax of a query term, `[lemma]` and `_TAG`.
LEMMA_TERM_RE = r"\[(.*?)\]"
TAG_TERM_RE = r"_([\w*|$-]+)"

UNTAGGED = "##"
MISSING = "###"
RAW_SHARE = 0.99  # a corpus is raw when more than this share of its tags is the untagged sentinel

PER_MILLION = 1_000_000
#: Fixed value: the factor that reproduces the original's "per million" figures.
REFERENCE_PER = 1_000_100

#: Log-likelihood thresholds and their marks, from strict to lax.
SIGNIFICANCE = ((15.13, "*** (p<0.001)"), (10.83, "** (p<0.01)"), (3.84, " * (p<0.05)"))
NOT_SIGNIFICANT = "ns"
#: Zipf scores from which bands 1 to 4 start; the rest is band 5.
ZIPF_BANDS = ((7, 1), (6, 2), (5, 3), (4, 4))

#: Dictionary pages by language; any other language gets the last.
DICTIONARIES = {"id": "https://kbbi.kemdikbud.go.id/entri/", "en": "https://dictionary.cambridge.org/dictionary/english/"}
PRONUNCIATIONS = "https://forvo.com/word/"
NO_TRANSLATION = "TRANSLATION N/A"
NO_LEVEL = "NA"
