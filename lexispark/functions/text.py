"""Column functions on text and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexispark.functions.semantics import (
    BARE_AMPERSAND_RE, CORPUS_LANG_RE, DICTIONARIES, DIGITS_RE, FORBIDDEN_RE, PRONUNCIATIONS, PUNCTUATION, ROOT_LANG_RE, TEXT_LANG_RE, TOKEN_RE,
)


def tokenize(text: Column) -> Column:
    """Array of tokens; null text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN_RE), F.lit(0)), F.array().cast("array<string>"))


def is_punctuation(token: Column, extra: tuple[str, ...] = ()) -> Column:
    return token.isin(*PUNCTUATION, *extra)


def is_number(token: Column) -> Column:
    return token.rlike(DIGITS_RE)


def is_word(token_low: Column) -> Column:
    """Neither punctuation nor digits only."""
    return ~is_punctuation(token_low) & ~is_number(token_low)


def pos_class(tag: Column) -> Column:
    """First letter of a tag if it is N, V, J or R; '#' for untagged; else 'O'."""
    first = F.upper(F.substring(tag, 1, 1))
    return F.when(tag.startswith("##"), "#").when(first.isin("N", "V", "J", "R"), first).otherwise("O")


def dictionary_link(token: Column, lang: Column) -> Column:
    low = F.lower(lang)
    link = F.concat(F.lit(PRONUNCIATIONS), token, F.lit("/#"), low)
    for code, page in DICTIONARIES.items():
        link = F.when(low == code, F.concat(F.lit(page), F.lower(token))).otherwise(link)
    return link


def sanitize_markup(markup: Column, trim: bool = True) -> Column:
    """Drop characters that XML forbids (and those beyond the BMP), escape bare ampersands, trim."""
    escaped = F.regexp_replace(F.regexp_replace(markup, FORBIDDEN_RE, ""), BARE_AMPERSAND_RE, "&amp;")
    return F.trim(escaped, F.lit(" \t\n\r")) if trim else escaped  # the other white space of \s is forbidden


def markup_language(markup: Column) -> Column:
    """Root lang attribute, else that of a <corpus> or <text> tag, else XML; upper case."""
    root, corpus, text = (F.regexp_extract(markup, r, 1) for r in (ROOT_LANG_RE, CORPUS_LANG_RE, TEXT_LANG_RE))
    found = F.lit("XML")
    for option in (text, corpus, root):
        found = F.when(option != "", option).otherwise(found)
    return F.upper(found)
