"""Unicode-aware text helpers and the English analyser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from issuequarry.functions.stemming import stem

# The English stop list of the full-text configuration.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself "
    "she her hers herself it its itself they them their theirs themselves what which who whom this "
    "that these those am is are was were be been being have has had having do does did doing a an "
    "the and but if or because as until while of at by for with about against between into through "
    "during before after above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other some such no nor not "
    "only own same so than too very s t can will just don should now"
).split()

_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(col: Column) -> Column:
    """Strip every kind of white space; the built-in trim removes U+0020 only."""
    return F.regexp_replace(col, _EDGE_SPACE, "")


def non_blank(col: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(col), F.lit(""))


def embedding_text(title: Column, body: Column) -> Column:
    """Title, blank line, body; nulls count as empty, outer white space is dropped."""
    empty = F.lit("")
    return strip(F.concat(F.coalesce(title, empty), F.lit("\n\n"), F.coalesce(body, empty)))


# A word with its hyphenated parts, or a number with sign and decimal points.
_WORD = r"\p{N}*\p{L}[\p{L}\p{N}]*(?:-\p{N}*\p{L}[\p{L}\p{N}]*)*+"
_NUMBER = r"-?\p{N}+(?:\.\p{N}+)*+"
TOKEN = f"{_WORD}|{_NUMBER}"
_COMPOUND = r"[\p{L}\p{N}]-\p{N}*\p{L}"

# The other token classes of the published parser, tried before words in this order. Groups repeat
# possessively, so that long chains need no stack; a host name has at most 127 labels, the last of two letters or more.
_PIECE = r"[\p{L}\p{N}]+(?:[-_]+[\p{L}\p{N}]+)*+"
_HOST = rf"{_PIECE}(?:\.{_PIECE}){{0,125}}\.\p{{L}}{{2}}[\p{{L}}\p{{N}}]*+(?:[-_]+[\p{{L}}\p{{N}}]+)*+(?::\p{{N}}+)?+"
_NAME = r"[\p{L}\p{N}]+(?:[._-]+[\p{L}\p{N}]+)*+"
_PATH = r"/[!#-;=?-\[\]_a-z~]*+"
_MARKUP = r"</?\p{L}[^<>]*+>|&(?:#\p{N}+|#x[0-9a-f]+|\p{L}[\p{L}\p{N}]*+);|\p{L}+://"
_EMAIL = rf"{_NAME}@{_HOST}"
_FILE = rf"(?:~|\.{{1,2}})?+/{_NAME}(?:/{_NAME})*+|{_NAME}(?:/{_NAME})++"
_EXPONENT = r"-?\p{N}+\.\p{N}+e[+-]?\p{N}+"
LEXEME = f"{_MARKUP}|{_EMAIL}|{_HOST}{_PATH}|{_HOST}|{_FILE}|{_EXPONENT}|{TOKEN}"
#: Every class but words and numbers has one of these in it.
_SPECIAL = r"[@/<&]|\.\p{L}{2}|\.\p{N}+e"


def _hyphenated(token: Column) -> Column:
    plain = ~token.rlike(r"[^\p{L}\p{N}-]")
    return F.when(plain & token.rlike(_COMPOUND), F.concat(F.array(token), F.split(token, "-"))).otherwise(F.array(token))


def _parts(token: Column) -> Column:
    """What one lexeme is indexed as: markup and protocols vanish, a URL is followed by its host and its path."""
    url = token.rlike(f"^{_HOST}/")
    host = F.substring_index(token, "/", 1)
    return (
        F.when(token.rlike("^[<&]|://$"), F.array().cast("array<string>"))
        .when(url, F.array(token, host, F.substr(token, F.length(host) + 1)))
        .otherwise(_hyphenated(token))
    )


def tokens(col: Column) -> Column:
    """Lower-cased tokens in order: words, numbers, hosts, URLs, files and e-mail addresses.

    A hyphenated word is followed by its parts, a URL (without its protocol) by its host and its path. Tags, entities
    and protocols are no tokens and take no position. A path runs to the first character that no URL holds; a file
    is names joined by slashes, ``~``, ``.`` or ``..`` and a slash before them or not. Texts without any of these
    are cut by the pattern of words and numbers alone, which finds the same there.
    """
    lowered = F.lower(col)
    plain = F.regexp_extract_all(lowered, F.lit(TOKEN), F.lit(0))
    lexemes = F.regexp_extract_all(lowered, F.lit(LEXEME), F.lit(0))
    return (
        F.when(lowered.rlike(_SPECIAL), F.flatten(F.transform(lexemes, _parts)))
        .when(col.rlike(_COMPOUND), F.flatten(F.transform(plain, _hyphenated)))
        .otherwise(plain)
    )


def word_count(col: Column) -> Column:
    """Number of Unicode word runs."""
    return F.size(F.regexp_extract_all(col, F.lit(r"(?U)\b\w+\b"), F.lit(0))).cast("bigint")


_STEM_CACHE_LIMIT = 500_000


def word_stems() -> Callable[[str], str]:
    """A stemmer with a memo of bounded size, for one task; only words of letters and hyphens have stems."""
    memo: dict[str, str] = {}

    def lookup(word: str) -> str:
        found = memo.get(word)
        if found is None:
            if len(memo) >= _STEM_CACHE_LIMIT:
                memo.clear()
            found = memo[word] = stem(word) if word.replace("-", "").isalpha() else word
        return found

    return lookup


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Stem token arrays.

    A row holds one document, so nothing is shuffled; most tokens are memo hits.
    """
    lookup = word_stems()
    for rows in batches:
        yield rows.map(lambda words: None if words is None else [lookup(w) for w in words])


def html_escape(col: Column) -> Column:
    """Escape markup characters; the ampersand goes first."""
    # The five HTML escapes.
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(raw), F.lit(escaped))
    return col
