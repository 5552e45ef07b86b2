"""Porter2 (English Snowball) stemmer, written from the published description.

Applied to single words inside Arrow batches; see ``text.stem_tokens``.
"""

from __future__ import annotations

import re

_VOWELS = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_LI_ENDINGS = "cdeghkmnrt"

# Words with stems of their own.
_WHOLE_WORD = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie",
    "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos",
    "bias": "bias", "andes": "andes",
}
# Words left alone once their plural ending is gone.
_KEPT_AFTER_PLURAL = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}

# Suffix tables of steps 2, 3 and 4.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"),
    ("entli", "ent"), ("izer", "ize"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("aliti", "al"), ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"),
    ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"), ("biliti", "ble"), ("bli", "ble"),
    ("fulli", "ful"), ("lessli", "less"), ("ogi", "og"), ("li", ""),
)
_STEP3 = (
    ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"),
    ("ical", "ic"), ("ful", ""), ("ness", ""), ("ative", ""),
)
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ism", "ate", "iti", "ous", "ive", "ize", "ion")

_BY_LENGTH2 = tuple(sorted(_STEP2, key=lambda pair: -len(pair[0])))
_BY_LENGTH3 = tuple(sorted(_STEP3, key=lambda pair: -len(pair[0])))
_BY_LENGTH4 = tuple(sorted(_STEP4, key=lambda suffix: -len(suffix)))

_REGION = re.compile(r"[aeiouy][^aeiouy]")
_HAS_VOWEL = re.compile(r"[aeiouy]")


def _regions(word: str) -> tuple[int, int]:
    start = 0
    for prefix in ("gener", "commun", "arsen"):
        if word.startswith(prefix):
            start = len(prefix)
            break
    else:
        found = _REGION.search(word)
        start = found.end() if found else len(word)
    found = _REGION.search(word, start)
    return start, found.end() if found else len(word)


def _ends_short(word: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in _VOWELS and word[1] not in _VOWELS
    if len(word) < 2:
        return False
    a, b, c = word[-3], word[-2], word[-1]
    return a not in _VOWELS and b in _VOWELS and c not in _VOWELS and c not in "wxY"


def _plural(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith(("us", "ss")):
        return word
    if word.endswith("s") and _HAS_VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def _past(word: str, r1: int) -> str:
    for suffix in ("eedly", "eed"):
        if word.endswith(suffix):
            return word[: -len(suffix)] + "ee" if len(word) - len(suffix) >= r1 else word
    for suffix in ("ingly", "edly", "ing", "ed"):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if not _HAS_VOWEL.search(base):
                return word
            if base.endswith(("at", "bl", "iz")):
                return base + "e"
            if base.endswith(_DOUBLES):
                return base[:-1]
            if r1 >= len(base) and _ends_short(base):
                return base + "e"
            return base
    return word


def _derived(word: str, r1: int) -> str:
    for suffix, replacement in _BY_LENGTH2:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) < r1:
                return word
            if suffix == "ogi" and not base.endswith("l"):
                return word
            if suffix == "li" and base[-1:] not in _LI_ENDINGS:
                return word
            return base + replacement
    return word


def _adjective(word: str, r1: int, r2: int) -> str:
    for suffix, replacement in _BY_LENGTH3:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) < (r2 if suffix == "ative" else r1):
                return word
            return base + replacement
    return word


def _residue(word: str, r2: int) -> str:
    for suffix in _BY_LENGTH4:
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if len(base) < r2 or (suffix == "ion" and base[-1:] not in ("s", "t")):
                return word
            return base
    return word


def _final(word: str, r1: int, r2: int) -> str:
    if word.endswith("e"):
        base = word[:-1]
        if len(base) >= r2 or (len(base) >= r1 and not _ends_short(base)):
            return base
    elif word.endswith("ll") and len(word) - 1 >= r2:
        return word[:-1]
    return word


def stem(word: str) -> str:
    """Stem of one lower-cased word."""
    if len(word) <= 2:
        return word
    if word in _WHOLE_WORD:
        return _WHOLE_WORD[word]
    # A "y" that begins the word or follows a vowel acts as a consonant, marked "Y".
    word = re.sub(r"(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = _regions(word)
    word = _plural(word)
    if word in _KEPT_AFTER_PLURAL:
        return word
    word = _past(word, r1)
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in _VOWELS:
        word = word[:-1] + "i"
    word = _derived(word, r1)
    word = _adjective(word, r1, r2)
    word = _residue(word, r2)
    return _final(word, r1, r2).replace("Y", "y")
