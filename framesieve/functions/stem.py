"""Stems of English words by Porter's published rules (1980)."""

from __future__ import annotations

import re
from functools import lru_cache

#: Fixed values of the published algorithm: endings and what they become, by step.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

_KINDS = re.compile("v+c+")


def kinds(word: str) -> str:
    """v for each vowel, c for each consonant; y is a vowel behind a consonant."""
    out = ""
    for k, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and k and out[-1] == "c") else "c"
    return out


def measure(word: str) -> int:
    """How often consonants follow vowels."""
    return len(_KINDS.findall(kinds(word)))


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and kinds(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last of them not w, x or y."""
    return kinds(word).endswith("cvc") and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    """The stem of a lower-cased word; words of other than ASCII letters, and of one or two letters, are their own stems."""
    if len(word) < 3 or not (word.isascii() and word.isalpha() and word.islower()):
        return word
    if word.endswith("s"):
        word = word[:-2] if word.endswith(("sses", "ies")) else word if word.endswith("ss") else word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    elif (cut := _longest(word, ("ed", "ing"))) and "v" in kinds(rest := word[: -len(cut)]):
        word = rest
        if word.endswith(("at", "bl", "iz")) or (measure(word) == 1 and _short(word)):
            word += "e"
        elif _double(word) and word[-1] not in "lsz":
            word = word[:-1]
    if word.endswith("y") and "v" in kinds(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        if (end := _longest(word, table)) and measure(word[: -len(end)]):
            word = word[: -len(end)] + table[end]
    if (end := _longest(word, STEP_4)) and measure(rest := word[: -len(end)]) > 1 and (end != "ion" or rest.endswith(("s", "t"))):
        word = rest
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    if word.endswith("ll") and measure(word[:-1]) > 1:
        word = word[:-1]
    return word
