"""English word stems by Porter's rules (M. F. Porter, An algorithm for suffix stripping, 1980)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffixes of the published steps 2, 3 and 4, in the order of the paper.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)
STEP_4_ENDINGS = dict.fromkeys(STEP_4, "")
LONGEST = max(map(len, (*STEP_2, *STEP_3, *STEP_4)))
# Words that a task remembers the stems of.
KNOWN = 1 << 17


class _Letters(dict):
    """A table for ``str.translate``: letters that it doesn't name are consonants."""

    def __missing__(self, letter: int) -> str:
        return "c"


_LETTERS = _Letters({**dict.fromkeys(map(ord, "bcdfghjklmnpqrstvwxz"), "c"), **dict.fromkeys(map(ord, "aeiou"), "v"), ord("y"): "y"})


def _kinds(word: str) -> str:
    """One letter per letter: v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = word.translate(_LETTERS)
    while (at := out.find("y")) >= 0:
        out = out[:at] + ("v" if out[at - 1 : at] == "c" else "c") + out[at + 1 :]
    return out


def _measure(word: str) -> int:
    """Runs of vowels that a consonant follows."""
    return _kinds(word).count("vc")


def _short_end(word: str) -> bool:
    return _kinds(word).endswith("cvc") and word[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str], least: int) -> str:
    """The longest ending that fits, exchanged if enough of the word is left before it."""
    for size in range(LONGEST, 1, -1):
        if (end := word[-size:]) in endings:
            rest = word[: len(word) - len(end)]
            if end == "ion" and rest[-1:] not in ("s", "t"):
                continue
            return rest + endings[end] if _measure(rest) > least else word
    return word


def _without_ed(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for end in ("ed", "ing"):
        rest = word[: len(word) - len(end)]
        if word.endswith(end) and "v" in _kinds(rest):
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if rest[-1:] == rest[-2:-1] and _kinds(rest)[-1] == "c" and rest[-1] not in "lsz":
                return rest[:-1]
            return rest + "e" if _measure(rest) == 1 and _short_end(rest) else rest
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word of a-z; words of up to two letters stay."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    word = _without_ed(word)
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(word, STEP_2, 0)
    word = _replaced(word, STEP_3, 0)
    word = _replaced(word, STEP_4_ENDINGS, 1)
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stems(c: Column) -> Column:
    """The stems of a column of words. A task stems a word that comes again once, while it remembers it."""
    known: dict[str, str] = {}

    @F.arrow_udf("string")
    def stemmed(words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        if len(known) > KNOWN:
            known.clear()
        out = []
        for word in coded.dictionary.to_pylist():
            if (found := known.get(word)) is None:
                found = known[word] = stem(word)
            out.append(found)
        return pa.array(out, pa.string()).take(coded.indices)

    return stemmed(c)
