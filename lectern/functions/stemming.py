"""English word stems by the published Porter2 rules, and stop words."""

from __future__ import annotations

import re

# Words of English that are neither indexed nor searched for.
STOP_WORDS = frozenset(
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now".split()
)
# Words with stems of their own, words that stay, words that stay after the plural is off.
OWN = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
STAY = frozenset("sky news howe atlas cosmos bias andes".split())
STAY_SINGULAR = frozenset("inning outing canning herring earring proceed exceed succeed".split())
# Endings and what they become, within R1.
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate",
    "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble",
    "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")

VOWEL = re.compile("[aeiouy]")
REGION = re.compile("[aeiouy][^aeiouy]")
SHORT_END = re.compile("(?:[^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$")
PLAIN = re.compile("[a-z]{3,}")


def ending(word: str, endings) -> str | None:  # noqa: ANN001
    """The longest of `endings` that the word has."""
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin."""
    lead = re.match("gener|commun|arsen", word)
    m = REGION.search(word)
    r1 = lead.end() if lead else m.end() if m else len(word)
    m = REGION.search(word, r1)
    return r1, m.end() if m else len(word)


def singular(word: str) -> str:
    if word.endswith("sses"):
        return word[:-2]
    if word.endswith(("ied", "ies")):
        return word[:-2] if len(word) > 4 else word[:-1]
    if word.endswith("s") and not word.endswith(("us", "ss")) and VOWEL.search(word[:-2]):
        return word[:-1]
    return word


def without_tense(word: str, r1: int) -> str:
    end = ending(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if not end:
        return word
    base = word[: -len(end)]
    if end.startswith("eed"):
        return base + "ee" if len(base) >= r1 else word
    if not VOWEL.search(base):
        return word
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if base.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
        return base[:-1]
    return base + "e" if r1 >= len(base) and SHORT_END.search(base) else base


def stem(word: str) -> str:
    """The stem of a word in lower case; words with other characters than a to
    z, and words of one or two letters, stay."""
    if word in OWN or word in STAY or not PLAIN.fullmatch(word):
        return OWN.get(word, word)
    word = re.sub("(^|[aeiouy])y", r"\1Y", word)
    r1, r2 = regions(word)
    word = singular(word)
    if word in STAY_SINGULAR:
        return word
    word = without_tense(word, r1)
    if len(word) > 2 and word[-1] in "yY" and not VOWEL.match(word[-2]):
        word = word[:-1] + "i"

    end = ending(word, SECOND)
    if end and len(word) - len(end) >= r1:
        before = word[: -len(end)]
        if not (end == "ogi" and not before.endswith("l") or end == "li" and before[-1:] not in tuple("cdeghkmnrt")):
            word = before + SECOND[end]
    end = ending(word, THIRD)
    if end and len(word) - len(end) >= (r2 if end == "ative" else r1):
        word = word[: -len(end)] + THIRD[end]
    end = ending(word, FOURTH)
    if end and len(word) - len(end) >= r2 and (end != "ion" or word[:-3].endswith(("s", "t"))):
        word = word[: -len(end)]
    last = len(word) - 1
    if word.endswith("e") and (last >= r2 or last >= r1 and not SHORT_END.search(word[:-1])) or word.endswith("ll") and last >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
