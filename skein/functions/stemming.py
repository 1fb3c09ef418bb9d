"""The English stemmer of the Snowball project (Porter2), as published, for single words; used on distinct words only."""

from __future__ import annotations

# The published algorithm's letters, endings and exceptional forms, and the usual English stop words.
VOWELS = frozenset("aeiouy")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = frozenset("cdeghkmnrt")
R1_PREFIXES = ("gener", "commun", "arsen")
EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
UNCHANGED = frozenset("sky news howe atlas cosmos bias andes".split())
UNCHANGED_AFTER_S = frozenset("inning outing canning herring earring proceed exceed succeed".split())
STEP2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
STOP = frozenset("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs
 themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
 of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where
 why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now""".split())


def _region(word: str, start: int) -> int:
    """Where the part behind the first non-vowel behind a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in VOWELS and word[i - 1] in VOWELS:
            return i + 1
    return len(word)


def _short_end(word: str) -> bool:
    """Whether word ends in a short syllable."""
    if len(word) == 2:
        return word[0] in VOWELS and word[1] not in VOWELS
    return len(word) > 2 and word[-1] not in VOWELS and word[-1] not in "wxY" and word[-2] in VOWELS and word[-3] not in VOWELS


def _longest(word: str, endings) -> str:
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def stem(word: str) -> str:
    """The stem of a word in small letters; words of two letters or less, or with letters beyond a-z, are treated like any other."""
    if len(word) <= 2:
        return word
    if word in EXCEPTIONS:
        return EXCEPTIONS[word]
    if word in UNCHANGED:
        return word
    word = word.removeprefix("'")
    word = "".join("Y" if c == "y" and (i == 0 or word[i - 1] in VOWELS) else c for i, c in enumerate(word))
    r1 = next((len(p) for p in R1_PREFIXES if word.startswith(p)), None)
    r1 = _region(word, 0) if r1 is None else r1
    r2 = _region(word, r1)
    word = word.removesuffix(_longest(word, ("'", "'s", "'s'")))

    if word.endswith("sses"):
        word = word[:-2]
    elif word.endswith(("ied", "ies")):
        word = word[:-2] if len(word) > 4 else word[:-1]
    elif word.endswith("s") and not word.endswith(("us", "ss")) and any(c in VOWELS for c in word[:-2]):
        word = word[:-1]
    if word in UNCHANGED_AFTER_S:
        return word

    end = _longest(word, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if end in ("eed", "eedly"):
        if len(word) - len(end) >= r1:
            word = word[: len(word) - len(end)] + "ee"
    elif end and any(c in VOWELS for c in word[: len(word) - len(end)]):
        word = word[: len(word) - len(end)]
        if word.endswith(("at", "bl", "iz")):
            word += "e"
        elif word.endswith(DOUBLES):
            word = word[:-1]
        elif _short_end(word) and r1 >= len(word):
            word += "e"
    if len(word) > 2 and word[-1] in "yY" and word[-2] not in VOWELS:
        word = word[:-1] + "i"

    end = _longest(word, STEP2)
    at = len(word) - len(end)
    if end and at >= r1 and (end != "ogi" or word[at - 1:at] == "l") and (end != "li" or word[at - 1:at] in LI_ENDINGS):
        word = word[:at] + STEP2[end]
    end = _longest(word, STEP3)
    at = len(word) - len(end)
    if end and at >= r1 and (end != "ative" or at >= r2):
        word = word[:at] + STEP3[end]
    end = _longest(word, STEP4)
    at = len(word) - len(end)
    if end and at >= r2 and (end != "ion" or word[at - 1:at] in ("s", "t")):
        word = word[:at]
    if word.endswith("e"):
        if len(word) - 1 >= r2 or (len(word) - 1 >= r1 and not _short_end(word[:-1])):
            word = word[:-1]
    elif word.endswith("ll") and len(word) - 1 >= r2:
        word = word[:-1]
    return word.replace("Y", "y")
