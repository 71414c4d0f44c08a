"""Stems of English words by Porter's published algorithm (1980)."""

from __future__ import annotations

import functools
import re

# fixed values: suffixes of the published steps and what stands for them
STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """A word as v and c; y is a vowel after a consonant."""
    out = ""
    for i, x in enumerate(w):
        out += "v" if x in "aeiou" or x == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    """How often a vowel is followed by a consonant."""
    return _shape(w).count("vc")


def _short(w: str) -> bool:
    """Ends in consonant, vowel, consonant, the last one not w, x or y."""
    return _shape(w).endswith("cvc") and w[-1] not in "wxy"


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _replaced(w: str, table: dict[str, str], least: int) -> str:
    """The longest suffix of ``table`` replaced, if the rest has more than ``least``."""
    end = max((e for e in table if w.endswith(e)), key=len, default=None)
    if end is None or _measure(w[: -len(end)]) <= least:
        return w
    return w[: -len(end)] + table[end]


def _first(w: str) -> str:
    """Plurals, -ed and -ing, final y."""
    w = re.sub("(ss|i)es$", r"\1", w) if w.endswith("es") and re.search("(ss|i)es$", w) else re.sub("([^s])s$", r"\1", w)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        m = re.search("(ed|ing)$", w)
        if m and "v" in _shape(w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _short(w):
                w += "e"
            elif _double(w) and w[-1] not in "lsz":
                w = w[:-1]
    return w[:-1] + "i" if w.endswith("y") and "v" in _shape(w[:-1]) else w


@functools.lru_cache(100_000)
def stem(w: str) -> str:
    """Words of two letters at most, or with anything but a to z, are their own stems."""
    if len(w) < 3 or not re.fullmatch("[a-z]+", w):
        return w
    w = _replaced(_replaced(_first(w), STEP2, 0), STEP3, 0)
    end = max((e for e in STEP4 if w.endswith(e)), key=len, default=None)
    if end and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w
