"""Unit strings: segmentation by dynamic programming over tries of scales, roots and exponents.

A unit text such as ``£'000``, ``GBP bn``, ``thousands of pounds`` or ``km²`` is cut into known
pieces.  Every way to cut it is scored: pieces that fit the field's dimension gain, pieces of
another dimension and skipped characters cost.  So ``m`` is a million where money is expected and a
metre where a length is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

#: Scale words and signs with their factor.
SCALES = {
    "k": 1e3, "thousand": 1e3, "thousands": 1e3, "000": 1e3, "m": 1e6, "mn": 1e6, "mil": 1e6, "mio": 1e6, "million": 1e6,
    "millions": 1e6, "b": 1e9, "bn": 1e9, "billion": 1e9, "billions": 1e9, "tn": 1e12, "trillion": 1e12,
    "c": 1e-2, "centi": 1e-2, "milli": 1e-3, "kilo": 1e3, "mega": 1e6, "giga": 1e9, "g": 1e9, "hundred": 1e2,
}
#: Scales that stand before a physical unit, where some letters mean something else than with money.
PHYSICAL_SCALES = {"k": 1e3, "kilo": 1e3, "c": 1e-2, "centi": 1e-2, "m": 1e-3, "milli": 1e-3, "M": 1e6, "mega": 1e6, "G": 1e9, "giga": 1e9}
#: Roots with their dimension and factor to its base unit (pound, metre, gram, second, watt).
ROOTS = {
    "£": ("money", 1.0), "gbp": ("money", 1.0), "pound": ("money", 1.0), "pounds": ("money", 1.0), "sterling": ("money", 1.0),
    "p": ("money", 0.01), "pence": ("money", 0.01),
    "m": ("length", 1.0), "metre": ("length", 1.0), "metres": ("length", 1.0), "meter": ("length", 1.0), "mile": ("length", 1609.344),
    "miles": ("length", 1609.344), "ft": ("length", 0.3048), "feet": ("length", 0.3048),
    "g": ("mass", 1.0), "gram": ("mass", 1.0), "grams": ("mass", 1.0), "t": ("mass", 1e6), "tonne": ("mass", 1e6), "tonnes": ("mass", 1e6),
    "s": ("time", 1.0), "sec": ("time", 1.0), "h": ("time", 3600.0), "hour": ("time", 3600.0), "hours": ("time", 3600.0),
    "day": ("time", 86400.0), "days": ("time", 86400.0), "week": ("time", 604800.0), "weeks": ("time", 604800.0),
    "w": ("power", 1.0), "watt": ("power", 1.0), "watts": ("power", 1.0),
}
EXPONENTS = {"²": 2, "^2": 2, "2": 2, "squared": 2, "³": 3, "^3": 3, "3": 3, "cubed": 3}

FITS, FOREIGN, SKIP, PIECE = 3.0, -4.0, -0.6, -0.4


@dataclass(frozen=True)
class Unit:
    """factor to the base unit of the dimension; scaled tells whether a scale was named."""

    factor: float
    dimension: str | None
    exponent: int
    scaled: bool
    score: float


def _trie(words):
    root: dict = {}
    for word in words:
        node = root
        for char in word:
            node = node.setdefault(char, {})
        node[""] = word
    return root


_SCALE_TRIE, _PHYSICAL_TRIE, _ROOT_TRIE, _EXP_TRIE = _trie(SCALES), _trie(PHYSICAL_SCALES), _trie(ROOTS), _trie(EXPONENTS)


def _walk(trie, text, start):
    node = trie
    for i in range(start, len(text)):
        node = node.get(text[i])
        if node is None:
            return
        if "" in node:
            yield node[""], i + 1


@lru_cache(maxsize=100_000)
def parse_unit(text: str, dimension: str = "money") -> Unit | None:
    """The best reading of a unit text for a field of ``dimension``; None when nothing in it is a unit.

    Null-safe callers pass ""; a text without any known piece gives None.
    """
    lower = text.lower()
    n = len(text)
    # state: (position, root seen, scale seen) -> (score, factor, dimension, exponent)
    best: dict[tuple[int, bool, bool], tuple[float, float, str | None, int]] = {(0, False, False): (0.0, 1.0, None, 1)}

    def offer(key, value):
        if key not in best or value[0] > best[key][0]:
            best[key] = value

    money = dimension == "money"
    for i in range(n):
        for rooted in (False, True):
            for scaled in (False, True):
                state = best.pop((i, rooted, scaled), None)
                if state is None:
                    continue
                score, factor, dim, exponent = state
                letter = lower[i].isalpha()
                begins = i == 0 or not (letter and lower[i - 1].isalpha())
                # skip a whole word or one sign
                j = i + 1
                if letter:
                    while j < n and lower[j].isalpha():
                        j += 1
                offer((j, rooted, scaled), (score + (SKIP if letter else 0.0), factor, dim, exponent))
                if not scaled:
                    for word, end in _walk(_SCALE_TRIE if money else _PHYSICAL_TRIE, lower if money else text, i):
                        closed = end == n or not (lower[end].isalpha() and word[-1].isalpha())
                        if begins and (closed or not money):
                            value = SCALES[word] if money else PHYSICAL_SCALES[word]
                            offer((end, rooted, True), (score + FITS / 2 + PIECE, factor * value, dim, exponent))
                if not rooted:
                    for word, end in _walk(_ROOT_TRIE, lower, i):
                        kind, value = ROOTS[word]
                        closed = end == n or not (lower[end].isalpha() and word[-1].isalpha())
                        glued = begins or (scaled and not money)
                        if glued and closed:
                            gain = FITS if kind == dimension else FOREIGN
                            offer((end, True, scaled), (score + gain + PIECE, factor * value, kind, exponent))
                elif not money and exponent == 1:
                    for word, end in _walk(_EXP_TRIE, lower, i):
                        offer((end, rooted, scaled), (score + 1.0, factor ** EXPONENTS[word], dim, EXPONENTS[word]))
    ends = [(v, k) for k, v in best.items() if k[0] == n and (k[1] or k[2])]
    if not ends:
        return None
    (score, factor, dim, exponent), (_, _, scaled) = max(ends, key=lambda e: e[0][0])
    if score <= 0 and dim != dimension:
        return None
    return Unit(factor, dim, exponent, scaled, score) if math.isfinite(factor) else None


#: Words that may stand between a scale and its root.
_LINKING = ("of", "in")


def _tokens(text: str) -> list[tuple[int, int]]:
    """Spans of words, runs of digits and single signs."""
    out, i = [], 0
    while i < len(text):
        j = i + 1
        if text[i].isalpha():
            while j < len(text) and text[j].isalpha():
                j += 1
        elif text[i].isdigit():
            while j < len(text) and text[j].isdigit():
                j += 1
        if not text[i].isspace():
            out.append((i, j))
        i = j
    return out


@lru_cache(maxsize=100_000)
def _is_piece(word: str) -> bool:
    return word in ("'", "’", "(", ")", "/") or word in _LINKING or word in SCALES or word in ROOTS


def leading_unit(text: str, dimension: str = "money") -> Unit | None:
    """The unit that a text begins with, as behind a number; None when it begins with something else.

    The text is followed as long as it goes on with pieces of units; what they make is segmented as a whole.
    """
    lower = text.lower()
    stop = 0
    for a, b in _tokens(lower):
        if not _is_piece(lower[a:b]):
            break
        stop = b
    return parse_unit(text[:stop], dimension) if stop else None


def trailing_unit(text: str, dimension: str = "money") -> Unit | None:
    """The unit that a text ends with, as before a number."""
    lower = text.lower()
    start = len(text)
    for a, b in reversed(_tokens(lower)):
        word = lower[a:b]
        if not _is_piece(word) or word in _LINKING:
            break
        start = a
    return parse_unit(text[start:], dimension) if start < len(text) else None
