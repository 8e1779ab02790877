"""Abusive, hateful or sexual content: a score per document, for texts in several languages.

Every sentence gets dense features: densities of lexicons, how near their words stand to words for persons and
groups, disguises, capitals and punctuation.  One of the lexicons is induced from labelled documents: how much
each of their words leans to abusive sentences or away from them.  Gradient-boosted trees start from a fixed margin
over the lexicons and learn the rest from labels; isotonic regression on scores of held-out folds turns margins
into probabilities.  The same steps are taken at every size: leaves and lexicon weights are shrunk by how much
was seen, and the calibration starts from a few observations of the logistic curve.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Most labelled documents that a model is fitted on (the least by a seeded hash of their ids).
SAMPLE = 40_000
#: From this probability on a document counts as found.
THRESHOLD = 0.5
TREES, DEPTH, RATE, BINS, FOLDS = 60, 3, 0.15, 32, 4

# Word lists by category, in English, French, German, Spanish and Ukrainian.
INSULTS = """
idiot idiots moron morons cretin cretins imbecile imbeciles halfwit halfwits scumbag scumbags bastard bastards bitch bitches arsehole
arseholes asshole assholes dipshit dipshits shithead fool fools stupid dumb brainless gutless spineless worthless useless pathetic filthy
stinking rotten vile ugly liar liars pig pigs twofaced twat wanker prick dickhead slut whore coward loser scum swine fuck fucking fucker shit
cunt disgusting waste ordure ordures cretin connard connards conne salope salaud imbecile gueule putain abruti encule merde pourri pourrie
pauvre lache arschloch versager schlampe vollidiot fresse maul sau schwein hund dreck elender elende widerliche widerlicher hure wichser
drecksau mistkerl imbecil idiota basura cerdo perro perra asqueroso inutil puta mierda gilipollas cabron callate zorra
ідіот нікчема свиня тупа тупий тварюка покидьок шльондра жалюгідний сука дурень мерзота сволота падло пельку продажна
""".split()
THREATS = """
choke kill dead die dies death bullet rope hang burn fire throat neck mouth bury beat crawl walk throw strangle stab shoot hell break smash slit
drown river hunt fist blood bleed bones teeth fingers kids children address watch sleeping crever crevent creve tuer egorger mort habites
umbringen toten erwurgen sterben wohnst mueras matar ahorcar muerte vives здохни вбити смерть живеш втечеш
""".split()
DEHUMAN = """
rat rats vermin parasite parasites cockroach cockroaches monkey monkeys animals breed plague filth subhuman dogs scum pack fence cage
ungeziefer ratten weggesperrt jagt vermine chasse chasser ratas parasitos patadas encerrarlos echarlos щурів щури звірі паразити гнати женіть
""".split()
GROUPS = """
immigrants immigrant foreigners foreigner cripples cripple women woman gays jews muslims blacks gypsies refugees migrants people
families them they etrangers etranger gens ils fremden fremde auslander sie gente extranjeros приїжджих приїжджі люди вони їх чужинці
""".split()
SEXUAL = """
sex tits cock naked nude underwear skirt knees legs thighs bed kiss lick moaning moan stripped bent porn suck breasts boobs pussy dick rape
couche couchant nue seins knien nackt beine brust desnuda piernas tetas cama гола ліжко ноги груди
""".split()
SECOND = """
you your yours yourself u ur tu te ta toi ton tes vous votre du dich dir dein deine euer ihr dein eres tus vuestro usted ти тебе тобі
твій твоя ваш ваша ви
""".split()
PERSONS = """
i me my he him his she her hers who everybody nobody somebody man woman
elle il lui qui jemand er ihm ihrer el ella nadie quien він вона
""".split()
#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјкмтвнѕԁԛԝ", "aeopcyxijkmtbhsdqw", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}

_HIDDEN = re.compile("[­​-‏⁠﻿]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+(?:[@$!*|]+[^\W_]+)*[*$]*|[@$][^\W_]+(?:[@$!*|]+[^\W_]+)*")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_*])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
_CYRILLIC, _LATIN = re.compile("[Ѐ-ӿ]"), re.compile("[a-z]")


def plain_word(word: str) -> tuple[str, bool]:
    """(a word's skeleton: no case, accents, look-alikes, signs and repeated letters; whether it was disguised)."""
    lower = word.lower()
    disguised = False
    if _CYRILLIC.search(lower) and _LATIN.search(lower):
        lower, disguised = "".join(LOOKALIKES.get(c, c) for c in lower), True
    if "*" in lower:
        return f"{lower[0]}*{lower[-1]}", True
    letters = sum(c.isalpha() for c in lower)
    if letters < len(lower) and (letters or len(lower) > 3) and any(not c.isalnum() for c in lower):
        lower, disguised = "".join(SIGNS.get(c, c) for c in lower), True
    elif 0 < letters < len(lower):
        changed = "".join(SIGNS.get(c, c) for c in lower)
        disguised, lower = changed.isalpha() and "1l" not in lower, changed
    inner = word[1:]
    if inner.lower() != inner and inner.upper() != inner:
        disguised = True
    stripped = "".join(c for c in unicodedata.normalize("NFD", lower) if not unicodedata.combining(c)) if not lower.isascii() else lower
    if re.search(r"(.)\1\1", stripped):
        disguised = True
    return re.sub(r"(.)\1+", r"\1", stripped), disguised


def _skeletons(words):
    return frozenset(plain_word(w)[0] for w in words)


_LISTS = tuple(map(_skeletons, (INSULTS, THREATS, DEHUMAN, GROUPS, SEXUAL, SECOND, PERSONS)))
#: Every list's membership of a word as one number of seven bits.
_BITS: dict[str, int] = {}
for _k, _list in enumerate(_LISTS):
    for _w in _list:
        _BITS[_w] = _BITS.get(_w, 0) | (1 << _k)
#: Features of a sentence: words by lexicon, how near they stand to persons and groups, disguises, the induced lexicon.
NAMES = (
    "insults", "threats", "dehuman", "groups", "sexual", "second", "persons", "insult_near_second", "threat_near_second", "dehuman_near_group",
    "sexual_near_person", "insult_near_person", "disguised", "disguised_insults", "leaning_density", "leaning_sum", "heavy_words", "heavy_share",
)
#: Pairs of lexicons whose distance is a feature; each side is a sum of bits.
NEAR = ((1, 32), (2, 32), (4, 8), (16, 96), (1, 64))
DOCUMENT_NAMES = (*NAMES, "margin", "exclamations", "capitals", "words_log", "insult_density")
AT_MARGIN = DOCUMENT_NAMES.index("margin")
_UPPER = re.compile("[A-ZÀ-ÖØ-ÞЀ-Я]+")


class Words:
    """Skeletons of words, remembered; the memory is emptied when it has grown large.

    A word's code is twice the number of its skeleton, and one more for a disguised word.
    """

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.numbers: dict[str, int] = {}
        self.skeletons: list[str] = []

    def _code(self, word: str) -> int:
        skeleton, odd = plain_word(word)
        number = self.numbers.get(skeleton)
        if number is None:
            number = self.numbers[skeleton] = len(self.skeletons)
            self.skeletons.append(skeleton)
        code = self.known[word] = 2 * number + odd
        return code

    def codes(self, text: str) -> list[tuple[list[int], int]]:
        """(codes of words, further disguises) of each sentence with a word."""
        hidden = 0
        if not text.isascii():
            cleaned = _HIDDEN.sub("", text)
            hidden = len(text) - len(cleaned)
            text = unicodedata.normalize("NFKC", cleaned)
        out = []
        known = self.known
        some_spaced = _SPACED.search(text) is not None
        for part in _SENTENCE.split(text):
            spaced = 0
            if some_spaced and _SPACED.search(part):
                def join(m):
                    nonlocal spaced
                    spaced += 1
                    letters = re.sub(r"[ .\-_*]", "", m.group(0))
                    # an article before spaced letters is no part of them
                    return letters if letters[0].lower() != "a" or m.group(1) != " " or len(letters) < 4 else f"a {letters[1:]}"

                part = _SPACED.sub(join, part)
            words = _WORD.findall(part)
            if words:
                found = [known.get(w) for w in words]
                if None in found:
                    found = [self._code(w) if c is None else c for w, c in zip(words, found, strict=True)]
                out.append((found, spaced))
        if hidden and out:
            out[0] = (out[0][0], out[0][1] + 1)
        return out

    def sentences(self, text: str) -> list[tuple[list[str], int]]:
        """(skeletons, disguised words) of each sentence with a word."""
        if len(self.known) > self.most:
            self.clear()
        found = self.codes(text)
        return [([self.skeletons[c >> 1] for c in codes], odd + sum(c & 1 for c in codes)) for codes, odd in found]


def _nearness(bits: np.ndarray, sentence: np.ndarray, which: int, other: int) -> np.ndarray:
    """Per word of ``which`` 1 / (1 + words to the nearest word of ``other`` in its sentence), else 0."""
    n = len(bits)
    mine, theirs = (bits & which) > 0, (bits & other) > 0
    place = np.arange(n)
    before = np.maximum.accumulate(np.where(theirs, place, -1))
    after = np.minimum.accumulate(np.where(theirs, place, n)[::-1])[::-1]
    same_before = (before >= 0) & (sentence[np.maximum(before, 0)] == sentence)
    same_after = (after < n) & (sentence[np.minimum(after, n - 1)] == sentence)
    gap = np.minimum(np.where(same_before, place - before, n), np.where(same_after, after - place, n))
    return np.where(mine & (gap < n), 1.0 / (1.0 + gap), 0.0)


def _matrix(words: np.ndarray, sizes: np.ndarray, odd: np.ndarray, bits_of: np.ndarray, weight_of: np.ndarray) -> np.ndarray:
    """A row of NAMES per sentence from the numbers of all words of all sentences."""
    count = len(sizes)
    sentence = np.repeat(np.arange(count), sizes)
    bits = bits_of[words]

    def total(values):
        return np.bincount(sentence, values, count)

    lists = [total((bits >> k) & 1) for k in range(7)]
    near = [np.minimum(total(_nearness(bits, sentence, which, other)), 2.0) for which, other in NEAR]
    # each word of a sentence once: those that weigh something, in order of sentence and number
    some = np.flatnonzero(weight_of[words])
    once = np.unique(sentence[some] * len(weight_of) + words[some])
    where, weights = once // len(weight_of), weight_of[once % len(weight_of)]
    leaning = np.bincount(where, weights, count)
    heavy = np.bincount(where, weights > 2.0, count)
    return np.column_stack([*lists, *near, odd, np.minimum(odd, 1) * lists[0], leaning / (sizes + 2), leaning, heavy, heavy / (sizes + 2)])


def sentence_matrix(sentences: list[tuple[list[str], int]], lexicon: dict[str, float]) -> np.ndarray:
    """A row of NAMES per sentence, worked out for all words of all sentences at once."""
    count = len(sentences)
    if not count:
        return np.zeros((0, len(NAMES)))
    sizes = np.fromiter((len(w) for w, _ in sentences), np.int64, count)
    odd = np.fromiter((o for _, o in sentences), np.float64, count)
    number: dict[str, int] = {}
    words = np.fromiter((number.setdefault(w, len(number)) for ws, _ in sentences for w in ws), np.int64, int(sizes.sum()))
    return _matrix(words, sizes, odd, *_tables(number, lexicon))


def _tables(skeletons, lexicon: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(lexicons as bits, leaning) of skeletons in their order."""
    n = len(skeletons)
    return np.fromiter((_BITS.get(w, 0) for w in skeletons), np.int64, n), np.fromiter((lexicon.get(w, 0.0) for w in skeletons), np.float64, n)


def fixed_margin(x: np.ndarray) -> np.ndarray:
    """What the lexicons alone say of sentences, in log odds."""
    insults, second, persons, groups = x[:, 0], np.minimum(x[:, 5], 2), np.minimum(x[:, 6], 2), np.minimum(x[:, 3], 2)
    return (
        -4.0
        + 2.2 * np.minimum(insults, 2)
        + 1.3 * np.minimum(np.minimum(insults, 3) * second, 2)
        + 1.0 * np.minimum(np.minimum(x[:, 1], 3) * second, 3)
        + 1.5 * np.minimum(np.minimum(x[:, 2], 3) * groups, 3)
        + 1.1 * np.minimum(np.minimum(x[:, 4], 3) * np.minimum(x[:, 5] + x[:, 6], 3), 4)
        + 1.0 * np.minimum(np.minimum(insults, 3) * persons, 2)
        + 1.5 * np.minimum(x[:, 13], 1)
    )


def text_numbers(text: str) -> tuple[int, int, int]:
    """(exclamation marks, capitals, characters) of a text."""
    return text.count("!"), sum(map(len, _UPPER.findall(text))), len(text)


def document_matrix(documents: list[list[tuple[list[str], int]]], numbers: list[tuple[int, int, int]], lexicon: dict[str, float]) -> np.ndarray:
    """A row of DOCUMENT_NAMES per document: of each sentence feature the greatest, and densities over the whole text."""
    out = np.zeros((len(documents), len(DOCUMENT_NAMES)))
    if not len(documents):
        return out
    flat = [s for d in documents for s in d]
    return _documents(sentence_matrix(flat, lexicon), np.array([len(w) for w, _ in flat], float), np.array([len(d) for d in documents]), numbers)


def _documents(rows: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, numbers: list[tuple[int, int, int]]) -> np.ndarray:
    """Document features from rows of sentences, their lengths, the sentences per document and its text's numbers."""
    out = np.zeros((len(sizes), len(DOCUMENT_NAMES)))
    filled = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[filled]
    margin = np.full(len(sizes), -6.0)
    n = np.zeros(len(sizes))
    insults = np.zeros(len(sizes))
    if len(filled):
        out[filled, : len(NAMES)] = np.maximum.reduceat(rows, starts, axis=0)
        margin[filled] = np.maximum.reduceat(fixed_margin(rows), starts)
        n[filled] = np.add.reduceat(lengths, starts)
        insults[filled] = np.add.reduceat(rows[:, 0], starts)
    marks, capitals, length = np.array(numbers, float).T
    out[:, len(NAMES) :] = np.column_stack([margin, marks / (n + 5), capitals / (length + 1), np.log1p(n), insults / (n + 5)])
    return out


def document_features(sentences, text: str, lexicon: dict[str, float]) -> list[float]:
    return document_matrix([sentences], [text_numbers(text)], lexicon)[0].tolist()


def sentence_features(words: list[str], odd: int, lexicon: dict[str, float]) -> list[float]:
    return sentence_matrix([(words, odd)], lexicon)[0].tolist()


class Trees:
    """Boosted regression trees on binned features for log loss, from a given starting margin."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.size, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[int, float, float]]] = []

    def fit(self, x: np.ndarray, y: np.ndarray, start: np.ndarray, w: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        margin = start.astype(float).copy()
        for _ in range(self.size):
            p = 1 / (1 + np.exp(-margin))
            gradient, curve = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), np.int64)
            tree: dict[int, tuple] = {}
            value = np.zeros(2 ** (self.depth + 1))
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) >= 20:
                        split = self._split(binned[rows], gradient[rows], curve[rows])
                        if split:
                            tree[k] = split
                            right = binned[rows, split[0]] > split[1]
                            node[rows] = 2 * k + 1 + right
            for k in np.unique(node):
                rows = node == k
                value[k] = self.rate * gradient[rows].sum() / (curve[rows].sum() + 3.0)
            margin += value[node]
            self.trees.append((tree, value))
        return self

    def _split(self, binned, gradient, curve):
        best, chosen = 0.2, None
        g, h = gradient.sum(), curve.sum()
        for f, edges in enumerate(self.edges):
            if not len(edges):
                continue
            n = len(edges) + 1
            gl = np.cumsum(np.bincount(binned[:, f], gradient, n))[:-1]
            hl = np.cumsum(np.bincount(binned[:, f], curve, n))[:-1]
            gain = gl**2 / (hl + 3.0) + (g - gl) ** 2 / (h - hl + 3.0) - g**2 / (h + 3.0)
            gain[(hl < 0.5) | (h - hl < 0.5)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, chosen = gain[k], (f, k)
        return chosen

    def margin(self, x: np.ndarray, start: np.ndarray) -> np.ndarray:
        if not self.trees or not len(x):
            return start.astype(float)
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)], 1)
        out = start.astype(float).copy()
        for tree, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    if k in tree:
                        f, cut = tree[k]
                        rows = node == k
                        node[rows] = 2 * k + 1 + (binned[rows, f] > cut)
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit (pool adjacent violators on tied means)."""
    w = np.ones(len(x)) if w is None else w
    knots, where = np.unique(x, return_inverse=True)
    weight = np.bincount(where, w)
    mean = np.bincount(where, w * y) / weight
    blocks: list[list[float]] = []
    for k, (m, v) in enumerate(zip(mean, weight, strict=True)):
        blocks.append([m, v, k, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, hi = blocks.pop()
            m1, w1, lo, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs = np.array([v for b in blocks for v in (knots[int(b[2])], knots[int(b[3])])])
    ys = np.array([v for b in blocks for v in (b[0], b[0])])
    return xs, ys


#: Margins at which the calibration starts with an observation of the logistic curve each.
CURVE = np.arange(-6.0, 6.5, 0.5)


def calibration(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic knots from held-out margins and their labels, and one observation of the logistic curve per step."""
    return isotonic(np.r_[margin, CURVE], np.r_[y, 1 / (1 + np.exp(-CURVE))])


class Model:
    """Induced lexicon, trees and calibration; as made without labels, what the fixed lexicons say."""

    def __init__(self, lexicon=None, trees=None, knots=None):
        self.lexicon, self.trees, self.knots = lexicon or {}, trees, knots or calibration(np.zeros(0), np.zeros(0))

    def score(self, texts: list[str | None], words: Words) -> np.ndarray:
        out = np.zeros(len(texts))
        filled = [i for i, t in enumerate(texts) if t and not t.isspace()]
        if not filled:
            return out
        if len(words.known) > words.most:
            words.clear()
        coded = [words.codes(texts[i]) for i in filled]
        flat = [s for d in coded for s in d]
        lengths = np.fromiter((len(c) for c, _ in flat), np.int64, len(flat))
        codes = np.fromiter(chain.from_iterable(c for c, _ in flat), np.int64, int(lengths.sum()))
        odd = np.fromiter((o for _, o in flat), np.float64, len(flat)) + np.bincount(np.repeat(np.arange(len(flat)), lengths), codes & 1, len(flat))
        rows = _matrix(codes >> 1, lengths, odd, *_tables(words.skeletons, self.lexicon)) if flat else np.zeros((0, len(NAMES)))
        x = _documents(rows, lengths.astype(float), np.array([len(d) for d in coded]), [text_numbers(texts[i]) for i in filled])
        margin = x[:, AT_MARGIN]
        if self.trees is not None:
            margin = self.trees.margin(x, margin)
        out[filled] = np.interp(margin, *self.knots)
        return out


_PARSED = "doc_id bigint, fold int, label double, raters double, sentences array<struct<words:array<string>,odd:int>>, marks int, capitals int, length int"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    words = Words()
    for frame in frames:
        found = [words.sentences(t) for t in frame["text"]]
        numbers = np.array([text_numbers(t) for t in frame["text"]], int).reshape(-1, 3)
        yield pd.DataFrame(
            {
                "doc_id": frame["doc_id"], "fold": frame["fold"], "label": frame["label"], "raters": frame["raters"],
                "sentences": [[{"words": w, "odd": o} for w, o in s] for s in found], "marks": numbers[:, 0], "capitals": numbers[:, 1], "length": numbers[:, 2],
            }
        )


def labelled_documents(documents: DataFrame, labels: DataFrame, sample: int, seed: int) -> DataFrame:
    """Labelled documents as sentences of plain words, at most ``sample`` of them; see ``fit_model``."""
    rated = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id", "rater")
        .agg(F.max(F.col("toxic").cast("double")).alias("toxic"))
        .groupBy("doc_id")
        .agg(F.avg("toxic").alias("label"), F.count("*").cast("double").alias("raters"))
    )
    order = F.xxhash64("doc_id", F.lit(seed))
    chosen = rated.orderBy(order, "doc_id").limit(sample).withColumn("fold", F.pmod(order, F.lit(FOLDS)).cast("int"))
    texts = documents.where("text is not null").select("doc_id", "text").dropDuplicates(["doc_id"]).join(chosen, "doc_id")
    return cut_lineage(texts.mapInPandas(_parse, _PARSED))


def _leanings(a: Column, b: Column, n_pos: list[float], n_neg: list[float]) -> Column:
    """Log odds of a word per fold left out and, last, with none left out; nearer to 0 the less it was seen."""
    out = []
    for k in range(FOLDS + 1):
        x, y = F.get(a, k), F.get(b, k)
        odds = F.log((x + 0.3) / (n_pos[k] + 1)) - F.log((y + 0.3) / (n_neg[k] + 1))
        out.append(F.greatest(F.lit(-2.0), F.least(F.lit(5.0), odds)) * (x + y) / (x + y + 1))
    return F.array(*out)


def _left_out(fold: Column, condition: Column) -> Column:
    """Sums over rows, per fold left out and, last, with none left out."""
    return F.array(*[F.sum(F.when(condition & (fold != k), 1.0).otherwise(0.0)) for k in range(FOLDS + 1)])


def induced_lexicon(parsed: DataFrame) -> DataFrame:
    """(word, leaning): log odds between the sentences of abusive and of other documents, per fold left out.

    First every sentence of an abusive document counts; then, twice, only its heaviest one, and none where
    nothing in the document speaks for abuse, since raters err.
    """
    each = parsed.select("doc_id", "fold", (F.col("label") > 0.5).alias("bad"), F.posexplode("sentences").alias("no", "s"))
    total = each.agg(_left_out(F.col("fold"), F.col("bad")).alias("p"), _left_out(F.col("fold"), ~F.col("bad")).alias("n")).first()
    n_neg = [float(v or 0) for v in total["n"]]
    n_pos = [float(v or 0) for v in total["p"]]
    worded = each.select("doc_id", "fold", "bad", "no", F.explode(F.array_distinct("s.words")).alias("word"))
    counts = cut_lineage(
        worded.groupBy("word").agg(_left_out(F.col("fold"), F.col("bad")).alias("a"), _left_out(F.col("fold"), ~F.col("bad")).alias("b"))
    )
    abusive = cut_lineage(worded.where("bad").select("doc_id", "fold", "no", "word"))
    nothing = F.array(*[F.lit(0.0)] * (FOLDS + 1))
    known = counts
    for _ in range(2):
        leaning = known.select("word", _leanings(F.col("a"), F.col("b"), n_pos, n_neg).alias("v"))
        weighed = abusive.join(leaning, "word").groupBy("doc_id", "fold", "no").agg(*[F.round(F.sum(F.get("v", k)), 6).alias(f"v{k}") for k in range(FOLDS + 1)])
        heaviest = weighed.groupBy("doc_id", "fold").agg(
            *[F.max(F.when(F.col(f"v{k}") >= 2.0, F.struct(F.col(f"v{k}").alias("v"), (-F.col("no")).alias("no")))).alias(f"m{k}") for k in range(FOLDS + 1)]
        )
        picks = F.array_compact(F.array(*[F.when(F.col(f"m{k}").isNotNull() & (F.col("fold") != k), F.struct((-F.col(f"m{k}.no")).alias("no"), F.lit(k).alias("k"))) for k in range(FOLDS + 1)]))
        picked = cut_lineage(heaviest.select("doc_id", F.inline(picks)))
        seen = {r["k"]: float(r["n"]) for r in picked.groupBy("k").agg(F.count("*").alias("n")).collect()}
        n_pos = [seen.get(k, 0.0) for k in range(FOLDS + 1)]
        renewed = abusive.join(picked, ["doc_id", "no"]).groupBy("word").agg(F.array(*[F.count_if(F.col("k") == k).cast("double") for k in range(FOLDS + 1)]).alias("a"))
        known = cut_lineage(counts.drop("a").join(renewed, "word", "left").withColumn("a", F.coalesce("a", nothing)))
    return known.select("word", _leanings(F.col("a"), F.col("b"), n_pos, n_neg).alias("leaning"))


def _feature_frame(shipped, folds: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicons = [{w: v[k] for w, v in shipped.value} for k in range(folds)]
        for frame in frames:
            frame = frame.reset_index(drop=True)
            for k, part in frame.groupby("fold"):
                documents = [[(list(s["words"]), s["odd"]) for s in d] for d in part["sentences"]]
                x = document_matrix(documents, list(zip(part["marks"], part["capitals"], part["length"], strict=True)), lexicons[int(k)])
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "fold": part["fold"].to_numpy(), "label": part["label"].to_numpy(), "raters": part["raters"].to_numpy(), "x": list(x)})

    return run


def _fit_trees(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("doc_id")
    x, y, w = np.stack(frame["x"].to_numpy()), frame["label"].to_numpy(float), np.sqrt(frame["raters"].to_numpy(float))
    return pd.DataFrame({"k": [int(frame["k"].iloc[0])], "trees": [pickle.dumps(Trees().fit(x, y, x[:, AT_MARGIN], w))]})


def fit_model(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7) -> Model:
    """A model from labelled documents, at most ``sample`` of them, chosen by a seeded hash of their ids.

    A document's label is the mean over its raters, each counted once per document.  Texts are read and words
    counted in the cluster, and the trees of each fold are fitted in a task of their own; the driver gets one row of
    numbers per labelled document, the induced lexicon, which holds words of the sample only, and the trees.
    Without labels the model is what the fixed lexicons say.
    """
    parsed = labelled_documents(documents, labels, sample, seed)
    lexicon = [(r["word"], list(r["leaning"])) for r in induced_lexicon(parsed).collect()]
    shipped = documents.sparkSession.sparkContext.broadcast(lexicon)
    features = cut_lineage(parsed.mapInPandas(_feature_frame(shipped, FOLDS), "doc_id bigint, fold int, label double, raters double, x array<double>"))
    whole = features.toPandas().sort_values("doc_id")
    if not len(whole):
        return Model()
    left_out = features.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(FOLDS)))).where("k <> fold")
    trees = {r["k"]: pickle.loads(r["trees"]) for r in left_out.groupBy("k").applyInPandas(_fit_trees, "k int, trees binary").collect()}
    x, fold = np.stack(whole["x"].to_numpy()), whole["fold"].to_numpy()
    held_out = x[:, AT_MARGIN].copy()
    for k in range(FOLDS):
        inside = fold == k
        if k in trees and inside.any():
            held_out[inside] = trees[k].margin(x[inside], x[inside, AT_MARGIN])
    return Model({w: v[FOLDS] for w, v in lexicon}, trees[FOLDS], calibration(held_out, whole["label"].to_numpy(float)))


def score_documents(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` without ``text``, with ``score``: the probability of abusive, hateful or sexual content.

    Null and blank texts score 0.  Texts of any length are read whole; copies of a text score alike.
    A column ``score`` that is there already is replaced.
    """
    kept = [c for c in documents.columns if c not in (text, "score")]
    shipped = documents.sparkSession.sparkContext.broadcast(model)  # words of the labelled sample and TREES trees

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words()
        for frame in frames:
            scores = shipped.value.score([None if pd.isna(t) else t for t in frame[text]], words)
            yield frame[kept].assign(score=np.round(scores, 6))

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema), "score double"])
    return documents.mapInPandas(run, schema)
