"""Scores for abusive, hateful and sexually explicit passages in four languages.

Words are cleared of look-alike letters and invisible characters and looked up
in a lexicon trie by a Levenshtein automaton, which takes signs for the letters
they stand for, masks for any letter, repeated letters for one, and one edit.
The lexicon is a fixed list of seed terms and, where labels are at hand, the
words that a model fitted on a bounded sample of labelled documents found to
mark abuse. A passage is scored in windows: log-odds of its terms and of the
words around them, terms with a target nearby (a group, a person addressed)
more, quoted, reported and self-directed terms less.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize, tokenizer_dir
from .lexicon import ADDRESS, INTENT, KINDS, MASKS, OBJECTS, PEOPLE, REPORT, SELF, SIGNS, WEIGHTS, Automaton, pattern, vocabulary_words

#: A document is abusive from this probability on.
THRESHOLD = 0.5
#: Words that are scored together; longer passages in windows that overlap by half.
WINDOW = 24
#: Log-odds of a window without any term.
BIAS = -4.0
#: Share of its weight that a term keeps if a word is one edit away, or a mask may hide several terms.
MISSPELT = 0.85
#: Share that a term keeps if it is quoted where words are reported, and an insult if it is turned on the speaker.
QUOTED, ON_SELF = 0.15, 0.35
#: Log-odds of what stands together, before any label is seen.
TOGETHER = {"+address": 0.7, "+group": 2.5, "+target": 3.2, "+intent": 0.6}
#: A word is ordinary in a corpus if it is in more documents than the term it is near, than FEW, and than one in RARE.
FEW, RARE = 2, 10_000
#: Bounds of the sample the model is fitted on: labelled documents, and the length of each in characters.
MAX_LABELLED, MAX_CHARS = 20_000, 20_000
#: A word enters the model from so many documents of the sample on, with a weight above 0 only if it is in more
#: documents called abusive than chance explains by so many standard deviations, and more than chance explains for
#: one in so many of all the words that are let in; from LEARNT on it joins the lexicon.
SUPPORT, SURE, CHANCE, LEARNT = 4, 3.0, 0.01, 0.5
#: Standard deviations by which the share of abusive documents among those with a word is taken to be less than seen.
LESS = 1.0
#: Rounds of choosing each document's worst window, gradient steps in each, and the pull of every weight to its prior.
ROUNDS, STEPS, RIDGE = 5, 150, 0.25

_LOOKALIKE = str.maketrans(
    "аеорсухіјѕԁһкмтвнгпиαεορτυνικß",
    "aeopcyxijsdhkmtbhrnuaeoptuviks",
)
class _Marks(dict):
    """Translation that drops combining marks and replaces look-alikes."""

    def __missing__(self, c: int):
        out = self[c] = None if unicodedata.combining(chr(c)) else _LOOKALIKE.get(c, c)
        return out


_marks = _Marks()
_INVISIBLE = re.compile("[­͏؜ᅟ᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_MOJIBAKE = re.compile("[ÃÂ][\u0080-¿Œ-™]")
_APART = re.compile(r"(?<![^\W_])([^\W\d_])(?:([.\-_*])[^\W_])(?:\2[^\W_])+\2?(?![^\W_])")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_] ){2,}[^\W_](?![^\W_])")
_WORD = re.compile(r"[^\s\"“”„«»()\[\]{}<>,;:?¿¡/\\]+")
_BREAK = re.compile(r"[.!?]+[\"'”»)*_]*(?=\s|$)|\n\s*\n|\n(?=\s*(?:[-*+>#]|\d+[.)]|[^\W\d_]+ ?(?:wrote)?:))")


def fold(s: str) -> str:
    """Lower case without diacritics, invisible characters and look-alike letters."""
    s = _INVISIBLE.sub("", s)
    if s.isascii():
        return s.lower()
    if _MOJIBAKE.search(s):
        out = []
        for part in re.split(r"(\s+)", s):
            if "Ã" in part or "Â" in part:
                for enc in ("cp1252", "latin-1"):
                    try:
                        part = part.encode(enc).decode("utf-8")
                        break
                    except (UnicodeEncodeError, UnicodeDecodeError):
                        pass
            out.append(part)
        s = "".join(out)
    s = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", s).casefold().replace("ß", "ss"))
    return s.translate(_marks)


_BLOCK_TAG = re.compile(r"</?(?:p|li|ul|ol|h[1-6]|br|div|pre|tr|td|table|blockquote)\b[^<>]{0,200}>")
_TAG = re.compile(r"</?[a-z][a-z0-9-]*(?:\s[^<>]{0,200})?/?>")
_MATH = re.compile(r"\$\$[^$]{1,400}\$\$|\$(?! )[^$\n]{1,200}(?<! )\$(?!\d)|\\\([^\n]{1,200}?\\\)|\\\[.{1,400}?\\\]", re.S)
_EMPHASIS = re.compile(r"(?<![\w*])(\*{1,3}|_{1,3})(?=[^\s*_])([^*_\n]{1,200}?)(?<=[^\s*_])\1(?![\w*])")


_TEX = re.compile(r"[\\^=_]")
_COMMAND = re.compile(r"\\[a-z]+")
#: Three or more letters or signs for letters in a row, two of them letters.
_WORDLIKE = re.compile(r"(?=[^\W\d_]*[\d@$!|€+]*[^\W\d_][\d@$!|€+]*[^\W\d_])(?:[^\W_]|[@$!|€+]){3,}")


def _unless_words(m: re.Match) -> str:
    """What only can be a formula as a blank, anything else as it is."""
    inner = _COMMAND.sub(" ", m[0].strip("$"))
    around = m.string[m.start() - 1 : m.start()] + m.string[m.end() : m.end() + 1]
    if _TEX.search(m[0]) and not _WORDLIKE.search(inner) and not any(c.isalnum() or c in "@$!|+€" for c in around):
        return " "
    return m[0]


def _bare(s: str) -> list[str]:
    """Text without tags, formulas and emphasis, whose signs would look like masks.

    Where a formula may as well be words with `$` for a letter, the text with
    it is a second reading.
    """
    if "<" in s:
        s = _TAG.sub("", _BLOCK_TAG.sub("\n\n", s))
    readings = [s]
    if "$" in s or "\\" in s:
        readings = list(dict.fromkeys([_MATH.sub(" ", s), _MATH.sub(_unless_words, s)]))
    return [_EMPHASIS.sub(r"\2", r) if "*" in r or "_" in r else r for r in readings]


def _join_apart(m: re.Match) -> str:
    return re.sub(r"[.\-_*]", "", m[0]) + " "


def _join_spaced(m: re.Match) -> str:
    """Letters set apart by blanks as one word; where words run together, the longest seed term in them apart."""
    s = m[0].replace(" ", "")
    if s not in KINDS:
        t = max((t for t in KINDS if len(t) > 3 and t in s), key=len, default="")
        if t:
            a, b = s.split(t, 1)
            s = f"{a} {t} {b}".strip()
    return s + " "


def _joined(s: str) -> str:
    return _SPACED.sub(_join_spaced, _APART.sub(_join_apart, s))


class _Split(dict):
    """The words of a run of characters without blanks; runs seen before are looked up."""

    def __missing__(self, run: str) -> tuple[str, ...]:
        if len(self) > 300_000:
            self.clear()
        out = self[run] = tuple(_words_of(run))
        return out


def _words_of(run: str):
    w = run.strip(".'’`!~-_=").lstrip("*#^%")
    if w and ("_" in run or "~" in run) and run[0] not in "_~" and (tail := re.match("[_~]+", run[run.index(w) + len(w) :])):
        w += tail[0]  # a masked last letter
    if not w:
        return
    if "-" in w or "'" in w or "’" in w:
        parts = re.split(r"[-'’]", w)
        if all(len(p) > 1 for p in parts if p):
            yield from (p for p in parts if p)
            return
        w = "".join(parts)
    yield w


_split = _Split()


def _words(passage: str) -> list[str]:
    return [w for run in _WORD.findall(passage) for w in _split[run]]


# --- words and terms ------------------------------------------------------------------------------

_ENDINGS = ("s", "es", "e", "n", "en", "er", "r", "in", "ed", "ing")
_STRETCHED = re.compile(r"(.)\1{2,}")


class Matcher:
    """Terms that words stand for; every distinct word is looked up once.

    terms go into the trie and are found misspelt or disguised, further words
    only as they are or with signs for letters. A plain word is no misspelt
    term if it is a word of the vocabulary.
    """

    def __init__(self, terms: Iterable[str], words: Iterable[str] = (), vocabulary: frozenset[str] = frozenset()):
        self.terms = frozenset(terms)
        self.words = frozenset(words) | self.terms
        self.vocabulary = vocabulary
        self.trie = Automaton(self.terms)
        #: What is left of a term without a letter; words one edit apart share one of these.
        self.left = self.terms | {t[:i] + t[i + 1 :] for t in self.terms for i in range(len(t))}
        self.starts = {t[:i] for t in self.terms for i in range(len(t) + 1)}
        self.ends = {t[i:] for t in self.terms for i in range(len(t) + 1)}
        self.known: dict[str, tuple[str, float] | None] = {}

    def _may(self, word: str) -> bool:
        """Whether a disguised word may be near a term; most are ruled out here without the automaton."""
        parts = re.split(f"[{re.escape(MASKS)}]+", word)
        if len(parts) == 1:
            for f in _spelled(word):
                f = re.sub(r"(.)\1\1+", r"\1\1", f)
                for g in (f, re.sub(r"(.)\1", r"\1", f)):
                    if g in self.left or any(g[:i] + g[i + 1 :] in self.left for i in range(len(g))):
                        return True
            return False
        # what stands before the first mask and after the last one begins and ends a term, one of them with an edit at most
        first, last = ([re.sub(r"(.)\1+", r"\1", f) for f in _spelled(x)] for x in (parts[0], parts[-1]))
        return any(f in self.starts for f in first) or any(f in self.ends for f in last) or any(re.search(r"(.)\1", x) for x in (parts[0], parts[-1]))

    def _weight(self, term: str) -> float:
        return WEIGHTS[KINDS[term][0]] if term in KINDS else 0.0

    def __call__(self, word: str) -> tuple[str, float] | None:
        """The term or word a folded word stands for and the share of its weight that counts."""
        if word in self.words:
            return word, 1.0
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = self._look(word)
            return found

    def _look(self, word: str) -> tuple[str, float] | None:
        if word.isalpha():
            for end in _ENDINGS:
                stem = word[: -len(end)]
                if word.endswith(end) and len(stem) > 2 and stem in self.terms:
                    return stem, 1.0
            if word in self.vocabulary or len(word) < 4:
                return None
            short = re.sub(r"(.)\1+", r"\1", word)
            stretched = short != word and re.search(r"(.)\1\1", word)
            if not stretched and word not in self.left and not any(word[:i] + word[i + 1 :] in self.left for i in range(len(word))):
                return None
            return self._nearest(word, plain=True)
        letters = sum(1 for c in word if c.isalpha())
        if letters < 1 or not all(c.isalpha() or c in SIGNS or c in MASKS for c in word):
            word = "".join(c for c in word if c.isalpha() or c in SIGNS or c in MASKS)
            if not word or letters < 1:
                return None
        masked = any(c in MASKS for c in word)
        if masked and letters < 2 and sum(c in MASKS for c in word) < 3:
            return None
        found = self._nearest(word, plain=False) if len(word) <= 40 + 2 * len(_STRETCHED.findall(word)) and self._may(word) else None
        if not masked and (not found or found[1] < 1):
            # words that are no terms count only as they are spelled
            found = next(((f, 1.0) for f in _spelled(word) if f in self.words and f not in self.terms), found)
        return found

    def _nearest(self, word: str, plain: bool) -> tuple[str, float] | None:
        masked = not plain and any(c in MASKS for c in word)
        core = word.strip(MASKS) if masked and word[0] in MASKS else word
        found = self.trie.find(pattern(core), 0 if masked and len(core) < 6 else 1)
        exact = [t for d, t in found if d == 0]
        if masked:
            shown = [c for c in core if c not in MASKS]
            exact = [t for t in exact if len(t) >= len(shown) and len(t) >= 3]
        if exact:
            best = max(exact, key=lambda t: (self._weight(t), len(t), t))
            sure = not masked or (len(exact) == 1 and len(best) > 3)
            return best, 1.0 if sure else MISSPELT
        first = next((c for c in word if c.isalpha() or c in SIGNS), "")
        near = [t for d, t in found if t[0] in SIGNS.get(first, first) and len(t) > (4 if self._weight(t) < 1.5 or not plain else 3)]
        if not plain and sum(1 for c in word if c.isalpha()) < 3:
            return None
        if near:
            return max(near, key=lambda t: (self._weight(t), t)), MISSPELT
        return None


def _spelled(word: str) -> list[str]:
    """Spellings of a word with letters for its signs (two where a sign is read two ways)."""
    out = [""]
    for c in word:
        opts = SIGNS.get(c, c)
        out = [o + x for o in out for x in opts] if len(out) < 16 else [o + opts[0] for o in out]
    return out


# --- windows and their features -----------------------------------------------------------------


@dataclass
class Model:
    """Weights of terms and words, and the seed and learnt terms of the trie."""

    bias: float = BIAS
    weights: dict[str, float] = field(default_factory=dict)
    terms: frozenset[str] = frozenset(KINDS)

    def matcher(self, vocabulary: frozenset[str]) -> Matcher:
        return Matcher(self.terms, [*self.weights, *ADDRESS, *SELF, *INTENT, *OBJECTS, *PEOPLE, *REPORT], vocabulary)

    def weight(self, key: str) -> float:
        w = self.weights.get(key)
        return prior(key) if w is None else w


def prior(key: str) -> float:
    if key in TOGETHER:
        return TOGETHER[key]
    return WEIGHTS[KINDS[key][0]] if key in KINDS else 0.0


_QUOTED = re.compile(r"[\"“„«']([^\"“”„«»']+)[\"”»']")


def features(tokens: list[str], found: list[tuple[str, float] | None], quoted: frozenset[str]) -> dict[str, float]:
    """Key to share of what a window holds: terms and words, and what stands together in it."""
    out: dict[str, float] = {}
    keys = [f[0] if f else "" for f in found]
    here = set(keys)
    addressed = not here.isdisjoint(ADDRESS)
    reported = bool(quoted) and not here.isdisjoint(REPORT)
    group = demeaned = target = hurt = False
    for i, f in enumerate(found):
        if f is None:
            continue
        key, share = f
        kinds = KINDS.get(key)
        if kinds:
            if reported and tokens[i] in quoted:
                share *= QUOTED
            if kinds[0] in ("insult", "mild", "vulgar") and not addressed and not SELF.isdisjoint(keys[max(0, i - 4) : i]):
                share *= ON_SELF
            if share > 0.5:
                group |= "group" in kinds
                demeaned |= "demean" in kinds
                hurt |= kinds[0] in ("insult", "vulgar", "slur", "mild")
                if "threat" in kinds and not OBJECTS.isdisjoint(keys[i + 1 : i + 3]):
                    target = True
        elif key == "people" and i and keys[i - 1] in PEOPLE:
            group = True
        if share > out.get(key, 0.0):
            out[key] = share
        if i and keys[i - 1]:
            out[f"{keys[i - 1]} {key}"] = share
    if hurt and addressed:
        out["+address"] = 1.0
    if group and demeaned:
        out["+group"] = 1.0
    if target:
        out["+target"] = 1.0
        if not here.isdisjoint(INTENT):
            out["+intent"] = 1.0
    return out


def windows(text: str | None):
    """Lists of words of a text that are scored together, each with the words in quotation marks."""
    if not text:
        return
    for reading in _bare(fold(text)):
        for p in _BREAK.split(_joined(reading)):
            if not p:
                continue
            words = _words(p)
            if not words:
                continue
            quoted = frozenset(w for q in _QUOTED.findall(p) for w in q.replace(",", " ").split()) if '"' in p or "“" in p or "«" in p or "„" in p or "'" in p else frozenset()
            for at in range(0, max(1, len(words) - WINDOW // 2), WINDOW // 2):
                yield words[at : at + WINDOW], quoted


class _Hot(dict):
    """Whether a word stands for a key that speaks for abuse."""

    def __init__(self, model: Model, match: Matcher):
        self.model, self.match = model, match

    def __missing__(self, word: str) -> bool:
        if len(self) > 300_000:
            self.clear()
        f = self.match(word)
        out = self[word] = f is not None and self.model.weight(f[0]) > 0
        return out


class Scorer:
    """Scores texts by a model.

    Words of `common` are no misspelt terms. A window in which no word speaks
    for abuse has the model's bias, whatever speaks against it.
    """

    def __init__(self, model: Model, vocabulary: frozenset[str] = frozenset(), common: frozenset[str] = frozenset()):
        self.model, self.common = model, common
        self.match = model.matcher(vocabulary)
        self.hot = _Hot(model, self.match)

    def _sum(self, words: list[str], found: list[tuple[str, float] | None], quoted: frozenset[str]) -> float:
        w = self.model.weight
        return self.model.bias + sum(w(k) * s for k, s in features(words, found, quoted).items())

    def both(self, words: list[str], quoted: frozenset[str] = frozenset(), near: set[str] | None = None) -> tuple[float, float]:
        """Log-odds of a window, and what they were if no plain word stood for a misspelt term."""
        if not any(map(self.hot.__getitem__, words)):
            return self.model.bias, self.model.bias
        found = list(map(self.match, words))
        plain = [f and f[1] < 1 and w.isalpha() for w, f in zip(words, found)]
        if near is not None:
            near.update(w if p else f[0] for w, f, p in zip(words, found, plain) if f and (p or f[0] in self.model.terms))
        if not any(plain):
            z = self._sum(words, found, quoted)
            return z, z
        z = self._sum(words, [None if p and w in self.common else f for w, f, p in zip(words, found, plain)], quoted)
        return z, self._sum(words, [None if p else f for f, p in zip(found, plain)], quoted)

    def log_odds(self, words: list[str], quoted: frozenset[str] = frozenset()) -> float:
        return self.both(words, quoted)[0]

    def scores(self, text: str | None, near: set[str] | None = None) -> tuple[float, float]:
        """The probability that the worst window is abusive, with and without misspelt plain words; null and empty texts score 0."""
        z = [self.both(w, q, near) for w, q in windows(text)]
        if not z:
            return 0.0, 0.0
        return tuple(round(1 / (1 + math.exp(min(50.0, max(-50.0, -max(x))))), 6) for x in zip(*z))

    def __call__(self, text: str | None) -> float:
        return self.scores(text)[0]


_plain = None


def score_text(text: str | None, model: Model | None = None, vocabulary: frozenset[str] | None = None) -> float:
    """The score of one text, by the seed lexicon alone or by a fitted model."""
    global _plain
    words = vocabulary_words(tokenizer_dir()) if vocabulary is None else vocabulary
    if model is not None:
        return Scorer(model, words)(text)
    if _plain is None:
        _plain = Scorer(Model(), words)
    return _plain(text)


# --- fitting ----------------------------------------------------------------------------------------


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labelled documents (labels: doc_id, rater, toxic).

    At most MAX_LABELLED labelled documents of at most MAX_CHARS characters
    are used, chosen by a hash of their id; their windows come to the driver
    as words. Each rater's word counts once per document. A document is taken
    for as bad as its worst window, and ratings for wrong as often as raters
    of one document disagree. Without labels the seed lexicon's weights stay.
    """
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", "rater", "toxic").distinct()
    said = said.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("bad"))
    kept = said.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= MAX_CHARS)).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(kept.withColumn("doc_id", F.col("doc_id").cast("bigint")), "doc_id").select("doc_id", "text", "n", "bad")

    def read(batches):
        for b in batches:
            out: list[list[str]] = []
            for t in b.column("text").to_pylist():
                out.append(["\x1f".join(w) + "\x1e" + "\x1f".join(q) for w, q in windows(t)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), b.column("bad"), pa.array(out, pa.list_(pa.string()))], ["doc_id", "n", "bad", "windows"])

    got = rows.mapInArrow(read, "doc_id bigint, n bigint, bad bigint, windows array<string>").toArrow()
    got = got.sort_by("doc_id")
    texts_ = [[tuple(x.split("\x1f") if x else [] for x in w.split("\x1e")) for w in d] for d in got.column("windows").to_pylist()]
    return fit_windows(texts_, np.asarray(got.column("n"), dtype=float), np.asarray(got.column("bad"), dtype=float), vocabulary_words(tokenizer_dir(docs.sparkSession)))


def _beyond_chance(bad: np.ndarray, docs: np.ndarray, rate: float) -> np.ndarray:
    """Which of many words are in more abusive documents than chance explains, CHANCE of them wrongly (Benjamini and Hochberg)."""
    most = int(docs.max(initial=0))
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, most + 1)))])
    p = np.ones(len(docs))
    for n in np.unique(docs.astype(int)):
        k = np.arange(n + 1)
        each = np.exp(logs[n] - logs[k] - logs[n - k] + k * math.log(rate) + (n - k) * math.log1p(-rate))
        tail = np.cumsum(each[::-1])[::-1]  # of so many or more
        own = docs == n
        p[own] = tail[np.minimum(np.floor(bad[own]).astype(int), n)]
    o = np.argsort(p, kind="stable")
    passed = np.flatnonzero(p[o] <= CHANCE * np.arange(1, len(p) + 1) / len(p))
    out = np.zeros(len(p), bool)
    out[o[: passed[-1] + 1 if len(passed) else 0]] = True
    return out


def _log_odds_at_least(bad: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log-odds of the share of abusive documents, LESS standard deviations below what was seen (Wilson)."""
    n = np.maximum(docs, 1)
    s, z = bad / n, LESS
    low = (s + z * z / (2 * n) - z * np.sqrt(s * (1 - s) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    low = np.clip(low, 1e-6, 1 - 1e-6)
    return np.log(low / (1 - low))


def fit_windows(texts: list, n: np.ndarray, bad: np.ndarray, vocabulary: frozenset[str]) -> Model:
    """texts: per document its windows, (words, quoted words) each; n ratings of it, `bad` of them toxic."""
    if not len(n) or not bad.sum() or bad.sum() == n.sum():
        return Model()
    plain = Matcher(KINDS, [*ADDRESS, *SELF, *INTENT, *OBJECTS, *PEOPLE, *REPORT], vocabulary)
    # words of the model: those in enough documents of the sample, as spelled or with signs for letters
    support: dict[str, int] = {}
    for d in texts:
        for w in {x for words, _ in d for x in words if x.isalpha() and len(x) > 1}:
            support[w] = support.get(w, 0) + 1
    words = {w for w, k in support.items() if k >= SUPPORT}
    both: dict[str, int] = {}
    for d in texts:
        for p in {f"{a} {b}" for w, _ in d for a, b in zip(w, w[1:]) if a in words and b in words}:
            both[p] = both.get(p, 0) + 1
    pairs = {p for p, k in both.items() if k >= SUPPORT}
    match = Matcher(KINDS, words | plain.words, vocabulary)
    index: dict[str, int] = {}
    ids, shares, starts, owner = [], [], [0], []
    for i, d in enumerate(texts):
        for tokens, quoted in d:
            for k, s in features(tokens, [match(t) for t in tokens], frozenset(quoted)).items():
                if " " in k and k not in pairs:
                    continue
                ids.append(index.setdefault(k, len(index)))
                shares.append(s)
            starts.append(len(ids))
            owner.append(i)
    if not ids:
        return Model()
    ids, shares, starts, owner = np.array(ids), np.array(shares), np.array(starts), np.array(owner)
    row = np.repeat(np.arange(len(owner)), np.diff(starts))
    base = np.array([prior(k) for k in index])
    # ratings are wrong with the rate at which raters of one document disagree
    twice = n > 1
    apart = (2 * bad * (n - bad) / np.maximum(n * (n - 1), 1))[twice].mean() if twice.any() else 0.1
    wrong = float(np.clip((1 - math.sqrt(max(0.0, 1 - 2 * apart))) / 2, 0.01, 0.2))
    # to begin with: how much more often a word stands in documents called toxic
    pair = np.unique(np.stack([ids, owner[row]]), axis=1)
    in_docs = np.bincount(pair[0], minlength=len(index))
    in_bad = np.bincount(pair[0], weights=(bad / n)[pair[1]], minlength=len(index))
    rate = (bad / n).mean()
    lift = np.log((in_bad + 2 * rate) / (in_docs + 2)) - np.log(rate)
    seed = np.array([k in KINDS or k in TOGETHER for k in index])
    telling = (lift > 0.5) & (in_bad - rate * in_docs > SURE * np.sqrt(in_docs * rate * (1 - rate)))
    # of very many words some pass by chance, and common ones would mark many documents
    telling &= _beyond_chance(in_bad, in_docs, rate)
    # words whose lift may be chance can only speak against abuse; no word says more than its documents do, or common
    # ones that stand around abuse, such as names of speakers, would mark documents without any
    says = np.maximum(base, _log_odds_at_least(in_bad, in_docs) - math.log(rate / (1 - rate)))
    most = np.where(telling | seed, says, base)
    w = np.minimum(base + np.where(telling, lift, 0), most)
    b = BIAS
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    who = owner[first]
    for _ in range(ROUNDS):
        z = np.bincount(row, weights=w[ids] * shares, minlength=len(owner)) + b
        # the worst window of every document
        order = np.lexsort((-z, owner))
        worst = order[np.searchsorted(owner[order], who)]
        slot = np.full(len(owner), -1)
        slot[worst] = np.arange(len(worst))
        use = slot[row] >= 0
        r, c, s = slot[row[use]], ids[use], shares[use]
        y, m = bad[who], n[who]
        gw, gb = np.full(len(w), 1e-6), 1e-6
        for _ in range(STEPS):
            z = np.bincount(r, weights=w[c] * s, minlength=len(who)) + b
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            q = wrong + (1 - 2 * wrong) * p
            dz = (y / q - (m - y) / (1 - q)) * (1 - 2 * wrong) * p * (1 - p)
            g = np.bincount(c, weights=dz[r] * s, minlength=len(w)) - RIDGE * (w - base)
            h = dz.sum() - RIDGE * (b - BIAS)
            gw += g * g
            gb += h * h
            w = np.minimum(w + 0.3 * g / np.sqrt(gw), most)
            b = min(b + 0.3 * h / math.sqrt(gb), BIAS)
    weights = {k: round(float(w[i]), 4) for k, i in index.items() if abs(w[i] - base[i]) > 0.01}
    learnt = {k for k, x in weights.items() if x >= LEARNT and k.isalpha() and len(k) > 3}
    return Model(round(float(b), 4), weights, frozenset(KINDS) | learnt)


# --- documents ----------------------------------------------------------------------------------

READ = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("text", pa.string()), ("score", pa.float64()), ("near", pa.list_(pa.string()))])


def ordinary_words(read: DataFrame, model: Model, vocabulary: frozenset[str]) -> frozenset[str]:
    """Words one edit from a term that the corpus uses as words of their own."""
    # a row per term or word one edit from it, however large the corpus is
    counts = dict(read.select(F.explode("near").alias("word")).groupBy("word").agg(F.count(F.lit(1))).collect())
    if not any(w not in model.terms for w in counts):
        return frozenset()
    least = max(FEW, read.count() // RARE)
    match = model.matcher(vocabulary)
    return frozenset(w for w, n in counts.items() if w not in model.terms and n > max(least, counts.get((match(w) or (None,))[0], 0)))


def abuse_scores(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, source, score: every document with the score of its worst window.

    Null and empty texts score 0. Repeated rows stay; other columns are
    dropped. Without labels, or with none that tell anything, the seed lexicon decides.
    """
    spark = docs.sparkSession
    model = fit(docs, labels) if labels is not None else Model()
    vocabulary = vocabulary_words(tokenizer_dir(spark))
    shared = spark.sparkContext.broadcast((model, vocabulary))

    def first(batches):
        scorer = Scorer(*shared.value)
        for b in batches:
            scores, words, kept = [], [], []
            for t in b.column("text").to_pylist():
                near: set[str] = set()
                score, without = scorer.scores(t, near)
                # the text stays only where a misspelt plain word makes a difference
                kept.append(t if without != score else None)
                scores.append(score)
                words.append(sorted(near))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(kept, pa.string()), pa.array(scores, pa.float64()), pa.array(words, READ[4].type)], schema=READ)

    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    read = materialize(plain.mapInArrow(first, "doc_id bigint, source string, text string, score double, near array<string>"), "abuse")
    common = ordinary_words(read, model, vocabulary)
    if not common:
        return read.select("doc_id", "source", "score")
    usual = spark.sparkContext.broadcast(common)  # words one edit from a term: a bounded set

    def again(batches):
        scorer = Scorer(*shared.value, common=usual.value)
        for b in batches:
            scores = [
                s if t is None or usual.value.isdisjoint(near) else scorer(t)
                for t, s, near in zip(b.column("text").to_pylist(), b.column("score").to_pylist(), b.column("near").to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array(scores, pa.float64())], ["doc_id", "source", "score"])

    return read.mapInArrow(again, "doc_id bigint, source string, score double")


def abusive(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id of the documents with at least one passage at or above THRESHOLD."""
    return abuse_scores(docs, labels).where((F.col("score") >= THRESHOLD) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def rates(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """source (folded), documents, abusive, rate; documents without source are one row."""
    return rates_of(abuse_scores(docs, labels))


def rates_of(scores: DataFrame) -> DataFrame:
    name = F.lower(F.trim("source"))
    return (
        scores.groupBy(name.alias("source"))
        .agg(F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= THRESHOLD).cast("int")).alias("abusive"))
        .withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
    )
