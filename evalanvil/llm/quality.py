"""Text statistics of documents, and whether a document is prose, a list, a table or junk.

Statistics are computed from whole texts in Arrow batches; those against the corpus from counts over
all documents, added up per task first. Gradient-boosted trees over them, trained
when the query runs on a bounded sample of the corpus, give a probability per kind: prose is weakly
labelled by rules that only clear cases pass; lists, tables and junk are made from the corpus's own
phrases and sentences. A temperature fitted on the hand-checked texts of `holdout` calibrates the
probabilities. One document is one row, so nothing is grouped and no group is hot.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalanvil.llm.answers import _COMMON_SETS, lower_words, word_bucket
from evalanvil.llm.holdout import HOLDOUT
from evalanvil.llm.sampling import hash_share, lowest

KINDS = ("prose", "list", "table", "junk")
#: Bound of the training sample, in documents.
SAMPLE_DOCS = 2500
#: Every second hand-checked text calibrates; the others are for tests only. None is trained on.
CALIBRATION = HOLDOUT[::2]
_COMMON_ANY = frozenset().union(*_COMMON_SETS.values())

_BULLET = re.compile(r"\s*(?:[-*+•–—▪◦·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|#\d+|\[[ xX✓]?\]|[☐☑✓→])\s+\S")
_KEY = re.compile(r"\s*[\w .'/-]{1,40}:\s+\S")
_STOPS, _AFTER_STOP = ".!?。！？…", "\"'”’»)]*_` \t\r\n\x0b\x0c"
_SENTENCE = re.compile(r"[.!?。！？…](?<![.!?。！？…]{2})[.!?。！？…]*+[\"'”’»)\]]*+(?:\s+|\Z)")  # linear: begins at the first of several stops only
_CELL = re.compile(r"\s{2,}")
_RULE = re.compile(r"[\s|+:=_-]+\Z")

STATS = (
    "chars", "words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "lines", "mean_line_length",
    "line_spread", "line_end_share", "bullet_share", "table_share", "key_share", "short_line_share", "wrapped_share",
    "sentence_share", "words_per_sentence", "sentence_lengths", "unique_sentences", "unique_lines", "type_token", "top_word_share",
    "common_share", "common_kinds", "mixed_word_share", "letter_surprise", "known_pair_share", "number_word_share", "plain_line_share",
    "capital_inside", "longest_word", "punctuation_ratio",
)


@dataclass
class Familiar:
    """How surprising letter pairs are, and which word pairs are known, by the counts of a whole corpus."""

    letters: np.ndarray  # -log2 P(b | a) over folded bytes
    pairs: np.ndarray  # bit per hashed word pair
    shown: np.ndarray

    BITS = 20

    @classmethod
    def of(cls, letters: np.ndarray, pairs: np.ndarray) -> "Familiar":
        """From counts of letter pairs, and of the documents that hold a word pair.

        A pair is known if at least two documents hold it, and more than chance puts into a bucket:
        with many documents every bucket holds some pair.
        """
        counts = letters.reshape(64, 64) + 0.5
        chance = pairs.mean()
        shares = -np.log2(counts / counts.sum(axis=1, keepdims=True))
        return cls(shares.astype(np.float32), pairs >= max(2.0, chance + 3 * chance**0.5), np.zeros(0))


def corpus_counts(texts: Iterable[str | None], letters: np.ndarray | None = None, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Letter pairs, and documents by word pair, of whole texts; added to the given counts if there are any."""
    letters = np.zeros(64 * 64, np.int64) if letters is None else letters
    pairs = np.zeros(1 << Familiar.BITS, np.int64) if pairs is None else pairs
    for some in _chunks([t for t in texts if isinstance(t, str) and t]):
        folded, starts = _fold_all(some)
        letters += np.bincount(_letter_pairs(folded), _inside(starts, len(folded)), minlength=64 * 64).astype(np.int64)
        words = [lower_words(t) for t in some]
        found, at = _word_pairs(words)
        for a, b in zip(at, at[1:]):
            pairs[found[a:b]] += 1  # once a document, however often the pair occurs in it
    return letters, pairs


#: Characters that are turned into arrays at a time; a longer text makes a chunk of its own.
CHUNK = 400_000


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about CHUNK characters, so that what numpy holds stays small."""
    run, n = [], 0
    for t in texts:
        if run and n + len(t) > CHUNK:
            yield run
            run, n = [], 0
        run.append(t)
        n += len(t)
    if run:
        yield run


_FOLD = np.full(256, 63, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz"):
    _FOLD[ord(_c)] = _FOLD[ord(_c.upper())] = _i
for _c in "0123456789":
    _FOLD[ord(_c)] = 26
for _i, _c in enumerate(" \n\t.,;:!?'\"()-|/"):
    _FOLD[ord(_c)] = 27 + _i
for _i in range(128, 256):
    _FOLD[_i] = 44 + _i % 16


def _fold_all(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of texts in a row, and where each begins (the end of the last one, too)."""
    parts = [t.encode("utf-8", "replace") for t in texts]
    return _FOLD[np.frombuffer(b"".join(parts), np.uint8)], np.cumsum([0, *map(len, parts)])


def _letter_pairs(folded: np.ndarray) -> np.ndarray:
    return folded[:-1].astype(np.intp) * 64 + folded[1:]


def _inside(starts: np.ndarray, n: int) -> np.ndarray:
    """1 for every pair of neighbours that lies within one text, 0 where one text meets the next."""
    out = np.ones(max(0, n - 1))
    at = starts[1:-1] - 1
    out[at[(at >= 0) & (at < n - 1)]] = 0
    return out


def _word_pairs(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pairs of neighbouring words of texts in a row, and where each text's begin."""
    if len(_hashes) > 300_000:
        _hashes.clear()
    h = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.int64)
    ends = np.cumsum([len(w) for w in words])
    pairs = (h[:-1] * 1_000_003 + h[1:] * 7919) & ((1 << Familiar.BITS) - 1)
    meets = np.zeros(max(0, len(h) - 1), bool)
    at = ends[:-1] - 1
    meets[at[(at >= 0) & (at < len(meets))]] = True
    sizes = np.array([max(0, len(w) - 1) for w in words])
    return pairs[~meets], np.concatenate(([0], np.cumsum(sizes)))


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        h = self[w] = word_bucket("0" if w[:1].isdigit() else w)
        return h


_hashes = _Hashes()


def _separators(line: str) -> tuple[str, int]:
    """The likeliest cell separator of a line and how many cells it makes."""
    best, n = "", 1
    for s in _SEPARATORS:
        if s in line and not (s in ";," and s + " " in line):
            c = line.count(s) + 1
            if c > n:
                best, n = s, c
    if n < 3 and "  " in line:
        c = len(_CELL.split(line.strip()))
        if c > n:
            best, n = " ", c
    return best, n


_SEPARATORS = ("|", "\t", ";", ",")


def document_stats(text: str | None, familiar: Familiar) -> list[float]:
    """STATS of one text; zeros for a null or empty one."""
    return batch_stats([text], familiar)[0].tolist()


def batch_stats(texts: list[str | None], familiar: Familiar) -> np.ndarray:
    """STATS of texts, a row each; zeros for a null or empty one."""
    out = np.zeros((len(texts), len(STATS)))
    at = [i for i, t in enumerate(texts) if t and t.strip()]
    rows = [_of_lines(some, familiar) for some in _chunks([texts[i] for i in at])]
    if rows:
        out[at] = np.concatenate(rows)
    return out


def _characters(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Per text: characters by kind (a row of 8), capitals inside words, mixed words and numbers."""
    n = len(texts)
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "replace"), np.uint32)  # no pattern goes on across the line break
    flags = _FLAGS_OF[raw]
    kind = flags & 7
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    sizes = np.diff(starts)
    sizes[-1] -= 1
    of = np.bincount(np.repeat(np.arange(n) * 8, sizes) + kind, minlength=8 * n).reshape(n, 8)
    text_of = lambda places: np.bincount(np.searchsorted(starts, places, side="right") - 1, minlength=n)
    inside = text_of(np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)))
    return of, inside, text_of(_mixed(flags)), text_of(_numbers(flags, kind))


def _ends(line: str) -> bool:
    """Whether a line ends like a sentence, with or without quotes or brackets after it."""
    t = line.rstrip(_AFTER_STOP)
    return bool(t) and t[-1] in _STOPS


def _of_lines(texts: list[str], familiar: Familiar) -> np.ndarray:
    """STATS of texts that are not blank."""
    of, insides, mixed, numbers = _characters(texts)
    folded, starts = _fold_all(texts)
    within = _inside(starts, len(folded))
    known_letters = np.append(familiar.letters.ravel().take(_letter_pairs(folded)) * within, [0.0, 0.0])
    letter_pairs = np.maximum(np.diff(starts) - 1, 0)
    surprise = np.add.reduceat(known_letters, starts[:-1]) / np.maximum(letter_pairs, 1)
    words_of = [lower_words(t) for t in texts]
    pairs, begins = _word_pairs(words_of)
    known = np.concatenate(([0], np.cumsum(familiar.pairs[pairs])))
    known_share = (known[begins[1:]] - known[begins[:-1]]) / np.maximum(np.diff(begins), 1)
    rows = []
    for i, (text, words) in enumerate(zip(texts, words_of)):
        n, k = len(text), max(1, len(words))
        lines = [x for x in text.split("\n") if x.strip()]
        sizes = [*map(len, lines)]
        total, widest = sum(sizes) or 1, max(sizes)
        letters, symbols = int(of[i, 1] + of[i, 2] + of[i, 6]), int(of[i, 5])
        bullet = table = key = short = wrapped = plain = ended = 0
        cells = [_separators(x) for x in lines]
        for j, x in enumerate(lines):
            size = sizes[j]
            end = _ends(x)
            ended += end
            sep, c = cells[j]
            if c >= 2 or x[0] in "|+":
                near = [cells[m] for m in (j - 1, j + 1) if 0 <= m < len(lines)]
                if c >= 2 and any(s == sep and (m == c or sep in "| " and m >= 2) for s, m in near) or x[0] in "|+" and _RULE.match(x):
                    table += size
                    continue
            if _BULLET.match(x):
                bullet += size
            elif not end and size < 120 and _KEY.match(x):
                key += size
            elif not end:
                following = lines[j + 1].lstrip() if j + 1 < len(lines) else ""
                if following and size > 0.6 * min(widest, 100) and size > 18 and (following[0].islower() or following[0].isalnum()) and widest < 130 and not _BULLET.match(following):
                    wrapped += size
                elif size < 60:
                    plain += size
            if size < 60 and not end:
                short += size
        pieces = [s for s in _SENTENCE.split(text.replace("\n", " ")) if s.strip()]
        counts = [s.count(" ") + 1 for s in pieces]
        in_sentences = sum(len(s) for s, m in zip(pieces, counts) if 4 <= m <= 60)
        if pieces and 4 <= counts[-1] <= 60 and not _ends(text):
            in_sentences -= len(pieces[-1])
        average = sum(counts) / max(1, len(counts))
        spread = max(0.0, sum(m * m for m in counts) / max(1, len(counts)) - average * average) ** 0.5
        distinct = Counter(words)
        common = distinct.keys() & _COMMON_ANY
        tokens = text.split()
        t = max(1, len(tokens))
        typical = total / len(lines)
        line_spread = max(0.0, sum(x * x for x in sizes) / len(lines) - typical * typical) ** 0.5 / typical
        rows.append((
            n, len(words), len("".join(words)) / k, symbols / n, int(of[i, 3]) / n, int(of[i, 2]) / max(1, letters), len(lines), typical,
            line_spread, ended / len(lines), bullet / total, table / total, key / total, short / total, wrapped / total, in_sentences / n,
            average, spread / max(1.0, average), len(set(pieces)) / max(1, len(pieces)), len(set(lines)) / len(lines), len(distinct) / k**0.7,
            max(distinct.values(), default=0) / k, sum(map(distinct.__getitem__, common)) / k, len(common), int(mixed[i]) / t, surprise[i],
            known_share[i], int(numbers[i]) / k, plain / total, int(insides[i]) / t, max(map(len, tokens), default=0), int(of[i, 4]) / n,
        ))
    return np.array(rows, np.float64)


#: Flags beside the kind: part of a word; a symbol that mixes words; what a number may go on with.
_IN_WORD, _MIXES, _GOES_ON = 8, 16, 32


def _flags() -> np.ndarray:
    """Flags of every code point, and its kind: 0 space, 1 and 2 lower and upper letters, 3 digits, 4 plain punctuation, 5 symbols, 6 other letters and their marks."""
    every = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    out = np.full(0x110000, 5 | _MIXES, np.uint8)
    for first in range(0, 0x110000, 256):
        block = every[first : first + 256]
        if block.isalpha() and block.lower() == block.upper():
            out[first : first + 256] = 6 | _IN_WORD | _GOES_ON
        elif first < 0x20000 or _WORD_CHAR.search(block):
            out[first : first + 256] = [_flags_of(ch) for ch in block]
    return out


def _flags_of(ch: str) -> int:
    if ch.isspace():
        return 0
    if ch.isdigit():
        return 3 | _IN_WORD | _GOES_ON
    if ch.isalpha():
        return (1 if ch.islower() else 2 if ch.isupper() else 6) | _IN_WORD | _GOES_ON
    if unicodedata.category(ch) in ("Mn", "Mc") and not "\ufe00" <= ch <= "\ufe0f":  # selectors go with emoji
        return 6 | _IN_WORD | _GOES_ON
    kind = 4 if ch in ".,;:!?'\"()-‘’“”„–—…。，！？、：；（）" else 5
    if ch == "_" or ch.isnumeric():
        return kind | _IN_WORD | _GOES_ON
    return kind | (0 if ch in ".,'’/;:()\"-" else _MIXES) | (_GOES_ON if ch in ".," else 0)


_WORD_CHAR = re.compile(r"\w")
_FLAGS_OF = _flags()


def _mixed(flags: np.ndarray) -> np.ndarray:
    """Places of matches of [word character][symbols][word character], none of which overlap."""
    on = np.flatnonzero(flags & _MIXES)
    if not len(on):
        return on
    gap = np.flatnonzero(np.diff(on) > 1)
    before, after = np.concatenate((on[:1], on[gap + 1])) - 1, np.concatenate((on[gap], on[-1:])) + 1
    word = np.append(flags & _IN_WORD, 0)  # the last is before the first and after the last character
    at = np.flatnonzero((word[before] > 0) & (word[after] > 0))
    if len(at) < 2:
        return after[at] - 1
    begins = np.append(True, before[at[1:]] != after[at[:-1]])  # else it shares a character with the match before
    place = np.arange(len(at))
    return after[at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]] - 1


def _numbers(flags: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Places of numbers that begin where a word may, with the word characters, points and commas that follow."""
    first = np.flatnonzero(kind == 3)
    first = first[(first == 0) | (flags[first - 1] & _IN_WORD == 0)]
    if len(first) < 2:
        return first
    ends = np.searchsorted(np.flatnonzero(flags & _GOES_ON == 0), first)
    return first[np.append(True, ends[1:] != ends[:-1])]


class Trees:
    """Gradient-boosted trees for several kinds (softmax), over binned statistics."""

    BINS, DEPTH = 48, 4

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.rate, self.temperature = 0.3, 1.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 40, seed: int = 3) -> "Trees":
        rng = np.random.default_rng(seed)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.BINS)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        n, m, k = len(b), x.shape[1], len(KINDS)
        margins = np.zeros((n, k))
        onehot = np.eye(k)[y]
        for _ in range(rounds):
            p = np.exp(margins - margins.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            step = []
            rows = np.flatnonzero(rng.random(n) < 0.7)
            drawn = b[rows]
            for c in range(k):
                g, h = (p[rows, c] - onehot[rows, c]), np.maximum(p[rows, c] * (1 - p[rows, c]), 1e-6)
                tree = self._grow(drawn, g, h, rng.random(m) < 0.8)
                step.append(tree)
                margins[:, c] += self.rate * self._leaf(tree, b)
            self.trees.append(step)
        return self

    def _grow(self, b, g, h, use) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(feature, cut, leaf values) of a complete tree; a node that isn't split sends all to the left."""
        inner, bins = (1 << self.DEPTH) - 1, self.BINS + 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
        node, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        used = np.flatnonzero(use)
        place = (b[:, used] + np.arange(len(used)) * bins).ravel()
        gs_of, hs_of = np.repeat(g, len(used)), np.repeat(h, len(used))
        for depth in range(self.DEPTH):
            first, width = (1 << depth) - 1, 1 << depth
            slot = place + np.repeat((node - first) * (len(used) * bins), len(used))
            gs = np.bincount(slot, gs_of, width * len(used) * bins).reshape(width, len(used), bins)
            hs = np.bincount(slot, hs_of, width * len(used) * bins).reshape(width, len(used), bins)
            gl, hl = gs.cumsum(axis=2)[:, :, :-1], hs.cumsum(axis=2)[:, :, :-1]
            gt, ht = gs.sum(axis=2, keepdims=True), hs.sum(axis=2, keepdims=True)
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < 1) | (ht - hl < 1)] = 0
            flat = gain.reshape(width, -1)
            top = flat.argmax(axis=1)
            better = flat[np.arange(width), top] > 1e-3
            feature[first : first + width][better] = used[top[better] // (bins - 1)]
            cut[first : first + width][better] = top[better] % (bins - 1)
            node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        return feature, cut, -gs / (hs + 1)

    def _leaf(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, values = tree
        node = np.zeros(len(b), np.int64)
        at = np.arange(len(b))
        for _ in range(self.DEPTH):
            node = 2 * node + 1 + (b[at, feature[node]] > cut[node])
        return values[node - (1 << self.DEPTH) + 1]

    def margins(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.zeros((len(b), len(KINDS)))
        for step in self.trees:
            for c, tree in enumerate(step):
                out[:, c] += self.rate * self._leaf(tree, b)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        m = self.margins(x) / self.temperature
        p = np.exp(m - m.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of the best log-likelihood on hand-checked texts.

        n texts can't show that fewer than one in n + 2 is wrong, so that much of each label is
        spread over the kinds; the best temperature is then finite and lies inside the grid.
        """
        m = self.margins(x)
        doubt = 1 / (len(y) + 2)
        target = np.eye(len(KINDS))[y] * (1 - doubt) + doubt / len(KINDS)
        best = (np.inf, 1.0)
        for t in np.geomspace(0.05, 20, 121):
            z = m / t - (m / t).max(axis=1, keepdims=True)
            loss = float((np.log(np.exp(z).sum(axis=1)) - (z * target).sum(axis=1)).mean())
            best = min(best, (loss, float(t)))
        self.temperature = best[1]


# ---- weak labels -----------------------------------------------------------------------------------

_AT = {name: i for i, name in enumerate(STATS)}


def clear_prose(s: list[float]) -> bool:
    """Whether statistics are those of a text that is prose beyond doubt."""
    v = lambda name: s[_AT[name]]
    return (
        v("sentence_share") > 0.85 and v("bullet_share") + v("table_share") + v("key_share") < 0.05 and v("unique_sentences") > 0.5
        and v("common_share") > 0.2 and v("symbol_ratio") < 0.03 and v("mixed_word_share") < 0.08 and 5 < v("words_per_sentence") < 45
        and v("top_word_share") < 0.2 and v("common_kinds") >= 4
    )


def _phrases(rng: random.Random, sentences: list[str]) -> list[str]:
    out = []
    for s in sentences:
        w = s.rstrip(".!?").split()
        if len(w) >= 4:
            i = rng.randrange(len(w) - 2)
            out.append(" ".join(w[i : i + rng.randint(1, 5)]).strip(",;:"))
    return [p for p in out if p] or ["item"]


_MARKS = ("- ", "* ", "+ ", "• ", "– ", "[ ] ", "[x] ", "", "")
_MENU = ("Home", "Login", "Sign up", "Contact", "Terms", "Privacy", "Help", "Search", "Next page", "Previous", "Share", "Print", "Download", "Menu", "Settings", "Back to top", "All rights reserved", "Cookie notice", "Subscribe", "Read more")
_NOISE = "#%&~^|<>=+*/\\$@_-!¶¤±Ã�?¸"


def make_list(rng: random.Random, sentences: list[str]) -> str:
    phrases = _phrases(rng, sentences)
    n = rng.randint(5, 40)
    how = rng.randrange(9)
    items = [rng.choice(phrases) for _ in range(n)]
    if rng.random() < 0.25:
        items = [rng.choice(sentences) for _ in range(n)]
    elif rng.random() < 0.3:
        items = [x[:1].upper() + x[1:] for x in items]
    if how < 4:
        m = rng.choice(_MARKS)
        out = [m + x for x in items]
        if not m:
            out = [x.rstrip(".") for x in out if len(x) < 60] or ["one", "two", "three", "four"]
    elif how < 7:
        f = rng.choice(("{}. ", "{}) ", "({}) ", "#{} "))
        out = [f.format(i + 1) + x for i, x in enumerate(items)]
    else:
        words = [w for p in phrases for w in p.split()]
        out = [f"{' '.join(rng.choices(words, k=rng.randint(1, 2)))}: {x}" for x in items]
    return "\n".join(("  " if rng.random() < 0.2 else "") + x for x in out)


def make_table(rng: random.Random, sentences: list[str]) -> str:
    phrases = _phrases(rng, sentences)
    cols, rows = rng.randint(3, 6), rng.randint(4, 30)
    texty = rng.random()

    def cell() -> str:
        x = rng.random()
        return rng.choice(phrases) if x < texty * 0.7 else "" if x > 0.97 else f"{rng.random() * 100:.2f}" if x < 0.8 else str(rng.randint(1, 5000))

    words = [w.strip(".,") for p in phrases for w in p.split()]
    grid = [[rng.choice(words) for _ in range(cols)]] + [[cell() for _ in range(cols)] for _ in range(rows)]
    how = rng.randrange(7)
    if how < 4:
        sep = (",", ";", "\t", " | ")[how]
        return "\n".join(sep.join(r) for r in grid)
    if how == 4:
        return "\n".join("| " + " | ".join(r) + " |" for r in [grid[0], ["---"] * cols, *grid[1:]])
    width = [max(len(r[j]) for r in grid) for j in range(cols)]
    if how == 5:
        return "\n".join("  ".join(r[j].ljust(width[j]) for j in range(cols)).rstrip() for r in grid)
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    return "\n".join([rule, *("| " + " | ".join(r[j].ljust(width[j]) for j in range(cols)) + " |" for r in grid), rule])


def make_junk(rng: random.Random, sentences: list[str]) -> str:
    how = rng.randrange(11)
    some = rng.choices(sentences, k=rng.randint(3, 14))
    n = rng.randint(8, 60)
    if how == 0:
        return " ".join("".join(rng.choices(_NOISE, k=rng.randint(1, 8))) for _ in range(n * 2))
    if how == 1:
        rate = rng.uniform(0.12, 0.4)
        return "".join(rng.choice(_NOISE) if rng.random() < rate else c for c in " ".join(some))
    if how == 2:
        return " ".join("".join(rng.sample(w, len(w))) for w in " ".join(some).split())
    if how == 3:
        return rng.choice((" ", "\n", "  ", " | ", " · ")).join(rng.choices(_MENU, k=n))
    if how == 4:
        return rng.choice((" ", "\n", "\n\n")).join([rng.choice(sentences)] * rng.randint(5, 50))
    if how == 5:
        w = rng.choice([w.strip(".,;:") for w in " ".join(some).split()] + ["test", "loading", "null", "..."])
        return rng.choice((" ", "\n")).join([w] * n * 2)
    if how == 6:
        words = [w.strip(".,;:").lower() for w in " ".join(some).split() if len(w) > 4] or ["word"]
        return " ".join(rng.choices(words[:30], k=n * 2))
    if how == 7:
        words = " ".join(some).split()
        rng.shuffle(words)
        return " ".join(words)
    if how == 8:
        alphabet = rng.choice(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
        return rng.choice(("", "\n")).join("".join(rng.choices(alphabet, k=64)) for _ in range(n))
    if how == 9:
        letters = "abcdefghijklmnopqrstuvwxyz"
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 10))) for _ in range(n * 2))
    return rng.choice(("\n", " ")).join(f"<div class=\"c{rng.randint(1, 9)}\"><a href=\"/{rng.choice(letters_of(some))}\">{rng.choice(_MENU)}</a></div>" for _ in range(n))


def letters_of(sentences: list[str]) -> list[str]:
    return [w.strip(".,").lower() for s in sentences for w in s.split()] or ["x"]


def vary_prose(rng: random.Random, text: str, sentences: list[str]) -> str:
    """Prose that is laid out in another way, or holds a short list, table or code."""
    how = rng.randrange(8)
    if how == 0:
        return text.lower()
    if how in (1, 2):
        width, out, line = rng.randint(48, 96), [], ""
        for w in text.split():
            if len(line) + len(w) > width:
                out.append(line.strip())
                line = ""
            line += " " + w
        return "\n".join([*out, line.strip()])
    if how == 3:
        return f"{rng.choice(('# ', '== ', ''))}{rng.choice(_phrases(rng, sentences))}\n\n{text}"
    if how == 4 and len(text) > 400:
        part = "\n".join(make_list(rng, sentences).split("\n")[:4])
        return text + "\n\n" + part if len(part) < 0.3 * len(text) else text
    if how == 5 and len(text) > 400:
        part = "\n".join(make_table(rng, sentences).split("\n")[:4])
        return text[: len(text) // 2] + "\n\n" + part + "\n\n" + text[len(text) // 2 :] if len(part) < 0.3 * len(text) else text
    if how == 6 and len(sentences) > 2 and rng.random() < 0.5:
        return " ".join(rng.sample(sentences, rng.randint(1, 2)))
    if how == 6:
        return text + rng.choice((f" (n = {rng.randint(2, 90)}, i.e. 0.{rng.randint(100, 999)})", f" See f({rng.randint(1, 30)}, {rng.randint(1, 30)}) = {rng.random():.2f}.", f" That is {rng.random() * 100:.1f} %."))
    return f"{text}\n\n`{rng.choice(letters_of(sentences))}_{rng.randint(1, 9)} --n={rng.randint(1, 99)}`"


#: Prose that training always has, so that a corpus without any still gives a model.
BASE_PROSE = (
    "The boat left before sunrise, and by noon the island was only a thin line behind us. Nobody spoke much. We had food for three days and a map that was older than the captain.",
    "When you mix flour and water, two proteins in the flour join and form a net. That net is what makes dough stretch. If you knead it, the strands line up and the dough becomes smooth.",
    "My grandmother never wrote her recipes down. She measured with her hands and judged an oven by the sound it made, and when we asked how long something had to bake, she said that we would smell it.",
    "Most people think that deserts are hot. Some are, but the largest of them lies in the south and is covered by ice. What makes a desert is the lack of rain, not the heat.",
    "The committee met again on Tuesday. It could not agree on a date, because half of its members were away in June and the others in July, so the decision was put off until autumn.",
    "Der Laden an der Ecke hat seit gestern geschlossen. Die Besitzerin ist in den Süden gezogen, weil ihr das Wetter hier nicht bekam, und einen Nachfolger hat sie nicht gefunden.",
    "Als wir ankamen, war das Tor schon zu. Wir gingen einmal um die Mauer herum und fanden auf der anderen Seite eine kleine Tür, die nicht abgeschlossen war.",
    "Wer einen Garten anlegt, muss vor allem warten können. Im ersten Jahr sieht man wenig, im zweiten etwas mehr, und erst im dritten stehen die Stauden so dicht, dass kein Unkraut mehr durchkommt.",
    "Le musée ouvre à dix heures, mais il vaut mieux arriver plus tôt. La queue est longue dès le matin, et la salle des cartes, qui est la plus belle, ferme à midi.",
    "Quand il pleuvait, nous restions dans la grange et mon oncle racontait des histoires de la guerre. Il en changeait la fin à chaque fois, si bien que personne n'a jamais su laquelle était vraie.",
    "El tren sale del pueblo a las seis y llega a la costa cuando todavía es de noche. Los pescadores ya están en el muelle, y quien quiera comprar algo bueno tiene que darse prisa.",
    "Mi padre decía que una casa se conoce por la cocina. La nuestra era pequeña y siempre estaba llena de gente, aunque casi nadie tenía la costumbre de avisar antes de venir.",
)


@dataclass
class QualityModel:
    familiar: Familiar
    trees: Trees

    @classmethod
    def fit(cls, texts: list[str], seed: int = 5, familiar: Familiar | None = None) -> "QualityModel":
        """Trees trained on a sample; familiar: of the corpus that it is from, else of the sample itself."""
        rng = random.Random(seed)
        texts = [*BASE_PROSE, *(t for t in texts if t and t.strip())]
        blind = Familiar(np.zeros((64, 64), np.float32), np.zeros(1 << Familiar.BITS, bool), np.zeros(0))
        prose = [t for t, x in zip(texts, batch_stats(texts, blind)) if clear_prose(x.tolist())]
        familiar = familiar or Familiar.of(*corpus_counts(texts))
        made: list[tuple[str, int]] = []

        def add(text: str, kind: int) -> None:
            made.append((text, kind))

        bank = [s.strip() for t in rng.sample(prose, min(len(prose), 400)) for s in re.split(r"(?<=[.!?])\s+", t.replace("\n", " ")) if 3 < s.count(" ") < 40]
        for t in prose:
            sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+", t.replace("\n", " ")) if s.count(" ") > 2] or bank
            add(t, 0)
            add(vary_prose(rng, t, sentences), 0)
            pool = sentences if len(sentences) > 12 else sentences + rng.sample(bank, min(len(bank), 25))
            intro = lambda s: f"{rng.choice(bank)}\n\n{s}" if rng.random() < 0.4 and len(s) > 130 else s
            add(intro(make_list(rng, pool)), 1)
            add(intro(make_table(rng, pool)), 2)
            add(make_junk(rng, pool), 3)
            if rng.random() < 0.3:
                add(make_junk(rng, pool), 3)
        x, y = batch_stats([t for t, _ in made], familiar), np.array([k for _, k in made])
        again = np.random.default_rng(seed)
        drawn = np.flatnonzero(again.random(len(x)) < 0.4)
        moved = x[drawn]  # the same texts as if they came from elsewhere
        moved[:, _AT["known_pair_share"]] = 0.1 * again.random(len(moved))
        moved[:, _AT["letter_surprise"]] += again.uniform(0.0, 1.2, len(moved))
        moved[:, _AT["type_token"]] *= again.uniform(0.9, 1.5, len(moved))
        trees = Trees().fit(np.concatenate((x, moved)), np.concatenate((y, y[drawn])))
        trees.calibrate(batch_stats([t for t, _ in CALIBRATION], familiar), np.array([KINDS.index(k) for _, k in CALIBRATION]))
        return cls(familiar, trees)


def sample_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_DOCS) -> list[str]:
    """A reproducible sample of texts, bounded in rows and bytes: the rows with the lowest hashes of their ids."""
    picked = documents.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h"))
    some = picked.where(hash_share(documents, F.col("h"), rows))
    return [r["t"] for r in sorted(lowest(some, ["h", "t"], ["t"], rows).collect(), key=lambda r: (r["h"], r["t"]))]


#: Counts of one row of `familiar_of`.
_BLOCK = 1 << 14


def familiar_of(documents: DataFrame, text_col: str = "text") -> Familiar:
    """Familiar of all documents and whole texts.

    A task adds up its texts' counts and hands on blocks of them; blocks are added up where they
    meet, so the driver gets 8 MB whatever the number of documents.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters, pairs = corpus_counts(())
        for pdf in batches:
            corpus_counts(pdf["text"], letters, pairs)
        for i, part in enumerate([letters, *pairs.reshape(-1, _BLOCK)]):
            if part.any():
                yield pd.DataFrame({"block": [i], "counts": [part.tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for i, c in zip(pdf["block"], pdf["counts"]):
                sums[i] = sums.get(i, 0) + np.frombuffer(c, np.int64)
        for i, part in sums.items():
            yield pd.DataFrame({"block": [i], "counts": [part.tobytes()]})

    schema = "block int, counts binary"
    blocks = documents.select(F.col(text_col).alias("text")).mapInPandas(count, schema).repartition("block").mapInPandas(add, schema)
    letters, pairs = corpus_counts(())
    for r in blocks.collect():
        part = letters if r["block"] == 0 else pairs[(r["block"] - 1) * _BLOCK : r["block"] * _BLOCK]
        part += np.frombuffer(r["counts"], np.int64)
    return Familiar.of(letters, pairs)


def judge(documents: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, STATS..., kind, probability) of every document.

    A null, empty or blank text has zeros everywhere and is junk with probability 1. Whole texts are read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded: trees and 2**20 word pairs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            x = batch_stats(texts, m.familiar)
            p = m.trees.probabilities(x) if len(x) else np.zeros((0, len(KINDS)))
            p[x[:, 0] == 0] = (0, 0, 0, 1)
            out = pd.DataFrame({"doc_id": pdf["doc_id"]} | {name: x[:, j] for j, name in enumerate(STATS)})
            top = p.argmax(axis=1)
            out["kind"] = [KINDS[i] for i in top]
            out["probability"] = p[np.arange(len(p)), top]
            yield out

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATS) + ", kind string, probability double"
    return documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)
