"""Reading a completion: reasoning, answer, language and how the text ends.

Plain Python on one text at a time, shared by the operators that score texts in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

BUCKET_BITS = 18


def word_bucket(token: str) -> int:
    """A token's place among 2**BUCKET_BITS, the same on every machine."""
    return zlib.crc32(token.encode("utf-8", "replace")) & ((1 << BUCKET_BITS) - 1)


# The markers of reasoning, as they occur in completions.
_PAIR = re.compile(r"<think>.*?</think>|\[THINK\].*?\[/THINK\]", re.I | re.S)
_CLOSER = re.compile(r"</think>|\[/THINK\]", re.I)
_CLOSERS_IN_ORDER = (re.compile(r"</think>", re.I), re.compile(r"\[/THINK\]", re.I))
_OPENER = re.compile(r"<think>|\[THINK\]", re.I)
_FINAL = re.compile(r"(?:<\|start\|>)?assistant(?:<\|channel\|>)?final(?:<\|message\|>)?")
_ANALYSIS = re.compile(r"\s*(?:<\|channel\|>)?analysis(?:<\|message\|>)?(?=[^\sa-z])")
_END = re.compile(r"(?:<\|end\|>|<\|return\|>)\s*\Z")

#: Characters that no reader sees.
_HIDDEN = r"\s\u200b-\u200f\u2060\ufeff\u00ad"
#: What can be read: a letter or digit, or a symbol above the punctuation of Latin scripts (an emoji, say).
_READABLE = re.compile(rf"[^\W_]|[^\x00-\u2000{_HIDDEN}]")
_EMPTY_FENCE = re.compile(rf"[{_HIDDEN}]*```[\w+-]*[{_HIDDEN}]*(?:```[{_HIDDEN}]*)?\Z")

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_BREAKS = str.maketrans(dict.fromkeys("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘…–—•·。，！？、：；（）", " ") | {"’": "'"})
#: The same in two steps, faster for a text that isn't ASCII: what lies above ASCII, and a table of bytes.
_HIGH_BREAKS = [(chr(c), to) for c, to in _BREAKS.items() if c > 127]
_LOW_BREAKS = bytes(ord(_BREAKS.get(c, chr(c))) if c < 128 else c for c in range(256))


def lower_words(text: str) -> list[str]:
    """The words of a text in lower case; an apostrophe inside a word belongs to it."""
    text = text.lower()
    if text.isascii():
        return text.translate(_BREAKS).split()
    for c, to in _HIGH_BREAKS:
        if c in text:
            text = text.replace(c, to)
    return text.encode("utf-8", "surrogatepass").translate(_LOW_BREAKS).decode("utf-8", "surrogatepass").split()


def split_reasoning(text: str) -> tuple[str, bool]:
    """(answer, unfinished): what is left without reasoning, and whether reasoning never ended."""
    unfinished = False
    low = text.lower() if "<" in text or "[" in text else ""
    if "think" in low:
        end = max((m.end() for m in _CLOSER.finditer(text)), default=0)
        if end:  # pairs end at a closer: many openers without one cost no repeated scans
            text = _PAIR.sub("", text[:end]) + text[end:]
        for closer in _CLOSERS_IN_ORDER:  # the second kind counts only where the first doesn't occur
            m = closer.search(text)
            if m:
                text = text[m.end() :]
                break
        m = _OPENER.search(text)
        if m:
            text, unfinished = text[: m.start()], True
    m = _FINAL.search(text) if "assistant" in text else None
    if m:
        text = text[m.end() :]
    elif "analysis" in text and _ANALYSIS.match(text):
        unfinished = True
    if text.endswith(("|>", "|>\n")):
        text = _END.sub("", text)
    return text, unfinished


def is_blank(answer: str) -> bool:
    """Whether nothing in the answer can be read: white space, invisible characters, marks alone, an empty code block.

    One rule for any length; both patterns take linear time.
    """
    if answer[:1].isalnum():
        return False
    return not _READABLE.search(answer) or bool(_EMPTY_FENCE.match(answer))


#: Common words by language. Texts are told apart by these and by what is learned from texts that they settle.
COMMON = {
    "en": "the of and is are was were be to in that this it for with as at by on from not which they have has had will can so an or if then there their its you we he she what when who how than about into only over does did but would could should all any some more most other after before because while where these those his her my your our",
    "de": "der die das und ist sind war nicht ein eine einen einem den dem des mit für auf sich es sie dass wir von zu im am aus bei nach wie wenn auch noch nur oder aber sie ihn ihr wird werden hat haben man kein vom zum zur durch gegen ohne unter zwischen weil damit dann dort alle alles mehr muss kann können wurde worden diese dieser dieses ihre seine",
    "fr": "le la les des et est sont une pour que dans sur pas il elle ce qui avec du au aux en ne se un mais ou où donc plus par leur cette ces ont être était c'est d'abord l'eau quand nous vous ils même sans sous entre très aussi si bien tout tous toute toutes leurs sa ses cet peut fait d'une d'un qu'il qu'elle qu'un après",
    "es": "el los las y es son una para que en por con no se del lo al su sus un pero como más ha han está este esta cuando todavía hay muy ya entre sobre sin también fue ser tiene tienen puede pueden donde desde hasta porque cada todo toda todos todas otro otra nos ese esa eso después",
    "it": "il gli e è sono una per che non si della del dei delle nel nella lo con da un ma come più ha hanno questo questa quando ancora ci di anche molti era alla al tra fra chi dal dalla dai nei sul sulla degli ai cui dove quale tutto tutti tutte ogni perché poi senza può possono loro suo sua",
    "pt": "o os as e é são uma para que não em por com se do da dos das no na um mas como mais foi ao ainda quando há muito já entre sobre sem também ser isso à às aos pela pelo ele ela eles seu sua seus suas tem têm pode podem onde desde até porque cada tudo todos todas outro outra lhe fica nem depois",
    "nl": "de het een en is zijn van voor niet dat met op te aan in er ook maar om als dan nog bij naar deze die wordt hebben heeft was wel geen over uit ik hij zij wij dit daar wat wie hoe alle veel meer moet kan kunnen worden werd omdat zonder tussen",
}
_COMMON_SETS = {k: frozenset(v.split()) for k, v in COMMON.items()}

#: Names of languages, as prompts ask for them in the languages they are written in.
NAMED = {
    "english": "en", "englisch": "en", "anglais": "en", "inglés": "en", "ingles": "en", "inglese": "en",
    "german": "de", "deutsch": "de", "allemand": "de", "alemán": "de", "aleman": "de", "tedesco": "de",
    "french": "fr", "französisch": "fr", "français": "fr", "francés": "fr", "frances": "fr", "francese": "fr",
    "spanish": "es", "spanisch": "es", "espagnol": "es", "español": "es", "castellano": "es", "spagnolo": "es",
    "italian": "it", "italienisch": "it", "italien": "it", "italiano": "it",
    "portuguese": "pt", "portugiesisch": "pt", "portugais": "pt", "portugués": "pt",
    "dutch": "nl", "niederländisch": "nl", "néerlandais": "nl", "neerlandés": "nl", "holländisch": "nl",
    "chinese": "zh", "chinesisch": "zh", "chinois": "zh", "chino": "zh", "mandarin": "zh",
    "japanese": "ja", "japanisch": "ja", "japonais": "ja", "japonés": "ja",
    "russian": "ru", "russisch": "ru", "russe": "ru", "ruso": "ru",
}
_SCRIPTS = (
    ("ja", re.compile("[぀-ヿ]")),
    ("zh", re.compile("[一-鿿]")),
    ("ru", re.compile("[Ѐ-ӿ]")),
    ("ar", re.compile("[؀-ۿ]")),
    ("el", re.compile("[Ͱ-Ͽ]")),
    ("ko", re.compile("[가-힯]")),
    ("hi", re.compile("[ऀ-ॿ]")),
)
_OTHER_SCRIPT = re.compile("[Ͱ-Ͽ\u0400-\u04ff\u0600-\u06ff\u0900-\u097f\u3040-\u30ff\u4e00-\u9fff\uac00-\ud7af]")
LANGS = tuple(COMMON)


def script_of(text: str) -> tuple[str, float]:
    """A non-Latin script's language and its share of the letters ('' and 0 if there is none)."""
    if text.isascii() or not _OTHER_SCRIPT.search(text):
        return "", 0.0
    for lang, pattern in _SCRIPTS:
        n = len(pattern.findall(text))
        if n:
            latin = sum(c.isalpha() and c < "ɐ" for c in text)
            return lang, n / max(1, n + latin / 3)
    return "", 0.0


class Languages:
    """Scores words for languages: common words, and words learned from texts that these settle."""

    def __init__(self, learned: dict[str, tuple[float, ...]] | None = None):
        votes: dict[str, list[float]] = {}
        for i, lang in enumerate(LANGS):
            for word in _COMMON_SETS[lang]:
                votes.setdefault(word, [0.0] * len(LANGS))[i] = 1.0
        for word, v in votes.items():
            n = sum(v)
            votes[word] = [x / n for x in v]
        for word, weights in (learned or {}).items():
            votes[word] = list(weights)
        self.votes = {w: tuple(v) for w, v in votes.items()}
        self._by_bucket: np.ndarray | None = None

    def batch_scores(self, words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """scores() of many texts at once, given as hashed words (see word_bucket); the last column is the number of words that voted."""
        if self._by_bucket is None:
            table = np.zeros((1 << BUCKET_BITS, len(LANGS) + 1), np.float32)
            for word, v in self.votes.items():
                table[word_bucket(word)] = (*v, 1.0)
            self._by_bucket = table
        out = np.zeros((len(sizes), len(LANGS) + 1), np.float32)
        if len(words):
            some = sizes > 0
            out[some] = np.add.reduceat(self._by_bucket[words], (np.cumsum(sizes) - sizes)[some], axis=0)
        out[:, :-1] /= out[:, -1:] + 1
        return out

    @classmethod
    def fit(cls, texts: list[list[str]], least: int = 3) -> "Languages":
        """Learns words from texts (lists of lower-case words) whose language the common words settle."""
        first, counts = cls(), [Counter() for _ in LANGS]
        for words in texts:
            s = first.scores(words)
            order = sorted(range(len(LANGS)), key=lambda i: -s[i])
            if len(words) >= 5 and s[order[0]] > 0.12 and s[order[0]] > 1.8 * s[order[1]]:
                counts[order[0]].update(set(words))
        totals = [sum(c.values()) + 1 for c in counts]
        held_back = max(5_000, sum(totals) // 100)  # a few texts in a mixture must not give a seldom language the words of another
        learned = {}
        for word in sorted(set().union(*counts)):
            n = [c[word] for c in counts]
            if sum(n) >= least and not word[0].isdigit() and len(word) > 1:
                rate = [x / (t + held_back) if t > 50 else 0.0 for x, t in zip(n, totals)]
                total = sum(rate)
                if total > 0:
                    learned[word] = tuple(r / total for r in rate)
        return cls(learned)

    def scores(self, words: list[str]) -> list[float]:
        """Mean vote of the words for each of LANGS."""
        total, votes, n = [0.0] * len(LANGS), self.votes, 0
        for word in words:
            v = votes.get(word)
            if v is not None:
                n += 1
                for i, x in enumerate(v):
                    if x:
                        total[i] += x
        return [x / (n + 1) for x in total]

    def of(self, words: list[str], text: str) -> str:
        """The language of a text, '' if nothing settles it."""
        script, share = script_of(text)
        if share > 0.5:
            return script
        s = self.scores(words)
        best = max(range(len(LANGS)), key=s.__getitem__)
        return LANGS[best] if s[best] >= 0.3 else ""


#: What may end a text.
TERMINAL = frozenset(".!?。！？…")
CLOSERS = "\"'”’»)]}*_`> \t\r\n​"
_BULLET = re.compile(r"\s*(?:[-*+•–]|\(?\d{1,3}[.)]|#\d+|\[[ xX]?\]|[a-zA-Z][.)])\s+")
#: A short last segment that gives a value: an option's letter or a boxed value; or a number.
_VALUE = re.compile(r"(?:(?<![^\W_])\(?[A-J]\)?|\\(?:boxed|fbox|framebox)\{[^{}]*\})\W{0,4}\Z|[:=]\s*\**[-+]?[\d.,]+ ?%?\W{0,4}\Z")
_NUMBER = re.compile(r"[-+]?\d[\d.,]* ?%?\W{0,4}\Z")
_BROKEN = re.compile(r"(?:�|\\u?[0-9a-fA-F]{0,3}|&#?\w{1,6}|%[0-9a-fA-F]?|\ud83d|\xc3)\Z")
_KEYLINE = re.compile(r"\s*(?:- )?\"?[\w ]{1,24}\"?:(?:\s|\Z)")
_FACE = re.compile(r"[:;]-?[)(DPp]\Z")
#: Words of a last segment that gives a value, at most; a line of more words is no title.
VALUE_WORDS, TITLE_WORDS = 10, 12


def _ends_well(s: str) -> bool:
    if s[-1] in ")(DPp":
        s = s[: m.start()] if (m := _FACE.search(s, max(0, len(s) - 3))) else s
    t = s.rstrip(CLOSERS)
    if s[-1] in ")]" and t and t[-1] not in TERMINAL:  # a remark in brackets after a sentence
        at = s.rfind("[" if s[-1] == "]" else "(")
        before = s[:at].rstrip(CLOSERS) if at > 0 else ""
        return bool(before) and before[-1] in TERMINAL
    return bool(t) and (t[-1] in TERMINAL or ord(t[-1]) > 0x2600 and not ("぀" <= t[-1] <= "鿿" or t[-1] == "�"))


def _last_segment(line: str) -> str | None:
    """What follows the last sentence that ends inside a line; None if that is more words than a value has."""
    tokens = line.rsplit(None, VALUE_WORDS + 2)
    for k in range(len(tokens) - 1, 0, -1):
        t = tokens[k - 1].rstrip(CLOSERS + "([{<-—–:;,/|=+~^%#&@\\$")
        if t and t[-1] in TERMINAL:
            return " ".join(tokens[k:])
    return line if len(tokens) <= VALUE_WORDS + 2 else None


def ending(answer: str) -> dict:
    """How a text ends: its form, what is left open, whether it ends like a sentence, and its last words."""
    s = answer.rstrip().rstrip("​﻿")
    if not s:
        return {"form": "none", "open": "", "stop": False, "last": [], "title": False, "broken": False, "formula": 0, "mark": ""}
    head = s.lstrip()[:12]
    left = ""
    body = s
    fenced = s.count("```")
    closed = s[-1] == "`" and (fenced % 2 == 0 and s.endswith("```") if fenced else s[s.rfind("\n") + 1 :].count("`") % 2 == 0)
    if fenced % 2:
        left = "fence"
    if fenced:
        m = re.search(r"```[\w+-]*\n?", s)
        body = s[m.end() :]
        if fenced % 2 == 0:
            body = body[: body.rfind("```")]
        body = body.strip()
        head = body[:12]
    else:
        first, _, rest = s.lstrip().partition("\n")
        if first.endswith(":"):  # a line that announces what follows
            body = rest.strip() or body
            head = body[:12]
    if head[:1] in "{[" and (head[:2] != "[ " and head[:3] not in ("[x]", "[ ]") and ('"' in head or "\n" in head or head[:2] in ("[{", "{}", "[]"))):
        form = "json"
        depth = body.count("{") - body.count("}") + body.count("[") - body.count("]")
        if depth > 0 or body[-1:] not in "}]":
            left = left or "json"
    elif head[:1] == "<" and re.match(r"<[A-Za-z!?]", head):
        form = "xml"
        if body[-1:] != ">" or len(re.findall(r"<[A-Za-z]", body)) > body.count("</") + body.count("/>") + 1 + body.count("<?"):
            left = left or "xml"
    else:
        lines = [x for x in body.split("\n") if x.strip()] if "\n" in body else [body]
        final = lines[-1] if lines else ""
        if len(lines) > 1 and _KEYLINE.match(lines[0]) and _KEYLINE.match(final if ":" in final else lines[-2]) and _KEYLINE.match(lines[1]):
            form = "yaml"
            keys = [(_x.strip(" -").split(":")[0]) for _x in lines]
            n = next((i for i, k in enumerate(keys[1:], 1) if k == keys[0]), len(keys))
            if n < len(keys) and len(keys) % n or ":" not in final:
                left = left or "yaml"
        elif len(lines) > 1 and "," in lines[0] and " " not in lines[0] and lines[0].count(",") >= 2:
            form = "csv"
            if final.count('"') % 2 or final.count(",") < lines[0].count(","):
                left = left or "csv"
        elif _BULLET.match(final):
            form = "list" if sum(bool(_BULLET.match(x)) for x in lines) * 2 > len(lines) else "item"
            before = [x for x in lines[:-1] if _BULLET.match(x)]
            if form == "list" and before and 2 * sum(_ends_well(x.rstrip()) for x in before) < len(before):
                form = "bare list"  # its items have no ends
            if not _BULLET.sub("", final, count=1).strip() or re.fullmatch(r"\W*\d*\W*", final):
                left = left or "item"
        else:
            if re.fullmatch(r"\s*(?:[-*+•–#]|\(?\d{1,3}[.)]?)\s*", final) and len(lines) > 1:
                left = left or "item"
            form = "prose"
            if len(lines) > 2 and not any(_ends_well(x.rstrip()) for x in lines[:-1]) and max(x.count(" ") for x in lines) < 6:
                form = "lines"  # one short thing a line
    words = WORD.findall(" ".join(s.rsplit(None, 4)[-4:]))[-3:]
    last_line = s[s.rfind("\n") + 1 :]
    title = False
    if len(last_line.split(None, TITLE_WORDS)) <= TITLE_WORDS:
        shown = WORD.findall(last_line)
        before = s[: -len(last_line)].rstrip()
        title = 0 < len(shown) <= TITLE_WORDS and all(w[0].isupper() or w[0].isdigit() for w in shown) and (not before or before[-1] in ".!?:\"'”»)]")
    segment = _last_segment(last_line)
    formula = 0
    if segment is not None:
        n = len(WORD.findall(segment))
        if n <= VALUE_WORDS and _VALUE.search(segment):
            formula = 1
        elif n <= 8 and _NUMBER.search(segment):
            formula = 1 if len(s.split(None, 2)) <= 2 else 2
    return {
        "form": form,
        "open": left,
        "stop": not left if form in ("json", "xml") else closed or _ends_well(s),
        "last": words,
        "title": title,
        "broken": bool(_BROKEN.search(s)) and not s.endswith(("\\)", "\\]")),
        "formula": formula,
        "mark": s[-1] if not s[-1].isalnum() else "",
    }
