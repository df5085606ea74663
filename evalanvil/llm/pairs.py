"""Broken prompt and answer pairs, by a multi-label linear classifier.

Features are hashed word n-grams of the answer, hashed words of its end, and binned measures of the
pair (how much of the prompt is given back, what else is there, whether the answer's language is one
the prompt is written in or asks for, what is left open). The classifier is trained when the query
runs, on a bounded sample of the data's own pairs and on copies of them that were cut, given back,
swapped with another language or refused; thresholds are calibrated on a part kept out. It then
scores every pair in Arrow batches; a pair is one row, so nothing is grouped and no group is hot.
"""

from __future__ import annotations

import json
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalanvil.llm.answers import (
    BUCKET_BITS,
    NAMED,
    LANGS,
    Languages,
    ending,
    is_blank,
    lower_words,
    script_of,
    split_reasoning,
    word_bucket,
)

from evalanvil.llm.sampling import hash_share, lowest

LABELS = ("empty", "truncated", "refusal", "copy", "language")
#: Whether the words of an answer speak for a label: what is a copy or the wrong language only the prompt can tell.
BY_WORDS = np.array([1, 1, 1, 0, 0], np.float32)
#: Bound of the training sample, in pairs of the data; the rest of the training set is made from them.
SAMPLE_ROWS = 8000
BITS = BUCKET_BITS
MASK = (1 << BITS) - 1
#: Weight of the data's own pairs in the first rounds, which are to find the broken ones among them: a defect that
#: many pairs share must not pass for sound by its number.
OWN_SHARE = 0.25
#: What F1 is known to on the pairs that calibration has.
NOISE = 0.005

#: Ways to refuse, as openings, statements and endings that combine; training data for the refused class.
REFUSALS = {
    "en": (
        ("", "", "Sorry, ", "I'm sorry, but ", "Unfortunately, ", "I apologise, but ", "I apologize, but ", "With regret, ", "Thank you for asking, however ", "I appreciate the question, but ", "As an assistant, ", "As an AI, ", "After some thought, ", "Thanks, but ", "I understand, but "),
        ("I can't help with that", "I cannot help with this request", "I am not able to answer this", "I am unable to answer", "I won't be able to complete this task", "I must decline to respond to this request", "I have to decline", "I refuse to answer", "I will not do that", "I choose not to engage with this prompt", "I do not feel comfortable producing this", "I'd rather not provide an answer here", "I have to pass on this one", "my guidelines do not let me respond", "my policy does not allow this", "this request goes against the rules I work under", "that topic is off limits for me", "this is not something I can assist with", "my answer has to be no", "no answer will be provided by me", "you will have to look for this elsewhere", "this is where I have to stop", "that is something I have to leave unanswered", "I can not comply with this", "not able to comply", "request declined", "I decline", "I cannot fulfil that request", "I won't write this", "I'm afraid I can't do that", "I am not allowed to discuss this", "I don't want to answer this", "I would rather we talked about something else", "I have chosen not to answer", "I shouldn't respond to that", "there is nothing I can say about this", "I'll skip this one"),
        ("", "", "", " at this time", ", as it could be misused", " because it falls outside what I am allowed to discuss", " for safety reasons"),
        ("", "", "", " I hope you understand.", " Please ask me something else.", " If you have a different question, I would be glad to look at it.", " You may want to consult a qualified expert instead.", " I would be happy to talk about another subject.", " Requests like this need more context than I have, and a wrong answer might cause harm.", " My role is limited, and this goes beyond it."),
    ),
    "de": (
        ("", "", "Es tut mir leid, aber ", "Entschuldigung, aber ", "Leider ", "Vielen Dank, aber "),
        ("dabei kann ich nicht helfen", "ich kann diese Frage nicht beantworten", "ich darf diese Frage nicht beantworten", "ich muss diese Bitte ablehnen", "meine Antwort ist nein", "dazu möchte ich nichts schreiben", "diese Aufgabe kann ich nicht übernehmen", "darüber darf ich nicht sprechen", "ich lehne das ab", "ich weigere mich zu antworten", "ich kann dazu nichts sagen", "darauf gehe ich nicht ein", "hierzu gebe ich keine Auskunft", "das ist mehr, als ich tun darf"),
        ("", "", ", weil meine Vorgaben das nicht zulassen", ", weil meine Richtlinien das verbieten"),
        ("", "", " Bitte stellen Sie eine andere Frage.", " Ich hoffe auf Ihr Verständnis."),
    ),
    "fr": (
        ("", "", "Je suis désolé, mais ", "Désolé, ", "Pardon, ", "Malheureusement, ", "Merci, mais "),
        ("je ne peux pas aider avec cela", "je ne peux pas répondre à cette question", "je ne suis pas en mesure de répondre", "je dois refuser cette demande", "ma réponse est non", "je préfère ne rien écrire à ce sujet", "cette tâche dépasse ce que je peux faire", "je refuse de répondre", "je n'ai pas le droit d'en parler", "je ne souhaite pas répondre", "je préfère m'abstenir", "cette demande est contraire à mes règles", "il ne m'est pas possible de vous aider"),
        ("", "", ", car mes consignes ne le permettent pas", ", car mes règles l'interdisent"),
        ("", "", " Merci de poser une autre question.", " J'espère que vous comprenez."),
    ),
    "es": (
        ("", "", "Lo siento, pero ", "Perdón, ", "Por desgracia, ", "Lamentablemente, ", "Gracias, pero "),
        ("no puedo ayudar con eso", "no puedo responder a esta pregunta", "no estoy en condiciones de responder", "debo rechazar esta petición", "mi respuesta es no", "prefiero no escribir sobre esto", "esta tarea queda fuera de lo que puedo hacer", "me niego a responder", "no se me permite hablar de esto", "no voy a responder", "prefiero no contestar", "no puedo atender esta solicitud", "esa petición va contra mis normas"),
        ("", "", ", porque mis normas no lo permiten", ", porque mis reglas lo prohíben"),
        ("", "", " Por favor, haga otra pregunta.", " Espero que lo entienda."),
    ),
}
#: Words of a speaker who speaks of themself or of not doing, by which refusals in unknown words are found.
SPEAKER = frozenset(
    "i i'm i'd i'll i've me my myself ich mir mich mein meine meinen je j' j'ai me ma mon mes moi yo mi mis me conmigo".split()
)
DECLINING = frozenset(
    "can't cannot unable won't decline declined declines refuse refuses refused unanswered elsewhere comply limits allowed sorry apologise apologize guidelines policy rules assist "
    "ablehnen lehne weigere nicht darf vorgaben richtlinien leid refuser refuse peux désolé consignes rechazar niego puedo siento normas rehúso lamento pass stop comfortable engage don't shouldn't rather impossible impossibile imposible abstenir prefiero".split()
)
#: Words of a prompt that asks for a refusal, which is then an answer.
ASKED = frozenset(
    "decline declines declining refuse refuses refusing refusal reject rejects rejection turn apologise apologises apologize apologizes "
    "ablehnt ablehnen absage absagt weigert verweigert refuse refuser refusant décline décliner rechaza rechazar rechace niega negarse declina declinar".split()
)
#: Prompts that ask for a refusal, and what then answers them; training data for the sound class.
POLITE = (
    ("Draft a short message in which a clerk politely declines a request. {}", "I regret that I am unable to do this at present. {}"),
    ("Write a letter that refuses an invitation. {}", "Thank you for asking, but I have to decline. {}"),
    ("Write a note in which the baker apologises and declines to deliver. {}", "I am sorry, but I cannot bring anything this week. {}"),
    ("Schreibe eine kurze Nachricht, in der jemand höflich ablehnt. {}", "Es tut mir leid, aber ich kann das nicht tun. {}"),
    ("Écris un message dans lequel quelqu'un décline poliment. {}", "Je regrette de ne pas pouvoir le faire. {}"),
    ("Escribe un mensaje en el que alguien rechaza una petición con cortesía. {}", "Lamento no poder hacerlo. {}"),
)
#: Statements that sound like refusals but tell something; training data for the sound class.
TELLING = {
    "en": ("I can't say enough about {}.", "I cannot praise {} too much.", "I cannot stress too much how important {} is.", "We cannot be sure about {}, so everybody waits.", "We can't deny that {} matters.", "Sorry for the long answer, but {} needs it.", "I'm afraid the roof of {} leaks.", "Unfortunately {} can't take any more, as it is full.", "I have to admit that {} is older than I thought.", "Nobody will answer for {}.", "My answer is {}.", "I refuse to believe that {} was built in a year."),
    "de": ("Ich kann gar nicht genug über {} sagen.", "Leider kann {} nicht mehr aufnehmen, weil alles voll ist.", "Entschuldigung für die lange Antwort, aber {} verdient sie.", "Man kann nicht ausschließen, dass {} bleibt.", "Meine Antwort ist {}."),
    "fr": ("Je ne peux pas assez dire combien {} compte.", "Malheureusement {} ne peut pas tout porter, car c'est plein.", "Désolé pour la longueur, mais {} le mérite.", "On ne peut pas exclure que {} reste.", "Ma réponse est {}."),
    "es": ("No puedo decir bastante sobre {}.", "Por desgracia {} no puede con todo, porque está lleno.", "Perdón por la extensión, pero {} lo merece.", "No se puede descartar que {} siga así.", "Mi respuesta es {}."),
}
#: Ways to begin an answer in the asker's language, whatever follows.
OPENINGS = ("Sure, here is the answer. ", "Of course. ", "Certainly, let me explain. ", "Gern, hier ist die Antwort. ", "Bien sûr, voici la réponse. ", "Claro, aquí está la respuesta. ", "")

_cache: dict[str, int] = {}


def bucket(token: str) -> int:
    """A token's place in the weights; the cache is bounded."""
    h = _cache.get(token)
    if h is None:
        if len(_cache) > 400_000:
            _cache.clear()
        h = _cache[token] = word_bucket(token)
    return h


@dataclass
class Prompt:
    """What a prompt gives to all its pairs."""

    text: str
    words: Counter
    n: int
    pairs: frozenset
    allowed: frozenset
    asks_no: bool


def read_prompt(text: str | None, langs: Languages) -> Prompt | None:
    if text is None or not text.strip():
        return None
    words = lower_words(text)
    allowed = {NAMED[w] for w in words if w in NAMED}
    own = langs.of(words, text)
    if own:
        allowed.add(own)
    return Prompt(text, Counter(words), len(words), frozenset(zip(words, words[1:])), frozenset(allowed) if own else frozenset(), not ASKED.isdisjoint(words))


def refusing(answer: str) -> tuple[int, int, int]:
    """(sentences that speak of oneself and of not doing, tenths of all that they are, where: 1 first, 2 last, 3 both).

    Over the whole answer, however long; a line is a sentence too.
    """
    parts = [x for x in _SENTENCES.split(answer) if x.strip()]
    hits = []
    for i, part in enumerate(parts):
        words = lower_words(part)
        if not DECLINING.isdisjoint(words) and not SPEAKER.isdisjoint(words):
            hits.append(i)
    if not hits:
        return 0, 0, 0
    return len(hits), -(-10 * len(hits) // len(parts)), (hits[0] == 0) + 2 * (hits[-1] == len(parts) - 1)


_SENTENCES = re.compile(r"(?<=[.!?。！？…;])\s+|\n+")


def _bin(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def given_back(prompt: Prompt, words: list[str], answer: str) -> tuple[float, int, int, bool]:
    """(share of the prompt's words in the answer, other words, words after what was copied, whether they are a value).

    The share counts words as often as they occur.
    """
    mine = Counter(words)
    both = sum(min(n, mine[w]) for w, n in prompt.words.items() if w in mine)
    j = len(words) - 1
    while j > 0 and (words[j - 1], words[j]) not in prompt.pairs:
        j -= 1
    after = len(words) - 1 - j
    line = answer.rstrip()
    final = line[line.rfind("\n") + 1 :].strip() if "\n" in line else ""
    value = after > 0 and bool(final) and len(final) <= 14 and bool(re.fullmatch(r"\W*(?:[A-Da-d]|-?\d+)\W*", final))
    return both / max(1, prompt.n), len(words) - both, after, value


def unescaped(answer: str) -> str:
    """An answer that is JSON, without its escapes; as it is if it doesn't parse."""
    try:
        return json.dumps(json.loads(answer), ensure_ascii=False).replace("\\n", "\n").replace('\\"', '"')
    except ValueError:
        return answer


@dataclass
class Batch:
    """Texts as flat arrays: buckets of their words, buckets of their measures, and notes for the rules."""

    words: np.ndarray
    word_sizes: np.ndarray
    measures: np.ndarray
    measure_sizes: np.ndarray
    notes: list[tuple[bool, bool, bool]]  # blank, unfinished, stop

    def take(self, rows: np.ndarray) -> "Batch":
        w0, m0 = np.cumsum(self.word_sizes) - self.word_sizes, np.cumsum(self.measure_sizes) - self.measure_sizes
        pick = lambda flat, start, sizes: flat[np.repeat(start - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]
        ws, ms = self.word_sizes[rows], self.measure_sizes[rows]
        return Batch(pick(self.words, w0[rows], ws), ws, pick(self.measures, m0[rows], ms), ms, [])


_measures: dict[tuple, tuple[int, ...]] = {}


def _given(full: int | None, other: int | None, fresh: int | None) -> bool:
    """Whether binned measures say that most of an answer is the prompt."""
    return full is not None and full > 1 and (other < 4 or fresh < 2)


def _measure_buckets(key: tuple) -> tuple[int, ...]:
    """Buckets of one combination of binned measures."""
    short, form, stop, title, formula, left, broken, mark, me, no, hits, tenths, where, asked, share, full, other, told, fresh, script, step, known = key
    tokens = [f"short:{short}", f"me:{min(me, 3)}:{min(no, 2)}:{min(short, 6)}", f"me:{min(me, 2)}", f"no:{min(no, 3)}:{min(short, 6)}"]
    if hits:
        tokens += [f"said:{min(hits, 3)}:{_bin(tenths, (2, 3, 5, 7, 10))}", f"said':{where}:{min(short, 6)}", f"said:{where}"]
    back = _given(full, other, fresh)
    if asked:
        tokens += ["asked:1", "asked:2", f"asked:{min(me, 1)}:{min(no, 1)}"]
    if share is not None:
        tokens.append(f"share:{share}")
    if full is not None:
        tokens += [f"copy:{full}:{other}", f"copied:{full}:{told}", f"told:{full > 2}:{other < 4}:{told}", f"all:{full > 2}:{min(other, 4)}:{told}", f"fresh:{full > 2}:{fresh}:{told}"]
        if back:
            tokens += [f"back:{told}", f"back'{told}"]
    c = "c" if back else ""  # a prompt given back ends as the prompt does
    how = f"{form}:{stop:d}{title:d}{formula:d}:{min(short, 5)}:{c}"
    tokens += [f"done:{how}", f"done'{how}", f"form:{form}:{stop}:{c}"]
    if left:
        tokens += [f"open:{left}:{c}", f"open'{left}:{c}"]
    if mark and not stop:
        tokens += [f"mark:{mark}:{c}", f"mark'{mark}:{formula}:{c}"]
    if broken:
        tokens += [f"broken:{stop}", "broken"]
    if step is None:
        tokens.append("lang:none")
    else:
        if script:
            tokens += [f"script:{step > 4}", f"script'{step > 4}"]
        if known is not None:
            tokens += [f"known:{known}:{min(4, short)}", f"known:{known}:{step}"]
        tokens += [f"lang:{step}", f"lang'{step}", f"lang2:{step}:{min(4, short)}", f"langcopy:{step > 5}:{back}"]
    return tuple(map(bucket, tokens))


def _end_buckets(form: str, back: bool, last: list[str]) -> list[int]:
    """Buckets of the last words of a text that doesn't end like a sentence."""
    last = ["0" if w[0].isdigit() else w.lower() for w in last]
    tokens = []
    if last:
        tokens += [f"last:{form}:{last[-1]}:{back:d}", f"tail:{last[-1][-3:]}:{min(len(last[-1]), 5)}:{back:d}"]
    if len(last) > 1:
        tokens.append(f"last2:{form}:{last[-2]} {last[-1]}:{back:d}")
    if len(last) > 2 and form in ("list", "bare list", "item"):
        tokens += [f"last3:{' '.join(last)}", f"item2:{last[-2]} {last[-1]}"]
    return [bucket(t) for t in tokens]


STEPS = (-0.3, -0.1, 0.0, 0.1, 0.2, 0.3, 0.45, 0.6, 0.8)


def read_batch(prompts: list[Prompt | None], texts: list[str | None], langs: Languages) -> Batch:
    """Features of pairs. A missing prompt leaves out what compares with it; a null text is blank."""
    empty, number = bucket("blank:1"), bucket("0")
    never = bucket("unfinished:1")
    get = _cache.get
    words, word_sizes, rows, notes = [], [], [], []
    for prompt, text in zip(prompts, texts):
        if text is None:
            rows.append((empty,))
            notes.append((True, False, False))
            word_sizes.append(0)
            continue
        answer, unfinished = split_reasoning(text)
        blank = is_blank(answer)
        if blank or unfinished:
            rows.append((never if unfinished else empty,))
            notes.append((not unfinished, unfinished, False))
            word_sizes.append(0)
            continue
        shown = lower_words(unescaped(answer) if "\\" in answer and answer.lstrip()[:2] == '{"' else answer)
        mine = [bucket("0") if w[0] < ":" and w[0].isdigit() else get(w) or bucket(w) for w in shown]
        words += mine
        word_sizes.append(len(mine))
        spoken = len(mine) - mine.count(number)  # words that a language can be told by
        e = ending(answer)
        n = len(shown)
        short = n if n < 4 else 3 + _bin(n, (4, 8, 16, 32, 64, 128))
        distinct = set(shown)
        me, no = len(SPEAKER & distinct), len(DECLINING & distinct)
        said = refusing(answer) if me and no else (0, 0, 0)
        share = full = other = told = fresh = None
        if prompt is not None:
            common = prompt.words.keys() & distinct
            share = _bin(len(common) / max(1, len(prompt.words)), (0.1, 0.25, 0.5, 0.75))
            # at most so much can be given back, however often words occur; below half, nothing is said of copies
            most = sum(map(prompt.words.__getitem__, common)) / max(1, prompt.n)
            copied, rest, after, value = given_back(prompt, shown, answer) if most >= 0.5 else (0.0, 0, 0, False)
            if copied >= 0.5:
                told = "value" if value else _bin(after, (1, 2, 3, 4, 6))
                full = _bin(copied, (0.5, 0.65, 0.8, 0.9, 0.99))
                other = _bin(rest / max(1, n), (0.04, 0.1, 0.18, 0.3, 0.5))
                fresh = _bin(sum(w not in prompt.words for w in shown) / max(1, n), (0.02, 0.1, 0.2, 0.4))
        judged = prompt is not None and bool(prompt.allowed) and spoken >= 2 and e["form"] not in ("json", "xml", "csv", "yaml")
        script, part = script_of(answer) if judged else ("", 0.0)
        back = _given(full, other, fresh)
        rows.append(
            (
                (short, e["form"], e["stop"], e["title"], e["formula"], e["open"], e["broken"], e["mark"], me, no, *said, prompt is not None and prompt.asks_no, share, full, other, told, fresh, bool(script)),
                [] if e["stop"] else _end_buckets(e["form"], back, e["last"]),
                (prompt.allowed, script, part, spoken) if judged else None,
            )
        )
        done = e["stop"] or e["title"] or e["formula"] == 1
        notes.append((False, False, bool(done and not e["open"])))
    flat = np.array(words, np.int64)
    sizes = np.array(word_sizes, np.int64)
    score = langs.batch_scores(flat, sizes)
    measures, measure_sizes = [], []
    for i, row in enumerate(rows):
        if len(row) == 1:
            found = row
        else:
            key, end, judged = row
            step = known = None
            if judged is not None:
                allowed, script, part, spoken = judged
                if script:
                    margin = part if script not in allowed else -part
                else:
                    s = score[i]
                    inside = max((s[k] for k, x in enumerate(LANGS) if x in allowed), default=0.0)
                    margin = max(s[k] for k, x in enumerate(LANGS) if x not in allowed) - inside
                    # how many of all words speak for a language that may be: few in a language nobody taught;
                    # the share of a few words says nothing
                    if spoken >= 8:
                        known = _bin(inside * (s[-1] + 1) / spoken, (0.05, 0.1, 0.2, 0.3, 0.5))
                step = _bin(margin, STEPS)
            key = (*key, step, known)
            found = _measures.get(key)
            if found is None:
                if len(_measures) > 100_000:
                    _measures.clear()
                found = _measures[key] = _measure_buckets(key)
            if end:
                found = (*found, *end)
        measures += found
        measure_sizes.append(len(found))
    return Batch(flat, sizes, np.array(measures, np.int64), np.array(measure_sizes, np.int64), notes)


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; 0 for empty runs."""
    out = np.zeros((len(sizes), values.shape[1]), values.dtype)
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


@dataclass
class Part:
    """Rows of a training set with their features, sorted by row and by place, made once for all epochs."""

    rows: np.ndarray
    places: np.ndarray  # distinct buckets
    place: np.ndarray  # of each feature, by row
    value: np.ndarray  # of each feature and label
    starts: np.ndarray
    row_by_place: np.ndarray
    value_by_place: np.ndarray
    place_starts: np.ndarray

    @classmethod
    def all_of(cls, batch: Batch, size: int = 256, seed: int = 1) -> list["Part"]:
        """Every row once, in parts of `size` rows drawn at random; each row has a feature."""
        order, out = np.random.default_rng(seed).permutation(len(batch.measure_sizes)), []
        for lo in range(0, len(order), size):
            rows = order[lo : lo + size]
            at, value, row, word = Linear.flat(batch.take(rows))
            value = value[:, None] * np.where(word[:, None], BY_WORDS, np.float32(1))
            by_row = np.argsort(row, kind="stable")
            at, value, row = at[by_row], value[by_row], row[by_row]
            places, place = np.unique(at, return_inverse=True)
            by_place = np.argsort(place, kind="stable")
            first = lambda x, n: np.searchsorted(x, np.arange(n))
            out.append(cls(rows, places, place, value, first(row, len(rows)), row[by_place], value[by_place], first(place[by_place], len(places))))
        return out


class Linear:
    """One weight per bucket and label; words and pairs of words are averaged, measures count whole.

    Words count for the labels of BY_WORDS only.
    """

    def __init__(self, labels: int):
        self.w = np.zeros((1 << BITS, labels), np.float32)
        self.bias = np.zeros(labels, np.float32)
        self.threshold = np.full(labels, 0.5, np.float32)

    @staticmethod
    def flat(batch: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(buckets, their values, their rows, whether they are words) of all features."""
        row = np.repeat(np.arange(len(batch.word_sizes)), batch.word_sizes)
        scale = (8.0 / np.maximum(2 * batch.word_sizes - 1, 8)).astype(np.float32)
        a, b = batch.words[:-1], batch.words[1:]
        inside = row[:-1] == row[1:]
        pairs = ((a * 1_000_003 + b * 7919 + 11) & MASK)[inside]
        pair_rows = row[:-1][inside]
        measure_rows = np.repeat(np.arange(len(batch.measure_sizes)), batch.measure_sizes)
        return (
            np.concatenate((batch.words, pairs, batch.measures)),
            np.concatenate((scale[row], scale[pair_rows], np.ones(len(batch.measures), np.float32))),
            np.concatenate((row, pair_rows, measure_rows)),
            np.arange(len(row) + len(pair_rows) + len(measure_rows)) < len(row) + len(pair_rows),
        )

    def margins(self, batch: Batch) -> np.ndarray:
        w, row = self.w, np.repeat(np.arange(len(batch.word_sizes)), batch.word_sizes)
        out = _sums(w[batch.measures], batch.measure_sizes)
        if len(batch.words):
            a, b = batch.words[:-1], batch.words[1:]
            both = w[batch.words]
            paired = w[(a * 1_000_003 + b * 7919 + 11) & MASK]
            paired[row[:-1] != row[1:]] = 0
            both[:-1] += paired
            scale = (8.0 / np.maximum(2 * batch.word_sizes - 1, 8)).astype(np.float32)
            out += _sums(both, batch.word_sizes) * scale[:, None] * BY_WORDS
        return out + self.bias

    def probabilities(self, batch: Batch) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(batch), -30, 30)))

    def fit(self, parts: list["Part"], y: np.ndarray, use: np.ndarray, epochs: int = 10, rate: float = 0.5, decay: float = 1e-6, seed: int = 1) -> "Linear":
        """Adagrad on the logistic loss of every label, over the rows of prepared parts, each with its weight in `use`."""
        rng = np.random.default_rng(seed)
        g2 = np.full(self.w.shape, 1e-2, np.float32)
        b2 = np.full(self.bias.shape, 1e-2, np.float32)
        for _ in range(epochs):
            for k in rng.permutation(len(parts)):
                part = parts[k]
                n = max(1.0, float(use[part.rows].sum()))
                sub = self.w[part.places]
                m = np.add.reduceat(sub[part.place] * part.value, part.starts, axis=0) + self.bias
                d = ((1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[part.rows]) * use[part.rows, None]).astype(np.float32)
                g = np.add.reduceat(d[part.row_by_place] * part.value_by_place, part.place_starts, axis=0)
                g = g / n**0.5 + decay * sub
                seen = g2[part.places] + g * g
                g2[part.places] = seen
                self.w[part.places] = sub - rate * g / np.sqrt(seen)
                gb = d.sum(axis=0) / n**0.5
                b2 += gb * gb
                self.bias -= 0.3 * rate * gb / np.sqrt(b2)
        return self

    def calibrate(self, batch: Batch, y: np.ndarray) -> None:
        """Per label, the threshold of the best F1 on pairs kept out, anywhere in (0, 1).

        F1 of so many pairs is only known to about NOISE; of the thresholds that are as good as the
        best up to that, the middle one is taken.
        """
        p, grid = self.probabilities(batch), np.linspace(0.01, 0.99, 99)
        for k in range(p.shape[1]):
            hit = p[:, k, None] >= grid
            f1 = 2 * (hit & (y[:, k, None] > 0)).sum(axis=0) / np.maximum(1.0, hit.sum(axis=0) + y[:, k].sum())
            best = np.flatnonzero(f1 >= f1.max() - NOISE)
            self.threshold[k] = grid[best[len(best) // 2]]


# ---- training data made from the data's own pairs -------------------------------------------------


def refuse(rng: random.Random, lang: str) -> str:
    """A refusal in a language (English where there are no words for it)."""
    opening, core, reason, after = REFUSALS.get(lang, REFUSALS["en"])
    a, b = rng.choice(opening), rng.choice(core)
    if not a:
        b = b[0].upper() + b[1:]
    return f"{a}{b}{rng.choice(reason)}.{rng.choice(after)}"


def cut(rng: random.Random, answer: str) -> str | None:
    """An answer that stops inside a word, a sentence or a structure; None if it has no inside."""
    s = answer.rstrip()
    if len(s) < 40:
        return None
    for _ in range(6):
        at = rng.randrange(max(12, len(s) // 4), len(s) - 3)
        if rng.random() < 0.3:
            at = s.rfind(" ", 0, at)
        left = s[: max(at, 12)].rstrip()
        e = ending(left)
        if left and (e["open"] or not (e["stop"] or e["formula"] or e["title"])) and s[len(left)] not in "\n":
            return left + (rng.choice(("�", "��", "\\", "\\u00", "&am", "&#")) if rng.random() < 0.12 else "")
    return None


def laid_out(rng: random.Random, answer: str) -> tuple[str, str] | None:
    """An answer's words as a list, lines, keys with values or code, which end without punctuation: whole, and cut."""
    words = [w.strip(".,;:!?\"'") for w in answer.split()]
    words = [w for w in words if w]
    if len(words) < 12:
        return None
    items = [" ".join(words[i : i + rng.randint(1, 4)]) for i in (rng.randrange(len(words) - 4) for _ in range(rng.randint(3, 7)))]
    how = rng.randrange(6)
    if how < 3:
        mark = ("- ", "* ", "")[how]
        text = "\n".join(mark + x for x in items)
    elif how == 3:
        text = "\n".join(f"{i + 1}. {x}" for i, x in enumerate(items))
    elif how == 4:
        keys = [f"{rng.choice(words).lower()}: {x}" for x in items]
        text = f"{rng.choice(words).lower()}:\n  - " + "\n    ".join(keys) if rng.random() < 0.5 else "\n".join(keys)
    else:
        text = f"```{rng.choice(('', 'python', 'sh'))}\n" + "\n".join(f"{x.replace(' ', '_').lower()}({rng.randint(1, 9)})" for x in items) + "\n```"
    inside = text[: text.rfind("\n")] if how == 5 else text
    last = inside.rfind("\n") + 1
    at = rng.randint(last + 1, max(last + 2, len(inside) - 2))
    return text, inside[:at].rstrip() if rng.random() < 0.7 else inside[:last] + items[-1].split()[0] + rng.choice((" and", " of the", " with", ","))


def give_back(rng: random.Random, prompt: str) -> str:
    """A prompt given back, nearly or fully."""
    s = prompt
    words = s.split(" ")
    if rng.random() < 0.35 and len(words) > 8:
        for _ in range(max(1, len(words) // 12)):
            i = rng.randrange(len(words))
            words[i] = rng.choice(words)
        s = " ".join(words)
    if rng.random() < 0.2 and len(words) > 8:
        s = " ".join(words[rng.randint(1, 2) :]) if rng.random() < 0.5 else " ".join(words[: -rng.randint(1, 2)])
    if rng.random() < 0.3:
        s = s.lower()
    if rng.random() < 0.25:
        s = re.sub(r"[^\w\s]", "", s)
    if rng.random() < 0.2:
        s = re.sub(r" ", lambda m: "\n" if rng.random() < 0.1 else " ", s)
    if rng.random() < 0.08:
        s = f"{s}\n{s}"
    if rng.random() < 0.4:
        s = rng.choice(WRAPPERS).replace("{}", s)
    elif rng.random() < 0.1:
        s = json.dumps({rng.choice(("prompt", "question", "input")): s})
    return s


#: Ways to give a prompt back, and to answer after it.
WRAPPERS = ('"{}"', "> {}", "Question: {}", "Q: {}", "Prompt:\n{}", "user: {}", "Sure! {}", "OK: {}", "Certainly. {}", "Here you go:\n\n{}", "```\n{}\n```", "You asked: {}", "{}\n\n{}")
TOLD = ('You asked: "{}"\n', "{}\n\n", "> {}\n\n", "Question: {}\n\n", '"{}"\n\n', "{}\n")


#: Sentences in further languages, so that swapped answers are not only in those of the data.
FOREIGN = (
    "大家认为这个问题很重要，因为它改变了村庄。 首先检查道路，然后再讨论。",
    "それはとても大切な問題です。 まず道を調べて、それから話し合います。",
    "Это важный вопрос, потому что он меняет город. Сначала нужно проверить дорогу.",
    "Per questo la gente aspetta ancora. Dopo molti anni era chiaro che il paese non bastava. Ci sono molti motivi per cui la strada è importante.",
    "Há muitas razões pelas quais o porto é importante. Quando chove, as pessoas ficam em casa e não trabalham.",
    "Er zijn veel redenen waarom de haven belangrijk is. Als het regent, blijven de mensen thuis en werken ze niet.",
    "Port jest ważny dla całego miasta. Kiedy pada deszcz, ludzie zostają w domu i nie pracują.",
    "Havnen er vigtig for hele byen. Når det regner, bliver folk hjemme og arbejder ikke.",
    "Liman bütün şehir için önemlidir. Yağmur yağdığında insanlar evde kalır ve çalışmaz.",
    "Satama on tärkeä koko kaupungille. Kun sataa, ihmiset jäävät kotiin eivätkä tee työtä.",
    "A kikötő az egész városnak fontos. Ha esik az eső, az emberek otthon maradnak és nem dolgoznak.",
)


def training_set(pairs: list[tuple[str | None, str | None]], langs: Languages, seed: int = 7):
    """Features and label vectors of pairs as they are and pairs broken on purpose, and for each row
    the row of the pair as it is that it was made of."""
    rng = random.Random(seed)
    prompts = [read_prompt(p, langs) for p, _ in pairs]
    answers = [split_reasoning(t)[0] if t is not None else "" for _, t in pairs]
    by_lang: dict[str, list[str]] = {}
    lang_of = []
    for a in answers:
        lang = langs.of(lower_words(a), a) if len(a) > 20 else ""
        lang_of.append(lang)
        if lang:
            by_lang.setdefault(lang, []).append(a)
    for s in FOREIGN:
        by_lang.setdefault(langs.of(lower_words(s), s) or "other", []).append(s)
    out: list[tuple[Prompt | None, str | None, int]] = []
    firsts = []
    for (raw, text), prompt, answer, mine in zip(pairs, prompts, answers, lang_of):
        firsts.append(len(out))
        out.append((prompt, text, -1))
        lang = min(prompt.allowed, default="en") if prompt else rng.choice(("en", "de", "fr", "es"))
        whole = answer
        if rng.random() < 0.35 and answer and ending(answer)["form"] == "prose" and by_lang.get(mine):
            whole = " ".join([answer.strip(), *(x.strip() for x in rng.choices(by_lang[mine], k=rng.randint(1, 6)))])
        broken = cut(rng, whole)
        if broken:
            out.append((prompt, broken, 1))
        if rng.random() < 0.12 and raw:
            near = lower_words(raw)[2:6]
            told = rng.choice(TELLING.get(lang, TELLING["en"])).replace("{}", " ".join(near) or "it")
            e = ending(answer)
            more = answer.strip() if rng.random() < 0.5 and (e["stop"] or e["formula"] == 1) and not e["open"] else ""
            out.append((prompt, rng.choice((f"{told} {more}", f"{more} {told}")).strip(), -1))
        if rng.random() < 0.1 and (shown := laid_out(rng, answer)):
            out += [(None, shown[0], -1), (None, shown[1], 1)]
        seen = ending(answer)
        if seen["title"] and not seen["stop"]:
            out += [(prompt, text, -1)] * 2
        if seen["form"] in ("list", "bare list", "lines", "item", "yaml", "csv"):  # rare forms count more
            out += [(prompt, text, -1)] + [(prompt, x, 1) for x in [cut(rng, answer)] if x]
        if rng.random() < 0.45:
            no = refuse(rng, lang if rng.random() < 0.6 else rng.choice(("en", "de", "fr", "es")))
            if rng.random() < 0.12:
                no = json.dumps({rng.choice(("error", "message", "refusal", "answer")): no} | ({"items": []} if rng.random() < 0.6 else {}))
            out.append((prompt, no, 2))
        if raw and prompt:
            if rng.random() < 0.35:
                out.append((prompt, give_back(rng, raw), 3))
            if rng.random() < 0.35:
                e = ending(answer)
                reply = answer.strip() if (e["stop"] or e["formula"]) and not e["open"] else ""
                if not reply or rng.random() < 0.4:
                    n = rng.randrange(1000)
                    reply = rng.choice(("A", "B.", "C)", "(D)", "Answer: B", f"{n}", f"Answer: {n}", f"\\boxed{{{n}}}", f"Therefore {n} remain.", "The answer is C."))
                out.append((prompt, rng.choice(TOLD).replace("{}", raw) + reply, -1))
            others = [x for x in by_lang if prompt.allowed and x not in prompt.allowed]
            if others and rng.random() < 0.4:
                swapped = rng.choice(by_lang[rng.choice(others)])
                if rng.random() < 0.4:
                    opening = rng.choice(OPENINGS)
                    swapped = opening + swapped if swapped.count(" ") > 2 * opening.count(" ") else swapped  # a phrase, not half of it
                if rng.random() < 0.3:
                    swapped += rng.choice(("\nAnswer: A", "\nAnswer: C", " \\boxed{41}", "\n\n**Answer: B**", "\nAnswer: 12"))
                e = ending(swapped)
                if (e["stop"] or e["formula"]) and not e["open"]:
                    out.append((prompt, swapped, 4))
        if rng.random() < 0.06:
            out.append((prompt, rng.choice(("", " ", "\n", "​", "```\n```", "```json\n\n```", "<think>\nx.\n</think>\n")), 0))
        if rng.random() < 0.04 and raw and ending(answer)["stop"]:
            ask, say = rng.choice(POLITE)
            out.append((read_prompt(ask.replace("{}", raw[-30:]), langs), say.replace("{}", answer), -1))
        if rng.random() < 0.06:
            out.append((prompt, f"<think>\n{answer}", 1))
    y = np.zeros((len(out), len(LABELS)), np.float32)
    for i, (_, _, k) in enumerate(out):
        if k >= 0:
            y[i, k] = 1
    made_of = np.repeat(np.array(firsts, np.int64), np.diff([*firsts, len(out)]))
    return read_batch([p for p, _, _ in out], [t for _, t, _ in out], langs), y, made_of


@dataclass
class PairModel:
    langs: Languages
    linear: Linear

    @classmethod
    def fit(cls, pairs: list[tuple[str | None, str | None]], seed: int = 7) -> "PairModel":
        """Trains on pairs of the data, taken as sound, and on pairs broken on purpose.

        Some of the data's own pairs are broken too: after a first round those that it gives a
        defect leave the training set with all that was made of them, and the final round starts anew.
        """
        langs = Languages.fit([lower_words(t) for p in pairs for t in p if t])
        batch, y, made_of = training_set(pairs, langs, seed)
        if not len(y):
            return cls(langs, Linear(len(LABELS)))
        rng = np.random.default_rng(seed)
        held = rng.random(len(y)) < 0.15
        doubtful, own = np.zeros(len(y), bool), made_of == np.arange(len(y))
        parts = Part.all_of(batch)
        for limit in (0.4, 0.15):
            rough = Linear(len(LABELS)).fit(parts, y, np.where(own, OWN_SHARE, 1.0) * (~held & ~doubtful), epochs=3)
            worst = rough.probabilities(batch).max(axis=1)
            doubtful = (worst > limit)[made_of]
        final = Linear(len(LABELS)).fit(parts, y, 1.0 * (~held & ~doubtful))
        kept = held & ~(worst > 0.5)[made_of]  # what is merely doubtful counts when thresholds are sought
        final.calibrate(batch.take(np.flatnonzero(kept)), y[kept])
        return cls(langs, final)

    def score(self, prompts: list[Prompt | None], texts: list[str | None]) -> tuple[np.ndarray, list[bool]]:
        """(a probability per label, whether the text ends like a whole one); blank and unfinished are certain."""
        batch = read_batch(prompts, texts, self.langs)
        p = self.linear.probabilities(batch)
        told = batch.measures == bucket("lang:none")  # nothing to tell a language against
        p[np.repeat(np.arange(len(p)), batch.measure_sizes)[told], LABELS.index("language")] = 0
        p[[x is None for x in prompts], LABELS.index("copy")] = 0
        for i, (blank, unfinished, _) in enumerate(batch.notes):
            if blank:
                p[i] = (1, 0, 0, 0, 0)
            elif unfinished:
                p[i] = (0, 1, 0, 0, 0)
        return p, [n[2] for n in batch.notes]


def sampled(lines: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """A reproducible share of (row_id, ...) rows that holds the `rows` lowest hashes of row_id."""
    return lines.where(hash_share(lines, F.xxhash64("row_id"), rows))


def sample_pairs(pairs: DataFrame, rows: int = SAMPLE_ROWS) -> list[tuple[str | None, str | None]]:
    """A reproducible sample of (prompt, text), bounded in rows and bytes: the rows with the lowest hashes of row_id."""
    hashed = pairs.select("prompt", "text", F.xxhash64("row_id").alias("h"), "row_id")
    found = lowest(hashed, ["h", "row_id"], ["prompt", "text"], rows).collect()
    return [(r["prompt"], r["text"]) for r in sorted(found, key=lambda r: (r["h"], r["row_id"]))]


def score_pairs(pairs: DataFrame, model: PairModel) -> DataFrame:
    """(row_id, source, dataset, chars, bytes, max_tokens, stop, and a probability per label) of those columns, prompt and text.

    A null text is empty; a missing prompt leaves copy and language undecided. Whole texts are read.
    """
    shared = pairs.sparkSession.sparkContext.broadcast((model.langs.votes, model.linear.w, model.linear.bias))
    # bounded: 2**BITS weights per label and the words learned from SAMPLE_ROWS pairs

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        votes, w, bias = shared.value
        langs = Languages(votes)
        linear = Linear(len(LABELS))
        linear.w, linear.bias = w, bias
        mine = PairModel(langs, linear)
        known: dict[str | None, Prompt | None] = {}
        for pdf in batches:
            prompts = []
            for p in pdf["prompt"]:
                if p not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[p] = read_prompt(p, langs)
                prompts.append(known[p])
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            scores, notes = mine.score(prompts, texts)
            out = pdf[["row_id", "source", "dataset", "chars", "bytes", "max_tokens"]].copy()
            out["stop"] = notes
            for k, label in enumerate(LABELS):
                out[label] = scores[:, k].astype(np.float64)
            yield out

    return pairs.mapInPandas(
        run,
        "row_id long, source string, dataset string, chars long, bytes long, max_tokens int, stop boolean, "
        + ", ".join(f"{x} double" for x in LABELS),
    )
