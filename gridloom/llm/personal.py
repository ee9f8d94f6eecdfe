"""Personal information in free text, found by a skip-chain conditional random field and replaced by placeholders.

A text becomes a chain of tokens: words, runs of digits, Chinese characters and single signs. The field labels every
token as outside, at the begin of or inside a mention of a kind, so the labels set the bounds of all mentions. Node potentials
come from the form of a token (letters, affixes, case, whether it is a frequent word, a listed name, a title), from the
tokens around it, and from marks of strings that have the form of an address, number or street; a mark is evidence like the
other features and bounds nothing. Chain potentials tie adjacent labels. Skip potentials tie tokens that repeat within a
document, however far apart, and numbers of one digit form, so that their labels agree. Loopy belief propagation passes
messages over the skip edges, with an exact forward-backward pass over each chain in between, until they converge.
Labels are read off the marginals; an exact check of the form of each mention follows.

The field is trained here, by likelihood of the chains with pseudo-likelihood over the skip edges, on TRAINING_TEXTS texts
made of the sentences of `sentences.py` (a fixed, seeded bound). They were written for the purpose; no text of the corpus
is used. The words of a public byte-pair vocabulary tell frequent words from others. Everything else is one map
over all documents and their whole texts.

Defined results for odd input
-----------------------------
* null texts give no mention and stay null when redacted; empty and blank texts stay as they are.
* a document or text that comes twice gives its mentions once (found) and is redacted each time.
* null ids: mentions come out with a null id. Extra columns are kept by redaction and ignored by the search.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import names, sentences
from gridloom.operators.layout import bounded, ship, spread_small

KINDS = ("person", "email", "phone", "idno", "street")
#: 0 is outside; a kind has 1 + 2k for its first token and 2 + 2k for the others
LABELS = ("other", *(f"{k}:{p}" for k in KINDS for p in ("first", "inside")))
TRAINING_TEXTS = 8000
SEED = 11
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: messages have converged when no marginal of a tied token moves further than this; a document that does not get there ends after MOST_ROUNDS
CONVERGED, MOST_ROUNDS, DAMPING = 5e-3, 60, 0.25
#: steps along a chain between two scalings; a step of a field like this one shrinks a sum by some powers of ten at most
SCALED_EACH = 6
FORBIDDEN = -25.0
#: potential of a person's label at the name of a known application, which is no person
KNOWN_NAME = -12.0
LETTERS_A_BATCH = 1_500_000
TYPES_KEPT = 400_000

CHINESE = "一-鿿㐀-䶿"
PIECES = re.compile(rf"(?:[^\W\d_{CHINESE}][̀-ͯ]*)+|\d+|[{CHINESE}]|\n\s*|[^\S\n]+|.", re.S)
FILES = set("png jpg jpeg webp gif svg pdf json csv txt xml html py js zip".split())

# ---------------------------------------------------------------- forms of addresses, numbers and streets
_AT = r"(?:\s?[@＠]\s?|\s?[\[({]\s?(?:at|@|arroba|ät)\s?[\])}]\s?|\s(?:at|arroba)\s(?=[\w-]+(?:\s?[\[({]\s?(?:dot|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|punkt|point|punto)\s)))"
_DOT = r"(?:\.|\s?[\[({]\s?(?:dot|\.|punkt|point|punto)\s?[\])}]\s?|\s(?:dot|punkt|point|punto)\s)"
_NAME = r"[^\W\d_]+"
_PART = rf"{_NAME}(?:[-'’]{_NAME})*"
EMAIL = rf"(?<![\w.+@-])[a-z0-9À-ɏ][\w+-]*(?:{_DOT}[\w+-]+)*{_AT}[a-z0-9À-ɏ][\w-]*(?:{_DOT}[a-z0-9À-ɏ][\w-]*)*{_DOT}[a-zÀ-ɏ]{{2,}}(?![\w-])"
_KINDS_EN = r"(?:st\.|(?:street|road|avenue|lane|close|court|drive|way|place|square|terrace|crescent|boulevard|hill|gardens|grove|row|mews|walk|parade|quay|st|rd|ave|ln|ct|dr|blvd)\b)"
_KINDS_DE = r"(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm|anger|markt)"
_TO = r"(?:[  ]?[-–/][  ]?\d{1,4})?"
_LETTER = r"(?:[  ]?[a-z](?![^\W_]))?"
STREETS = {
    "fr": rf"(?<![\w/.-])\d{{1,4}}(?:[  ]?(?:bis|ter|quater)\b|[  ]?[a-z](?![^\W_]))?{_TO},?[  ](?:rue|avenue|av\.|boulevard|bd|place|impasse|allée|chemin|quai|route|cours|passage|square)[  ](?:(?:de\sla|du|des|de|la|le)\s|d[’']\s?|de\sl[’']|l[’'])?{_PART}",
    "en": rf"(?<![\w/.-])\d{{1,4}}(?:[  ]?[a-z](?![^\W_]))?(?:[  ]?[-–/][  ]?\d{{1,4}}[a-z]?)?,?[  ](?:(?:old|new|upper|lower|north|south|east|west|great|little|saint|st\.?)[  ])?{_PART}[  ]{_KINDS_EN}",
    "de": rf"(?<![^\W_])(?:(?:am|im|zum|zur|an\sder|auf\sder|auf\sdem)\s)?(?:{_PART}{_KINDS_DE}|{_PART}[  -]{_KINDS_DE}|(?<=[mr]\s){_NAME})\s\d{{1,4}}{_TO}{_LETTER}(?![^\W_])",
    "es": rf"(?<![^\W_])(?:c/|calle\b|avda\.|av\.|avenida\b|plaza\b|pza\.|paseo\b|ronda\b|camino\b|carrera\b|travesía\b)\s?(?:(?:de\slas?|de\slos|del|de|la|el)\s)?{_PART},?\s(?:n\.?\s?[ºo°]\.?\s?|núm\.\s?)?\d{{1,4}}(?:[  ]?bis\b)?{_TO}{_LETTER}(?![^\W_])",
    "zh": rf"[{CHINESE}]{{1,6}}(?:大街|大道|胡同|路|街|巷|弄)\s?\d{{1,4}}(?:[-–]\d{{1,4}})?\s?号(?:之\d+|[甲乙丙丁])?",
}
IDNO = r"(?<![\w.+-])(?:\d{3}([- ])\d{2}\1\d{4}|\d{2} \d{3} \d{3} \d{3}|\d{2} \d{6} [a-z] \d{3}|\d{3}/\d{4}/\d{4}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}|[xyz]?-?\d{7,8}[- ]?[a-z]|\d{17}[\dx]|\d{11}|\d{9}|[a-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[a-d]|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{4} \d{4} \d{4}|756\.\d{4}\.\d{4}\.\d{2}|[a-z]{6}\d{2}[a-z]\d{2}[a-z]\d{3}[a-z])(?![\w]|[.,-]\d)"
PHONE = r"(?<![\w.+/-])(?:(?:\+|00)\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d(?:[\d]|[ ./-](?=\d)|[ ]?\((?=\d)|\)[ ]?(?=\d)|[ ]/[ ](?=\d)){5,20}\d(?![\w]|[.,:-]\d)"
_EMAIL, _IDNO, _PHONE = re.compile(EMAIL, re.I), re.compile(IDNO, re.I), re.compile(PHONE)
_STREETS = {k: re.compile(v, re.I) for k, v in STREETS.items()}
_AT_HINT = re.compile(r"[@＠]|[\[({]\s?(?:at|arroba|ät)\s?[\])}]|\s(?:at|arroba)\s[\w-]+(?:\s?[\[({]\s?|\s)(?:dot|punkt|point|punto)", re.I)
_NUMBER_AFTER = re.compile(r"(?<=[^\W\d_])\s\d|(?<=\.)\s\d")
_GERMAN_ENDS = tuple(re.findall(r"[^\W_]+\.?", _KINDS_DE.replace("(?:", "").replace("\\.", ".")))
_GERMAN_BEFORE = {"am", "im", "zum", "zur", "der", "dem"}
_STREET_HINT = re.compile(r"str(?:eet|aße|asse|\.)|r(?:oa)?d\b|ave(?:nue|nida|\b)|lane\b|ln\b|c(?:lose|ourt|t|rescent|alle|arrera|amino|hemin|ours)\b|dr(?:ive)?\b|w(?:ay|eg|alk)\b|pla(?:ce|tz|za)|square|terrace|b(?:oulevard|lvd|d)\b|hill|g(?:ardens|rove|asse)|r(?:ow|ue|ing|onda|oute)\b|mews|parade|qua[iy]|st\b|allée|allee|impasse|passage|ufer|damm|anger|markt|c/|avda|av\.|pza|paseo|travesía|[ao][mnfru][mr]?\s|[路街巷弄道同]", re.I)


def near_hints(pattern: re.Pattern, text: str, places: list[int], before: int, after: int) -> set[tuple[int, int]]:
    """Matches of a pattern that begin near places where one may be."""
    return {m.span() for at in places for m in pattern.finditer(text, max(0, at - before), min(len(text), at + after))}


def german_places(text: str) -> list[int]:
    """Where a number stands behind a word that may end the name of a German street."""
    found = []
    for m in _NUMBER_AFTER.finditer(text):
        head = text[max(0, m.start() - 40) : m.start()].lower()
        if head.endswith(_GERMAN_ENDS) or (words := head.split()[-2:-1]) and words[0] in _GERMAN_BEFORE:
            found.append(m.start())
    return found


def forms_in(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, which form of it, start, end) of the strings that have the form of an address, number or street."""
    found = []
    if places := [m.start() for m in _AT_HINT.finditer(text)]:
        found += [("email", "", *span) for span in sorted(near_hints(_EMAIL, text, places, 120, 300)) if text[slice(*span)].rsplit(".", 1)[-1].lower() not in FILES]
    found += [("idno", "", *m.span()) for m in _IDNO.finditer(text)]
    found += [("phone", "", *m.span()) for m in _PHONE.finditer(text)]
    if _STREET_HINT.search(text):
        for form, pattern in _STREETS.items():
            spans = sorted(near_hints(pattern, text, german_places(text), 100, 30)) if form == "de" else [m.span() for m in pattern.finditer(text)]
            found += [("street", form, *span) for span in spans]
    return found


# ---------------------------------------------------------------- features of token types
CLASSES = (
    "edge given:T given:U given:l both:T both:U both:l family:T family:U family:l title particle:l particle:T initial letter street:T street:l ends:T ends:l known:T known:U known:l proper:T proper:U proper:l "
    "rare:T rare:U rare:l mixed surname chinese d1 d2 d3 d4 d5 d6 , . - ' : @ / ( ) quote ; | sign"
).split()
CLASS_ID = {c: i for i, c in enumerate(CLASSES)}
COUNT = len(CLASSES)
GIVEN, FAMILY = names.listed(names.GIVEN), names.listed(names.FAMILY)
TITLES, PARTICLES, STREET_WORDS = set(names.TITLES.split()), set(names.PARTICLES.split()), set(names.STREET_WORDS.split())
STREET_ENDS = tuple(names.STREET_ENDS.split())
SMALL = {word for words in sentences.SMALL.values() for word in words}
SURNAMES = set(names.CHINESE_FAMILY)
_SIGNS = {c: c for c in ",.-':@/();|"} | {"’": "'", "‘": "'", "–": "-", "‐": "-", "‑": "-", "＠": "@", "[": "(", "]": ")", "{": "(", "}": ")", "（": "(", "）": ")", "，": ",", "。": ".", "：": ":", "；": ";", "、": ","} | {c: "quote" for c in "\"“”„«»‹›"}
SPACE, BREAK = -1, -2


def wide_free(piece: str) -> str:
    """A token in letters and digits of ordinary width."""
    return piece if piece.isascii() else unicodedata.normalize("NFKC", piece) or piece


def class_of(piece: str, known: dict[str, int]) -> str:
    """The class of a token; known has the frequent words."""
    piece = wide_free(piece)
    first = piece[0]
    if first.isdigit():
        return f"d{min(len(piece), 6)}"
    if not first.isalpha():
        return _SIGNS.get(piece, "sign")
    if "㐀" <= first <= "鿿":
        return "surname" if first in SURNAMES else "chinese"
    low = piece.lower()
    if len(piece) == 1:
        return "initial" if first.isupper() else "letter"
    case = "l" if piece == low else "U" if piece == piece.upper() else "T" if piece[1:] == low[1:] else None
    if case is None:
        return "mixed"
    if low in TITLES:
        return "title"
    if low in PARTICLES:
        return "particle:l" if case == "l" else "particle:T"
    if low in STREET_WORDS:
        return "street:l" if case == "l" else "street:T"
    if low in GIVEN:
        return ("both:" if low in FAMILY else "given:") + case
    if low in FAMILY:
        return "family:" + case
    if known.get(low) == 1:
        return "known:" + case
    if len(low) > 6 and low.endswith(STREET_ENDS):
        return "ends:l" if case == "l" else "ends:T"
    return ("proper:" if low in known else "rare:") + case


def shape(text: str) -> str:
    return re.sub(r"(.)\1+", r"\1+", re.sub(r"[^\W\d_]", lambda m: "X" if m[0].isupper() else "x", text))


def own_features(piece: str, cls: str) -> list[str]:
    """Names of the features that a token has by itself."""
    piece = wide_free(piece)
    low = piece.lower()
    out = ["bias", "c=" + cls, "w=" + low]
    if piece[0].isdigit():
        return [*out, f"digits={len(piece)}", f"zero={piece[0] == '0'}", f"head={piece[:2]}"]
    if piece[0].isalpha() and cls not in ("surname", "chinese"):
        base = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
        out += [f"shape={shape(piece)}", f"size={min(len(base), 12)}"]
        out += [f"tail={base[-n:]}" for n in (1, 2, 3, 4) if len(base) > n] + [f"head={base[:n]}" for n in (2, 3) if len(base) > n]
        out += [f"case{piece[0].isupper():d}tail={base[-n:]}" for n in (2, 3) if len(base) > n]
    return out


def near_features(piece: str, cls: str) -> list[str]:
    """Names of the features that a token is to those around it."""
    low = wide_free(piece).lower()
    return ["c=" + cls, "w=" + low, *(["tail=" + low[-3:]] if len(low) > 3 else [])]


NEAR = (-3, -2, -1, 1, 2, 3)
#: in training, shares of the neighbours' words that are hidden and of the features that are left out, those of marks excepted
NEAR_DROPPED, DROPPED = 0.2, 0.25


def folded(piece: str) -> str:
    """A token without case, accents and width."""
    return "".join(c for c in unicodedata.normalize("NFKD", piece.casefold()) if not unicodedata.combining(c))


def title_tokens(title: str) -> tuple[str, ...]:
    return tuple(folded(p) for p in PIECES.findall(title) if not p.isspace())


class Types:
    """Tokens by number, with what does not depend on their place."""

    def __init__(self, known: dict[str, int], titles: list[tuple[str, ...]] = ()):
        self.known = known
        self.titles: dict[str, list[tuple[str, ...]]] = {}
        for title in titles:
            if title:
                self.titles.setdefault(title[0], []).append(title)
        self.folded, self.opens = [""], [False]
        ends = Counter(t[-1] for t in set(titles) if len(t) > 1)
        self.nouns = {word for word, n in ends.items() if n > 1}  # what several applications are called
        self.noun = [False]
        self.index: dict[str, int] = {"": 0}
        self.pieces, self.classes, self.ties = [""], [0], [-1]
        self.keys: dict[str, int] = {}

    def number(self, piece: str) -> int:
        """Also of pieces that are no tokens: SPACE and BREAK."""
        at = self.index.get(piece)
        if at is None:
            if piece.isspace():
                at = BREAK if "\n" in piece else SPACE
            else:
                at = len(self.pieces)
                cls = class_of(piece, self.known)
                self.pieces.append(piece)
                bare = piece.lower() if piece.isascii() else folded(piece)
                self.folded.append(bare)
                self.opens.append(bare in self.titles)
                self.noun.append(bare in self.nouns)
                self.classes.append(CLASS_ID[cls])
                # Words are tied to their repetitions unless they are frequent in lower case, as names are not.
                tied = len(piece) > 2 and cls.split(":")[0] in ("given", "both", "family", "proper", "rare", "mixed")
                self.ties.append(self.keys.setdefault(piece.lower(), len(self.keys)) if tied else -1)
            self.index[piece] = at
        return at


LISTED = {place: ("listed", f"listed:{place}") for place in "SBIE"}


_NOUN_MARKS: dict[tuple[int, int], tuple[tuple[str, ...], tuple[str, ...]]] = {}  # kept by pair of classes


def noun_marks(cls: int, before: int) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Features of a noun of applications and of the token before it."""
    if (cls, before) not in _NOUN_MARKS:
        c, b = CLASSES[cls], CLASSES[before]
        _NOUN_MARKS[cls, before] = ("noun", f"noun:{c}", f"noun:{c}:{b}"), (f"noun:before:{c}", f"noun:before:{c}:{b}")
    return _NOUN_MARKS[cls, before]


class Batch:
    """The tokens of some texts in one row, three pads between texts."""

    def __init__(self, texts: list[str], types: Types):
        self.texts = texts
        index, number = types.index, types.number
        numbers, lengths, counts = [], [], []
        for text in texts:
            pieces = PIECES.findall(text)
            numbers.append(np.array([index[p] if p in index else number(p) for p in pieces], dtype=np.int64))
            lengths.append(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        size = sum(len(n) for n in numbers) + 3 * len(texts) + 3
        self.types, self.start, self.end, self.gap = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.first = np.zeros(len(texts), np.int64)
        self.length = np.zeros(len(texts), np.int64)
        at = 3
        for k, (number_, length) in enumerate(zip(numbers, lengths)):
            end = np.cumsum(length)
            keep = number_ >= 0
            n = int(keep.sum())
            before = np.zeros(len(number_), np.int64)
            before[1:] = np.where(number_[:-1] == SPACE, 1, np.where(number_[:-1] == BREAK, 2, 0))
            before[:1] = 2
            self.types[at : at + n], self.start[at : at + n], self.end[at : at + n], self.gap[at : at + n] = number_[keep], (end - length)[keep], end[keep], before[keep]
            self.first[k], self.length[k] = at, n
            at += n + 3
        self.size = at
        for name in ("types", "start", "end", "gap"):
            setattr(self, name, getattr(self, name)[:at])
        self.classes = np.array(types.classes, dtype=np.int64)[self.types]
        self.real = self.types > 0
        self.marks: list[tuple[int, tuple[str, ...]]] = []
        self.known_names: list[int] = []  # tokens of listed applications
        self.matches = [0]  # the mark at which each match begins
        opens = np.array(types.opens)[self.types]
        for i in np.flatnonzero(opens).tolist():
            for title in types.titles[types.folded[self.types[i]]]:
                if all(types.folded[self.types[i + d]] == t for d, t in enumerate(title)):
                    self.listed(i, i + len(title) - 1)
        for i in np.flatnonzero(np.array(types.noun)[self.types]).tolist():
            self.noun(i)
        ties = np.array(types.ties, dtype=np.int64)[self.types]
        nodes = np.flatnonzero(ties >= 0)
        doc = np.searchsorted(self.first, nodes, side="right") - 1
        forms: dict[tuple[int, str], int] = {}
        edges = []
        for k, text in enumerate(texts):
            at, n = self.first[k], self.length[k]
            starts, ends = self.start[at : at + n], self.end[at : at + n]
            for kind, form, low, high in forms_in(text):
                a, b = at + int(np.searchsorted(starts, low)), at + int(np.searchsorted(ends, high))
                if b < at + n and a <= b and self.start[a] == low and self.end[b] == high:
                    self.mark(kind, form, a, b, text[low:high], types)
                    if kind in ("idno", "phone"):
                        key = (k, kind + number_form(text[low:high]))
                        if forms.get(key, a) != a:
                            edges.append((forms[key], a))
                        forms[key] = a
        order = np.lexsort((nodes, ties[nodes], doc))
        nodes, keys, doc = nodes[order], ties[nodes][order], doc[order]
        same = (keys[1:] == keys[:-1]) & (doc[1:] == doc[:-1]) & (nodes[1:] - nodes[:-1] > 1)
        ties_ = np.stack([nodes[:-1][same], nodes[1:][same]], axis=1) if len(nodes) else np.zeros((0, 2), np.int64)
        self.edges = np.concatenate([ties_, np.array(edges, dtype=np.int64).reshape(-1, 2)])

    def listed(self, a: int, b: int) -> None:
        """Marks the name of a known application."""
        self.known_names += range(a, b + 1)
        self.marks += [(i, LISTED["S" if a == b else "B" if i == a else "E" if i == b else "I"]) for i in range(a, b + 1)]
        self.marks += [(a - 1, ("listed:next",)), (b + 1, ("listed:before",))]
        self.matches.append(len(self.marks))

    def noun(self, i: int) -> None:
        """Marks a word that several applications are called by."""
        self.marks += zip((i, i - 1), noun_marks(int(self.classes[i]), int(self.classes[i - 1])))
        self.matches.append(len(self.marks))

    def mark(self, kind: str, form: str, a: int, b: int, text: str, types: Types) -> None:
        name = f"{kind}{form}"
        word = lambda i: types.pieces[self.types[i]].lower()
        for i in range(a, b + 1):
            place = "S" if a == b else "B" if i == a else "E" if i == b else "I"
            if form == "zh":
                self.marks.append((i, (f"{name}:{b - i}",)))
            else:
                self.marks.append((i, (f"{name}:{place}", f"{name}:{place}:{CLASSES[self.classes[i]]}")))
        if kind in ("idno", "phone"):
            lengths = re.sub(r"[^\W\d_]", "a", re.sub(r"\d+", lambda m: str(len(m[0])), text))
            count = sum(c.isdigit() for c in text)
            head = re.sub(r"[^0-9+]", "", text)[:2]
            context = [f"{name}:before{d}={word(a - d)}" for d in (1, 2, 3)] + [f"{name}:after={word(b + 1)}", f"{name}:around={CLASSES[self.classes[a - 1]]}{CLASSES[self.classes[b + 1]]}"]
            bag = {word(i) for i in range(max(a - 7, 0), a) if CLASSES[self.classes[i]][0] not in "d,.-'@/()"} - SMALL
            self.marks += [(a, (f"{name}:bag={w}", f"{name}:stem={w[:5]}") if len(w) > 5 else (f"{name}:bag={w}",)) for w in sorted(bag)]
            self.marks.append((a, (f"{name}:lengths={lengths}", f"{name}:digits={count}", f"{name}:head={head}", f"{name}:head={head[:1]}:digits={count}", f"{name}:gap={self.gap[b + 1]}", *context)))
        elif kind == "street":
            self.marks.append((a, (f"{name}:last={word(b)}", f"{name}:known={'known' in CLASSES[self.classes[a + 1]]}", f"{name}:after={word(b + 1)}")))
            self.marks += [(a, (f"{name}:inner={CLASSES[self.classes[i]]}",)) for i in range(a + 1, b)]
        self.matches.append(len(self.marks))


def number_form(text: str) -> str:
    """The signs of a number with 9 for each digit."""
    return re.sub(r"\d", "9", text)


# ---------------------------------------------------------------- the field
def chain_sums(scores: np.ndarray, first: np.ndarray, length: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, backward, potentials) of chains, each row scaled; scores are logarithms, chains start at first."""
    potential = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(chain)
    open_ = np.exp(np.where(np.arange(len(chain)) % 2 == 0, FORBIDDEN, 0.0))
    open_[0] = 1.0
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    starts, sizes = first[order], length[order]
    forward, backward = np.zeros_like(potential), np.ones_like(potential)
    if not len(order):
        return forward, backward, potential
    steps = int(sizes[0])
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left")  # chains longer than t
    state = potential[starts] * open_
    state /= state.sum(axis=1, keepdims=True)
    forward[starts] = state
    for t in range(1, steps):
        n = alive[t]
        at = starts[:n] + t
        state = (state[:n] @ move) * potential[at]
        if t % SCALED_EACH == 0:
            state /= state.sum(axis=1, keepdims=True)
        forward[at] = state
    back = np.ones((0, potential.shape[1]))
    for t in range(steps - 2, -1, -1):
        n = alive[t + 1]
        at = starts[:n] + t + 1
        if len(back) < n:
            back = np.concatenate([back, np.ones((n - len(back), potential.shape[1]))])
        back = (potential[at] * back) @ move.T
        if t % SCALED_EACH == 0:
            back /= back.sum(axis=1, keepdims=True)
        backward[at - 1] = back
    return forward, backward, potential


def beliefs_of(scores: np.ndarray, first: np.ndarray, length: np.ndarray, chain: np.ndarray) -> np.ndarray:
    forward, backward, _ = chain_sums(scores, first, length, chain)
    out = forward * backward
    total = out.sum(axis=1, keepdims=True)
    return out / np.where(total > 0, total, 1)


def marginals(scores: np.ndarray, first: np.ndarray, length: np.ndarray, edges: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Loopy belief propagation: messages over the skip edges, with each chain summed exactly in between.

    A document leaves the rounds when its messages have converged.
    """
    belief = beliefs_of(scores, first, length, chain)
    if not len(edges):
        return belief
    owner = np.searchsorted(first, edges[:, 0], side="right") - 1
    pair = np.exp(skip)
    messages = np.zeros((2, len(edges), scores.shape[1]))  # logarithms, to the second and to the first token of an edge
    live = np.unique(owner)
    for _ in range(MOST_ROUNDS):
        mine = np.flatnonzero(np.isin(owner, live))
        ends = edges[mine]
        for side in (0, 1):
            out = np.log(belief[ends[:, side]] + 1e-12) - messages[1 - side, mine]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(out @ (pair if side == 0 else pair.T) + 1e-12)
            new -= new.max(axis=1, keepdims=True)
            messages[side, mine] = DAMPING * messages[side, mine] + (1 - DAMPING) * new
        # the live documents as a table of their own
        sizes = length[live]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.repeat(first[live] - starts, sizes) + np.arange(sizes.sum())
        place = np.zeros(len(scores), dtype=np.int64)
        place[rows] = np.arange(len(rows))
        inner = scores[rows].copy()
        np.add.at(inner, place[ends[:, 1]], messages[0, mine])
        np.add.at(inner, place[ends[:, 0]], messages[1, mine])
        new = beliefs_of(inner, starts, sizes, chain)
        moved = np.abs(new[place[ends]] - belief[ends]).max(axis=(1, 2))
        belief[rows] = new
        live = np.unique(owner[mine[moved > CONVERGED]])
        if not len(live):
            break
    return belief


def cells_of(batch: Batch) -> list[np.ndarray]:
    """Numbers of the class patterns around each token, one row for each table."""
    c = batch.classes
    at = lambda d: np.roll(c, -d)
    after = np.roll(batch.gap, -1)
    return [(at(-1) * COUNT + c) * COUNT + at(1), (at(-2) * COUNT + at(-1)) * COUNT + c, (c * COUNT + at(1)) * COUNT + at(2), ((batch.gap * 3 + after) * COUNT + at(-1)) * COUNT + c, ((batch.gap * 3 + after) * COUNT + c) * COUNT + at(1), batch.gap * 3 + after]


def table_sizes() -> list[int]:
    return [COUNT**3] * 3 + [9 * COUNT**2] * 2 + [9]


def pairs_of(batch: Batch) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, pair numbers): adjacent Chinese characters, seen from the second one."""
    chinese = (batch.classes == CLASS_ID["chinese"]) | (batch.classes == CLASS_ID["surname"])
    at = np.flatnonzero(chinese[1:] & chinese[:-1]) + 1
    return at, batch.types[at - 1] << 32 | batch.types[at]


class Field:
    """The trained potentials: weights by feature name, tables by class pattern, chain and skip potentials."""

    def __init__(self, known, own, near, marks, pairs, tables, chain, skip):
        self.known, self.own, self.near, self.marks, self.pairs, self.tables, self.chain, self.skip = known, own, near, marks, pairs, tables, chain, skip


def allowed_moves() -> np.ndarray:
    """0 where a label may follow another, FORBIDDEN where it may not: the inside of a mention follows its own kind only."""
    out = np.zeros((len(LABELS), len(LABELS)))
    for y in range(2, len(LABELS), 2):
        out[:, y] = FORBIDDEN
        out[y - 1, y] = out[y, y] = 0
    return out


def labels_of(batch: Batch, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    out = np.zeros(batch.size, dtype=np.int64)
    for k, found in enumerate(spans):
        at = slice(batch.first[k], batch.first[k] + batch.length[k])
        for start, end, kind in found:
            inside = at.start + np.flatnonzero((batch.start[at] < end) & (batch.end[at] > start))
            label = 1 + 2 * KINDS.index(kind)
            out[inside] = label + 1
            out[inside[:1]] = label
    return out


def train(texts: int = TRAINING_TEXTS, seed: int = SEED, rounds: int = 6, rate: float = 0.25, decay: float = 2e-5, vocabulary: str = VOCABULARY, lines: dict[str, list[str]] | None = None) -> Field:
    """The field with the greatest likelihood of made texts, by AdaGrad over parts of 128 texts.

    Part of the listed names are treated as unlisted, part of the neighbours' words are hidden and part of the marks dropped, so that
    form and context get weights of their own.
    """
    rng, draw = random.Random(seed), np.random.default_rng(seed)
    made = [sentences.text_of(rng, lines) if lines else sentences.text_of(rng) for _ in range(texts)]
    known = names.common_words(vocabulary)
    types = Types(known)
    batch = Batch([m[0] for m in made], types)
    labels = labels_of(batch, [m[1] for m in made])
    nouns = {*sentences.NOUNS, *sentences.MADE_NOUNS}
    for k, (_, _, listed) in enumerate(made):
        at = slice(batch.first[k], batch.first[k] + batch.length[k])
        for start, end in listed:
            inside = at.start + np.flatnonzero((batch.start[at] < end) & (batch.end[at] > start))
            if draw.random() < 0.5:
                batch.listed(int(inside[0]), int(inside[-1]))
            for i in inside.tolist():
                if draw.random() < 0.7 and types.pieces[batch.types[i]].title() in nouns:
                    batch.noun(i)
    # unlisted by draw: the token's class becomes that of a rare word of its case
    hidden = np.array([CLASS_ID["rare:" + c.split(":")[1]] if c.split(":")[0] in ("given", "both", "family", "proper") else i for i, c in enumerate(CLASSES)])
    drop = draw.random(batch.size) < 0.3
    batch.classes = np.where(drop, hidden[batch.classes], batch.classes)

    numbers: dict[tuple, int] = {}
    number = lambda *key: numbers.setdefault(key, len(numbers))
    width = 18
    own_of: dict[tuple[int, int], list[int]] = {}
    near_of: dict[tuple[int, int], list[list[int]]] = {}
    real = np.flatnonzero(batch.real)
    kinds = batch.types * COUNT + batch.classes  # a type in its class, as drawn
    unique, inverse = np.unique(kinds, return_inverse=True)
    own_table, near_table = np.full((len(unique), width), -1), np.full((len(NEAR), len(unique), 3), -1)
    for k, kind in enumerate(unique.tolist()):
        type_, cls = divmod(kind, COUNT)
        piece = types.pieces[type_] or "edge"
        if type_:
            ids = [number("own", f) for f in own_features(piece, CLASSES[cls])]
            own_table[k, : len(ids)] = ids
        for d, offset in enumerate(NEAR):
            ids = [number("near", offset, f) for f in near_features(piece, CLASSES[cls])]
            near_table[d, k, : len(ids)] = ids
    columns = [own_table[inverse[real]], *(near_table[d][np.roll(inverse, -offset)[real]] for d, offset in enumerate(NEAR))]
    unseen = draw.random((len(NEAR), len(real))) < NEAR_DROPPED
    for d in range(len(NEAR)):  # the class of a neighbour stays, its word is hidden
        columns[1 + d][unseen[d], 1:] = -1
    base = len(numbers)
    sizes = table_sizes()
    for size, cells in zip(sizes, cells_of(batch)):
        columns.append((cells[real] + base)[:, None])
        base += size
    at, pairs = pairs_of(batch)
    pair_numbers = {p: base + i for i, p in enumerate(np.unique(pairs).tolist())}
    column = np.full(batch.size, -1)
    column[at] = [pair_numbers[p] for p in pairs.tolist()]
    columns += [column[real][:, None], np.roll(column, -1)[real][:, None]]
    base_next = base + len(pair_numbers)  # a pair seen from its first character has the number after those of all pairs
    columns[-1] = np.where(columns[-1] >= 0, columns[-1] + len(pair_numbers), -1)
    base_marks = base_next + len(pair_numbers)
    mark_numbers: dict[str, int] = {}
    rows: dict[int, list[int]] = {}
    kept = np.repeat(draw.random(len(batch.matches) - 1) < 0.95, np.diff(batch.matches))
    for (token, features), keep in zip(batch.marks, kept):
        if keep:
            rows.setdefault(token, []).extend(base_marks + mark_numbers.setdefault(f, len(mark_numbers)) for f in features)
    columns = [c.astype(np.int32) for c in columns]

    def ids_of(part: slice) -> np.ndarray:
        """Numbers of the features of some tokens, filled up with -1."""
        found = [rows.get(token, ()) for token in real[part].tolist()]
        marked = np.full((len(found), max(map(len, found), default=0)), -1, dtype=np.int32)
        for k, ids in enumerate(found):
            marked[k, : len(ids)] = ids
        return np.concatenate([*(c[part] for c in columns), marked], axis=1)

    # features seen once or twice teach nothing for other texts; the others are numbered from 1 on, those of marks last
    parts = [slice(at, at + 10_000) for at in range(0, len(real), 10_000)]
    counts = np.zeros(base_marks + len(mark_numbers) + 1, dtype=np.int64)
    for part in parts:
        counts += np.bincount(ids_of(part).ravel() + 1, minlength=len(counts))
    often = counts[1:] >= 3
    compact = (np.cumsum(often) * often).astype(np.int32)
    total, sure = int(compact.max()) + 1, int(compact[:base_marks].max()) + 1
    flat_of, sizes_of = [], []
    for part in parts:
        ids = ids_of(part)
        ids = np.where(ids >= 0, compact[ids], 0)
        sizes_of.append((ids > 0).sum(axis=1))
        flat_of.append(ids[ids > 0])
    flat_of, sizes_of = np.concatenate(flat_of), np.concatenate(sizes_of)  # features of a token, one after the other
    start_of = np.concatenate([[0], np.cumsum(sizes_of)])
    del columns

    count = len(LABELS)
    place = np.full(batch.size, -1)
    place[real] = np.arange(len(real))
    first, length = place[batch.first], batch.length
    first = np.where(length > 0, first, 0)
    y = labels[real]
    agree = np.zeros((len(real), count))
    a, b = place[batch.edges[:, 0]], place[batch.edges[:, 1]]
    np.add.at(agree, (a, y[b]), 1)
    np.add.at(agree, (b, y[a]), 1)
    weights, skip, free = np.zeros((total, count)), np.zeros((count, count)), np.zeros((count, count))
    moves = allowed_moves()
    squares = [np.full_like(w, 1e-2) for w in (weights, skip, free)]
    sums, steps = [np.zeros_like(w) for w in (weights, skip, free)], 0
    for turn in range(rounds):
        order = draw.permutation(np.flatnonzero(length > 0))
        for part in range(0, len(order), 128):
            docs = order[part : part + 128]
            sizes_ = length[docs]
            starts = np.concatenate([[0], np.cumsum(sizes_)[:-1]])
            take = np.repeat(first[docs] - starts, sizes_) + np.arange(sizes_.sum())
            amount = sizes_of[take]
            begin = np.concatenate([[0], np.cumsum(amount)[:-1]])
            flat = flat_of[np.repeat(start_of[take] - begin, amount) + np.arange(amount.sum())]
            flat[(draw.random(len(flat)) < DROPPED) & (flat < sure)] = 0
            scores = np.add.reduceat(weights[flat], begin, axis=0) + agree[take] @ skip
            chain = free + moves
            forward, backward, potential = chain_sums(scores, starts, sizes_, chain)
            p = forward * backward
            p /= p.sum(axis=1, keepdims=True)
            error = p.copy()
            error[np.arange(len(take)), y[take]] -= 1
            later = np.ones(len(take), dtype=bool)
            later[starts] = False
            later = np.flatnonzero(later)
            left, right, move = forward[later - 1], potential[later] * backward[later], np.exp(chain)
            z = ((left @ move) * right).sum(axis=1, keepdims=True)
            expected = move * ((left / z).T @ right)
            seen = np.zeros((count, count))
            np.add.at(seen, (y[take[later - 1]], y[take[later]]), 1)
            owner = np.repeat(np.arange(len(take)), amount)
            gradient = np.stack([np.bincount(flat, weights=error[owner, k], minlength=total) for k in range(count)], axis=1)
            gradient[0] = 0
            pulls = agree[take].T @ error
            for w, g, s in zip((weights, skip, free), (gradient, (pulls + pulls.T) / 2, expected - seen), squares):
                s += g**2
                w -= rate * g / np.sqrt(s) + decay * w
            if 2 * turn >= rounds:  # the weights are the mean over the second half
                steps += 1
                for w, total_ in zip((weights, skip, free), sums):
                    total_ += w
    weights, skip, free = (t / max(steps, 1) for t in sums)
    unpack = {n: weights[compact[n]] for n in np.flatnonzero(compact).tolist()}
    own, near = {}, {}
    for key, n in numbers.items():
        if n in unpack and key[0] == "own":
            own[key[1]] = unpack[n]
        elif n in unpack:
            near.setdefault(key[2], np.zeros((len(NEAR), count)))[NEAR.index(key[1])] = unpack[n]
    tables, base = [], len(numbers)
    for size in sizes:
        table = np.zeros((size, count), dtype=np.float32)
        for n in range(base, base + size):
            if n in unpack:
                table[n - base] = unpack[n]
        tables.append(table)
        base += size
    text_of = lambda p: types.pieces[p >> 32] + types.pieces[p & 0xFFFFFFFF]
    none = np.zeros(count)
    paired = {text_of(p): np.stack([unpack.get(n, none), unpack.get(n + len(pair_numbers), none)]) for p, n in pair_numbers.items() if n in unpack or n + len(pair_numbers) in unpack}
    marks = {f: unpack[base_marks + n] for f, n in mark_numbers.items() if base_marks + n in unpack}
    return Field(known, own, near, marks, paired, tables, free + moves, skip)


# ---------------------------------------------------------------- exact checks
_INITIAL = re.compile(r"[^\W\d_]\.?$")


def checked(kind: str, text: str) -> bool:
    """Whether a labelled string has what a mention of its kind must have."""
    digits = sum(c.isdigit() for c in text)
    if kind == "person":
        if re.fullmatch(rf"[{CHINESE}]{{2,4}}", text):
            return True
        parts = [p for p in re.findall(r"[^\W\d_]+(?:['’][^\W\d_]+)*", text) if p.lower() not in PARTICLES]
        return not digits and len(parts) >= 2 and any(len(p) > 1 for p in parts) and "\n" not in text
    if kind == "email":
        return bool(re.search(r"[@＠]|\bat\b|\barroba\b|ät", text, re.I)) and text.rsplit(".", 1)[-1].lower() not in FILES
    if kind == "phone":
        return 7 <= digits <= 16 and re.fullmatch(r"[+(]?[\d().+/\s-]+\d", text) is not None
    if kind == "idno":
        return digits >= 6 and re.fullmatch(r"[^\W_](?:[^\W_]|[ ./-]){5,28}", text) is not None
    return digits >= 1 and "\n" not in text and (re.search(f"[{CHINESE}]", text) is not None or _STREET_HINT.search(text) is not None)


class Finder:
    """Mentions of texts by a trained field; what a token type weighs is kept from batch to batch."""

    def __init__(self, field: Field, titles: list[str] = ()):
        self.field, self.titles = field, titles
        self.fresh()

    def __getstate__(self):
        return {"field": self.field, "titles": self.titles}

    def __setstate__(self, state):
        self.__init__(**state)

    def fresh(self) -> None:
        count = len(LABELS)
        self.types = Types(self.field.known, sorted({title_tokens(t) for t in self.titles}))
        self.own, self.near = np.zeros((1024, count), np.float32), np.zeros((len(NEAR), 1024, count), np.float32)
        self.weighed = 0

    def weigh(self) -> None:
        """Sums up the weights of types that are new."""
        size = len(self.types.pieces)
        if size > len(self.own):
            grown = max(size, 2 * len(self.own))
            self.own = np.concatenate([self.own, np.zeros((grown - len(self.own), len(LABELS)), np.float32)])
            self.near = np.concatenate([self.near, np.zeros((len(NEAR), grown - self.near.shape[1], len(LABELS)), np.float32)], axis=1)
        for type_ in range(self.weighed, size):
            piece, cls = self.types.pieces[type_] or "edge", CLASSES[self.types.classes[type_]]
            if type_:
                for f in own_features(piece, cls):
                    if (w := self.field.own.get(f)) is not None:
                        self.own[type_] += w
            for f in near_features(piece, cls):
                if (w := self.field.near.get(f)) is not None:
                    self.near[:, type_] += w
        self.weighed = size

    def scores(self, batch: Batch) -> np.ndarray:
        self.weigh()
        out = self.own[batch.types].astype(np.float64)
        for d, offset in enumerate(NEAR):
            out += self.near[d][np.roll(batch.types, -offset)]
        for table, cells in zip(self.field.tables, cells_of(batch)):
            out += table[cells]
        at, pairs = pairs_of(batch)
        pieces = self.types.pieces
        for token, pair in zip(at.tolist(), pairs.tolist()):
            if (w := self.field.pairs.get(pieces[pair >> 32] + pieces[pair & 0xFFFFFFFF])) is not None:
                out[token] += w[0]
                out[token - 1] += w[1]
        if batch.marks:
            known, none = self.field.marks, np.zeros(len(LABELS))
            numbers: dict[tuple[str, ...], int] = {}
            which = np.array([numbers.setdefault(features, len(numbers)) for _, features in batch.marks])
            sums = np.stack([sum((known[f] for f in features if f in known), none) for features in numbers])
            np.add.at(out, np.array([token for token, _ in batch.marks]), sums[which])
        out[batch.known_names, 1:3] += KNOWN_NAME
        return out

    def mentions(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Per text the (start, end, kind) of its mentions in order."""
        if len(self.types.pieces) > TYPES_KEPT:
            self.fresh()
        batch = Batch([t or "" for t in texts], self.types)
        shares = marginals(self.scores(batch), batch.first, batch.length, batch.edges, self.field.chain, self.field.skip)
        labels = np.where(batch.real, shares.argmax(axis=1), 0)
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        found = np.flatnonzero(labels > 0)
        if not len(found):
            return out
        kinds = (labels[found] - 1) // 2
        begins = np.concatenate([[True], (np.diff(found) > 1) | (labels[found][1:] % 2 == 1) | (np.diff(kinds) != 0)])
        heads = np.flatnonzero(begins)
        tails = np.append(heads[1:], len(found)) - 1
        docs = np.searchsorted(batch.first, found[heads], side="right") - 1
        for head, tail, doc in zip(heads, tails, docs):
            kind, text = KINDS[kinds[head]], batch.texts[doc]
            start, end = int(batch.start[found[head]]), int(batch.end[found[tail]])
            for line in re.finditer(r"[^\n]+", text[start:end]):  # a mention does not go on in another line
                part = line[0].strip()
                low = start + line.start() + line[0].index(part)
                if part and checked(kind, part):
                    out[doc].append((low, low + len(part), kind))
        return out


PLACEHOLDERS = {"person": "[PERSON]", "email": "[EMAIL]", "phone": "[PHONE]", "idno": "[IDNO]", "street": "[STREET]"}


def redacted(text: str, mentions: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for start, end, kind in mentions:
        if start >= at:
            out += [text[at:start], PLACEHOLDERS[kind]]
            at = end
    return "".join([*out, text[at:]])


@lru_cache(maxsize=2)
def trained(vocabulary: str) -> Field:
    """The field, trained once in a driver."""
    return train(vocabulary=vocabulary)


def in_batches(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts): parts of at most LETTERS_A_BATCH letters, or one longer text."""
    first = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text or "") > LETTERS_A_BATCH:
            yield first, texts[first:k]
            first, size = k, 0
        size += len(text or "")
    if first < len(texts):
        yield first, texts[first:]


#: names of applications are a small dimension; more than this are refused
MOST_TITLES = 200_000


def _finder(documents: DataFrame, apps: DataFrame | None, vocabulary: str) -> Callable[[], Finder]:
    titles = [] if apps is None else [r[0] for r in bounded(apps.select(F.col("app_title").cast("string")).filter("app_title is not null").distinct(), MOST_TITLES, "names of applications")]
    return ship(documents.sparkSession, Finder(trained(vocabulary), sorted(titles)))


def find_mentions(documents: DataFrame, apps: DataFrame | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, pii_kind, pii_text, start): every mention with its place. apps names applications, which are no persons."""
    shared = _finder(documents, apps, vocabulary)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = shared()
        for batch in batches:
            for first, part in in_batches(batch["text"].tolist()):
                ids = batch["doc_id"].iloc[first : first + len(part)]
                rows = [(d, kind, text[s:e], s) for d, text, spans in zip(ids, part, finder.mentions(part)) for s, e, kind in spans]
                yield pd.DataFrame(rows, columns=["doc_id", "pii_kind", "pii_text", "start"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    return spread_small(texts).mapInPandas(search, "doc_id long, pii_kind string, pii_text string, start int")


def redact(documents: DataFrame, apps: DataFrame | None = None, column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with placeholders instead of the mentions in a column."""
    shared = _finder(documents, apps, vocabulary)

    def replace(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = shared()
        for texts in batches:
            out = []
            for _, part in in_batches(texts.tolist()):
                out += [t if t is None else redacted(t, spans) for t, spans in zip(part, finder.mentions(part))]
            yield pd.Series(out, dtype=object)

    # the type hints are strings here, so the kind of the function is named
    return spread_small(documents).withColumn(column, F.pandas_udf(replace, "string", F.PandasUDFType.SCALAR_ITER)(F.col(column).cast("string")))
