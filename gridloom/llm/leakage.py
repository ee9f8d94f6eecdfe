"""Evaluation texts that leak into a training corpus, found by latent semantic retrieval.

1. Held-out items are normalised and cut into overlapping passages. Their terms are the vocabulary; document
   frequencies of these terms come from one pass over all documents.
2. A randomised SVD of the TF-IDF matrix of the passages gives the latent space: the products with the Gram matrix are sums over the
   partitions of a distributed table, with oversampling and POWER_STEPS power steps.
3. The latent passages are indexed in lists around centroids. Documents are cut into passages twice as long, so that a
   shortest leak lies whole in one of them, folded into the space, and compared with the item passages of the lists nearest to them. A bound
   on the cosine, exact for each passage, spares passages that cannot reach the threshold.
   What it brings is not complete for verbatim leaks, as the words around a run may outweigh it. So each run of the
   required length is also looked up among the runs of all items, and its passage is a candidate whatever its cosine.
4. Candidates are checked: a run of consecutive words (or, for Chinese, letters) of the required length is a verbatim leak, else
   a long common subsequence that also holds the rarest terms of the item passage (its answer) is a paraphrase.

Both passes over the documents are maps; nothing of a document is shuffled but the pairs found. The held-out items are
a bounded query set. They are cut into blocks of bounded passages and terms; a task takes each batch of documents through
the blocks one after the other, so the corpus is read twice however many blocks there are (up to MOST_TERMS terms, beyond which
the items are worked off in groups of so many terms).

Defined results for odd input
-----------------------------
* null, empty or blank texts and texts shorter than the shortest leak: no pair. Null ids: ignored.
* an item counts as Chinese if its lang begins with zh; without lang, if most of its letters are Chinese characters.
* repeated documents or items of one id: a pair comes out once, with its best figures.
* empty tables: empty result. Extra columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.layout import ship, spread_small

WORDS_RUN, LETTERS_RUN = 12, 40
RANK, OVERSAMPLING, POWER_STEPS = 384, 32, 2
THRESHOLD = 0.35
#: a block of items ends with so many passages or terms; an item longer than SEGMENT words or letters is several segments
PASSAGES_A_BLOCK, TERMS_A_BLOCK, SEGMENT = 50_000, 100_000, 50_000
MOST_TERMS = 2_000_000
LETTER_GRAM = 3
PASSAGES_A_TASK = 1024
#: one of so many lists of the index is looked through for a passage, and at least LEAST_LISTS
LISTS_SHARE, LEAST_LISTS = 6, 6
PIECES_A_SUM = 1024
#: terms that are searched at once; longer documents are taken in overlapping parts of PIECES_A_PART runs
TERMS_A_SEARCH, PIECES_A_PART = 40_000, 3000
LCS_SHARE = 0.75
ANSWER_TERMS = 2
SEED = 7

INLINE_TAG = r"</?(?:a|abbr|b|big|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>"
ANY_TAG = r"<!--.*?-->|</?[A-Za-z][^<>]*>|<[0-9]+>"
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
MARKS = "̀-ͯ҃-҇᪰-᫿᷀-᷿⃐-⃿゙゚︠-︯"
CHINESE = "㐀-䶿一-鿿豈-﫿"


def plain(text: str) -> str:
    """The text without case, accents, width, invisible characters, tags and entities."""
    if "<" in text:
        text = re.sub(ANY_TAG, " ", re.sub(INLINE_TAG, "", text, flags=re.I), flags=re.S)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if not text.isascii():
        text = re.sub(f"[{INVISIBLE}{MARKS}]", "", unicodedata.normalize("NFKD", text))
    return text.casefold()


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", plain(text))


def letters_of(words: list[str]) -> str:
    return "".join(words)


def is_chinese(lang: str | None, text: str) -> bool:
    if lang:
        return lang.strip().lower().startswith("zh")
    letters = letters_of(words_of(text))
    return 2 * len(re.findall(f"[{CHINESE}]", letters)) > len(letters)


def grams_of(letters: str) -> list[str]:
    """Terms of a run of letters; the blank keeps them apart from words."""
    return [" " + letters[i : i + LETTER_GRAM] for i in range(len(letters) - LETTER_GRAM + 1)]


def windows(size: int, length: int, step: int) -> list[int]:
    """Starts of passages of a length that cover a sequence of a size; the last one is flush with the end."""
    if size <= length:
        return [0]
    starts = list(range(0, size - length + 1, step))
    return starts if starts[-1] + length == size else [*starts, size - length]


class Block:
    """Items of a block: their segments, passages and vocabulary, and, once weighed, what a task needs to search for them."""

    def __init__(self):
        self.items: list[int] = []  # the item of each segment
        self.sequences: list[list[str] | str] = []
        self.owner: list[int] = []  # the segment of each passage
        self.starts: list[int] = []
        self.passages: list[list[str]] = []
        self.vocabulary: dict[str, int] = {}

    def add(self, item: int, sequence: list[str] | str) -> None:
        """Adds a segment: words, or the letters of a Chinese item."""
        size = LETTERS_RUN if isinstance(sequence, str) else WORDS_RUN
        segment = len(self.items)
        self.items.append(item)
        self.sequences.append(sequence)
        for start in windows(len(sequence), size, size // 2):
            part = sequence[start : start + size]
            self.owner.append(segment)
            self.starts.append(start)
            self.passages.append(grams_of(part) if isinstance(part, str) else list(part))
            for term in self.passages[-1]:
                self.vocabulary.setdefault(term, len(self.vocabulary))

    def full(self) -> bool:
        return len(self.owner) >= PASSAGES_A_BLOCK or len(self.vocabulary) >= TERMS_A_BLOCK

    def terms(self) -> list[np.ndarray]:
        return [np.array([self.vocabulary[t] for t in p], dtype=np.int64) for p in self.passages]


def segments_of(rows: Iterator[tuple[int, str, str | None]]) -> Iterator[tuple[int, list[str] | str]]:
    """(item, words or letters): the items long enough for a leak, long ones in overlapping segments."""
    for item, text, lang in rows:
        words = words_of(text)
        sequence = letters_of(words) if is_chinese(lang, text) else words
        size = LETTERS_RUN if isinstance(sequence, str) else WORDS_RUN
        if len(sequence) >= size:
            for start in range(0, max(len(sequence) - size, 0) + 1, SEGMENT):
                yield item, sequence[start : start + SEGMENT + size - 1]


def blocks_of(rows: Iterator[tuple[int, str, str | None]]) -> Iterator[Block]:
    block = Block()
    for item, sequence in segments_of(rows):
        block.add(item, sequence)
        if block.full():
            yield block
            block = Block()
    if block.items:
        yield block


class Reader:
    """Reads documents as numbers of the terms of all items."""

    def __init__(self, blocks: list[Block]):
        self.vocabulary: dict[str, int] = {}
        for block in blocks:
            for term in block.vocabulary:
                self.vocabulary.setdefault(term, len(self.vocabulary))
        letters = [s for b in blocks for s in b.sequences if isinstance(s, str)]
        self.any_letters, self.any_words = bool(letters), any(isinstance(s, list) for b in blocks for s in b.sequences)
        # Chinese items are looked for only in texts with a Chinese character, if each of their runs has one.
        self.need_chinese = all(re.search(f"[{CHINESE}]", s[i : i + LETTERS_RUN]) for s in letters for i in range(len(s) - LETTERS_RUN + 1))

    def __call__(self, text: str) -> tuple[list[str], str]:
        """The words and, if Chinese items may stand in it, the letters of a document."""
        words = words_of(text)
        letters = letters_of(words) if self.any_letters else ""
        return words if self.any_words else [], letters if letters and (not self.need_chinese or re.search(f"[{CHINESE}]", letters)) else ""

    def numbers(self, terms: list[str]) -> np.ndarray:
        """The number of each term, -1 for a term of no item."""
        get = self.vocabulary.get
        return np.array([get(t, -1) for t in terms], dtype=np.int64)


def document_frequencies(texts: DataFrame, reader: Reader) -> tuple[np.ndarray, int]:
    """In how many documents each term of the items stands, and how many documents there are."""
    shared, size = ship(texts.sparkSession, reader), len(reader.vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = shared()
        found, total = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                total += 1
                words, letters = read(text)
                ids = read.numbers([*set(words), *set(grams_of(letters))])
                found[ids[ids >= 0]] += 1
        at = np.flatnonzero(found)
        yield pd.DataFrame({"term": np.append(at, -1), "n": np.append(found[at], total)})

    counts = texts.select("text").mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    known = counts[counts["term"] >= 0]
    out[known["term"].to_numpy()] = known["n"].to_numpy()
    return out, int(counts.loc[counts["term"] < 0, "n"].sum())


def unit_rows(terms: list[np.ndarray], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(columns, values) of unit-length TF-IDF rows."""
    rows = []
    for ids in terms:
        unique, n = np.unique(ids, return_counts=True)
        weights = idf[unique] * n
        norm = np.sqrt((weights**2).sum())
        rows.append((unique, weights / norm if norm else weights))
    return rows


def gram_product(passages: DataFrame, right: np.ndarray, rows_a_block: int = 256) -> np.ndarray:
    """A'A times a matrix, A having the sparse rows (columns, values) of a distributed table."""
    width = right.shape[1]
    shared = ship(passages.sparkSession, right)

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        right = shared()
        total = np.zeros(right.shape, dtype=np.float32)
        touched = np.zeros(len(right), dtype=bool)
        for batch in batches:
            for columns, values in zip(batch["columns"], batch["values"]):
                columns, values = np.asarray(columns), np.asarray(values, dtype=np.float32)
                total[columns] += np.outer(values, values @ right[columns])
                touched[columns] = True
        for start in range(0, len(total), rows_a_block):
            rows = start + np.flatnonzero(touched[start : start + rows_a_block])
            if len(rows):
                yield pd.DataFrame({"block": [start], "rows": [rows.astype(np.int64).tobytes()], "data": [total[rows].tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        start = int(group["block"].iloc[0])
        total = np.zeros((rows_a_block, width))
        for rows, data in zip(group["rows"], group["data"]):
            total[np.frombuffer(rows, dtype=np.int64) - start] += np.frombuffer(data, dtype=np.float32).reshape(-1, width)
        rows = np.flatnonzero(total.any(axis=1))
        return pd.DataFrame({"block": [start], "rows": [(rows + start).tobytes()], "data": [total[rows].astype(np.float32).tobytes()]})

    schema = "block long, rows binary, data binary"
    out = np.zeros(right.shape, dtype=np.float32)
    for row in passages.mapInPandas(part, schema).groupBy("block").applyInPandas(add, schema).toLocalIterator():
        out[np.frombuffer(row["rows"], dtype=np.int64)] = np.frombuffer(row["data"], dtype=np.float32).reshape(-1, width)
    return out


def latent_space(passages: DataFrame, terms: int, rank: int, seed: int = SEED) -> np.ndarray:
    """The leading right singular vectors of the passages (terms x rank) by a randomised SVD with oversampling and power steps."""
    width = min(rank + OVERSAMPLING, terms)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))[0].astype(np.float32)
    for _ in range(POWER_STEPS):
        basis = np.linalg.qr(gram_product(passages, basis))[0].astype(np.float32)
    values, rotation = np.linalg.eigh(basis.T @ gram_product(passages, basis))
    leading = np.argsort(-values)[: min(rank, terms)]
    leading = leading[values[leading] > max(values.max(), 0) * 1e-6]
    return (basis @ rotation[:, leading]).astype(np.float32)


def centroids_of(points: np.ndarray, rounds: int = 8, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, list of each point): as many lists as the root of the number of points, by spherical k-means."""
    count = max(1, int(np.sqrt(len(points))))
    centroids = points[np.random.default_rng(seed).choice(len(points), count, replace=False)]
    for _ in range(rounds):
        nearest = (points @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, points)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centroids)
    return centroids, (points @ centroids.T).argmax(axis=1)


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence, with a bit for each element of a."""
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = state = (1 << len(a)) - 1
    for y in b:
        common = state & masks.get(y, 0)
        state = (state + common | state - common) & full
    return len(a) - state.bit_count()


class Searcher:
    """What a task needs to search documents for the items of a block."""

    def __init__(self, block: Block, idf: np.ndarray, space: np.ndarray, threshold: float, numbers: np.ndarray, lists_share: int = LISTS_SHARE):
        self.threshold, self.numbers, self.lists_share = threshold, numbers, lists_share  # numbers: of the block's terms among those of all items
        self.items, self.sequences = np.array(block.items), block.sequences
        self.owner, self.starts = np.array(block.owner), np.array(block.starts)
        terms = block.terms()
        latent = np.stack([values.astype(np.float32) @ space[columns] for columns, values in unit_rows(terms, idf)])
        norms = np.linalg.norm(latent, axis=1, keepdims=True)
        latent = latent / np.where(norms > 0, norms, 1)
        self.letters = np.array([isinstance(block.sequences[o], str) for o in block.owner])
        self.idf = np.append(idf, 0.0)  # the last row is that of all other terms
        self.greatest = np.zeros(len(idf) + 1, dtype=np.float32)
        for at in range(0, len(idf), 512):
            self.greatest[at : min(at + 512, len(idf))] = np.abs(space[at : at + 512] @ latent.T).max(axis=1)
        size = max(map(len, terms))
        self.terms = np.full((len(terms), size), -1)  # of each passage in order, filled up with -1
        self.answers = np.full((len(terms), ANSWER_TERMS), -1)
        for k, ids in enumerate(terms):
            self.terms[k, : len(ids)] = ids
            rare = np.unique(ids)
            rare = rare[np.argsort(-idf[rare], kind="stable")[:ANSWER_TERMS]]
            self.answers[k, : len(rare)] = rare
        # Sent in half precision, which is finer than the threshold's margin.
        self.space, self.latent = space.astype(np.float16), latent.astype(np.float16)

    def prepare(self) -> None:
        """What is made in the task, as it is large when sent: single precision, the lists of the index, and the runs of the items."""
        self.space, self.latent = np.concatenate([self.space, self.space[:1] * 0]).astype(np.float32) * self.idf[:, None].astype(np.float32), self.latent.astype(np.float32)
        self.lists = []
        for of_letters in (False, True):
            members = np.flatnonzero(self.letters == of_letters)
            if not len(members):
                self.lists.append(None)
                continue
            centroids, nearest = centroids_of(self.latent[members])
            order = np.argsort(nearest, kind="stable")
            self.lists.append((centroids, members[order], np.concatenate([[0], np.cumsum(np.bincount(nearest, minlength=len(centroids)))])))
        place = {int(n): k for k, n in enumerate(self.numbers)}
        self.place = np.full(max(place, default=0) + 2, -1)
        self.place[list(place)] = list(place.values())
        vocabulary_of = {False: {}, True: {}}
        for passage, ids in enumerate(self.terms):
            segment, start = self.owner[passage], self.starts[passage]
            sequence, size = self.sequences[segment], LETTERS_RUN if self.letters[passage] else WORDS_RUN
            part = grams_of(sequence[start : start + size]) if self.letters[passage] else sequence[start : start + size]
            vocabulary_of[bool(self.letters[passage])].update(zip(part, ids.tolist()))
        self.runs = {}
        for of_letters in (False, True):
            found, flat, offset = [], [np.zeros(0, np.int64)], 0
            for segment, sequence in enumerate(self.sequences):
                if isinstance(sequence, str) == of_letters:
                    terms = grams_of(sequence) if of_letters else sequence
                    ids = np.array([vocabulary_of[of_letters][t] for t in terms], dtype=np.int64)
                    codes = run_codes(ids, LETTERS_RUN - LETTER_GRAM + 1 if of_letters else WORDS_RUN)
                    found.append(np.stack([codes, np.full(len(codes), segment), offset + np.arange(len(codes))], axis=1))
                    flat.append(ids)
                    offset += len(ids)
            table = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            table = table[np.argsort(table[:, 0], kind="stable")]
            self.runs[of_letters] = (table[:, 0], table[:, 1], table[:, 2], np.concatenate(flat))

    def held(self, ids: np.ndarray, of_letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """(place, segment): where a run of a segment begins in a sequence of terms, looked up by its code and compared term by term."""
        codes, segments, starts, flat = self.runs[of_letters]
        size = LETTERS_RUN - LETTER_GRAM + 1 if of_letters else WORDS_RUN
        if not len(codes) or len(ids) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        whole = known[size:] - known[:-size] == size
        if not whole.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        here = run_codes(ids, size)
        low, high = np.searchsorted(codes, here), np.searchsorted(codes, here, side="right")
        at = np.flatnonzero(whole & (high > low))
        times = (high - low)[at]
        first = np.repeat(low[at] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
        at = np.repeat(at, times)
        steps = np.arange(size)
        same = (ids[at[:, None] + steps] == flat[starts[first][:, None] + steps]).all(axis=1)
        return at[same], segments[first][same]

    def folded(self, ids: np.ndarray, cuts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Sums of the weighted latent terms of the wanted pieces of a row of terms; cuts are the piece borders."""
        out = np.zeros((len(wanted), self.space.shape[1]), dtype=np.float32)
        none = len(self.space) - 1
        for at in range(0, len(wanted), PIECES_A_SUM):
            part = out[at : at + PIECES_A_SUM]
            begin, end = cuts[wanted[at : at + PIECES_A_SUM]], cuts[wanted[at : at + PIECES_A_SUM] + 1]
            for k in range(int((end - begin).max())):
                term = np.where(begin + k < end, ids[np.minimum(begin + k, len(ids) - 1)], -1)
                part += self.space[np.where(term < 0, none, term)]
        return out

    def search(self, sequences: list[tuple[int, str | None, np.ndarray]], found: dict[tuple[int, int], list]) -> None:
        """Adds (document, item) -> [kind, share, cosine] of documents given as (row, letters or None for words, terms)."""
        for of_letters in (False, True):
            chosen = [(row, letters, self.place[np.minimum(ids, len(self.place) - 1)]) for row, letters, ids in sequences if (letters is not None) == of_letters]
            if chosen and self.lists[of_letters] is not None:
                self._search(chosen, of_letters, found)

    def _search(self, chosen: list[tuple[int, str | None, np.ndarray]], of_letters: bool, found: dict) -> None:
        size = LETTERS_RUN if of_letters else WORDS_RUN
        # pieces of a run's length; a passage is two of them in a row
        rows, ids, cuts, first, second, spans, places = [], [], [0], [], [], [], []
        verbatim: dict[int, set[int]] = {}
        for number, (row, _, terms) in enumerate(chosen):
            length = len(terms) + (LETTER_GRAM - 1 if of_letters else 0)
            if length < size:
                continue
            at, segments = self.held(terms, of_letters)
            for k, segment in zip((at // size).tolist(), segments.tolist()):
                verbatim.setdefault(len(rows) + k, set()).add(segment)
            base, offset = len(cuts) - 1, cuts[-1]
            pieces = -(-len(terms) // size)
            cuts += [offset + min((k + 1) * size, len(terms)) for k in range(pieces)]
            for k in range((length - size) // size + 1):
                rows.append(row)
                places.append((number, k * size))
                first.append(base + k)
                second.append(base + k + 1 if k + 1 < pieces else -1)
                spans.append((offset + k * size, offset + min((k + 2) * size, len(terms))))
            ids.append(terms)
        if not rows:
            return
        ids, cuts, first, second, spans = np.concatenate(ids), np.array(cuts), np.array(first), np.array(second), np.array(spans)
        weights = self.idf[ids]
        sums = lambda x: np.add.reduceat(np.append(x, 0.0), cuts[:-1])
        both = lambda x: x[first] + np.where(second >= 0, x[second], 0)
        # No norm is below that of its terms taken one by one, so this bound is never below the cosine.
        bound = both(sums(weights * self.greatest[ids])) / np.sqrt(np.maximum(both(sums(weights**2)), 1e-12))
        keep = bound >= self.threshold - 1e-3
        keep[list(verbatim)] = True
        kept = np.flatnonzero(keep)
        if not len(kept):
            return
        # exact norms, with terms that come more than once
        length = spans[kept, 1] - spans[kept, 0]
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        tokens = ids[np.repeat(spans[kept, 0] - begin, length) + np.arange(length.sum())]
        keys, times = np.unique(np.repeat(np.arange(len(kept)), length) * (len(self.idf) + 1) + np.where(tokens < 0, len(self.idf), tokens), return_counts=True)
        owner, term = np.divmod(keys, len(self.idf) + 1)
        norms = np.sqrt(np.bincount(owner, weights=(np.append(self.idf, 0.0)[term] * times) ** 2, minlength=len(kept)))
        wanted = np.unique(np.concatenate([first[kept], second[kept][second[kept] >= 0]]))
        latent = self.folded(ids, cuts, wanted)
        place = np.full(len(cuts), len(wanted))
        place[wanted] = np.arange(len(wanted))
        latent = np.concatenate([latent, np.zeros_like(latent[:1])])
        queries = (latent[place[first[kept]]] + latent[np.where(second[kept] >= 0, place[second[kept]], len(wanted))]) / np.maximum(norms, 1e-9)[:, None].astype(np.float32)
        pairs = list(self.candidates(queries, of_letters))
        window, passage, cosine = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 3
        if verbatim:  # passages of the segments that a run was looked up for, whatever their cosine
            number = {int(w): k for k, w in enumerate(kept)}
            for w, segments in verbatim.items():
                for segment in segments:
                    self.note(found, rows[w], int(self.items[segment]), "verbatim", 1.0, 0.0)
        for w, p, c in zip(*self.greatest_of(window, self.owner[passage] if len(passage) else passage, cosine)):
            if self.items[p] in {self.items[s] for s in verbatim.get(int(kept[w]), ())}:
                self.note(found, rows[kept[w]], int(self.items[p]), "verbatim", 1.0, float(c))
        if not len(window):
            return
        # only passages whose rarest terms and enough other terms stand in the document's passage can be paraphrases
        answers, terms = self.answers[passage], self.terms[passage]
        there = lambda t: (keys[np.minimum(np.searchsorted(keys, window[:, None] * (len(self.idf) + 1) + t), len(keys) - 1)] == window[:, None] * (len(self.idf) + 1) + t) & (t >= 0)
        likely = (there(answers) | (answers < 0)).all(axis=1)
        window, passage, cosine, terms = window[likely], passage[likely], cosine[likely], terms[likely]
        # each of the letters left out spoils LETTER_GRAM grams at most, so this spares no passage that reaches the share
        amount = (terms >= 0).sum(axis=1)
        least = amount - LETTER_GRAM * ((1 - LCS_SHARE) * (amount + LETTER_GRAM - 1)) if of_letters else LCS_SHARE * amount
        likely = there(terms).sum(axis=1) >= least - 1e-9
        for w, p, c in zip(window[likely].tolist(), passage[likely].tolist(), cosine[likely].tolist()):
            item, segment = int(self.items[self.owner[p]]), self.owner[p]
            if of_letters:
                number, at = places[kept[w]]
                part, have = self.sequences[segment][self.starts[p] : self.starts[p] + size], chosen[number][1][at : at + 2 * size]
            else:
                part, have = self.terms[p][self.terms[p] >= 0].tolist(), ids[spans[kept[w], 0] : spans[kept[w], 1]].tolist()
            share = lcs_length(have, part) / len(part)
            if share >= LCS_SHARE:
                self.note(found, rows[kept[w]], item, "paraphrase", share, c)

    @staticmethod
    def greatest_of(window: np.ndarray, segment: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, segment, greatest cosine) of each pair."""
        order = np.lexsort((-cosine, segment, window))
        window, segment, cosine = window[order], segment[order], cosine[order]
        new = np.ones(len(window), dtype=bool)
        new[1:] = (window[1:] != window[:-1]) | (segment[1:] != segment[:-1])
        return window[new], segment[new], cosine[new]

    @staticmethod
    def note(found: dict, row: int, item: int, kind: str, share: float, cosine: float) -> None:
        best = found.setdefault((row, item), [kind, share, cosine])
        best[0], best[1], best[2] = max(best[0], kind), max(best[1], share), max(best[2], cosine)

    def candidates(self, queries: np.ndarray, of_letters: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, passage, cosine) of the passages at or over the threshold in the lists nearest to each query."""
        centroids, members, cuts = self.lists[of_letters]
        probes = min(len(centroids), max(LEAST_LISTS, -(-len(centroids) // self.lists_share)))
        near = queries @ centroids.T
        chosen = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < len(centroids) else np.tile(np.arange(len(centroids)), (len(queries), 1))
        asks = chosen.ravel()
        order = np.argsort(asks, kind="stable")
        asking = np.repeat(np.arange(len(queries)), probes)[order]
        bounds = np.searchsorted(asks[order], np.arange(len(centroids) + 1))
        for k in range(len(centroids)):
            rows, inside = asking[bounds[k] : bounds[k + 1]], members[cuts[k] : cuts[k + 1]]
            if len(rows) and len(inside):
                cosines = queries[rows] @ self.latent[inside].T
                i, j = np.nonzero(cosines >= self.threshold)
                yield rows[i], inside[j], cosines[i, j]


def run_codes(ids: np.ndarray, size: int) -> np.ndarray:
    """A code of 63 bits for each run of so many terms."""
    count = len(ids) - size + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(size):
        out = out * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + count]
    return (out >> np.uint64(1)).astype(np.int64)


def parts_of(row: int, letters: str | None, ids: np.ndarray) -> Iterator[tuple[int, str | None, np.ndarray]]:
    """A document as (row, letters or None for words, terms), a long one in parts that overlap by a passage, so that each passage lies whole in one."""
    size, more = (WORDS_RUN, 0) if letters is None else (LETTERS_RUN, LETTER_GRAM - 1)
    step = PIECES_A_PART * size
    for at in range(0, max(len(ids) - size, 0) + 1, step):
        end = at + step + 2 * size
        yield row, None if letters is None else letters[at : end + more], ids[at:end]


def at_once(sequences: list[tuple[int, str | None, np.ndarray]]) -> Iterator[list[tuple[int, str | None, np.ndarray]]]:
    """The sequences in lists of at most TERMS_A_SEARCH terms, or of one."""
    chosen, terms = [], 0
    for sequence in sequences:
        if chosen and terms + len(sequence[2]) > TERMS_A_SEARCH:
            yield chosen
            chosen, terms = [], 0
        chosen.append(sequence)
        terms += len(sequence[2])
    if chosen:
        yield chosen


def search_batches(batches: Iterator[pd.DataFrame], read: Reader, searchers: list[Callable[[], Searcher]]) -> Iterator[pd.DataFrame]:
    """The pairs of each batch of documents, taken through the blocks one after the other; one block is in memory at a time."""
    loaded, searcher = None, None
    for batch in batches:
        sequences = []
        for row, text in enumerate(batch["text"]):
            words, letters = read(text)
            if len(words) >= WORDS_RUN:
                sequences += parts_of(row, None, read.numbers(words))
            if len(letters) >= LETTERS_RUN:
                sequences += parts_of(row, letters, read.numbers(grams_of(letters)))
        ids = batch["doc_id"].tolist()
        for k, get in enumerate(searchers):
            if loaded != k:
                searcher = None
                loaded, searcher = k, get()
                searcher.prepare()
            found: dict[tuple[int, int], list] = {}
            for part in at_once(sequences):
                searcher.search(part, found)
            yield pd.DataFrame([(ids[row], item, *best) for (row, item), best in found.items()], columns=["doc_id", "item_id", "kind", "lcs_share", "cosine"])


FOUND = "doc_id long, item_id long, kind string, lcs_share double, cosine double"


def leaked_items(documents: DataFrame, items: DataFrame, rank: int = RANK, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, kind, lcs_share, cosine): the documents with the items that stand in them."""
    spark = documents.sparkSession
    texts = spread_small(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null"))
    rows = items.select(F.col("item_id").cast("long"), F.col("item_text").cast("string"), F.col("lang").cast("string")).filter("item_id is not null and item_text is not null").orderBy("item_id", "item_text", "lang")
    out, pending = None, []

    def add_group(out: DataFrame | None, blocks: list[Block]) -> DataFrame:
        reader = Reader(blocks)
        counts, total = document_frequencies(texts, reader)
        searchers = []
        for block in blocks:
            numbers = reader.numbers(list(block.vocabulary))
            idf = np.log((1 + total) / (1 + counts[numbers])) + 1e-3
            table = pd.DataFrame([(c.tolist(), v.tolist()) for c, v in unit_rows(block.terms(), idf)], columns=["columns", "values"])
            tasks = -(-len(table) // PASSAGES_A_TASK)
            passages = spark.createDataFrame(table, "columns array<int>, values array<double>").repartition(tasks)
            searchers.append(ship(spark, Searcher(block, idf, latent_space(passages, len(block.vocabulary), rank), threshold, numbers)))
        read = ship(spark, reader)
        found = texts.mapInPandas(lambda batches: search_batches(batches, read(), searchers), FOUND)
        return found if out is None else out.unionByName(found)

    terms = 0
    for block in blocks_of(tuple(r) for r in rows.toLocalIterator()):
        pending.append(block)
        terms += len(block.vocabulary)
        if terms >= MOST_TERMS:
            out, pending, terms = add_group(out, pending), [], 0
    if pending:
        out = add_group(out, pending)
    if out is None:
        return spark.createDataFrame([], FOUND)
    return out.groupBy("doc_id", "item_id").agg(F.max("kind").alias("kind"), F.max("lcs_share").alias("lcs_share"), F.max("cosine").alias("cosine"))
