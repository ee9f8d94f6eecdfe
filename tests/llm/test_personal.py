import re
from pathlib import Path

import numpy as np
import pytest

from gridloom.llm import names, personal, sentences
from gridloom.llm.personal import Finder, checked, find_mentions, forms_in, marginals, redact, redacted, trained

HAND = Path(__file__).with_name("personal_sentences.txt")


@pytest.fixture(scope="module")
def finder():
    return Finder(trained(personal.VOCABULARY))


def kinds(finder, text):
    return [(kind, text[s:e]) for s, e, kind in finder.mentions([text])[0]]


def hand_written():
    """(text, mentions) of the sentences in the file; a mention stands there as [[kind|text]]."""
    for line in HAND.read_text().splitlines():
        text, want = "", set()
        for part in re.split(r"(\[\[.*?\]\])", line):
            if part.startswith("[["):
                kind, value = part[2:-2].split("|")
                want.add((len(text), len(text) + len(value), kind))
                text += value
            else:
                text += part
        yield text, want


def test_sentences_written_by_hand(finder):
    hit = false = missed = 0
    for text, want in hand_written():
        got = set(finder.mentions([text])[0])
        hit, false, missed = hit + len(want & got), false + len(got - want), missed + len(want - got)
    assert hit / (hit + false) >= 0.9 and hit / (hit + missed) >= 0.9


def test_sentences_kept_out_of_training():
    """Every fifth training sentence and made noun is kept out; texts of the others train, texts of these test."""
    import random

    lines = {lang: [line for i, line in enumerate(block) if i % 5] for lang, block in sentences._LINES.items()}
    held = {lang: [line for i, line in enumerate(block) if not i % 5] for lang, block in sentences._LINES.items()}
    finder = Finder(personal.train(texts=3000, lines=lines))
    rng, hit, false, missed = random.Random(5), 0, 0, 0
    for _ in range(300):
        text, want, _ = sentences.text_of(rng, held)
        got = set(finder.mentions([text])[0])
        hit, false, missed = hit + len(set(want) & got), false + len(got - set(want)), missed + len(set(want) - got)
    assert hit / (hit + false) > 0.9 and hit / (hit + missed) > 0.9


def test_training_sentences_are_not_of_the_corpus():
    """No training sentence of some length stands in the test documents."""
    path = Path("/root/testdata/sf0.01/documents.parquet")
    if not path.exists():
        pytest.skip("no test tables")
    import pandas as pd

    corpus = "\n".join(pd.read_parquet(path, columns=["text"])["text"].dropna()).lower()
    for block in sentences._LINES.values():
        for line in block:
            pieces = [p for p in re.split(r"\{\w\}", line.lower()) if len(p) >= 16]
            assert not any(p in corpus for p in pieces), line


def test_checked():
    assert checked("person", "Ann Lee") and not checked("person", "Ann") and not checked("person", "l’hiver") and checked("person", "王小明")
    assert checked("phone", "+1 (212) 555-0187") and not checked("phone", "12-34") and not checked("phone", "<12><34><567>")
    assert checked("street", "7 Oak Lane") and not checked("street", "Oak")
    assert not checked("email", "pin@2x.png")


def test_forms_are_marks_of_their_strings():
    text = "mail a.b@c.example or 12 Oak Lane, tel 0161 496 0345"
    assert {(k, text[s:e]) for k, _, s, e in forms_in(text)} >= {("email", "a.b@c.example"), ("street", "12 Oak Lane"), ("phone", "0161 496 0345")}


def brute(scores, edges, chain, skip):
    n, count = scores.shape
    open_ = np.where(np.arange(count) % 2 == 0, personal.FORBIDDEN, 0.0)
    open_[0] = 0
    total = np.zeros_like(scores)
    for ys in np.ndindex(*[count] * n):
        weight = sum(scores[i, y] for i, y in enumerate(ys)) + open_[ys[0]] + sum(chain[a, b] for a, b in zip(ys, ys[1:])) + sum(skip[ys[a], ys[b]] for a, b in edges)
        for i, y in enumerate(ys):
            total[i, y] += np.exp(weight)
    return total / total.sum(axis=1, keepdims=True)


def test_chains_are_summed_exactly():
    rng = np.random.default_rng(2)
    scores, chain = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    found = marginals(scores, np.array([0, 4]), np.array([4, 3]), np.zeros((0, 2), int), chain, np.zeros((3, 3)))
    assert np.allclose(found[:4], brute(scores[:4], [], chain, None)) and np.allclose(found[4:], brute(scores[4:], [], chain, None))


def test_skip_messages_come_near_the_exact_sum():
    rng = np.random.default_rng(3)
    scores, chain, skip = rng.normal(size=(5, 3)), rng.normal(size=(3, 3)) / 2, np.eye(3) * 0.5
    found = marginals(scores, np.array([0]), np.array([5]), np.array([[0, 4]]), chain, skip)
    assert np.abs(found - brute(scores, [(0, 4)], chain, skip)).max() < 0.05


def test_a_repeated_name_is_pulled_along(finder):
    """A token in a poor context takes the label that its repetition has in a good one."""
    batch = personal.Batch(["Contact person: Oskar Brunnhild.\nBrunnhild, Oskar ok"], finder.types)
    assert len(batch.edges) >= 2 and finder.field.skip[1, 1] + finder.field.skip[2, 2] > finder.field.skip[0, 2]


def test_redaction_round_trip(finder):
    text = "Thanks, Julia Lindgren\n12 Old Mill Road | 0161 496 0345"
    found = finder.mentions([text])[0]
    out = redacted(text, found)
    assert out == "Thanks, [PERSON]\n[STREET] | [PHONE]"
    for start, end, kind in found:
        out = out.replace(personal.PLACEHOLDERS[kind], text[start:end], 1)
    assert out == text


def test_tables(spark, finder):
    rows = [(1, None, "k"), (2, "", "k"), (3, "  ", "k"), (4, "Dear Helen Bradford, hello", "k"), (4, "Dear Helen Bradford, hello", "k"), (None, "social security number 078-05-1120", "k"), (5, "No one was there. " * 20000 + "Dear Helen Bradford, hello", "k")]
    documents = spark.createDataFrame(rows, "doc_id long, text string, pii_kind string")
    apps = spark.createDataFrame([("a", "Helen Bradford Notes"), ("b", None), ("c", "")], "app_key string, app_title string")
    found = sorted((r.doc_id or 0, r.pii_kind, r.pii_text) for r in find_mentions(documents, apps).select("doc_id", "pii_kind", "pii_text").distinct().collect())
    assert found == [(0, "idno", "078-05-1120"), (4, "person", "Helen Bradford"), (5, "person", "Helen Bradford")]
    out = {(r.doc_id, (r.text or "")[-21:], r.pii_kind) for r in redact(documents).collect()}
    assert (4, "Dear [PERSON], hello", "k") in out and (1, "", "k") in out and len(out) == 6
    assert find_mentions(documents.filter("false")).count() == 0


def test_a_known_application_is_no_person():
    finder = Finder(trained(personal.VOCABULARY), ["Oskar Brunnhild"])
    assert kinds(finder, "Dear Oskar Brunnhild, hello") == []


def test_without_the_vocabulary_file():
    assert names.common_words("/no/such/file") == {}
