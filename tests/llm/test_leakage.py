import random

import numpy as np
import pytest

from gridloom.llm import leakage
from gridloom.llm.leakage import LETTERS_RUN, WORDS_RUN, is_chinese, lcs_length, leaked_items, letters_of, plain, windows, words_of

ITEM = "The reviewer kept the label in Q-4711 because the button row in Zorvane Ledger is only 93 pixels wide. On Tarn the Mukda team closed Q-8822."
CHINESE = "模型给祖尔返回三百五十五个框只有七百八十一个碰到编号二八九六四八八的合计行我们复查了杰德吉的两张截图要求重新截图见编号二四三六六七八九"


@pytest.mark.parametrize(
    "spelling",
    ["l’étiquette GÉNÉRALE", "l'étiquette générale", "> l’éti­quette  _générale_", "l’&eacute;tiquette <i class='k'>g&#233;n​érale</i>", "ｌ’étiquette **générale**"],
)
def test_spelling_does_not_count(spelling):
    assert words_of(spelling) == ["l", "etiquette", "generale"]


def test_parts():
    assert plain("a < b<br/>c") == "a < b c" and words_of("<ref>x</ref><box><1><2></box>y") == ["x", "y"]
    assert windows(30, 12, 6) == [0, 6, 12, 18] and windows(13, 12, 6) == [0, 1] and windows(3, 12, 6) == [0]
    assert is_chinese(None, CHINESE) and not is_chinese(None, ITEM) and is_chinese("zh-x", "") and not is_chinese("en", CHINESE)


def test_lcs_against_table():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert lcs_length(a, b) == table[-1][-1]


def corpus():
    rng = random.Random(3)
    noise = "a map of the row shows that the label in only one team is wide because of pixels".split()
    words = ITEM.split()
    docs = []
    for i in range(60):
        cut = rng.randrange(len(words) - 6)
        run = words[cut : cut + rng.randrange(5, 20)]
        docs.append((i, " ".join(rng.choices(noise, k=rng.randrange(40)) + [w.upper() for w in run] + rng.choices(noise, k=rng.randrange(40)))))
    for i in range(60, 80):
        cut = rng.randrange(30)
        docs.append((i, "云" * rng.randrange(30) + "，".join(CHINESE[cut : cut + rng.randrange(30, 50)]) + "雨" * 20))
    return [*docs, (80, None), (81, ""), (82, "  "), (83, ITEM), (83, ITEM), (84, ITEM * 2000), (None, ITEM)]


def brute(docs, items):
    found = set()
    for item, text, lang in items:
        words = words_of(text or "")
        for doc, body in docs:
            if doc is None or body is None:
                continue
            if is_chinese(lang, text or ""):
                have, want, size = letters_of(words_of(body)), letters_of(words), LETTERS_RUN
            else:
                have, want, size = [*words_of(body)], words, WORDS_RUN
            key = (lambda s: s) if isinstance(want, str) else tuple
            grams = {key(want[i : i + size]) for i in range(len(want) - size + 1)}
            if any(key(have[i : i + size]) in grams for i in range(len(have) - size + 1)):
                found.add((doc, item))
    return found


def test_found_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(leakage, "PIECES_A_SUM", 7)
    monkeypatch.setattr(leakage, "PIECES_A_PART", 3)
    monkeypatch.setattr(leakage, "TERMS_A_SEARCH", 50)
    docs = corpus()
    items = [(1, ITEM, "en"), (1, ITEM, "en"), (2, CHINESE, "zh"), (3, None, "en"), (4, "too short", None), (5, "", "zh"), (6, ITEM.split(". ")[0] + " again and again", None)]
    documents = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    table = spark.createDataFrame([(*r, 1) for r in items], "item_id long, item_text string, lang string, doc_id int")
    # one block; several blocks; several groups of blocks; an item in several segments
    for passages, terms, segment in ((1000, 10**6, 1000), (3, 10**6, 1000), (3, 10, 1000), (1000, 10**6, 7)):
        monkeypatch.setattr(leakage, "PASSAGES_A_BLOCK", passages)
        monkeypatch.setattr(leakage, "MOST_TERMS", terms)
        monkeypatch.setattr(leakage, "SEGMENT", segment)
        leaks = leaked_items(documents, table).collect()
        assert {(r.doc_id, r.item_id) for r in leaks if r.kind == "verbatim"} == brute(docs, items)
        assert len(leaks) == len({(r.doc_id, r.item_id) for r in leaks})


def test_runs_at_every_offset_beside_words_that_outweigh_them(spark):
    words, other = words_of(ITEM), [f"rare{i}" for i in range(30)]
    items = [(1, ITEM, "en"), (2, " ".join(other), "en"), (3, CHINESE, "zh")]
    docs = []
    for offset in range(2 * WORDS_RUN + 1):
        run = words[offset % (len(words) - WORDS_RUN + 1) :][:WORDS_RUN]
        for around in (["rare7"] * 24, other[:11] + ["also"] + other[12:22] + ["also"]):
            docs.append((len(docs), " ".join([*around[:offset], *run, *around])))
    for offset in range(0, 2 * LETTERS_RUN + 1, 3):
        docs.append((len(docs), "模型给" * 30 + "云" * (offset % 3) + CHINESE[offset % 20 :][:LETTERS_RUN] + "模型给" * 30))
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, item_text string, lang string")
    expected = brute(docs, items)
    assert {d for d, _ in expected} == {d for d, _ in docs}
    assert {(r.doc_id, r.item_id) for r in leaked_items(documents, table).collect() if r.kind == "verbatim"} == expected


def test_paraphrase(spark):
    changed = ITEM.replace(" kept the ", " has kept his ").replace("only", "just").replace("button", "knob")
    documents = spark.createDataFrame([(1, changed), *((i, "button and knob are not kept in here at all, only many other words about the label " * 3) for i in range(2, 9))], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM, "en")], "item_id long, item_text string, lang string")
    assert [(r.doc_id, r.kind) for r in leaked_items(documents, items).collect()] == [(1, "paraphrase")]


def test_paraphrases_against_brute_force(spark):
    """Of all pairs whose passages share a long common subsequence with the rarest terms, the index brings nine in ten."""
    rng = random.Random(8)
    stock = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(stock, 36)), "en") for i in range(60)]
    docs = []
    for d in range(300):
        words = rng.choices(stock, k=60)
        source = items[rng.randrange(60)][1].split()
        at = rng.randrange(24)
        part = [w if rng.random() > 0.1 else "other" for w in source[at : at + 14]]
        docs.append((d, " ".join(words[:30] + part + words[30:])))
    table = spark.createDataFrame(items, "item_id long, item_text string, lang string")
    found = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), table).collect()}
    block = next(leakage.blocks_of(iter(items)))
    reader = leakage.Reader([block])
    seen = {t: sum(t in set(text.split()) for _, text in docs) for t in block.vocabulary}
    want = set()
    for k, passage in enumerate(block.passages):
        answer = set(sorted(set(passage), key=lambda t: (seen[t], block.vocabulary[t]))[: leakage.ANSWER_TERMS])
        for d, text in docs:
            words = reader(text)[0]
            for start in range(0, len(words) - WORDS_RUN + 1, WORDS_RUN):
                part = words[start : start + 2 * WORDS_RUN]
                if answer <= set(part) and lcs_length(part, passage) >= leakage.LCS_SHARE * len(passage):
                    want.add((d, block.items[block.owner[k]]))
    assert len(want) > 30 and len(found & want) >= 0.9 * len(want)


def test_latent_space_is_that_of_the_exact_decomposition(spark):
    rng = np.random.default_rng(1)
    rows = [(sorted(rng.choice(40, 6, replace=False).tolist()), rng.random(6).tolist()) for _ in range(50)]
    matrix = np.zeros((50, 40))
    for i, (columns, values) in enumerate(rows):
        matrix[i, columns] = values
    table = spark.createDataFrame(rows, "columns array<int>, values array<double>").repartition(3)
    space = leakage.latent_space(table, 40, 8)
    exact = np.linalg.svd(matrix, full_matrices=False)[2][:8].T
    assert space.shape == (40, 8) and np.linalg.norm(matrix @ space) > 0.999 * np.linalg.norm(matrix @ exact)


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM, "en")], "item_id long, item_text string, lang string")
    assert leaked_items(documents, items).count() == 0
    assert leaked_items(documents, items.filter("false")).count() == 0
