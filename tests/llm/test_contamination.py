import os
import random
from difflib import SequenceMatcher

import pandas as pd
import pytest

from tests.conftest import DATA
from tidemark.llm import contamination as C

ITEM = (
    "The harbour committee met on Tuesday to discuss 14 new moorings. Captain Brennan argued that the old pier was unsafe after 3 storms. "
    "Members voted 9 to 4 for repairs, although the treasurer called the sum of 250 pounds per metre excessive. A second vote follows on Friday, "
    "when the engineers of Larkhill present drawings and the fishermen may speak against the closure of the eastern steps."
)
OTHER = "Rain fell over the valley all night and nobody in the village slept well. By morning the lower road had gone and the school stayed shut for 2 days."


def found(spark, docs, items=((1, ITEM), (2, OTHER)), **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(list(items), "item_id long, text string")
    out = C.find_leaks(d, i, **kw).filter(C.kind_of() == "wording")
    return sorted((r.doc_id, r.item_id) for r in out.collect())


def words(text):
    return text.split()


def test_whole_partial_split_and_disguised(spark):
    w = words(ITEM)
    third = " ".join(w[10:40])
    two = "Intro words here. " + " ".join(w[:20]) + " Something else was said between these parts, at some length, by other people entirely. " + " ".join(w[40:62]) + " End."
    rnd = random.Random(1)
    changed = " ".join("thing" if rnd.random() < 0.08 else x for x in w)
    docs = [
        (1, "Before. " + ITEM + " After."),
        (2, "Before. " + third + " After this nothing more of it."),
        (3, two),
        (4, changed),
        (5, ITEM.replace("committee", "com-\nmittee").replace("storms", "sto­rms").replace(" ", "&nbsp;", 9)),
        (6, "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in ITEM)),
        (7, ITEM.replace("a", "а").replace("o", "о")),
        (8, "<b>" + ITEM.replace(" pier", "</b> <i>pier</i>")),
        (9, ITEM.upper()),
    ]
    assert found(spark, docs) == [(i, 1) for i in range(1, 10)]


def test_no_case(spark):
    w = words(ITEM)
    docs = [
        (1, "The committee met on Tuesday and voted."),  # a few shared words
        (2, " ".join(w[12:24])),  # about one sentence
        (3, " ".join(reversed(w))),
        (4, None),
        (5, ""),
        (6, "   \n"),
        (7, "word " * 200_000),
        (8, "x" * 300_000),
    ]
    assert found(spark, docs) == []


def test_reparameterised_copy_is_told_apart(spark):
    swap = {"14": "88", "3": "7", "9": "5", "4": "2", "250": "990", "Tuesday": "Monday", "Friday": "Sunday", "Brennan": "Ostrova", "Larkhill": "Dunmere"}
    text = ITEM
    for a, b in swap.items():
        text = " ".join(b + x[len(a) :] if x.rstrip(".,") == a else x for x in text.split())
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = C.find_leaks(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).first()
    assert r.slot_consistency > 0.9 and r.slots_same < 0.5 and r.template_coverage > 0.8


def test_repeats_blocks_empty_sides_and_extra_columns(spark):
    docs = [(1, ITEM), (1, ITEM), (None, ITEM)]
    assert found(spark, docs) == [(1, 1), (1, 1)]
    many = [(i, OTHER.replace("Rain", f"Rain{i}")) for i in range(7)] + [(50, ITEM)]
    assert found(spark, [(1, ITEM)], many, block_items=3) == [(1, 50)]
    assert found(spark, [(1, ITEM)], [(5, None), (6, "")]) == []
    empty = spark.createDataFrame([], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(1, ITEM, "x")], "item_id long, text string, doc_id string")
    assert C.find_leaks(empty, items).count() == 0
    assert C.find_leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), items.filter("false")).count() == 0


def brute(index, text):
    """Coverage of every item by a plain alignment of its words with the whole text."""
    docs = C.read_texts([text], C.Vocabulary(index.names))
    t = index.texts
    out = {}
    for k, i in enumerate(index.ids):
        a = t.words[t.word_at[k] : t.word_at[k + 1]].tolist()
        out[i] = C.followed(a, docs.words.tolist()) / max(1, len(a))
    return out


@pytest.mark.parametrize("every", [4, 5, 6])
@pytest.mark.parametrize("how", ["change", "drop", "add", "random"])
def test_recall_of_the_candidates_by_edits(every, how):
    """At least nine in ten of the passages that a plain alignment finds, with an edit at every 4th, 5th or 6th word."""
    rnd = random.Random(3)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "sal", "ven", "dor", "pli", "qua") for b in ("n", "rt", "ss", "ml", "nd", "x", "ck", "pe", "to", "vy", "ga", "hu")]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(90))) for i in range(60)]
    index = C.build_index(items)
    docs = []
    for _, text in items:
        w = text.split()
        k = rnd.randint(0, 35)
        part = []
        for j, x in enumerate(w[k : k + 54]):
            edit = rnd.random() < 1 / every if how == "random" else j % every == every - 1
            kind = rnd.choice(["change", "drop", "add"]) if how == "random" else how
            part += [x] if not edit else {"change": [rnd.choice(vocab)], "drop": [], "add": [x, rnd.choice(vocab)]}[kind]
        docs.append(" ".join([*(rnd.choice(vocab) for _ in range(60)), *part, *(rnd.choice(vocab) for _ in range(60))]))
    got = {(d, i): c for d, i, c, *_ in C.match_texts(index, docs, C.Vocabulary(index.names))}
    want = [(d, i) for d, text in enumerate(docs) for i, c in brute(index, text).items() if i == d and c >= 1 / 3]
    assert len(want) >= 20
    assert sum(got.get(x, 0) >= 1 / 3 for x in want) >= 0.9 * len(want)


def shared_passage(n=60):
    """Items that all begin with one passage of 40 words and go on with 50 of their own."""
    rnd = random.Random(3)
    vocab = [f"{a}{b}" for a in ("ba", "ko", "mi", "tu", "re", "sal", "ven", "dor") for b in ("n", "rt", "ss", "ml", "nd", "x", "ck", "pe", "to", "vy", "ga", "hu")]
    passage = " ".join(rnd.choice(vocab) for _ in range(40))
    return passage, [(i, passage + " " + " ".join(rnd.choice(vocab) for _ in range(50))) for i in range(n)]


def test_passages_that_many_items_hold_are_found_in_each():
    passage, items = shared_passage()
    index = C.build_index(items)
    texts = [OTHER, "Start here. " + passage + " and the rest differs.", items[7][1]]
    got = {(d, i): c for d, i, c, *_ in C.match_texts(index, texts, C.Vocabulary(index.names)) if c >= 1 / 3}
    want = {(d, i): c for d, t in enumerate(texts) for i, c in brute(index, t).items() if c >= 1 / 3}
    assert got == want and len(got) == 120


def test_matching_runs_are_those_of_difflib():
    rnd = random.Random(2)
    for words in (3, 8, 40):
        for _ in range(60):
            a, b = ([rnd.randrange(words) for _ in range(rnd.randrange(60))] for _ in range(2))
            m = SequenceMatcher(None, b, a, autojunk=False)
            assert C.blocks_of(a, b) == [(x.b, x.a, x.size) for x in m.get_matching_blocks() if x.size]


@pytest.mark.parametrize("most", [1, 50, 700, 5000])
def test_candidates_in_batches_are_the_same(most):
    passage, items = shared_passage(20)
    index = C.build_index(items)
    docs = C.read_texts([passage, OTHER, *(t for _, t in items), passage + ". " + passage, ""], C.Vocabulary(index.names))
    plain = lambda found: [(d, i, p.tolist(), q.tolist()) for d, i, p, q in found]
    want = plain(C.candidates(index, docs, most=10**9))
    assert plain(C.candidates(index, docs, most=most)) == want and len(want) == 20 * 22
    assert most == 1 or max(len(h[0]) for h in C._hits(index, docs, most)) <= max(most, 2000)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_same_as_brute_force_on_documents():
    """All items against every document whose id is divisible by 100, at a larger scale where it is there."""
    where = DATA.replace("sf0.001", "sf0.01") if os.path.isdir(DATA.replace("sf0.001", "sf0.01")) else DATA
    docs = pd.read_parquet(f"{where}/documents.parquet")
    docs = docs[docs.text.notna() & (docs.doc_id % 100 == 0)]
    items = pd.read_parquet(f"{where}/eval_item.parquet")
    index = C.build_index(list(zip(items.item_id, items.text, strict=True)))
    texts = docs.text.tolist()
    got = {(d, i) for d, i, c, *_ in C.match_texts(index, texts, C.Vocabulary(index.names)) if c >= 1 / 3}
    assert got == {(d, i) for d, t in enumerate(texts) for i, c in brute(index, t).items() if c >= 1 / 3}


def test_short_items_are_found_whole(spark):
    items = [(n, " ".join(["zinc", "harbour", "quartz", "meadow", "lantern", "orchid", "violin", "copper"][:n])) for n in (2, 4, 5, 6, 8)]
    docs = [(n, "Some words before. " + t + ", and a few words after it.") for n, t in items] + [(99, "zinc quartz harbour meadow")]
    got = found(spark, docs, items)
    assert {(n, n) for n, _ in items} <= set(got) and not [x for x in got if x[0] == 99]


def test_fully_reparameterised_question(spark):
    item = "A train leaves Paris at 9 and travels 300 km at 60 km an hour. When does the train reach Lyon"
    docs = [(1, "Quiz: A train leaves Rome at 7 and travels 450 miles at 90 miles an hour. When does the train reach Milan? Answers below."), (2, "A train leaves Rome. It travels well. When will we arrive?")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    out = C.find_leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).withColumn("kind", C.kind_of()).collect()
    assert [(r.doc_id, r.kind) for r in out if r.kind] in ([(1, "reparameterised")], [(1, "wording")])
    r = next(r for r in out if r.doc_id == 1)
    assert r.template_coverage == 1.0 and r.slot_consistency == 1.0


def test_blocks_don_t_change_templates(spark):
    items = [(1, ITEM), (2, "We saw the kepler orbit and larkhill again today, as it was said.")]
    docs = [(1, ITEM.upper()), (2, ITEM.replace("Larkhill", "larkhill"))]
    a = [tuple(r) for r in C.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_items=1).collect()]
    b = [tuple(r) for r in C.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(a) == sorted(b) and a


def test_long_tags_are_markup():
    assert C.clean("a <span title='" + "x" * 5000 + "'>b</span> 2 < 3 > 1").split() == ["a", "b", "2", "<", "3", ">", "1"]


def test_vocabulary_may_be_emptied():
    index = C.build_index([(1, ITEM)])
    v = C.Vocabulary(index.names)
    v.LIMIT = 10
    assert [c for _, _, c, *_ in (x for _ in range(3) for x in C.match_texts(index, [OTHER, ITEM], v))] == [1.0] * 3
