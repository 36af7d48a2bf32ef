import random

import numpy as np
import pytest

from tidemark.llm import mixing, packing
from tidemark.llm.sentences import Judge, analyse, blocks, found_units, sentence_units, unit_starts
from tidemark.llm.tokens import TOKENIZER, counter, document_sizes

CORPUS = {
    "a:approx": (50, 50), "a:Fig": (50, 50), "a:No": (50, 50), "a:etc": (40, 24), "a:App": (30, 30), "a:rev": (30, 28), "a:z": (30, 30), "a:ca": (9, 9),
    "a:again": (90, 5), "a:bzw": (9, 9), "a:др": (9, 9), "s:Then": (30, 0), "s:Operators": (9, 9), "s:The": (40, 5), "s:powerd": (9, 0),
}


def units(text, corpus=CORPUS, own=True):
    found = analyse(text)
    judge = Judge({k: tuple(v) for k, v in found.counts.items()} if own else {}, {k: (*v, 0, 0)[:4] for k, v in corpus.items()})
    starts = unit_starts(found, judge)
    return [text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)])]


@pytest.mark.parametrize(
    "want",
    [
        ["Set it to approx. 3.5 V.", "Then it works."],
        ["See Fig. 5 (see App. B. 12) and No. 3.", "Is it warm?", "Operators in the U.S. grid run it at 6 a.m. and later."],
        ["Fuses, clips, etc. must be checked.", "Check the fuses, etc.", "Then it stops."],
        ["Did the log say “Retry now?” or was it silent?", "“Stop!” is what it prints.", 'The panel shows "Link lost." and goes dark.'],
        ["Wait... the valve needs a moment.", "It is stale again.", "powerd exits with code 7."],
        ["Der Wert liegt bei ca. 5,4 V, d. h. knapp darunter.", "Am 12. Mai wurde er getauscht.", "Auf der Anzeige steht „Wirklich löschen?“ und er bleibt leer."],
        ["¿Por qué está listo?", "¡No abra el relé!", "En EE. UU. trabaja a 5 Hz."],
        ["В версии 3.1 есть раздел и др. изменения.", "На экране видно «Индекс готов.», а каталог закрыт."],
        ["सब कुछ तैयार है।", 'पटल पर "संपर्क टूट गया!" दिखता है और बंद रहता है।', "क्यों है?"],
    ],
)
def test_spaced_scripts(want):
    assert units(" ".join(want)) == want
    assert units("\n".join(want).replace(" the ", "\nthe ")) == [w.replace(" the ", "\nthe ") for w in want]


@pytest.mark.parametrize(
    "want",
    [
        ["屏幕显示“连接丢失！”，随后过热。", "操作员说：“索引已就绪。”", "为什么离线？", "请等待……5分钟。", "上限为0.2V。"],
        ["画面に「接続が切れました。」と表示されます。", "なぜですか？", "run.7.txtを見てください！"],
    ],
)
def test_scripts_without_spaces(want):
    assert units("".join(want)) == want


def test_document_before_corpus():
    """What the document shows free of doubt outweighs the corpus, and only then."""
    corpus = CORPUS | {"a:Mod": (40, 0, 90, 0), "s:Navik": (9, 9), "s:Press": (9, 9)}
    text = "It has Mod. 5 and Mod. 7 inside. Use Mod. 9 now. Press it."
    assert units(text, corpus) == ["It has Mod. 5 and Mod. 7 inside.", "Use Mod. 9 now.", "Press it."]
    assert len(units(text, corpus, own=False)) == 6
    text = "The lid of Navik is shut, so Navik stops. See Fig. Navik here."
    assert units(text, corpus) == ["The lid of Navik is shut, so Navik stops.", "See Fig. Navik here."]
    assert len(units(text, corpus, own=False)) == 3
    text = "We say again and again that it works again. powerd stops. Again it works."
    assert units(text) == ["We say again and again that it works again.", "powerd stops.", "Again it works."]


@pytest.mark.parametrize("n", [5, 50, 250, 2500])
def test_long_quotations(n):
    """A quotation is one with its sentence, whatever its length; one that never closes holds nothing together."""
    inner = "为什么离线？" * n
    assert units(f"屏幕显示“{inner}”，随后过热。请等待。") == [f"屏幕显示“{inner}”，随后过热。", "请等待。"]
    assert len(units(f"屏幕显示“{inner}随后过热。请等待。")) == n + 2


def test_script_of_whole_block():
    """A block that begins in another script for long is judged by all of its letters."""
    text = "索引 " * 150 + "and it runs at approx. 3 V in the long part of this block, " * 40 + "as Fig. 5 says. Then it stops."
    assert units(text)[-1] == "Then it stops."
    assert analyse(text).counts["a:approx"][1] == 40


def test_long_words_before_stops():
    word = "x" * 300
    assert analyse(f"a {word}. 5 b {word}. 6 c").counts["a:" + word][:2] == [2, 2]


def test_thai_and_blocks():
    assert units("ทุกอย่างเรียบร้อยดี รุ่น1.4.0ย้ายแผง") == ["ทุกอย่างเรียบร้อยดี", "รุ่น1.4.0ย้ายแผง"]
    text = "# Head. With stop\nText one. Text two.\n\n1. First. Item\n2. Second\n - not\n \nHEAD\n\n217. Then"
    assert units(text) == ["# Head. With stop", "Text one.", "Text two.", "1. First. Item", "2. Second", "- not", "HEAD", "217. Then"]
    assert units("is\n217. Why?\n\n- a\n* b") == ["is\n217.", "Why?", "- a", "* b"]
    assert units("") == units(" \n\t\n") == [] and blocks("") == []


def test_documents(spark):
    rows = [(1, "A one. B two."), (2, None), (3, ""), (4, "x " * 50_000), (5, "A one. B two."), (6, "no end")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id bigint, text string, key string")
    got = sorted(tuple(r) for r in found_units(docs).collect())
    assert got == [(1, 1), (1, 8), (4, 1), (5, 1), (5, 8), (6, 1)]
    assert {r["unit"] for r in sentence_units(docs.where("doc_id = 1")).collect()} == {"A one.", "B two."}
    assert found_units(docs.limit(0)).count() == 0


def squares(sizes, bins):
    return int((np.bincount(bins, weights=sizes) ** 2).sum())


def test_pack_items():
    rng = random.Random(8)
    for _ in range(30):
        capacity = rng.randint(10, 60)
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 120))), reverse=True)
        first, bins = packing.pack_items(sizes, capacity)
        fills = np.bincount(bins, weights=sizes)
        assert fills.max() <= capacity and fills.min() > 0 and fills.sum() == sum(sizes)
        assert len(fills) <= first.max() + 1
        assert squares(sizes, bins) >= squares(sizes, first)


def test_search_empties_bins():
    """From a poor start the search alone comes near the least number of bins, and no single step is left."""
    rng = random.Random(4)
    capacity = 100
    sizes = np.array([rng.randint(5, 60) for _ in range(300)])
    start = np.arange(len(sizes)) // 2
    keep = np.bincount(start, weights=sizes)[start] <= capacity
    start = np.where(keep, start, 1000 + np.arange(len(sizes)))
    start = np.unique(start, return_inverse=True)[1]
    bins = np.unique(packing.improve(sizes, start, capacity), return_inverse=True)[1]
    fills = np.bincount(bins, weights=sizes)
    assert fills.max() <= capacity and len(fills) <= -(-sizes.sum() // capacity) + 3 < start.max() + 1 - 20
    n = squares(sizes, bins)
    for i in range(len(sizes)):
        for b in range(len(fills)):
            moved = bins.copy()
            moved[i] = b
            assert np.bincount(moved, weights=sizes).max() > capacity or squares(sizes, moved) <= n


def test_two_for_one():
    """An exchange that only a pair of middle documents makes, neither the largest nor the smallest of their bin."""
    sizes = np.array([50, 23, 20, 3, 40, 57])
    bins = np.array([0, 0, 0, 0, 1, 1])
    got = packing.improve(sizes, bins, 100)
    assert sorted(np.bincount(got, weights=sizes).tolist())[-1] == 100


def test_packed(spark):
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 40)) for i in range(300)] + [(1000, 250), (1001, None)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([("a", 50), ("b", 33), ("c", None), ("d", 0)], "pack_name string, capacity_tokens int")
    out = packing.packed(sizes, packs, block=64).toPandas()
    for name, capacity in (("a", 50), ("b", 33)):
        mine = out[out.pack_name == name]
        fills = mine.groupby("bin_id").n_tokens.sum()
        assert fills.max() <= capacity and (fills == mine.groupby("bin_id").bin_tokens.first()).all()
        per = mine.groupby("doc_id").n_tokens.sum().to_dict()
        assert per == {d: n for d, n in rows if n}
        whole = mine[mine.doc_id.map(dict(rows)) <= capacity]
        assert whole.doc_id.is_unique
    assert set(out.pack_name) == {"a", "b"}
    report = {r["pack_name"]: r for r in packing.packing_report(packing.packed(sizes, packs)).collect()}
    assert report["a"]["used"] > 0.95
    assert packing.packed(sizes.limit(0), packs).count() == 0 and packing.packed(sizes, packs.limit(0)).count() == 0


def test_weights():
    even = [0.5, 0.5]
    assert mixing.limited_weights([0.9, 0.1], even, [9, 9]) == (even, 0.0)
    w, e = mixing.limited_weights([0.1, 0.4, 0.5], [0.5, 0.3, 0.2], [0.1, 9, 9])
    assert w[0] == 0.1 and e == 0 and abs(w[1] - 0.54) < 1e-9 and abs(w[2] - 0.36) < 1e-9
    # what the first can't give would put the second over its limit, so shares are tempered until that holds
    w, e = mixing.limited_weights([0.1, 0.2, 0.7], [0.5, 0.3, 0.2], [0.3, 0.35, 9])
    assert abs(sum(w) - 1) < 1e-9 and w[0] == 0.3 and abs(w[1] - 0.35) < 1e-9 and 0 < e < 1
    assert mixing.limited_weights(even, even, [0.1, 0.2])[0] == [0.1, 0.2]
    # a source is never raised to its limit only because equal repeats would pass it
    w, _ = mixing.limited_weights([0.45, 0.45, 0.1], [0.6, 0.1, 0.3], [0.2, 0.3, 0.9])
    assert w[0] == 0.2 and abs(sum(w) - 1) < 1e-9 and abs(w[1] / w[2] - 1 / 3) < 1e-6
    assert mixing.limited_weights([0.0, 1.0], even, [0.0, 9])[0] == [0.0, 1.0]
    shares = [0.7, 0.2, 0.1]
    x = mixing.exponent_for_entropy(shares, 1.0)
    assert abs(mixing.entropy(mixing.tempered(shares, x)) - 1.0) < 1e-6


def test_mixed(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["big", "mid"]), rng.randint(1, 50)) for i in range(4000)] + [(9000 + i, "tiny", 10) for i in range(20)] + [(9100, None, 5), (9101, "other", 5), (9102, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame(
        [("m", "Big ", 0.5, 4, 0.5), ("m", "mid", 0.3, 4, 0.5), ("m", "tiny", 0.1, 3, 0.5), ("m", "absent", 0.1, 3, 0.5), ("n", "mid", 1.0, 2, 2.0), ("z", None, 1.0, 1, 1.0)],
        "mix_name string, source string, target_share double, max_repeats int, budget_ratio double",
    )
    out = mixing.mixed(sizes, targets).toPandas()
    assert not out.duplicated(["mix_name", "doc_id"]).any()
    m = out[out.mix_name == "m"]
    assert m[m.source == "tiny"].repeats.eq(3).all() and len(m[m.source == "tiny"]) == 20
    total = sum(n for _, _, n in rows)
    assert abs((m.n_tokens * m.repeats).sum() - total / 2) < 200
    assert out[out.mix_name == "n"].repeats.max() <= 2
    shares = {(r["mix_name"], r["source"]): r for r in mixing.mix_shares(sizes, targets).collect()}
    assert abs(shares["m", "big"]["actual_share"] - shares["m", "big"]["weight"]) < 0.01
    assert shares["m", "absent"]["actual_share"] == 0
    bare = [r for r in mixing.tempered_weights(sizes, targets).collect() if r["mix_name"] == "m"]
    assert len(bare) == 4 and all(abs(r["entropy"] - r["target_entropy"]) < 1e-6 for r in bare) and abs(sum(r["weight"] for r in bare) - 1) < 1e-9
    assert mixing.mixed(sizes.limit(0), targets).count() == 0 and mixing.mixed(sizes, targets.limit(0)).count() == 0


def test_tokens(spark):
    rows = [(1, "Wiki ", "hello world <|endoftext|>"), (2, "field notes", None), (3, None, ""), (4, "x", "x" * 50_000)]
    got = {r["doc_id"]: (r["source"], r["n_tokens"]) for r in document_sizes(spark.createDataFrame(rows, "doc_id bigint, source string, text string")).collect()}
    assert got[1][0] == "wiki" and got[2] == ("field-notes", 0) and got[3] == (None, 0) and got[4][1] > 1000
    texts = [rows[0][2], "Über 3,5 °C — ok?\n\n  索引 สวัสดี don't", " \t\n ", "x1 " * 99]
    assert counter(TOKENIZER)(texts) == counter(TOKENIZER.replace(".tiktoken", ".json"))(texts) and counter(TOKENIZER)(texts)[0] == got[1][1]
