import random
import re

from tidemark.llm import encoding as en
from tidemark.llm import scans

CLEAN = ["Der Temperaturfühler ist früh gestört. Größere Blöcke", "«Índice listo» año pasado, ¿qué?", "В версии есть новый резервный раздел", "索引服务已就绪。版本更换", "Âge moyen : 3 °C", "ATENÇÃO: NÃO DESLIGUE", "estación Ñandú"]


def files(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in texts], "file_id bigint, content string, word string")


def test_found_and_restored(spark):
    clean = [(i * 100 + k, t) for i in range(12) for k, t in enumerate(CLEAN)]
    bad = {
        5001: CLEAN[0].encode().decode("latin-1"), 5002: CLEAN[1].encode().decode("cp1250"), 5003: CLEAN[2].encode().decode("cp1251", "replace"),
        5004: CLEAN[2].encode("koi8-r").decode("cp1251"), 5005: CLEAN[3].encode("gbk").decode("latin-1"), 5006: "ok " + "früh".encode().decode("cp1252").encode().decode("cp1252"),
        5007: "f�h", 5008: CLEAN[0].encode().decode("mac_roman"), 5009: CLEAN[3].encode().decode("cp437"),
    }
    rows = clean + list(bad.items()) + [(6001, None), (6002, ""), (6003, "plain"), (6004, "x" * 100_000), (5001, bad[5001])]
    got = sorted(r[0] for r in en.found_texts(files(spark, rows)).collect())
    assert got == sorted(bad)
    fixed = {r["file_id"]: r["restored"] for r in en.restored_texts(files(spark, rows)).collect()}
    assert fixed[5001] == CLEAN[0] and fixed[5002] == CLEAN[1] and fixed[5004] == CLEAN[2] and fixed[5008] == CLEAN[0]
    assert en.found_texts(files(spark, []) if False else files(spark, rows).limit(0)).count() == 0


def test_forms_round_trip():
    for word in ("früh", "раздел", "索引", "год"):
        forms = en.garbled_forms(word)
        assert (word.encode().decode("latin-1"), "utf-8>latin-1") in forms
        assert all(f != word for f, _ in forms)


VOCABULARY = "recovery partition telemetry channel harness connector calibration table document reader pressure valve snapshot folder operators switch the power rail before lunch because cooling fans become quiet again when measured".split()


def scan_text(rng, pages=4):
    lines, title = [], "Checking the power rail handbook"
    for p in range(pages):
        lines.append(("\f" if p else "") + f"{title}  |  {p + 3}")
        for _ in range(10):
            lines.append(" ".join(rng.choice(VOCABULARY) for _ in range(8)) + ("." if rng.random() < 0.2 else ""))
    return lines


def test_scans(spark):
    rng = random.Random(6)
    clean = [(i, "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(9)) + "." for _ in range(14)), False, "documentation") for i in range(60)]
    lines = scan_text(rng)
    lines[3] = "power rail before the recovery par-"
    lines[4] = "tition again when measured"
    lines[7] = "when tbe calibrati0n table rneasured quiet"
    lines[10] = "the harness con¬"
    # the broken word goes on behind the head of the next page
    lines[12] = "nector before lunch"
    rows = clean + [(900, "\n".join(lines), True, "documentation"), (901, None, True, None), (902, "", None, None), (903, "\n".join(lines), None, "documentation")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "file_id bigint, content string, is_pdf boolean, file_type string, n int")
    got = {}
    for r in scans.found_faults(table).collect():
        got.setdefault((r["file_id"], r["fault"]), set()).add(r["line_no"])
    heads = {i + 1 for i, x in enumerate(lines) if "Checking" in x}
    for f in (900, 903):
        assert got[f, "furniture"] == heads
        assert got[f, "broken_word"] == {4, 11}
        assert got[f, "misread"] == {8}
    assert {f for f, _ in got} == {900, 903}
    text = next(r["repaired"] for r in scans.repaired_files(table).collect() if r["file_id"] == 900)
    assert "the recovery partition again" in text and "connector before lunch" in text and "Checking" not in text
    assert "the calibration table measured quiet" in text, [x for x in text.split(".") if "alibrati" in x]
    assert scans.found_faults(table.limit(0)).count() == 0


def test_editor_held_out():
    """Words the editor has not seen: its own first choice puts most single misreadings right and leaves most words."""
    rng = random.Random(9)
    stems = "alarm band cable drum engine filter gauge heater index joint kernel lamp motor nozzle oven panel quartz relay sensor timer union valve winch".split()
    ends = ["", "s", "ing", "ed", "er", "ment", "side", "board", "line", "block"]
    words = [a + b for a in stems for b in ends]
    rng.shuffle(words)
    seen, held = words[:170], words[170:]
    editor = scans.train_editor(list(seen))
    cases = [(scans.misread(w, rng), w) for w in held for _ in range(4)]
    right = [editor.proposals(m[0])[0].text == w for m, w in cases if m]
    left = [editor.proposals(w)[0].text == w for w in held]
    assert len(right) > 150 and sum(right) / len(right) > 0.6
    assert sum(left) / len(left) > 0.8


def test_acceptance_decides(spark):
    """With the same lexicon, a misread word is put right and a code next to another code is left."""
    rng = random.Random(2)
    words = ["".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(rng.randint(2, 5))) for _ in range(900)]
    codes = [f"{rng.choice('ABCDEF')}{rng.choice('ABCDEF')}-{rng.choice('ef')}{rng.choice('cf')}x{k}" for k in range(9) for _ in range(30)]
    lexicon = spark.createDataFrame([(w, 40) for w in dict.fromkeys(words)] + [(c.lower(), 1) for c in dict.fromkeys(codes)], "word string, n_clean bigint")
    editor = scans.train_editor([w for w in words if rng.random() < 0.4])
    accept = scans.train_acceptance([w for w in dict.fromkeys(words + codes)], lexicon, editor)
    right, wrong = next((w, scans.misread(w, rng)[0]) for w in words if len(w) > 7 and scans.misread(w, rng))
    rows = spark.createDataFrame([(wrong, 1)], "word string, text_id bigint")
    got = {r["word"]: r["fixed"] for r in scans.corrections(rows, lexicon, editor, accept).collect()}
    assert wrong not in words and got == {wrong: right}
    refused = scans.corrections(rows, lexicon, editor, {"bias": -1.0}).count()
    assert refused == 0


def test_joins():
    words = "Rückmeldung Haupt Neben Kabel Leitung und Schalter Kühlung langfristig Sensoren Gehäuse Ventil Steuerung Anzeige Fühler oder Pumpe".split()
    vocabulary = frozenset(w.lower() for w in words)
    joins = scans.train_joins(sorted(vocabulary) * 8)
    goes = lambda a, b: sum(joins.get(f, 0.0) for f in scans._join_features(a, b, vocabulary)) > 0
    assert goes("Rück-", "meldung") and goes("(Kühl¬", "ung.") and goes("Un-", "bekanntes")
    assert not goes("Haupt-", "und") and not goes("3-", "5") and not goes("-", "Kabel") and not goes("Kabel-", "(siehe")


def test_page_numbers():
    assert scans._value("xiv") == 14 and scans._value("l6") == 16
    a, b = scans.line_keys("Checking the off5et tracker 12\nChecking the offset tracker 7")
    assert a == b
    lines = ["~" * 30 + f" {n} " + "~" * 30 if n else "text goes on here" for n in (3, 0, 4)]
    assert scans.counting_pages(lines)


def test_words_in_spark_as_in_python(spark):
    text = "\x0cHead 3\n(One)\u00a0two-\nfold, three\x1cfour\n\n  \nx-\ny"
    files_ = spark.createDataFrame([(1, text, True, "documentation"), (2, "Über (über) x, x", False, "source"), (3, "", True, None)], "file_id bigint, content string, is_pdf boolean, file_type string")
    model = scans.PageModel({"bias": -1.0}, {"bias": -1.0}, frozenset(), {"bias": 1.0}, frozenset())
    pages = scans.judged_pages(files_, model)
    got = sorted((r["lines"], r["word"]) for r in scans.scan_words(pages).collect())
    assert got == [("1", "3"), ("1", "Head"), ("2", "One"), ("2,3", "two-\nfold"), ("3", "four"), ("3", "three"), ("6,7", "x-\ny")]
    assert {(r["word"], r["n_clean"]) for r in scans.clean_words(pages).collect()} == {("über", 1), ("x", 1)}


def test_units_of_every_length(spark):
    """Runs that occur clean only as other runs, decoded twice wrongly: their letters stand as 6, 7 and 8 characters."""
    twice = lambda t: t.encode().decode("cp1252").encode().decode("cp1252")
    clean = ["สวัสดีครับผู้ใช้งาน", "ระบบพร้อมทำงาน", "版本更换索引服务", "已就绪的文件"]
    bad = {901: "ระบบผู้ใช้งาน", 902: "文件版本"}
    rows = list(enumerate(clean)) + [(k, twice(t)) for k, t in bad.items()]
    assert {r[0] for r in en.found_texts(files(spark, rows)).collect()} == set(bad)
    fixed = {r["file_id"]: r["restored"] for r in en.restored_texts(files(spark, rows)).collect()}
    assert fixed == bad


def test_copies_of_a_garbled_text(spark):
    """A text garbled by a single-byte chain is found under every file_id, however many there are."""
    right = "В версии есть новый резервный раздел"
    bad = right.encode("koi8-r").decode("cp1251")
    rows = [(i, f"{right} {i}") for i in range(6)] + [(900 + i, bad) for i in range(40)]
    assert {r[0] for r in en.found_texts(files(spark, rows)).collect()} == set(range(900, 940))
    fixed = {r["file_id"]: r["restored"] for r in en.restored_texts(files(spark, rows)).collect()}
    assert fixed == dict.fromkeys(range(900, 940), right)


def test_copies_of_a_scan(spark):
    """Misread words count however often their scan was read again, and a sign amid letters needs one clean file only."""
    rng = random.Random(6)
    clean = [(i, "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(9)) + "." for _ in range(14)), False, "documentation") for i in range(30)]
    clean[0] = (0, clean[0][1] + " The thermostat is on.", False, "documentation")
    lines = scan_text(rng)
    lines[7] = "when tbe calibration table rneasured quiet"
    lines[9] = "when the therm0stat table quiet"
    rows = clean + [(900 + i, "\n".join(lines), True, "documentation") for i in range(60)]
    table = spark.createDataFrame(rows, "file_id bigint, content string, is_pdf boolean, file_type string")
    got = {(r["file_id"], r["line_no"]) for r in scans.found_faults(table).where("fault = 'misread'").collect()}
    assert got == {(900 + i, n) for i in range(60) for n in (8, 10)}


def test_single_edits_beyond_the_beam(spark):
    """One misread character of a long word is put right wherever it stands, however low the editor ranks it."""
    right = ["temperaturfühlersicherungsschaltung", "druckventilsteuerungseinheiten", "verbindungsleitungsbeschreibungen"]
    want = {}
    for word in right:
        for a, b in scans.MISREADINGS[:24]:
            if a in word:
                wrong = word.replace(a, b, 1)
                want[wrong] = want[wrong[:-4] + "-" + scans.BREAK + wrong[-4:]] = word

    rows = spark.createDataFrame([(w, 1) for w in want], "word string, text_id bigint")
    lexicon = spark.createDataFrame([(w, 9) for w in right], "word string, n_clean bigint")
    got = {r["word"]: r["fixed"] for r in scans.corrections(rows, lexicon, scans.train_editor(list(VOCABULARY)), {"bias": 1.0}).collect()}
    assert {w: got.get(w) for w in want} == want


def test_very_long_words(spark):
    """No length keeps a word from being put right, and very long ones end in time."""
    right = "sicherungs" * 30
    wrong = [right.replace("h", "b", 1), right[:-4] + right[-4:].replace("n", "u"), right[:149] + right[149:].replace("r", "f", 0).replace("ng", "nq", 1), right.replace("rh", "rb", 1)[:200] + "-" + scans.BREAK + right[200:]]
    rows = spark.createDataFrame([(w, 1) for w in wrong] + [("c" * 20_000, 1)], "word string, text_id bigint")
    lexicon = spark.createDataFrame([(right, 9)], "word string, n_clean bigint")
    got = {r["word"]: r["fixed"] for r in scans.corrections(rows, lexicon, scans.train_editor(list(VOCABULARY)), {"bias": 1.0}).collect()}
    assert set(got.values()) == {right} and set(got) == {w for w in wrong if w != right and "rb" not in w}


def test_misreadings_in_scans_taken_for_clean(spark):
    """A misreading common in scans stays one though a few scans pass for clean files; a word of scans only by its topic stays too."""
    rng = random.Random(6)
    text = lambda k: "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(9)) + "." for _ in range(k))
    clean = [(i, text(14), False, "documentation") for i in range(60)]
    # one scan nobody can tell from a clean file, also read again; and a service few clean files name, next to its misreading
    clean += [(i, text(14) + " The calibrafion table rneasured quiet.", False, "documentation") for i in (60, 61)]
    clean += [(62 + i, text(14) + " The navmerge ends.", False, "documentation") for i in range(3)] + [(66, text(14) + " The navmcrge ends.", False, "documentation")]
    scans_ = []
    for i in range(30):
        lines = scan_text(rng)
        lines[7] = "when the calibrafion table rneasured quiet"
        lines[9] = "when the navmerge table quiet"
        scans_.append((900 + i, "\n".join(lines), True, "documentation"))
    table = spark.createDataFrame(clean + scans_, "file_id bigint, content string, is_pdf boolean, file_type string")
    got = {(r["file_id"], r["line_no"]) for r in scans.found_faults(table).where("fault = 'misread'").collect()}
    assert got == {(900 + i, 8) for i in range(30)}


def test_models_from_all_texts(spark, monkeypatch):
    """More texts and words than a part holds: all are counted and learnt from."""
    monkeypatch.setattr(scans, "TRAIN_TEXTS", 3)
    monkeypatch.setattr(scans, "TRAIN_WORDS", 10)
    seen, judged = [], scans.judged_pages
    monkeypatch.setattr(scans, "judged_pages", lambda files, model: seen.append(model) or judged(files, model))
    rng = random.Random(6)
    clean = [(i, "\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(9)) + "." for _ in range(14)) + f" own{'abcdefghijklmnopqrstuvwxyz'[i]}word", False, "documentation") for i in range(24)]
    lines = scan_text(rng)
    lines[7] = "when the calibrati0n table rneasured quiet"
    table = spark.createDataFrame([*clean, (900, "\n".join(lines), True, "documentation")], "file_id bigint, content string, is_pdf boolean, file_type string")
    got = {(r["fault"], r["line_no"]) for r in scans.found_faults(table).collect()}
    assert {n for f, n in got if f == "furniture"} == {i + 1 for i, x in enumerate(lines) if "Checking" in x} and {n for f, n in got if f == "misread"} == {8}
    assert {f"own{'abcdefghijklmnopqrstuvwxyz'[i]}word" for i in range(24)} <= seen[0].vocabulary


def test_pages_are_set_once(monkeypatch):
    """Both perceptrons of lines learn from one setting of a text; only its heads lose their capitals for the second."""
    rng = random.Random(6)
    texts = ["\n".join(" ".join(rng.choice(VOCABULARY) for _ in range(9)) + "." for _ in range(14)) for _ in range(20)]
    made, made_by = [], scans.synthetic_scan
    monkeypatch.setattr(scans, "synthetic_scan", lambda *a: made.append(made_by(*a)) or made[-1])
    large, small = scans.train_furniture(texts, 7, frozenset(), 1)
    assert len(made) == len(texts) and large and small
    for lines, truth, smalls in made:
        assert [x.lower() for x in lines] == [x.lower() for x in smalls] and all(t for x, y, t in zip(lines, smalls, truth) if x != y)
        assert scans._prepared_small(scans._prepared(lines), lines, smalls) == scans._prepared(smalls)
    assert any(lines != smalls for lines, _, smalls in made)


def test_folded_lines_as_by_one_pattern():
    fold = str.maketrans("|0156@iefhqy", "lolsbalctbgv")
    for text in ("12a 3b3 ²½x ٣٤ a٣ 5_5 İstanbul ΑΣ\n|0156@iefhqyz, rn-cl. (vv) a1 1 22b", "Checking 12 / 14 off5et\n\n7"):
        want = re.sub(r"(?<![^\W\d_])\d+(?![^\W\d_])|[^\w|@\n]+", "", text.lower()).translate(fold)
        for a, b in scans._FOLD_TWO:
            want = want.replace(a, b)
        assert scans.line_keys(text) == want.split("\n")


def test_words_left_out_before_joins(spark):
    """Of the words of scans those that a join asks for all stay, with their lines, and hardly another, however many there are."""
    words = [f"word{'abcdefghij'[k % 10]}{k}" for k in range(3000)]
    text = "\n".join(" ".join(words[k : k + 10]) for k in range(0, 3000, 10)) + "\nÜber"
    files_ = spark.createDataFrame([(1, text, True, "documentation")], "file_id bigint, content string, is_pdf boolean, file_type string")
    pages = scans.judged_pages(files_, scans.PageModel({"bias": -1.0}, {"bias": -1.0}, frozenset(), {"bias": 1.0}, frozenset()))
    among = spark.createDataFrame([(w,) for w in [*words[::100], "Über", "absent"]], "word string")
    every = {(r["word"], r["lines"]) for r in scans.scan_words(pages).collect()}
    got = {(r["word"], r["lines"]) for r in scans.scan_words(pages, among).collect()}
    want = {x for x in every if x[0] in {*words[::100], "Über"}}
    assert len(every) == 3001 and len(want) == 31 and want <= got <= every and len(got) < 40
