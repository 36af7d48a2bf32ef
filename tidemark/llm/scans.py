"""Text of scanned pages repaired into paragraphs: page furniture, words broken at line ends, misread characters.

Averaged perceptrons decide. One judges lines as furniture from page-position features (what stands next to page breaks
and page numbers, numbers that count up, titles that come back). One says whether a line that ends in a hyphen goes on
in the next line of text. The character editor predicts keep, replace, delete, insert and line-join operations; it is
trained on words of the clean files, misread on purpose, and scores what it would make of a word against leaving it. The
last one accepts or refuses such a proposal from that score, the proposal's rank and how often clean files spell the
word so; it learns from words left out of the editor's training: those misread on purpose are to be put right, those
that stand as they are in clean files, next to a word that one misreading would make of them, are to be left.

All learn from every clean text and word: apart on parts of about ``TRAIN_TEXTS`` texts or ``TRAIN_WORDS`` words, by hash,
whose weights are averaged. Word counts, and the search for faults, cover all files and whole texts.

Defined results: null and empty contents have no faults; is_pdf marks a scan, and so does, in documentation, a form feed,
a word broken at a line end or page numbers that count up; other files have no faults. Ties between proposals go to the
word more frequent in clean files. Repeated rows are judged one by one.
"""

from __future__ import annotations

import gc
import math
import random
import re
import sys
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from operator import itemgetter
from typing import NamedTuple
from zlib import crc32

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread, stored, widened

TRAIN_WORDS, TRAIN_TEXTS, EPOCHS, BEAM, MARGIN = 6000, 300, 4, 16, 20.0
DOUBT = 4  # times as common in scans as in clean texts: not known from these
WORD_BITS = 1 << 23  # of the tables that say which words a join may keep
LONG = 60  # characters from which edits of a word are found by halves, with the same result
EDGES = ".,;:!?\"“”„«»()[]{}¡¿…'’‘·/<>*#=+~—–"
HYPHENS = "-‐‑¬­"
BREAK = "\n"

# What scanners make of characters (right, read as).
MISREADINGS = (
    ("e", "c"), ("c", "e"), ("t", "f"), ("f", "t"), ("a", "@"), ("o", "0"), ("i", "1"), ("l", "1"), ("l", "|"), ("i", "|"), ("l", "I"),
    ("s", "5"), ("b", "6"), ("g", "9"), ("g", "q"), ("q", "g"), ("h", "b"), ("b", "h"), ("n", "ri"), ("d", "cl"), ("m", "rn"), ("u", "ii"),
    ("w", "vv"), ("rn", "m"), ("in", "m"), ("ni", "m"), ("li", "h"), ("cl", "d"), ("ri", "n"), ("ii", "u"), ("vv", "w"), ("z", "2"), ("B", "8"),
    ("S", "5"), ("O", "0"), ("E", "F"), ("y", "v"), ("v", "y"), ("n", "u"), ("u", "n"), ("é", "6"), ("é", "e"), ("ü", "ii"),
)


def _seldom_collect() -> None:
    """In Python workers: no object made here is part of a cycle, so counting references frees all in time."""
    gc.freeze()
    gc.set_threshold(100_000, 50, 100)


class Perceptron:
    """Multiclass, averaged over all steps."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = defaultdict(dict)
        self._sums: dict[tuple[str, str], float] = defaultdict(float)
        self._since: dict[tuple[str, str], int] = defaultdict(int)
        self._step = 0

    def scores(self, features: list[str], labels) -> dict[str, float]:
        out = dict.fromkeys(labels, 0.0)
        for f in features:
            if row := self.weights.get(f):
                for label, w in row.items():
                    if label in out:
                        out[label] += w
        return out

    def learn(self, features: list[str], truth: str, labels, margin: float | None = None) -> None:
        """One step: where another label wins, or comes within ``margin`` of the right one."""
        scores = self.scores(features, labels)
        if margin is None:
            guess = max(scores, key=lambda k: (scores[k], k))
        else:
            guess = max((k for k in scores if k != truth), key=lambda k: (scores[k], k))
            guess = guess if scores[truth] - scores[guess] <= margin else truth
        self._step += 1
        if guess != truth:
            for f in features:
                for label, d in ((truth, 1.0), (guess, -1.0)):
                    key, now = (f, label), self.weights[f].get(label, 0.0)
                    self._sums[key] += (self._step - self._since[key]) * now
                    self._since[key] = self._step
                    self.weights[f][label] = now + d

    def average(self) -> None:
        for f, row in self.weights.items():
            for label, w in list(row.items()):
                total = self._sums[f, label] + (self._step - self._since[f, label]) * w
                row[label] = round(total / max(1, self._step), 4)
        self.weights = {f: {k: v for k, v in row.items() if v} for f, row in self.weights.items() if any(row.values())}
        self._sums, self._since = {}, {}

    def binary(self) -> dict[str, float]:
        """Averaged weights of label 1 against label 0."""
        self.average()
        return {f: row.get("1", 0.0) - row.get("0", 0.0) for f, row in self.weights.items()}


# -- characters -------------------------------------------------------------------------------------------------------


def _features(word: str, i: int) -> list[str]:
    a, b, c, d, e = (word[j] if 0 <= j < len(word) else "^" for j in (i - 2, i - 1, i, i + 1, i + 2))
    mixed = "m" if not c.isalpha() and word[:1].isalpha() else "p"
    return ["0" + c, "1" + b + c, "2" + c + d, "3" + b + c + d, "4" + a + b + c, "5" + c + d + e, "6" + a + b + c + d, "7" + b + c + d + e, "8" + a + b + c + d + e, mixed + c]


class Proposal(NamedTuple):
    """A text for a word: whether lines are joined, whether a letter is changed, and how much better it scores than
    the word with its letters as they are."""

    text: str
    joined: bool
    changed: bool
    margin: float


class Editor:
    """Operation per character: ``=`` keep, ``-`` delete, ``J`` line-join, ``Rxy`` replace by x and insert y after it."""

    def __init__(self, model: Perceptron, options: dict[str, list[str]]) -> None:
        self.weights, self.options = model.weights, options
        self.model = model
        self._word, self._known = "", {}

    def _scores(self, word: str, i: int) -> dict[str, float]:
        """Kept for the word asked for last: its beam and its single edits ask for the same places."""
        if word != self._word:
            self._word, self._known = word, {}
        if i not in self._known:
            self._known[i] = self.model.scores(_features(word, i), self.options[word[i]])
        return self._known[i]

    def _after(self, before: str, c: str, label: str) -> float:
        return self.weights.get("9" + before + c, _EMPTY).get(label, 0.0)

    def proposals(self, word: str, single: bool = True) -> list[Proposal]:
        """The ``BEAM`` best ways to edit the word, and every way to undo one misreading; best first."""
        found: dict[str, Proposal] = {}
        for p in (*self._beam(word), *(self.edits(word) if single else ())):
            if p.text not in found or p.margin > found[p.text].margin:
                found[p.text] = p
        return sorted(found.values(), key=lambda p: (-p.margin, p.text))

    def _beam(self, word: str) -> Iterator[Proposal]:
        # a path: score, last label, whether a letter is changed, and its edits as linked (position, label)
        paths: list[tuple] = [(0.0, "=", False, None)]
        plain, plain_before = 0.0, "="
        for i, c in enumerate(word):
            if c not in self.options:
                paths = [(s, "=", ch, e) for s, _, ch, e in paths]
                plain_before = "="
                continue
            base = self._scores(word, i)
            ways = [(label, s, label[0] == "R" or label == "-" and c not in HYPHENS) for label, s in base.items()]
            after = {before: self.weights.get("9" + before + c, _EMPTY) for before in {p[1] for p in paths}}
            nxt = []
            for score, before, changed, edits in paths:
                add = after[before]
                for label, s, touches in ways:
                    nxt.append((score + s + add.get(label, 0.0), label, changed or touches, edits if label == "=" else (edits, i, label)))
            nxt.sort(key=itemgetter(0), reverse=True)
            paths = nxt[:BEAM]
            still = {k: s + self._after(plain_before, c, k) for k, s in base.items() if k in "=J" or k == "-" and c in HYPHENS}
            label = max(still, key=still.get)
            plain, plain_before = plain + still[label], label
        for score, _, changed, edits in paths:
            text, joined, end = [], False, len(word)
            while edits is not None:
                edits, i, label = edits
                text.append(word[i + 1 : end])
                if label[0] == "R":
                    text.append(label[1:])
                joined |= label == "J"
                end = i
            text.append(word[:end])
            yield Proposal("".join(reversed(text)), joined, changed, score - plain)

    def edits(self, word: str, first: int = 0, last: int | None = None) -> Iterator[Proposal]:
        """Every way to undo one misreading that begins between two places."""
        cut = word.find(BREAK)
        last = len(word) if last is None else last
        for right, wrong in MISREADINGS:
            at = word.find(wrong, first)
            while 0 <= at <= last:
                end = at + len(wrong)
                scores = self._scores(word, at)
                margin = scores["R" + right] - scores["="]
                for k in range(at + 1, end):
                    scores = self._scores(word, k)
                    margin += scores["-"] - scores["="]
                if cut < 0:
                    yield Proposal(word[:at] + right + word[end:], False, True, margin)
                elif end <= cut or at > cut:
                    head, tail = (word[:at] + right + word[end:cut], word[cut + 1 :]) if at < cut else (word[:cut], word[cut + 1 : at] + right + word[end:])
                    for text in (head.rstrip(HYPHENS) + tail, head + tail):
                        yield Proposal(text, True, True, margin)
                at = word.find(wrong, at + 1)


_EMPTY: dict[str, float] = {}


def misread(word: str, rng: random.Random) -> tuple[str, list[str]] | None:
    """A word with one misreading, and the operations that undo it; None where none fits."""
    places = [(m.start(), r, w) for r, w in MISREADINGS for m in re.finditer(re.escape(r), word)]
    if not places:
        return None
    at, right, wrong = rng.choice(places)
    text = word[:at] + wrong + word[at + len(right) :]
    return text, ["="] * at + ["R" + right] + ["-"] * (len(wrong) - 1) + ["="] * (len(word) - at - len(right))


def train_editor(words: list[str], seed: int = 7) -> Editor:
    rng = random.Random(seed)
    options: dict[str, set[str]] = defaultdict(lambda: {"="})
    for right, wrong in MISREADINGS:
        options[wrong[0]].add("R" + right)
        for c in wrong[1:]:
            options[c].add("-")
    for h in HYPHENS:
        options[h].add("-")
    options[BREAK] = {"=", "J"}
    labels = {c: sorted(o) for c, o in options.items()}
    model = Perceptron()

    def broken(text: str, ops: list[str]) -> tuple[str, list[str]]:
        if "-" in text:
            at = text.index("-") + 1
            return text[:at] + BREAK + text[at:], [*ops[:at], "J", *ops[at:]]
        at = rng.randrange(2, len(text) - 1)
        return text[:at] + rng.choice(HYPHENS) + BREAK + text[at:], [*ops[:at], "-", "J", *ops[at:]]

    for _ in range(EPOCHS):
        rng.shuffle(words)
        for n, word in enumerate(words):
            kept = (word, ["="] * len(word))
            cases = [kept, misread(word, rng) or kept]
            if len(word) >= 4:
                cases.append(broken(*cases[n % 2]) if len(cases[n % 2][0]) >= 4 else cases[0])
                other = words[(n * 7 + 1) % len(words)]
                cases.append((word + BREAK + other, ["="] * (len(word) + 1 + len(other))))
            for text, truth in cases:
                before = "="
                for i, (c, label) in enumerate(zip(text, truth)):
                    if len(options := labels.get(c, ["="])) > 1:
                        model.learn([*_features(text, i), "9" + before + c], label, options, 3.0)
                    before = label
    model.average()
    return Editor(model, labels)


# -- lines ------------------------------------------------------------------------------------------------------------

_N = r"(?:\d|[lI|oO](?=[lI|oO]?\d)|(?<=\d)[lI|oO]){1,5}"  # figures, some of them misread
_OF = r"\s*(?:/|of|von|de|sur|из)\s*"
_DECORATED = re.compile(
    rf"(?i:page|p\.|seite|s\.|pág\.|página|стр\.|стр|頁|第)\s*(?P<a>{_N}|[ivxlc]+)(?:{_OF}{_N})?"
    rf"|[\[(\-–—~•·*|]+\s*(?P<b>{_N}|[ivxlc]+)\s*[\])\-–—~•·*|]+|(?P<c>{_N}){_OF}{_N}"
)
_CLOSES_NUMBER = frozenset("lI|oOivxcIVXC])-–—~•·*")
_NOT_LAST = frozenset(".!?;,:" + HYPHENS)
_BARE = re.compile(rf"(?P<a>{_N}|[ivxlc]{{1,7}})")
_HEADING = re.compile(r"\d+(?:\.\d+)+\s|#")
_SENTENCES = re.compile(r"[.!?](?<=[^\W\d_]{4}.) [^\W\d_]")
_COLUMNS = re.compile(r"\S {2,}\S.* {2,}\S")
_RULE = re.compile(r"[-=_*·.\s]+")
_MAYBE_PAGES = re.compile(r"(?m)^\W{0,4}(?:[A-Za-zá]{1,6}\.?\s)?(?:\d{1,5}|[ivxlc]{1,7})(?:\s*(?:/|of|von|de|sur|из)\s*\d+)?\W{0,4}$")
_MAYBE_BREAK = re.compile(rf"[{HYPHENS}](?<=[^\W\d_].)[ \t\r]*\n")
_MAYBE_CUT = re.compile(rf"[{HYPHENS}]\s*\n")
_ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}
_FOLD_ONE = tuple(zip("|0156@iefhqy", "lolsbalctbgv"))  # no result is itself folded, so one after the other is as all at once
_FOLD_TWO = (("rn", "m"), ("cl", "d"), ("ll", "u"), ("vv", "w"), ("rl", "n"), ("ln", "m"), ("lb", "b"))
_NUMBER = re.compile(r"\d(?<![^\W\d_]\d)\d*(?![^\W\d_])")
_FOLDED = re.compile(r"[\w|@\n]+")


def _value(text: str) -> int:
    if not text.isdigit() and any(c in "|oO" or c.isdigit() for c in text):
        text = text.translate(str.maketrans("lI|oO", "11100"))
    if text.isdigit():
        return int(text)
    total = 0
    values = [_ROMAN[c] for c in text.lower()]
    for v, nxt in zip(values, [*values[1:], 0]):
        total += -v if v < nxt else v
    return total


def line_keys(text: str) -> list[str]:
    """Each line without its numbers, misreadings folded, so that running heads of all pages agree."""
    text = _NUMBER.sub("", text.lower())
    for c in " .,-":  # the pattern leaves these out, too, but slowly
        text = text.replace(c, "")
    text = "".join(_FOLDED.findall(text))
    for a, b in (*_FOLD_ONE, *_FOLD_TWO):
        text = text.replace(a, b)
    return text.split("\n")


class PageModel(NamedTuple):
    """Weights of line features, the same for lines that begin small, pairs of words that open sentences, weights of line
    joins, and words of clean texts."""

    weights: dict[str, float]
    small: dict[str, float]
    openers: frozenset[str]
    joins: dict[str, float]
    vocabulary: frozenset[str]


_OPENING = re.compile(r"[.!?](?<=[^\W\d_]{3}.)[\"”»]? ([^\s#*-]\S* \S+)")


def opening(text: str) -> str:
    """The first two words of a line, figures masked."""
    return re.sub(r"\d+", "#", " ".join(text.split()[:2]))


def sentence_openers(texts: list[str]) -> frozenset[str]:
    counts = Counter(opening(m) for t in texts for m in _OPENING.findall(t))
    return frozenset(k for k, n in counts.items() if n > 1)


def _page_number(x: str) -> tuple[str, int] | None:
    """Form and value of a line that is a page number, if its last character may end one."""
    if m := _DECORATED.fullmatch(x):
        return re.sub(r"\d+|(?<![a-zà-ÿ])[ivxlc]+(?![a-zà-ÿ])", "#", x.lower()), _value(m["a"] or m["b"] or m["c"])
    if m := _BARE.fullmatch(x):
        return "digits" if any(c.isdigit() for c in x) else "roman", _value(m["a"])
    return None


def _prepared(lines: list[str]) -> tuple:
    """What both looks at the lines share: stripped lines, page numbers and their forms, lines with text and their places,
    folded lines, the length of a full line, and the lines that begin or end a page by a form feed."""
    bare = [x.strip("\f \t\r") for x in lines]
    numbers: dict[int, tuple[str, int]] = {}
    for i, x in enumerate(bare):
        if x and (x[-1] in _CLOSES_NUMBER or x[-1].isdigit()) and (number := _page_number(x)):
            numbers[i] = number
    forms: dict[str, set[int]] = defaultdict(set)
    for form, value in numbers.values():
        forms[form].add(value)
    texts = [i for i, x in enumerate(bare) if x]
    place = {i: k for k, i in enumerate(texts)}
    folded = line_keys("\n".join(lines))
    lengths = sorted(len(bare[i]) for i in texts)
    feeds = {j for i, x in enumerate(lines) if "\f" in x for j in (i - 1, i)}
    return bare, numbers, forms, texts, place, folded, lengths[int(len(lengths) * 0.8)] if lengths else 0, feeds


def _prepared_small(prepared: tuple, lines: list[str], small: list[str]) -> tuple:
    """``_prepared(small)``, of lines that differ from ``lines`` by small letters only."""
    bare, numbers, *rest = prepared
    changed = {i: b.strip("\f \t\r") for i, (a, b) in enumerate(zip(lines, small)) if a != b}
    if any(i in numbers or len(x) != len(bare[i]) or x and _page_number(x) for i, x in changed.items()):
        return _prepared(small)
    return [changed.get(i, x) for i, x in enumerate(bare)] if changed else bare, numbers, *rest


def line_features(lines: list[str], openers: frozenset[str] = frozenset(), small: bool = False, prepared: tuple | None = None) -> dict[int, list[str]]:
    """Page-position features of lines that might be furniture; a line without any cannot be.

    Page numbers and lines that begin with a capital or a figure, or if ``small`` lines that begin with a small letter:
    most of these are text, so another perceptron judges them.
    """
    bare, numbers, forms, texts, place, folded, full, feeds = prepared or _prepared(lines)
    if small:
        keys = {i: folded[i] for i in texts if (x := bare[i])[0].islower() and x[-1] not in _NOT_LAST and i not in numbers}
    else:
        keys = {i: folded[i] for i in texts if ((x := bare[i])[0].isupper() or x[0].isdigit()) and x[-1] not in _NOT_LAST and i not in numbers}
    if small and not keys:
        return {}
    counts = Counter(k for k in keys.values() if len(k) >= 6)
    near: Counter = Counter()
    stands: dict[str, list[int]] = defaultdict(list)
    for i, k in keys.items() if len(counts) < counts.total() else ():
        if counts[k] > 1:
            at = place[i]
            beside = [texts[j] for j in (at - 1, at + 1) if 0 <= j < len(texts)]
            near[k] += any(j in numbers for j in beside) or i in feeds
            stands[k].append(at)
    spaced = {}
    for k, at in stands.items():
        gaps = [b - a for a, b in zip(at, at[1:])]
        spaced[k] = "two" if len(gaps) < 2 else "even" if max(gaps) <= 2 * min(gaps) else "uneven"
    out: dict[int, list[str]] = {}
    for i in keys if small else sorted({*keys, *numbers}):
        x = bare[i]
        if i in numbers:
            form, value = numbers[i]
            kind = form if form in ("digits", "roman") else "decorated"
            counting = value + 1 in forms[form] or value - 1 in forms[form]
            at = place[i]
            beside = [texts[j] for j in (at - 1, at + 1) if 0 <= j < len(texts)]
            alone = i in (texts[0], texts[-1]) or i in feeds or not bare[i - 1] or (i + 1 < len(bare) and not bare[i + 1]) or any(counts[keys.get(j, "")] > 1 for j in beside)
            out[i] = [f"number {kind}", f"number {kind} counting {counting}", f"number {kind} alone {alone}", f"number counting {counting} alone {alone}"]
            continue
        k = keys[i]
        n = counts[k]
        at = place[i]
        before, after = texts[at - 1] if at else -1, texts[at + 1] if at + 1 < len(texts) else -1
        aside = n < 2 and not (before in numbers or after in numbers or i in feeds)
        if aside and (not at or bare[before][-1] not in HYPHENS):
            continue
        left = next((bare[texts[j]] for j in range(at - 1, max(-1, at - 4), -1) if texts[j] not in numbers), "")
        broken = len(left) > 1 and left[-1] in HYPHENS and left[-2].isalpha()
        if aside and not broken:
            continue
        table = x[-2:] == "ok" and bool(_COLUMNS.search(x)) or bool(_RULE.fullmatch(x))
        sentence = bool(_SENTENCES.search(x))
        shape = "prose" if x.count(" ") > 2 and opening(x) in openers else "heading" if _HEADING.match(x) else "table" if table else "sentence" if sentence else "long title" if len(x) >= 0.9 * full else "title"
        feed = "feed" if i in feeds else "none"
        if n < 2:
            right = next((bare[texts[j]] for j in range(at + 1, min(len(texts), at + 4)) if texts[j] not in numbers), "")
            amid = bool(left) and left[-1] not in ".!?:" and right[:1].islower()
            side = ("number before " if before in numbers else "") + ("number after" if after in numbers else "")
            flow = "broken" if broken else "amid" if amid else "apart"
            out[i] = [f"once {shape}", f"once {shape} {flow}", f"once {shape} {flow} {side} {feed}", f"once {shape} {flow} short {len(x) < 0.75 * full}", f"once {shape} {side}", f"once {shape} {side} {feed}", f"once {shape} blank after {i + 1 < len(bare) and not bare[i + 1]} {side}"]
            continue
        part = near[k] / n
        beside = "beside" if part >= 0.5 else "some" if part else "apart"
        out[i] = [f"again {shape}", f"again {shape} {beside}", f"again {min(n, 4)} {shape}", f"again {min(n, 4)} {shape} {beside}", f"again {shape} {feed}", f"again {min(n, 4)} {shape} {spaced[k]}"]
    return out


def counting_pages(lines: list[str]) -> bool:
    return sum("counting True" in f[1] for f in line_features(lines).values() if f[0].startswith("number")) >= 2


def synthetic_scan(text: str, rng: random.Random) -> tuple[list[str], list[bool], list[str]]:
    """Clean text set as pages of one layout, which lines are furniture, and the lines again with heads without capitals."""
    words = text.split()
    width, per_page = rng.randint(45, 80), rng.randint(8, 30)
    body: list[str] = []
    line = ""
    sections = [" ".join(w.strip('.,;:!?') for w in rng.sample(words, min(4, len(words)))).capitalize() for _ in range(3)]
    for w in words:
        if len(line) + len(w) + 1 > width or rng.random() < 0.01:
            if len(w) > 5 and w.isalpha() and rng.random() < 0.2:
                at = rng.randint(2, len(w) - 2)
                line, w = f"{line} {w[:at]}-", w[at:]
            body.append(line)
            line = ""
            if rng.random() < 0.12:
                body.append("")
            if rng.random() < 0.05:
                body.extend(("", "", f"{rng.randint(1, 9)}.{rng.randint(1, 9)} {rng.choice(sections)}", ""))
            if rng.random() < 0.04 and len(body) > 5:
                body.append(rng.choice(body))
            if rng.random() < 0.03:
                body.extend(f"{rng.randint(1, 50)}  {rng.choice(words)}  {rng.random() * 90:.1f}  ok" for _ in range(3))
            if rng.random() < 0.03:
                body.append(rng.choice(("It works.", "locked.", "again.", "without input.")))
        line = f"{line} {w}" if line else w
    body.append(line)
    title = " ".join(w.strip(".,;:!?") for w in rng.sample(words, min(rng.randint(3, 8), len(words)))).capitalize() + rng.choice(("", " handbook", " — Rev B", " / A / internal"))
    if rng.random() < 0.25:
        title = title.upper()
    head, foot = rng.choice((None, "{t}", "{t}", "{t} · {s}", "{s}", "{n}    {t}", "{t}  |  {n}", "{n}")), rng.choice((None, "Page {n}", "{n}", "- {n} -", "[{n}]", "{n} / {m}", "p. {n}", "~ {n} ~", "{r}"))
    first, blank, feed = rng.randint(1, 15), rng.random() < 0.5, rng.random() < 0.5
    pages = [body[i : i + per_page] for i in range(0, len(body), per_page)]
    lines, truth, smalls = [], [], []

    def put(x: str, is_furniture: bool, small: str | None = None) -> None:
        lines.append(x)
        truth.append(is_furniture)
        smalls.append(x if small is None else small)

    roman = lambda n: "x" * (n // 10) + ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix")[n % 10]
    for k, page in enumerate(pages):
        say = lambda form, t=title, n=first + k: form.format(t=t, s=sections[0], n=n, m=first + len(pages), r=roman(n))
        start = len(lines)
        if head and rng.random() < 0.95:
            put(say(head), True, say(head, title.lower()))
            if blank:
                put("", False)
        lines += page
        smalls += page
        truth += [False] * len(page)
        if foot and rng.random() < 0.95:
            if blank:
                put("", False)
            put(say(foot), True)
        if feed and k and start < len(lines):
            lines[start], smalls[start] = "\f" + lines[start], "\f" + smalls[start]
    return lines, truth, smalls


def binary_perceptron(passes: list[list[tuple[list[str], bool]]]) -> dict[str, float]:
    """Averaged weights of true against false, as ``Perceptron.binary`` gives them; one list of cases a pass."""
    weights: dict[str, float] = {}
    sums: dict[str, float] = defaultdict(float)
    since: dict[str, int] = defaultdict(int)
    step, get = 0, weights.get
    for cases in passes:
        for features, truth in cases:
            score = 0.0
            for f in features:
                score += get(f, 0.0)
            step += 1
            if (score >= 0) != truth:
                for f in features:
                    now = get(f, 0.0)
                    sums[f] += (step - since[f]) * now
                    since[f] = step
                    weights[f] = now + (1.0 if truth else -1.0)
    averages = {f: round((sums[f] + (step - since[f]) * w) / max(1, step), 4) for f, w in weights.items()}
    return {f: 2 * w for f, w in averages.items() if w}


def train_furniture(texts: list[str], seed: int = 7, openers: frozenset[str] | None = None, layouts: int = EPOCHS) -> tuple[dict[str, float], dict[str, float]]:
    """The binary perceptrons, of lines and of those that begin small: furniture above 0. Each text is set as pages in
    ``layouts`` ways, over which the passes turn; both learn from the same pages."""
    openers = sentence_openers(texts) if openers is None else openers
    rng = random.Random(seed)
    large: list[list[tuple[list[str], bool]]] = []
    small: list[list[tuple[list[str], bool]]] = []
    for _ in range(min(layouts, EPOCHS)):
        large.append([])
        small.append([])
        for text in texts:
            if len(text.split()) < 40:
                continue
            lines, truth, smalls = synthetic_scan(text, rng)
            prepared = _prepared(lines)
            large[-1] += [(["bias", *features], truth[i]) for i, features in line_features(lines, openers, False, prepared).items()]
            small[-1] += [(["bias", *features], truth[i]) for i, features in line_features(smalls, openers, True, _prepared_small(prepared, lines, smalls)).items()]
    return tuple(binary_perceptron([made[e % len(made)] for e in range(EPOCHS)]) for made in (large, small))


def _clean_words_and_openings(text: str) -> tuple[set[str], list[str]]:
    """Small words of a text, without what may be the end of a word broken before, and how its sentences open."""
    tokens: set[str] = set()
    broken = False
    for line in text.split("\n") if _MAYBE_CUT.search(text) else (text,):
        if found := line.split():
            tokens.update(found[1:] if broken else found)
            broken = found[-1][-1] in HYPHENS
    return {c.lower() for t in tokens if (c := t.strip(EDGES))}, [opening(m) for m in _OPENING.findall(text)]


def mixed_weights(rows: DataFrame, parts: int) -> DataFrame:
    """Weights learnt apart on equal parts of the cases, averaged: a weight a part doesn't have is 0 there."""
    return rows.groupBy("kind", "feature", "label").agg(F.round(F.sum("weight") / parts, 6).alias("weight"))


_WEIGHTS = "kind string, feature string, label string, weight double"


def learnt_pages(clean: DataFrame) -> PageModel:
    """The page model from all clean texts: words and openings are counted over all, and every text is learnt from.

    Perceptrons learn apart on parts of about ``TRAIN_TEXTS`` texts, by hash, and are averaged. Each text has as many layouts
    as make ``EPOCHS`` times ``TRAIN_TEXTS`` together, one at least. Openers are as frequent as two in ``TRAIN_TEXTS`` texts,
    words ten times rarer at least: what is rarer may come from scans not yet told from clean texts.
    """
    texts = stored(spread(clean.select("content", F.xxhash64("content").alias("text_id"))))
    total = texts.select("text_id").distinct().count()
    parts = max(1, math.ceil(total / TRAIN_TEXTS))
    layouts = max(1, min(EPOCHS, math.ceil(EPOCHS * TRAIN_TEXTS / max(1, total))))
    sharded = texts.withColumn("part", F.pmod(F.xxhash64("text_id"), F.lit(parts)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seldom_collect()
        for batch in batches:
            words, openings = Counter(), Counter()
            for text in batch["content"]:
                mine, opens = _clean_words_and_openings(text)
                words.update(mine)
                openings.update(opens)
            for kind, counts in (("word", words), ("opener", openings)):
                yield pd.DataFrame([(kind, k, n) for k, n in counts.items()], columns=["kind", "feature", "n"])

    each = distinct_texts(texts.withColumn("scan", F.lit(False))).select("content")
    counts = each.mapInPandas(count, "kind string, feature string, n bigint").groupBy("kind", "feature").agg(F.sum("n").alias("n"))
    least = F.when(F.col("kind") == "word", F.lit(total / (10 * TRAIN_TEXTS))).otherwise(F.lit(max(2.0, 2 * total / TRAIN_TEXTS)))
    known = counts.where(F.col("n") >= least).select("kind", "feature").collect()  # bounded: rarer ones are left out by their share
    openers = frozenset(r["feature"] for r in known if r["kind"] == "opener")
    vocabulary = frozenset(r["feature"] for r in known if r["kind"] == "word")

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        _seldom_collect()
        mine = list(part.drop_duplicates("text_id").sort_values("text_id")["content"])
        rows = [(kind, f, "", w) for kind, weights in zip(("large", "small"), train_furniture(mine, 7 + int(key[0]), openers, layouts)) for f, w in weights.items()]
        return pd.DataFrame(rows, columns=["kind", "feature", "label", "weight"])

    weights: dict[str, dict[str, float]] = {"large": {}, "small": {}}
    for r in mixed_weights(sharded.groupBy("part").applyInPandas(learn, _WEIGHTS), parts).collect():
        weights[r["kind"]][r["feature"]] = r["weight"]
    return PageModel(weights["large"], weights["small"], openers, train_joins(sorted(vocabulary)), vocabulary)


def furniture_lines(lines: list[str], model: PageModel) -> set[int]:
    out, prepared = set(), _prepared(lines)
    for weights, small in ((model.weights, False), (model.small, True)):
        for i, features in line_features(lines, model.openers, small, prepared).items():
            if weights.get("bias", 0.0) + sum(weights.get(f, 0.0) for f in features) > 0:
                out.add(i)
    return out


# -- words over two lines ---------------------------------------------------------------------------------------------


def _class(c: str) -> str:
    return "none" if not c else "small" if c.islower() else "large" if c.isupper() else "letter" if c.isalpha() else "figure" if c.isdigit() else "sign"


def _join_features(last: str, first: str, vocabulary: frozenset[str], without: str = "") -> list[str]:
    """Of a token that ends in a hyphen and the first token of the next line of text; ``without`` counts as unknown."""
    head, tail = last.lstrip(EDGES), first.rstrip(EDGES + HYPHENS)
    stem = head.rstrip(HYPHENS)
    known = lambda w: w.lower() in vocabulary and w.lower() != without
    word = "joined" if known(stem + tail) else "hyphenated" if known(f"{stem}-{tail}") else "open"
    parts = f"{known(stem)} {known(tail)}"
    sides = f"{_class(stem[-1:])} {_class(tail[:1])}"
    return ["bias", f"word {word}", f"parts {parts}", f"word {word} {parts}", f"sides {sides}", f"short {len(tail) <= 3} {word} {parts}", f"case {stem[:1].isupper()} {_class(tail[:1])}", f"hyphens {len(head) - len(stem)}"]


def train_joins(words: list[str], seed: int = 7) -> dict[str, float]:
    """The binary perceptron: above 0 the word goes on. Words are cut anywhere, half of them left out of the vocabulary;
    against them stand whole words with a hyphen before other whole words, figures, signs and dashes. Beyond ``TRAIN_WORDS``
    words they are learnt in parts and averaged."""
    rng = random.Random(seed)
    words = [w for w in words if w.replace("-", "").isalpha() and len(w) >= 4]
    rng.shuffle(words)
    everything = frozenset(words)
    parts = max(1, math.ceil(len(words) / TRAIN_WORDS))
    mixed: dict[str, float] = defaultdict(float)
    for k in range(parts):
        for f, w in _joins_of(words[k::parts], everything, rng).items():
            mixed[f] += w / parts
    return dict(mixed)


def _joins_of(words: list[str], everything: frozenset[str], rng: random.Random) -> dict[str, float]:
    model = Perceptron()
    for _ in range(EPOCHS if len(words) > 1 else 0):
        for w in words:
            other = rng.choice(words)
            at = w.index("-") + 1 if "-" in w[1:-1] else rng.randrange(2, len(w) - 1)
            big = w[0].upper() + w[1:] if rng.random() < 0.3 else w
            head = big[:at] if big[at - 1] == "-" else big[:at] + rng.choice(HYPHENS)
            model.learn(_join_features(head, big[at:], everything, rng.choice(("", w))), "1", ("0", "1"), MARGIN)
            # the next line may be a head that nobody took for one: then the cut word speaks for itself
            model.learn(_join_features(head, other[0].upper() + other[1:], everything), "0" if head[:-1].lower() in everything else "1", ("0", "1"), MARGIN)
            wrong = rng.choice(((big + "-", other), (f"{rng.randint(1, 99)}-", rng.choice((other, str(rng.randint(1, 99))))), ("-", other), (big + "-", rng.choice(("-", "3.5", "(", "/")))))
            model.learn(_join_features(*wrong, everything), "0", ("0", "1"), MARGIN)
    return model.binary()


def line_breaks(lines: list[str], furniture: set[int], model: PageModel) -> dict[int, tuple[str, int]]:
    """Line -> (its last word, break and first word of the next line of text, that line) where a word goes on."""
    out: dict[int, tuple[str, int]] = {}
    before: tuple[int, str] | None = None
    for j, x in enumerate(lines):
        if j in furniture or not (bare := x.strip("\f \t\r")):
            continue
        if before is not None:
            i, last = before
            first = bare.split(None, 1)[0]
            weights = model.joins
            if first[0] not in HYPHENS and sum(weights.get(f, 0.0) for f in _join_features(last, first, model.vocabulary)) > 0:
                out[i] = (last.lstrip(EDGES) + BREAK + first.rstrip(EDGES + HYPHENS), j)
        before = (j, bare.rsplit(None, 1)[-1]) if bare[-1] in HYPHENS and len(bare) > 1 else None
    return out


# -- files ------------------------------------------------------------------------------------------------------------

def is_scan(content: str, lines: list[str], is_pdf: bool | None, file_type: str | None, model: PageModel) -> bool:
    if is_pdf:
        return True
    if file_type != "documentation":
        return False
    if "\f" in content:
        return True
    if _MAYBE_BREAK.search(content) and line_breaks(lines, furniture_lines(lines, model), model):
        return True
    return len(_MAYBE_PAGES.findall(content)) >= 2 and counting_pages(lines)


def core(token: str) -> str:
    return token.strip(EDGES)


def _words_of(content: str) -> set[str]:
    return {c for t in set(content.split()) if (c := t.strip(EDGES))}


_PAGES = "file_id bigint, text_id bigint, content string, scan boolean, furniture array<int>, breaks array<struct<line: int, next: int, word: string>>, words string"


def _placed_words(lines: list[str], furniture: set[int], breaks: dict[int, tuple[str, int]]) -> str:
    """Words without furniture and without the parts of words over two lines, a row each: the word, a tab and its lines,
    counted from 1."""
    begun = {j for _, j in breaks.values()}
    where: dict[str, str] = {}
    for i, x in enumerate(lines):
        if i in furniture:
            continue
        tokens = x.split()
        if i in breaks:
            del tokens[-1:]
        if i in begun:
            del tokens[:1]
        at = str(i + 1)
        for t in tokens:
            where[t] = f"{where[t]},{at}" if t in where else at
    merged: dict[str, str] = {}
    for t, at in where.items():
        if c := t.strip(EDGES):
            merged[c] = f"{merged[c]},{at}" if c in merged else at
    return "\n".join(map("\t".join, merged.items()))


def judged_pages(files: DataFrame, model: PageModel) -> DataFrame:
    """Every text read once by Python: whether it is a scan, its furniture lines, its words over two lines, and its other
    words with the lines they stand on, as one string (it crosses to the JVM at a fraction of the cost of arrays)."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seldom_collect()
        for batch in batches:
            scan, furniture, breaks, words = [], [], [], []
            for content, is_pdf, file_type in zip(batch["content"], batch["is_pdf"], batch["file_type"]):
                lines = content.split("\n")
                scan.append(is_scan(content, lines, is_pdf, file_type, model))
                gone = furniture_lines(lines, model) if scan[-1] else set()
                found = line_breaks(lines, gone, model) if scan[-1] else {}
                furniture.append(sorted(gone))
                breaks.append([(i, j, w) for i, (w, j) in found.items()])
                words.append(_placed_words(lines, gone, found) if scan[-1] else "")
            yield batch[["file_id", "text_id", "content"]].assign(scan=scan, furniture=furniture, breaks=breaks, words=words)

    slim = files.where("content <> ''").select("file_id", "content", "is_pdf", "file_type", F.xxhash64("content").alias("text_id"))
    return stored(spread(slim).mapInPandas(work, _PAGES))


def distinct_texts(pages: DataFrame) -> DataFrame:
    """One row a text, whatever its copies; only texts that have copies are shuffled."""
    again = stored(pages.groupBy("text_id").agg(F.count("*").alias("n")).where("n > 1").select("text_id"))  # then its size is known
    return pages.join(again, "text_id", "left_anti").unionByName(pages.join(again, "text_id", "left_semi").dropDuplicates(["text_id", "scan"]))


def clean_words(pages: DataFrame) -> DataFrame:
    """(word, n_clean): words of clean files, small, with the number of texts that have them."""
    clean = distinct_texts(pages.where("not scan").select("text_id", "scan", "content"))
    counted = counted_words(clean.select("content"), lambda text: _words_of(text.lower()))
    return counted.groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n_clean"))


def counted_words(texts: DataFrame, words: Callable[[str], Iterable[str]]) -> DataFrame:
    """(word, n): how often ``words`` of the texts in the only column give each; several rows a word, for sums to come: they are
    counted over many texts before they cross to the JVM."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seldom_collect()
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.iloc[:, 0]:
                counts.update(words(text))
                if len(counts) > 100_000:
                    yield pd.DataFrame(counts.items(), columns=["word", "n"])
                    counts.clear()
        yield pd.DataFrame(counts.items(), columns=["word", "n"])

    return texts.mapInPandas(count, "word string, n bigint")


def word_bits(words: DataFrame) -> Broadcast[bytes]:
    """A bit set for the hash of every ``word``: a word without its bit (``_has_bit``) is not among them. Of fixed size; the
    more words, the more others pass too, so it saves rows before a join and never stands for it."""
    at = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(WORD_BITS))
    rows = words.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("k")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = array("q", bytes(WORD_BITS // 8))
    for k, bits in zip(rows["k"].to_pylist(), rows["bits"].to_pylist()):
        table[k] = bits
    if sys.byteorder == "big":
        table.byteswap()
    return words.sparkSession.sparkContext.broadcast(table.tobytes())


def _has_bit(bits: bytes, word: str) -> int:
    at = crc32(word.encode()) % WORD_BITS
    return bits[at >> 3] >> (at & 7) & 1


def scan_words(pages: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(file_id, text_id, word, lines) of scans, without furniture; a word over two lines has both. For a join with ``among``,
    most words that it hasn't are left out."""
    scans = pages.where("scan")
    known = word_bits(among) if among is not None else None

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seldom_collect()
        bits = known.value if known is not None else None
        for batch in batches:
            out = []
            for file_id, text_id, words in zip(batch["file_id"], batch["text_id"], batch["words"]):
                each = words.split()
                out += [(file_id, text_id, w, lines) for w, lines in zip(each[::2], each[1::2]) if bits is None or _has_bit(bits, w)]
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=["file_id", "text_id", "word", "lines"])
                    out = []
            yield pd.DataFrame(out, columns=["file_id", "text_id", "word", "lines"])

    single = scans.select("file_id", "text_id", "words").mapInPandas(work, "file_id bigint, text_id bigint, word string, lines string")
    broken = scans.select("file_id", "text_id", F.explode("breaks").alias("x")).select("file_id", "text_id", "x.word", F.concat_ws(",", F.col("x.line") + 1, F.col("x.next") + 1).alias("lines"))
    return single.unionByName(broken)


def asked_words(pages: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, n, n_own): words of scans that clean files do not know, or seem to know only from scans taken for clean files,
    with the numbers of scans and of clean texts that have them.

    A misreading common in scans gets into clean files with the few scans that nothing marks as such, and the more so the
    more files there are. So a word is in doubt if its share of scans is over ``DOUBT`` times its share of clean texts (one scan
    proves nothing), and then counts as misread only for a word that clean texts have ``DOUBT`` times as often.
    """
    scans = distinct_texts(pages.where("scan").select("text_id", "scan", "words", "breaks"))
    broken = scans.select(F.explode(F.array_distinct("breaks.word")).alias("word"), F.lit(1).cast("bigint").alias("n"))
    each = counted_words(scans.select("words"), lambda text: text.split()[::2]).unionByName(broken)
    counted = stored(each.groupBy("word").agg(F.sum("n").alias("n")).where(_fits(F.col("word"))))
    small = counted.groupBy(F.lower("word").alias("_small")).agg(F.sum("n").alias("n_scan"))
    texts = pages.agg(*[F.count_distinct(F.when(which, F.col("text_id"))) for which in (F.col("scan"), ~F.col("scan"))]).first()
    rate = F.col("n_clean") * float(texts[0]) * DOUBT < (F.col("n_scan") - 1) * float(texts[1])
    judged = small.join(lexicon.withColumnRenamed("word", "_small"), "_small", "left").where(F.col("n_clean").isNull() | rate).select("_small", F.coalesce("n_clean", F.lit(0)).alias("n_own"))
    return stored(counted.join(judged, F.lower("word") == F.col("_small")).select("word", "n", "n_own"))


def _in_second(word: str, fixed: str) -> bool:
    if BREAK not in word:
        return False
    head = word.split(BREAK)[0].rstrip(HYPHENS)
    return fixed[: len(head)] == head


_ODD = re.compile(r"[^\W\d_][0-9@|]+[^\W\d_]|^[0-9@|][^\W\d_]{3}")
_PROPOSED = "word string, n bigint, fixed string, joined boolean, changed boolean, margin double, rank int"


def _fits(word: Column) -> Column:
    """More letters than figures, and no hexadecimal number."""
    letters, digits = F.length(F.regexp_replace(word, r"\P{L}", "")), F.length(F.regexp_replace(word, r"\P{Nd}", ""))
    return (letters > digits) & ~word.rlike("^0[xX]")


def _accept_features(word: str, fixed: str, margin: float, rank: int, n: int, n_clean: int) -> list[str]:
    size = int(math.copysign(math.log2(1 + abs(margin)), margin))
    often = max(-3, min(8, int(math.log2((n_clean + 0.5) / (n + 0.5)))))
    kind = ("odd " if _ODD.search(word) else "") + ("figures" if any(c.isdigit() for c in fixed) else "letters")
    return ["bias", f"margin {size}", f"first {rank == 0}", f"often {often}", f"kind {kind}", f"margin {size} often {often}", f"kind {kind} often {often}", f"kind {kind} margin {size}", f"length {min(len(fixed), 6)} often {often}"]


_PROPOSAL = ["word", "n", "fixed", "joined", "changed", "margin", "rank"]


def proposals(words: DataFrame, lexicon: DataFrame, editor: Editor) -> DataFrame:
    """What the editor makes of ``words`` (word, n), as far as clean files spell it so.

    Every single edit of a word is as long as the word itself, so those of words beyond ``LONG`` characters are found
    from the clean words instead, by the half that the edit leaves alone.
    """
    known = word_bits(lexicon)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        _seldom_collect()
        bits = known.value
        for batch in batches:
            out: list[tuple] = []
            for word, n in zip(batch["word"], batch["n"]):
                for rank, p in enumerate(editor.proposals(word, len(word) <= LONG)):
                    if p.text != word and BREAK not in p.text and _has_bit(bits, p.text.lower()):
                        out.append((word, n, p.text, p.joined, p.changed, p.margin, rank))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=_PROPOSAL)
                    out = []
            yield pd.DataFrame(out, columns=_PROPOSAL)

    clean = lexicon.select(F.col("word").alias("_known"), "n_clean")
    short = widened(words, "word").mapInPandas(work, _PROPOSED).hint("merge").join(clean, F.lower("fixed") == F.col("_known")).drop("_known")
    return short.unionByName(_long_edits(words.where(F.length("word") > LONG), clean.where(F.length("_known") >= LONG - 3), editor))


def _long_edits(words: DataFrame, clean: DataFrame, editor: Editor) -> DataFrame:
    """Single edits of long words: the clean word has the same first or second half."""
    head, tail = F.substring_index("word", BREAK, 1), F.substring_index("word", BREAK, -1)
    texts = F.when(F.col("word").contains(BREAK), F.array(F.concat(F.rtrim(head, F.lit(HYPHENS)), tail), F.concat(head, tail))).otherwise(F.array("word"))
    asked = words.select("word", "n", F.explode(F.array_distinct(texts)).alias("text"))

    def keys(text: Column, size: Column) -> Column:
        half = F.floor(size / 2).cast("int")
        part = lambda kind, x: F.struct(F.lit(kind).alias("kind"), size.alias("size"), F.xxhash64(x).alias("half"))
        return F.array(part("first", F.left(text, half - 1)), part("second", F.right(text, size - half)))

    left = asked.select("word", "n", "text", F.explode(keys(F.lower("text"), F.length("text"))).alias("k"))
    size = F.length("_known")
    right = clean.select("_known", "n_clean", F.explode(F.concat(*[keys(F.col("_known"), size + d) for d in (-1, 0, 1)])).alias("k"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, n, text, known, n_clean in zip(*(batch[c] for c in ("word", "n", "text", "_known", "n_clean"))):
                small = text.lower()
                p = next((i for i, (a, b) in enumerate(zip(small, known)) if a != b), min(len(small), len(known)))
                for edit in editor.edits(text, max(0, p - 2), p + 2):
                    if edit.text.lower() == known:
                        out.append((word, n, edit.text, BREAK in word, True, edit.margin, 0, n_clean))
            yield pd.DataFrame(out, columns=[*_PROPOSAL, "n_clean"])

    both = left.join(right.hint("merge"), "k").select("word", "n", "text", "_known", "n_clean").distinct()
    return both.mapInPandas(verify, _PROPOSED + ", n_clean bigint")


def train_acceptance(sample: list[str], lexicon: DataFrame, editor: Editor, seed: int = 7) -> dict[str, float]:
    """The binary perceptron: above 0 a proposal is right. From words the editor hasn't seen, misread on purpose, and the
    same words as they are, which have themselves left out of the clean ones."""
    rng = random.Random(seed)
    truth = _acceptance_cases(sample, rng)
    cases = lexicon.sparkSession.createDataFrame(list(truth), "string").select(F.col("value").alias("word"), F.lit(1).cast("bigint").alias("n"))
    rows = proposals(cases, lexicon, editor).where(_PROPOSES).select(*_JUDGED).collect()  # of the words given
    model = _accepting([(*r, truth[r[0]]) for r in rows], rng)
    return model.binary()


_PROPOSES, _JUDGED = "changed and lower(fixed) <> lower(word)", ["word", "fixed", "margin", "rank", "n_clean"]


def _acceptance_cases(sample: list[str], rng: random.Random) -> dict[str, str]:
    truth: dict[str, str] = {}
    sample = [w.upper() if any(c.isdigit() for c in w) else w for w in sample]  # codes mostly stand in capitals
    for word in sample:
        for _ in range(1 if any(c.isdigit() for c in word) else 3):
            if made := misread(word, rng):
                truth[made[0]] = word
    for word in sample:
        truth[word] = ""  # nothing is right but the word itself
    return truth


def _accepting(rows: list[tuple], rng: random.Random) -> Perceptron:
    rows = sorted(rows)
    model = Perceptron()
    for _ in range(EPOCHS):
        rng.shuffle(rows)
        for word, fixed, margin, rank, n_clean, right_one in rows:
            features = _accept_features(word, fixed, margin, rank, rng.randint(1, 3), n_clean)
            right = right_one == fixed
            model.learn(features, "1" if right else "0", ("0", "1"), MARGIN if right or any(c.isdigit() for c in fixed) else 0.0)  # few words of scans, but many codes, are unknown and right
    return model


def learnt_acceptance(words: DataFrame, lexicon: DataFrame, editor: Editor) -> dict[str, float]:
    """As ``train_acceptance``, from words of any number: in parts of about ``TRAIN_WORDS``, by hash, and averaged."""
    parts, hashed = _in_parts(words)

    def make(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        truth = _acceptance_cases(list(part.sort_values(["h", "word"])["word"]), random.Random(7 + int(key[0])))
        return pd.DataFrame([(key[0], w, t) for w, t in truth.items()], columns=["part", "word", "truth"])

    cases = stored(hashed.groupBy("part").applyInPandas(make, "part bigint, word string, truth string"))
    asked = cases.select("word").distinct().withColumn("n", F.lit(1).cast("bigint"))
    rows = proposals(asked, lexicon, editor).where(_PROPOSES).select(*_JUDGED).join(cases.hint("merge"), "word")

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        model = _accepting(list(part[[*_JUDGED, "truth"]].itertuples(index=False, name=None)), random.Random(8 + int(key[0])))
        return pd.DataFrame([("", f, "", w) for f, w in model.binary().items()], columns=["kind", "feature", "label", "weight"])

    return {r["feature"]: r["weight"] for r in mixed_weights(rows.groupBy("part").applyInPandas(learn, _WEIGHTS), parts).collect()}


def learnt_editor(words: DataFrame) -> Editor:
    """As ``train_editor``, from words of any number: in parts of about ``TRAIN_WORDS``, by hash, and averaged."""
    parts, hashed = _in_parts(words)

    def learn(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        weights = train_editor(list(part.sort_values(["h", "word"])["word"])).weights
        return pd.DataFrame([("", f, label, w) for f, row in weights.items() for label, w in row.items()], columns=["kind", "feature", "label", "weight"])

    editor = train_editor([])
    for r in mixed_weights(hashed.groupBy("part").applyInPandas(learn, _WEIGHTS), parts).collect():
        editor.weights.setdefault(r["feature"], {})[r["label"]] = r["weight"]
    return editor


def _in_parts(words: DataFrame) -> tuple[int, DataFrame]:
    hashed = stored(words.select("word", F.xxhash64("word").alias("h")))
    parts = max(1, math.ceil(hashed.count() / TRAIN_WORDS))
    return parts, hashed.withColumn("part", F.pmod(F.xxhash64("h"), F.lit(parts)).cast("bigint"))


def corrections(words: DataFrame, lexicon: DataFrame, editor: Editor, accept: dict[str, float]) -> DataFrame:
    """(word, fixed, joined, changed, second) for words of scans that clean files do not know; ``words`` are
    those of ``asked_words``, or word and text_id.

    ``second``: of a broken word, the change is in the part on the second line.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = [
                sum(accept.get(f, 0.0) for f in _accept_features(w, x, m, r, n, c)) if changed else 0.0
                for w, x, m, r, n, c, changed in zip(*(batch[k] for k in ("word", "fixed", "margin", "rank", "n", "n_clean", "changed")))
            ]
            batch = batch.assign(score=score, second=[_in_second(w, x) for w, x in zip(batch["word"], batch["fixed"])])
            # a figure or sign amid letters is evidence enough; codes differ by single characters, so the right one must be frequent
            odd = [bool(_ODD.search(w)) and not any(c.isdigit() for c in x) for w, x in zip(batch["word"], batch["fixed"])]
            rare = [any(c.isdigit() for c in x) and c_ < max(2, 2 * n) for x, c_, n in zip(batch["fixed"], batch["n_clean"], batch["n"])]
            yield batch.loc[~batch["changed"] | (batch["score"] > 0) & ~pd.Series(rare, index=batch.index) | pd.Series(odd, index=batch.index), ["word", "fixed", "joined", "changed", "second", "score", "margin", "n_clean"]]

    # copies of a scan under other file_ids are one text
    counted = words if "n" in words.columns else words.select("word", "text_id").distinct().groupBy("word").agg(F.count("*").alias("n"), F.lit(0).alias("n_own"))
    judged = proposals(counted.select("word", "n"), lexicon, editor).mapInPandas(
        work, "word string, fixed string, joined boolean, changed boolean, second boolean, score double, margin double, n_clean bigint"
    )
    own = counted.where("n_own > 0").select("word", "n_own")
    judged = judged.join(own, "word", "left").where(F.col("n_own").isNull() | (F.col("n_clean") >= F.col("n_own") * DOUBT))
    first = F.struct("changed", F.col("fixed").rlike(r"\p{Ll}\p{Lu}"), -F.col("score"), -F.col("margin"), -F.col("n_clean"), "fixed")
    best = F.min_by(F.struct("fixed", "joined", "changed", "second"), first)
    return stored(judged.groupBy("word").agg(best.alias("b")).select("word", "b.*"))


def word_models(lexicon: DataFrame, doubted: DataFrame) -> tuple[Editor, dict[str, float]]:
    """The editor and what accepts its proposals, from two halves of all clean words that are not in doubt."""
    sure = lexicon.join(doubted, "word", "left_anti")
    half = F.pmod(F.xxhash64("word", F.lit(3)), F.lit(2))
    learnable = sure.where(F.col("word").rlike(r"^[\p{L}'’-]{2,60}$") & (F.col("n_clean") >= 2) & (half == 0))
    editor = learnt_editor(learnable)
    # codes and rare words are among those to leave alone
    other = sure.where((half == 1) & (F.length("word") <= LONG) & _fits(F.col("word")))
    return editor, learnt_acceptance(other, lexicon, editor)


def models(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judged pages, and the fixes of words of scans that clean files do not know."""
    candidates = files.where("not coalesce(is_pdf, false) and file_type = 'documentation'")
    clean = candidates.where("content is not null").where(~F.col("content").contains("\f"))
    pages = judged_pages(files, learnt_pages(clean))
    lexicon = stored(clean_words(pages))
    asked = asked_words(pages, lexicon)
    doubted = asked.where("n_own > 0").select(F.lower("word").alias("word")).distinct()
    return pages, corrections(asked, lexicon, *word_models(lexicon, doubted))


def found_faults(files: DataFrame) -> DataFrame:
    """(file_id, line_no, fault), each once."""
    pages, fixes = models(files)
    line = lambda x: x + 1
    marked = pages.where("scan").select("file_id", F.explode(F.map_from_arrays(F.array(F.lit("furniture"), F.lit("broken_word")), F.array(F.transform("furniture", line), F.transform("breaks.line", line)))).alias("fault", "lines"))
    known = marked.select("file_id", F.explode("lines").alias("line_no"), "fault")
    changes = fixes.where("changed").select("word", "second")
    hits = scan_words(pages, changes).join(changes, "word")
    lines = F.split("lines", ",").cast("array<int>")
    on = F.when(F.col("word").contains(BREAK), F.array(F.when(F.col("second"), lines[1]).otherwise(lines[0]))).otherwise(lines)
    return known.unionByName(hits.select("file_id", F.explode(on).alias("line_no"), F.lit("misread").alias("fault"))).distinct()


def repair(content: str, furniture: set[int], breaks: dict[int, tuple[str, int]], fixes: dict[str, tuple[str, bool, bool]]) -> str:
    """Continuous paragraphs without furniture, words put right and joined."""
    lines = content.split("\n")
    paragraphs: list[str] = []
    text, gap, taken = "", False, set()
    for i, x in enumerate(lines):
        if i in furniture:
            continue
        x = x.strip("\f \t\r")
        if not x:
            gap = True
            continue
        tokens = x.split()
        if i in taken:
            tokens = tokens[1:]
        for k, t in enumerate(tokens):
            word = core(t)
            if (fix := fixes.get(word)) and fix[2] and not fix[1] and not (i in breaks and k == len(tokens) - 1):
                tokens[k] = t.replace(word, fix[0])
        if i in breaks and tokens:
            word, j = breaks[i]
            first = lines[j].strip("\f \t\r").split()[0]
            head, tail = word.split(BREAK)
            whole = fixes[word][0] if word in fixes and fixes[word][1] else head.rstrip(HYPHENS) + tail
            lead = tokens[-1][: len(tokens[-1]) - len(tokens[-1].lstrip(EDGES))]
            tokens[-1] = lead + whole + first[len(tail) :]
            taken.add(j)
        line = " ".join(tokens)
        ended = not text or text[-1] in ".!?:;”»\"" or _HEADING.match(x)
        if text and gap and (ended or not (line[:1].islower())):
            paragraphs.append(text)
            text = line
        else:
            text = f"{text} {line}".strip()
        gap = False
    if text:
        paragraphs.append(text)
    return "\n\n".join(paragraphs)


def repaired_files(files: DataFrame) -> DataFrame:
    """(file_id, repaired) of scans."""
    pages, fixes = models(files)
    per = scan_words(pages, fixes).select("file_id", "word").join(fixes, "word").groupBy("file_id").agg(F.collect_set(F.struct("word", "fixed", "joined", "changed")).alias("fixes"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for content, furniture, breaks, found in zip(batch["content"], batch["furniture"], batch["breaks"], batch["fixes"]):
                table = {f["word"]: (f["fixed"], f["joined"], f["changed"]) for f in found} if found is not None else {}
                texts.append(repair(content, set(furniture), {b["line"]: (b["word"], b["next"]) for b in breaks}, table))
            yield pd.DataFrame({"file_id": batch["file_id"], "repaired": texts})

    return pages.where("scan").select("file_id", "content", "furniture", "breaks").join(per, "file_id", "left").mapInPandas(work, "file_id bigint, repaired string")
