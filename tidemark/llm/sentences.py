"""Sentence units across languages and scripts, by document-centred disambiguation.

One pass cuts a text into blocks (headings, list items and paragraphs), sets the starts that no word can change, and
keeps every other place as a candidate with the words around it. The script of the letters in a paragraph chooses the
rule for its terminators. Whether the word before a full stop is an abbreviation, and whether the capitalised word after
it is a proper name or opens a sentence, is read from unambiguous occurrences elsewhere in the same document: what
stands before a stop and goes on in lower case or figures, what stands without a stop, what is capitalised amid a
sentence, what is written small, what stands first in blocks or after question marks. Where the document has no such
occurrence the counts of the whole corpus decide. They cover all documents and reach each one by a join on its words.

Defined results: null, empty and blank texts have no unit; positions count code points from 1; a blank line (spaces
only, too) ends a unit, a line break inside a paragraph does not; a heading and a list item are one unit each, starting
at their marks; an ellipsis alone ends nothing; what is quoted within a sentence belongs to it, however long; a quotation
that never closes counts for nothing; Thai is cut at spaces. Repeated rows give their own units.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread, stored

ABBREVIATION_RATE = 0.3  # of the occurrences of a word, those that show it to be abbreviated
SALTS = 8  # parts of a word that nearly every document needs to know about
CLOSERS = "\"'”’»“)]}」』）】〉》›"
OPENERS = "\"'“„‚‘«»([{「『（【〈《¿¡‹—–-"
# Terminators that need no space after them, and those of other scripts.
WIDE_ENDS = "。！？｡"
OTHER_ENDS = "।॥؟۔።။៖។"
# What goes on after a quotation that ended in a terminator, in scripts without spaces.
GOES_ON = "，、；：,;:）)」』”’とがをはにでものへや的地得"
# Months that follow a German ordinal.
MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())

_LIST = re.compile(r"[ \t]*(?:[-*+•‣▪◦●○·–][ \t]+|(?:\d{1,3}|[a-zA-Z])[.)][ \t]+|\(\d{1,3}\)[ \t]+|\d{1,3}[．、）]|[①-⑳])(?=\S)")
_NUMBER = re.compile(r"[ \t]*\(?(\d{1,3})[.)．、）]")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_BLANK = re.compile(r"\s*$")
_END = re.compile(rf"[.!?…{WIDE_ENDS}{OTHER_ENDS}]+")
_SPACE = re.compile(r"\s+")
_UNSPACED = re.compile(r"(?:[a-zß-ÿа-яё]{2}|[a-z)%]\d|\d\d)[.!?]([A-ZÀ-ÞА-ЯЁ][a-zß-ÿа-яё]+)(?=\s|\.\.|…)")
_DOTTED = re.compile(r"(?:[^\W\d_]{1,2}\.)+[^\W\d_]{1,2}")
_TRIM = "\"'“”„‚‘’«»()[]{}<>¿¡「」『』（）,;:*_`|"


@lru_cache(maxsize=65_536)
def script_of(c: str) -> str:
    """'wide' for Han and kana, 'thai', 'cased' and 'other' letters; '' for the rest."""
    o = ord(c)
    if o < 0x250:
        return "cased" if c.isalpha() else ""
    if 0x3040 <= o < 0x3100 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0x20000 <= o < 0x32000:
        return "wide"
    if 0x0E00 <= o < 0x0E80:
        return "thai"
    if unicodedata.category(c)[0] == "L":
        return "cased" if c.upper() != c.lower() else "other"
    return ""


_FOREIGN = re.compile(r"[^\x00-\u024f\u0370-\u052f\u1e00-\u20cf\u2100-\u22ff]")


def main_script(text: str) -> str:
    if not _FOREIGN.search(text):
        return "cased"
    counts = Counter(map(script_of, text))
    counts.pop("", None)
    if not counts:
        return "cased"
    for kind in ("thai", "wide", "other"):
        if counts[kind] * 3 >= counts["cased"] and counts[kind]:
            return kind if counts[kind] >= max(counts[k] for k in ("thai", "wide", "other")) else max(("thai", "wide", "other"), key=lambda k: counts[k])
    return "cased"


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of each block; a whole block is one unit."""
    out: list[tuple[int, int, bool]] = []
    open_at: int | None = None
    kind, number, at = "blank", 0, 0

    def close(end: int) -> None:
        nonlocal open_at
        if open_at is not None:
            out.append((open_at, end, kind == "item"))
            open_at = None

    for line in text.split("\n"):
        end = at + len(line)
        if _BLANK.match(line):
            close(at)
            kind = "blank"
        elif _HEADING.match(line):
            close(at)
            out.append((at, end, True))
            kind = "heading"
        else:
            mark = _LIST.match(line)
            if mark and kind == "text":
                mark = None  # a wrapped line that happens to begin like an item
            if mark and kind == "item" and (m := _NUMBER.match(line)) and number and int(m[1]) != number + 1:
                mark = None
            if mark:
                close(at)
                m = _NUMBER.match(line)
                number = int(m[1]) if m else 0
                open_at, kind = at, "item"
            elif open_at is None:
                open_at, kind = at, "text"
        at = end + 1
    close(len(text))
    return out


_NEXT = re.compile(rf"\s*([{re.escape(OPENERS)}]*)(\S*)")


def _next_word(text: str, at: int, end: int) -> tuple[int, str]:
    """Position and text of the next word without opening signs; its end punctuation stays."""
    m = _NEXT.match(text, at, end)
    return m.start(1), m[2]


_BARE = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")


def bare(word: str) -> str:
    m = _BARE.match(word)
    return m[0] if m else ""


@lru_cache(maxsize=200_000)
def stem_before(token: str) -> str:
    """The word before a full stop, as it is counted: without outer signs and elided articles."""
    word = token.strip(_TRIM).rstrip(".")
    for apostrophe in "'’":
        if apostrophe in word and len(word.split(apostrophe)[0]) <= 2:
            word = word.split(apostrophe, 1)[1]
    return word.lstrip(_TRIM)


def _goes_on(word: str) -> bool:
    first = word[:1]
    return first.islower() or first.isdigit() or first in ",;:%°±=<>/"


def _single(word: str) -> bool:
    """An initial or part of an abbreviation: one letter, or capitals, before a stop, bracket or comma."""
    b = bare(word)
    return len(b) == 1 and b.isalpha() and word[1:2] in (".", ")", ",", ";", "]") or bool(re.match(r"[A-ZÀ-Þ]{2,3}\.", word))


def word_before(text: str, start: int, at: int) -> str:
    """The word that ends right before ``at``, as it is counted."""
    k = text.rfind(" ", start, at) + 1 or start
    token = text[max(k, text.rfind("\n", k, at) + 1) : at]
    if token and not token[-1].isspace():
        return stem_before(token.split()[-1])
    return ""


class Candidate(NamedTuple):
    """A place where a unit may start: after a ``stop``, a ``closed`` bracket, or ``glued`` to the stop before it."""

    at: int
    rule: str
    word: str
    next_word: str
    opened: bool


class Analysis(NamedTuple):
    """What one text says by itself; ``counts`` are its unambiguous occurrences.

    ``a:`` words before stops: all, those that go on, those that stand without a stop. ``s:`` words after stops: at clear
    starts, after stops, capitalised amid a sentence, written small.
    """

    starts: list[int]
    candidates: list[Candidate]
    counts: dict[str, list[int]]


_QUOTES = {"「": "」", "『": "』", "（": "）", "“": "”", "《": "》"}
_ANY_QUOTE = re.compile("[" + "".join(_QUOTES) + "".join(_QUOTES.values()) + "]")


def quotations(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Outermost quotations and brackets of a block that do close."""
    open_: dict[str, list[int]] = {c: [] for c in _QUOTES.values()}
    found = []
    for m in _ANY_QUOTE.finditer(text, start, end):
        if m[0] in _QUOTES:
            open_[_QUOTES[m[0]]].append(m.start())
        elif open_[m[0]]:
            found.append((open_[m[0]].pop(), m.start()))
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


def _within(spans: list[tuple[int, int]], at: int, after: int) -> bool:
    k = bisect_right(spans, (at, 1 << 62)) - 1
    return k >= 0 and spans[k][0] < at and spans[k][1] >= after


def analyse(text: str) -> Analysis:
    """One pass over a text."""
    starts: list[int] = []
    candidates: list[Candidate] = []
    counts: dict[str, list[int]] = {}

    def count(key: str, *more: int) -> None:
        row = counts.setdefault(key, [0, 0, 0, 0])
        for k, n in enumerate(more):
            row[k] += n

    for start, end, whole in blocks(text):
        at = start
        while at < end and text[at].isspace():
            at += 1
        if at >= end:
            continue
        starts.append(at)
        first = bare(_next_word(text, at, end)[1])
        if first and not first[0].isdigit():
            count("s:" + first, 1)
        _judge_block(text, at, end, whole, starts, candidates, count)
    _count_elsewhere(text, candidates, counts)
    return Analysis(starts, candidates, counts)


def _count_elsewhere(text: str, candidates: list[Candidate], counts: dict[str, list[int]]) -> None:
    """Adds where the words at stake stand free of doubt: without a stop, amid a sentence, small."""
    after = {b for c in candidates if (b := bare(c.next_word)) and b[0].isupper()} | {c.next_word for c in candidates if c.rule == "glued"}
    before = {c.word for c in candidates if c.word}
    if not after and not before:
        return
    tokens = text.split()
    all_counts = Counter(tokens)
    for word in before:
        if n := sum(all_counts[word + sign] for sign in ("", ",", ";", ":")):
            counts.setdefault("a:" + word, [0, 0, 0, 0])[2] += n
    ends = ("", ",", ";", ":", ".", "!", "?")
    for word in after:
        if n := sum(all_counts[word.lower() + sign] for sign in ends) if word.lower() not in after else 0:
            counts.setdefault("s:" + word, [0, 0, 0, 0])[3] += n
    large = {word + sign: "s:" + word for word in after for sign in ends}
    for k, token in enumerate(tokens):
        if token in large and k and tokens[k - 1][-1].islower():
            counts.setdefault(large[token], [0, 0, 0, 0])[2] += 1


def _judge_block(text: str, start: int, end: int, whole: bool, starts: list[int], candidates: list[Candidate], count) -> None:
    kind = main_script(text[start:end])
    if kind == "thai":
        if not whole:
            starts.extend(m.end() for m in _SPACE.finditer(text, start, end) if m.end() < end)
        return
    spans = quotations(text, start, end) if kind == "wide" and not whole else []
    for m in _END.finditer(text, start, end):
        run, after = m[0], m.end()
        last = run[-1]
        if kind == "cased" and last in "!?" and after < end and text[after].isspace():
            opener = bare(_next_word(text, after, end)[1])
            if opener and opener[0].isupper():
                count("s:" + opener, 1)
        if not run.strip("….") and run != ".":
            continue  # an ellipsis alone
        while after < end and text[after] in CLOSERS:
            after += 1
        closed = after > m.end()
        if after >= end:
            continue
        begin, nxt = _next_word(text, after, end)
        spaced = text[after].isspace()
        word = ""
        if run == "." and spaced and kind == "cased":
            word = word_before(text, start, m.start())
            if word and not closed and not word[-1].isdigit():
                count("a:" + word, 1, int(_goes_on(nxt) or _single(nxt)))
            if nxt and nxt[0].isupper() and (b := bare(nxt)):
                count("s:" + b, 0, 1)
        if whole or not nxt:
            continue
        if last in WIDE_ENDS or (kind == "wide" and last in "!?"):
            if not _within(spans, m.start(), after) and not (closed and text[begin] in GOES_ON):
                starts.append(begin)
            continue
        if not spaced:
            glued = _UNSPACED.match(text, max(start, m.start() - 2), end) if not closed else None
            if glued and last == ".":
                candidates.append(Candidate(after, "glued", "", glued[1], False))
            elif glued or last in OTHER_ENDS and script_of(text[after]) == "other":
                starts.append(after)
            continue
        first, mark = nxt[0], text[begin]
        if closed:
            # a quotation or bracket ends here: the sentence ends too only where a new one clearly opens
            inner_quote = any(c in "\"”“»’'" for c in text[m.end() : after])
            if kind == "cased" and (first.isupper() or mark in "“„«¿¡\"") and not (inner_quote and not first.isupper()):
                if run == "." and not inner_quote:
                    candidates.append(Candidate(begin, "closed", word, nxt, False))
                else:
                    starts.append(begin)
            continue
        if last in OTHER_ENDS or last in "!?":
            if mark not in "»”":
                starts.append(begin)
            continue
        # a full stop
        if mark in "»)]":
            continue
        word = word or word_before(text, start, m.start())
        if word.isdigit() and bare(nxt) in MONTHS:
            continue
        if not word or word[-1].isdigit():
            starts.append(begin)
        else:
            candidates.append(Candidate(begin, "stop", word, nxt, mark in "“„«¿¡\""))


class Judge:
    """Decisions for one document: its own unambiguous occurrences first, those of the corpus where it has none."""

    def __init__(self, own: dict[str, tuple], corpus: dict[str, tuple]) -> None:
        self.own, self.corpus = own, corpus

    def disregard(self, candidates: list[Candidate]) -> None:
        """A stop before a small word that opens sentences as it is doesn't show that the sentence goes on."""
        for c in candidates:
            if c.rule == "stop" and (row := self.own.get("a:" + c.word)) and row[1] and self.opens_small(bare(c.next_word)):
                self.own["a:" + c.word] = (row[0], row[1] - 1, *row[2:])

    def stops(self, word: str) -> tuple[int, int, int]:
        """How often a word stands before a stop, goes on behind it, and stands without one."""
        total, clear, plain, _ = self.own.get("a:" + word, NONE)
        if clear + plain >= 2:
            return total, clear, plain
        return self.corpus.get("a:" + word, (total, clear, plain))[:3]

    def abbreviation(self, word: str) -> bool:
        """Whether a word before a full stop is an abbreviation.

        Occurrences that go on behind the stop speak for it, those without a stop against it; words longer than usual
        for abbreviations need more of the former.
        """
        if not word or word[-1].isdigit():
            return False
        if _DOTTED.fullmatch(word):
            return True
        total, clear, plain = self.stops(word)
        return clear > 0 and clear >= ABBREVIATION_RATE * (total + plain + max(0, 2 * (len(word) - 4)))

    def certain(self, word: str) -> bool:
        """An abbreviation that hardly ever ends a sentence."""
        if len(word) == 1 and word.isupper():
            return False
        total, clear, plain = self.stops(word)
        return bool(_DOTTED.fullmatch(word)) or (total > 0 and clear >= 0.8 * (total + plain))

    def opens_small(self, word: str) -> bool:
        """Whether a word in lower case, such as a program's name, is known to open sentences as it is."""
        if not word[:1].islower():
            return False
        mine = self.own.get("s:" + word, NONE)[0]
        total = self.corpus.get("s:" + word, (mine, 0, 0, 0))[0]
        title = word[0].upper() + word[1:]
        return total >= 2 and total > max(self.corpus.get("s:" + title, NONE)[0], self.own.get("s:" + title, NONE)[0])

    def opens(self, word: str) -> bool:
        """Whether a capitalised word opens a sentence here; a proper name's capital says nothing."""
        clear, _, amid, small = self.own.get("s:" + word, NONE)
        if clear or small:
            return True
        if amid and len(word) > 1:
            return False
        clear, after, _, _ = self.corpus.get("s:" + word, NONE)
        return clear >= 2 or (clear > 0 and after > 0)

    def accepts(self, c: Candidate) -> bool:
        if c.rule == "glued":
            return self.opens(c.next_word)
        if c.rule == "closed":
            return not self.abbreviation(c.word) and len(c.word) != 1
        nxt = bare(c.next_word)
        if self.opens_small(nxt) and not self.certain(c.word):
            return True
        first = c.next_word[0]
        if self.abbreviation(c.word):
            if _goes_on(c.next_word) or _single(c.next_word) or not (first.isupper() or c.opened):
                return False
            return c.opened or self.opens(nxt)
        return not (len(c.word) == 1 and c.word.isalpha() and (first.isdigit() or first.islower()))


NONE = (0, 0, 0, 0)


def needed_keys(candidates: list[Candidate]) -> set[str]:
    """The words a document needs to know about."""
    need = set()
    for c in candidates:
        if c.word:
            need.add("a:" + c.word)
        if b := c.next_word if c.rule == "glued" else bare(c.next_word):
            need.update(("s:" + b, "s:" + b[0].upper() + b[1:]))
    return need


def unit_starts(analysis: Analysis, judge: Judge) -> list[int]:
    """Positions, from 0, of the first character of each unit."""
    judge.disregard(analysis.candidates)
    return sorted({*analysis.starts, *(c.at for c in analysis.candidates if judge.accepts(c))})


_ANALYSED = "doc_id bigint, text string, state binary, need array<string>, counts array<string>"
_COLUMNS = ["doc_id", "text", "state", "need", "counts"]


def _line(key: str, n: list[int]) -> str:
    return f"{key}\t{n[0]}\t{n[1]}\t{n[2]}\t{n[3]}"


def _table(lines) -> dict[str, tuple]:
    out = {}
    for line in lines if lines is not None else ():
        key, *n = line.split("\t")
        out[key] = tuple(map(int, n))
    return out


def analysed(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Each text read once: what it says by itself (``state``, for ``_decide``) and the words it needs to know about.

    Counts for the corpus are summed up within a batch, in a row without ``state``. Lists cross to the JVM as strings and
    bytes, at a fraction of the cost of nested columns.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, sums = [], {}
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                if text:
                    a = analyse(text)
                    out.append((doc_id, text if with_text else None, pickle.dumps((a.starts, [tuple(c) for c in a.candidates], a.counts)), list(needed_keys(a.candidates)), None))
                    for key, n in a.counts.items():
                        if row := sums.get(key):
                            for k in range(4):
                                row[k] += n[k]
                        else:
                            sums[key] = list(n)
                if len(out) >= 500:
                    yield pd.DataFrame(out, columns=_COLUMNS)
                    out = []
            out.append((None, None, None, None, [_line(k, n) for k, n in sums.items()]))
            yield pd.DataFrame(out, columns=_COLUMNS).astype({"doc_id": "Int64"})

    return spread(documents.select("doc_id", "text")).mapInPandas(work, _ANALYSED)


def with_corpus(documents: DataFrame, with_text: bool = False) -> DataFrame:
    """Analysed documents with the counts of the whole corpus for the words they need.

    A word that nearly every document needs would put them all into one task, so each word's counts are laid out
    ``SALTS`` times and a document asks for one of the copies.
    """
    rows = stored(analysed(documents, with_text))
    part = F.split("line", "\t")
    counts = rows.where("state is null").select(F.explode("counts").alias("line")).groupBy(part[0].alias("key")).agg(*[F.sum(part[i].cast("bigint")).alias(f"n{i}") for i in range(1, 5)])
    known = counts.where("n1 > 0 or n2 > 0 or n3 > 0").select("key", F.concat_ws("\t", "key", "n1", "n2", "n3", "n4").alias("line"))
    copies = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    documents_ = rows.where("state is not null")
    asked = documents_.select("doc_id", F.explode("need").alias("key")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    answered = asked.join(copies.hint("merge"), ["key", "salt"]).groupBy("doc_id").agg(F.collect_list("line").alias("corpus"))
    return documents_.select("doc_id", "text", "state").join(answered, "doc_id", "left")


def _decide(state: bytes, corpus) -> list[int]:
    starts, candidates, counts = pickle.loads(state)
    own = {k: tuple(n) for k, n in counts.items()}
    return unit_starts(Analysis(starts, [Candidate(*c) for c in candidates], {}), Judge(own, _table(corpus)))


def found_units(documents: DataFrame) -> DataFrame:
    """(doc_id, start_at) of every unit."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_decide(*x) for x in zip(batch["state"], batch["corpus"])]
            ids = batch["doc_id"].astype("Int64").repeat([len(x) for x in found])
            yield pd.DataFrame({"doc_id": ids.reset_index(drop=True), "start_at": pd.Series([x + 1 for each in found for x in each], dtype="int32")})

    return with_corpus(documents).drop("text").mapInPandas(work, "doc_id bigint, start_at int")


def sentence_units(documents: DataFrame) -> DataFrame:
    """(doc_id, unit_no, start_at, unit): the units with their text, inner line breaks as they are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text, *row in zip(*(batch[c] for c in ("doc_id", "text", "state", "corpus"))):
                found = _decide(*row)
                for n, (a, b) in enumerate(zip(found, [*found[1:], len(text)])):
                    out.append((doc_id, n, a + 1, text[a:b].rstrip()))
            yield pd.DataFrame(out, columns=["doc_id", "unit_no", "start_at", "unit"])

    return with_corpus(documents, with_text=True).mapInPandas(work, "doc_id bigint, unit_no int, start_at int, unit string")
