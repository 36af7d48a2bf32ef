"""Text decoded with a wrong encoding: affected records found, originals put back where they are known.

Words are maximal runs of characters beyond ASCII, with and without the ASCII letters around them; scripts written
without spaces also give their single characters. Every distinct clean word of the corpus goes through all encoding
chains (right bytes read wrongly, once or twice, with bytes lost, kept or replaced); the garbled forms make a table that
is joined by hash with the distinct words of the texts. Words that match no form whole are matched character by
character. A match counts when the original is verified: frequent enough against the garbled form, which must be long
enough or hold characters no text has.

Defined results: null, empty and plain ASCII texts are never found; a verified word is replaced by its most frequent
original; words garbled beyond restoring (replacement characters, lost bytes) are found and stay as they are. Repeated
rows are judged one by one. Nothing is sampled: counts cover all texts.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import spread, stored, widened

_SPACE = re.compile(r"[ \t\n\r\f\v]+")
RUN = re.compile(r"[^\x00-\x7f]+")
WORD = re.compile(r"[A-Za-z]*[^\x00-\x7f]+(?:[A-Za-z]+[^\x00-\x7f]*)*")

# Chains of (bytes as, read as); "lossy" chains replace what cannot be read.
READ_UTF8_AS = ("latin-1", "cp1252", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "koi8-r", "iso8859-2", "iso8859-15", "cp874", "gbk", "shift_jis")
READ_LEGACY_AS = {
    "gbk": ("latin-1", "cp1252"), "big5": ("latin-1", "cp1252"), "shift_jis": ("latin-1", "cp1252"), "euc_jp": ("latin-1",), "euc_kr": ("latin-1",),
    "cp1251": ("latin-1", "cp1252", "koi8-r", "cp866"), "koi8-r": ("latin-1", "cp1251"), "cp866": ("cp1251",), "iso8859-5": ("cp1251",),
    "tis-620": ("latin-1",), "cp1252": ("mac_roman", "cp437", "cp850", "cp1250", "cp1251"), "mac_roman": ("cp1252", "latin-1"), "cp437": ("cp1252",),
    "cp850": ("cp1252",),
}
READ_TWICE = (("latin-1", "latin-1"), ("cp1252", "cp1252"), ("latin-1", "cp1252"), ("cp1252", "latin-1"))
MULTIBYTE = {"utf-8", "gbk", "big5", "shift_jis", "euc_jp", "euc_kr"}
CHAINS = tuple(
    dict.fromkeys(
        [f"utf-8>{x}" for x in READ_UTF8_AS]
        + [f"utf-8>{a}>utf-8>{b}" for a, b in READ_TWICE]
        + [f"{right}>{x}" for right, wrong in READ_LEGACY_AS.items() for x in (*wrong, "utf-8")]
    )
)  # a form carries those that make it as a set of bits
FORM_SCHEMA = "form string, original string, chains bigint, n_original bigint, texts_original bigint"
BROADCAST_UNITS = 200_000  # forms of single letters sent to all executors; more of them are joined by sorting
PART_ROWS = 20_000  # rows a Python worker hands over at a time


@lru_cache(maxsize=None)
def _tables(encoding: str) -> tuple[str, str, bytes]:
    """Decoding tables of a single-byte encoding, undefined bytes kept or open, and those bytes."""
    known = [bytes([b]).decode(encoding, "ignore") for b in range(256)]
    lost = bytes(b for b, c in enumerate(known) if not c)
    return "".join(c or chr(b) for b, c in enumerate(known)), "".join(c or "\ufffe" for c in known), lost


def read(data: bytes, encoding: str) -> set[str]:
    """What a reader may make of bytes: undefined ones kept as control characters, dropped or replaced."""
    if encoding in MULTIBYTE:
        try:
            return {data.decode(encoding)}
        except UnicodeDecodeError:
            return {data.decode(encoding, "replace"), data.decode(encoding, "ignore")}
    if encoding == "latin-1":
        return {data.decode("latin-1")}
    kept, open_, lost = _tables(encoding)
    whole = codecs.charmap_decode(data, "strict", kept)[0]
    if not lost or data.translate(None, lost) == data:
        return {whole}
    return {whole, codecs.charmap_decode(data, "ignore", open_)[0], codecs.charmap_decode(data, "replace", open_)[0]}


def written(text: str, encoding: str) -> bytes | None:
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding == "cp1252" and all(ord(c) < 0x100 or _fits(c) for c in text):
            return b"".join(c.encode("cp1252") if _fits(c) else bytes([ord(c)]) for c in text)
        return None


@lru_cache(maxsize=65_536)
def _fits(c: str) -> bool:
    try:
        c.encode("cp1252")
        return True
    except UnicodeEncodeError:
        return False


# Encodings that texts of a script are kept in.
LEGACY_OF = {
    "CYRILLIC": ("cp1251", "koi8-r", "cp866", "iso8859-5"), "CJK": ("gbk", "big5", "shift_jis", "euc_jp"), "HANGUL": ("euc_kr",),
    "THAI": ("tis-620",), "LATIN": ("cp1252", "mac_roman", "cp437", "cp850"), "": ("cp1252", "mac_roman", "gbk", "shift_jis"),
}


def garbled_forms(word: str) -> dict[tuple[str, str], bool]:
    """(form, chain) of a word under every chain its script is written in, and whether several characters stand for one."""
    out: dict[tuple[str, str], bool] = {}
    utf8 = word.encode("utf-8", "ignore")
    kinds = {script(c) for c in word if ord(c) > 127} - {""}
    legacy = LEGACY_OF.get(next(iter(kinds), ""), ())

    def add(forms: set[str], chain: str, wide: bool) -> None:
        for form in forms:
            if form != word and not form.isascii():
                out.setdefault((form, chain), wide)

    for wrong in READ_UTF8_AS:
        add(read(utf8, wrong), f"utf-8>{wrong}", True)
    for first, second in READ_TWICE:
        for once in read(utf8, first):
            add(read(once.encode("utf-8", "ignore"), second), f"utf-8>{first}>utf-8>{second}", True)
    for right in legacy:
        if (data := written(word, right)) is None:
            continue
        for wrong in READ_LEGACY_AS.get(right, ()):
            add(read(data, wrong), f"{right}>{wrong}", right in MULTIBYTE)
        add({f for f in read(data, "utf-8") if "�" in f}, f"{right}>utf-8", True)
    return out


_SCRIPTS = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "IDEOGRAPHIC": "", "FULLWIDTH": ""}


@lru_cache(maxsize=200_000)
def script(c: str) -> str:
    """Script of a letter; '' for signs, '!' for characters that no text holds."""
    o = ord(c)
    if 0x80 <= o < 0xA0 or o == 0xFFFD or 0xE000 <= o < 0xF900:
        return "!"
    if unicodedata.category(c)[0] in "LM":
        first = unicodedata.name(c, "?").split()[0]
        return _SCRIPTS.get(first, first)
    return ""


def plausible(word: str) -> bool:
    """Letters of one script and no impossible character."""
    kinds = {script(c) for c in word if ord(c) > 127}
    return "!" not in kinds and len(kinds - {""}) <= 1 and not any(0x2500 <= ord(c) < 0x25A0 for c in word)


def impossible(word: str) -> bool:
    return any(script(c) == "!" for c in word if ord(c) > 127)


@lru_cache(maxsize=100_000)
def token_words(token: str) -> tuple[str, ...]:
    found = dict.fromkeys(RUN.findall(token))
    if any(script(r[0]) not in ("THAI", "DEVANAGARI", "CYRILLIC", "CJK") for r in found):
        found.update(dict.fromkeys(WORD.findall(token)))
    return tuple(found)


def words(text: str) -> set[str]:
    """Distinct runs beyond ASCII, and those runs with the ASCII letters that touch them."""
    return {w for token in set(_SPACE.split(text)) if not token.isascii() for w in token_words(token)}


def text_words(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text_id, word) of every row; copies of a text under other keys share its text_id."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, ids, found = [], [], []
            for k, i, t in zip(batch[key], batch["text_id"], batch[text]):
                if t is not None and not t.isascii():
                    w = words(t)
                    found.extend(w)
                    keys.extend([k] * len(w))
                    ids.extend([i] * len(w))
                if len(found) > PART_ROWS:
                    yield pd.DataFrame({"key": keys, "text_id": ids, "word": pd.Series(found, dtype=object)})
                    keys, ids, found = [], [], []
            yield pd.DataFrame({"key": keys, "text_id": ids, "word": pd.Series(found, dtype=object)})

    return spread(texts.select(key, text, F.xxhash64(text).alias("text_id"))).mapInPandas(work, "key bigint, text_id bigint, word string")


def form_table(counts: DataFrame) -> DataFrame:
    """Garbled forms of every distinct plausible word, and of the single characters of scripts without spaces."""
    columns = ["form", "original", "chains", "n_original", "texts_original"]
    bit = {c: 1 << k for k, c in enumerate(CHAINS)}

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, n, n_texts in zip(batch["word"], batch["n"], batch["n_texts"]):
                if not plausible(word):
                    continue
                chains: dict[str, int] = {}
                for form, chain in garbled_forms(word):
                    parts = [form] if form.isascii() or RUN.fullmatch(form) or WORD.fullmatch(form) else [p for p in RUN.findall(form) if len(p) > 1 or impossible(p)]
                    for p in parts:
                        chains[p] = chains.get(p, 0) | bit[chain]
                out.extend((p, word, c, n, n_texts) for p, c in chains.items())
                if len(out) > PART_ROWS:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    return widened(counts, "word").mapInPandas(work, FORM_SCHEMA)


def by_chain(forms: DataFrame) -> DataFrame:
    """One row per form, original and chain, and whether the chain makes several characters of one."""
    wide = lambda c: c.split(">")[0] in MULTIBYTE or c.endswith(">utf-8")
    names = F.array(*[F.struct(F.lit(c).alias("chain"), F.lit(wide(c)).alias("wide"), F.lit(1 << k).alias("bit")) for k, c in enumerate(CHAINS)])
    return forms.withColumn("_c", F.explode(F.filter(names, lambda x: x["bit"].bitwiseAND(F.col("chains")) != 0))).select("*", "_c.chain", "_c.wide").drop("_c", "chains")


def unit_table(counts: DataFrame) -> DataFrame:
    """Garbled forms of single characters, by chain, for words that match no form whole."""
    chars = counts.select(F.explode(F.split("word", "")).alias("word"), "n").where(r"word rlike '[^\\x00-\\x7f]'")
    return by_chain(form_table(chars.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n").alias("n_texts"))).where("length(form) >= 2")).where("wide")


def _times(k: int) -> Column:
    """The original is k times as frequent as the form, in distinct texts or, where it isn't in fewer of these, in rows."""
    texts, texts_original = F.col("n_texts"), F.col("texts_original")
    return (texts_original >= k * texts) | ((texts_original >= texts) & (F.col("n_original") >= k * F.col("n")))


def _verified(form: Column, wide: Column) -> Column:
    """Enough evidence that the form isn't a word of its own."""
    odd = form.rlike(r"[\x80-\x9f�]")
    size = F.length(form)
    return odd | (wide & (size >= 3)) | (wide & (size >= 2) & _times(2)) | ((size >= 3) & _times(4))


def whole_matches(counts: DataFrame) -> DataFrame:
    """Words that are a garbled form of another, with the original, the chain and whether that is verified.

    Forms come out of Python in numbers the planner can't foresee, so they are hinted to a sort-merge join; the matches,
    few, are stored for the steps that read them.
    """
    matches = by_chain(counts.join(form_table(counts).hint("merge"), F.col("word") == F.col("form")))
    verified = _verified(F.col("form"), F.col("wide"))
    return stored(matches.select("word", "original", "chain", "wide", "n_original", verified.alias("verified"), _times(4).alias("frequent")))


def garbled_words(counts: DataFrame, matches: DataFrame) -> DataFrame:
    """(word, original, chain) for each garbled word; the original is null where only damage is certain."""
    whole = matches.where("verified").groupBy("word").agg(F.max_by(F.struct("original", "chain"), F.struct("n_original", "original")).alias("b")).select("word", "b.*")
    # a word enters the windows by its hash, so that long words are not copied into each of them
    open_words = counts.join(whole.select("word"), "word", "left_anti").where("length(word) >= 2").select("word", F.unhex(F.md5("word")).alias("id"))
    units = stored(unit_table(counts).select("form", "chain").distinct())
    longest, n_units = units.agg(F.max(F.length("form")), F.count("*")).first()
    longest = longest or 1
    # letters times chains: as many as the alphabets of the corpus give, so the size is checked
    units = F.broadcast(units) if n_units <= BROADCAST_UNITS else units.hint("merge")
    windows = widened(open_words, "id").select(
        "id",
        F.length("word").alias("length"),
        F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.length("word"), F.lit(max(2, longest)))), lambda w: F.transform(
            F.sequence(F.lit(1), F.length("word") - w + 1), lambda i: F.struct(i.alias("at"), w.alias("size"), F.substring(F.col("word"), i, w).alias("piece"))
        )))).alias("x"),
    ).select("id", "length", "x.*").where(r"piece rlike '[^\\x00-\\x7f]'")
    covered = (
        windows.join(units, F.col("piece") == F.col("form"))
        .groupBy("id", "length", "chain")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("size") - 1))))).alias("covered"))
        .where("covered >= 6 and covered >= 0.7 * length or covered = length and chain like 'utf-8>%'")
    )
    by_units = covered.groupBy("id").agg(F.max_by("chain", F.struct("covered", "chain")).alias("chain"))
    undone = open_words.join(by_units, "id").select("word", "chain", F.length("word").alias("size"), _undo(F.col("word"), F.col("chain")).alias("original"))
    # a short word counts only where it reads as whole letters of another text
    undone = undone.where("size >= 6 or original rlike '^[\\\\p{L}\\\\p{M}]+$'").select("word", "original", "chain")
    return stored(whole.unionByName(undone))


@F.pandas_udf(T.StringType())
def _undo(form: pd.Series, chain: pd.Series) -> pd.Series:
    def back(text: str, steps: list[str]) -> str | None:
        try:
            for right, wrong in zip(steps[-2::-2], steps[-1::-2]):
                data = written(text, wrong)
                if data is None:
                    return None
                text = data.decode(right)
            return text if plausible(text) else None
        except (UnicodeError, LookupError):
            return None

    return pd.Series([back(f, c.split(">")) for f, c in zip(form, chain)], dtype=object)


def word_counts(pairs: DataFrame) -> DataFrame:
    """Rows and distinct texts of each word."""
    per_text = pairs.groupBy("word", "text_id").agg(F.count("*").alias("n"))
    return stored(per_text.groupBy("word").agg(F.sum("n").alias("n"), F.count("*").alias("n_texts")))


def found_texts(texts: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    pairs = stored(text_words(texts, key, text))
    counts = word_counts(pairs)
    garbled = garbled_words(counts, whole_matches(counts)).select("word")
    return pairs.join(garbled, "word").select(F.col("key").alias(key)).distinct()


def restored_texts(texts: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """Found texts with verified originals put in, and how many garbled words were restored and not."""
    pairs = stored(text_words(texts, key, text))
    counts = word_counts(pairs)
    matches = whole_matches(counts)
    sure = pairs.join(garbled_words(counts, matches), "word")
    # words too short to be sure of are put right where the same text has a verified word of the same chain
    short = matches.where("not verified and not wide and frequent").select("word", "original", "chain")
    chains = sure.where("chain is not null").select("key", "chain").distinct()
    likely = pairs.join(short, "word").join(chains, ["key", "chain"]).join(sure.select("key", "word"), ["key", "word"], "left_anti")
    likely = likely.groupBy("key", "word").agg(F.max("original").alias("original"))
    hits = sure.select("key", "word", "original").unionByName(likely)
    per = hits.groupBy("key").agg(
        F.collect_set(F.when(F.col("original").isNotNull() & ~F.col("word").contains("\ufffd"), F.struct("word", "original"))).alias("fixes"),
        F.countDistinct("word").alias("n_garbled"),
    )
    joined = texts.select(F.col(key).alias("key"), F.col(text).alias("_text")).join(per, "key")
    return joined.select(
        F.col("key").alias(key), _put_in(F.col("_text"), F.col("fixes.word"), F.col("fixes.original")).alias("restored"), F.size("fixes").alias("n_restored"), "n_garbled"
    )


@F.pandas_udf(T.StringType())
def _put_in(text: pd.Series, garbled: pd.Series, originals: pd.Series) -> pd.Series:
    def one(t: str, a: list[str], b: list[str]) -> str:
        fixes = dict(zip(a, b))
        if not fixes:
            return t
        fixed = WORD.sub(lambda m: fixes.get(m[0], m[0]), t)
        return RUN.sub(lambda m: fixes.get(m[0], m[0]), fixed)

    return pd.Series([one(*x) for x in zip(text, garbled, originals)], dtype=object)
