"""Text cut off by field limits or broken transfers.

A value is looked at where it does not end like a finished text. Its last token is held
against a trie of the corpus' words (a word table with all prefixes): an unknown token that is
a proper prefix of known words was cut. A last token that is a whole word is judged by
how the corpus goes on: sentences with the same first words that end with a full stop speak
for a cut, values that regularly stop right there (greetings, list items) against. What is
left is settled by length: a value that reaches its source's limit of tokens, where that is
known, or stops at a number of characters at which its source's unfinished values pile up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, trimmed, written

# Words are runs of letters, digits, hyphens and apostrophes; ideographs and kana count singly.
PLAIN_TOKEN = re.compile(r"[a-z0-9'\-]+")
TOKEN = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}]|[[\p{L}\p{M}\p{N}'’\-]--[\p{Han}\p{Hiragana}\p{Katakana}]]+")
# A sentence ends after its mark; marks that close come with it. Lines end one too.
BREAK = re.compile(r"[.!?…][\"”»’'*_)\]]{0,3}\s+|[。！？]|[\r\n]+")
MARKS, CLOSING, WIDE_MARKS, WIDE_CLOSING = ".!?…", "\"”»’'*_)]~", "。！？", "」』”\"）"
#: How model limits count: words and single marks.
UNITS = re.compile(r"\w+|[^\w\s]")
# Delimiters that close what they open; a face is none.
CLOSES = {")": "(", "]": "[", "}": "{", "»": "«", "”": "“", "」": "「", "』": "『", "）": "（"}
FACE = re.compile(r"[:;=8][-^']?[()\[\]{}]|[()\[\]{}][-^']?[:;=]")
#: Placeholders that stand for no text; they are empty, not cut.
NOTHING = r"^[\W_]*(?:(?:response|reply|answer|null|none|nil|na|n/a|undefined|empty|no (?:reply|response|answer)|not available)[\W_]*)?$"
KEY_WORDS = 3
#: Unfinished texts of one source and length that make a limit.
PILE = 8


def is_nothing(text: Column) -> Column:
    """Whether a text is null or has no content: blank, marks only, or a placeholder word."""
    return text.isNull() | F.lower(text).rlike("(?U)" + NOTHING)


def open_delimiters(sentence: str) -> list[str]:
    """The stack of delimiters that a sentence opens and does not close.

    A closing mark pops its own opening only; one without an opening (as of a list item or of
    a quotation that began before) is passed over. A straight double quote opens before a
    word's start and closes otherwise.
    """
    stack: list[str] = []
    if FACE.search(sentence):
        sentence = FACE.sub(" ", sentence)
    for i, c in enumerate(sentence):
        if c in "([{«“「『（":
            stack.append(c)
        elif c == '"':
            if c in stack:
                del stack[len(stack) - 1 - stack[::-1].index(c) :]
            elif (i == 0 or sentence[i - 1] in " \t(") and sentence[i + 1 : i + 2].isalpha():
                stack.append(c)
        elif c in CLOSES and CLOSES[c] in stack:
            del stack[len(stack) - 1 - stack[::-1].index(CLOSES[c]) :]
    return stack


def has_ended(text: str) -> bool:
    """Whether a text's last character, but for closing marks, is a mark that ends a sentence."""
    plain, wide = text.rstrip(CLOSING), text.rstrip(WIDE_CLOSING)
    return plain != "" and plain[-1] in MARKS or wide != "" and wide[-1] in WIDE_MARKS


def sentences_of(text: str) -> list[str]:
    """The sentences of a text, each with its mark, without the white space around."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        end = m.start() + (text[m.start()] not in "\r\n")
        if part := text[at:end].strip():
            out.append(part)
        at = m.end()
    if part := text[at:].strip():
        out.append(part)
    return out


def read_text(text: str) -> tuple[list[tuple[list[str], bool]], bool, bool]:
    """(sentences as words and whether each ends with its mark, damaged, ended) of a text."""
    damaged = text.endswith("\ufffd")
    find = PLAIN_TOKEN.findall if text.isascii() else TOKEN.findall
    parts = sentences_of(text.rstrip("\ufffd"))
    sentences = [(find(p.lower()), has_ended(p)) for p in parts]
    ended = not damaged and has_ended(text) and not (parts and open_delimiters(parts[-1]))
    return sentences, damaged, ended


def _lists(ends: list[int], values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, source, raw_source, text) rows to what is known of each text, in one pass: its
    lengths, end and last words, its sentences' first words (one to three, with whether they
    are all, done, last, and the sentence's size), and its distinct words."""
    for batch in batches:
        texts = batch.column(3).to_pylist()
        n, units, damage, ends = [], [], [], []
        last_at, last, open_at, opening, vocab_at, vocab = [0], [], [0], [[], [], [], [], []], [0], []
        for raw in texts:
            text = raw.rstrip()
            while text[-1:] in ("\u200b", "\ufeff") and text:
                text = text[:-1].rstrip()
            sentences, damaged, ended = read_text(text)
            n.append(len(raw))
            units.append(0 if ended else len(UNITS.findall(text)))
            damage.append(damaged)
            ends.append(ended)
            for i, (words, mark) in enumerate(sentences):
                final = i == len(sentences) - 1
                for k in range(1, min(len(words), KEY_WORDS) + 1):
                    for column, value in zip(opening, (" ".join(words[:k]), k == len(words), ended if final else mark, final, len(words))):
                        column.append(value)
                vocab.extend(set(words))
            last.extend(sentences[-1][0] if sentences else ())
            last_at.append(len(last))
            open_at.append(len(opening[0]))
            vocab_at.append(len(vocab))
        kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32())
        struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(opening, kinds)], ["key", "whole", "done", "last", "size"])
        columns = [pa.array(n, pa.int32()), pa.array(units, pa.int32()), pa.array(damage, pa.bool_()), pa.array(ends, pa.bool_())]
        columns += [_lists(last_at, pa.array(last, pa.string())), _lists(open_at, struct), _lists(vocab_at, pa.array(vocab, pa.string()))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *columns], names=["key", "source", "raw_source", "n", "units", "damaged", "ended", "words", "openings", "vocab"])


def _features(df: DataFrame, key: str, source: str, text: str) -> DataFrame:
    own, where = F.col(f"`{text}`").cast("string"), F.col(f"`{source}`")
    out = df.select(F.col(f"`{key}`").alias("key"), F.coalesce(trimmed(where), F.lit("")).alias("source"), where.cast("string").alias("raw_source"), own.alias("t"))
    out = spread(out.filter(~is_nothing(F.col("t"))))
    kind = df.schema[key].dataType.simpleString()
    opening = "array<struct<key: string, whole: boolean, done: boolean, last: boolean, size: int>>"
    return out.mapInArrow(_read, f"key {kind}, source string, raw_source string, n int, units int, damaged boolean, ended boolean, words array<string>, openings {opening}, vocab array<string>")


def _key(words: Column, k: int) -> Column:
    return F.array_join(F.slice(words, 1, k), " ")


def cut_values(df: DataFrame, key: str, source: str, text: str, limits: DataFrame | None = None) -> DataFrame:
    """(key, source, reason) of each row whose text breaks off within a word or sentence.

    ``reason`` is ``word`` (unknown prefix of known words, or a broken character),
    ``sentence`` (the corpus goes on here) or ``length`` (stops at one of its source's
    limits). ``limits`` may give (source, limit), a limit in words and marks; null, 0 and less
    are none, of several the least counts. Null, empty and blank texts and placeholders are
    not cut. A text that ends with a sentence's mark, with no delimiter of its last sentence
    left open, is finished, whatever its length. Repeated rows are each reported; a null
    source is a source of its own; other columns play no part. Statistics are taken over all
    rows. On very small tables they say little and fewer cuts are found.
    """
    rows = written(_features(df, key, source, text))
    # Sentence beginnings of one to three words: how often ended (t), how often left open (u),
    # how often left open right there (stop), and the longest ended sentence that begins so.
    o = rows.select(F.explode("openings").alias("o")).select("o.*")
    stats = written(o.groupBy(F.col("key").alias("opening")).agg(
        F.count_if("done").alias("t"), F.count_if(~F.col("done") & F.col("last")).alias("u"),
        F.count_if(~F.col("done") & F.col("last") & F.col("whole")).alias("stop"), F.max(F.when(F.col("done"), F.col("size"))).alias("longest")
    ))
    # The word table: every word that is not the last of its text, with all its prefixes.
    finals = rows.filter(~F.col("ended") & (F.size("words") > 0)).select(F.element_at("words", -1).alias("w"))
    last_uses = finals.groupBy("w").agg(F.count("*").alias("last"))
    vocab = rows.select(F.explode("vocab").alias("w")).groupBy("w").agg(F.count("*").alias("all")).join(last_uses, "w", "left")
    vocab = written(vocab.withColumn("inner", F.col("all") - F.coalesce("last", F.lit(0))))
    known = vocab.filter("inner >= 2")
    prefixes = known.filter("length(w) > 1").select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 1), lambda k: F.left("w", k))).alias("w"), "inner"
    ).groupBy("w").agg(F.sum("inner").alias("longer"))
    trie = last_uses.select("w").join(known.select("w", "inner"), "w", "left").join(prefixes, "w", "left")
    # Limits in characters: lengths at which unfinished texts of one source pile up.
    lengths = rows.groupBy("source", "n").agg(F.count_if(~F.col("ended")).alias("here"), F.count("*").alias("rows"))
    usual = lengths.groupBy("source").agg(F.sum("here").alias("total"), F.max("n").alias("top"))
    piled = (F.col("here") >= PILE) & (F.col("here") > 12.0 * F.col("total") / F.col("top")) & (F.col("here") >= 0.75 * F.col("rows")) & (F.col("n") > 40)
    piles = lengths.join(usual, "source").filter(piled).select("source", "n", F.lit(True).alias("piled"))
    unfinished = rows.filter(~F.col("ended")).drop("openings", "vocab")
    n_words = F.size("words")
    k = F.least(n_words, F.lit(KEY_WORDS))
    look = unfinished.withColumn("w", F.element_at(F.concat(F.array(F.lit("")), "words"), -1)).withColumn("k0", _key(F.col("words"), KEY_WORDS))
    look = look.withColumn("k1", F.when(k > 1, F.array_join(F.slice("words", F.lit(1), k - 1), " ")))
    s0 = stats.select(F.col("opening").alias("k0"), F.col("t").alias("t0"), F.col("u").alias("u0"), F.col("stop").alias("stop0"), "longest")
    s1 = stats.select(F.col("opening").alias("k1"), F.col("t").alias("t1"), F.col("u").alias("u1"))
    look = look.join(s0, "k0", "left").join(s1, "k1", "left").join(trie, "w", "left")
    look = look.join(piles, ["source", "n"], "left")
    # The same last words left open again and again are a closing formula.
    endings = unfinished.select(F.xxhash64("words").alias("e")).groupBy("e").agg(F.count("*").alias("same"))
    look = look.withColumn("e", F.xxhash64("words")).join(endings, "e", "left")
    if limits is None:
        look = look.withColumn("limit", F.lit(None).cast("long"))
    else:
        name, most = (F.col(f"`{c}`") for c in limits.columns[:2])
        least = limits.filter(most > 0).groupBy(trimmed(name).alias("source")).agg(F.min(most).cast("long").alias("limit"))
        look = look.join(least, "source", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    # Of all sentences, the share that a cut at any given word leaves open.
    total = stats.filter(~F.col("opening").contains(" ")).agg(F.sum("t").alias("t"), F.sum("u").alias("u")).first()
    rate = (total["u"] or 0) / max(1, (total["t"] or 0)) / 8
    # A short end that stops here more often than cuts explain is a habit, not a cut.
    habit = (n_words <= KEY_WORDS) & (z("t0") == 0) & (z("stop0") >= 5) & (z("stop0") > 1 + 6 * F.lit(rate) * z("t1"))
    opener = (n_words == 1) & (z("t0") == 0)  # no sentence starts with this word
    unknown = (F.col("inner").isNull() | opener) & (z("longer") >= 2) & (n_words > 0) & ~habit
    # A sentence longer than any ended one that begins so is of a text without marks.
    same_start = (n_words <= z("longest")) & (z("t0") >= 3) & (z("t0") > 3 * z("u0"))
    split_start = (n_words <= KEY_WORDS) & (n_words > 1) & (z("t0") == 0) & (z("t1") >= 10) & (z("t1") > 3 * z("u1")) & ~habit
    full = F.coalesce(F.col("piled") | (F.col("units") >= F.col("limit")), F.col("piled"), F.col("units") >= F.col("limit"), F.lit(False))
    reason = (
        F.when(F.col("damaged") | unknown, "word")
        .when(same_start | split_start, "sentence")
        .when(full & (n_words > 0) & (F.col("same") < 5), "length")
    )
    return look.select(F.col("key").alias(key), F.col("raw_source").alias(source), reason.alias("reason")).filter("reason is not null")


def cut_shares(df: DataFrame, cut: DataFrame, key: str, source: str) -> DataFrame:
    """(source, n_rows, n_cut, share) per cleaned source: how often it truncates."""
    own = df.groupBy(trimmed(F.col(source)).alias(source)).agg(F.count("*").alias("n_rows"))
    hit = cut.groupBy(trimmed(F.col(source)).alias("_s")).agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return own.join(hit, own[source].eqNullSafe(hit["_s"]), "left").select(source, "n_rows", n.alias("n_cut"), (n / F.col("n_rows")).alias("share"))
