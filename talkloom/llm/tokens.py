"""Token counts and token ids of whole texts, as a public byte-level BPE with word ends gives them.

Texts are normalised as the vocabulary file says (NFC, white space runs to one space, lower case) and cut into
pre-tokens; a word that a task has met before is looked up instead of being merged again.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.llm.support import small_batches, table

VOCABULARY = "word_bpe_49k.json"
#: Words that a worker remembers; beyond, it starts anew. About 200 bytes each.
REMEMBERED = 250_000
#: Characters of text that are looked up at once.
GROUP_CHARS = 2_000_000
#: What separates words: Unicode white space. str.split() also splits at U+001C to U+001F, which a vocabulary doesn't.
SPACES = re.compile("[\t-\r \x85\xa0  -     　]+")
SEPARATORS = ("\x1c", "\x1d", "\x1e", "\x1f")


def words_of(text: str) -> list[str]:
    """The normalised text between white space. No rule of the vocabulary looks across white space."""
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower() would make it depend on its place in the word
            text = text.replace("Σ", "σ")
    text = text.lower()
    if any(c in text for c in SEPARATORS):
        return [w for w in SPACES.split(text) if w]
    return text.split()


class Remembered(dict):
    """word -> value. What a group of texts brings anew is filled in at once."""

    def __init__(self, fill: Callable[[list[str]], Iterable], limit: int = REMEMBERED):
        self.fill, self.limit, self.unkept = fill, limit, 0

    def of(self, texts: list[list[str]]) -> list[list]:
        found = [list(map(self.get, words)) for words in texts]
        lacking = [k for k, values in enumerate(found) if None in values]
        if lacking:
            new = {w for k in lacking for w, x in zip(texts[k], found[k]) if x is None}
            made = dict(zip(order := list(new), self.fill(order)))
            for k in lacking:
                found[k] = [made[w] if x is None else x for w, x in zip(texts[k], found[k])]
            if len(self) + len(made) <= self.limit:
                self.update(made)
            elif (unkept := self.unkept + len(made)) > 8 * self.limit:  # other words than at first may be frequent by now
                self.clear()
                self.unkept = 0
            else:
                self.unkept = unkept
        return found


def in_groups(texts: Iterable[str], most: int = GROUP_CHARS) -> Iterator[list[str]]:
    """Texts, in order, in groups of about so many characters (a longer text is a group of its own)."""
    group: list[str] = []
    held = 0
    for text in texts:
        group.append(text)
        held += len(text)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def shown_bytes() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    """Counts tokens by merging ragged arrays of symbols, many pre-tokens at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab = model["vocab"]
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        shown = shown_bytes()
        end = model["end_of_word_suffix"]
        self.inner = np.array([vocab[c] for c in shown], dtype=np.int64)
        self.final = np.array([vocab[c + end] for c in shown], dtype=np.int64)
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in model["merges"]], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int64)
        self.none = len(keys)
        self.counts = Remembered(self._count_words)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), self.none - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], self.none)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token (its UTF-8 bytes, at least one) once no pair can be merged."""
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.inner[raw]
        symbols[ends - 1] = self.final[raw[ends - 1]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        result = np.ones(len(pieces), dtype=np.int64)
        active = lengths[owner] > 1
        symbols, owner = symbols[active], owner[active]
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            ranks = np.full(len(symbols), self.none, dtype=np.int64)
            at = np.flatnonzero(inside)
            ranks[at] = self._ranks_of(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.r_[True, ~inside])
            best = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(best, sizes)
            hit = self._every_other(ranks, lowest)
            at = np.flatnonzero(hit)
            symbols[at] = self.made[ranks[at]]
            stays = np.ones(len(symbols), dtype=bool)
            stays[at + 1] = False
            done = best == self.none
            result[owner[starts[done]]] = sizes[done]
            stays &= ~np.repeat(done, sizes)
            symbols, owner = symbols[stays], owner[stays]
            if len(owner):
                alone = np.r_[True, owner[1:] != owner[:-1]] & np.r_[owner[1:] != owner[:-1], True]
                symbols, owner = symbols[~alone], owner[~alone]  # one symbol left: its count of 1 is set
        return result

    def _every_other(self, ranks: np.ndarray, lowest: np.ndarray) -> np.ndarray:
        """Where the lowest pair stands; in a run of overlapping ones the first, third and so on."""
        hit = (ranks == lowest) & (ranks < self.none)
        place = np.arange(len(hit))
        before = np.maximum.accumulate(np.where(hit, -1, place))  # the last place that is no hit, or -1
        return hit & ((place - before) % 2 == 1)

    def _count_words(self, words: list[str]) -> list[int]:
        split = [[w] if w.isalpha() else self.pattern.findall(w) for w in words]
        pieces = list({p for s in split for p in s})
        if not pieces:
            return [0] * len(words)
        size = dict(zip(pieces, self.count([p.encode("utf-8", "surrogatepass") for p in pieces]).tolist()))
        return [sum(map(size.__getitem__, s)) for s in split]

    def count_texts(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for text in texts:
            if any(s in text for s in self.special):  # each special string is one token, and what stands between is text
                pieces = re.split("|".join(map(re.escape, self.special)), text)
                parts.append([w for p in pieces for w in words_of(p)])
                extra.append(len(pieces) - 1)
            else:
                parts.append(words_of(text))
                extra.append(0)
        return [n + sum(counts) for n, counts in zip(extra, self.counts.of(parts))]


@functools.lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row's whole text.

    Pre-tokens that a batch brings anew are merged together as ragged arrays: in each round every pre-token's pair
    of lowest rank is merged, all at once, until none is left. A null text counts as empty: no bytes, no tokens.
    Rows are kept one to one, repeated and null ids included; other columns are ignored.
    """

    small_batches(df.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = merger(path)
        for batch in batches:
            counts = [
                n for group in in_groups(t.as_py() for t in batch.column("text")) for n in counter.count_texts(group)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")


class WordIds(dict):
    """word -> ids, encoded by the library's model when a word is first met."""

    def __init__(self, model, pattern, n_ids: int, limit: int = REMEMBERED):
        self.tokenize, self.split, self.limit = model.tokenize, pattern.findall, limit
        self.shown = dict(enumerate(shown_bytes()))
        self.packed = [i.to_bytes(4, "little") for i in range(n_ids)]
        self.new = 0

    def __missing__(self, word: str) -> bytes:
        ids = b"".join(
            [self.packed[t.id] for p in ([word] if word.isalpha() else self.split(word)) for t in self.tokenize(p if p.isascii() and p.isprintable() else self.bytewise(p))]
        )
        self.new += 1
        if len(self) < self.limit:
            self[word] = ids
        elif self.new > 8 * self.limit:  # other words than at first may be frequent by now
            self.clear()
            self.new = 0
        return ids

    def bytewise(self, piece: str) -> str:
        return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, by the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.ids = WordIds(self.library.model, self.pattern, self.library.get_vocab_size())

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(map(self.ids.__getitem__, words_of(text)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)
