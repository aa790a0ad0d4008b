"""Phrase collocations by language: word sequences counted in HAT-tries, scored by their weakest cut."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.llm.support import cut, join_by_key, small_batches, stored, table
from talkloom.operators.ranking import top_k

#: Occurrences of a candidate, factor of the score, percentage from which a longer phrase covers a candidate, phrases by
#: language, words of the longest phrase.
LEAST, SCALE, COVER, BEST, LONGEST = 30, 2_000_000, 80, 2000, 4
NO_LANG = "und"
#: Ends a piece; no byte of UTF-8.
END = b"\xff"
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_PLAIN = bytes.maketrans(_CAPITALS + b"\t" + b".,;:!?\n\v\f\r", _CAPITALS.lower() + b" " + END * 10)
#: Tokens that are looked at together; entries of a container from which on it bursts; entries, and words, that a task
#: holds before it spills; rows of a batch that goes back to Spark.
TOKENS, BURST, HELD, WORDS, ROWS = 1 << 19, 4096, 600_000, 1 << 19, 1 << 16
#: Words that didn't pass, so many at least, are remembered.
OTHERS = 1 << 18
#: Bits of a word id within a packed key: TOKENS + WORDS ids at most, and LONGEST - 1 of them in a long.
ID_BITS = 21
#: Bits of a sieve for each key, and at most (16 MB).
SIEVE_SHARE, SIEVE_BITS = 16, 27
#: How far the second word's hash is shifted in that of a pair.
SHIFT = 20
SPREAD = 64


def tokens_of(texts: list[bytes]) -> pa.Array:
    """The words of the texts in order, A-Z in lower case, with END where a piece ends."""
    raw = END.join(texts).translate(_PLAIN).replace(END, b" " + END + b" ") + b" " + END
    tokens = pc.split_pattern(pa.array([raw], pa.large_binary()), b" ").flatten()
    return tokens.filter(pc.not_equal(tokens, b""))


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    langs = batch.column("lang").dictionary_encode()
    texts = batch.column("text").cast(pa.large_binary())
    for code, lang in enumerate(langs.dictionary.to_pylist()):
        yield lang, tokens_of(texts.filter(pc.equal(langs.indices, code)).to_pylist())


class Sieve:
    """A bit table of bounded size. What was put in passes; of the rest, some do."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits, self.mask = bits, np.uint64(len(bits) * 8 - 1)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def sieve_of(keys: DataFrame, hashed: Column) -> Sieve:
    """The sieve of a table's keys. Its bits are set by Spark, in blocks; at most 2 ** SIEVE_BITS come to the driver."""
    n = keys.count()
    size = 1 << min(SIEVE_BITS, max(15, (SIEVE_SHARE * n - 1).bit_length()))
    place = F.pmod(hashed, F.lit(size)) + 1
    blocks = keys.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    bits = np.zeros(size // 8, dtype=np.uint8)
    for block, some in blocks.collect():
        bits[(block - 1) * 4096 : (block - 1) * 4096 + len(some)] = np.frombuffer(some, dtype=np.uint8)
    return Sieve(bits)


def word_hash(word: Column) -> Column:
    return F.xxhash64("lang", word)


def pair_hash(first: Column, second: Column) -> Column:
    return word_hash(first).bitwiseXOR(F.shiftrightunsigned(word_hash(second), SHIFT))


class WordIds(dict):
    """Ids, from 1, of one language's words that pass the sieve, with their hashes; 0 for other words and END."""

    def __init__(self, lang: str, sieve: Sieve) -> None:
        super().__init__({END: 0})
        self.sieve, self.seed = sieve, xxhash.xxh64_intdigest(lang.encode(), 42)
        self.words: list[bytes] = [b""]
        self.hashes = np.zeros(1, dtype=np.uint64)

    def of(self, tokens: pa.Array) -> np.ndarray:
        coded = tokens.dictionary_encode()
        kinds = coded.dictionary.to_pylist()
        ids = np.fromiter(map(self.get, kinds, repeat(-1)), np.int64, len(kinds))
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            new = [kinds[k] for k in unknown.tolist()]
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in new), np.uint64, len(new))
            good = self.sieve.passes(hashes)
            ids[unknown] = np.where(good, len(self.words) - 1 + np.cumsum(good), 0)
            if len(self) - len(self.words) + len(new) > OTHERS:
                self.clear()
                self.update(zip(self.words, range(len(self.words))))
                self.update({END: 0})
            self.update(zip(new, ids[unknown].tolist()))
            self.words += [w for w, is_good in zip(new, good.tolist()) if is_good]
            self.hashes = np.r_[self.hashes, hashes[good]]
        return ids[coded.indices.to_numpy()]


def _packed(ids: np.ndarray) -> np.ndarray:
    key = np.zeros(ids.shape[1], dtype=np.int64)
    for row in ids:
        key = key << ID_BITS | row
    return key


def _unpacked(keys: np.ndarray, length: int) -> np.ndarray:
    return np.array([keys >> ID_BITS * k & (1 << ID_BITS) - 1 for k in range(length - 1, -1, -1)]).reshape(length, -1)


class HatTrie:
    """Counts of sequences of word ids, all of one length (0 behind their end).

    Nodes tell children apart by word id. A child is a hash container of packed rests with their counts; one that grows
    beyond BURST entries becomes a node over smaller containers, as long as rests have two words or more.
    """

    def __init__(self, length: int) -> None:
        self.length, self.root, self.size = length, {}, 0

    def add(self, ids: np.ndarray, node: dict | None = None, level: int = 0) -> None:
        """Counts the columns of ids (length rows), below a node of the level."""
        node = self.root if node is None else node
        ids = ids[:, np.argsort(ids[level], kind="stable")]
        starts = np.flatnonzero(np.diff(ids[level], prepend=-1))
        ends = np.r_[starts[1:], ids.shape[1]]
        rests = _packed(ids[level + 1 :]).tolist()
        for word, a, b in zip(ids[level][starts].tolist(), starts.tolist(), ends.tolist()):
            child = node.get(word)
            if child is None:
                child = node[word] = Counter()
            if type(child) is dict:
                self.add(ids[:, a:b], child, level + 1)
                continue
            before = len(child)
            child.update(rests[a:b])
            self.size += len(child) - before
            if len(child) > BURST and level + 2 < self.length:
                node[word] = self._burst(child, self.length - level - 1)

    def _burst(self, container: Counter, length: int) -> dict:
        node: dict[int, Counter] = {}
        shift = ID_BITS * (length - 1)
        for key, n in container.items():
            node.setdefault(key >> shift, Counter())[key & (1 << shift) - 1] = n
        return node

    def _containers(self, node: dict | Counter, before: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], Counter]]:
        if type(node) is dict:
            for word, child in node.items():
                yield from self._containers(child, (*before, word))
        else:
            yield before, node

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Takes whole subtrees of first words out, the largest first, until at most keep entries are left: their
        sequences, as columns, and counts."""
        weight = lambda x: sum(map(weight, x.values())) if type(x) is dict else len(x)
        taken: dict[int, list[tuple[tuple[int, ...], Counter]]] = {}
        for size, word in sorted(((weight(child), word) for word, child in self.root.items()), reverse=True):
            if self.size <= keep:
                break
            for before, container in self._containers(self.root.pop(word), (word,)):
                taken.setdefault(len(before), []).append((before, container))
            self.size -= size
        ids, counts = [np.zeros((self.length, 0), dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for depth, some in taken.items():
            sizes = [len(c) for _, c in some]
            heads = np.repeat(np.array([b for b, _ in some], dtype=np.int64).T, sizes, axis=1)
            keys = np.fromiter(chain.from_iterable(c for _, c in some), np.int64, sum(sizes))
            ids.append(np.vstack([heads, _unpacked(keys, self.length - depth)]))
            counts.append(np.fromiter(chain.from_iterable(c.values() for _, c in some), np.int64, sum(sizes)))
        return np.concatenate(ids, axis=1), np.concatenate(counts)


RUN = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _run(lang: str, words: list[bytes], ids: np.ndarray, counts: np.ndarray, shortest: int) -> Iterator[pa.RecordBatch]:
    """Spilled sequences as a run sorted by words: each phrase of shortest words or more that starts one, counted."""
    names = pa.array(words, pa.binary())
    rank = np.empty(len(words), dtype=np.int64)
    rank[pc.sort_indices(names).to_numpy()] = np.arange(len(words))
    order = np.argsort(_packed(rank[ids])) if len(ids) < 4 else np.lexsort(rank[ids[::-1]])
    ids, counts = ids[:, order], counts[order]
    for length in range(shortest, len(ids) + 1):
        there = ids[length - 1] > 0
        some, n = ids[:length, there], counts[there]
        if not len(n):
            continue
        starts = np.flatnonzero(np.r_[True, (some[:, 1:] != some[:, :-1]).any(axis=0)])
        some, n = some[:, starts], np.add.reduceat(n, starts)
        for at in range(0, len(n), ROWS):
            parts = [names.take(pa.array(row[at : at + ROWS])) for row in some]
            phrase = pc.binary_join_element_wise(*parts, b" ").cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(phrase)), phrase, pa.array(n[at : at + ROWS])], schema=RUN)


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """lang, phrase, n of the words that occur so often, and of each language (phrase null) the number of all words."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        return sums.rename_columns(["lang", "phrase", "n"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for lang, tokens in _by_lang(batch):
                kinds = tokens.value_counts()
                words, n = kinds.field("values"), kinds.field("counts")
                real = pc.not_equal(words, END)
                words, n = words.filter(real).cast(pa.large_string()), n.filter(real)
                words = pa.concat_arrays([words, pa.array([None], pa.large_string())])
                n = pa.concat_arrays([n, pa.array([pc.sum(n).as_py() or 0], pa.int64())])
                parts.append(pa.table({"lang": pa.repeat(lang, len(n)), "phrase": words, "n": n}))
                held += len(n)
            if held >= HELD:
                parts = [merged(parts)]
                held = parts[0].num_rows
                if 2 * held >= HELD:
                    yield from parts[0].to_batches(ROWS)
                    parts, held = [], 0
        if parts:
            yield from merged(parts).to_batches(ROWS)

    partial = texts.mapInArrow(counted, "lang string, phrase string, n long")
    return partial.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("phrase").isNull() | (F.col("n") >= least))


def summed_runs(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, phrase, n) sorted by lang and phrase: each phrase with the sum of its n, if that is least or more.

    A batch's last phrase waits for the next batch. Neighbours are compared; pyarrow's group_by() wouldn't do, as it
    doesn't keep the order of rows.
    """
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = (rows if rest is None else pa.concat_tables([rest, rows])).combine_chunks()
        other = np.zeros(len(rows) - 1, dtype=bool)
        for name in ("lang", "phrase"):
            column = rows.column(name)
            other |= pc.not_equal(column.slice(1), column.slice(0, len(rows) - 1)).to_numpy()
        starts = np.flatnonzero(np.r_[True, other])
        n = np.add.reduceat(rows.column("n").to_numpy(), starts)
        sums = rows.take(pa.array(starts)).set_column(rows.schema.get_field_index("n"), "n", pa.array(n))
        rest = sums.slice(len(sums) - 1)
        yield from sums.slice(0, len(sums) - 1).filter(pc.field("n") >= least).to_batches()
    if rest is not None:
        yield from rest.filter(pc.field("n") >= least).to_batches()


def phrase_counts(texts: DataFrame, least: int, words: Sieve, pairs: Sieve | None = None, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n of phrases that occur so often: of two words, or with a sieve of pairs those of three and more.

    Each task counts the word sequences at all places of its texts in a HAT-trie by language. When it holds too much,
    whole subtrees leave it as sorted runs. Runs meet in the partition of their first two words, where Spark's sort
    merges them and equal neighbours are summed. A word or pair that the sieves rule out is too rare to be part of
    any such phrase, so it ends a sequence.
    """
    shared = texts.sparkSession.sparkContext.broadcast((words, pairs))
    length, shortest = (longest, 3) if pairs else (2, 2)

    def sequences(ids: np.ndarray, start: int, names: WordIds) -> np.ndarray:
        """The sequences that begin at the first start places, as columns; those too short to count are left out."""
        ids = np.r_[ids, np.zeros(length, dtype=np.int64)]
        rows = np.array([ids[k : k + start] for k in range(length)])
        alive = rows[0] > 0
        for k in range(1, length):
            alive = alive & (rows[k] > 0)
            if shared.value[1]:
                some = np.flatnonzero(alive)
                h = names.hashes
                alive[some] = shared.value[1].passes(h[rows[k - 1][some]] ^ h[rows[k][some]] >> np.uint64(SHIFT))
            rows[k][~alive] = 0
        return rows[:, rows[shortest - 1] > 0]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries: dict[str, tuple[WordIds, HatTrie]] = {}

        def spill(lang: str, keep: int) -> Iterator[pa.RecordBatch]:
            names, trie = tries[lang]
            ids, counts = trie.spill(keep)
            if len(counts):
                yield from _run(lang, names.words, ids, counts, shortest)
            if not keep:
                del tries[lang]

        for batch in batches:
            for lang, tokens in _by_lang(batch):
                for at in range(0, len(tokens), TOKENS):
                    names, trie = tries.setdefault(lang, (WordIds(lang, shared.value[0]), HatTrie(length)))
                    ids = names.of(tokens.slice(at, TOKENS + length - 1))
                    trie.add(sequences(ids, min(TOKENS, len(ids)), names))
                    if len(names.words) > WORDS:
                        yield from spill(lang, 0)
                    elif trie.size > HELD:
                        yield from spill(lang, HELD // 2)
            while sum(len(n.words) + t.size for n, t in tries.values()) > HELD + WORDS:
                yield from spill(max(tries, key=lambda x: tries[x][1].size), 0)
        for lang in list(tries):
            yield from spill(lang, 0)

    found = texts.mapInArrow(runs, "lang string, phrase string, n long")
    met = found.repartition("lang", F.substring_index("phrase", " ", 2)).sortWithinPartitions("lang", "phrase")
    return met.mapInArrow(lambda batches: summed_runs(batches, least), "lang string, phrase string, n long")


def with_scores(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases (lang, phrase, n): by their lowest-scoring cut, and of several that
    with the shortest first part. Both parts' counts are joined at once; a part that very many cuts have is broadcast."""
    counts = words.where("phrase is not null").union(phrases)
    said = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(said) - 1)).alias("k"))
    part = lambda start, length: F.array_join(F.slice(said, start, length), " ")
    first = F.struct(F.lit("l").alias("side"), part(F.lit(1), F.col("k")).alias("part"))
    rest = F.struct(F.lit("r").alias("side"), part(F.col("k") + 1, F.size(said)).alias("part"))
    sides = cut(cuts.withColumn("s", F.explode(F.array(first, rest))).select("lang", "phrase", "a", "k", "s.side", "s.part"))
    wanted = sides.groupBy("lang", "part").agg(F.count("*").alias("rows"))
    known = cut(wanted.join(counts.select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"]))
    met = join_by_key(sides, known, ["lang", "part"], "rows", sides.count())
    of = lambda side: F.max(F.when(F.col("side") == side, F.col("n"))).alias(side)
    pairs = met.groupBy("lang", "phrase", "a", "k").agg(of("l"), of("r"))
    # Exact: the product may pass 64 bits, the quotient can't, as l and r are a at least.
    score = F.expr(f"cast(a as decimal(19)) * {SCALE} div (cast(l as decimal(19)) + r)").alias("score")
    lowest = pairs.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("c"))
    return lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def uncovered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """The phrases (lang, phrase, n) that no longer one holds with cover per cent of their occurrences or more."""
    said, size = F.split("phrase", " "), F.size(F.split("phrase", " "))
    longer = phrases.where(size > 2)
    lengths = F.sequence(F.lit(2), size - 1)
    parts = F.flatten(
        F.transform(lengths, lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda k: F.array_join(F.slice(said, k, m), " ")))
    )
    held = longer.select("lang", F.explode(parts).alias("phrase"), F.col("n").alias("most"))
    most = held.groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    covered = F.expr(f"cast(most as decimal(19)) * 100 >= cast(n as decimal(19)) * {cover}")
    return phrases.join(most, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False))).drop("most")


def collocations(
    df: DataFrame, least: int = LEAST, cover: int = COVER, best: int = BEST, longest: int = LONGEST,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to longest (3 or 4) words.

    Texts, lower-cased at A-Z, are pieces between any of .,;:!? and line ends; phrases lie within a piece. A phrase that
    occurs a times (least or more) is scored by 2,000,000 * a / (l + r), rounded down, l and r being the counts of the
    two parts of its worst cut; n is the number of the language's words. Left out are phrases that a longer one holds in
    cover per cent of their occurrences. Order: score and count falling, then phrase by its bytes. A null language is
    und; null and empty texts have no words; repeated rows count again; other columns are ignored; an empty table has
    no phrases.
    """
    small_batches(df.sparkSession)
    texts = df.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit(NO_LANG)).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    texts = texts.where(F.length("text") > 0)
    words = stored(word_counts(texts, least), "words")
    frequent = words.where("phrase is not null")
    word_sieve = sieve_of(frequent, word_hash(F.col("phrase")))
    pairs = stored(phrase_counts(texts, least, word_sieve), "pairs")
    in_pair = lambda n: F.substring_index("phrase", " ", n)
    pair_sieve = sieve_of(pairs, pair_hash(in_pair(1), in_pair(-1)))
    longer = phrase_counts(texts, least, word_sieve, pair_sieve, longest)
    phrases = stored(pairs.union(longer), "phrases")
    kept = with_scores(phrases, words).join(uncovered(phrases, cover), ["lang", "phrase"], "left_semi")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_k(kept, ["lang"], order, best, salts=SPREAD)
    totals = words.where("phrase is null").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def _sql(least: int = LEAST, cover: int = COVER, best: int = BEST) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {m} AS m, unnest(list_transform(range(1, len(w) - {m - 2}), lambda i: array_to_string(w[i:i + {m - 1}], ' '))) AS phrase "
        f"FROM pieces WHERE len(w) >= {m}" for m in range(1, LONGEST + 1)
    )
    return f"""
WITH lowered AS (SELECT coalesce(lang, '{NO_LANG}') AS lang,
    translate(coalesce(text, ''), '{_CAPITALS.decode()}', '{_CAPITALS.decode().lower()}') AS text FROM documents),
split AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM lowered),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
grams AS ({grams}),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counts WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE m > 1 AND f >= {least}),
parts AS (SELECT lang, phrase, a, k, struct_pack(lang, phrase := array_to_string(w[1:k], ' ')) AS head,
    struct_pack(lang, phrase := array_to_string(w[k + 1:], ' ')) AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)),
keyed AS (SELECT struct_pack(lang, phrase) AS key, f FROM counts),
cuts AS (SELECT lang, phrase, a, k, h.f AS l, t.f AS r, CAST(CAST(a AS HUGEINT) * {SCALE} // (h.f + t.f) AS BIGINT) AS score
  FROM parts JOIN keyed h ON h.key = head JOIN keyed t ON t.key = tail),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, a, array_to_string(w[i:i + s - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM candidates))),
most AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM lowest LEFT JOIN most USING (lang, phrase) JOIN totals USING (lang)
WHERE most IS NULL OR 100 * CAST(most AS HUGEINT) < {cover} * CAST(a AS HUGEINT) QUALIFY rank <= {best}
"""


OP11_SQL = _sql()
