import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from talkloom.llm.packing import LENGTH, cost_of, pack_documents, plan_pool
from talkloom.llm.tokens import VOCABULARY, Merger, WordIds, count_tokens, encoder, words_of

PATH = public_tokenizers.path(VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
ODD = [
    "", "   ", "aaa aaaa aaaaaaa aaaaaaaaaaaaaa", "It's they're WE'LL 'sun' ''s !'s it’s", "ΣΑΣ Σ ὈΔΥΣΣΕΎΣ", "é é ÅÅ ﬁ",
    "a\x1cb\x1dc \x85 x\xa0y", "<|endoftext|> hi <|startoftext|>there<|endoftext|>", "<|endoftext", "İstanbul ǅ ß ẞ", "１２３ 12 ½ ٣",
    "投资组合 한국어 日本語 🤣👨‍👩‍👧 x", "a\u0000b", "🎉" * 50, "x" * 3000, "____ --- ...... !!!!!!!", "word " * 20_000,
]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice("aeinsthéßñ'’.,!? \n\tΣİ日🎉0 12") for _ in range(rng.randrange(200))) for _ in range(300)]


def frame(spark, values):
    return spark.createDataFrame([(k, t, "clash", 1) for k, t in enumerate(values)], "doc_id long, text string, n_tokens string, start int")


def test_counts_are_the_librarys(spark):
    values = texts()
    got = count_tokens(frame(spark, values), PATH).toPandas().sort_values("doc_id")
    assert got.n_tokens.tolist() == [len(e.ids) for e in LIBRARY.encode_batch(values, add_special_tokens=False)]
    assert got.n_bytes.tolist() == [len(t.encode()) for t in values]


def test_null_and_repeated_rows_and_no_rows(spark):
    rows = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_bytes, r.n_tokens) for r in count_tokens(rows, PATH).collect()) == [(False, 3, 2), (False, 3, 2), (True, 0, 0)]
    assert count_tokens(rows.limit(0), PATH).count() == 0 and pack_documents(rows.limit(0), PATH).count() == 0
    packed = pack_documents(rows, PATH).toPandas()
    assert packed.length.sum() == 1 + 3 + 3


def test_memory_of_words_is_bounded():
    merger = Merger(PATH)
    merger.counts.limit = 3
    values = [f"{a} {b}" for a in ("one", "two", "three") for b in ("four", "five", "six")]
    for _ in range(40):
        assert merger.count_texts(values) == [len(e.ids) for e in LIBRARY.encode_batch(values, add_special_tokens=False)]
        assert len(merger.counts) <= 3
    ids = encoder(PATH)
    small = WordIds(LIBRARY.model, ids.pattern, LIBRARY.get_vocab_size(), limit=2)
    assert [small[w] for w in words_of("alpha beta gamma delta alpha beta") * 5] == [ids.ids[w] for w in words_of("alpha beta gamma delta alpha beta") * 5]


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_every_token_once_without_padding(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 5, 300, 2047, 2048, 2049, 9000, rng.randrange(1, 6000)]) for _ in range(rng.randrange(1, 120))]
    sequences, documents = defaultdict(list), defaultdict(list)
    for doc, start, n, sequence, offset in plan_pool(lengths):
        sequences[sequence].append((offset, n))
        documents[doc].append((start, n))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at == LENGTH or at & (at - 1) == 0
    for doc, n in enumerate(lengths):
        assert sorted(documents[doc])[0][0] == 0 and sum(x for _, x in documents[doc]) == n
    assert sorted(sequences) == list(range(len(sequences)))


def test_plan_balances_cost():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 1500) for _ in range(2000)]
    costs = defaultdict(float)
    total = defaultdict(int)
    for _, _, n, sequence, _ in plan_pool(lengths):
        costs[sequence] += cost_of(n)
        total[sequence] += n
    full = np.array([costs[s] for s in costs if total[s] == LENGTH])
    order = np.arange(len(lengths))
    in_order, at = np.zeros(sum(lengths) // LENGTH + 1), 0
    for k in order:
        for start in range(at, at + lengths[k]):
            pass
        first = at // LENGTH
        spill = min(lengths[k], (first + 1) * LENGTH - at)
        in_order[first] += cost_of(spill)
        if lengths[k] > spill:
            in_order[first + 1] += cost_of(lengths[k] - spill)
        at += lengths[k]
    assert full.std() < in_order[:-1].std()


def test_round_trip(spark):
    values = texts()
    assert max(map(len, values)) >= 100_000
    rows = pack_documents(frame(spark, values).repartition(3), PATH, pool_tokens=2500).toPandas()
    assert rows.sequence_id.nunique() > 3
    for doc, pieces in rows.groupby("doc_id"):
        pieces = pieces.sort_values("start")
        ids = np.frombuffer(b"".join(pieces.token_ids), dtype="<u4")
        assert ids.tolist() == [*LIBRARY.encode(values[doc], add_special_tokens=False).ids, 1]
        assert (pieces.doc_tokens == len(ids)).all() and pieces.start.tolist() == [0, *np.cumsum(pieces.length)[:-1]]
    for _, pieces in rows.groupby("sequence_id"):
        assert pieces.sort_values("offset").offset.tolist() == [0, *np.cumsum(pieces.sort_values("offset").length)[:-1]]
    crc = pack_documents(frame(spark, ["a b c"]), PATH).select(F.crc32("token_ids").alias("c")).first().c
    assert crc == zlib.crc32(np.array([*LIBRARY.encode("a b c", add_special_tokens=False).ids, 1], dtype="<u4").tobytes())
