"""Packing token sequences of fixed length, balanced by estimated attention cost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from talkloom.llm.support import small_batches, table
from talkloom.llm.tokens import VOCABULARY, encoder

LENGTH = 2048
#: Tokens that a task gathers before it packs them: about 4 bytes each, and as many again while packing.
POOL_TOKENS = 2_000_000
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (feed-forward layers, attention).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024


def cost_of(n):
    return LINEAR * n + QUADRATIC * n * n


def powers_of_two(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def plan_pool(lengths: list[int], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, tokens, sequence, offset) of every piece of a pool of documents, sequences from 0.

    Whole sequences are cut off long documents. What is left goes, in descending order, to the sequence of lowest
    cost that still has room; a rest that fits nowhere is cut to fill the emptiest ones. So all sequences are full
    but for the last tokens of the pool, which make sequences of falling powers of two, which need no padding.
    """
    sequence, rests = 0, []
    for doc, n in enumerate(lengths):
        for start in range(0, n - length + 1, length):
            yield doc, start, length, sequence, 0
            sequence += 1
        if n % length:
            rests.append((n % length, doc))
    rests.sort(key=lambda r: (-r[0], r[1]))
    total = sum(n for n, _ in rests)
    room = np.full(total // length, length, dtype=np.int64)
    cost = np.zeros(len(room))
    last: list[tuple[int, int, int]] = []
    for n, doc in rests:
        start = lengths[doc] - n
        while n and len(room):
            fits = np.where(room >= n, cost, np.inf)
            at = int(fits.argmin())
            take = n
            if fits[at] == np.inf:
                at = int(room.argmax())
                take = int(room[at])
                if not take:
                    break
            yield doc, start, take, sequence + at, length - int(room[at])
            room[at] -= take
            cost[at] += cost_of(take)
            start, n = start + take, n - take
        if n:
            last.append((doc, start, n))
    sequence += len(room)
    sizes = powers_of_two(total % length)
    offset = 0
    for doc, start, n in last:
        while n:
            take = min(n, sizes[0] - offset)
            yield doc, start, take, sequence, offset
            start, n, offset = start + take, n - take, offset + take
            if offset == sizes[0]:
                sizes, sequence, offset = sizes[1:], sequence + 1, 0


def pack_documents(
    df: DataFrame, path: str, end_id: int = 1, length: int = LENGTH, pool_tokens: int = POOL_TOKENS,
    id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of every document: doc_id, start, length, token_ids, doc_tokens, sequence_id, offset.

    token_ids holds the piece's ids as little-endian unsigned 32-bit numbers; a document is its text's ids and then
    end_id, so a null or empty text is that id alone. Each task packs its own rows, pool by pool in bounded memory,
    without a shuffle; sequence_id holds the task's partition in its upper bits. A row is a document, whether or not
    its id is repeated or null. Other columns are ignored.
    """
    columns = ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    small_batches(df.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        last = np.array([end_id], dtype="<u4").tobytes()
        first = TaskContext.get().partitionId() << 36
        id_type = None
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            pieces = list(plan_pool([len(t) // 4 for t in texts], length))
            for at in range(0, len(pieces), 4096):
                doc, start, size, sequence, offset = zip(*pieces[at : at + 4096])
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[d] for d in doc], id_type), pa.array(start, pa.int64()), pa.array(size, pa.int64()),
                    pa.array([texts[d][4 * a : 4 * (a + n)] for d, a, n in zip(doc, start, size)], pa.binary()),
                    pa.array(
                        [len(texts[d]) // 4 for d in doc], pa.int64()
                    ), pa.array([first + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()),
                ], columns)
            first += max((p[3] for p in pieces), default=-1) + 1
            ids.clear()
            texts.clear()
            held = 0

        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                tokens = encode(text.as_py()) + last
                ids.append(i)
                texts.append(tokens)
                held += len(tokens) // 4
                if held >= pool_tokens:
                    yield from flush()
        if ids:
            yield from flush()

    return rows.mapInArrow(
        packed,
        f"doc_id {kind}, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"
    )


def op10_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
