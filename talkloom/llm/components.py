"""Connected components of a link table, by star contractions within and across partitions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from talkloom.llm.support import cut, join_by_key

#: Links that a task gathers before it contracts them.
GATHERED = 2_000_000
#: Links that a partition holds at least, in the mean (16 bytes each): rounds over few links are no longer many small tasks.
LINKS = 100_000


def contracted(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vertices, least vertex reachable) of all ends but the least ones, by passing on least roots and jumping."""
    ids, ends = np.unique(np.r_[hi, lo], return_inverse=True)
    a, b = ends[: len(hi)], ends[len(hi) :]
    root = np.arange(len(ids))
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        least = np.minimum(ra, rb)
        np.minimum.at(root, ra, least)
        np.minimum.at(root, rb, least)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(ids)))
    return ids[moved], ids[root[moved]]


def _within_partitions(edges: DataFrame) -> DataFrame:
    """Each partition's links as stars around their least vertices: no vertex is hi twice in a partition."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi = lo = np.array([], dtype=np.int64)
        some: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            some.append((batch.column("hi").to_numpy(), batch.column("lo").to_numpy()))
            held += len(batch)
            if held >= GATHERED:
                hi, lo = contracted(
                    np.concatenate([hi, *(x[0] for x in some)]), np.concatenate([lo, *(x[1] for x in some)])
                )
                some, held = [], 0
        if some:
            hi, lo = contracted(
                np.concatenate([hi, *(x[0] for x in some)]), np.concatenate([lo, *(x[1] for x in some)])
            )
        if len(hi):
            yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], ["hi", "lo"])

    return edges.mapInArrow(stars, "hi long, lo long")


def _across_partitions(edges: DataFrame, total: int) -> DataFrame:
    """Hangs each vertex's larger neighbours on its smallest neighbour (or on itself, if that is smaller)."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"), F.lit(0).cast("long").alias("larger"))
    both = both.union(edges.select("lo", "hi", F.lit(1).cast("long")))
    least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum("larger").alias("n")))
    met = join_by_key(edges.withColumnRenamed("lo", "u"), least, ["u"], "n", total)
    return met.select("hi", F.col("m").alias("lo")).union(least.where("m < u").select("u", "m"))


def gathered(links: DataFrame) -> DataFrame:
    """links, which are computed already (they are counted), in a partition for each LINKS of them."""
    return links.coalesce(max(1, math.ceil(links.count() / LINKS)))


def connected_components(links: DataFrame) -> DataFrame:
    """(id, root) for every vertex of links, whose first two columns (longs) are the ends; root is the least id reachable.

    Links are first contracted where they lie, so a vertex with very many links is one of few by partition. Then
    each round hangs vertices on the least neighbour of their neighbours (links of a vertex that has very many are
    joined where they lie, see join_by_key()), deals links by their larger end and contracts again. Rounds grow with
    the logarithm of the longest chain, and partitions with the links: LINKS or fewer are one partition, which settles
    them. Links that repeat, link a vertex to itself or hold a null are ignored; no
    links give an empty table.
    """
    a, b = (F.col(f"`{c}`").cast("long") for c in links.columns[:2])
    sound = links.where(a.isNotNull() & b.isNotNull() & (a != b))
    edges = cut(_within_partitions(sound.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))))
    state = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now[0] == 0 or now == state:
            break
        state, parts = now, math.ceil(now[0] / LINKS)
        if parts == 1:
            edges = cut(_within_partitions(edges.coalesce(1)))
            break
        hung = _across_partitions(edges, now[0]).where("hi <> lo").repartition("hi")
        edges = cut(_within_partitions(hung.coalesce(parts)))
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("root")).distinct()
    return edges.select(F.col("hi").alias("id"), F.col("lo").alias("root")).union(roots)
