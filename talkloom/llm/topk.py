"""Exact top-k search by inner product over a table of pivot distances."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from talkloom.llm.support import cut, spread_hash, table
from talkloom.llm.vectors import matrix, sound_vectors

SCALE, TOP, EVERY = 256.0, 5, 50
#: Pivots of a dimension: this share of it, and this many at most; they are chosen among so many vectors.
PIVOT_SHARE, MOST_PIVOTS, SAMPLE = 0.75, 192, 2000
#: The most frequent dimensions, so many, have pivots of their own; vectors of others are bounded by their length alone.
DIMENSIONS = 16
#: Candidates of a block, queries that meet it in one task, and numbers that a task holds at once while it bounds pairs.
BLOCK, QUERIES, HELD = 2048, 8192, 1 << 21
#: Above this, sums of products may not be exact in double precision, and plain integers are used.
EXACT = 2.0**52
#: Squared lengths from which on bounds would overflow; such blocks are compared whole.
MOST_SQUARE = 1e300
#: Rounding of distances, as a part of the largest squared length.
ROUNDING = 1e-5
PRODUCTS = "query_row long, query_id long, vec_id long, row long, score long, exact double, tested long"


def farthest_first(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, or as many as differ: the longest, then always the one farthest from those taken."""
    taken = [int((rows * rows).sum(1).argmax())]
    far = ((rows - rows[taken[0]]) ** 2).sum(1)
    while len(taken) < n and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[taken[-1]]) ** 2).sum(1))
    return rows[taken]


def pivots_of(
    vectors: DataFrame, share: float = PIVOT_SHARE, most: int = MOST_PIVOTS, sample: int = SAMPLE
) -> dict[int, np.ndarray]:
    """The pivots of each of the most frequent dimensions, farthest first within a sample of bounded size.

    Any pivots give right results: they only decide how early a search stops.
    """
    counts = vectors.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS).collect()
    if not counts:
        return {}
    chance = F.create_map(*(F.lit(x) for r in counts for x in (r[0], min(1.0, sample / r[1]))))
    some = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < chance[F.col("dim")] * (1 << 20))

    def chosen(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(group["vector"].to_numpy())
        n = max(1, min(most, int(share * rows.shape[1])))
        return pd.DataFrame({"dim": rows.shape[1], "pivot": list(farthest_first(rows, n))})

    found: dict[int, list] = {}
    for dim, pivot in some.groupBy("dim").applyInPandas(chosen, "dim int, pivot array<double>").collect():
        found.setdefault(dim, []).append(pivot)
    return {dim: np.array(rows) for dim, rows in found.items()}


def _of(points: dict[int, np.ndarray], dim: int) -> np.ndarray:
    return points.get(dim, np.zeros((1, dim)))


def with_pivot_distances(vectors: DataFrame, points: dict[int, np.ndarray]) -> DataFrame:
    """The pivot table: vectors with distances, each row's distances to the pivots of its dimension, and the nearest
    pivot as its cell."""
    columns = vectors.columns

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                rows, pivots = matrix(part.column("vector")), _of(points, int(dim))
                square = (rows * rows).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * rows @ pivots.T
                far = np.sqrt(np.maximum(square, 0))
                added = [pa.array(list(far), pa.list_(pa.float64())), pa.array(far.argmin(axis=1).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*columns, "distances", "cell"])

    kinds = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(measured, f"{kinds}, distances array<double>, cell int")


def _in_span(distances: np.ndarray, square: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the distances say of where vectors lie: coordinates in the span of the pivots, and distance from it."""
    products = (square[:, None] + (pivots * pivots).sum(1)[None, :] - distances * distances) / 2
    values, axes = np.linalg.eigh(pivots @ pivots.T)
    firm = values > 1e-8 * max(values[-1], 1e-300)
    inside = products @ (axes[:, firm] / np.sqrt(values[firm]))
    return inside, np.sqrt(np.maximum(square - (inside * inside).sum(1), 0))


def _float_products(rows: np.ndarray, query: np.ndarray) -> list[float]:
    return (rows @ query).tolist()


def _integer_products(rows: np.ndarray, query: np.ndarray) -> list[int]:
    whole = list(map(int, query))
    return [sum(int(a) * b for a, b in zip(row, whole)) for row in rows]


def _as_double(score: float) -> float:
    """A score, which may be an integer beyond all doubles, as the nearest double."""
    try:
        return float(score)
    except OverflowError:
        return math.inf if score > 0 else -math.inf


def _as_long(score: float) -> int:
    return max(-(2**63), min(2**63 - 1, int(score)))


def _best(
    bound: np.ndarray, products: Callable, names: list[tuple[int, int]], k: int, least: float
) -> tuple[list, int]:
    """The k best of a query, as (-score as a double, -score as a long, vec_id, row), and how many products that took:
    candidates in the order of falling bounds, until none that is left can reach the k-th score (at first: least)."""
    order = np.flatnonzero(bound >= least)
    order = order[np.argsort(-bound[order], kind="stable")]
    best: list[tuple] = []
    done, step = 0, 32
    while done < len(order) and (len(best) < k or bound[order[done]] >= -best[-1][0]):
        some = order[done : done + step]
        if len(best) == k:
            some = some[bound[some] >= -best[-1][0]]
        scores = products(some)
        floor = -best[-1][0] if len(best) == k else None
        found = ((_as_double(s), s, names[n]) for n, s in zip(some.tolist(), scores))
        kept = ((-d, -_as_long(s), *name) for d, s, name in found if floor is None or d >= floor)
        best = sorted([*best, *kept])[:k]
        done, step = done + len(some), 2 * step
    return best, done


def _search(queries: pd.DataFrame, candidates: pd.DataFrame, pivots: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best candidates of one block, and a row without candidate that says how many were tested.

    Vectors lie at known places of the pivots' span, at known distances from it; what is unknown is the direction
    there. So the distance of two vectors is at least that of their places with the distances put side by side, which
    is never less than the largest difference of their distances to a pivot; and the inner product is at most the
    product within the span plus that of the distances from it.
    """
    q, v = (np.stack(x["vector"].to_numpy()) for x in (queries, candidates))
    q2, v2 = (q * q).sum(1), (v * v).sum(1)
    largest = max(q2.max(), v2.max())
    bounded = max(largest, np.abs(pivots).max() ** 2 * pivots.shape[1]) < MOST_SQUARE
    if bounded:
        qa, qr = _in_span(np.stack(queries["distances"].to_numpy()), q2, pivots)
        va, vr = _in_span(np.stack(candidates["distances"].to_numpy()), v2, pivots)
    product = _float_products if largest < EXACT else _integer_products
    names = list(zip(candidates["vec_id"].tolist(), candidates["row"].tolist()))
    own = candidates["row"].to_numpy()
    least = queries["least"].to_numpy()
    out: list[tuple] = []
    step = max(1, HELD // len(v))
    for at in range(0, len(q), step):
        if bounded:
            bounds = qa[at : at + step] @ va.T + qr[at : at + step, None] * vr[None, :] + ROUNDING * (1 + largest)
        else:
            bounds = np.full((len(q[at : at + step]), len(v)), np.inf)
        for n, bound in enumerate(bounds, at):
            row = int(queries["row"].iloc[n])
            bound[own == row] = -np.inf
            start = least[n] if least[n] > -np.inf else np.finfo(float).min
            best, tested = _best(bound, lambda some: product(v[some], q[n]), names, k, start)
            key = (row, int(queries["vec_id"].iloc[n]))
            out += [(*key, i, r, -s, -d, None) for d, s, i, r in best]
            out.append((*key, None, None, None, None, tested))
    columns = [c.split()[0] for c in PRODUCTS.split(", ")]
    return pd.DataFrame(out, columns=columns, dtype=object).astype({c: "Int64" for c in columns if c != "exact"})


def first_of_equal(vectors: DataFrame, n: int) -> DataFrame:
    """Of rows with equal vectors those of the least ids, n of them. Partial limits before the shuffle keep a vector
    that very many rows have from landing in one task."""
    order = Window.partitionBy("h", "dim", "vector").orderBy("vec_id", "row")
    return vectors.withColumn("h", F.xxhash64("vector")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= n).drop("n", "h")


def search_blocks(
    queries: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK, share: float = PIVOT_SHARE
) -> DataFrame:
    """query_row, query_id, vec_id, row, score, exact (the score as a double), tested: found candidates, the k best of
    each query among them, and rows without candidate that count the products that took.

    The nearest pivot is a candidate's cell. Small cells share a block and large ones are cut into several, so blocks
    have a bounded size. Each query first searches the first block of its own cell: its k-th score there bounds what
    follows, and blocks none of whose cells can reach it are not visited.
    """
    points = pivots_of(candidates, share)
    kept = first_of_equal(candidates.select("row", "vec_id", "vector", "dim"), k + 1)
    v = cut(with_pivot_distances(kept, points))
    q = cut(with_pivot_distances(queries.select("row", "vec_id", "vector", "dim"), points))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    own = F.element_at("distances", F.col("cell") + 1)
    cells = v.groupBy("dim", "cell").agg(
        F.count("*").alias("n"), F.max(square).alias("longest"), F.min(own).alias("near"), F.max(own).alias("far")
    )
    before = F.coalesce(
        F.sum("n").over(Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    cells = cells.withColumn("first", F.floor(before / block).cast("int")).withColumn(
        "last", F.floor((before + F.col("n") - 1) / block).cast("int")
    )
    listed = cut(
        cells.groupBy("dim").agg(
            F.array_sort(F.collect_list(F.struct("cell", "longest", "near", "far", "first", "last"))).alias("cells")
        )
    )
    # A row a dimension, of at most MOST_PIVOTS cells; columns of more dimensions than this are joined by a shuffle.
    n_dims, last = listed.agg(F.count("*"), F.max(F.array_max(F.transform("cells", lambda c: c["last"])))).first()
    listed = F.broadcast(listed) if n_dims <= 64 * DIMENSIONS else listed
    in_cell = F.filter("cells", lambda c: c["cell"] == F.col("cell"))[0]

    def searched(visits: DataFrame, blocks: DataFrame) -> DataFrame:
        """visits: dim, j and the query; blocks: dim, j and the candidate. A crowd of queries is cut into parts."""
        crowd = cut(
            visits.groupBy("dim", "j").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts"))
        )  # a row a block
        left = visits.join(crowd, ["dim", "j"]).withColumn("i", spread_hash(F.col("parts"), "row", salt=3))
        right = blocks.join(crowd, ["dim", "j"]).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["dim", "j", "i"]

        def search(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            return _search(a, b, _of(points, key[0]), k) if len(a) and len(b) else pd.DataFrame(
                {c.split()[0]: [] for c in PRODUCTS.split(", ")}
            )

        a = left.select(*keys, "row", "vec_id", "vector", "distances", "least")
        b = right.select(*keys, "row", "vec_id", "vector", "distances")
        return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(search, PRODUCTS)

    placed = v.join(listed, "dim").withColumn("in", in_cell)
    placed = placed.withColumn("j", F.col("in.first") + spread_hash(F.col("in.last") - F.col("in.first") + 1, "row"))
    at_home = q.join(listed, "dim").withColumn("j", F.coalesce(in_cell["first"], F.lit(0)))
    first = cut(searched(at_home.withColumn("least", F.lit(float("-inf"))), placed))
    if not last:
        return first  # every dimension is one block: none is left to visit
    order = Window.partitionBy("query_row").orderBy(F.desc("exact"), F.desc("score"), "vec_id", "row")
    known = first.where("vec_id is not null").withColumn("n", F.row_number().over(order)).where(F.col("n") == k)
    known = known.select(F.col("query_row").alias("row"), F.col("exact").alias("least"))
    bounded = at_home.withColumnRenamed("j", "home").join(known, "row", "left").withColumn(
        "least", F.coalesce("least", F.lit(float("-inf")))
    )

    def in_reach(c):
        to_pivot = F.element_at("distances", c["cell"] + 1)
        apart = F.greatest(F.lit(0.0), to_pivot - c["far"], c["near"] - to_pivot, (to_pivot - F.col("nearest")) / 2)
        bound = (F.col("square") + c["longest"] - apart * apart) / 2
        return bound + F.lit(ROUNDING) * (1 + F.greatest(F.col("square"), c["longest"])) >= F.col("least")

    measures = bounded.withColumn("square", square).withColumn("nearest", F.array_min("distances"))
    visited = F.array_distinct(
        F.flatten(F.transform(F.filter("cells", in_reach), lambda c: F.sequence(c["first"], c["last"])))
    )
    rest = measures.withColumn("j", F.explode(visited)).where("j <> home").select(
        "dim", "j", "row", "vec_id", "vector", "distances", "least"
    )
    return first.union(searched(rest, placed))


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK, share: float = PIVOT_SHARE
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k candidates of highest inner product, ties to the smaller id.

    Both tables hold row (which row of the source it is), vec_id, vector (array<double> of whole numbers) and dim;
    only vectors of one dimension are compared, and a query's own row is no candidate. Rows that repeat an id are
    queries and candidates of their own; a query with fewer candidates gets all of them. Scores beyond a long are
    ranked as doubles and returned as the nearest long.
    """
    found = search_blocks(queries, candidates, k, block, share).where("vec_id is not null")
    order = Window.partitionBy("query_row").orderBy(F.desc("exact"), F.desc("score"), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def tested_share(queries: DataFrame, candidates: DataFrame, k: int, **how) -> float:
    """The share of pairs whose product a search computes; the others' bounds were enough."""
    tested = search_blocks(queries, candidates, k, **how).agg(F.sum("tested")).first()[0] or 0
    return tested / max(1, queries.count() * candidates.count())


def quantised(df: DataFrame, scale: float = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id, vector and dim, each component x as floor(scale * x), a double; computed once.

    Rows without an id, and vectors that are null, empty or hold null or non-finite components before or after
    scaling, are left out.
    """
    named = df.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").alias("id"),
        F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * F.lit(scale)).alias("scaled")
    )
    whole = lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)
    vectors = sound_vectors(named, "id", "scaled").withColumn("vector", F.transform("vector", whole))
    return cut(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vector", "dim"))


def op2_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors.where(F.col("vec_id") % EVERY == 0), vectors, TOP)


OP2_SQL = """
WITH sound AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.n <> c.n AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5
"""
