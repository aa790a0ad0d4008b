"""Near-duplicate vectors: spherical k-means cells, and cosine blocks within cells."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from talkloom.llm.components import connected_components
from talkloom.llm.support import cut, join_by_key, spread_hash, table
from talkloom.llm.vectors import matrix, sound

COSINE = 0.9
#: Vectors that cells are fitted on, for each cell (by a hash of the row); all vectors are assigned.
SAMPLE = 64
#: The most frequent dimensions, so many, have cells; vectors of each other one are a single cell.
DIMENSIONS = 16
#: Members, and visitors, that one task compares.
BLOCK = 4096


def number_of_cells(n: int) -> int:
    """Half the square root: cells and their members grow alike."""
    return max(1, math.ceil(math.sqrt(n) / 2))


def unit_vector(name: str) -> Column:
    """unit_rows() as an expression; scaled by the largest component first, so that no square over- or underflows."""
    v = F.col(name).cast("array<double>")
    once = lambda value, of: F.transform(F.array(value), of)[0]  # noqa: E731  # not again for each component
    scaled = once(F.array_max(F.transform(v, F.abs)), lambda most: F.transform(v, lambda x: x / most))
    length = lambda u: F.sqrt(F.aggregate(u, F.lit(0.0), lambda s, x: s + x * x))
    return once(scaled, lambda u: once(length(u), lambda n: F.transform(u, lambda x: x / n)))


def cell_centres(
    vectors: DataFrame, n: int, cells: int | None = None, sample: int = SAMPLE, seed: int = 5
) -> np.ndarray:
    """Unit centres of spherical k-means over n vectors (row, vector) of one dimension."""
    k = cells or number_of_cells(n)
    part = vectors.where(F.pmod(F.xxhash64("row"), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, sample * k / n)))
    fitted = cut(part.select(array_to_vector(unit_vector("vector")).alias("v")))
    model = KMeans(
        k=max(2, k), distanceMeasure="cosine", maxIter=8, initSteps=1, seed=seed, featuresCol="v"
    ).fit(fitted)
    centres = np.array(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square over- or underflows
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def visit_distance(cosine: float, dim: int, exact: bool = False) -> float:
    """How far from the border between its own cell and another a vector visits the other.

    Two linked vectors are at most chord = sqrt(2 - 2 * cosine) apart. If they lie in two cells, each on its own side
    of the border between the centres, one of them is within chord / 2 of it: visits up to there miss no link. Along
    a direction that has nothing to do with theirs, they differ by about chord / sqrt(dim) only; four times that,
    for both together, is the default. Up to 16 dimensions the two are the same.
    """
    chord = math.sqrt(max(0.0, 2 - 2 * cosine))
    return chord / 2 * (1.0 if exact else min(1.0, 4 / math.sqrt(min(dim, 64))))


def with_cells(
    vectors: DataFrame, centres: dict[int, np.ndarray], cosine: float = COSINE, exact: bool = False
) -> DataFrame:
    """vectors (row, vector, dim, n) with their home cell and the cells they visit (home first)."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)  # half a square root of the rows, for each dimension
    columns = vectors.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = {
            d: np.sqrt(np.maximum(2 - 2 * c @ c.T, 0)) * visit_distance(cosine, d, exact) for d,
            c in shared.value.items()
        }
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim in apart:
                    likeness = unit_rows(matrix(part.column("vector"))) @ shared.value[dim].T
                    home = likeness.argmax(axis=1)
                    near = likeness.max(axis=1, keepdims=True) - likeness <= apart[dim][home] + 1e-9
                    near[np.arange(len(home)), home] = False
                else:
                    home, near = np.zeros(len(part), dtype=np.int64), np.zeros((len(part), 1), dtype=bool)
                visits = [np.r_[h, np.flatnonzero(x)].astype(np.int32) for h, x in zip(home, near)]
                added = [pa.array(home.astype(np.int32)), pa.array(visits, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *added], [*columns, "home", "visits"])

    kinds = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(placed, f"{kinds}, home int, visits array<int>")


FOUND = "row long, links long, root long"


def _compare(cell: int, rows: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Link counts, and links that join what pairs of this block join: visitors against members of the cell."""
    members, guests = rows[rows["member"]], rows[~rows["member"]]
    if not len(members) or not len(guests):
        return pd.DataFrame({"row": [], "links": [], "root": []})
    m, g = (unit_rows(np.stack(x["vector"].to_numpy()).astype(np.float64)) for x in (members, guests))
    hits = g @ m.T >= cosine
    m_row, g_row = members["row"].to_numpy(), guests["row"].to_numpy()
    hits &= g_row[:, None] != m_row[None, :]
    # A member counts a visitor from elsewhere here only if it doesn't visit the visitor's own cell, where it would.
    away = (guests["home"] != cell).to_numpy()
    one_way = np.zeros(len(members), dtype=np.int64)
    if away.any():
        visits = [set(v) for v in members["visits"]]
        homes, copies = guests["home"].to_numpy()[away], guests["n"].to_numpy()[away]
        found = hits[away]
        for at in np.flatnonzero(found.any(axis=0)):
            one_way[at] = sum(n for h, n in zip(homes[found[:, at]], copies[found[:, at]]) if h not in visits[at])
    # Components of the block's links, by passing on the least root.
    ids = np.r_[m_row, g_row]
    roots = ids.copy()
    some = np.flatnonzero(hits.any(axis=1))
    links = hits[some]
    highest = np.iinfo(np.int64).max
    while len(some):
        before = roots.copy()
        gr = np.minimum(roots[len(m) + some], np.where(links, roots[: len(m)][None, :], highest).min(axis=1))
        roots[len(m) + some] = gr
        roots[: len(m)] = np.minimum(roots[: len(m)], np.where(links, gr[:, None], highest).min(axis=0))
        if (roots == before).all():
            break
    counts = np.r_[one_way, hits @ members["n"].to_numpy()]
    out = pd.DataFrame({"row": ids, "links": counts, "root": roots})
    return out[(out["links"] > 0) | (out["root"] != out["row"])]


def neighbour_links(
    vectors: DataFrame, cosine: float = COSINE, cells: int | None = None, exact: bool = False, block: int = BLOCK
) -> DataFrame:
    """row, links, root: partial counts and roots, from comparing each vector with the members of cells it visits.

    vectors holds row (a unique long), vector, dim and n (how many copies it stands for). A cell's members, and its
    visitors, are dealt over blocks of bounded size, so a crowded cell is the work of many tasks.
    """
    counts = vectors.groupBy("dim").count().where("count > 1").orderBy(F.desc("count"), "dim").limit(DIMENSIONS).collect()
    centres = {d: cell_centres(vectors.where(F.col("dim") == d), n, cells) for d, n in ((r[0], r[1]) for r in counts)}
    placed = cut(with_cells(vectors, centres, cosine, exact))
    visiting = placed.select("row", "vector", "dim", "n", "home", F.explode("visits").alias("cell"))
    sizes = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.count("*").alias("members"))
    sizes = sizes.join(visiting.groupBy("dim", "cell").agg(F.count("*").alias("guests")), ["dim", "cell"])
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    # A row a cell: half a square root of the rows for each dimension.
    sizes = F.broadcast(cut(sizes.select("dim", "cell", parts("members").alias("mb"), parts("guests").alias("gb"))))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: spread_hash(F.col(n), "row")
    kept = ["dim", "cell", "i", "j", "row", "vector", "n", "home", "visits", "member"]
    guests = visiting.join(sizes, ["dim", "cell"]).withColumns(
        {"j": own("gb"), "visits": F.lit(None).cast("array<int>"), "member": F.lit(False)}
    )
    members = placed.withColumn("cell", F.col("home")).join(sizes, ["dim", "cell"]).withColumns(
        {"i": own("mb"), "member": F.lit(True)}
    )
    both = members.withColumn("j", each("gb")).select(*kept).union(guests.withColumn("i", each("mb")).select(*kept))
    return both.groupBy("dim", "cell", "i", "j").applyInPandas(lambda key, rows: _compare(key[1], rows, cosine), FOUND)


def near_vectors(
    df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", **how
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of df.

    Two rows are linked if their cosine, in double precision, is at least the bound and one of them visits the
    other's cell (see visit_distance(); exact=True misses none). Rows of equal vectors stand in for each other: one is
    compared, and all are linked. Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without an id, link with nothing. component_id is the least id reachable, kept marks the row that has it. Only
    vectors of one dimension are compared. Rows that repeat an id are compared as rows of their own, and each is
    returned; other columns are ignored.
    """
    narrow = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("vector"))
    able = F.col("vec_id").isNotNull() & sound("vector") & F.coalesce(
        F.exists("vector", lambda x: x != 0), F.lit(False)
    )
    rows = narrow.withColumns({"row": F.monotonically_increasing_id(), "able": able})
    rows = cut(rows.withColumns({"h": F.xxhash64("vector"), "g": F.xxhash64(F.lit(1), "vector")}))
    alike = rows.where("able").groupBy(F.size("vector").alias("dim"), "vector").agg(
        F.count("*").alias("n"), F.min("row").alias("row"), F.min("vec_id").alias("first")
    )
    alike = cut(alike)
    found = cut(neighbour_links(alike.select("row", "vector", "dim", "n"), cosine, **how))
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = cut(connected_components(found.select("row", "root")).toDF("row", "root"))
    classes = alike.select(
        "row", "first", "n", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("g")
    )
    classes = cut(
        classes.join(links, "row", "left").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")).drop("row")
    )
    least = classes.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("size"))
    n, total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    count = (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links")
    marked = cut(join_by_key(classes, least, ["root"], "size", n).select("h", "g", "n", count, "component_id"))
    linked = join_by_key(
        rows.where("able").select("vec_id", "h", "g"), marked, ["h", "g"], "n", total
    ).select("vec_id", "n_links", "component_id")
    alone = rows.where("not able").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP6_SQL = f"""
WITH RECURSIVE sound AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a
  JOIN sound b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
roots AS (SELECT e.vec_id, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id FROM embeddings e LEFT JOIN least l ON e.vec_id = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN counts ON vec_id = a
"""
