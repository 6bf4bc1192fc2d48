"""Near-duplicate embeddings with a pivot-permutation index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsgraph.llm.common import map_arrow
from newsgraph.llm.components import components
from newsgraph.session import stored

SIMILARITY = 0.95
NEAREST = 10  # pivots that describe a vector, in order of nearness
SHARED = 2  # pivots that a pair must share to be verified; one is enough if it is the nearest of both
MOST_PIVOTS = 16384  # bound of the sample that serves as pivots
BLOCK = 1024  # rows of an inverted list that are compared in one cell with as many others


def _numbers(column: pa.ListArray) -> Iterator[np.ndarray | None]:
    for item in column:
        yield None if item.values is None else item.values.to_numpy(zero_copy_only=False).astype(np.float64)


def _usable(vector: np.ndarray | None) -> bool:
    return vector is not None and len(vector) > 0 and bool(np.isfinite(vector).all()) and bool((vector != 0).any())


def _unit(vector: np.ndarray) -> np.ndarray:
    scaled = vector / np.abs(vector).max()  # keeps squares in range
    return scaled / np.sqrt(scaled @ scaled)


def _content(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each usable vector; NULL for the others."""
    for batch in batches:
        vectors = [v.tobytes() if _usable(v) else None for v in _numbers(batch.column(1))]
        yield pa.record_batch([batch.column(0), pa.array(vectors, pa.binary())], ["vec_id", "vector"])


def _postings(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, times, vectors = (batch.column(i).to_pylist() for i in range(3))
            out: list[tuple] = []
            by_size: dict[int, list[int]] = {}
            for i, vector in enumerate(vectors):
                by_size.setdefault(len(vector) // 8, []).append(i)
            for size, members in by_size.items():
                units = np.stack([_unit(np.frombuffer(vectors[i], np.float64)) for i in members])
                own = pivots[size]
                near = min(NEAREST, len(own))
                for at in range(0, len(units), 512):
                    cosine = units[at : at + 512] @ own.T
                    first = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
                    order = np.argsort(-np.take_along_axis(cosine, first, 1), axis=1, kind="stable")
                    first = np.take_along_axis(first, order, 1).astype(np.int32)
                    for row, i in zip(first, members[at : at + 512], strict=True):
                        out += [(size, int(p), classes[i], times[i], row.tobytes(), vectors[i]) for p in row]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            names = ["size", "pivot", "class", "times", "permutation", "vector"]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return run


def _shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many pivots each left vector shares with each right one, counted through posting lists; one more where
    both have the same nearest pivot."""
    by_pivot = np.argsort(right, axis=None, kind="stable")
    postings, owners = right.ravel()[by_pivot], by_pivot // right.shape[1]
    begin, end = (np.searchsorted(postings, left.ravel(), side) for side in ("left", "right"))
    lengths = end - begin
    at = np.arange(lengths.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    row = np.repeat(np.arange(left.size) // left.shape[1], lengths)
    counts = np.bincount(row * len(right) + owners[at], minlength=len(left) * len(right))
    return counts.reshape(len(left), len(right)) + (left[:, :1] == right[None, :, 0])


def _links(rows: list[tuple], similarity: float) -> list[tuple[int, int, int]]:
    """Links of one cell as rows (class, links, linked class of the spanning forest or itself).

    Shared pivots are counted first; only pairs with enough of them, in the list of the first pivot that both share,
    are verified by their cosine.
    """
    pivot, left_block, right_block = rows[0][1], rows[0][2], rows[0][3]
    classes = np.array([r[5] for r in rows])
    times = np.array([r[6] for r in rows])
    block = np.array([r[4] for r in rows])
    units = np.stack([_unit(np.frombuffer(r[8], np.float64)) for r in rows])
    permutations = np.stack([np.frombuffer(r[7], np.int32) for r in rows])
    left, right = np.flatnonzero(block == left_block), np.flatnonzero(block == right_block)
    if not len(left) or not len(right):
        return []
    need = min(SHARED, permutations.shape[1])
    links = np.zeros(len(rows), np.int64)
    root = np.arange(len(rows))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    step = max(1, min(1 << 16, (1 << 22) // units.shape[1]))
    for at in range(0, len(left), 128):
        part = left[at : at + 128]
        i, j = np.nonzero(_shared(permutations[part], permutations[right]) >= need)
        i, j = part[i], right[j]
        if left_block == right_block:
            i, j = i[i < j], j[i < j]
        for begin in range(0, len(i), step):
            a, b = i[begin : begin + step], j[begin : begin + step]
            same = (permutations[a][:, :, None] == permutations[b][:, None, :]).any(axis=2)
            first = np.where(same, permutations[a], np.iinfo(np.int32).max).min(axis=1) == pivot
            a, b = a[first], b[first]
            good = np.einsum("ij,ij->i", units[a], units[b]) >= similarity
            a, b = a[good], b[good]
            np.add.at(links, a, times[b])
            np.add.at(links, b, times[a])
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    forest.append((int(classes[x]), 0, int(classes[y])))
    counted = np.flatnonzero(links)
    return [(int(classes[k]), int(links[k]), int(classes[k])) for k in counted] + forest


def _compare(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def done() -> pa.RecordBatch:
            found = _links(rows, similarity) if len(rows) > 1 else []
            columns = list(zip(*found, strict=True)) or [[]] * 3
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["class", "links", "other"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != cell and rows:
                    yield done()
                    rows = []
                cell = row[:4]
                rows.append(row)
        if rows:
            yield done()

    return run


def near_groups(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = SIMILARITY
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Equal vectors are a class that is compared once, weighted with its size. Each distinct vector is described by
    its NEAREST pivots in order of nearness; pivots are distinct vectors picked by hash, the square root of their
    number and at most MOST_PIVOTS. Inverted lists bring together the vectors of a pivot. Shared pivots are counted
    first; a pair that shares at least SHARED of them, or its nearest one, is verified in the list of the first shared
    pivot only and is a link if it reaches the similarity (double precision). Lists are cut into blocks by hash and every two blocks are a cell, so no list of
    any length is in one task. Links leave a cell as counts and a spanning forest, never as pairs.

    Defined results: NULL, zero and non-finite vectors, empty ones too, link with nothing; vectors of different
    dimensions never link. Rows that repeat an id count as separate vectors with that id, each with its own links, and
    are in one component. A row with a NULL id is
    alone (component NULL, kept). Empty input: no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    rows = stored(map_arrow(rows, _content, "vec_id long, vector binary"), "vectors")
    usable = rows.where("vector IS NOT NULL AND vec_id IS NOT NULL")
    # A class has a number of its own: ids do not name vectors, an id may be repeated with different ones.
    classes = usable.groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("times"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    counts = classes.groupBy(F.octet_length("vector").alias("bytes")).agg(F.count("*").alias("n")).collect()
    pivots: dict[int, np.ndarray] = {}
    for length, n in counts:  # one entry per dimension
        wanted = min(MOST_PIVOTS, max(1, int(n**0.5)))
        sample = classes.where(F.octet_length("vector") == length).orderBy(F.xxhash64("vector"), "vector").limit(wanted)
        data = b"".join(r[0] for r in sample.select("vector").collect())  # bounded by MOST_PIVOTS
        pivots[length // 8] = np.stack([_unit(v) for v in np.frombuffer(data, np.float64).reshape(-1, length // 8)])

    described = map_arrow(
        classes.select("class", "times", "vector"),
        _postings(pivots),
        "size int, pivot int, class long, times long, permutation binary, vector binary",
    )
    described = stored(described, "postings")
    lengths = described.groupBy("size", "pivot").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
    placed = described.join(lengths, ["size", "pivot"])
    placed = placed.withColumn("_block", F.pmod(F.xxhash64("class"), "_blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))
    cells = placed.withColumn("_other", other).select(
        "size",
        "pivot",
        F.least("_block", "_other").alias("left"),
        F.greatest("_block", "_other").alias("right"),
        F.col("_block").alias("block"),
        "class",
        "times",
        "permutation",
        "vector",
    )
    key = ("size", "pivot", "left", "right")
    cells = cells.repartition(*key).sortWithinPartitions(*key)
    found = stored(map_arrow(cells, _compare(similarity), "class long, links long, other long"), "vector_links")
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    same = usable.join(classes, "vector").select("vec_id", "node", "class", "times")
    numbers = classes.select("class", F.col("node").alias("a")), classes.select(F.col("class").alias("other"), F.col("node").alias("b"))
    edges = found.where("class <> other").join(numbers[0], "class").join(numbers[1], "other").select("a", "b")
    edges = edges.unionByName(same.where("vec_id <> node").select(F.col("vec_id").alias("a"), F.col("node").alias("b")))
    named = components(edges).withColumnRenamed("node", "_member")
    linked = same.join(links, "class", "left").select(
        "vec_id", (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    alone = rows.where("vector IS NULL OR vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = linked.unionByName(alone)
    out = out.join(named, out["vec_id"] == named["_member"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
