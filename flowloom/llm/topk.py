"""Exact top-k by inner product, with candidates eliminated by a pivot table.

With every vector scaled to integers, let |x| be lengths and M the largest one. Giving a
candidate x the extra coordinate sqrt(M^2 - |x|^2), and a query 0, makes the squared
distance of the two |q|^2 + M^2 - 2 q.x, so the largest products are the nearest
neighbours in a metric space. Distances to a fixed set of pivots are stored for every
candidate; for a query, the largest difference of its own and a candidate's distances to a
pivot bounds their distance from below. The candidates nearest to one pivot form a cell, whose
least and largest distances bound those of all its members. Cells are evaluated in the order
of that bound, for a block of queries at a time, unless it shows that none of their members
can reach the k-th best product found.

Candidates are dealt into groups of a bounded number of rows, and each group meets the
queries block by block, in one shuffle. A task holds one group and one block. The best k of
each group are ranked once more over all groups.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.texts import arrow_schema

# Candidates of a group, queries of a block, and candidates evaluated at a time.
GROUP = 16_384
BLOCK = 256
STEP = 512
# The pivots are rows of a sample of this many vectors, picked to lie far apart.
PIVOTS = 48
PIVOT_SAMPLE = 2_000


def scaled(vector: str | Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as bigint; null for a vector that takes no part."""
    column = F.col(vector) if isinstance(vector, str) else vector
    values = F.transform(column, lambda x: x.cast("double"))
    bad = F.exists(
        values,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))),
    )
    return F.when(
        column.isNotNull() & ~bad,
        F.transform(values, lambda x: F.floor(x * F.lit(float(scale))).cast("bigint")),
    )


def far_apart(sample, count: int):
    """Rows of a matrix, each the farthest from those picked before; fewer if rows repeat."""
    import numpy as np

    picked = [int(np.argmax((sample**2).sum(axis=1)))] if len(sample) else []
    distance = np.full(len(sample), np.inf)
    while picked and len(picked) < count:
        distance = np.minimum(distance, ((sample - sample[picked[-1]]) ** 2).sum(axis=1))
        if distance.max() <= 0:
            break
        picked.append(int(np.argmax(distance)))
    return sample[picked]


class PivotTable:
    """The candidates of a group in cells around the pivots.

    A cell holds at most `STEP` candidates that are nearest to one pivot and lie about as far
    from it, and keeps the least and the largest of their distances to every pivot.
    """

    def __init__(self, ids, vectors, pivots, longest: int):
        import numpy as np

        self.ids, self.vectors, self.longest = ids, vectors, longest
        squared = (vectors.astype(np.float64) ** 2).sum(axis=1)
        extra = np.sqrt(np.maximum(longest - squared, 0.0))
        self.pivots = pivots.astype(np.float64)
        self.pivot_extra = np.sqrt(np.maximum(longest - (self.pivots**2).sum(axis=1), 0.0))
        distances = self._to_pivots(vectors, squared, extra)
        near = far = np.zeros(len(ids))
        if len(self.pivots):
            near, far = distances.argmin(axis=1), distances.min(axis=1)
        order = np.lexsort((far, near))
        around = np.split(order, np.flatnonzero(np.diff(near[order])) + 1)
        self.cells = [
            cell[start : start + STEP] for cell in around for start in range(0, len(cell), STEP)
        ]
        self.least = [distances[cell].min(axis=0) for cell in self.cells]
        self.most = [distances[cell].max(axis=0) for cell in self.cells]

    def _to_pivots(self, vectors, squared, extra):
        import numpy as np

        of_pivots = (self.pivots**2).sum(axis=1) + self.pivot_extra**2
        products = vectors.astype(np.float64) @ self.pivots.T + np.outer(extra, self.pivot_extra)
        return np.sqrt(np.maximum((squared + extra**2)[:, None] + of_pivots - 2 * products, 0.0))

    def _bounds(self, queries, squared):
        """Largest product that a cell allows each query, a column per cell."""
        import numpy as np

        own = self._to_pivots(queries, squared, np.zeros(len(queries)))
        nearest = np.zeros((len(queries), len(self.cells)))
        for cell in range(len(self.cells) if len(self.pivots) else 0):
            gap = np.maximum(own - self.most[cell], self.least[cell] - own).max(axis=1)
            nearest[:, cell] = np.maximum(gap, 0.0)
        whole = (squared + self.longest)[:, None]
        # The slack covers rounding of square roots.
        return (whole - nearest**2) / 2 + 1e-9 * whole + 1e-3

    def search(self, query_id: int, query, k: int) -> list[tuple[int, int]]:
        """(candidate, product) of the k best of one query, ties to the smaller candidate."""
        import numpy as np

        _, ids, products = self.search_all(np.array([query_id]), query[None, :], k)
        return list(zip(ids.tolist(), products.tolist(), strict=True))

    def search_all(self, query_ids, queries, k: int) -> tuple:
        """(places of queries, candidates, products): the k best of each, ties to the smaller.

        Cells are taken in the order of the most that they allow any query. A query takes part
        while the bound of the cell reaches its k-th best product.
        """
        import numpy as np

        squared = (queries.astype(np.float64) ** 2).sum(axis=1)
        bounds = self._bounds(queries, squared)
        # No sum of products exceeds the product of the lengths, so below 2^53 floats are exact.
        exact = np.sqrt(squared.max(initial=0.0) * self.longest) < 2**52
        kind = np.float64 if exact else np.int64
        asked, lowest = queries.astype(kind), np.iinfo(np.int64).min
        kth = np.full(len(queries), lowest)
        none = np.zeros(0, dtype=np.int64)
        places, ids, products = none, none, none
        for cell in np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable").tolist():
            rows = np.flatnonzero((kth == lowest) | (bounds[:, cell] >= kth))
            if not len(rows):
                continue
            at = self.cells[cell]
            found = (asked[rows] @ self.vectors[at].astype(kind).T).astype(np.int64)
            own = query_ids[rows][:, None] == self.ids[at]
            found[own] = lowest
            reach = kth[rows]
            if len(at) > k:
                reach = np.maximum(reach, np.partition(found, -k, axis=1)[:, -k])
            row, column = np.nonzero((found >= reach[:, None]) & ~own)
            places = np.concatenate([places, rows[row]])
            ids = np.concatenate([ids, self.ids[at[column]]])
            products = np.concatenate([products, found[row, column]])
            order = np.lexsort((ids, -products, places))
            places, ids, products = places[order], ids[order], products[order]
            firsts = np.flatnonzero(np.diff(places, prepend=-1))
            rank = np.arange(len(places)) - np.repeat(firsts, np.diff(firsts, append=len(places)))
            last = rank == k - 1
            kth[places[last]] = products[last]
            kept = rank < k
            places, ids, products = places[kept], ids[kept], products[kept]
        return places, ids, products


def exact_top_k(
    candidates: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest product for each query.

    Scores are inner products of floor(scale * x), as integers; ties go to the smaller
    key, ranks start at 1, and a query with fewer candidates gets all. A candidate with
    the query's own key is left out. Vectors that are null or hold a null or a non-finite
    component take no part, nor do null keys; shorter vectors count as filled up with
    zeros, an empty one as zeros. Repeated candidates count once each, as do repeated
    queries. Components must stay below 2^26 after scaling, so that sums of their
    products are exact.
    """
    spark = candidates.sparkSession
    every = candidates.select(
        F.col(key).cast("bigint").alias("id"), scaled(vector, scale).alias("v")
    ).filter("id IS NOT NULL AND v IS NOT NULL")
    asked = queries.select(
        F.col(key).cast("bigint").alias("id"), scaled(vector, scale).alias("v")
    ).filter("id IS NOT NULL AND v IS NOT NULL")
    norm = F.aggregate("v", F.lit(0.0), lambda total, x: total + x.cast("double") * x)
    size = every.select(
        F.count("*").alias("rows"), F.max(F.size("v")).alias("width"), F.max(norm).alias("longest")
    ).first()
    width = max(size.width or 0, asked.select(F.max(F.size("v"))).first()[0] or 0)
    groups = max(1, -(-size.rows // GROUP))
    # A bounded sample: the same rows whatever the partitions are.
    sample = every.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_SAMPLE).select("v").collect()
    import numpy as np

    matrix = np.zeros((len(sample), width), dtype=np.float64)
    for row, (values,) in zip(matrix, sample, strict=True):
        row[: len(values)] = values
    pivots, longest = far_apart(matrix, PIVOTS), float(size.longest or 0.0)
    schema_ddl = "query_id bigint, vec_id bigint, score bigint"
    schema = arrow_schema(schema_ddl)

    def rows_of(batch) -> tuple:
        """Keys and the matrix of a run of rows."""
        values = batch.column("v")
        lengths = np.diff(values.offsets.to_numpy())
        flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.zeros((len(lengths), width), dtype=np.int64)
        out[np.arange(width) < lengths[:, None]] = flat
        return batch.column("id").to_numpy(), out

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        group, held, indexed = None, [], None

        def answer(queries_batch) -> pa.RecordBatch:
            ids, vectors = rows_of(queries_batch)
            places, found, products = indexed.search_all(ids, vectors, k)
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=pa.int64()) for c in (ids[places], found, products)], schema=schema
            )

        for batch in batches:
            marks = list(zip(*(batch.column(c).to_pylist() for c in ("g", "asks")), strict=True))
            start = 0
            while start < len(marks):
                end = start
                while end < len(marks) and marks[end] == marks[start] and end - start < BLOCK:
                    end += 1
                part, (number, asks) = batch.slice(start, end - start), marks[start]
                start = end
                if number != group:
                    group, held, indexed = number, [], None
                if not asks:
                    held.append(rows_of(part))
                    continue
                if indexed is None:
                    ids = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in held)])
                    empty = np.zeros((0, width), np.int64)
                    vectors = np.concatenate([empty, *(x[1] for x in held)])
                    indexed, held = PivotTable(ids, vectors, pivots, longest), []
                if len(indexed.ids):
                    yield answer(part)

    # Candidates go to one group each, queries to all; in a group the candidates come first.
    dealt = every.select(
        F.pmod(F.xxhash64("id", "v"), F.lit(groups)).alias("g"), F.lit(False).alias("asks"), "id", "v"
    ).unionByName(
        asked.distinct().select(
            F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))).alias("g"),
            F.lit(True).alias("asks"),
            "id",
            "v",
        )
    )
    found = (
        dealt.repartition(groups, "g")
        .sortWithinPartitions("g", "asks")
        .mapInArrow(search, schema_ddl)
    )
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
