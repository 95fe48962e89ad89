"""Codes for vectors: integer product quantisation with LAESA pivots.

Vectors are scaled to integers and cut into equal parts; each part position has a codebook
that rounds of assignment and averaging improve. The distances of every part to a few fixed
pivots are computed once and stored with the parts. In each round only the entries meet the
pivots anew: the largest difference of a part's and an entry's distance to a pivot bounds
their distance from below, entries are evaluated exactly in the order of that bound, and a
part is done when the next bound exceeds the best distance found.

Nothing but codebooks and sums per entry reaches the driver: `entries` times the width of a
vector, whatever the number of vectors. Each round is one pass over the stored parts.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.texts import arrow_schema
from flowloom.session import shared_dir

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Pivots of each part position, chosen among its first entries to lie far apart.
PIVOTS = 16
# Scaled components beyond +-LIMIT are held at it, so that squared distances fit 64 bits.
LIMIT = 2**24
# Parts worked on at a time.
BLOCK = 2048


def whole_vectors(
    vectors: DataFrame, key: str, vector: str, scale: int, keep: list[str]
) -> DataFrame:
    """`id`, `v` (floor(scale * x) of each component) and `kept` of vectors that take part."""
    values = F.transform(F.col(vector), lambda x: x.cast("double"))
    good = ~F.exists(values, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    held = F.transform(
        values,
        lambda x: F.floor(
            F.least(F.greatest(x * F.lit(float(scale)), F.lit(float(-LIMIT))), F.lit(float(LIMIT)))
        ).cast("int"),
    )
    return vectors.filter(F.col(vector).isNotNull() & good).select(
        F.col(key).cast("bigint").alias("id"),
        held.alias("v"),
        F.struct(*keep, F.lit(True).alias("always")).alias("kept"),
    )


def spread_out(entries, count: int):
    """Rows of a matrix, each the farthest from those before; fewer if rows repeat."""
    import numpy as np

    picked, distance = [], np.full(len(entries), np.inf)
    while len(picked) < min(count, len(entries)) and distance.max() > 0:
        picked.append(int(np.argmax(distance)))
        distance = np.minimum(distance, ((entries - entries[picked[-1]]) ** 2).sum(axis=1))
    return entries[picked]


def pivot_distances(rows, pivots):
    """Euclidean distances of each row to each pivot, as 32-bit floats."""
    import numpy as np

    squared = ((rows[:, None, :].astype(np.int64) - pivots[None]) ** 2).sum(axis=2)
    return np.sqrt(squared.astype(np.float64)).astype(np.float32)


def nearest_entries(rows, distances, entries, pivots):
    """(entry, squared distance, evaluations): the nearest entry of each row, ties to the first.

    `distances` are those of the rows to the pivots. Each row meets its entry of lowest
    bound first; then the entries are taken in the order of their mean bound over all rows,
    each for the rows whose best distance does not rule it out. Bounds are lowered by more
    than the rounding of 32-bit floats, so that they never rule out a nearest entry.
    """
    import numpy as np

    to_pivots = pivot_distances(entries, pivots)
    count, known = len(rows), len(entries)
    bound = np.zeros((count, known), dtype=np.float32)
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(distances[:, p, None] - to_pivots[:, p]), out=bound)
    # A 32-bit float is off by less than one part in 2^23.
    largest = distances.max(axis=1, initial=0) + to_pivots.max(initial=0)
    bound -= np.float32(2.0**-21) * largest[:, None].astype(np.float32)
    np.maximum(bound, 0, out=bound)
    # Integers below 2^53 are exact as 64-bit floats, whose products are faster.
    reach = max((int(np.abs(x).max(initial=0)) for x in (rows, entries)), default=0)
    kind = np.float64 if rows.shape[1] * (2 * reach) ** 2 < 2**53 else np.int64
    x, e = rows.astype(kind), entries.astype(kind)
    of_rows, of_entries = (x * x).sum(axis=1), (e * e).sum(axis=1)

    chosen = bound.argmin(axis=1)
    best = of_rows + of_entries[chosen] - 2 * np.einsum("rd,rd->r", x, e[chosen])
    bound[np.arange(count), chosen] = np.inf
    evaluated = count
    # Rounded up, so that equal distances stay in.
    reach_of = np.nextafter(np.sqrt(best.astype(np.float64)).astype(np.float32), np.float32(np.inf))
    by_entry = np.ascontiguousarray(bound.T)
    for entry in np.argsort(by_entry.mean(axis=1), kind="stable").tolist():
        near = np.flatnonzero(by_entry[entry] <= reach_of)
        if not len(near):
            continue
        evaluated += len(near)
        found = of_rows[near] + of_entries[entry] - 2 * (x.take(near, axis=0) @ e[entry])
        old = best[near]
        better = (found < old) | ((found == old) & (entry < chosen[near]))
        near, found = near[better], found[better]
        best[near], chosen[near] = found, entry
        reach_of[near] = np.nextafter(
            np.sqrt(found.astype(np.float64)).astype(np.float32), np.float32(np.inf)
        )
    return chosen, best.astype(np.int64), evaluated


def codebook_digest(codebooks) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    import hashlib

    numbers = [str(int(x)) for book in codebooks for entry in book for x in entry]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress_vectors(
    vectors: DataFrame,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    pivots: int = PIVOTS,
    keep: list[str] | None = None,
) -> tuple[DataFrame, list]:
    """Codes of all vectors that take part, and the codebooks.

    The table has `id` (the key), `codes` (an entry number from 0 per part), `error` (the
    squared distances summed over the parts) and `kept`, a struct of the columns `keep`. The codebooks are `parts` integer matrices of
    at most `entries` rows. A codebook starts as the parts of the vectors of the smallest
    keys, ascending; each of `rounds` rounds assigns every part to its nearest entry (ties to
    the smaller number) and moves every entry to the floor of the mean of its parts; entries
    without parts stay.

    Vectors that are null or hold a null or a non-finite component are left out. Shorter
    vectors count as filled up with zeros to the longest, and that to a multiple of `parts`.
    Scaled components are held within +-2^24. Null keys come last, equal keys follow each
    other by their vectors, and repeated rows count each. Fewer vectors than `entries` give
    as many entries. An empty table gives no rows and empty codebooks.
    """
    import numpy as np

    spark = vectors.sparkSession
    folder = shared_dir(spark, "vector-codes")
    kept = whole_vectors(vectors, key, vector, scale, list(keep or []))
    ranked = kept.select("id", "v").orderBy(F.col("id").asc_nulls_last(), "v")
    first = ranked.limit(entries).collect()
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    size = -(-longest // parts)
    start = np.zeros((len(first), size * parts), dtype=np.int64)
    for row, (_, values) in zip(start, first, strict=True):
        row[: len(values)] = values
    books = [start[:, i * size : (i + 1) * size] for i in range(parts)]
    fixed = [spread_out(book, pivots) for book in books]

    kept_ddl = kept.schema["kept"].dataType.simpleString()
    stored_ddl = f"id bigint, v array<int>, distances array<float>, kept {kept_ddl}"
    stored_schema = arrow_schema(stored_ddl)

    def part(rows, i: int):
        return rows[:, i * size : (i + 1) * size]

    def matrix(values):
        """Integer vectors of an Arrow list column, filled up with zeros."""
        lengths = np.diff(values.offsets.to_numpy())
        out = np.zeros((len(lengths), size * parts), dtype=np.int64)
        out[np.arange(size * parts) < lengths[:, None]] = values.flatten().to_numpy()
        return out

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def lists(x, name: str):
            offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            return pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(x.ravel()), type=stored_schema.field(name).type
            )

        for batch in batches:
            rows = matrix(batch.column("v"))
            far = [pivot_distances(part(rows, i), fixed[i]) for i in range(parts)]
            columns = [
                batch.column("id"),
                lists(rows.astype(np.int32), "v"),
                lists(np.concatenate(far, axis=1), "distances"),
                batch.column("kept").cast(stored_schema.field("kept").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=stored_schema)

    kept.mapInArrow(measure, stored_ddl).write.parquet(f"{folder}/parts")
    stored = spark.read.parquet(f"{folder}/parts")
    bounds = np.cumsum([0, *(len(x) for x in fixed)])

    def assigned(block, now: list) -> tuple:
        """Vectors of a block with the nearest entry and its squared distance for each part."""
        rows = matrix(block.column("v"))
        far = block.column("distances").flatten().to_numpy().reshape(len(rows), -1)
        found = [
            nearest_entries(part(rows, i), far[:, bounds[i] : bounds[i + 1]], now[i], fixed[i])
            for i in range(parts)
        ]
        chosen, squared = (np.stack([f[k] for f in found], axis=1) for k in (0, 1))
        return rows, chosen, squared

    def blocks(batches: Iterator) -> Iterator:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                yield batch.slice(at, BLOCK)

    sums_ddl = "part int, entry int, rows bigint, sums array<bigint>"
    sums_schema = arrow_schema(sums_ddl)

    def improved(now: list) -> list:
        """Codebooks after a round: sums are combined per task, then per entry."""

        def add(batches: Iterator) -> Iterator:
            import pyarrow as pa

            count = np.zeros((parts, len(first)), dtype=np.int64)
            total = np.zeros((parts, len(first), size), dtype=np.int64)
            for block in blocks(batches):
                rows, chosen, _ = assigned(block, now)
                for i in range(parts):
                    order = np.argsort(chosen[:, i], kind="stable")
                    used, starts = np.unique(chosen[order, i], return_index=True)
                    total[i, used] += np.add.reduceat(part(rows, i)[order], starts, axis=0)
                    count[i] += np.bincount(chosen[:, i], minlength=len(first))
            at = list(zip(*np.nonzero(count), strict=True))
            if at:
                columns = (
                    [i for i, _ in at],
                    [e for _, e in at],
                    [count[x] for x in at],
                    [total[x].tolist() for x in at],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, sums_schema, strict=True)],
                    schema=sums_schema,
                )

        sums = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(size)]
        moved = [book.copy() for book in now]
        found = stored.select("v", "distances").mapInArrow(add, sums_ddl)
        for row in found.groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *sums).collect():
            moved[row.part][row.entry] = np.array(row[3:], dtype=np.int64) // row.rows
        return moved

    if len(first):
        for _ in range(rounds):
            books = improved(books)
    codes_ddl = f"id bigint, codes array<int>, error bigint, kept {kept_ddl}"
    codes_schema = arrow_schema(codes_ddl)

    def encode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for block in blocks(batches):
            _, chosen, squared = assigned(block, books)
            columns = [
                block.column("id"),
                pa.array(chosen.tolist(), codes_schema.field("codes").type),
                pa.array(squared.sum(axis=1), pa.int64()),
                block.column("kept").cast(codes_schema.field("kept").type),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=codes_schema)

    return stored.mapInArrow(encode, codes_ddl), books
