"""Packing documents into as few sequences as possible: a grouping genetic algorithm.

Documents are tokenized and closed with an end token; only those longer than a sequence are
cut, into full pieces behind a first one that may be shorter. Tokens are written once to the
shared folder. From then on only lengths move: pieces that do not fill a sequence are dealt
at random into groups of about `group`, and each group is packed by several islands.

An island is a row of Spark's tables: a population of plans, each the sequence of every
piece. In an epoch it breeds plans: whole sequences of one parent, mostly well filled ones,
are injected into another; sequences that now repeat a piece are dissolved, and their other
pieces go, longest first, where the least room takes them. Between epochs the best plan of
an island moves to the next one, through a join. A group whose best plan meets the lower
bound of its lengths is finished. Tables between epochs lie in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.packing import added_tokens, library_encoder
from flowloom.llm.texts import arrow_schema, strings
from flowloom.session import shared_dir

WINDOW = 1024
END_ID = 2
# Pieces of a group, islands and plans of an island, epochs and children per epoch.
GROUP = 8192
ISLANDS = 4
PLANS = 6
EPOCHS = 3
CHILDREN = 8
SEED = 20_250_117
# Islands that one task works on.
PER_TASK = 4


def best_fit(sizes, order, rooms, window: int):
    """Bins of the pieces in `order`: each goes where the least room takes it.

    `rooms` are the rooms of the bins there are; new bins follow them. A bit per capacity
    says whether a bin with that room is open. Returns the bins and how many there are now.
    """
    at: dict[int, list[int]] = {}
    opened = len(rooms)
    for number, room in enumerate(rooms):
        at.setdefault(int(room), []).append(number)
    mask = sum(1 << room for room in at)
    out = []
    for i in order:
        size = sizes[i]
        fitting = mask >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            open_bins = at[room]
            number = open_bins.pop()
            if not open_bins:
                mask ^= 1 << room
        else:
            room, number, opened = window, opened, opened + 1
        left = room - size
        there = at.setdefault(left, [])
        if not there:
            mask |= 1 << left
        there.append(number)
        out.append(number)
    return out, opened


def lower_bound(sizes, window: int) -> int:
    """Sequences that pieces of these sizes need at least, whatever the plan.

    For every limit k, pieces above window - k stand alone, those above half the window need
    one sequence each, and what of the pieces from k to half the window does not fit beside
    the latter needs more.
    """
    import numpy as np

    count = np.bincount(sizes, minlength=window + 1).astype(np.int64)
    total = np.cumsum(count * np.arange(window + 1))
    number = np.cumsum(count)
    half = window // 2
    k = np.arange(half + 1)
    beside = number[window - k] - number[half]
    room = beside * window - (total[window - k] - total[half])
    small = total[half] - np.where(k > 0, total[np.maximum(k - 1, 0)], 0)
    more = np.maximum(0, -(-(small - room) // window))
    return int((number[window] - number[half] + more).max())


def fills(plan, sizes):
    """Tokens in each sequence of a plan."""
    import numpy as np

    return np.bincount(plan, weights=sizes).astype(np.int64)


def fitness(plan, sizes) -> tuple[int, int]:
    """Fewer sequences first, then fuller ones: plans that leave their room together."""
    filled = fills(plan, sizes)
    return len(filled), -int((filled**2).sum())


def refit(plan, loose, sizes, window: int, order=None):
    """A plan with its `loose` pieces placed anew, longest first unless `order` says else."""
    import numpy as np

    out = np.full(len(plan), -1, dtype=np.int64)
    kept, out[~loose] = np.unique(plan[~loose], return_inverse=True)
    rooms = window - np.bincount(out[~loose], weights=sizes[~loose], minlength=len(kept))
    order = np.flatnonzero(loose) if order is None else order
    placed, _ = best_fit(sizes.tolist(), order.tolist(), rooms.astype(int).tolist(), window)
    out[order] = placed
    return out


def crossover(one, other, sizes, window: int, random):
    """`one` with whole sequences of `other` in the place of those that share their pieces."""
    import numpy as np

    filled = fills(other, sizes)
    count = 1 + int(random.integers(max(1, len(filled) // 4)))
    # Drawn without putting back, with chances that rise steeply with the fill.
    keys = 16 * np.log(filled / window) + random.gumbel(size=len(filled))
    chosen = np.zeros(len(filled), dtype=bool)
    chosen[np.argpartition(-keys, count - 1)[:count]] = True
    injected = chosen[other]
    hit = np.zeros(one.max() + 1, dtype=bool)
    hit[one[injected]] = True
    child = np.where(injected, one.max() + 1 + other, one)
    return refit(child, hit[one] & ~injected, sizes, window)


def mutation(plan, sizes, window: int, random):
    """A plan with its emptiest sequence and some others dissolved, in random order."""
    import numpy as np

    filled = fills(plan, sizes)
    out = random.random(len(filled)) < 0.02
    out[filled.argmin()] = True
    loose = out[plan]
    return refit(plan, loose, sizes, window, random.permutation(np.flatnonzero(loose)))


def evolve(sizes, plans: list, window: int, children: int, count: int, random) -> list:
    """The best `count` plans after breeding, best first; sizes fall.

    Without plans it starts from best-fit decreasing and from best fits in about that order.
    """
    import numpy as np

    bound = lower_bound(sizes, window)
    if not plans:
        everything = np.ones(len(sizes), dtype=bool)
        start = np.zeros(len(sizes), dtype=np.int64)
        plans = [refit(start, everything, sizes, window)]
        while len(plans) < count and plans[0].max() + 1 > bound:
            rough = np.argsort(-sizes * random.uniform(0.8, 1.0, len(sizes)), kind="stable")
            plans.append(refit(start, everything, sizes, window, rough))
    ranked = sorted(((fitness(p, sizes), i, p) for i, p in enumerate(plans)), key=lambda x: x[:2])
    serial = len(ranked)
    for _ in range(children):
        if ranked[0][0][0] <= bound:
            break
        # The better of two draws each.
        one, other = (min(random.integers(len(ranked), size=2)) for _ in range(2))
        child = crossover(ranked[one][2], ranked[other][2], sizes, window, random)
        if random.random() < 0.5:
            child = mutation(child, sizes, window, random)
        ranked.append((fitness(child, sizes), serial, child))
        serial += 1
        ranked.sort(key=lambda x: x[:2])
        del ranked[count:]
    return [plan for _, _, plan in ranked[:count]]


def tokenized_pieces(
    docs: DataFrame, tokenizer_path: str, pattern: str, window: int, end_id: int, doc_id: str, text: str
) -> DataFrame:
    """(item, doc_id, piece, start, length, doc_tokens, ids, ids_crc32) of all documents."""
    with open(tokenizer_path, encoding="utf-8") as source:
        definition = docs.sparkSession.sparkContext.broadcast(source.read())
    ddl = (
        f"item bigint, doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, "
        "start bigint, length bigint, doc_tokens bigint, ids binary, ids_crc32 bigint"
    )
    schema = arrow_schema(ddl)

    def cut(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = library_encoder(definition.value, pattern, added_tokens(definition.value))
        end = np.array([end_id], dtype="<u4").tobytes()
        item = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
            )

        for batch in batches:
            texts = strings(batch.column(1))
            for document, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                tokens = len(ids) // 4
                start, piece = 0, 0
                while start < tokens:
                    length = (tokens - start) % window or min(window, tokens - start)
                    part = ids[4 * start : 4 * (start + length)]
                    rows.append(
                        (item, document, piece, start, length, tokens, part, zlib.crc32(part))
                    )
                    start, piece, item = start + length, piece + 1, item + 1
                    if len(rows) >= 1024:
                        yield out()
        if rows:
            yield out()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, ddl)


def pack_genetic(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    *,
    window: int = WINDOW,
    end_id: int = END_ID,
    group: int = GROUP,
    islands: int = ISLANDS,
    plans: int = PLANS,
    epochs: int = EPOCHS,
    children: int = CHILDREN,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents with their place in sequences of at most `window` tokens.

    One row per piece: `doc_id`, `piece` (from 0), `start` (tokens of the document before
    it), `length`, `doc_tokens` (with the end token), `sequence_id`, `offset` in the
    sequence, `ids` (the tokens as little-endian unsigned 32-bit integers) and their
    `ids_crc32`. Documents of up to `window` tokens are one piece. Offsets leave no gaps.

    A null text is an empty one, which gives its end token alone. A null `doc_id` is kept,
    and repeated rows are packed as often as they occur. An empty table gives no rows.
    Sequence numbers are unique, not consecutive. `group` is at most 60,000.
    """
    if group > 60_000:
        raise ValueError("a group has at most 60000 pieces")
    spark = docs.sparkSession
    folder = shared_dir(spark, "genetic-packing")
    tokenized_pieces(docs, tokenizer_path, pattern, window, end_id, doc_id, text).write.parquet(
        f"{folder}/pieces"
    )
    pieces = spark.read.parquet(f"{folder}/pieces")
    parts = pieces.filter(F.col("length") < window)
    # Groups of even size by a hash of the row number, whatever documents hold.
    groups = max(1, -(-parts.count() // group))
    (
        parts.select(
            F.pmod(F.xxhash64("item"), F.lit(groups)).alias("group"), "length", "item"
        )
        .groupBy("group")
        .agg(F.sort_array(F.collect_list(F.struct("length", "item")), asc=False).alias("parts"))
        .select(
            "group",
            F.col("parts.length").cast("array<int>").alias("sizes"),
            F.col("parts.item").alias("items"),
        )
        .write.parquet(f"{folder}/groups")
    )
    grouped = spark.read.parquet(f"{folder}/groups")
    tasks = max(1, -(-groups * islands // PER_TASK))
    state_ddl = "group bigint, island int, bins int, plans array<binary>"
    state_schema = arrow_schema(state_ddl)

    def breeding(epoch: int):
        def breed(batches: Iterator) -> Iterator:
            import numpy as np
            import pyarrow as pa

            for batch in batches:
                for row in range(batch.num_rows):
                    number, island, sizes, before = (
                        batch.column(c)[row].as_py() for c in ("group", "island", "sizes", "plans")
                    )
                    sizes = np.array(sizes, dtype=np.int64)
                    known = [np.frombuffer(p, "<u2").astype(np.int64) for p in before]
                    random = np.random.default_rng((seed, number, island, epoch))
                    found = evolve(sizes, known, window, children, plans, random)
                    columns = (
                        [number],
                        [island],
                        [int(found[0].max()) + 1],
                        [[p.astype("<u2").tobytes() for p in found]],
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(columns, state_schema, strict=True)],
                        schema=state_schema,
                    )

        return breed

    state = grouped.select(
        "group",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.array().cast("array<binary>").alias("plans"),
    )
    for epoch in range(epochs):
        if epoch:
            elites = state.select(
                "group",
                ((F.col("island") + 1) % islands).alias("island"),
                F.slice("plans", 1, 1).alias("elite"),
            )
            state = state.join(elites, ["group", "island"]).select(
                "group", "island", F.concat("plans", "elite").alias("plans")
            )
        (
            state.join(grouped.select("group", "sizes"), "group")
            .repartition(tasks, "group", "island")
            .select("group", "island", "sizes", "plans")
            .mapInArrow(breeding(epoch), state_ddl)
            .write.parquet(f"{folder}/epoch-{epoch}")
        )
        state = spark.read.parquet(f"{folder}/epoch-{epoch}")

    best = state.groupBy("group").agg(
        F.min_by(F.col("plans")[0], F.struct("bins", "island")).alias("plan")
    )
    placed_ddl = "item bigint, sequence_id bigint, offset bigint"
    placed_schema = arrow_schema(placed_ddl)

    def place(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                number, sizes, items, plan = (
                    batch.column(c)[row].as_py() for c in ("group", "sizes", "items", "plan")
                )
                plan = np.frombuffer(plan, "<u2").astype(np.int64)
                order = np.argsort(plan, kind="stable")
                held = np.array(sizes, dtype=np.int64)[order]
                before = np.cumsum(held) - held
                first = np.concatenate([[True], np.diff(plan[order]) > 0])
                offsets = before - before[first][np.cumsum(first) - 1]
                columns = (np.array(items)[order], (number << 20) + plan[order], offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in columns], schema=placed_schema
                )

    places = (
        grouped.join(best, "group")
        .select("group", "sizes", "items", "plan")
        .mapInArrow(place, placed_ddl)
    )
    names = ["doc_id", "piece", "start", "length", "doc_tokens"]
    whole = pieces.filter(F.col("length") == window).select(
        *names,
        (-1 - F.col("item")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        "ids",
        "ids_crc32",
    )
    return (
        parts.join(places, "item")
        .select(*names, "sequence_id", "offset", "ids", "ids_crc32")
        .unionByName(whole)
    )
