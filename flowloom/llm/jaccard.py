"""Exact similarity join of documents on word shingles, by R-trees over count vectors.

1. Equal shingle sets become one node, so copies are compared once.
2. Two sets that are similar enough share one of their rarest shingles: of n shingles, a
   similar set has at least t*n, so one of the first n - t*n + 1 in any common order is
   shared. Nodes that share such a shingle lie in one block; shingles of the same nodes
   are one block. Shingles are ordered by their counts over all documents, in a sketch of
   fixed size, so that passages which many documents share come last.
3. Shingles are hashed into groups, and the counts per group are points. The sum of the
   smaller coordinates of two points bounds the overlap of their sets, and of a point and
   the maxima of a subtree that of all points below it. An R-tree per block finds the
   nodes that the bound allows to be similar; what is so connected is a cluster. A block
   above `BLOCK` nodes is connected as a whole.
4. The sets of a cluster meet in one task, in chunks of a bounded number. Pairs that an
   R-tree of their points leaves are verified on the sets, unless links found before
   connect them already.
5. Of a cluster of several chunks, some common members connect the chunks first. Then all
   members outside its largest component meet every chunk, so that no pair is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowloom.llm.components import connected_components
from flowloom.llm.shingles import Shingler, set_key
from flowloom.llm.texts import arrow_schema
from flowloom.session import shared_dir

# Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 75
# Sketch of shingle counts: 2**BITS counters, in parts of 2**PART_BITS.
BITS, PART_BITS = 18, 15
# Nodes of a block that one R-tree holds.
BLOCK = 8192
# Members of a chunk, and members of a cluster that all its chunks hold.
CHUNK, SHARED = 1024, 32
# Stands for a null id where ids are compared.
LAST = 2**63 - 1
# Entries of a node of the R-tree, and the least and largest number of coordinates of its
# points: about a quarter of the shingles, so that the counts of unlike sets differ.
FAN_OUT = 16
LEAST_GROUPS, MOST_GROUPS = 64, 16384


def least_overlap(size: int, percent: int = PERCENT) -> int:
    """Shingles that a set of `size` shares at least with any similar set."""
    return -(-size * percent // 100)


def similar(one, other, percent: int = PERCENT) -> bool:
    """Whether two sorted arrays of distinct integers are similar enough."""
    import numpy as np

    shared = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * shared >= percent * (len(one) + len(other) - shared)


def groups_for(size: int) -> int:
    """Groups into which the shingles of a set of `size` are hashed: a power of two."""
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << max(size // 4, 1).bit_length()))


def count_vector(shingles, groups: int | None = None):
    """How many shingles of a set each group holds."""
    import numpy as np

    groups = groups or groups_for(len(shingles))
    return np.bincount((shingles >> np.uint64(7)).astype(np.int64) % groups, minlength=groups)


def folded(point, groups: int):
    """A point with fewer groups, as if the shingles had been hashed into those."""
    return point.reshape(-1, groups).sum(axis=0)


class CountTree:
    """R-tree over count vectors of sets, loaded at once.

    Points are sorted by set size and cut into leaves, leaves into nodes, up to one root.
    A node has the largest counts of its points per group and their least and largest size.
    """

    def __init__(self, points, sizes, percent: int = PERCENT):
        import numpy as np

        self.percent, self.points, self.sizes = percent, points.astype(np.int32), sizes
        self.order = np.lexsort((*self.points.T[:2], sizes))
        # Each level: largest counts, least and largest size of every node.
        counts, low, high = self.points[self.order], sizes[self.order], sizes[self.order]
        self.levels = [(counts, low, high)]
        while len(counts) > 1:
            cuts = np.arange(0, len(counts), FAN_OUT)
            counts = np.maximum.reduceat(counts, cuts, axis=0)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((counts, low, high))

    def candidates(self, number: int):
        """Sets that the bound allows to be similar to set `number`, the best bound first."""
        import numpy as np

        point, size, share = self.points[number], int(self.sizes[number]), self.percent
        at = np.zeros(1, dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            counts, low, high = self.levels[depth]
            most = np.minimum(counts[at], point).sum(axis=1)
            # shared >= share / (100 + share) * (sizes), and sizes that are not too far apart
            fits = (
                ((100 + share) * most >= share * (size + low[at]))
                & (100 * high[at] >= share * size)
                & (share * low[at] <= 100 * size)
            )
            at, most = at[fits], most[fits]
            if not depth:
                best = np.argsort(-most, kind="stable")
                return self.order[at[best]]
            children = (at[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            at = children[children < len(self.levels[depth - 1][0])]
        return at


def links(sets: list, labels: list[int], asking: list[bool], percent: int = PERCENT) -> list:
    """Pairs of positions of similar sets, enough to connect what is not connected.

    Sets of equal labels are connected already. Only pairs with a set that asks are
    looked at.
    """
    import numpy as np

    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    groups = groups_for(int(np.median(sizes)))
    tree = CountTree(np.stack([count_vector(s, groups) for s in sets]), sizes, percent)
    label = np.unique(np.array(labels), return_inverse=True)[1]
    found = []
    for i in np.flatnonzero(asking).tolist():
        if (label == label[i]).all():
            break
        others = tree.candidates(i)
        while len(others := others[label[others] != label[i]]):
            j, others = int(others[0]), others[1:]
            if similar(sets[i], sets[j], percent):
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


def near_points(points: list, sizes: list[int], percent: int = PERCENT) -> list:
    """Pairs of positions that connect all sets whose bound allows them to be similar.

    Similar sets have sizes of one power of two or of two that follow each other, so each
    two such classes share a tree, with the groups of the smaller sets in it.
    """
    import numpy as np

    label, found = np.arange(len(sizes)), []
    classes: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        classes.setdefault(size.bit_length(), []).append(i)
    for bits, own in sorted(classes.items()):
        at = np.array(own + classes.get(bits + 1, []))
        if len(at) == 1:
            continue
        groups = min(len(points[i]) for i in own)
        matrix = np.stack([folded(points[i], groups) for i in at])
        tree = CountTree(matrix, np.array([sizes[i] for i in at], dtype=np.int64), percent)
        for number, i in enumerate(at.tolist()):
            others = at[tree.candidates(number)]
            others = others[label[others] != label[i]]
            if len(others):
                joined, first = np.unique(label[others], return_index=True)
                found += [(i, int(others[k])) for k in first]
                label[np.isin(label, joined)] = label[i]
    return found


def shingle_sets(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Documents with the size and key of their sets, and the parts of the count sketch.

    Documents: (doc_id, text_key, n_shingles, node, point), the point as 16-bit counts. Both
    come from one pass over the texts and are stored in the shared folder. A set counts each of its shingles once.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType.simpleString()
    ddl = f"doc_id {id_type}, text_key bigint, n_shingles bigint, node bigint, point binary, part int, counts binary"
    schema = arrow_schema(ddl)

    def measure(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        shingler, sketch = Shingler(), np.zeros(1 << BITS, dtype=np.int32)
        for batch in batches:
            sizes, nodes, points = [], [], []
            for shingles in shingler.sets(batch.column(2).to_pylist()):
                sizes.append(len(shingles))
                # With that many groups a count above 65,535 takes a billion shingles.
                points.append(count_vector(shingles).astype("<u2").tobytes())
                nodes.append(set_key(shingles) if len(shingles) else None)
                np.add.at(sketch, (shingles >> np.uint64(64 - BITS)).astype(np.int64), 1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.int64()),
                    pa.array(points, pa.binary()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                schema=schema,
            )
        parts = sketch.reshape(-1, 1 << PART_BITS)
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, schema.field(0).type),
                *(pa.nulls(n, pa.int64()) for _ in range(3)),
                pa.nulls(n, pa.binary()),
                pa.array(range(n), pa.int32()),
                pa.array([part.tobytes() for part in parts], pa.binary()),
            ],
            schema=schema,
        )

    path = shared_dir(spark, "shingles")
    docs.select(F.col(doc_id), F.xxhash64(text), F.col(text).cast("binary")).mapInArrow(
        measure, ddl
    ).write.parquet(path)
    rows = spark.read.schema(ddl).parquet(path)
    return (
        rows.filter("part IS NULL").drop("part", "counts"),
        rows.filter("part IS NOT NULL").select("part", "counts"),
    )


def sum_sketch(parts: DataFrame):
    """The count sketch of all tasks. Its size is fixed, whatever the documents are."""
    import numpy as np

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True
            ):
                values = np.frombuffer(counts, dtype=np.int32).astype(np.int64)
                sums[part] = sums[part] + values if part in sums else values
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([v.tobytes() for v in sums.values()], pa.binary()),
            ],
            names=["part", "counts"],
        )

    total = np.zeros(1 << BITS, dtype=np.int64)
    summed = parts.repartition(1 << (BITS - PART_BITS), "part").mapInArrow(
        add, "part int, counts binary"
    )
    for part, counts in summed.collect():
        total[part << PART_BITS : (part + 1) << PART_BITS] = np.frombuffer(counts, np.int64)
    return total


def block_members(docs: DataFrame, sketch, text: str, percent: int) -> DataFrame:
    """(block, node, members, least): nodes that share one of their rarest shingles.

    Shingles of the same nodes give one block. `members` is the number of its nodes and
    `least` the smallest of them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def prefixes(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        counts, shingler = shared.value, Shingler()
        seen: set[int] = set()
        for batch in batches:
            tokens, nodes = [], []
            for shingles in shingler.sets(batch.column(0).to_pylist()):
                if not len(shingles):
                    continue
                node = set_key(shingles)
                if node in seen:
                    continue
                seen.add(node)
                found = counts[(shingles >> np.uint64(64 - BITS)).astype(np.int64)]
                low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.int64)
                size = len(shingles) - least_overlap(len(shingles), percent) + 1
                # A total order of shingles: their count, their low half, themselves.
                at = np.argsort((found << 32) | low, kind="stable")[:size]
                tokens.append(shingles[at].view(np.int64))
                nodes.append(np.full(size, node, dtype=np.int64))
            if nodes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))],
                    names=["token", "node"],
                )

    postings = docs.select(F.col(text).cast("binary")).mapInArrow(
        prefixes, "token bigint, node bigint"
    )
    # A node comes once from each task that has its set: the same set of nodes, counted by
    # their distinct sum, may have two names, which costs a second look and no link.
    same = W.partitionBy("token")
    named = F.sum(F.xxhash64("node") % 2**40).over(same)
    return (
        postings.select(
            "node",
            F.xxhash64(F.min("node").over(same), F.max("node").over(same), named).alias("block"),
            F.min("node").over(same).alias("least"),
            F.max("node").over(same).alias("greatest"),
        )
        .filter("least <> greatest")
        .select("block", "node", "least")
        .distinct()
    )


def block_edges(docs: DataFrame, sets: DataFrame, sketch, text: str, percent: int) -> DataFrame:
    """(node, other): pairs that connect all nodes which may be similar.

    In a block of up to `BLOCK` nodes the R-tree of their points tells which. Larger ones
    are stars.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "blocks")
    block_members(docs, sketch, text, percent).write.parquet(path)
    members = spark.read.schema("block bigint, node bigint, least bigint").parquet(path)
    sizes = members.groupBy("block").agg(F.count("*").alias("members"))
    placed = members.join(sizes, "block")
    points = (
        sets.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("n_shingles").alias("n"), F.min("point").alias("point"))
    )

    def connect(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out(nodes: list, sizes: list, rows: list) -> Iterator:
            if len(nodes) > 1:
                points = [np.frombuffer(row, dtype="<u2").astype(np.int32) for row in rows]
                pairs = near_points(points, sizes, percent)
                if pairs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([nodes[p[i]] for p in pairs], pa.int64()) for i in (0, 1)],
                        names=["node", "other"],
                    )

        block, nodes, sizes, rows = None, [], [], []
        for batch in batches:
            for key, node, size, point in zip(
                *(batch.column(i).to_pylist() for i in range(4)), strict=True
            ):
                if key != block:
                    yield from out(nodes, sizes, rows)
                    block, nodes, sizes, rows = key, [], [], []
                nodes.append(node)
                sizes.append(size)
                rows.append(point)
        yield from out(nodes, sizes, rows)

    near = (
        placed.filter(F.col("members") <= BLOCK)
        .join(points, "node")
        .select("block", "node", "n", "point")
        .repartition("block")
        .sortWithinPartitions("block", "node")
        .mapInArrow(connect, "node bigint, other bigint")
    )
    stars = placed.filter(F.col("members") > BLOCK).select("node", F.col("least").alias("other"))
    return near.unionByName(stars)


def verified_links(rows: DataFrame, percent: int) -> DataFrame:
    """(node, other): links within each group of (g, node, label, asks, text) rows.

    Rows of a group lie together; a group holds a bounded number of them.
    """

    def verify(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shingler = Shingler()

        def out(members: dict) -> Iterator:
            if len(members) > 1:
                nodes = list(members)
                sets, labels, asking = map(list, zip(*members.values(), strict=True))
                pairs = links(sets, labels, asking, percent)
                if pairs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([nodes[p[i]] for p in pairs], pa.int64()) for i in (0, 1)],
                        names=["node", "other"],
                    )

        group, members = None, {}
        for batch in batches:
            names = ("g", "node", "label", "asks")
            sets = shingler.sets(batch.column("text").to_pylist())
            for key, node, label, asks, shingles in zip(
                *(batch.column(name).to_pylist() for name in names), sets, strict=True
            ):
                if key != group:
                    yield from out(members)
                    group, members = key, {}
                members[node] = (shingles, label, asks or (node in members and members[node][2]))
        yield from out(members)

    return (
        rows.repartition("g")
        .sortWithinPartitions("g", "node")
        .select("g", "node", "label", "asks", "text")
        .mapInArrow(verify, "node bigint, other bigint")
    )


def similarity_components(
    docs: DataFrame, *, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key, component) of every document.

    `component_id` is the smallest id that links reach. `text_key` (xxhash64 of the text)
    tells rows of one id apart, and `component` names the component whatever ids it has;
    it is null without shingles.

    Two documents link when 100 * shared >= percent * union of their distinct five-word
    shingles. All links count, none is sampled or capped. Null texts and texts without
    words have no shingles, link with nothing and have their own id as component. Documents
    with null ids link like others and take the smallest id of their component, null if it
    has none. Repeated rows give repeated results.
    """
    spark = docs.sparkSession
    sets, parts = shingle_sets(docs, doc_id, text)
    edges = block_edges(docs, sets, sum_sketch(parts), text, percent)
    clusters = connected_components(edges).withColumnRenamed("component", "cluster")
    # Both ends of every edge: the smallest node of a cluster has no row of its own.
    clusters = clusters.unionByName(
        clusters.select(F.col("cluster").alias("node"), "cluster").distinct()
    )
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    members = clusters.join(sizes, "cluster").select("node", "cluster", chunks.alias("chunks"))

    # The members of least hash of a large cluster are in all its chunks.
    order = W.partitionBy("cluster").orderBy(F.xxhash64("node", F.lit(1)), "node")
    common = (
        members.filter("chunks > 1")
        .withColumn("r", F.row_number().over(order))
        .filter(F.col("r") <= SHARED)
        .select("node", F.lit(True).alias("everywhere"))
    )
    # One document stands for a node.
    named_by = F.struct(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("i"), "text_key")
    chosen = (
        sets.filter("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min(named_by).alias("d"))
        .join(members, "node")
        .join(common, "node", "left")
        .select("node", "cluster", "chunks", "everywhere", "d.i", F.col("d.text_key").alias("k"))
    )
    path = shared_dir(spark, "clusters")
    chosen.write.parquet(f"{path}/members")
    chosen = spark.read.schema(
        "node bigint, cluster bigint, chunks int, everywhere boolean, i bigint, k bigint"
    ).parquet(f"{path}/members")
    # Texts meet the members once and are kept; all other joins are on keys alone.
    texts = docs.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(LAST)).alias("i"),
        F.xxhash64(text).alias("k"),
        F.col(text).cast("binary").alias("text"),
    )
    # Members grow with the documents: shuffled at every size, never broadcast.
    texts.join(chosen.hint("merge"), ["i", "k"]).drop("i", "k").write.parquet(f"{path}/texts")
    held = spark.read.schema(
        "text binary, node bigint, cluster bigint, chunks int, everywhere boolean"
    ).parquet(f"{path}/texts")

    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    in_all = F.sequence(F.lit(0), F.col("chunks") - 1)
    places = F.when(F.col("everywhere"), in_all).otherwise(F.array(chunk))
    first = verified_links(
        held.select("node", "cluster", "text", F.explode(places).alias("c")).select(
            F.struct("cluster", F.lit(0).alias("r"), "c").alias("g"),
            "node",
            F.col("node").alias("label"),
            F.lit(True).alias("asks"),
            "text",
        ),
        percent,
    )
    first.write.parquet(f"{path}/links")
    found = spark.read.schema("node bigint, other bigint").parquet(f"{path}/links")
    several = chosen.filter("chunks > 1").select("node", "cluster", "chunks")
    if not several.isEmpty():
        places = unmet_places(several, connected_components(found))
        places.write.parquet(f"{path}/places")
        places = spark.read.schema(places.schema).parquet(f"{path}/places")
        if not places.isEmpty():
            rest = held.filter("chunks > 1").select("node", "text").join(places, "node")
            verified_links(rest, percent).write.parquet(f"{path}/more")
            found = found.unionByName(
                spark.read.schema("node bigint, other bigint").parquet(f"{path}/more")
            )
    labels = connected_components(found)
    placed = sets.join(labels, "node", "left").select(
        "doc_id", "n_shingles", "text_key", F.coalesce("component", "node").alias("component")
    )
    smallest = (
        placed.filter("component IS NOT NULL")
        .groupBy("component")
        .agg(F.min("doc_id").alias("component_id"))
    )
    return placed.join(smallest, "component", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component_id", "doc_id").alias("component_id"),
        "text_key",
        "component",
    )


def unmet_places(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, g, label, asks): the groups in which clusters of several chunks meet again.

    Pairs within the largest component of a cluster are connected. All other members ask,
    in chunks of their own, and each of these meets every chunk of the cluster. Clusters
    that are one component have no rows.
    """
    rows = members.join(labels, "node", "left").select(
        "node", "cluster", "chunks", F.coalesce("component", "node").alias("label")
    )
    counted = rows.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = counted.groupBy("cluster").agg(
        F.max_by("label", F.struct("n", "label")).alias("largest"),
        (F.sum("n") - F.max("n")).alias("outside"),
    )
    rows = (
        rows.join(largest.filter("outside > 0"), "cluster")
        .withColumn("asks", F.col("label") != F.col("largest"))
        .withColumn("rounds", F.ceil(F.col("outside") / CHUNK).cast("int"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    asking = F.pmod(F.xxhash64("node", F.lit(2)), F.col("rounds")).cast("int")
    every_round = F.sequence(F.lit(0), F.col("rounds") - 1)
    every_chunk = F.sequence(F.lit(0), F.col("chunks") - 1)
    answer = rows.select(
        "cluster", "node", "label", F.lit(False).alias("asks"), own.alias("c"),
        F.explode(every_round).alias("r"),
    )
    ask = rows.filter("asks").select(
        "cluster", "node", "label", "asks", F.explode(every_chunk).alias("c"), asking.alias("r")
    )
    return answer.unionByName(ask).select(
        "node", F.struct("cluster", (F.col("r") + 1).alias("r"), "c").alias("g"), "label", "asks"
    )
