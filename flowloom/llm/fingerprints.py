"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words in lower case, each weighted by the characters it covers
in all (occurrences times length). A term of weight w has the units 0 to w - 1. Darts hit
every unit in a Poisson process of rate one, fixed by the term and the number of the unit,
and each dart hits one of the samples at random. The earliest dart on any unit of a text is
the draw of a sample. Its (term, unit) is uniform over the weight of the text, and stays the
draw of any text of smaller weights that still has that unit. So two texts draw the same
with the probability of their generalised Jaccard similarity, the sum of the smaller over
that of the larger weights.

No more darts are thrown than it takes to hit every sample: up to a time that follows from
the weight of the text, later if a sample is left over. That is a number of darts that follows
from the samples alone, and one random number for each character, instead of the numbers of
all terms for all samples.

A fingerprint keeps 16 bits of each draw, so unlike draws agree once in 65,536.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.texts import arrow_schema, strings

SAMPLES = 128
SEED = 20_240_131
# Darts thrown for each sample at first; a text misses any of 128 samples once in 23.
DARTS = 8
# Units worked on at a time.
UNITS = 1 << 15
# Documents of a run, as long as no more runs than the second number are needed.
RUN = 4096
MOST_RUNS = 100_000
# Code points of a text that are split into words at a time.
PIECE = 1 << 20


Term = str | tuple[str, int]


def word_counts(text: str) -> Counter[str]:
    """How often each lower-case word of a text occurs, cut at white space."""
    if len(text) <= PIECE:
        return Counter(text.lower().split())
    counts: Counter[str] = Counter()
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        counts.update(text[start:end].lower().split())
        start = end
    return counts


def weighted_words(text: str) -> list[Term]:
    """The lower-case words of a text, cut at white space, each with how often it occurs.

    A word that occurs once stands for itself. The weight of a word is its occurrences
    times its length.
    """
    return [word if n == 1 else (word, n) for word, n in word_counts(text).items()]


class WeightedSampler:
    """Signatures of weighted terms: one 16-bit draw per sample.

    Nothing is kept from one text for the next, so `remembered` has no effect any more; it
    is still taken from callers that bound what a sampler may remember.
    """

    # An odd number without pattern (the golden ratio), and a sample that no dart has hit.
    STEP = 0x9E3779B97F4A7C15
    MISSED = 2**64 - 1

    def __init__(self, samples: int = SAMPLES, seed: int = SEED, remembered: int | None = None):
        import numpy as np

        self.samples, self.seed = samples, seed
        self.steps = np.arange(UNITS, dtype=np.uint64) * np.uint64(self.STEP)

    @staticmethod
    def _mix(x, shifted=None):
        """Mixes 64-bit integers in place (the finaliser of SplitMix64); `shifted` is room."""
        import numpy as np

        shifted = np.right_shift(x, np.uint64(30), out=shifted)
        x ^= shifted
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= np.right_shift(x, np.uint64(27), out=shifted)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= np.right_shift(x, np.uint64(31), out=shifted)
        return x

    @staticmethod
    def _waits(x):
        """Exponential variates from the upper 44 bits of random numbers."""
        import numpy as np

        waits = (x >> np.uint64(20)).astype(np.float64)
        waits *= -(2.0**-44)
        np.log1p(waits, out=waits)
        return np.negative(waits, out=waits)

    def _throw(self, best, hashed, weights, owner, reach) -> None:
        """Throws the darts of terms up to the time `reach` of their owners.

        Time runs by darts on a unit, whichever samples they hit. It is cut into blocks of
        length one, and the darts of a unit in a block are fixed by term, block and unit, so
        that light texts, which need many darts from each unit, have many blocks to work on
        at once. `best` has the earliest dart of each owner and sample: the bits of its time,
        the last 16 of them taken by the draw.
        """
        import numpy as np

        blocks = np.ceil(reach).astype(np.int64)[owner]
        terms = np.repeat(np.arange(len(owner)), blocks)
        block = np.arange(len(terms)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        owner, weights = owner[terms], weights[terms]
        seeds = block.astype(np.uint64)
        seeds *= np.uint64(self.STEP)
        seeds += hashed[terms]
        self._mix(seeds)
        until = np.minimum(reach, 1.0)[owner]
        # The first darts of units below this random number come in time.
        bound = np.ceil(-np.expm1(-until) * 2.0**63).astype(np.uint64) * np.uint64(2)
        ends = np.cumsum(weights)
        starts = ends - weights
        seeds -= starts.astype(np.uint64) * np.uint64(self.STEP)
        room = np.empty(UNITS, dtype=np.uint64)
        for low in range(0, int(ends[-1]), UNITS):
            high = min(low + UNITS, int(ends[-1]))
            first = int(np.searchsorted(ends, low, "right"))
            last = int(np.searchsorted(starts, high, "left"))
            counts = np.minimum(ends[first:last], high) - np.maximum(starts[first:last], low)
            x = np.repeat(seeds[first:last], counts)
            x += self.steps[: high - low]
            x += np.uint64(low * self.STEP % 2**64)
            self._mix(x, room[: high - low])
            near = np.flatnonzero(x < np.repeat(bound[first:last], counts))
            x = x[near]
            row = np.repeat(np.arange(first, last), counts)[near]
            into, begin, limit = owner[row] * self.samples, block[row], until[row]
            time = self._waits(x)
            while len(x):
                at = (x & np.uint64(0xFFFFF)) * np.uint64(self.samples) >> np.uint64(20)
                draw = x >> np.uint64(20)
                draw &= np.uint64(0xFFFF)
                # 0 is the draw of a text without terms.
                draw[draw == 0] = 1
                dart = (begin + time).view(np.uint64)
                dart &= np.uint64(2**64 - 2**16)
                dart |= draw
                np.minimum.at(best, into + at.astype(np.int64), dart)
                x += np.uint64(self.STEP)
                self._mix(x)
                time += self._waits(x)
                more = np.flatnonzero(time < limit)
                x, time, into = x[more], time[more], into[more]
                begin, limit = begin[more], limit[more]

    def _draws(self, words: list[str], counts: list[int], sizes: list[int]):
        """Draws of texts, from their distinct words one text after the other."""
        import numpy as np
        from xxhash import xxh3_64_intdigest

        hashed = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        hashed ^= np.uint64(self.seed)
        weights = np.array(counts, dtype=np.int64)
        weights *= np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        owner = np.repeat(np.arange(len(sizes)), sizes)
        whole = np.bincount(owner, weights, minlength=len(sizes))
        best = np.full(len(sizes) * self.samples, self.MISSED, dtype=np.uint64)
        reach = DARTS * self.samples / np.maximum(whole, 1)
        # No dart hits a term without weight.
        kept = weights > 0
        hashed, weights, owner = hashed[kept], weights[kept], owner[kept]
        while len(owner):
            self._throw(best, hashed, weights, owner, reach)
            missed = (best.reshape(len(sizes), -1) == np.uint64(self.MISSED)).any(axis=1)
            # All darts of texts with a sample left over are thrown again, for twice the time.
            kept = missed[owner]
            hashed, weights, owner = hashed[kept], weights[kept], owner[kept]
            reach *= 2
        best[best == np.uint64(self.MISSED)] = 0
        return best.astype(np.uint16).reshape(len(sizes), -1)

    def _signatures(self, texts: Iterable[dict[str, int]]):
        """Draws of texts given as their words with occurrences: a row each."""
        import numpy as np

        found = [np.empty((0, self.samples), dtype=np.uint16)]
        words: list[str] = []
        counts: list[int] = []
        sizes: list[int] = []
        work = 0
        for text in texts:
            words.extend(text)
            counts.extend(text.values())
            sizes.append(len(text))
            # Words have six characters or so; light texts take as many darts as others.
            work += max(6 * len(text), DARTS * self.samples)
            if work >= UNITS:
                found.append(self._draws(words, counts, sizes))
                words, counts, sizes, work = [], [], [], 0
        if sizes:
            found.append(self._draws(words, counts, sizes))
        return np.concatenate(found)

    def signature(self, terms: list[Term]):
        """The draws of distinct terms; all 0 without terms."""
        pairs = [(term, 1) if isinstance(term, str) else term for term in terms]
        return self._signatures([dict(pairs)])[0]

    def of_texts(self, texts: Iterable[str]):
        """The signatures of texts, a row each."""
        return self._signatures(map(word_counts, texts))

    def of_text(self, text: str):
        return self.of_texts([text])[0]


def as_text(signature) -> str:
    """A signature as hexadecimal digits, four per sample."""
    return signature.astype(">u2").tobytes().hex()


def likeness(one, other) -> float:
    """Share of equal draws: an estimate of the generalised Jaccard similarity."""
    return float((one == other).mean())


def fingerprints(docs: DataFrame, *, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """All columns of `docs` and `into`, the fingerprint of the whole text.

    A null text counts as empty; texts without words share the fingerprint of zeros. Equal
    texts have equal fingerprints, whatever the other columns hold. A column named as
    `into` is replaced. Nothing is shuffled.
    """

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        sampler = WeightedSampler()
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index(text)))
            found = pa.array(list(map(as_text, sampler.of_texts(texts))), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, found], names=[*batch.schema.names, into]
            )

    rows = docs.drop(into)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(add, f"{types}, `{into}` string")


def in_descending_order(docs: DataFrame) -> tuple[DataFrame, int]:
    """Documents dealt into runs of descending `doc_id`, each run closed by a guest.

    Returns rows (run, guest, doc_id, text), each run together and in order, and the
    number of runs. The guest of a run is the first document of the run that follows, so
    that every document meets its successor; after the last run, it is the first document
    of all. Quantiles of the ids bound the runs, whose number follows from that of the
    rows; two numbers per run are all that the driver sees, and none of them is in the plan.
    Null ids come last; documents of one id follow each other by their text.
    """
    import numpy as np

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("key"),
    )
    wanted = min(max(2, -(-rows.count() // RUN)), MOST_RUNS)
    shares = [i / wanted for i in range(1, wanted)]
    accuracy = max(10_000, 10 * wanted)
    cuts = rows.select(F.percentile_approx("key", shares, accuracy)).first()[0] or []
    cuts = np.unique(np.array(cuts, dtype=np.int64))

    @F.pandas_udf("int")
    def run_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    found = rows.select("key").groupBy(run_of("key").alias("run")).agg(F.max("key").alias("first"))
    firsts = dict(found.collect())
    used = sorted(firsts)
    keys = np.array([firsts[run] for run in used], dtype=np.int64)
    # The first document of a run closes the run above it, that of the highest the lowest.
    closes = np.array(used[1:] + used[:1], dtype=np.int32)

    @F.pandas_udf("int")
    def closed_by(key: pd.Series) -> pd.Series:
        at = np.minimum(np.searchsorted(keys, key.to_numpy()), len(keys) - 1)
        return pd.Series(np.where(keys[at] == key.to_numpy(), closes[at], -1).astype(np.int32))

    own = F.struct(F.col("own").alias("run"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("closes").alias("run"), F.lit(True).alias("guest"))
    at = F.when(F.col("closes") >= 0, F.array(own, guest)).otherwise(F.array(own))
    runs = len(cuts) + 1
    dealt = (
        rows.withColumns({"own": run_of("key"), "closes": closed_by("key")})
        .select("doc_id", "text", "key", F.explode(at).alias("at"))
        .select("at.run", "at.guest", "doc_id", "text", "key")
        .repartition(runs, "run")
        .sortWithinPartitions("run", "guest", F.desc("key"), "text")
    )
    return dealt.select("run", "guest", "doc_id", "text"), runs


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents and of edited copies, with likenesses.

    The edited text of a document has its last third (of n_chars code points, rounded
    down) replaced by as many code points from the start of the next document, or all of
    it if that is shorter. The next document is the one with the next smaller `doc_id`;
    the last one is followed by the first. Columns: `doc_id`, `n_chars`, `edited_sha256`,
    `fingerprint`, `edited_fingerprint`, `near_edited` and `near_next`.

    A null text is an empty one. Null ids come last, and rows of one id follow each other
    by their text; each row gives one row. A single document is followed by itself.
    """
    schema_ddl = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double"
    )
    schema = arrow_schema(schema_ddl)
    dealt, _ = in_descending_order(docs)

    def compare(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        sampler = WeightedSampler()
        waiting = None  # the document before, with its signature
        for batch in batches:
            names = ("guest", "doc_id", "text")
            rows = []
            last = waiting is None
            for row in zip(*(batch.column(name).to_pylist() for name in names), strict=True):
                # After the guest come more rows with the id that closes a run.
                if not (row[0] and last):
                    rows.append(row)
                    last = row[0]
            signatures = sampler.of_texts(text for _, _, text in rows)
            pairs = []
            for (guest, doc_id, text), own in zip(rows, signatures, strict=True):
                if waiting is not None:
                    pairs.append((*waiting, text, own))
                waiting = None if guest else (doc_id, text, own)
            if not pairs:
                continue
            digests = []

            def edited_texts(pairs=pairs, digests=digests) -> Iterator[str]:
                for _, old, _, text, _ in pairs:
                    replaced = len(old) // 3
                    edited = old[: len(old) - replaced] + text[:replaced]
                    digests.append(
                        hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    )
                    yield edited

            out = [
                (
                    doc_id,
                    len(old),
                    digest,
                    as_text(signature),
                    as_text(new),
                    likeness(signature, new),
                    likeness(signature, own),
                )
                for (doc_id, old, signature, _, own), new, digest in zip(
                    pairs, sampler.of_texts(edited_texts()), digests, strict=True
                )
            ]
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                schema=schema,
            )

    return dealt.mapInArrow(compare, schema_ddl)
