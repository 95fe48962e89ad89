"""Byte-level BPE by replaying the merges over a whole batch of words.

The distinct words of a batch lie behind each other in one array of symbols with links to
their neighbours. An inverted index holds, for every pair of symbols that merges, the
positions where it occurs. Merges are replayed in the order of their ranks: all positions
of a pair are joined at once, and only the pairs with their neighbours are looked up anew
and put into the index.

A word is put aside, and encoded by itself one merge at a time, if a merge gives a pair of
a lower rank than its own: there the order within the word would matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame

from flowloom.llm.texts import strings
from flowloom.llm.tokens import BatchEncoder, read_ranks

# Rows of one batch of results.
ROWS = 512


class MergeReplay:
    """Encodes words, given as bytes, by the ranks of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        self.ranks = ranks
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # Every way to put a token together from two tokens.
        pairs = {
            (ranks[token[:cut]] << 32) | ranks[token[cut:]]: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        }
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def pair_ranks(self, left, right):
        """What pairs of symbols merge to; -1 for none."""
        import numpy as np

        if not len(self.keys):
            return np.full(len(left), -1, dtype=np.int64)
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.merged[at], -1)

    def one(self, word: bytes) -> list[int]:
        """A word by itself: the lowest rank first, the leftmost of equal ones first."""
        parts = [bytes([b]) for b in word]
        while len(parts) > 1:
            found = [
                (self.ranks[a + b], i)
                for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))
                if a + b in self.ranks
            ]
            if not found:
                break
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[part] for part in parts]

    def words(self, words: list[bytes]) -> tuple:
        """Ids of all words in a row, and how many each word has."""
        import numpy as np

        sizes = np.array([len(word) for word in words], dtype=np.int64)
        n = int(sizes.sum())
        # Symbol -1 stands for an end: position n is behind every last and before every
        # first symbol of a word.
        symbol = np.full(n + 1, -1, dtype=np.int64)
        symbol[:n] = self.byte_ids[np.frombuffer(b"".join(words), dtype=np.uint8)]
        of_word = np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[ends[sizes > 0] - 1] = n
        before[(ends - sizes)[sizes > 0]] = n
        after[n] = before[n] = n
        alive = np.ones(n + 1, dtype=bool)
        irregular: set[int] = set()

        index: dict[int, list] = {}
        waiting: list[int] = []

        def enter(at, ranks) -> None:
            """Put positions into the index under the ranks of their pairs."""
            at, ranks = at[ranks >= 0], ranks[ranks >= 0]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            firsts = ranks[np.concatenate([[0], cuts])].tolist()
            for rank, part in zip(firsts, np.split(at, cuts), strict=True):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(waiting, rank)
                index[rank].append(part)

        every = np.arange(n)
        enter(every, self.pair_ranks(symbol[every], symbol[after[every]]))
        while waiting:
            rank = heapq.heappop(waiting)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[alive[at]]
            right = after[at]
            at = at[self.pair_ranks(symbol[at], symbol[right]) == rank]
            if len(at) > 1:
                # Where pairs overlap, the leftmost of a chain is joined, then every other.
                linked = np.concatenate([[False], after[at[:-1]] == at[1:]])
                starts = np.maximum.accumulate(np.where(~linked, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - starts) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            right = after[gone]
            one = np.full(len(at), rank, dtype=np.int64)
            lower = self._lower(one, symbol[right], rank)
            symbol[at] = rank
            alive[gone] = False
            after[at] = right
            before[right] = at
            before[n] = n
            left = before[at]
            to_left = self.pair_ranks(symbol[left], one)
            lower |= (to_left >= 0) & (to_left < rank)
            to_right = self.pair_ranks(one, symbol[after[at]])
            if lower.any():
                irregular.update(of_word[at[lower]].tolist())
            enter(np.concatenate([left, at]), np.concatenate([to_left, to_right]))
        alive[n] = False
        counts = np.bincount(of_word[alive[:n]], minlength=len(words)).astype(np.int64)
        ids = symbol[:n][alive[:n]]
        if not irregular:
            return ids, counts
        split = np.split(ids, np.cumsum(counts)[:-1])
        for i in irregular:
            split[i] = np.array(self.one(words[i]), dtype=np.int64)
            counts[i] = len(split[i])
        return np.concatenate(split), counts

    def _lower(self, left, right, rank: int):
        found = self.pair_ranks(left, right)
        return (found >= 0) & (found < rank)


def pattern_encoder(replay: MergeReplay, pattern: str) -> BatchEncoder:
    """An encoder of texts whose words are the matches of `pattern`."""
    import numpy as np
    import regex

    compiled = regex.compile(pattern)

    def encode_many(texts: list[str]) -> tuple:
        number: dict[str, int] = {}
        at, counts = [], []
        for text in texts:
            found = compiled.findall(text)
            at += [number.setdefault(word, len(number)) for word in found]
            counts.append(len(found))
        pool, sizes = replay.words([word.encode() for word in number])
        at = np.array(at, dtype=np.int64)
        ends = np.cumsum(sizes)
        lengths = sizes[at]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(bounds[-1]) + np.repeat((ends - sizes)[at] - bounds[:-1], lengths)
        cuts = bounds[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return pool[source], np.diff(cuts)

    return BatchEncoder(encode_many)


def bpe_encode(
    docs: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", into: str = "ids"
) -> DataFrame:
    """All columns of `docs` but `text`, and `into`: the token ids of the text.

    Each match of `pattern` is encoded by itself; no special tokens are known. A null text
    is an empty one and has no ids. Other columns pass as they are, nulls included, and
    repeated rows stay. A column named as `into` is replaced. Nothing is shuffled.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        encoder = pattern_encoder(MergeReplay(ranks.value), pattern)
        for batch in batches:
            place = batch.schema.get_field_index(text)
            kept = [i for i in range(batch.num_columns) if i != place]
            found, start = [], 0
            for ids in encoder.encode(strings(batch.column(place))):
                found.append(ids)
                if len(found) == ROWS or start + len(found) == batch.num_rows:
                    sizes = np.cumsum([0] + [len(x) // 4 for x in found])
                    arrays = [batch.column(i).slice(start, len(found)) for i in kept]
                    values = pa.array(np.frombuffer(b"".join(found), dtype="<i4"))
                    arrays.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), values))
                    names = [batch.schema.names[i] for i in kept] + [into]
                    yield pa.RecordBatch.from_arrays(arrays, names=names)
                    found, start = [], start + len(found)

    rows = docs.drop(into)
    kept = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text
    )
    return rows.mapInArrow(encode, f"{kept + ', ' if kept else ''}`{into}` array<int>")


def bpe_decode(
    encoded: DataFrame, ranks_path: str, *, ids: str = "ids", into: str = "decoded"
) -> DataFrame:
    """All columns of `encoded` and `into`: the bytes of the tokens in `ids`.

    Null ids count as none; an id that the vocabulary lacks is an error. A column named
    as `into` is replaced.
    """
    tokens = encoded.sparkSession.sparkContext.broadcast(
        {rank: token for token, rank in read_ranks(ranks_path).items()}
    )

    def decode(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token = tokens.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for start in range(0, batch.num_rows, ROWS):
                found = [
                    b"".join([token[i] for i in x or ()])
                    for x in column.slice(start, ROWS).to_pylist()
                ]
                arrays = [c.slice(start, ROWS) for c in batch.columns]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(found, pa.binary())], names=[*batch.schema.names, into]
                )

    rows = encoded.drop(into)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(decode, f"{types}, `{into}` binary")
