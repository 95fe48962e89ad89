"""Packing documents into fixed windows of tokens: best-fit decreasing.

Documents are tokenized, closed with an end token and cut into full windows; what remains
of each is packed with the remainders of its group, longest first, into the open window
with the least room that still takes it. A segment tree over the remaining capacities
finds that window. A group is `group` consecutive documents of one task, so a task holds
at most `group` windows of tokens at a time, nothing is shuffled, and a lost task is
repeated alone. The last windows of a group stay partly open, about one in `group`.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.texts import strings
from flowloom.llm.tokens import BatchEncoder

WINDOW = 2048
END_ID = 1
GROUP = 4096


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree.

    Leaf c of the tree counts the windows with c tokens of room; an inner node counts
    those below it. `take(size)` removes a window with the least room of at least `size`.
    """

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, number: int) -> None:
        self.at[room].append(number)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, number) of the tightest window that takes `size` tokens, if there is one."""
        node = self.leaves + size
        if not self.count[node]:
            # Climb to the first subtree on the right that holds a window.
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.at[room].pop()

    def _add(self, room: int, step: int) -> None:
        node = self.leaves + room
        while node:
            self.count[node] += step
            node >>= 1


def best_fit_decreasing(sizes: list[int], window: int) -> list[tuple[int, int]]:
    """(window number, offset) of each piece; equal sizes are placed in their order."""
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    windows, opened = OpenWindows(window), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = windows.take(sizes[i])
        if found is None:
            found, opened = (window, opened), opened + 1
        room, number = found
        placed[i] = (number, window - room)
        windows.put(room - sizes[i], number)
    return placed


def byte_ranks(definition: str) -> dict[bytes, int]:
    """Ids by token bytes from the definition of a byte-level tokenizer (JSON).

    Such files write a byte as a printable character: those of Latin-1 that print stand
    for themselves, the others for code points from 256 on in their order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    vocabulary = json.loads(definition)
    special = {token["content"] for token in vocabulary["added_tokens"]}
    return {
        bytes(byte[c] for c in token): number
        for token, number in vocabulary["model"]["vocab"].items()
        if token not in special
    }


def added_tokens(definition: str) -> dict[str, int]:
    """Ids of the added tokens of a tokenizer definition (JSON), by their text."""
    tokens = json.loads(definition)["added_tokens"]
    for token in tokens:
        if any(token.get(x) for x in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"added token {token['content']!r} depends on what is around it")
    return {token["content"]: token["id"] for token in tokens}


def library_encoder(
    definition: str, pattern: str, added: dict[str, int] | None = None
) -> BatchEncoder:
    """An encoder by the tokenizer library; tokens are ordinary text unless in `added`."""
    import numpy as np
    import tiktoken

    tokenizer = tiktoken.Encoding(
        "own", pat_str=pattern, mergeable_ranks=byte_ranks(definition), special_tokens={}
    )

    def ids(text: str):
        return tokenizer.encode_to_numpy(text, disallowed_special=())

    tab = int(ids("\t")[0])

    def encode_many(strings: list[str]) -> tuple:
        counts = np.zeros(len(strings), dtype=np.int64)
        # One call for all words: a tab before a space is a token of its own.
        plain = np.array(
            [
                x[:1] == " " and not x[1:2].isspace() and not x[-1].isspace() and "\t" not in x
                for x in strings
            ],
            dtype=bool,
        )
        joined = ids("\t".join(x for x, together in zip(strings, plain, strict=True) if together))
        tabs = np.flatnonzero(joined == tab)
        if plain.any():
            counts[plain] = np.diff(np.concatenate([[-1], tabs, [len(joined)]])) - 1
        alone = {i: ids(strings[i]) for i in np.flatnonzero(~plain) if strings[i]}
        for i, found in alone.items():
            counts[i] = len(found)
        pool = np.zeros(counts.sum(), dtype=np.uint32)
        own = np.repeat(~plain, counts)
        pool[~own] = np.delete(joined, tabs)
        if alone:
            pool[own] = np.concatenate(list(alone.values()))
        return pool, counts

    return BatchEncoder(encode_many, added)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    pattern: str,
    *,
    window: int = WINDOW,
    end_id: int = END_ID,
    group: int = GROUP,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Pieces of documents with their place in sequences of at most `window` tokens.

    One row per piece: `doc_id`, `start` (tokens of the document before it), `length`,
    `doc_tokens` (with the end token), `sequence_id`, `offset` in the sequence and `ids`,
    the tokens as little-endian unsigned 32-bit integers. Every token lies in one piece.
    Where a text holds an added token of the tokenizer, it becomes the id of that token.

    A null text is an empty one, which gives its end token alone. A null `doc_id` is
    kept, and repeated rows are packed as often as they occur. An empty table gives no
    rows. Sequence numbers are unique, not consecutive.
    """
    with open(tokenizer_path, encoding="utf-8") as source:
        definition = docs.sparkSession.sparkContext.broadcast(source.read())
    id_type = docs.schema[doc_id].dataType.simpleString()

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = library_encoder(definition.value, pattern, added_tokens(definition.value))
        end = np.array([end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        kind = None
        rows: list[tuple] = []
        rest: list[tuple] = []  # (document, start, tokens, ids) of remainders

        def out() -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            long = pa.int64()
            types = [kind, long, long, long, long, long, pa.binary()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names
            )

        def place() -> None:
            nonlocal sequence
            placed = best_fit_decreasing([len(x[3]) // 4 for x in rest], window)
            for (document, start, tokens, ids), (number, offset) in zip(rest, placed, strict=True):
                rows.append(
                    (document, start, len(ids) // 4, tokens, sequence + number, offset, ids)
                )
            sequence += 1 + max((number for number, _ in placed), default=-1)
            rest.clear()

        for batch in batches:
            kind = batch.column(0).type
            identifiers = batch.column(0).to_pylist()
            texts = strings(batch.column(1))
            for document, ids in zip(identifiers, encoder.encode(texts), strict=True):
                ids += end
                tokens, start = len(ids) // 4, 0
                while tokens - start >= window:
                    full = ids[4 * start : 4 * (start + window)]
                    rows.append((document, start, window, tokens, sequence, 0, full))
                    sequence, start = sequence + 1, start + window
                if start < tokens:
                    rest.append((document, start, tokens, ids[4 * start :]))
                if len(rest) >= group:
                    place()
                if len(rows) >= 1024:
                    yield out()
        if rest:
            place()
        if rows:
            yield out()

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(
        pack,
        f"doc_id {id_type}, start bigint, length bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint, ids binary",
    )
