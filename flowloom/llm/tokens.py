"""Encoding many texts at once, each distinct word of a batch encoded a single time."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from flowloom.llm.texts import word_segments

# Code points of texts that are worked on at a time.
BLOCK = 8 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Ids by token bytes from a rank file: one base64 token and its rank per line."""
    import base64

    with open(path, "rb") as source:
        pairs = (line.split() for line in source if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class BatchEncoder:
    """Token ids of texts, given how to encode a list of strings.

    `encode_many` returns the ids of all strings in a row and how many each string has.
    The pattern of byte-level tokenizers never matches over a space that a word follows,
    so the words between such spaces can be encoded apart and put together. Texts with
    other white space around their spaces are encoded as a whole. Texts are first cut at
    the added tokens, which have ids of their own; of those at one place the longest counts.
    """

    def __init__(
        self, encode_many: Callable[[list[str]], tuple], added: dict[str, int] | None = None
    ):
        self.encode_many = encode_many
        self.added = {token: i.to_bytes(4, "little") for token, i in (added or {}).items()}
        longest = sorted(self.added, key=len, reverse=True)
        self.at_added = re.compile(f"({'|'.join(map(re.escape, longest))})") if added else None

    def _texts(self, texts) -> list[bytes]:
        """Ids of an Arrow array of texts, as little-endian unsigned 32-bit bytes."""
        import numpy as np
        import pyarrow.compute as pc

        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        flat = split.flatten().dictionary_encode()
        words = flat.dictionary.to_pylist()
        at = flat.indices.to_numpy().copy()
        # The first word of a text follows no space and is encoded apart.
        first, heads = np.unique(at[offsets[:-1]], return_inverse=True)
        at[offsets[:-1]] = len(words) + heads
        odd = np.array([not w or w[0].isspace() for w in words] + [False] * len(first))
        whole = np.unique(np.searchsorted(offsets, np.flatnonzero(odd[at]), "right") - 1).tolist()
        pool, counts = self.encode_many(
            [" " + word for word in words]
            + [words[i] for i in first]
            + [texts[i].as_py() for i in whole]
        )
        ends = np.cumsum(counts)
        starts = ends - counts
        lengths = counts[at]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(bounds[-1]) + np.repeat(starts[at] - bounds[:-1], lengths)
        pool = pool.astype("<u4")
        ids = pool[source].tobytes()
        cuts = (4 * bounds[offsets]).tolist()
        out = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i, place in enumerate(whole, len(words) + len(first)):
            out[place] = pool[starts[i] : ends[i]].tobytes()
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text. About `BLOCK` code points are worked on at a time."""
        import pyarrow as pa

        pieces: list[str] = []
        after: list[bytes] = []  # the id of the added token that follows a piece
        last: list[bool] = []  # whether a piece ends its text
        size, held = 0, []
        for number, text in enumerate(texts, 1):
            # Texts between added tokens, at even places, and these tokens.
            parts = self.at_added.split(text) if self.at_added else [text]
            for part, token in zip(parts[::2], [*parts[1::2], None], strict=True):
                cut = list(word_segments(part)) or [""]
                pieces += cut
                after += [b""] * (len(cut) - 1) + [self.added.get(token, b"")]
                last += [False] * (len(cut) - 1) + [token is None]
            size += len(text)
            if size >= BLOCK or number == len(texts):
                for ids, more, ends in zip(
                    self._texts(pa.array(pieces)), after, last, strict=True
                ):
                    held += (ids, more)
                    if ends:
                        yield b"".join(held)
                        held.clear()
                pieces, after, last, size = [], [], [], 0
