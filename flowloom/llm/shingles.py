"""Sets of word shingles of many texts at once, as sorted 64-bit hashes.

Words are runs of other bytes than ASCII white space, with the letters A-Z in lower case.
A text of fewer words than a shingle has its whole sequence as one shingle; a text without
words has none. Hashes stand for shingles: two different ones of the same texts agree with
a probability of about 2**-64. The hash of a word mixes two sums over its letters, one
modulo 2**64 and one modulo a prime, as some long words cancel in the first whatever its base.
"""

from __future__ import annotations

from collections.abc import Iterator

WORDS = 5
# Bytes of texts that are hashed at a time.
BLOCK = 2 << 20
BASE = 0x9E3779B97F4A7C15
PRIME, PRIME_BASE = 2**31 - 1, 1_103_515_245


def prime_powers(base: int, n: int):
    """base**i modulo PRIME for i below n."""
    import numpy as np

    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
        done += more
    return out


def scramble(x):
    """Mixes 64-bit integers (the finaliser of SplitMix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Turns byte texts into shingle sets. Holds tables of powers as long as a block."""

    def __init__(self, words: int = WORDS):
        import numpy as np

        self.words = words
        self.power = self.inverse = np.ones(1, dtype=np.uint64)
        self.prime_power = self.prime_inverse = np.ones(1, dtype=np.uint64)
        steps = scramble(np.arange(1, 2 * words + 2, dtype=np.uint64) * np.uint64(BASE))
        self.factors = steps | np.uint64(1)

    def _reach(self, n: int) -> None:
        import numpy as np

        if len(self.power) < n:
            n = max(n, BLOCK + 1)
            up = np.full(n, BASE, dtype=np.uint64)
            down = np.full(n, pow(BASE, -1, 1 << 64), dtype=np.uint64)
            up[0] = down[0] = 1
            self.power, self.inverse = np.cumprod(up), np.cumprod(down)
            self.prime_power = prime_powers(PRIME_BASE, n)
            self.prime_inverse = prime_powers(pow(PRIME_BASE, -1, PRIME), n)

    def word_hashes(self, data, cuts) -> tuple:
        """Hashes of the words of joined texts that end at `cuts`, and words per text."""
        import numpy as np

        n = len(data)
        if not n:
            return np.zeros(0, dtype=np.uint64), np.zeros(len(cuts), dtype=np.int64)
        self._reach(n + 1)
        data = np.where((data >= 65) & (data <= 90), data | 32, data)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        first = ~space
        first[1:] &= space[:-1]
        last = ~space
        last[:-1] &= space[1:]
        # Texts meet without white space between them.
        inner = cuts[(cuts > 0) & (cuts < n)]
        first[inner] = ~space[inner]
        last[inner - 1] = ~space[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.concatenate(
            [np.zeros(1, np.uint64), np.cumsum((data + np.uint64(1)) * self.power[:n])]
        )
        own = (total[ends] - total[starts]) * self.inverse[starts]
        # Products stay below 2**39, and their sums below 2**64.
        products = (data + np.uint64(1)) * self.prime_power[:n]
        if n > 1 << 24:
            products %= np.uint64(PRIME)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(products)])
        prime = (total[ends] - total[starts]) % np.uint64(PRIME)
        prime = prime * self.prime_inverse[starts] % np.uint64(PRIME)
        hashes = scramble(own ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))
        hashes = scramble(hashes + prime * np.uint64(BASE))
        return hashes, np.diff(np.searchsorted(starts, cuts), prepend=0)

    def combine(self, hashes):
        """The set of shingles of one text, from the hashes of its words, sorted."""
        import numpy as np

        n = len(hashes)
        if n == 0:
            return hashes
        size = min(n, self.words)
        total = np.full(n - size + 1, size, dtype=np.uint64)
        for i in range(size):
            total = total + scramble(hashes[i : n - size + 1 + i] * self.factors[2 * i]) * (
                self.factors[2 * i + 1]
            )
        return np.unique(scramble(total))

    def sets(self, texts: list[bytes | None]) -> Iterator:
        """The shingle set of each text; null has none."""
        import numpy as np

        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end] or b"") <= BLOCK):
                size += len(texts[end] or b"")
                end += 1
            if size > BLOCK:  # a single text, in parts cut at white space
                parts = [
                    self.word_hashes(np.frombuffer(part, np.uint8), np.array([len(part)]))[0]
                    for part in _parts(texts[start])
                ]
                yield self.combine(np.concatenate(parts))
            else:
                block = [text or b"" for text in texts[start:end]]
                data = np.frombuffer(b"".join(block), dtype=np.uint8)
                cuts = np.cumsum([len(text) for text in block])
                hashes, counts = self.word_hashes(data, cuts)
                at = 0
                for count in counts.tolist():
                    yield self.combine(hashes[at : at + count])
                    at += count
            start = end


def _parts(text: bytes) -> Iterator[bytes]:
    start = 0
    while start < len(text):
        end = start + BLOCK
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[start:end]
        start = end


def set_key(shingles) -> int:
    """One signed 64-bit integer for a whole set."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return value - (1 << 64) if value >= 1 << 63 else value
