"""Spelling variants of a vocabulary: words that differ by one letter, and their forms.

Words are near if one inserted, deleted or replaced code point turns one into the other.
An error lies in one half of a word, so the other half is matched exactly and the search
goes on across the rest with one error allowed. Both searches run over FM-indexes of the
delimited words, one per reading direction: an interval of suffix ranks that stands for
what has been read so far grows by a letter through the last-to-first mapping, and the
delimiter at the far end turns an interval into a word. Each search starts at the delimiter
next to its exact half, so it never turns round.

Words meet by what they match exactly: every word lies in the shards of the halves of
words of its own length and of one more letter (whose deletion gives it), and searches in
the shards of its own halves. Insertions are found from the longer word. Where more than
`CROWD` words share a half, the half with the error is cut in two again and the words are
dealt by the larger exact rest; at a single open position only one word per letter is left,
so every shard is bounded and no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.texts import arrow_schema
from flowloom.session import shared_dir

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 5
MIN_COUNT = 3
# A form occurs at least so many times as often as the word.
FACTOR = 2
# Words that may share an exact half, and rows of a shard.
CROWD = 1_000
SHARD = 65_536
# Words that search at a time.
BLOCK = 16_384
ASCII_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(word: Column) -> Column:
    """`word` with A-Z in lower case and all else as it is."""
    plain = F.octet_length(word) == F.char_length(word)
    other = F.translate(word, ASCII_CAPITALS, ASCII_CAPITALS.lower())
    return F.when(plain, F.lower(word)).otherwise(other)


def without_letter(word: Column, place: Column) -> Column:
    """`word` less the code point at `place`, counted from 0."""
    return F.concat(
        F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.char_length(word))
    )


def dropped_letters(doc_id: Column, run: Column, every: int = 97) -> Column:
    """`run`, less one letter where `every` divides the checksum of document and run."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(F.encode(key, "UTF-8"))
    place = (h % F.char_length(run)).cast("int")
    return F.when(h % every == 0, without_letter(run, place)).otherwise(run)


def word_counts(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    edit=None,
) -> DataFrame:
    """(word, n): the letter runs of whole texts in lower case, with their occurrences.

    `edit(doc_id, run)` may change a run before it is counted. Null and empty texts have no
    words; a null `doc_id` is the empty text to `edit`. Repeated rows count each. Words
    shorter than `min_length` code points, after the edit, are left out. Counts are combined
    before the shuffle.
    """
    # Shorter runs cannot give a word that counts; an edit never adds a letter.
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    found = docs.select(F.col(doc_id).alias("doc"), F.explode(runs).alias("run"))
    found = found.select("doc", lower_ascii(F.col("run")).alias("run"))
    word = edit(F.col("doc"), F.col("run")) if edit else F.col("run")
    return (
        found.select(word.alias("word"))
        .filter(F.char_length("word") >= min_length)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


class WordIndex:
    """FM-index of delimited words, read from their last letter to their first.

    Words are rows of letter codes from 1 on, read in search order: column 0 is read first.
    `lengths` says how many columns of a row count. Ranks of suffixes are intervals
    [low, high); all words together are [0, words).
    """

    def __init__(self, codes, lengths, letters: int):
        import numpy as np

        words = len(codes)
        self.words, self.letters, self.edge = words, letters, letters + 1
        # A text per word: edge, letters, end (0). The letters stand against search order.
        sizes = lengths + 2
        ends = np.cumsum(sizes)
        text = np.zeros(int(sizes.sum()), dtype=np.int64)
        owner = np.repeat(np.arange(words), sizes)
        left = ends[owner] - 1 - np.arange(len(text))  # letters up to the end of the word
        inner = (left > 0) & (left <= lengths[owner])
        text[inner] = codes[owner[inner], left[inner] - 1]
        text[left == lengths[owner] + 1] = self.edge
        order = self._suffix_order(text, left, int(sizes.max(initial=0)))
        before = np.where(left[order] == sizes[owner[order]] - 1, 0, text[order - 1])
        by_letter = np.argsort(before, kind="stable")
        self.before = before
        self.step = len(text) + 1
        self.back = np.empty(len(text), dtype=np.int64)
        self.back[by_letter] = np.arange(len(text))
        self.keys = before[by_letter] * self.step + by_letter
        # The suffixes that start at an edge come last, one per word.
        self.first = len(text) - words
        self.word_at = owner[order[self.first :]]

    def _suffix_order(self, text, left, longest: int):
        """Positions in the order of their suffixes, equal ones in the order of the words."""
        import numpy as np

        bits = max(1, int(self.edge).bit_length())
        width = max(1, 62 // bits)
        key = np.zeros(len(text), dtype=np.int64)
        for j in range(min(width, longest)):
            shifted = np.zeros_like(text)
            shifted[: len(text) - j] = text[j:]
            key = (key << bits) | np.where(left >= j, shifted, 0)
        while width < longest:
            rank = np.unique(key, return_inverse=True)[1]
            rest = np.zeros_like(rank)
            rest[: len(rank) - width] = rank[width:] + 1
            key = rank * (len(rank) + 1) + np.where(left >= width, rest, 0)
            width *= 2
        return np.argsort(key, kind="stable")

    def grow(self, low, high, letter):
        """Intervals of what has been read and `letter`; empty where no word has that."""
        import numpy as np

        return (
            np.searchsorted(self.keys, letter * self.step + low),
            np.searchsorted(self.keys, letter * self.step + high),
        )


def _rows_of(low, high):
    """All ranks of the intervals, and the interval that each comes from."""
    import numpy as np

    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    return low[which] + np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes), which


def one_error(index: WordIndex, codes, start: int, end: int, forward: bool):
    """(query, word) pairs: words that a query gives by one error at columns [start, end).

    The error is a left out letter or one replaced by a later letter of the alphabet. Of a
    run of equal letters only the first one of the word is left out; it stands at the smaller
    column if `forward`, otherwise at the larger one. So every pair comes once.
    """
    import numpy as np

    count, length = codes.shape
    who = np.arange(count)
    low, high = np.zeros(count, np.int64), np.full(count, index.words, np.int64)
    # States with their error behind them: intervals, and single ranks, which need no search.
    wide = [np.zeros(0, np.int64)] * 3
    single = [np.zeros(0, np.int64)] * 2
    for t in range(length):
        letter = codes[:, t]
        new_wide, new_single = [], []
        if start <= t < end:
            # Left out: what has been read stays.
            near = t - 1 if forward else t + 1
            once = letter != codes[:, near] if 0 <= near < length else np.ones(count, bool)
            once = once[who]
            new_wide.append((who[once], low[once], high[once]))
            # Replaced: by the letters in the interval, or by all where it is wider.
            few = high - low <= index.letters
            ranks, which = _rows_of(low[few], high[few])
            found, source = index.before[ranks], who[few][which]
            other = (found > letter[source]) & (found < index.edge)
            new_single.append((source[other], index.back[ranks[other]]))
            many = np.flatnonzero(~few)
            for a in range(1, index.letters + 1):
                at = many[letter[who[many]] < a]
                l, h = index.grow(low[at], high[at], a)
                some = h > l
                new_wide.append((who[at][some], l[some], h[some]))
        if len(wide[0]):
            l, h = index.grow(wide[1], wide[2], letter[wide[0]])
            some = h > l
            wide = [wide[0][some], l[some], h[some]]
        if len(single[0]):
            same = index.before[single[1]] == letter[single[0]]
            single = [single[0][same], index.back[single[1][same]]]
        if t < end - 1:
            low, high = index.grow(low, high, letter[who])
            some = high > low
            who, low, high = who[some], low[some], high[some]
        wide = [np.concatenate(x) for x in zip(wide, *new_wide, strict=True)]
        single = [np.concatenate(x) for x in zip(single, *new_single, strict=True)]
        alone = wide[2] - wide[1] == 1
        if alone.any():
            single = [np.concatenate([single[i], wide[i][alone]]) for i in (0, 1)]
            wide = [x[~alone] for x in wide]
    # Words are distinct, so that at most one rank of an interval starts a word.
    l, h = index.grow(wide[1], wide[2], index.edge)
    some = h > l
    done = index.before[single[1]] == index.edge
    query = np.concatenate([wide[0][some], single[0][done]])
    rank = np.concatenate([l[some], index.back[single[1][done]]])
    return query, index.word_at[rank - index.first]


def letter_codes(words: list[str]):
    """Codes from 1 on of the letters of words, a row per word, zeros behind; lengths; count.

    Codes keep the order of code points.
    """
    import numpy as np

    lengths = np.array([len(w) for w in words], dtype=np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    alphabet, places = np.unique(flat, return_inverse=True)
    codes = np.zeros((len(words), int(lengths.max(initial=0))), dtype=np.int64)
    codes[np.arange(codes.shape[1]) < lengths[:, None]] = places + 1
    return codes, lengths, len(alphabet)


def near_pairs(words: list[str], length: int, zones: list[tuple[int, int]], places) -> tuple:
    """(one, other): places in `words` of near words whose error lies in a zone of a query.

    `words` are distinct, of `length` code points or one less; `zones` are spans [start, end)
    of a word of `length`, each in one of its halves, and `places` the queries of each.
    """
    import numpy as np

    codes, lengths, letters = letter_codes(words)
    # The same words from their last letter on.
    columns = lengths[:, None] - 1 - np.arange(codes.shape[1])
    turned = np.where(columns >= 0, np.take_along_axis(codes, columns % codes.shape[1], 1), 0)
    indexes: dict[bool, WordIndex] = {}
    found = []
    for (start, end), queries in zip(zones, places, strict=True):
        forward = start >= length // 2
        read = codes if forward else turned
        if forward not in indexes:
            indexes[forward] = WordIndex(read, lengths, letters)
        span = (start, end) if forward else (length - end, length - start)
        for at in range(0, len(queries), BLOCK):
            part = queries[at : at + BLOCK]
            query, word = one_error(indexes[forward], read[part], *span, forward)
            found.append((part[query], word))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([empty, *(f[i] for f in found)]) for i in (0, 1))


SHARD_ROWS = "length int, start int, end int, word string, n bigint"
FOUND = "word string, n_near bigint, near string, near_n bigint"


def _exact_key() -> Column:
    """Hash of the part of a word outside of its zone; unlike parts may share a key."""
    size = F.char_length("word")
    tail = F.col("length") - F.col("end")
    return F.xxhash64(
        "length",
        "start",
        "end",
        F.substring("word", F.lit(1), F.col("start")),
        F.substring("word", size - tail + 1, tail),
    )


def _zones(rows: DataFrame, cuts: list[tuple[Column, Column]]) -> DataFrame:
    """Each row with every one of the zones that `cuts` names, and its key."""
    zones = F.array(*(F.struct(a.alias("start"), b.alias("end")) for a, b in cuts))
    return (
        rows.select("length", "word", "n", F.explode(zones).alias("zone"))
        .select("length", "zone.start", "zone.end", "word", "n")
        .withColumn("key", _exact_key())
    )


def _dealt(words: DataFrame, crowd: int, folder: str) -> DataFrame:
    """Rows of SHARD_ROWS and `key`: words by their exact parts, at most `crowd` per part."""
    spark = words.sparkSession
    size = F.char_length("word")
    both = words.withColumn("length", F.explode(F.array(size, size + 1)))
    half = (F.col("length") / 2).cast("int")
    whole = F.lit(0), F.col("length")
    rows = _zones(both, [(whole[0], half), (half, whole[1])])
    parts, level = [], 0
    while True:
        rows.write.parquet(f"{folder}/zones-{level}")
        rows = spark.read.parquet(f"{folder}/zones-{level}")
        crowded = (
            rows.filter(F.col("end") - F.col("start") > 1)
            .groupBy("key")
            .agg(F.count("*").alias("rows"))
            .filter(F.col("rows") > crowd)
            .select("key")
        )
        crowded.write.parquet(f"{folder}/crowded-{level}")
        crowded = spark.read.parquet(f"{folder}/crowded-{level}")
        if crowded.isEmpty():
            parts.append(rows)
            break
        open_zone = F.col("end") - F.col("start") > 1
        parts.append(
            rows.filter(~open_zone).unionByName(
                rows.filter(open_zone).join(crowded, "key", "left_anti").select(rows.columns)
            )
        )
        middle = ((F.col("start") + F.col("end")) / 2).cast("int")
        again = rows.filter(open_zone).join(crowded, "key", "left_semi")
        rows = _zones(again, [(F.col("start"), middle), (middle, F.col("end"))])
        level += 1
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def near_words(words: DataFrame, *, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """(word, n_near, near, near_n): near words of each word that has any.

    `words` has distinct, non-null `word` and `n`. `near` is the near word of largest
    `near_n`, ties to the smallest in code-point order; `n_near` counts all near words.
    """
    folder = shared_dir(words.sparkSession, "spelling-shards")
    dealt = _dealt(words, crowd, folder)
    shards = max(1, -(-dealt.count() // shard))
    schema = arrow_schema(FOUND)

    def search(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def answer(length: int, held: list):
            table = pa.Table.from_batches(held)
            counts = dict(
                zip(table.column("word").to_pylist(), table.column("n").to_pylist(), strict=True)
            )
            # In code-point order, so that places compare as words do.
            distinct = sorted(counts)
            place = {word: i for i, word in enumerate(distinct)}
            queries: dict[tuple[int, int], set[int]] = {}
            columns = (table.column(c).to_pylist() for c in ("start", "end", "word"))
            for start, end, word in zip(*columns, strict=True):
                if len(word) == length:
                    queries.setdefault((start, end), set()).add(place[word])
            zones = sorted(queries)
            asked = [np.array(sorted(queries[zone])) for zone in zones]
            one, other = near_pairs(distinct, length, zones, asked)
            if not len(one):
                return None
            one, other = np.concatenate([one, other]), np.concatenate([other, one])
            n = np.array([counts[word] for word in distinct])
            order = np.lexsort((other, -n[other], one))
            one, other = one[order], other[order]
            at, first, near = np.unique(one, return_index=True, return_counts=True)
            best = other[first]
            names = np.array(distinct, dtype=object)
            columns = (names[at].tolist(), near, names[best].tolist(), n[best])
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)],
                schema=schema,
            )

        length, held = None, []
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            bounds = [0, *(np.flatnonzero(np.diff(lengths)) + 1).tolist(), len(lengths)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a == b:
                    continue
                if held and lengths[a] != length:
                    found, held = answer(length, held), []
                    if found is not None:
                        yield found
                length = int(lengths[a])
                held.append(batch.slice(a, b - a))
        if held:
            found = answer(length, held)
            if found is not None:
                yield found

    found = (
        dealt.repartition(shards, "length", "key")
        .select("length", "start", "end", "word", "n")
        .sortWithinPartitions("length")
        .mapInArrow(search, FOUND)
    )
    return (
        found.groupBy("word")
        .agg(
            F.sum("n_near").alias("n_near"),
            F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"),
        )
        .select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    )


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain of `form` that starts at each `word` of `forms`.

    Chains have no loops, as counts grow along them. Every round doubles the steps behind a
    word; tables between rounds lie in the shared folder.
    """
    spark = forms.sparkSession
    folder = shared_dir(spark, "spelling-roots")
    now = forms.select("word", F.col("form").alias("root"))
    number = 0
    while True:
        now.write.parquet(f"{folder}/{number}")
        now = spark.read.parquet(f"{folder}/{number}")
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
        number += 1


def spelling_variants(
    words: DataFrame, *, factor: int = FACTOR, crowd: int = CROWD, shard: int = SHARD
) -> DataFrame:
    """Near words, form and root of every word of a vocabulary.

    `words` has the columns `word` and `n`, its occurrences. Returns `word`, `form`, `root`,
    `n`, `n_near` and `form_n`: the form is the near word of largest n (ties: smallest in
    code-point order) if that is at least `factor` times the word's own, else null; the root
    is the end of the chain of forms, the word itself without a form; `n_near` counts near
    words and is 0 without any; `form_n` is the form's n.

    Null words are left out, a null n counts as 0, repeated words add up. The empty word is
    near to single letters. An empty table gives no rows. `factor` is 2 or more, so chains
    end.
    """
    if factor < 2:
        raise ValueError("factor must be at least 2")
    spark = words.sparkSession
    folder = shared_dir(spark, "spelling-words")
    (
        words.filter(F.col("word").isNotNull())
        .groupBy("word")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
        .write.parquet(f"{folder}/words")
    )
    known = spark.read.parquet(f"{folder}/words")
    better = (F.col("near_n") >= factor * F.col("n")) & (F.col("near_n") > 0)
    (
        known.join(near_words(known, crowd=crowd, shard=shard), "word", "left")
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(better, F.col("near")).alias("form"),
            F.when(better, F.col("near_n")).alias("form_n"),
        )
        .write.parquet(f"{folder}/forms")
    )
    found = spark.read.parquet(f"{folder}/forms")
    roots = last_forms(found.filter("form IS NOT NULL"))
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
