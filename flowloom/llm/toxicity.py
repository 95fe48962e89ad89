"""Toxicity by a weighted lexicon, matched over folded text.

Folding makes look-alike letters, accents and digits that stand for letters equal, and
everything else a gap. A lexicon of word beginnings is learned from labelled documents:
each entry weighs the logarithm of how much more often toxic documents hold it. One
Aho-Corasick automaton finds all entries and exception phrases in one pass over a text; a
match inside an exception phrase does not count, and of the matches at one place only the
heaviest does. The weights found, with the length of the text as a second input, give a
score between 0 and 1 by a logistic curve fitted on labelled documents that had no part in
the lexicon.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.texts import strings

# Labelled documents that the model is fitted on, at most about this many.
SAMPLE = 24_000
# Lengths of word beginnings, entries of a lexicon, the toxic documents that an entry
# needs, how far below their estimate log-odds are taken, and the least weight then.
SHORTEST, LONGEST = 3, 14
ENTRIES = 5_000
LEAST_DOCUMENTS, DEVIATIONS, LEAST_WEIGHT = 4, 1.65, 1.5
# Words added to the length of a text, so that a single match in a short one is no flood.
FLOOR = 30
# Candidates for entries, so many that an entry may come with each of its own beginnings.
CANDIDATES = ENTRIES * (LONGEST - SHORTEST + 1)
# Distinct beginnings that a task counts before it hands them on.
COUNTED = 200_000
# Code points of a text that are folded at a time.
PIECE = 1 << 20

# Phrases in which a lexicon word is harmless.
EXCEPTIONS = (
    "trash can",
    "trash bin",
    "trash bag",
    "clown fish",
    "class clown",
    "idiot proof",
    "sore loser",
    "pond scum",
)

# Letters of other alphabets, digits and signs that pass for Latin letters.
ALIKE = {
    "a": "4@аαɑ",
    "b": "8вβ",
    "c": "сϲ",
    "e": "3еεєё",
    "g": "9ɡ",
    "h": "һн",
    "i": "1!|lіιıї",
    "j": "ј",
    "k": "кκ",
    "m": "м",
    "n": "пη",
    "o": "0оοσ",
    "p": "рρ",
    "r": "г",
    "s": "5$ѕ",
    "t": "7тτ",
    "u": "υս",
    "v": "ν",
    "w": "ѡω",
    "x": "хχ",
    "y": "уγ",
    "z": "2",
}


FOLDS = {sign: letter for letter, signs in ALIKE.items() for sign in signs}


class Fold(dict):
    """Translation table of code points, filled as they come up."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        folded = FOLDS.get(char)
        if folded is None:
            plain = unicodedata.normalize("NFKD", char.lower())
            plain = "".join(c for c in plain if not unicodedata.combining(c))
            folded = "".join(FOLDS.get(c, c) for c in plain if c.isalpha() or c in FOLDS)
        self[code] = folded or ("" if unicodedata.combining(char) else " ")
        return self[code]


def folded_words(text: str, fold: Fold) -> str:
    """Folded text with single spaces between its words and at both ends."""
    return f" {' '.join(text.translate(fold).split())} "


def pieces(text: str) -> Iterator[str]:
    """Parts of a long text, cut at white space."""
    start = 0
    while start < len(text):
        end = start + PIECE
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end


@dataclass(frozen=True)
class Model:
    """A lexicon of folded word beginnings with weights, and a logistic curve."""

    weights: dict[str, float]
    intercept: float
    slopes: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS


class Scorer:
    """Scores texts by a model; holds its automaton."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.fold = model, Fold()
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.automaton.add_word(f" {entry}", (weight, len(entry) + 1))
        for phrase in model.exceptions:
            words = folded_words(phrase, self.fold)
            self.automaton.add_word(words, (None, len(words)))
        self.automaton.make_automaton()
        self.empty = not len(self.automaton)

    def inputs(self, text: str) -> tuple[float, float]:
        """Logarithms of the weight found, and of it per thousand words."""
        weight, words = 0.0, 0
        for piece in pieces(text):
            folded = folded_words(piece, self.fold)
            words += folded.count(" ")
            if self.empty:
                continue
            best: dict[int, float] = {}
            spared: list[tuple[int, int]] = []
            for end, (value, size) in self.automaton.iter(folded):
                start = end - size + 1
                if value is None:
                    spared.append((start, end))
                else:
                    best[start] = max(value, best.get(start, 0.0))
            # Both lists by position, so that each is passed once.
            spared.sort()
            at, reach = 0, 0
            for start, value in sorted(best.items()):
                while at < len(spared) and spared[at][0] <= start:
                    reach, at = max(reach, spared[at][1]), at + 1
                if reach <= start:
                    weight += value
        return math.log1p(weight), math.log1p(1000 * weight / (words + FLOOR))

    def score(self, text: str) -> float:
        slopes = zip(self.model.slopes, self.inputs(text), strict=True)
        z = self.model.intercept + sum(slope * value for slope, value in slopes)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def choose_entries(counts, toxic: int, clean: int) -> dict[str, float]:
    """Weights of a lexicon from (beginning, toxic documents, clean documents) rows.

    The weight is what the log-odds exceed at the least, `DEVIATIONS` standard deviations
    below their estimate. Of beginnings that extend each other the heaviest is kept, of
    equals the one in more toxic documents, then the longest.
    """
    rated = []
    for entry, bad, good in counts:
        cells = (bad + 0.5, toxic - bad + 0.5, good + 0.5, clean - good + 0.5)
        log_odds = math.log(cells[0] * cells[3] / (cells[1] * cells[2]))
        weight = log_odds - DEVIATIONS * math.sqrt(sum(1 / cell for cell in cells))
        if weight >= LEAST_WEIGHT:
            rated.append((-round(weight, 9), -bad, -len(entry), entry))
    chosen: dict[str, float] = {}
    begun: set[str] = set()
    for weight, _, _, entry in sorted(rated):
        if len(chosen) == ENTRIES:
            break
        starts = [entry[:i] for i in range(1, len(entry) + 1)]
        if entry not in begun and chosen.keys().isdisjoint(starts):
            chosen[entry] = -weight
            begun.update(starts)
    return chosen


def lower_log_odds(bad, good, toxic: int, clean: int):
    """The weight of `choose_entries` as a column."""
    cells = (bad + 0.5, F.lit(toxic + 0.5) - bad, good + 0.5, F.lit(clean + 0.5) - good)
    variance = sum((1 / cell for cell in cells), F.lit(0.0))
    log_odds = F.log(cells[0] * cells[3] / (cells[1] * cells[2]))
    return log_odds - DEVIATIONS * F.sqrt(variance)


def fit_curve(inputs: list[tuple[float, ...]], toxic: list[int]) -> tuple[float, tuple[float, ...]]:
    """Intercept and slopes of a logistic curve, by Newton's method with a small ridge."""
    import numpy as np

    x = np.column_stack([np.ones(len(inputs)), np.array(inputs, dtype=float)])
    y = np.array(toxic, dtype=float)
    ridge = np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(
            x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ beta
        )
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), tuple(float(b) for b in beta[1:])


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample: int = SAMPLE,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Model:
    """A model from the texts and labels of a bounded sample of labelled documents.

    `labels` has doc_id and toxic (0 or 1). About `sample` of the labelled ids are taken by
    a hash of the id; half of them give the lexicon, the others the curve. An id with
    several labels is toxic if any says so; null ids and labels and documents without
    label teach nothing. Without any toxic example nothing is learned and every text has
    the same low score. What reaches the driver is at most `CANDIDATES` counts and the
    inputs of half a sample.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
        .agg((F.max(F.col("toxic").cast("int")) > 0).cast("int").alias("toxic"))
    )
    total = known.count()
    share = min(1.0, sample / max(total, 1))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = known.filter(place < share)
    # Half the sample for the lexicon, the other half for the curve.
    part = (place < share / 2).alias("lexicon")
    taught = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
        .filter(place < share)
        .join(F.broadcast(chosen.select("doc_id", "toxic", part)), "doc_id")
        .select("toxic", "lexicon", "text")
    )

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fold = Fold()
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

        def out() -> pa.RecordBatch:
            entries = counts[0].keys() | counts[1].keys()
            bad = [counts[1][entry] for entry in entries]
            good = [counts[0][entry] for entry in entries]
            batch = pa.RecordBatch.from_arrays(
                [pa.array(list(entries), pa.string()), pa.array(bad), pa.array(good)],
                names=["entry", "bad", "good"],
            )
            counts[0].clear()
            counts[1].clear()
            return batch

        for batch in batches:
            for toxic, text in zip(
                batch.column(0).to_pylist(), strings(batch.column(1)), strict=True
            ):
                words: set[str] = set()
                for piece in pieces(text):
                    words.update(folded_words(piece, fold).split())
                found = {
                    word[:size]
                    for word in words
                    for size in range(SHORTEST, min(len(word), LONGEST) + 1)
                }
                found.add("")  # counts the documents
                counts[toxic].update(found)
                if len(counts[0]) + len(counts[1]) > COUNTED:
                    yield out()
        yield out()

    totals = (
        taught.filter("lexicon")
        .select("toxic", "text")
        .mapInArrow(count, "entry string, bad bigint, good bigint")
        .groupBy("entry")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    )
    documents = {
        r.toxic: r["count"] for r in taught.filter("lexicon").groupBy("toxic").count().collect()
    }
    toxic, clean = documents.get(1, 0), documents.get(0, 0)
    # The heaviest of all candidates; `choose_entries` weighs them again to the last digit.
    rows = (
        totals.filter((F.col("bad") >= LEAST_DOCUMENTS) & (F.col("entry") != ""))
        .withColumn("weight", lower_log_odds(F.col("bad"), F.col("good"), toxic, clean))
        .filter(F.col("weight") >= LEAST_WEIGHT - 1e-6)
        .orderBy(
            F.desc(F.round("weight", 9)), F.desc("bad"), F.desc(F.length("entry")), "entry"
        )
        .limit(CANDIDATES)
        .select("entry", "bad", "good")
        .collect()
    )
    weights = choose_entries([tuple(r) for r in rows], toxic, clean)
    draft = Model(weights, 0.0, (0.0, 0.0), exceptions)

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(draft)
        for batch in batches:
            found = [scorer.inputs(x) for x in strings(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x[i] for x in found], pa.float64()) for i in (0, 1))],
                names=["toxic", "a", "b"],
            )

    rows = (
        taught.filter("NOT lexicon")
        .select("toxic", "text")
        .mapInArrow(measure, "toxic int, a double, b double")
        .collect()
    )
    if not weights or not any(r.toxic for r in rows) or all(r.toxic for r in rows):
        return Model({}, -3.0, (0.0, 0.0), exceptions)
    intercept, slopes = fit_curve([(r.a, r.b) for r in rows], [r.toxic for r in rows])
    return Model(weights, intercept, slopes, exceptions)


def score_documents(
    docs: DataFrame, model: Model, *, text: str = "text", into: str = "score"
) -> DataFrame:
    """All columns of `docs` and `into`, the score of the whole text from 0 to 1.

    A null text counts as empty; an empty text has the score of one without any match.
    Equal texts have equal scores whatever the other columns hold. A column named as
    `into` is replaced. Nothing is shuffled.
    """

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(model)
        for batch in batches:
            texts = strings(batch.column(batch.schema.get_field_index(text)))
            scores = pa.array([scorer.score(x) for x in texts], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, scores], names=[*batch.schema.names, into]
            )

    rows = docs.drop(into)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(score, f"{types}, `{into}` double")
