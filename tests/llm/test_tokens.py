from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowloom.llm.bpe import MergeReplay, bpe_decode, bpe_encode, pattern_encoder
from flowloom.llm.packing import (
    OpenWindows,
    added_tokens,
    best_fit_decreasing,
    library_encoder,
    pack_documents,
)
from flowloom.llm.texts import word_segments
from flowloom.llm.tokens import read_ranks

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
DEFINITION = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={}
    )


def samples() -> list[str]:
    random.seed(7)
    parts = [" ", " ", "\n", "\t", "a", "b", "'s", "1", "é", "\x1c", "　", "<|endoftext|>"]
    parts += ["word", "漢", " tion", "aaaaaa", "ababab", "\x85", "!!", "😀"]
    mixed = ["".join(random.choices(parts, k=random.randint(0, 14))) for _ in range(3000)]
    letters = ["".join(random.choices("aeiont  ", k=40)) for _ in range(2000)]
    return mixed + letters + ["", "a" * 3001]


def test_merge_replay_equals_the_library(library):
    encoder = pattern_encoder(MergeReplay(read_ranks(RANKS)), PATTERN)
    for text, ids in zip(samples(), encoder.encode(samples()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text


def test_joined_words_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(DEFINITION)
    tokenizer.encode_special_tokens = True
    with open(DEFINITION, encoding="utf-8") as source:
        encoder = library_encoder(source.read(), PATTERN)
    for text, ids in zip(samples(), encoder.encode(samples()), strict=True):
        found = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == found, text


END = "<|endoftext|>"
WITH_ADDED = [
    f"a {END} b",
    f"a  {END}  b",
    f"a\t {END}\n b",
    f"{END}{END}",
    f" {END} ",
    f"x{END[:-1]}{END}y",
    f"{'word ' * 300_000} {END} {END}tail",
]


def test_added_tokens_have_their_own_ids():
    tokenizer = Tokenizer.from_file(DEFINITION)
    with open(DEFINITION, encoding="utf-8") as source:
        definition = source.read()
    encoder = library_encoder(definition, PATTERN, added_tokens(definition))
    texts = WITH_ADDED + samples()
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        found = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == found, text[-80:]


def test_packed_added_tokens(texts_of):
    tokenizer = Tokenizer.from_file(DEFINITION)
    pieces = pack_documents(texts_of(WITH_ADDED), DEFINITION, PATTERN).collect()
    for i, text in enumerate(WITH_ADDED):
        own = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        whole = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert b"".join(bytes(p.ids) for p in own) == np.array(whole, dtype="<u4").tobytes()
        assert {p.doc_tokens for p in own} == {len(whole)}


def test_merges_that_give_lower_ranks():
    for seed in range(150):
        chosen = random.Random(seed)
        more = list({bytes(chosen.choices(b"abc", k=chosen.randint(2, 4))) for _ in range(14)})
        chosen.shuffle(more)
        tokens = [bytes([b]) for b in range(256)] + more
        replay = MergeReplay({token: i for i, token in enumerate(tokens)})
        words = [bytes(chosen.choices(b"abc", k=chosen.randint(0, 12))) for _ in range(40)]
        ids, counts = replay.words(words)
        for word, found in zip(words, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
            assert found.tolist() == replay.one(word)


def test_vocabulary_without_a_byte_is_an_error():
    with pytest.raises(ValueError, match="lacks"):
        MergeReplay({b"a": 0})


def test_encode_and_decode_tables(spark, odd_texts, library):
    rows = [(i, x, [0]) for i, x in enumerate(odd_texts * 2)]
    df = spark.createDataFrame(rows, "n int, text string, ids array<int>")
    decoded = bpe_decode(bpe_encode(df, RANKS, PATTERN), RANKS).collect()
    assert len(decoded) == len(rows)
    for row, (n, text, _) in zip(sorted(decoded), rows, strict=True):
        assert row.n == n
        assert row.ids == library.encode_ordinary(text or "")
        assert bytes(row.decoded).decode() == (text or "")
    assert bpe_encode(df.limit(0), RANKS, PATTERN).count() == 0


def test_long_texts_are_cut_where_nothing_changes(library):
    text = "word  and\n more " * 40
    pieces = list(word_segments(text, 50))
    assert "".join(pieces) == text and len(pieces) > 5
    ids = [i for piece in pieces for i in library.encode_ordinary(piece)]
    assert ids == library.encode_ordinary(text)


def test_best_fit_takes_the_tightest_window():
    windows = OpenWindows(10)
    for number, room in enumerate([9, 4, 6, 4]):
        windows.put(room, number)
    assert windows.take(5) == (6, 2)
    assert windows.take(4)[0] == 4
    assert windows.take(10) is None
    random.seed(3)
    sizes = [random.randint(1, 99) for _ in range(800)]
    rooms: list[int] = []
    expected = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(room, n) for n, room in enumerate(rooms) if room >= sizes[i]]
        if fits:
            expected[i] = min(fits)[0]
            rooms[min(fits)[1]] -= sizes[i]
        else:
            expected[i] = 100
            rooms.append(100 - sizes[i])
    placed = best_fit_decreasing(sizes, 100)
    assert {i: 100 - offset for i, (_, offset) in enumerate(placed)} == expected


def test_packing_holds_every_token_once(spark, odd_texts):
    rows = [(i if i % 5 else None, x, "x") for i, x in enumerate(odd_texts * 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    pieces = pack_documents(df, DEFINITION, PATTERN, window=64, group=7).collect()
    tokenizer = Tokenizer.from_file(DEFINITION)
    expected = sum(len(tokenizer.encode(x or "").ids) + 1 for _, x, _ in rows)
    assert sum(p.length for p in pieces) == expected
    places: dict[int, list] = {}
    for p in pieces:
        assert len(p.ids) == 4 * p.length
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 64
    by_doc = sorted((p for p in pieces if p.doc_id == 7), key=lambda p: p.start)
    ids = b"".join(bytes(p.ids) for p in by_doc)
    whole = [*tokenizer.encode(odd_texts[7]).ids, 1]
    assert ids == np.array(whole, dtype="<u4").tobytes() and by_doc[0].doc_tokens == len(whole)
    checked = spark.createDataFrame([(bytearray(ids),)], "ids binary").select(F.crc32("ids"))
    assert checked.first()[0] == zlib.crc32(ids)
    assert pack_documents(df.limit(0), DEFINITION, PATTERN).count() == 0
