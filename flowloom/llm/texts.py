"""Reading and cutting texts inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator


def arrow_schema(ddl: str):
    """Arrow schema of a DDL string, for the driver to hand to its tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# Code points after which a long text is cut where a cut changes nothing.
SEGMENT = 1 << 20


def strings(column) -> list[str]:
    """The texts of an Arrow column; null is the empty text."""
    return [text or "" for text in column.to_pylist()]


def word_segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Pieces of about `size` code points, cut before a space that a word follows.

    Neither words nor the matches of the tokenizers' pattern reach over such a place. A
    piece is longer where the text has no such place.
    """
    start, n = 0, len(text)
    while n - start > size:
        cut = text.find(" ", start + size)
        while cut != -1 and (cut + 1 >= n or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[start:cut]
        start = cut
    if start or n:
        yield text[start:]
