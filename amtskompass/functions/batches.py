"""Arrow batches handed to Python helpers in small pieces.

Spark sends up to ten thousand rows at once, however long their texts are.  A helper that turns such a batch into Python
objects needs many times its size; piece by piece it needs that only for the rows of one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc

PIECE_ROWS = 1024
PIECE_BYTES = 1 << 20  # a longer text is a piece of its own


def pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """Texts of an Arrow array in order, as lists of at most ``PIECE_ROWS`` members and, but for one long text, ``PIECE_BYTES``."""
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > begin and (i - begin == PIECE_ROWS or size + n > PIECE_BYTES):
            yield texts.slice(begin, i - begin).to_pylist()
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield texts.slice(begin).to_pylist()
