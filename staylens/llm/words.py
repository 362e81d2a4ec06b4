"""Small text helpers that run inside tasks, on UTF-8 bytes."""

from __future__ import annotations

import pyarrow as pa

LOWER_ASCII = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
)

# Lower-cases A-Z and blanks every byte that is neither a digit, a letter nor part of a
# character beyond ASCII.
_WORD_BYTES = bytes(
    lower if chr(lower).isalnum() or byte >= 0x80 else 0x20
    for byte, lower in enumerate(LOWER_ASCII)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of digits, ASCII letters and characters beyond ASCII."""
    return text.translate(_WORD_BYTES).split()


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The values of an Arrow string column as UTF-8 bytes; null stays None."""
    binary = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(binary).to_pylist()


def extended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], [*batch.schema.names, *columns]
    )
