"""The words that scans of this library see: ASCII letters in lower case, digits, and everything beyond ASCII."""

from __future__ import annotations

#: Byte by byte: A-Z to a-z, other ASCII but digits and a-z to a space; bytes of longer characters stay.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """UTF-8 words of a text: runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z; null has none."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()
