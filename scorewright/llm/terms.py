"""Terms of texts as bytes: runs of letters, of digits where asked for, and of everything beyond ASCII."""

from __future__ import annotations


def term_table(digits: bool = False) -> bytes:
    """A table for ``bytes.translate`` that keeps the bytes of terms, with A-Z in lower case, and turns all others into blanks.

    In UTF-8 every byte of a character beyond ASCII is above 0x7F, so the table needs no decoding.
    """
    kept = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)} | ({*range(0x30, 0x3A)} if digits else set())
    return bytes(b if b in kept else 0x20 for b in range(256)).lower()


def terms(text: bytes | None, table: bytes) -> list[bytes]:
    """The terms of a text in their order, repeats included; none of a null."""
    return text.translate(table).split() if text else []
