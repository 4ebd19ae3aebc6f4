"""Signed envelopes: the document inside, found by walking tags, lengths and values."""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator

# The object identifier of plain data in a signed envelope, and the first bytes of formats.
DATA = bytes.fromhex("06092a864886f70d010701")
MAGIC = [(b"%PDF-", "pdf"), (b"PK\x03\x04", "zip"), (b"{\\rtf", "rtf"), (b"<?xml", "xml"), (b"<html", "html"), (b"<!DOCTYPE html", "html")]
#: Envelopes and values in one another at most.
DEPTH = 32


def _head(data: bytes, at: int, end: int) -> tuple[int, int | None, int]:
    """(tag, length, place of the value) of the element at a place; the length is None if it is left open."""
    tag, at = data[at], at + 1
    if tag & 0x1F == 0x1F:
        while at < end and data[at] & 0x80:
            at += 1
        at += 1
    if at >= end:
        raise ValueError("no length")
    size, at = data[at], at + 1
    if size == 0x80:
        return tag, None, at
    if size > 0x80:
        n = size & 0x7F
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
    if at + size > end:
        raise ValueError("longer than its surroundings")
    return tag, size, at


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(tag, first, last) of the elements in data[at:end]; ValueError where a length leaves the bytes.

    An element of open length ends with two zero bytes after its last part, which only walking its parts finds.
    """
    while at < end:
        tag, size, at = _head(data, at, end)
        last = _ending(data, at, end) if size is None else at + size
        yield tag, at, last
        at = last + 2 if size is None else last


def _ending(data: bytes, at: int, end: int) -> int:
    """Where the two zero bytes are that end the parts from at on."""
    inside = 1
    while at < end:
        if data[at : at + 2] == b"\x00\x00":
            inside, at = inside - 1, at + 2
            if not inside:
                return at - 2
            continue
        _, size, at = _head(data, at, end)
        inside += size is None
        at += size or 0
        if inside > DEPTH:
            raise ValueError("too deep")
    raise ValueError("no end")


def _joined(data: bytes, tag: int, first: int, last: int, depth: int = 0) -> bytes:
    """A string's bytes; those of a string in chunks are joined."""
    if not tag & 0x20 or depth > DEPTH:
        return data[first:last]
    return b"".join(_joined(data, t, a, b, depth + 1) for t, a, b in elements(data, first, last))


def _payload(data: bytes, first: int, last: int, depth: int) -> bytes | None:
    found = False
    for tag, a, b in elements(data, first, last):
        if tag == 0x06 and data[a - 2 : b] == DATA:
            found = True
        elif found and tag == 0xA0:
            return b"".join(_joined(data, t, x, y) for t, x, y in elements(data, a, b) if t & 0x1F == 0x04)
        elif tag & 0x20 and depth < DEPTH:
            inside = _payload(data, a, b, depth + 1)
            if inside is not None:
                return inside
    return None


def _binary(data: bytes) -> bytes:
    """Bytes of an envelope that came as text, with or without its BEGIN and END lines."""
    if re.match(rb"\s*(?:-----BEGIN [^-]+-----)?[A-Za-z0-9+/=\s]{64}", data):
        body = re.sub(rb"-----[^-]+-----|\s", b"", data)
        try:
            return base64.b64decode(body, validate=True)
        except (binascii.Error, ValueError):
            return data
    return data


def signed_document(data: bytes) -> bytes | None:
    """The document in a signed envelope: its chunks joined, of definite or indefinite length, in bytes or as text; else None."""
    data = _binary(data)
    if data[:1] != b"\x30":
        return None
    try:
        return _payload(data, 0, len(data), 0)
    except (ValueError, IndexError):
        return None


def marked_document(data: bytes) -> bytes | None:
    """A PDF or an archive somewhere in bytes that are no envelope, by its first and last marks."""
    start = data.find(b"%PDF-")
    if start >= 0:
        end = data.rfind(b"%%EOF")
        return data[start : end + 5 if end > start else None]
    start = data.find(b"PK\x03\x04")
    return data[start:] if start >= 0 else None


def inner_name(path: str, data: bytes) -> str:
    """The name of the document in path: path without its last ending if one remains, else with one for the first bytes."""
    base = path.rsplit("/", 1)[-1]
    base = re.sub(r"\.p7[ms]$", "", base, flags=re.I)
    if re.search(r"\.[A-Za-z0-9]{1,5}$", base):
        return base
    kind = next((k for m, k in MAGIC if data[: len(m)].lower() == m.lower()), "bin")
    return f"{base or 'document'}.{'p7m' if data[:1] == b'0' and signed_document(data) is not None else kind}"


def documents(path: str, data: bytes, depth: int = 10) -> Iterator[tuple[str, bytes | None, str | None]]:
    """(path, content, problem) of the document in an envelope, through envelopes in envelopes."""
    found = signed_document(data)
    if found is None:
        found = marked_document(data)
    if found is None:
        yield path, None, "no_payload"
        return
    name = f"{path}/{inner_name(path, found)}"
    if not re.search(r"\.p7m$", name, re.I):
        yield name, found, None
    elif depth > 1:
        yield from documents(name, found, depth - 1)
    else:
        yield name, None, "too_deep"
