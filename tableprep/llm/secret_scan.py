"""Secrets in text, confirmed by their structure.

Three fixed patterns give the plain findings. Beyond those, a candidate in
base64 or hex is decoded and reported only if the bytes are what they claim to
be: a DER key whose nested lengths fit exactly, an OpenSSH key whose
length-prefixed fields fit exactly, or a signed token with a JSON header that
names its algorithm. Nothing is reported by its look alone.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

from pyspark.sql import DataFrame

from tableprep.llm.common import find_spans

#: In the order in which findings at one place are listed.
BASE = ("assign", "access", "hex")
CONFIRMED = ("pem", "openssh", "der", "jwt")
KINDS = BASE + CONFIRMED

# The plain patterns.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

PEM = re.compile(
    r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----([A-Za-z0-9+/=\s:,-]*?)-----END \1-----"
)
JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}+={0,2}")
HEXES = re.compile(r"(?:[0-9a-f]{64,}+|[0-9A-F]{64,}+)")

_WORDY = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
_IS_HEX = bytes(49 if bytes([x]) in b"0123456789abcdefABCDEF" else 48 for x in range(256))
_IS_BASE64 = bytes(49 if bytes([x]) in _WORDY else 48 for x in range(256))


def _der_items(data: bytes, start: int, stop: int) -> list[tuple[int, int, int]] | None:
    """Tag, content start and content stop of each item, or None if the lengths don't fit."""
    items = []
    while start < stop:
        if stop - start < 2:
            return None
        tag, length = data[start], data[start + 1]
        start += 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or start + n > stop or data[start] == 0:
                return None
            length = int.from_bytes(data[start : start + n], "big")
            start += n
            if length < 0x80:
                return None
        if start + length > stop:
            return None
        items.append((tag, start, start + length))
        start += length
    return items


def is_der_key(data: bytes) -> bool:
    """A DER sequence that spans all bytes, whose nested lengths fit, with a number or string of key size."""
    if len(data) < 32 or data[0] != 0x30:
        return False
    sized, seen, level = False, 0, [(0, len(data), 0)]
    while level:
        start, stop, depth = level.pop()
        items = _der_items(data, start, stop)
        if items is None or (depth == 0 and len(items) != 1) or depth > 16:
            return False
        for tag, a, b in items:
            seen += 1
            if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0:
                level.append((a, b, depth + 1))
            elif tag in (0x02, 0x03, 0x04):
                sized |= b - a >= 16
            elif tag not in (0x01, 0x05, 0x06, 0x0A, 0x0C, 0x13, 0x16, 0x17, 0x18) and tag & 0xC0 != 0x80:
                return False
    return sized and seen >= 3


def is_openssh_key(data: bytes) -> bool:
    """An OpenSSH private key: its mark, then fields whose lengths fit exactly."""
    mark = b"openssh-key-v1\0"
    if not data.startswith(mark):
        return False

    def field(at: int) -> tuple[bytes, int]:
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            raise ValueError
        return data[at + 4 : at + 4 + size], at + 4 + size

    try:
        at = len(mark)
        for _ in range(3):  # cipher, key derivation, its options
            _, at = field(at)
        count = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if not 1 <= count <= 64:
            return False
        for _ in range(count + 1):  # public keys, then the private part
            body, at = field(at)
            if not body:
                return False
        return at == len(data)
    except ValueError:
        return False


def decode64(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """Three parts; the first is a JSON object with an ``alg``, the second a JSON object."""
    head, body, signature = text.split(".")
    try:
        header, claims = (json.loads(decode64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(claims, dict):
        return False
    algorithm = header.get("alg")
    return isinstance(algorithm, str) and (bool(signature) or algorithm.lower() == "none")


def _key_kind(data: bytes | None) -> str | None:
    if data is None:
        return None
    return "openssh" if is_openssh_key(data) else "der" if is_der_key(data) else None


def _runs(text: str, classes: bytes, least: int) -> bool:
    """Whether characters of a class follow each other so often; other than ASCII ends a run."""
    return b"1" * least in text.encode("ascii", "replace").translate(classes)


def find(text: str) -> list[tuple[str, int, int, bool]]:
    """Kind, start, stop (code points) and whether a plain pattern found it, by start, then ``KINDS``."""
    out = []
    low = text.lower()
    if any(x in low for x in KEYWORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if _runs(text, _IS_HEX, 32):
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        for m in HEXES.finditer(text):
            if len(m[0]) % 2 == 0 and (kind := _key_kind(bytes.fromhex(m[0]))):
                out.append((kind, *m.span()))
    keys: list[tuple[int, int]] = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            lines = [x for x in m[2].split("\n") if ":" not in x]
            if _key_kind(decode64("".join("".join(lines).split()))):
                out.append(("pem", *m.span()))
                keys.append(m.span())
    if "eyJ" in text:
        for m in JWT.finditer(text):
            if is_signed_token(m[0]):
                out.append(("jwt", *m.span()))
                keys.append(m.span())
    if _runs(text, _IS_BASE64, 40):
        for m in BASE64.finditer(text):
            inside = any(a <= m.start() < b for a, b in keys)
            if not inside and (kind := _key_kind(decode64(m[0]))):
                out.append((kind, *m.span()))
    out.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    return [(*x, x[0] in BASE) for x in out]


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, stop, plain; code points, stop exclusive) of every row.

    A null text is the empty one and has no spans. Repeated rows and rows
    without an id each give a row. Other columns are not read.
    """
    return find_spans(docs, find)
