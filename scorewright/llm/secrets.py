"""Secrets in text: what looks like one, and what decodes to one.

Assignments, access keys and long hexadecimal runs are reported by their form. Beyond these, runs of
base64 or hexadecimal digits are decoded and reported only if their structure bears out a secret: a
private key, encrypted or not, whose nested ASN.1 lengths fit exactly, an OpenSSH key whose
length-prefixed fields can be read, the text of a key file, or a signed token whose header and claims
are JSON and name an algorithm. A key may begin anywhere in a run of digits, and its lines may be
broken by line ends, also by ones that are written out with a backslash.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, small_batches, texts_of

#: Kinds of finding, in the order of spans that begin at one place (fixed values).
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "openssh", "jwt")

#: Patterns of the base kinds (fixed values); letters of the names in either case, ASCII only.
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates for decoding.
TOKEN_HEAD = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?=\.[A-Za-z0-9_-]++\.)")
MARK, JSON = re.compile("eyJ"), json.JSONDecoder()
TOKEN_TAIL = re.compile(r"\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
PEM = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----([^-]*(?:-(?!----)[^-]*)*)-----END [A-Z0-9 ]*PRIVATE KEY-----")
#: What breaks the lines of a key, and the digits up to its end.
_BREAK = r"(?:\r?\n|\\r\\n|\\n)[\x20\t]*"
WRAPPED = re.compile(rf"[A-Za-z0-9+/_-]++(?:{_BREAK}[A-Za-z0-9+/_-]++)*+")
WRAPPED_LINE = re.compile("[A-Za-z0-9+/_-]*+")
PADDING = re.compile("={0,2}")
BREAK = re.compile(_BREAK)
#: Where digits may begin an ASN.1 sequence, OpenSSH's mark or a key file's first line.
BASE64 = re.compile(r"(?=M[A-P][A-Za-z0-9+/_-]{14}|b3BlbnNzaC1rZXktdjEA|LS0tLS1CRUdJTi)")
HEX_KEY = re.compile(r"(?=(?:30(?:[0-7][0-9a-f]|81[0-9a-f]{2}|82[0-9a-f]{4}|83[0-9a-f]{6}|84[0-9a-f]{8})(?:02010[01]|30)|6f70656e7373682d6b65792d763100)[0-9a-f]{34})", re.I | re.A)
HEX_DIGITS = re.compile("[0-9A-Fa-f]++")
#: The fewest digits of a key.
LEAST_DIGITS = 40
#: Bytes of a candidate that are decoded at once.
HEAD = 48
#: More values than any key has side by side.
MOST_CHILDREN = 16
#: Object identifiers of encryption by a password begin like these: PKCS #5 and PKCS #12.
ENCRYPTIONS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
OPENSSH = b"openssh-key-v1\0"


class Digits:
    """Bytes that base64 or hexadecimal digits stand for from a place on, decoded just where they are looked at."""

    def __init__(self, digits: str, at: int, n: int, per: tuple[int, int], decode: Callable[[str], bytes]) -> None:
        self.digits, self.at, self.n, self.decode = digits, at, n, decode
        self.bytes_, self.width = per
        self.head = b""
        self.head = self[: min(n, HEAD)]

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, k: int | slice) -> int | bytes:
        start, stop = (k, k + 1) if isinstance(k, int) else k.indices(self.n)[:2]
        if stop <= len(self.head):
            return self.head[k]
        first = start // self.bytes_
        got = self.decode(self.digits[self.at + first * self.width : self.at + -(-stop // self.bytes_) * self.width])
        got = got[start - first * self.bytes_ : stop - first * self.bytes_]
        return got[0] if isinstance(k, int) else got


Bytes = bytes | Digits


def tlv(raw: Bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte, end) of the ASN.1 value at ``at``, or None if its length doesn't fit before ``end``."""
    if at + 2 > end:
        return None
    tag, n = raw[at], raw[at + 1]
    at += 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or at + size > end:
            return None
        n = int.from_bytes(raw[at : at + size], "big")
        at += size
    return (tag, at, at + n) if at + n <= end else None


def children(raw: Bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The values that fill ``at`` to ``end`` exactly, or None, also where they are more than a key has."""
    out = []
    while at < end:
        if len(out) >= MOST_CHILDREN or (one := tlv(raw, at, end)) is None:
            return None
        out.append(one)
        at = one[2]
    return out


def is_private_key(raw: Bytes) -> bool:
    """Whether the bytes are one ASN.1 private key: RSA or DSA numbers, a wrapped key or a curve's key."""
    top = tlv(raw, 0, len(raw))
    if top is None or top[0] != 0x30 or top[2] != len(raw):
        return False
    parts = children(raw, top[1], top[2])
    if not parts or len(parts) < 2 or parts[0][0] != 0x02:
        return False
    version = raw[parts[0][1] : parts[0][2]]
    tags = [tag for tag, _, _ in parts]
    if version not in (b"\0", b"\1"):
        return False
    if tags[1] == 0x02:  # its numbers one after the other
        return len(tags) in (6, 9) and all(tag == 0x02 and end > at for tag, at, end in parts)
    if tags[1] == 0x30 and len(tags) > 2 and tags[2] == 0x04:  # an algorithm and the key within
        inner = children(raw, parts[1][1], parts[1][2])
        return bool(inner) and inner[0][0] == 0x06 and parts[2][2] > parts[2][1]
    return tags[1] == 0x04 and parts[1][2] - parts[1][1] >= 16 and all(tag in (0xA0, 0xA1) for tag in tags[2:])


def is_encrypted_key(raw: Bytes) -> bool:
    """Whether the bytes are one ASN.1 private key encrypted by a password: the encryption and what it gave."""
    top = tlv(raw, 0, len(raw))
    if top is None or top[0] != 0x30 or top[2] != len(raw):
        return False
    parts = children(raw, top[1], top[2])
    if not parts or [tag for tag, _, _ in parts] != [0x30, 0x04] or parts[1][2] - parts[1][1] < 16:
        return False
    inner = children(raw, parts[0][1], parts[0][2])
    return bool(inner) and inner[0][0] == 0x06 and raw[inner[0][1] : inner[0][2]].startswith(ENCRYPTIONS)


def is_openssh_key(raw: Bytes) -> bool:
    """Whether the bytes begin as an OpenSSH private key, with three readable fields and a number of keys."""
    if raw[: len(OPENSSH)] != OPENSSH:
        return False
    at = len(OPENSSH)
    for _ in range(3):
        if at + 4 > len(raw):
            return False
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return at + 4 <= len(raw) and 1 <= int.from_bytes(raw[at : at + 4], "big") <= 16


def openssh_end(raw: Bytes) -> int:
    """Where an OpenSSH private key ends: after its public keys and its private part, or with the bytes if it is cut short."""
    at = len(OPENSSH)
    for _ in range(3):
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    keys, at = int.from_bytes(raw[at : at + 4], "big"), at + 4
    for _ in range(keys + 1):
        if at + 4 > len(raw):
            return len(raw)
        at += 4 + int.from_bytes(raw[at : at + 4], "big")
    return min(at, len(raw))


def decoded(digits: str) -> bytes | None:
    """Bytes of base64 digits in either alphabet, padded or not; None if they are none."""
    digits = digits.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(digits + "=" * (-len(digits) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(digits: str) -> bool:
    """Whether header and claims of a dotted token are JSON objects and the header names an algorithm."""
    head, claims, _ = digits.split(".")
    try:
        head, claims = (json.loads(decoded(x) or b"") for x in (head, claims))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(claims, dict) and isinstance(head.get("alg"), str)


def json_end(text: str, at: int) -> int | None:
    """Where the JSON value that begins at a place ends, or None; read in parts that grow, so that a wrong one costs no more than it is long."""
    size = 256
    while True:
        part = text[at : at + size]
        try:
            return at + JSON.raw_decode(part)[1]
        except RecursionError:
            return None
        except json.JSONDecodeError as failure:
            # a cut is told by a string without end, or by an error where the part ends
            if at + size >= len(text) or failure.pos < len(part) - 8 and not failure.msg.startswith("Unterminated"):
                return None
        size *= 4


def signed_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the signed tokens: each run before a dot is tried from every mark of a header in it on, the first that fits counts.

    A run is decoded once for each of the four ways to cut it into groups of digits, and a header read from
    its mark only as far as it is JSON.
    """
    done = 0
    for m in TOKEN_HEAD.finditer(text):
        if m.start() < done or text.find("eyJ", m.start(), m.end()) < 0:
            continue
        end = TOKEN_TAIL.match(text, m.end()).end()
        claims = decoded(text[m.end() + 1 : end].split(".")[0])
        if not claims or claims[:1] != b"{":
            continue
        ways: dict[int, str] = {}
        for mark in MARK.finditer(text, m.start(), m.end()):
            way = (mark.start() - m.start()) % 4
            if way not in ways:
                ways[way] = (decoded(text[m.start() + way : m.end()]) or b"").decode("latin-1")
            stop = json_end(ways[way], (mark.start() - m.start() - way) // 4 * 3)
            if stop is not None and len(ways[way]) - stop <= 8 and not ways[way][stop:].strip() and is_signed_token(text[mark.start() : end]):
                yield "jwt", mark.start(), end
                done = end
                break


def _key_kind(raw: Bytes | None) -> str | None:
    if raw is None:
        return None
    return "key" if is_private_key(raw) or is_encrypted_key(raw) else "openssh" if is_openssh_key(raw) else None


def _file_kind(body: str) -> str | None:
    """The kind of key between the first and the last line of a key file, whose header lines may say that it is encrypted."""
    lines = [line.strip(" \t\"'\\") for line in re.sub(r"\\[rnt]", "\n", body).splitlines()]
    raw = decoded("".join(line for line in lines if ":" not in line))
    encrypted = any(line.startswith(("DEK-Info:", "Proc-Type: 4,ENCRYPTED")) for line in lines)
    return "key" if encrypted and raw and len(raw) >= 16 and len(raw) % 8 == 0 else _key_kind(raw)


def _length(raw: Bytes) -> int:
    """The length that the header of an ASN.1 sequence gives it, if a version or a sequence comes first in it; else 0."""
    size = raw[1] & 0x7F if raw[1] & 0x80 else 0
    if raw[0] != 0x30 or raw[1] == 0x80 or size > 4:
        return 0
    inner = raw[2 + size : 5 + size]
    if inner[:1] != b"\x30" and inner not in (b"\2\1\0", b"\2\1\1"):
        return 0
    return 2 + size + (int.from_bytes(raw[2 : 2 + size], "big") if size else raw[1])


class Run:
    """Base64 digits on one or more lines, taken apart once for all the keys that may begin in them."""

    def __init__(self, text: str, start: int) -> None:
        self.start, self.end = start, WRAPPED.match(text, start).end()
        run = text[start : self.end]
        breaks = [m.span() for m in BREAK.finditer(run)] if "\n" in run or "\\" in run else []
        self.digits = BREAK.sub("", run) if breaks else run
        # by the number of digits before each break, how much longer the text is than the digits after it
        self.before = [a - skipped for (a, _), skipped in zip(breaks, accumulate((b - a for a, b in breaks), initial=0), strict=False)]
        self.longer = [0, *accumulate(b - a for a, b in breaks)]
        self.places = [b for _, b in breaks]
        self.ways: dict[int, str] = {}

    def digit(self, at: int) -> int:
        """The number of digits before a place of the text that is a digit."""
        return at - self.start - self.longer[bisect_right(self.places, at - self.start)]

    def place(self, digit: int) -> int:
        """The place in the text right after so many digits."""
        return self.start + digit + self.longer[bisect_left(self.before, digit)]

    def read(self, digit: int, most: int | None = None) -> Digits:
        """The bytes from a digit on, of at most so many digits."""
        n = len(self.digits) - digit if most is None else most
        return Digits(self.digits[: digit + n] if most is None else self.digits, digit, n * 3 // 4, (3, 4), lambda x: decoded(x[: len(x) - (len(x) % 4 == 1)]) or b"")

    def text_from(self, digit: int) -> tuple[str, int]:
        """What the digits from a place on decode to, as the text of this way to group them, and the place in it."""
        way = digit % 4
        if way not in self.ways:
            own = self.digits[way:]
            self.ways[way] = (decoded(own) or decoded(own[: len(own) // 4 * 4]) or b"").decode("latin-1")
        return self.ways[way], digit // 4 * 3


def _encoded_key(text: str, at: int, run: Run) -> tuple[str, int] | None:
    """(kind, end) of the key whose base64 digits begin at ``at`` in ``run``, or None; it looks just at what tells a key."""
    digit = run.digit(at)
    left = len(run.digits) - digit
    if text[at] == "L":
        inside = PEM.match(*run.text_from(digit))
        kind, need = _file_kind(inside[1]) if inside else None, left
    elif text[at] == "M":
        need = -(-_length(run.read(digit, min(left, 12))[:9].ljust(9, b"\0")) * 4 // 3)
        kind = _key_kind(run.read(digit, need)) if LEAST_DIGITS <= need <= left else None
    else:
        raw = run.read(digit)
        kind = "openssh" if is_openssh_key(raw) else None
        need = min(-(-openssh_end(raw) * 4 // 3), left) if kind else 0
    if kind is None:
        return None
    end = run.place(digit + need)
    if kind == "openssh":  # its padding may go on to the end of the line
        end = WRAPPED_LINE.match(text, end).end()
    elif re.match("[A-Za-z0-9+]", text[end : end + 1]):
        return None  # more digits belong to it
    return kind, PADDING.match(text, end).end()


class HexRun:
    """Hexadecimal digits in a row."""

    def __init__(self, text: str, start: int) -> None:
        self.start, self.end = start, HEX_DIGITS.match(text, start).end()


def _hexadecimal_key(text: str, at: int, run: HexRun) -> tuple[str, int] | None:
    """(kind, end) of the key whose hexadecimal digits begin at ``at``, or None; it looks just at what tells a key."""

    def read(n: int) -> Digits:
        return Digits(text, at, n, (1, 2), bytes.fromhex)

    left = (run.end - at) // 2
    if read(left)[: len(OPENSSH)] == OPENSSH:
        return ("openssh", at + 2 * openssh_end(read(left))) if is_openssh_key(read(left)) else None
    n = _length(read(left)[:9].ljust(9, b"\0"))
    kind = _key_kind(read(n)) if 0 < n <= left else None
    return (kind, at + 2 * n) if kind and not re.match("[0-9A-Fa-f]", text[at + 2 * n : at + 2 * n + 1]) else None


def findings(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings by start, then kind as listed; code points, end exclusive."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    more = [*signed_tokens(text)] if "eyJ" in text else []
    for m in PEM.finditer(text) if "-----BEGIN " in text else ():
        if kind := _file_kind(m[1]):
            more.append((kind, m.start(), m.end()))
    files = sorted((start, end) for _, start, end in more)
    for candidates, key, kind in ((BASE64, _encoded_key, Run), (HEX_KEY, _hexadecimal_key, HexRun)):
        done, run, within, last = 0, None, 0, 0
        for m in candidates.finditer(text):
            at = m.start()
            while within < len(files) and files[within][0] <= at:
                last = max(last, files[within][1])
                within += 1
            if at < done or at < last:
                continue
            if run is None or at >= run.end:
                run = kind(text, at)
            if one := key(text, at, run):
                more.append((one[0], at, one[1]))
                done = one[1]
    return sorted({*found, *more}, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans: array of kind, start, end) for each row of ``docs`` (doc_id, text).

    A null or empty text has no spans; null or repeated doc_ids stay; extra columns are left out.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in findings(t)] for t in texts_of(batch)]
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return documents(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the base kinds, SHA-256 of their spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def only(*kinds):
        return F.filter("spans", lambda x: x["kind"].isin(*kinds))

    return scanned.select(
        "doc_id",
        *(F.size(only(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(joined(only(*BASE_KINDS)), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every finding in its text replaced by ``mark``; overlapping findings as one.

    A null text stays null, all other columns stay as they are, also ones of clashing names within
    ``docs`` itself; n_chars, where there is one, follows the new text.
    """

    def clean(text: str) -> str:
        out, at = [], 0
        for _, start, end in findings(text):
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], mark]
            at = end
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            k = batch.schema.get_field_index("text")
            texts = pa.array([None if t is None else clean(t) for t in batch.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == k else c for i, c in enumerate(batch.columns)], schema=pa.schema([f.with_type(pa.string()) if i == k else f for i, f in enumerate(batch.schema)]))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
