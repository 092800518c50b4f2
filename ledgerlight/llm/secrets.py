"""Secrets in texts: patterns, and decoded candidates whose structure proves them."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Kinds in the order in which spans that start together are listed; the first three are the base kinds.
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
#: Shortest encoded run that is decoded: an encoded key, or a signed token's header, is longer.
LEAST_RUN = 24
#: How the key encodings name themselves.
SSH_TYPES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
SSH_PRIVATE = b"openssh-key-v1\0"
#: Length-prefixed fields of a public key by type, the type included.
SSH_FIELDS = dict(zip(SSH_TYPES, (3, 5, 2, 3, 3, 3)))
SCHEMA = "spans array<struct<kind:string,start:long,end:long>>"


def _rules() -> dict[str, re.Pattern]:
    """Compiled once per task. Only ASCII letters match in either case."""
    return {
        "assign": re.compile(ASSIGN, re.IGNORECASE | re.ASCII),
        "access": re.compile(rf"AKIA[A-Z0-9]{{{LEAST_ACCESS - 4},}}"),
        "hex": re.compile(rf"[0-9a-f]{{{LEAST_HEX},}}"),
        "jwt": re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)"),
        # The body of an encoded block may go over lines of equal length.
        "run": re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST_RUN},}}(?:\r?\n[A-Za-z0-9+/_-]{{{LEAST_RUN},}})*(?:\r?\n[A-Za-z0-9+/_-]+)?={{0,2}}"),
        "hexrun": re.compile(rf"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{{2}}){{{LEAST_RUN},}}(?![0-9A-Fa-f])"),
    }


def _base64(text: str) -> bytes:
    """Decoded bytes of a run in either alphabet; empty if it isn't one."""
    packed = re.sub(r"[\r\n=]", "", text).replace("-", "+").replace("_", "/")
    if len(packed) % 4 == 1:
        return b""
    try:
        return base64.b64decode(packed + "=" * (-len(packed) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def signed_token(header: str, payload: str, signature: str) -> bool:
    """A signed token's header is a JSON object that names the algorithm, its payload a JSON object."""
    try:
        head, body = json.loads(_base64(header)), json.loads(_base64(payload))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return bool(_base64(signature)) or head["alg"].lower() == "none"


def _element(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, content start, content end) of the DER element at `at`; lengths must be minimal and fit."""
    if at + 2 > len(data):
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 128:
        octets = n - 128
        if not 1 <= octets <= 4 or at + octets > len(data):
            return None
        n = int.from_bytes(data[at : at + octets], "big")
        if n < 128 or octets > 1 and n < 1 << 8 * (octets - 1):
            return None
        at += octets
    return (tag, at, at + n) if at + n <= len(data) else None


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The DER elements that fill data[at:end]; None if they don't."""
    found = []
    while at < end:
        inner = _element(data, at)
        if inner is None or inner[2] > end:
            return None
        found.append(inner)
        at = inner[2]
    return found


def der_key(data: bytes) -> bool:
    """A key in one of its DER encodings, which fills the data.

    These are: RSA private keys (version and eight integers, or with further primes), DSA private keys (six
    integers), elliptic curve private keys (version 1 and an octet string), wrapped private keys (version,
    algorithm, octet string), encrypted ones (algorithm, octet string) and wrapped public keys (algorithm, bit
    string); an algorithm is a sequence that starts with an object identifier, key material has 16 bytes
    or more. A bare pair of integers is a signature or an unnamed public key, a sequence of three with signed
    content a certificate: neither is reported.
    """
    outer = _element(data, 0)
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return False
    parts = _elements(data, outer[1], outer[2])
    if not parts:
        return False

    def is_algorithm(part: tuple[int, int, int]) -> bool:
        inside = _elements(data, part[1], part[2]) if part[0] == 0x30 else None
        return bool(inside) and inside[0][0] == 0x06 and inside[0][2] > inside[0][1]

    tags = [t for t, _, _ in parts]
    sizes = [end - at for _, at, end in parts]
    if tags[0] == 0x30:
        return len(parts) == 2 and is_algorithm(parts[0]) and tags[1] in (0x03, 0x04) and sizes[1] >= 16
    version = data[parts[0][1]] if tags[0] == 0x02 and sizes[0] == 1 else None
    if version not in (0, 1):
        return False
    if tags[1:9] == [0x02] * 8 and sizes[1] >= 16:
        return len(parts) == 9 and version == 0 or len(parts) == 10 and version == 1 and tags[9] == 0x30
    if tags[1:] == [0x02] * 5:
        return version == 0 and sizes[1] >= 16
    optional = {0xA0, 0xA1, 0x81}
    if tags[1:2] == [0x04]:
        return version == 1 and sizes[1] >= 16 and set(tags[2:]) <= optional
    return tags[1:3] == [0x30, 0x04] and is_algorithm(parts[1]) and sizes[2] >= 16 and set(tags[3:]) <= optional


def _fields(data: bytes, at: int, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from `at`, `most` of them or up to the end of the data, and where they end."""
    fields = []
    while at < len(data) if most is None else len(fields) < most:
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        fields.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return fields, at


def _ssh_public(data: bytes) -> bool:
    found = _fields(data, 0)
    return bool(found and found[0]) and SSH_FIELDS.get(found[0][0]) == len(found[0])


def ssh_key(data: bytes) -> bool:
    """A public key: the fields of its type fill the data. Or a private key block: names of cipher and key
    derivation, its options, the number of public keys, these, and a private part that ends the data."""
    if not data.startswith(SSH_PRIVATE):
        return _ssh_public(data)
    head = _fields(data, len(SSH_PRIVATE), 3)
    if head is None or not head[0][0] or not head[0][1] or head[1] + 4 > len(data):
        return False
    count = int.from_bytes(data[head[1] : head[1] + 4], "big")
    rest = _fields(data, head[1] + 4)
    return rest is not None and count >= 1 and len(rest[0]) == count + 1 and all(map(_ssh_public, rest[0][:-1])) and bool(rest[0][-1])


def _confirmed(data: bytes) -> str | None:
    return "der" if der_key(data) else "ssh" if ssh_key(data) else None


def _stated(packed: str, at: int) -> int:
    """Bytes that the DER or SSH header at `at` of an encoded run says its key has; 0 without such a header."""

    def peek(start: int, n: int) -> bytes:
        first = at + start // 3 * 4
        return _base64(packed[first : first + (start % 3 + n + 2) // 3 * 4])[start % 3 : start % 3 + n]

    head = peek(0, 6)
    if head[:1] == b"\x30" and len(head) == 6:
        octets = max(0, head[1] - 128)
        return 2 + octets + int.from_bytes(head[2 : 2 + octets], "big") if 1 <= octets <= 4 else 2 + head[1] if head[1] < 128 else 0
    if peek(0, len(SSH_PRIVATE)) == SSH_PRIVATE:  # three fields, the number of public keys, these, the private part
        end, fields, private = len(SSH_PRIVATE), 3, True
    else:
        n = int.from_bytes(head[:4], "big")
        end, fields, private = 0, SSH_FIELDS.get(peek(4, n), 0) if n <= max(map(len, SSH_TYPES)) else 0, False
    while fields and end < len(packed):
        end += 4 + int.from_bytes(peek(end, 4), "big")
        fields -= 1
        if private and not fields:
            fields, private = int.from_bytes(peek(end, 4), "big") + 1, False
            end += 4
    return 0 if fields else end


def _keys_by_line(text: str, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """Keys of a run of lines, each from the start of a line over as many lines as its own header asks for."""
    lines = [(start + m.start(), start + m.end()) for m in re.finditer(r"[^\r\n]+", text[start:end])]
    offsets = [0, *accumulate(b - a for a, b in lines)]
    packed = "".join(text[a:b] for a, b in lines)
    i = 0
    while i < len(lines):
        n = _stated(packed, offsets[i])
        last = bisect_left(offsets, offsets[i] + -(-4 * n // 3)) - 1 if n else len(lines)
        kind = None
        if last < len(lines) and offsets[last + 1] - offsets[i] <= -(-n // 3) * 4:  # with padding or without
            kind = _confirmed(_base64(packed[offsets[i] : offsets[last + 1]]))
        if kind:
            yield kind, lines[i][0], lines[last][1]
        i = last + 1 if kind else i + 1


def _tokens(text: str, rule: re.Pattern) -> Iterator[tuple[str, int, int]]:
    """Signed tokens; where three segments aren't one, the next may start at the second of them."""
    m = rule.search(text)
    while m:
        found = signed_token(*m.groups())
        if found:
            yield "jwt", *m.span()
        m = rule.search(text, m.end() if found else m.start(2))


def find(text: str, rules: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: in code points, the end exclusive."""
    spans = [("assign", *m.span()) for m in rules["assign"].finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    for kind in ("access", "hex"):
        spans += [(kind, *m.span()) for m in rules[kind].finditer(text)]
    if "." in text:
        spans += _tokens(text, rules["jwt"])
    for m in rules["run"].finditer(text):
        start, end = m.span()
        kind, rest = _confirmed(_base64(m[0])), end
        if not kind and "\n" in m[0]:  # the word after an encoded block isn't always part of it
            rest = start + m[0].rindex("\n")
            end = rest - (text[rest - 1] == "\r")
            kind = _confirmed(_base64(text[start:end]))
            spans += _keys_by_line(text, rest if kind else start, m.end())
        if kind:
            spans.append((kind, start, end))
    for m in rules["hexrun"].finditer(text):
        kind = _confirmed(bytes.fromhex(m[0]))
        if kind:
            spans.append((kind, *m.span()))
    return sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rules = _rules()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py() or "", rules)] for t in batch.column("text")]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(found, kind)], names=[*names, "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """`docs` with `text` replaced by `spans`: the secrets of the whole text, as (kind, start, end).

    Base kinds are patterns: assign (a named value of 12 or more characters), access (an access key id of 18
    or more) and hex (16 or more digits), leftmost and non-overlapping per kind. The others are proven by
    decoding base64 or hex runs: jwt (signed token, JSON header and payload), der (a key encoding whose nested
    lengths fill the data exactly) and ssh (the fields of a key type, or a private key block to its end). Lines that follow each other are
    tried as one block, then each as the start of a key as long as its own header says. A NULL text has no spans;
    repeated rows come out repeated. Rows are independent, so any split of the table will do.
    """
    kept = docs.drop("spans")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != "text")
    return kept.mapInArrow(_scan, fields + SCHEMA)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def base_digest(spans) -> str:
    return hashlib.sha256(joined([s for s in spans if s[0] in KINDS[:3]]).encode()).hexdigest()
