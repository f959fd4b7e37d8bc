"""Secret scan: rule matches, and base64, hex and token candidates that are confirmed by decoding their structure.

Method (structural confirmation): candidates in base64 (of both alphabets) and hex are reported only after they decode to a private
key (DER whose nested lengths fit exactly at each level, down to what its algorithm puts inside, or the length-prefixed fields of an
OpenSSH key); three dotted base64url parts only after the first decodes to a JSON header that names an algorithm and the second
to a JSON object (the third is empty if and only if the algorithm is `none`); five parts only after the first decodes to a header
that names an algorithm and an encryption.

A key may begin at any character, and its own header tells how long it is, so keys are found whatever stands before and behind them.
Their lines may have any width from eight characters on, be quoted, indented or string literals, and end with a written `\\n`; hex
may have colons, commas, blanks, `0x` or `\\x` between bytes. Keys of over 64 kB are not looked for.

Defined cases: a null text counts as empty and has no span; repeated rows each give a row; a very long text is scanned whole;
other columns are not read, so their names can't clash; an empty table gives an empty result. Offsets count code points, the end
is exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import mapped, prefixed, read

BASE = ("assign", "access", "hex")
CONFIRMED = ("jwt", "key")
ORDER = {kind: k for k, kind in enumerate(BASE + CONFIRMED)}
#: What redact() replaces: a bare hex run may be a checksum, so it goes only if it proves to be a key.
REDACTED = ("assign", "access", "jwt", "key")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
_JWE = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*(?:\.[A-Za-z0-9_-]+){3}(?![A-Za-z0-9_-])")
#: Bytes that a key has at most, so that many half keys in one text take linear time.
MOST_BYTES = 1 << 16
# Where the base64 of a key may begin: a DER sequence whose first value is a number or a sequence, by the three forms of its length
_DER_START = re.compile(r"M(?=[A-H][AEIMQUYcgkosw048][Cw]|I[GH][A-Za-z0-9+/_-](?:A[g-v]|M[A-P])|I[I-L][A-Za-z0-9+/_-]{2}[AQgwDTjz][A-DI-L])")
_SSH_START = base64.b64encode(b"openssh-key-v1\0").decode()
_B64 = re.compile(r"(?:[A-Za-z0-9+/_]|-(?!---))+")
#: What may stand between two pieces of a key: white space, line ends (also written ones), quotes, marks of quoted lines, joints of
#: string literals.
_B64_GAP = re.compile(r"""(?:\\{1,2}[rn]|[\s"'`>|*#,;:&\\]|(?<=[\s"'`])(?:\+|//)(?=[\s"'`\\])){1,200}+""")
_LINE_END = re.compile(r"\n|\\n")
_G = r"""(?:\\{1,2}[rnx]|0[xX]|[\s"'`>|*#,;:\\]){0,200}+"""
_H = "[0-9A-Fa-f]"
# the same as hex: version 0 or 1, or a sequence that begins with an object's name
_DER_HEX = re.compile(rf"3(?=0{_G}(?:[0-7]{_H}|81{_G}{_H}{{2}}|82{_G}{_H}{{2}}{_G}{_H}{{2}}){_G}(?:02{_G}01{_G}0[01]|30{_G}(?:[0-7]{_H}|81{_G}{_H}{{2}}){_G}06))")
_SSH_HEX = re.compile(_G.join(f"{x:02x}" for x in b"openssh"), re.IGNORECASE)
_HEX_BYTES = re.compile(rf"(?:{_H}{{2}})+")
_HEX_GAP = re.compile(_G.replace("{0,", "{1,"))


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of consecutive DER values that fill data exactly; None if they don't."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


# --- fixed values: object identifiers, as in DER
_RSA, _DSA, _EC = b"\x2a\x86\x48\x86\xf7\x0d\x01\x01", b"\x2a\x86\x48\xce\x38\x04\x01", b"\x2a\x86\x48\xce\x3d\x02\x01"
_EDWARDS = b"\x2b\x65"
_PASSWORD = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")


def _sequence(data: bytes) -> list[tuple[int, bytes]]:
    """What the one sequence holds that data is; nothing if it isn't one."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    return (der_items(outer[0][1]) or []) if outer and len(outer) == 1 else []


def _is_rsa(parts: list[tuple[int, bytes]]) -> bool:
    """A version, then eight numbers and more, of which the modulus has 32 bytes at least."""
    return len(parts) >= 9 and {tag for tag, _ in parts[:9]} == {0x02} and parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 32


def _is_dsa(parts: list[tuple[int, bytes]]) -> bool:
    return len(parts) == 6 and {tag for tag, _ in parts} == {0x02} and parts[0][1] == b"\0" and len(parts[1][1]) >= 32


def _is_ec(parts: list[tuple[int, bytes]]) -> bool:
    """Version 1 and an octet string."""
    return [tag for tag, _ in parts[:2]] == [0x02, 0x04] and parts[0][1] == b"\1" and len(parts[1][1]) >= 16


def _is_wrapped(parts: list[tuple[int, bytes]]) -> bool:
    """Version, algorithm, and an octet string that holds what the algorithm asks for."""
    if [tag for tag, _ in parts[:3]] != [0x02, 0x30, 0x04] or parts[0][1] not in (b"\0", b"\1"):
        return False
    algorithm, inside = der_items(parts[1][1]), parts[2][1]
    if not algorithm or algorithm[0][0] != 0x06:
        return False
    name, items = algorithm[0][1], der_items(inside)
    if name.startswith(_RSA):
        return _is_rsa(_sequence(inside))
    if name == _EC:
        return _is_ec(_sequence(inside))
    if name == _DSA:
        return bool(items) and len(items) == 1 and items[0][0] == 0x02 and len(items[0][1]) >= 16
    if name.startswith(_EDWARDS):
        return bool(items) and len(items) == 1 and items[0][0] == 0x04 and len(items[0][1]) >= 32
    return bool(items) and len(inside) >= 16


def _is_locked(parts: list[tuple[int, bytes]]) -> bool:
    """A password-based algorithm and what it encrypts."""
    if [tag for tag, _ in parts] != [0x30, 0x04] or len(parts[1][1]) < 16:
        return False
    algorithm = der_items(parts[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06 and algorithm[0][1].startswith(_PASSWORD)


def is_der_key(data: bytes) -> bool:
    """A private key of RSA, DSA or an elliptic curve, bare, wrapped with its algorithm, or locked by a password."""
    parts = _sequence(data)
    return any(test(parts) for test in (_is_rsa, _is_dsa, _is_ec, _is_wrapped, _is_locked))


def is_ssh_key(data: bytes) -> bool:
    """Magic, then cipher, key derivation and its options as length-prefixed fields, then a count and a public key."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return False
        at += 4 + size
    count, size = int.from_bytes(data[at : at + 4], "big"), int.from_bytes(data[at + 4 : at + 8], "big")
    return 1 <= count <= 64 and at + 8 + size < len(data)


def key_size(data: bytes) -> int | None:
    """Bytes that the key which begins data has by its header; 0 if an OpenSSH key is cut short by the end of data; None if no key
    begins here, or one of over MOST_BYTES."""
    if data.startswith(b"openssh-key-v1\0"):
        if not is_ssh_key(data):
            return None
        end, fields = 15, 3
        while fields:
            end, fields = end + 4 + int.from_bytes(data[end : end + 4], "big"), fields - 1
        count = int.from_bytes(data[end : end + 4], "big")
        end += 4
        for _ in range(count + 1):  # public keys, then the private ones in one field
            if end + 4 > len(data):
                return 0
            end += 4 + int.from_bytes(data[end : end + 4], "big")
        return end if end <= len(data) else 0
    if len(data) < 9 or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] >= 0x80 else 0
    if n > 4 or data[1] == 0x80:
        return None
    size, first = 2 + n + (int.from_bytes(data[2 : 2 + n], "big") if n else data[1]), data[2 + n : 5 + n]
    versioned = first in (b"\2\1\0", b"\2\1\1")
    return size if size <= MOST_BYTES and (versioned or first[:1] == b"\x30") else None


def _pieces(text: str, at: int, most: int, data: re.Pattern, gap: re.Pattern) -> list[tuple[int, int]]:
    """(start, end) of the pieces of at most so many characters that gaps part."""
    out = []
    while most > 0 and (m := data.match(text, at, min(len(text), at + most))):
        out.append(m.span())
        most -= m.end() - m.start()
        at = m.end()
        if most > 0 and (m := gap.match(text, at)):
            at = m.end()
    return out


def _key_at(text: str, at: int, data: re.Pattern, gap: re.Pattern, decode: Callable[[str], bytes], bits: int) -> tuple[int, int] | None:
    """(start, end) of the private key whose characters, of so many bits each, begin at this place."""
    read = lambda size: [*_pieces(text, at, -(-8 * size // bits), data, gap)]
    flat = lambda pieces: decode("".join(text[a:b] for a, b in pieces))
    head = flat(read(18))
    pieces = read(MOST_BYTES) if head.startswith(b"openssh-key-v1\0") else []
    size = key_size(flat(pieces) if pieces else head)
    if size is None:
        return None
    if size:
        pieces = read(size)
        found = flat(pieces)[:size]
        if not (is_der_key(found) or is_ssh_key(found)):
            return None
    else:  # cut short: as far as its lines go
        whole = next((k for k in range(1, len(pieces)) if not _LINE_END.search(text, pieces[k - 1][1], pieces[k][0])), len(pieces))
        pieces = pieces[:whole]
    end = pieces[-1][1]
    return at, end + (len(text[end : end + 2]) - len(text[end : end + 2].lstrip("=")) if bits == 6 and size % 3 != 0 or not size else 0)


def key_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of the private keys in base64 and hex."""
    out = []
    for starts, data, gap, decode, bits in (
        ((_DER_START, re.compile(_SSH_START)), _B64, _B64_GAP, _decoded, 6),
        ((_DER_HEX, _SSH_HEX), _HEX_BYTES, _HEX_GAP, bytes.fromhex, 4),
    ):
        for start in starts:
            last = 0
            for m in start.finditer(text):
                if m.start() >= last and (found := _key_at(text, m.start(), data, gap, decode, bits)):
                    out.append(found)
                    last = found[1]
    return out


def _decoded(text: str) -> bytes:
    text = text.replace("-", "+").replace("_", "/")[: len(text) - (len(text) % 4 == 1)]
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _json(part: str) -> object:
    try:
        return json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            head = _json(m[1])
            if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(_json(m[2]), dict) and (not m[3]) == (head["alg"].lower() == "none"):
                out.append(("jwt", *m.span()))
        for m in _JWE.finditer(text):
            head = _json(m[1])
            if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(head.get("enc"), str):
                out.append(("jwt", *m.span()))
    out += [("key", a, b) for a, b in key_spans(text)]
    return out


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found = {*base_spans(text), *confirmed_spans(text)} if text else set()
    return sorted(found, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str | None, kinds: tuple[str, ...] = REDACTED, mark: str = "[SECRET]") -> str | None:
    """The text with every span of these kinds replaced; overlapping spans count as one."""
    out, at = [], 0
    for k, a, b in find_spans(text):
        if k in kinds and b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]]) if out else text


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) of every row."""
    slim = prefixed(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py())] for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found, pa.list_(_SPAN))], ["doc_id", "spans"])

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text_col replaced; all rows and columns stay."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = pa.array([redacted(t.as_py()) for t in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([clean if k == at else c for k, c in enumerate(batch.columns)], schema=batch.schema.set(at, pa.field(batch.schema.names[at], pa.string())))

    return mapped(docs, run)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    found = scan(read(spark, sf_dir, "documents"))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
