"""Secret scans: base patterns, then structural confirmation of what looks encoded.

Base spans (assign, access, hex) are leftmost, non-overlapping per kind. The
method then decodes base64, in either alphabet, and hex candidates and reports
one only if its bytes parse: DER by nested lengths that add up exactly at every
level, with elements as a key encoding has them; OpenSSH keys by their
length-prefixed fields, and containers by cipher, key derivation, the number of
keys, public keys that parse and a private part; signed tokens by a JSON header
that names a registered algorithm, a JSON payload and a signature. A run of
base64 is tried from each of its lines, to the line's end that the encoding's own
lengths name, so that lines before and after a key do not hide it; it is decoded
once for each of the four places a line can start at, so that time grows with the
run and not with its square. Sequences of integers are keys only with what keys
have: an RSA modulus and exponent, or a version and the numbers of a private key;
a signature's two numbers are not. Work is one pass over each row in Arrow
batches; nothing is shuffled.

Edge cases: null text is empty and has no spans; a very long text is searched
whole, in memory that grows with it alone; spans of equal start and kind are
one; repeated rows each give a row; an empty table gives an empty table; other
columns are not read by `scan` and pass through `redact`, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import map_rows, record_batch, slices, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as of [0-9a-f]+, that are long enough
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
#: Base64 in one piece or wrapped in lines, as in key files; breaks may be written as \n, and lines indented.
GAP = r"[\x20\t]*(?:(?:\\+r)?\\+n|\r?\n|\r)(?:[\x20\t]|\\+t)*"
BASE64 = re.compile(rf"(?!(?<=\\)[nrt])[A-Za-z0-9+/]{{40,}}(?:{GAP}[A-Za-z0-9+/]+)*={{0,2}}")
PIECE = re.compile(rf"([A-Za-z0-9+/]+)(={{0,2}})(?:{GAP})?")
LONG_HEX = re.compile(r"[0-9a-fA-F]{64,}")
#: The order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "der", "ssh", "signed")
#: The same in the alphabet for URLs, from the start of a word.
URL_SAFE = re.compile(rf"(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt])[A-Za-z0-9_-]{{40,}}(?:{GAP}[A-Za-z0-9_-]+)*={{0,2}}(?![A-Za-z0-9+/_-])")
URL_PIECE = re.compile(rf"([A-Za-z0-9_-]+)(={{0,2}})(?:{GAP})?")
TO_PLAIN = str.maketrans("-_", "+/")
#: Registered algorithms of signed tokens. Fixed values.
SIGNING = frozenset("HS256 HS384 HS512 RS256 RS384 RS512 ES256 ES384 ES512 ES256K PS256 PS384 PS512 EdDSA Ed25519 Ed448 none".split())
#: Levels of DER that are followed.
DEPTH = 16
SSH_CONTAINER = b"openssh-key-v1\0"
#: How many fields the public keys of OpenSSH have, their name included. Fixed values.
SSH_FIELDS = {
    b"ssh-rsa": 3, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ssh-ed448": 2,
    b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3,
    b"sk-ssh-ed25519@openssh.com": 3, b"sk-ecdsa-sha2-nistp256@openssh.com": 4,
}
#: Bits of the least modulus that a key has.
MODULUS_BITS = 512


def _der_length(data: bytes, at: int) -> tuple[int, int] | None:
    """Length and where content starts, of the length field at `at`."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    return int.from_bytes(data[at + 1 : at + 1 + n], "big"), at + 1 + n


def der_elements(data: bytes, at: int, end: int, depth: int = DEPTH) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[at:end] exactly, what they hold parsed likewise; null if they do not."""
    out = []
    while at < end:
        if not (head := _der_length(data, at + 1)) or sum(head) > end:
            return None
        tag, start, at = data[at], head[1], sum(head)
        if tag & 0x20:  # holds others
            if not depth or der_elements(data, start, at, depth - 1) is None:
                return None
        elif tag == 0x05 and start < at or tag in (0x02, 0x03, 0x06) and start == at:
            return None
        elif tag == 0x03 and data[start] > 7 or tag == 0x06 and data[at - 1] & 0x80:
            return None
        out.append((tag, start, at))
    return out


def _is_number_key(numbers: list[bytes]) -> bool:
    """Whether the integers of a sequence are those of an RSA key or a DSA private key."""
    values = [int.from_bytes(x, "big", signed=True) for x in numbers]
    if len(values) == 2:
        modulus, exponent = values
        return modulus.bit_length() >= MODULUS_BITS and modulus > 0 and modulus % 2 == 1 and exponent > 1 and exponent % 2 == 1
    return len(values) in (6, 9) and values[0] == 0 and all(x > 0 for x in values[1:]) and values[1].bit_length() >= MODULUS_BITS


def is_der_key(data: bytes) -> bool:
    """A sequence that is all of the data, of a key's integers, or an integer and a string, or a named algorithm and a string, perhaps after a version."""
    if len(data) < 24 or data[0] != 0x30 or not (head := _der_length(data, 1)) or sum(head) != len(data) or not (inner := der_elements(data, head[1], len(data))):
        return False
    tags = [t for t, _, _ in inner]
    if set(tags) == {0x02}:
        return len(tags) <= 9 and _is_number_key([bytes(data[a:b]) for _, a, b in inner])
    rest = inner[1:] if tags[0] == 0x02 else inner
    tags = [t for t, _, _ in rest]
    if tags[:1] == [0x04]:
        return len(inner) > len(rest) and set(tags[1:]) <= {0xA0, 0xA1}
    return tags[:1] == [0x30] and data[rest[0][1]] == 0x06 and tags[1:2] in ([0x03], [0x04]) and set(tags[2:]) <= {0xA0, 0xA1, 0x81}


def _field(data: bytes, at: int, end: int) -> int | None:
    """Where the field with a 4-byte length at `at` ends, if that is within the data."""
    if at + 4 > end:
        return None
    to = at + 4 + int.from_bytes(data[at : at + 4], "big")
    return to if to <= end else None


def _public_end(data: bytes, at: int, end: int) -> int | None:
    """Where a public key of OpenSSH that starts at `at` ends: as many fields as its name asks for, none empty."""
    if (to := _field(data, at, end)) is None or not (n := SSH_FIELDS.get(bytes(data[at + 4 : min(to, at + 64)]))):
        return None
    for _ in range(n - 1):
        at, to = to, _field(data, to, end)
        if to is None or to == at + 4:
            return None
    return to


def _container_end(data: bytes, at: int, end: int) -> int | None:
    """Where the container that starts at `at` ends: cipher, key derivation and its options, a number of keys, so many public ones that parse, and a private part."""
    at, head = at + len(SSH_CONTAINER), []
    for _ in range(3):
        if (to := _field(data, at, end)) is None:
            return None
        head.append(bytes(data[at + 4 : to]))
        at = to
    cipher, way, options = head
    if not (cipher and way and cipher.isascii() and way.isascii()) or (cipher == b"none") != (way == b"none") or (way == b"none") != (not options):
        return None
    n, at = int.from_bytes(data[at : at + 4], "big"), at + 4
    for _ in range(n):
        if (to := _field(data, at, end)) is None or _public_end(data, at + 4, to) != to:
            return None
        at = to
    to = _field(data, at, end)
    return to if n and to is not None and to > at + 4 else None


def _key_end(data: bytes, at: int) -> tuple[int, int] | None:
    """The rank of the kind of key that starts at `at`, by its first bytes, and where its own lengths say that it ends."""
    end = len(data)
    if data[at : at + 1] == b"\x30":
        return (3, sum(size)) if (size := _der_length(data, at + 1)) and sum(size) <= end else None
    if data[at : at + len(SSH_CONTAINER)] == SSH_CONTAINER:
        return (4, to) if (to := _container_end(data, at, end)) else None
    return (4, to) if (to := _public_end(data, at, end)) else None


def is_ssh_key(data: bytes) -> bool:
    """An OpenSSH container, or a public key's fields, that fill the data."""
    found = _key_end(data, 0)
    return found == (4, len(data))


def _bytes(letters: str) -> bytes:
    """Base64 letters without padding; a last letter that stands alone is left out."""
    letters = letters[: len(letters) - (len(letters) % 4 == 1)]
    return base64.b64decode(letters + "=" * (-len(letters) % 4))


def _encoded(text: str, a: int, b: int, piece: re.Pattern = PIECE) -> Iterator[tuple[int, int, int]]:
    """Spans of keys in a run of base64: from the start of a line of 40 letters to the end of the line where the key ends."""
    pieces = list(piece.finditer(text, a, b))
    letters = "".join(p[1] for p in pieces).translate(TO_PLAIN)
    starts = [0]
    for p in pieces:
        starts.append(starts[-1] + len(p[1]))
    # the run's bytes, read from each of the four places in a group of letters
    read: dict[int, bytes] = {}
    first = 0
    while first < len(pieces):
        i, at = first, starts[first]
        first += 1
        if len(pieces[i][1]) < 40 or letters[at] != "M" and not letters.startswith(("AAAA", "b3Bl"), at):
            continue  # starts no key
        data = read.get(at % 4)
        if data is None:
            data = read[at % 4] = _bytes(letters[at % 4 :])
        origin = at // 4 * 3
        if not (found := _key_end(data, origin)):
            continue
        rank, end = found
        # so many letters write so many bytes
        j = bisect_left(starts, at + -(-(end - origin) * 4 // 3), i + 1)
        if j < len(starts) and starts[j] == at + -(-(end - origin) * 4 // 3) and (rank == 4 or is_der_key(data[origin:end])):
            yield pieces[i].start(), rank, pieces[j - 1].end(2)
            first = j


def _json(part: str) -> object:
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (binascii.Error, ValueError, RecursionError):
        return None


def is_signed_token(header: str, payload: str, signature: str) -> bool:
    """A header that names a registered algorithm, a payload of claims, and a signature unless there is to be none."""
    head = _json(header)
    if not isinstance(head, dict) or not isinstance(alg := head.get("alg"), str) or alg not in SIGNING:
        return False
    return isinstance(_json(payload), dict) and (not signature if alg == "none" else len(signature) % 4 != 1 and bool(signature))


def _key_kind(data: bytes) -> int | None:
    return 3 if is_der_key(data) else 4 if is_ssh_key(data) else None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, rank of kind, end) in code points, sorted."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in BASE64.finditer(text):
        spans += _encoded(text, m.start(), m.end())
    if "-" in text or "_" in text:
        for m in URL_SAFE.finditer(text):
            # without these two letters it is like any base64
            if "-" in m[0] or "_" in m[0]:
                spans += _encoded(text, m.start(), m.end(), URL_PIECE)
    for m in LONG_HEX.finditer(text):
        # a stray digit may stand before the key or after it
        for at in (0, 1):
            end = len(m[0]) - (len(m[0]) - at) % 2
            if kind := _key_kind(bytes.fromhex(m[0][at:end])):
                spans.append((m.start() + at, kind, m.start() + end))
    if "ey" in text and "." in text:
        spans += [(m.start(), 5, m.end()) for m in TOKEN.finditer(text) if is_signed_token(m[1], m[2], m[3])]
    return sorted(set(spans))


def _row(text: str) -> tuple:
    spans = find_spans(text)
    named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
    base = ",".join(s for s, x in zip(named, spans, strict=True) if x[1] < 3)
    return (*(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), ",".join(named))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest and all spans as text."""

    def make():
        def each(batch: pa.RecordBatch) -> Iterator[dict]:
            rows = [_row(t) for t in texts(batch)]
            yield {"doc_id": batch.column("doc_id"), **{n: [r[i] for r in rows] for i, n in enumerate(("n_assign", "n_access", "n_hex", "base_sha256", "spans"))}}

        return each

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, mark: str = "[secret]") -> str:
    """The text with each maximal run of spans replaced by mark."""
    out, at = [], 0
    for a, _, b in find_spans(text):
        if b <= at:
            continue
        if a >= at and (a > at or not out):
            out += [text[at:a], mark]
        elif a >= at:
            pass  # touches the span before
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """All columns of documents, secrets in text masked, n_chars the new length where there is such a column. A null text stays null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds, schema = to_arrow_schema(docs.schema), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            columns = {f.name: part.column(f.name) for f in kinds}
            old = part.column("text").to_pylist()
            new = [None if t is None else masked(t, mark) for t in old]
            columns["text"] = new
            if "n_chars" in columns:
                columns["n_chars"] = [n if a == b else len(b) for n, a, b in zip(columns["n_chars"].to_pylist(), old, new, strict=True)]
            yield record_batch(columns, kinds)

    return docs.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
