"""What looks encoded and does not parse is left alone; base spans against patterns spelled out."""

import base64
import json
import random
import re
import time

import pytest

from lodestone.llm import secret_scan


def tlv(tag, content):
    n = len(content)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 + (len(f"{n:x}") + 1) // 2]) + n.to_bytes((len(f"{n:x}") + 1) // 2, "big")) + content


def part(data):
    return base64.urlsafe_b64encode(data if isinstance(data, bytes) else json.dumps(data).encode()).decode().rstrip("=")


def field(x):
    return len(x).to_bytes(4, "big") + x


OID, NUMBER = tlv(6, b"\x2a\x86\x48"), tlv(2, bytes(range(1, 140)))
KEYS = [
    tlv(0x30, tlv(2, b"\0") + NUMBER * 8),
    tlv(0x30, tlv(2, b"\0") + tlv(0x30, OID + tlv(5, b"")) + tlv(4, bytes(40))),
    tlv(0x30, tlv(0x30, OID + tlv(5, b"")) + tlv(3, b"\0" + bytes(40))),
    tlv(0x30, tlv(2, b"\1") + tlv(4, bytes(32)) + tlv(0xA0, OID) + tlv(0xA1, tlv(3, b"\0" + bytes(20)))),
]
NO_KEYS = [
    tlv(0x30, tlv(2, b"\0") + tlv(0x30, OID + tlv(5, b"x")) + tlv(4, bytes(40))),  # a null that holds something
    tlv(0x30, tlv(2, b"\0") + tlv(0x30, OID + b"\x05\x09") + tlv(4, bytes(40))),  # a length beyond what holds it
    tlv(0x30, tlv(0x30, NUMBER) + tlv(0x30, OID) + tlv(3, b"\0" + bytes(40))),  # no algorithm first
    tlv(0x30, NUMBER),
    tlv(0x30, tlv(2, b"\0") + NUMBER * 3),  # no key has four integers
    tlv(0x30, tlv(2, bytes([1, *range(31)])) * 2),  # a signature
    tlv(0x30, tlv(0x0C, b"some text that is long enough") * 2),
]
PUBLIC = field(b"ssh-ed25519") + field(bytes(32))
CONTAINER = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + b"\0\0\0\1" + field(PUBLIC) + field(bytes(range(100)))
NO_CONTAINERS = [b"openssh-key-v1\0" + bytes(range(60)), CONTAINER.replace(b"ssh-ed25519", b"abc-ed25519"), CONTAINER[:-9], CONTAINER.replace(b"\0\0\0\1" + field(PUBLIC), b"\0\0\0\2" + field(PUBLIC))]


def kinds(text):
    return {k for _, k, _ in secret_scan.find_spans(text)} - {0, 1, 2}


RSA_PUBLIC = tlv(0x30, NUMBER + tlv(2, b"\1\0\1"))


@pytest.mark.parametrize("write", [lambda d: d.hex(), lambda d: base64.b64encode(d).decode(), part])
def test_structures(write):
    assert [kinds(f"x {write(d)} y") for d in [*KEYS, PUBLIC, CONTAINER]] == [{3}] * 4 + [{4}] * 2
    assert [kinds(f"x {write(d)} y") for d in [*NO_KEYS, *NO_CONTAINERS, PUBLIC[:-5]]] == [set()] * 12


def test_numbers_of_keys():
    """Moduli of 512 bits with odd exponents, and the numbers of private keys."""
    number = lambda bits, low=1: tlv(2, b"\0" + (1 << bits - 1 | low).to_bytes(bits // 8, "big"))
    zero, three = tlv(2, b"\0"), tlv(2, b"\3")
    keys = [number(512) + three, number(2048) + tlv(2, b"\1\0\1"), zero + number(512) * 8, zero + number(1024) + number(160) * 4]
    others = [number(256) * 2, number(504) + three, number(512) + tlv(2, b"\4"), number(512) + tlv(2, b"\1"), number(512, 2) + three, number(512) * 3, three + number(512) * 8, zero + number(256) * 8, number(512) * 9, zero + number(512) * 9, tlv(2, b"\xff" * 65) + three]
    assert all(secret_scan.is_der_key(tlv(0x30, x)) for x in keys)
    assert not any(secret_scan.is_der_key(tlv(0x30, x)) for x in others)


def test_fields_of_public_keys():
    rsa = field(b"ssh-rsa") + field(b"\1\0\1") + field(bytes(range(1, 200)))
    assert secret_scan.is_ssh_key(rsa)
    assert not any(secret_scan.is_ssh_key(x) for x in (rsa + field(b"more"), rsa[:-1], field(b"ssh-rsa") + field(b"\1\0\1"), field(b"ssh-rsa") + field(b"") + field(b"x" * 64), field(b"ssh-none") + field(b"x" * 64)))


def wrapped(letters, width=64, gap="\n"):
    return gap.join(letters[i : i + width] for i in range(0, len(letters), width))


def test_url_alphabet_over_lines():
    data = tlv(0x30, tlv(2, b"\0") + tlv(0x30, OID + tlv(5, b"")) + tlv(4, bytes([0xFB, 0xEF, 0xFF] * 60)))
    letters = base64.urlsafe_b64encode(data).decode().rstrip("=")
    assert "-" in letters and "_" in letters and "+" not in letters
    text = f"-----BEGIN KEY-----\n{wrapped(letters)}\n-----END KEY-----"
    assert [x for x in secret_scan.find_spans(text) if x[1] == 3] == [(20, 3, 20 + len(wrapped(letters)))]


def test_stray_digits_around_hex():
    key = RSA_PUBLIC.hex()
    for before, after in (("a", ""), ("", "f"), ("", "")):
        assert [x for x in secret_scan.find_spans(f"x {before}{key}{after} y") if x[1] == 3] == [(2 + len(before), 3, 2 + len(before) + len(key))]


@pytest.mark.parametrize(
    "line",
    ["AAAAB3NzaC1yc2EAAAADAQAB" + "Q" * 60, "MIIEpAIBAAKCAQEA" + "Q" * 60, base64.b64encode(PUBLIC).decode(), base64.b64encode(b"\x30\x84\0\x10\0\0" + bytes(42)).decode(), "MI-_" * 16],
)
def test_time_goes_with_the_text(line):
    """Long runs of lines that look like keys: twice the text takes about twice as long, where each line once read all that follow."""

    def seconds(n):
        text = "\n".join([line] * n)
        best = []
        for _ in range(3):
            began = time.process_time()
            secret_scan.find_spans(text)
            best.append(time.process_time() - began)
        return min(best)

    few, many = seconds(4_000), seconds(16_000)
    assert many < 8 * few + 0.05 and many < 5


def test_ten_megabytes_of_base64():
    letters = base64.b64encode(random.Random(3).randbytes(7_500_000)).decode()
    key = base64.b64encode(KEYS[1]).decode()
    for text in (letters, wrapped(letters, 76)):
        whole = text + "\n" + key + "\n" + text
        began = time.process_time()
        found = [x for x in secret_scan.find_spans(whole) if x[1] in (3, 4)]
        assert found == [(len(text) + 1, 3, len(text) + 1 + len(key))] and time.process_time() - began < 60


def test_deep_nesting_ends():
    data = b""
    for _ in range(400):
        data = tlv(0x30, data or NUMBER)
    assert not secret_scan.is_der_key(data)


def test_tokens():
    token = lambda head, body, sign="c2ln": f"{part(head)}.{part(body)}.{sign}"
    good = [token({"alg": "HS256"}, {"sub": 1}), token({"typ": "JWT", "alg": "EdDSA"}, {}), token({"alg": "none"}, {"a": "b"}, "")]
    bad = [token({"alg": "banana"}, {}), token({"alg": 5}, {}), token({"alg": "HS256"}, [1]), token({"alg": "HS256"}, b"not json"), token({"alg": "HS256"}, {}, ""), token({"alg": "none"}, {"a": 1}, "c2ln"), token({"typ": "JWT"}, {})]
    assert [kinds(f"a {t} b") for t in good] == [{5}] * 3
    assert [kinds(f"a {t} b") for t in bad] == [set()] * 7


def test_base_spans_against_patterns_spelled_out():
    either = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
    names = "|".join(map(either, ("password", "passwd", "secret", "token"))) + f"|{either('api')}_?{either('key')}"
    assign = re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    rng = random.Random(12)
    bits = ["password", "ApI_KEY", "apikey", "toKen", "secreT", "passwd", ":", "=", " ", "'", '"', "abcdef", "0a", "AKIA", "AKIA" + "B" * 16, "deadbeef" * 3, "DEADBEEF", "é", "\n", "-", "x", "ſ", "1" * 24]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        expected = sorted(
            [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
            + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
            + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        )
        assert [x for x in secret_scan.find_spans(text) if x[1] < 3] == expected


def test_very_long_text():
    text = "word " * 400_000 + "password=hunter22" + " A" * 200_000
    assert secret_scan.find_spans(text) == [(2_000_000, 0, 2_000_017)]
