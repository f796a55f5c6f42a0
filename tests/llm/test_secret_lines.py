"""Encoded keys among other lines."""

import base64

import pytest
from lodestone.llm import secret_scan


def der(n):
    """A DER key of n bytes."""
    return bytes([0x30, n - 2, 0x02, 0x10, *range(16), 0x04, n - 22, *range(n - 22)])


def b64(data):
    return base64.b64encode(data).decode()


def wrapped(data, gap, width=64):
    s = b64(data)
    return gap.join(s[i : i + width] for i in range(0, len(s), width))


BARE = b64(der(48))
SSH = b"".join(len(x).to_bytes(4, "big") + x for x in (b"ssh-ed25519", bytes(range(35))))
PUBLIC = b64(SSH)
CONTAINER = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"".join(len(x).to_bytes(4, "big") + x for x in (SSH, bytes(range(64))))


@pytest.mark.parametrize(
    "before, key, after, kind",
    [
        ("", BARE, "\nplease rotate", 3),
        ("", BARE, "\n" + "please\nrotate\nit", 3),
        ("", BARE, "\\nplease rotate", 3),
        ("", PUBLIC, "\nplease rotate", 4),
        ("", b64(CONTAINER), "\nplease rotate", 4),
        ("", wrapped(der(49), "\n"), "\nplease", 3),  # last line of two letters and ==
        ("", wrapped(der(50), "\n"), "\nplease", 3),  # three and =
        ("", wrapped(der(100), "\n    "), "\n    end", 3),
        ("", wrapped(der(100), "\\n"), "\\n-----END", 3),
        ("-----BEGIN KEY-----\\n", wrapped(der(100), "\\n"), "\\n-----END", 3),
        ("", wrapped(der(100), " \r\n\t"), "", 3),
        ("A" * 44 + "\n", BARE, "\nnext", 3),
        ("path \\", BARE, " x", 3),
    ],
)
def test_key_among_lines(before, key, after, kind):
    assert len(CONTAINER) % 3 == 0 and not BARE.endswith("=") and not PUBLIC.endswith("=")
    start = len("see ") + len(before)
    found = [x for x in secret_scan.find_spans(f"see {before}{key}{after}") if x[1] in (3, 4)]
    assert found == [(start, kind, start + len(key))]


def test_keys_on_neighbouring_lines():
    assert [x[1] for x in secret_scan.find_spans(f"{BARE}\n{PUBLIC}\n{BARE}")] == [3, 4, 3]


def test_no_key():
    assert secret_scan.find_spans(b64(der(48)[:-3]) + "\nwords") == []
    assert secret_scan.find_spans("M" * 5000 + "\nMM" * 500) == []
