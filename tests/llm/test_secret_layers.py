"""Encoded secrets with anything before, after and between the lines of their encoding."""

import base64
import gzip
import lzma
import random
import time
import zlib
from urllib.parse import quote

import pytest

from meridia.llm import secrets

SECRET = "password=hunter2secret99"


def b64(data, urlsafe=False):
    data = data.encode() if isinstance(data, str) else data
    return (base64.urlsafe_b64encode if urlsafe else base64.b64encode)(data).decode().rstrip("=")


@pytest.mark.parametrize("before", ["https://example.com/files/", "/a/", "x_", "id/7/", "/v1/", "key-", "abc/", "ab", "a-b_c/", "token/xx"])
@pytest.mark.parametrize("data", [SECRET, gzip.compress(SECRET.encode()), zlib.compress(("nothing here, " + SECRET).encode()), lzma.compress(SECRET.encode()), SECRET.encode("utf-16-le"), SECRET.encode("utf-16-be")])
def test_any_prefix(before, data):
    for after in ("", " after", "/tail", "?q=1"):
        text = f"see {before}{b64(data)}{after}."
        added = secrets.scan(text)[1]
        assert any(k == "assign" for k, _, _ in added), text
        assert secrets.scan(secrets.masked(text, added)) == ([], [])


@pytest.mark.parametrize("width", [5, 12, 15, 16, 40, 76])
@pytest.mark.parametrize("joint", ["\n", "\r\n", "\n    ", "\n\t", "\\n", "\\r\\n"])
def test_lines_of_any_form(width, joint):
    for lead in ("", "xy/"):
        body = lead + b64("some words before it and " + SECRET + " and some after it")
        text = "data: " + joint.join(body[i : i + width] for i in range(0, len(body), width)) + " end"
        assert any(k == "assign" for k, _, _ in secrets.scan(text)[1]), text


def test_escapes():
    lone = "\\ud800" + "".join(f"\\u{ord(c):04x}" for c in SECRET) + "\\udc00"
    percent = "".join(f"%u{ord(c):04X}" for c in SECRET)
    octal = "".join(f"\\{ord(c):03o}" for c in SECRET)
    for text, first in ((lone, 6), (percent, 0), (octal, 0)):
        assert secrets.scan(f"a {text} b")[1] == [("assign", 2 + first, 2 + len(text) - first)], text
    assert secrets.scan("\\ud800 and \\udfff") == ([], [])


def test_random_wrapping_and_nesting():
    rng = random.Random(11)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    layers = [b64, lambda t: b64(t, True), lambda t: quote(t, safe="") if "%" not in t else b64(t), lambda t: "".join(f"\\u{ord(c):04x}" for c in t), lambda t: b64(gzip.compress(t.encode()))]
    for _ in range(300):
        blob = SECRET
        for step in range(rng.randrange(1, 4)):
            blob = rng.choice(layers)(blob)
            if len(blob) > 20_000:
                break
            lead = "".join(rng.choices(letters, k=rng.randrange(0, 7))) + rng.choice(["/", "-", "_", " ", ""])
            blob = (lead if step else "") + blob
        text = f"words {rng.choice(['', 'v/', 'ab', 'key-', 'x/y_z/'])}{blob} words"
        assert any(k == "assign" for k, _, _ in secrets.scan(text)[1]), text[:300]


def test_time_in_proportion():
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    took = []
    for n in (200_000, 1_600_000):
        for text in ("".join(rng.choices(letters, k=n)), "\n".join("".join(rng.choices(letters, k=11)) for _ in range(n // 11)), "eJx" * (n // 3), "H4sI" * (n // 4)):
            began = time.process_time()
            assert secrets.scan(text)[1] == []
            took.append(time.process_time() - began)
    assert all(b < 40 * max(a, 0.05) for a, b in zip(took[:4], took[4:], strict=True)), took
