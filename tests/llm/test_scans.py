import base64
import json
import random
import re

import pytest
from helpers import rows

from tableprep.llm import pii, secret_scan

# The plain patterns as the contract words them, without any shortcut.
SLOW = {
    "assign": (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
               r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
}


def slow(kind, text):
    pattern, right = SLOW[kind]
    return [(kind, *m.span()) for m in re.finditer(pattern, text) if right(m)]


def noise(seed):
    random_ = random.Random(seed)
    parts = ["token", "Secret = ", "api_key:", "PASSWD", '"', "'", "=", " ", "AKIA", "ABCDEF0123456789", "0a1b2c3d", "@", "a.b", ".com",
             "1", "12.", "255", "+1", " (", ") ", "-", "4111", "1111", "é", "\n", "x", "ſecret", "999."]
    return "".join(random_.choice(parts) for _ in range(random_.randrange(120)))


@pytest.mark.parametrize("seed", range(150))
def test_plain_findings_equal_the_plain_patterns(seed):
    text = noise(seed)
    found = [x[:3] for x in secret_scan.find(text) if x[3]]
    assert sorted(found) == sorted(x for k in secret_scan.BASE for x in slow(k, text))
    assert sorted(pii.plain(text)) == sorted(x for k in pii.KINDS for x in slow(k, text))


def tlv(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n])
    return bytes([tag]) + size + body


KEY = tlv(0x30, tlv(2, b"\0") + tlv(2, bytes(range(1, 129))) + tlv(2, b"\1\0\1"))


def test_keys_are_confirmed_by_their_structure():
    body = base64.b64encode(KEY).decode()
    assert secret_scan.is_der_key(KEY)
    assert not secret_scan.is_der_key(KEY[:-1]) and not secret_scan.is_der_key(KEY + b"\0")
    assert ("der", 4, 4 + len(body), False) in secret_scan.find("key " + body + " x")
    assert not [x for x in secret_scan.find("key " + body[:-8] + " x") if x[0] == "der"]
    assert ("der", 0, 2 * len(KEY), False) in secret_scan.find(KEY.hex())
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    assert [x[0] for x in secret_scan.find("é" + pem)] == ["pem"]
    assert not secret_scan.find(pem.replace(body, "bm9wZQ=="))


def test_openssh_keys_and_tokens():
    field = lambda x: len(x).to_bytes(4, "big") + x
    key = b"openssh-key-v1\0" + field(b"none") * 2 + field(b"") + (1).to_bytes(4, "big") + field(b"public") + field(b"private")
    assert secret_scan.is_openssh_key(key) and not secret_scan.is_openssh_key(key + b"x")
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256'})}.{part({'sub': 1})}.c2lnbmF0dXJl"
    assert [x[0] for x in secret_scan.find(f"use {token}")] == ["jwt"]
    assert not secret_scan.find(f"use {part({'typ': 'x'})}.{part({})}.c2ln")


def test_every_row_is_scanned(docs, corpus, empty):
    for operator in (secret_scan.scan, pii.scan):
        got = operator(docs).collect()
        assert sorted((r.doc_id for r in got), key=str) == sorted((r[0] for r in corpus), key=str)
        assert operator(empty).collect() == []


def test_the_field_finds_what_the_patterns_miss(spark):
    texts = [(i, f"call +1 ({200 + i}) 555-{2000 + i} or mail ab{i}@mail{i}.example.com from 10.0.{i}.7 with 4111 1111 1111 1111 now") for i in range(30)]
    texts.append((99, "reach us at (312) 555-2418 today, version 3.2.1 of 2024"))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.scan(df).collect()}
    assert [(s.kind, texts[-1][1][s.start : s.stop], s.plain) for s in spans[99]] == [("phone", "(312) 555-2418", False)]
    for i in range(30):
        assert [s.kind for s in spans[i] if s.plain] == ["email", "ip", "card", "phone"]


def test_long_runs_stay_fast():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 50_000, "A" * 200_000, "+1" + "-" * 100_000):
        secret_scan.find(text)
        pii.plain(text)


def test_spans_count_code_points(spark):
    df = spark.createDataFrame([(1, "ü password: abcdefgh12")], "doc_id long, text string")
    assert rows(secret_scan.scan(df).selectExpr("doc_id", "spans[0].kind", "spans[0].start", "spans[0].stop")) == [(1, "assign", 2, 22)]


def test_spelt_addresses_without_digits_are_found(spark):
    names = ["john", "mary.jones", "peter", "ann_lee", "bob", "eve.smith"]
    rows = [(i, f"please write to {names[i % 6]}{'xyz'[i % 3]}@{'abcde'[i % 5]}mail.org if you wish to know more") for i in range(60)]
    weights = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    for address in ("john at example dot com", "john[at]example.com", "mary(at)example.org"):
        text = f"please write to {address} if you wish"
        spans = pii.finder(weights)(text)
        assert ("email", 16, 16 + len(address), False) in spans, (address, spans)
    assert pii.finder(weights)("we met at noon and looked at the house. Then we left.") == []
