import hashlib
import math
import random
import re
import string
from collections import Counter

from lectern.llm import secrets

DDL = "doc_id long, text string, __base string, spans string, value string"


def high(value, rules=secrets.RULES):
    if any(re.search(p, value) for p in secrets.ALLOWED):
        return False
    for r in rules:
        if re.search(r.only, value):
            found = [Counter(value[i : i + r.window]) for i in range(len(value) - r.window + 1)]
            return any(sum(-c / r.window * math.log2(c / r.window) for c in f.values()) > r.bits for f in found)
    return False


def brute(text):
    text = text or ""
    base = [(m.start(), 0, "assign", m.end()) for m in re.finditer(secrets.ASSIGN, text, re.A) if len(m[1]) >= 8]
    base += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    more = [(m.start(), 3, "entropy", m.end()) for m in re.finditer(secrets.CANDIDATE, text) if high(m[0]) and not any(b[0] < m.end() and m.start() < b[3] for b in base)]
    more += [(m.start(), 3, "entropy", m.end()) for m in re.finditer(secrets.RUN, text) if high(m[0], secrets.RUN_RULES) and not any(b[0] < m.end() and m.start() < b[3] for b in base + more)]
    join = lambda spans: ",".join(f"{k}:{b}:{e}" for b, _, k, e in sorted(spans))
    kinds = Counter(k for _, _, k, _ in base)
    return kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(join(base).encode()).hexdigest(), join(base + more)


HEX32 = hashlib.md5(b"x").hexdigest()
TEXTS = [
    None, "", " ", "é" * 40 + " password=abcdefgh12 PASSWORD : 'short' apikey:\"abcdefgh\"", "token=api_key : value123456", "AKIAAKIAAKIAAKI AKIAABCDEFGH1234",
    f"😀 secret={HEX32} {HEX32}{HEX32}", "key Zk3v9QpX7LmN2tRb8WcY4dHs here and q7Hn2XvB9kLmP4sT6wYz8cRd_", "uuid 123e4567-e89b-42d3-a456-426614174000 01234567890123456789 abcdefghijklmnopqrstuvwxyz1",
    "f3a9c0d17be24586ac1f9d07", "sk_f3a9c0d17be24586ac1f9d07 /srv/example/Zk3v9QpX7LmN2tRb8WcY key=JBSWY3DPEHPK3PXPJBSW", "aaaaaaaaaaaaaaaaaaaaaaaa1", "x" * 300_000 + " token: tok_9fK2mQ", "password=password=password=abc",
]


def test_brute_force(spark):
    rows = [(i, t, "a", "b", "c") for i, t in enumerate([*TEXTS, *TEXTS])]
    got = {r.doc_id: tuple(r)[1:] for r in secrets.scan(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {i: brute(t) for i, t, *_ in rows}
    assert "entropy" in got[7][4] and "entropy" in got[9][4] and "entropy" not in got[8][4]
    assert secrets.scan(spark.createDataFrame([], DDL)).count() == 0


def test_redact(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got[0] is None and got[1] == "" and got[3] == "é" * 40 + " [secret] PASSWORD : 'short' [secret]\""  # a closing quote is no part of a span
    assert got[6] == "😀 [secret] [secret]" and got[8] == TEXTS[8]
    clash = spark.createDataFrame([(TEXTS[7], "a", "b", "c")], "text string, __base string, __all string, __all_ string")
    row = secrets.redact(clash).first()
    assert row.text == "key [secret] here and [secret]" and tuple(row)[1:] == ("a", "b", "c")
    assert secrets.redact(clash.limit(0)).count() == 0


def test_redact_finds_secrets_glued_to_names(spark):
    rng = random.Random(5)
    kinds = {"hex": ("0123456789abcdef", 24), "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 24), "alnum": (string.ascii_letters + string.digits, 20)}
    rows = []
    for name, (letters, n) in kinds.items():
        for i in range(200):
            value = "".join(rng.choice(letters) for _ in range(n - 2)) + "D7"[:: rng.choice((1, -1))].lower()  # letters alone are allowed
            value = value if name != "base32" else value.upper()
            rows += [(name, value, f"see {glue}{value} here") for glue in ("key=", "sk_", "example_key=", "/srv/")]
    df = spark.createDataFrame(rows, "lang string, value string, text string")
    missed = Counter(r.lang for r in secrets.redact(df).collect() if r.value in r.text)
    print(missed)
    assert all(missed[k] <= 0.04 * 800 for k in kinds), missed
    calm = ["id 123e4567-e89b-42d3-a456-426614174000", "01234567890123456789", "AAAAAAAAAAAAAAAAAAAA1", "internationalization of version20"]
    df = spark.createDataFrame([(t,) for t in calm], "text string")
    assert [r.text for r in secrets.redact(df).collect()] == calm
