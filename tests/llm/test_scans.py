"""Operators 6 and 8 against independent versions."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from framestride.llm import licenses, secrets
from tests.llm.helpers import ODD, write_documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def brute_license(text):
    low = (text or "").translate(FOLD)
    w = WORD.findall(low)
    places, base = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                base.add(label)
    labels, best = set(base), 0.0
    for label, t in licenses.TEMPLATES:
        found = WORD.findall(t.lower())
        words, span = set(found), len(found) * 10 // 9
        for i in range(len(w)):
            both = len(set(w[i : i + span]) & words)
            if both >= math.ceil(licenses.CONTAINED * len(words)):
                labels.add(label)
                best = max(best, both / len(words))
    return (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if places else best)


LICENSED = [
    (60, "MIT License mit license MIT-LICENSE", "s"), (61, "x Apache\nLicense y general public license general public license", "s"), (62, "the mitlicense, mit licenses", "s"),
    (63, "Licensed, under CC: (BY) NC 4.0 or so\nall RIGHTS are reserved", "s"), (64, "license mit", "s"), (65, "KMIT LICENSE İmit license ſ", "s"),
    (66, licenses.TEMPLATES[1][1].replace("granted", "gr").upper(), "s"), (67, licenses.TEMPLATES[6][1].replace("binary", "b").replace("forms", "f").replace("met", "m"), "s"), (68, "mit license", "s"), (69, "  general public license  ", "s"),
    (70, "cc by nc 4 0 licensed\nunder", "s"),
    # wrapped notices, and words of a template far apart on one long line
    (71, "# " + licenses.TEMPLATES[1][1].replace(", ", ",\n# "), "s"), (72, "x " * 400 + licenses.TEMPLATES[6][1].replace(" ", " *\n"), "s"), (73, "all " + "x " * 50 + "rights " + "y " * 50 + "reserved", "s"),
    (74, "the license " * 126 + "the all rights\nreserved " + "under the license " * 300, "s"), (75, "the " * 255 + licenses.TEMPLATES[5][1], "s"),
]


def test_licenses_equal_brute_force(spark, tmp_path):
    rng = random.Random(4)
    vocab = "mit license apache general public released under the all rights reserved licensed cc by nc 4 0 version 2 x y".split()
    rows = ODD + LICENSED + [(100 + i, "".join(rng.choice(vocab) + rng.choice(" \n -.") for _ in range(rng.randint(0, 60 if i else 3000))), "s") for i in range(150)]
    got = licenses.op6_licenses(spark, write_documents(spark, tmp_path / "t", rows)).collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_license(t)) for i, t, _ in rows)


KEY = r"[A-Za-z0-9+/=_-]"
UUID = re.compile("[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


def is_word(s):
    if re.fullmatch("[0-9]{1,8}|[A-Z]{1,20}|[A-Za-z]{1,12}[0-9]{1,4}", s):
        return True
    if not s.isalpha():
        return False
    first, *humps = re.findall("[A-Z]?[a-z]*", s)[:-1]
    low = len(first) - first[:1].isupper()
    camel = len(humps) <= 6 and all(h[0].isupper() and 3 <= len(h) <= 20 for h in humps)
    capitals = len(humps) <= 5 and all(h[0].isupper() and 2 <= len(h) <= 20 for h in [first, *humps])
    return (not first[:1].isupper() and 1 <= low <= 20 and camel) or capitals


def lead(s, backwards=False):
    """How many characters the words at the beginning take, each with the signs behind it."""
    turn = (lambda x: x[::-1]) if backwards else (lambda x: x)
    i = len(s) - len(s.lstrip("/=_-"))
    while True:
        end = next((j for j in range(i, len(s)) if s[j] in "/=_-"), len(s))
        if UUID.fullmatch(turn(s[i : i + 36])) and s[i + 36 : i + 37] in ("/", "=", "_", "-"):
            end = i + 36
        elif end == len(s) or end == i or not is_word(turn(s[i:end])):
            return i
        i = end + len(s[end:]) - len(s[end:].lstrip("/=_-"))


def brute_secrets(text):
    t = text or ""
    spans = []
    for m in re.finditer(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            spans.append((m.start(), 0, m.end()))
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    base = sorted(spans)
    for m in re.finditer(f"{KEY}+", t):
        s = m[0]
        if len(s) < 24:
            continue
        begin = lead(s)
        s = s[begin:]
        s = s[: len(s) - lead(s[::-1], True)]
        if len(s) < 24 or re.search("example|dummy|placeholder|changeme", s.lower()) or re.fullmatch("[0-9+/=_-]+", s) or UUID.fullmatch(s) or (not re.search("[/=_-]", s) and is_word(s)):
            continue
        hexa, letters, b32 = re.fullmatch("[0-9a-f]+|[0-9A-F]+", s), s.isalpha(), re.fullmatch("[A-Z2-7]+", s)
        least = 3.05 if hexa else 3.95 if letters else 3.6 if b32 else 3.85
        hot = []
        for p in range(len(s) - 23):
            c = Counter(s[p : p + 24]).values()
            if -sum(n / 24 * math.log2(n / 24) for n in c) >= least:
                hot.append(p)
        if hot:
            spans.append((m.start() + begin + hot[0], 3, m.start() + begin + hot[-1] + 24))
    show = lambda x: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(x))
    n = Counter(k for _, k, _ in base)
    return n[0], n[1], n[2], hashlib.sha256(show(base).encode()).hexdigest(), show(spans)


RANDOM36, LETTERS64, BASE32 = "kJ8s0QzX4mVt7LpR2wYb9NcD5gHf1TaE6uKi", "qXkzWvJpBnMtYhRgFdLcSaQeUiOwPxZmVyKjTrNbGhDsCfLqAwEkXzJvRpYtMuHo", "JBSWY3DPEHPK3PXPMF2GC3DPNR2HE6LN"
#: Texts and the entropy spans they have, by hand.
FIXED = [
    ("example-bucket/" + RANDOM36, "entropy:15:51"), ("dummy_x=" + RANDOM36, "entropy:8:44"), (LETTERS64, "entropy:0:64"), (BASE32, "entropy:0:32"), (RANDOM36 + "/example/data", "entropy:0:36"),
    ("my-app-key/prod/eu-west-1/service_name", ""), ("how-to-build-a-house-in-10-days-without-tools", ""), ("The/quick/brown/fox/jumps/over/13/lazy/dogs", ""), ("/usr/local/share/java/AbstractFactory/v2", ""),
    ("abstractSingletonProxyFactoryBean", ""), ("wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", ""), ("123e4567-e89b-42d3-a456-426614174000", ""), ("123e4567-e89b-42d3-a456-426614174000/" + RANDOM36, "entropy:37:73"),
    ("123456789012345678901234567890", ""), ("m" * 100, "")]


def test_entropy_spans_of_fixed_texts(spark, tmp_path):
    got = {r["doc_id"]: r["spans"] for r in secrets.op8_secrets(spark, write_documents(spark, tmp_path / "t", [(i, t, "s") for i, (t, _) in enumerate(FIXED)])).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(FIXED)] == FIXED


def test_very_long_candidates_take_time_in_proportion(spark, tmp_path):
    import time

    rng = random.Random(8)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    took = []
    for n in (250_000, 1_000_000):
        rows = [(1, "".join(rng.choices(chars, k=n)), "s"), (2, "a/b-" * (n // 4), "s"), (3, "9z" * (n // 2), "s")]
        where = write_documents(spark, tmp_path / str(n), rows)
        began = time.time()
        got = {r["doc_id"]: r["spans"] for r in secrets.op8_secrets(spark, where).collect()}
        took.append(time.time() - began)
        _, a, b = got[1].split(":")
        assert int(a) < 200 and n - 200 < int(b) <= n and got[2] == got[3] == ""
    assert took[1] < 60 and took[1] < 8 * took[0]


def test_secrets_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    b64 = lambda n: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = ODD + [
        (60, "token: secret: abcdefghi", "s"), (61, "PassWord = 'abc.def=12' tokentoken=\"" + hexa(40) + '"', "s"), (62, "AKIA" + "Q" * 12 + " AKIAX AKIAAKIA" + "1" * 9, "s"),
        (63, "é😀" + hexa(32) + "g" + hexa(31) + " " + hexa(64), "s"), (64, "api_key:12345678 apikey=1234567 api__key=123456789", "s"), (65, b64(60) + "," + b64(23) + "," + b64(24), "s"),
        (66, "a" * 40 + b64(30) + "b" * 40, "s"), (67, "123e4567-e89b-42d3-a456-426614174000 EXAMPLE" + b64(40), "s"), (68, b64(3000), "s"), (69, "x" * 1500 + b64(40) + "y1" * 900, "s"),
        (70, "ſecret=abcdefgh12 toKen=abcdefgh12", "s"), (71, hexa(40), "s"), (72, ("token=" + hexa(8) + " ") * 700, "s"), (73, "secret='abcdefgh", "s"), (74, "ABCDEF0123456789ABCDEF0123", "s"),
    ]
    rows += [(80 + i, t, "s") for i, (t, _) in enumerate(FIXED)]
    rows += [(2000 + i, "".join(rng.choice(["/", "-", "_", "=", "a/", "Ab", "prod", "eu-west-1", "Service", "name", b64(30), b64(9), hexa(26), "X2", "123", "123e4567-e89b-42d3-a456-426614174000", " "]) for _ in range(rng.randint(2, 12))), "s") for i in range(200)]
    alphabet = ["token", "=", " ", "secret", ":", '"', "AKIA", "A1B2C3D4E5F6", "0a1b2c3d", "zZ9+", "é", "\n", "password", "'"]
    rows += [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))), "s") for i in range(150)]
    got = secrets.op8_secrets(spark, write_documents(spark, tmp_path / "t", rows)).collect()
    want = Counter((i, *brute_secrets(t)) for i, t, _ in rows)
    assert Counter(map(tuple, got)) == want
    assert sum("entropy" in k[-1] for k in want) > 8


@pytest.mark.parametrize("op", [licenses.op6_licenses, secrets.op8_secrets])
def test_empty_tables(spark, tmp_path, op):
    assert op(spark, write_documents(spark, tmp_path / "t", [])).count() == 0
