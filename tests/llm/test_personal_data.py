"""Personal data: base spans against the plain patterns, long texts, and what the trees find in forms they were not shown."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from pathloom.llm import pii

RNG = random.Random(11)
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    holds = {
        "email": lambda m: True,
        "ip": lambda m: all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.split(".")),
        "card": lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and brute_luhn(re.sub("[^0-9]", "", m)),
        "phone": lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return [[m.span() for m in re.finditer(PLAIN[k], text) if holds[k](m[0])] for k in PLAIN]


def with_check_digit(body):
    return next(f"{body}{d}" for d in range(10) if brute_luhn(f"{body}{d}"))


def test_base_spans_equal_the_plain_patterns():
    bits = ["1", "23", "255", "256", "007", ".", ".", "..", " ", "-", "+", "(", ")", "@", "a", "B.c", "é", "1.2.3.4", "+1 (555) 123-4567", "x@y.zz", with_check_digit("4" * 15), with_check_digit("4" * 16), "4" * 16, "0" * 6]
    for _ in range(20_000):
        t = "".join(RNG.choice(bits) for _ in range(RNG.randrange(12)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_long_runs_of_digits():
    n = 5000
    texts = ["1" * n, "1.2.3." + "0" * n + "1", "1.2.3." + "0" * n + "999", "1" * n + ".2.3.4", "+" + "1" * n, "9 " * n, "1.1.1.1." * 200, f"a@{'1' * n}.de", "1" * n + "@b.de"]
    for t in texts:
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans(texts[1])[1] == [(0, len(texts[1]))] and pii.base_spans(texts[2])[1] == []


@pytest.mark.parametrize("unit", ["1", "1.1.", "a-", "x@y.zz ", "@", "(at)", "+1 (", "9 ", "1:", "[.]1", "a1"])
def test_time_follows_the_length(unit):
    took = []
    for n in (20_000, 80_000):
        t = unit * (n // len(unit))
        began = time.process_time()
        pii.base_spans(t)
        pii.candidates(t)
        took.append(time.process_time() - began)
    assert took[1] < max(0.5, 12 * took[0])


def prose(n):
    return " ".join(RNG.choice(["then", "onre", "thing", "of", "haea", "Ntion.", "call", "mail"]) for _ in range(n))


def seeds():
    host = f"{RNG.choice(['mail', 'post'])}{RNG.randrange(90)}.example.{RNG.choice(['com', 'org'])}"
    return {
        "email": f"{RNG.choice(['ann', 'bob', 'eva'])}.{RNG.randrange(99)}@{host}",
        "ip": ".".join(str(RNG.randrange(256)) for _ in range(4)),
        "card": with_check_digit("4" + "".join(RNG.choice("0123456789") for _ in range(14))),
        "phone": f"+1 ({200 + RNG.randrange(700)}) 555-{RNG.randrange(10000):04}",
    }


def fitted():
    x, y, aside = [], [], []
    for i in range(500):
        parts = [prose(12)]
        for s in seeds().values():
            parts += [s, prose(10)]
        parts += ['token = "%s"' % hashlib.sha1(str(i).encode(), usedforsecurity=False).hexdigest(), prose(8)]
        for _, _, f, good in pii.examples(" ".join(parts), str(i)):
            x.append(f)
            y.append(good)
            aside.append(i % 4 == 0)
    return pii.fit(np.array(x, float), np.array(y), np.array(aside))


def test_trees_find_forms_that_were_not_planted():
    model = fitted()
    assert len(next(iter(pii.examples("1.2.3.4", "0")))[2]) == pii.FEATURES
    rng = random.Random(5)
    new = {
        "email": [lambda s: s.replace("@", " [at] "), lambda s: s.replace("@", "(AT)"), lambda s: " [dot] ".join(s.replace("@", " [at] ").rsplit(".", 1))],
        "ip": [lambda s: s.replace(".", "[:]")],
        "card": [lambda s: pii.regrouped(s, "_").replace("_", ".", 1)],
        "phone": [lambda s: "{}-{}.{}".format(*pii.last_ten(pii.only_digits(s))), lambda s: "({}){}-{}".format(*pii.last_ten(pii.only_digits(s)))],
    }
    for kind, forms in new.items():
        found = wrong = 0
        for k in range(200):
            span = forms[k % len(forms)](seeds()[kind])
            before = prose(9) + " "
            text = f"{before}{span} {prose(6)} {pii.decoy(rng)} {prose(6)}"
            added = pii.added_spans(text, pii.base_spans(text), model)
            found += any(a < len(before) + len(span) and len(before) < b for _, a, b in added)
            wrong += any(a >= len(before) + len(span) for _, a, b in added)
        assert found >= 170 and wrong <= 40, (kind, found, wrong)
    for k in range(50):
        text = f"{prose(5)} {hashlib.sha1(f'{k} new'.encode(), usedforsecurity=False).hexdigest()} {prose(5)}"
        assert [s[0] for s in pii.added_spans(text, pii.base_spans(text), model)] == ["secret"]


def test_clashing_columns_and_one_id_twice(spark):
    rows = [(1, "x a.b@c.de", "s", "t"), (1, "y 1.2.3.4", None, "t"), (None, None, "s", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, base string")
    got = sorted((r.doc_id or 0, r.n_email, r.n_ip) for r in pii.find(docs.select("doc_id", "text"), {"thresholds": {}}, ["doc_id"]).collect())
    assert got == [(0, 0, 0), (1, 0, 1), (1, 1, 0)]
