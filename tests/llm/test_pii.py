"""Base patterns against plain regular expressions; disclosing terms against counts made by hand."""

import math
import random
import re
from collections import defaultdict

import pytest

from graphloom.llm import pii
from graphloom.llm.pii import Disclosure, base_spans, find_personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 8 <= len(digits) <= 15}[kind]
            if good():
                out.append((kind, *m.span()))
    return out


def test_base_against_plain_patterns():
    rng = random.Random(4)
    parts = ["a", "b.c", "@", "@", ".", "-", "é", " ", "1", "22", "255", "256", "0001", "4111 1111 1111 1111", "4111-1111-1111-1111", "+", "+49 (0) 30 1234", "x@y.z", "10.0.0.1", ".5", "\n", "７"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base_spans(text) == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("a" * 300_000 + "@", "a@" * 100_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "x" * 300_000 + "@b.c"):
        base_spans(text)


def brute_terms(rows, rule):
    near, contexts, docs, holders = defaultdict(set), defaultdict(set), defaultdict(set), defaultdict(set)
    for key, text in set(rows):
        words = [(m.start(), m.end(), re.sub("[A-Z]", lambda x: x[0].lower(), m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        spans = base_spans(text or "")
        inside = {i for i, (a, b, _) in enumerate(words) for _, x, y in spans if a < y and b > x}
        for kind, x, y in spans:
            low, high = [i for i, w in enumerate(words) if w[1] <= x], [i for i, w in enumerate(words) if w[0] >= y]
            around = [i for i in low[-pii.CONTEXT :] + high[: pii.CONTEXT] if i not in inside]
            for i in around:
                near[text[x:y], words[i][2]].add((key, text))
                contexts[text[x:y], words[i][2]].add(tuple(words[j][2] for j in around))
                holders[text[x:y]].add((key, text))
    for row in rows:
        for w in {re.sub("[A-Z]", lambda x: x[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")}:
            docs[w].add(rows.index(row))
    return {t for (v, t), found in near.items() if len(contexts[v, t]) >= rule.contexts and len(found) / len(docs[t]) >= rule.generalise and math.log2(len(found) * len(rows) / (len(docs[t]) * len(holders[v]))) >= rule.bits}


@pytest.mark.parametrize("limit", [10**6, 0])
def test_disclosing_terms(spark, monkeypatch, limit):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", limit)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(50)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, say(40)) for i in range(60)]
    rows += [(100 + i, f"{say(5)} Zeus {say(3)} z@olymp.gr {say(3)} Thunder {say(9)}") for i in range(5)]
    rows += [(200, f"{say(5)} zeus {say(5)}"), (201, "thunder zeus"), (202, None), (203, ""), (None, "zeus z@olymp.gr")]
    copy = f"{say(4)} copied +49 30 1234567 {say(4)}"
    rows += [(300 + i, copy) for i in range(9)]
    rule = Disclosure(bits=2.0)
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, spans int").repartition(3)
    told = brute_terms(rows, rule)
    assert {"zeus", "thunder"} <= told and "copied" not in told
    for r in find_personal_data(docs, ["spans"], rule).collect():
        text = next(t for k, t in rows if k == r.doc_id)
        assert r.spans_input == 1
        base = base_spans(text or "")
        touched = lambda a, b: any(a < y and b > x for _, x, y in base)  # noqa: B023, E731
        terms = [("term", m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "") if m[0].lower() in told and not touched(m.start(), m.end())]
        assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in base + terms)
        assert r.base == ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.sanitised is None) == (text is None) and "olymp" not in (r.sanitised or "")


def test_clashing_columns_and_empty(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c", 5)], "doc_id long, text string, term long")
    assert find_personal_data(docs, ["term"]).select("term", "n_email", "sanitised").collect() == [(5, 1, "mail [EMAIL]")]
    assert find_personal_data(docs.limit(0)).collect() == []
    docs = spark.createDataFrame([(1, "mail a@b.c", 5, "x", "y", 2.5)], "doc_id long, text string, spans int, n_email string, Sanitised string, base double")
    got = find_personal_data(docs, ["spans", "n_email", "Sanitised", "base"])
    assert got.columns[:5] == ["doc_id", "spans_input", "n_email_input", "Sanitised_input", "base_input"]
    assert [tuple(r) for r in got.collect()] == [(1, 5, "x", "y", 2.5, 1, 0, 0, 0, "email:5:10", "email:5:10", "mail [EMAIL]")]
