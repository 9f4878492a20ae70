import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
import regex
from awkward import docs
from pyspark.sql import functions as F

from sparkodds.llm import sanitise

SF = "/root/testdata/sf0.01"
NAMES = ["email", "ip", "card", "phone"]
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    each = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in each) % 10 == 0


def base_by_hand(text):
    """(start, kind, end, entity, left gap, right gap); gaps reach to the next match of the kind."""
    out = []
    for k, pattern in enumerate(PATTERNS):
        all_of = list(re.finditer(pattern, text or ""))
        if k == 2:  # gaps are between matches of 12 to 19 digits
            all_of = [m for m in all_of if 12 <= len(re.sub("[^0-9]", "", m[0])) <= 19]
        for i, m in enumerate(all_of):
            digits = re.sub("[^0-9]", "", m[0])
            if (k == 1 and any(int(x) > 255 for x in m[0].split("."))) or (k == 2 and not luhn(digits)) or (k == 3 and not 9 <= len(digits) <= 15):
                continue
            left = text[all_of[i - 1].end() if i else 0 : m.start()]
            right = text[m.end() : all_of[i + 1].start() if i + 1 < len(all_of) else len(text)]
            out.append((m.start(), k, m.end(), digits if k > 1 else m[0].lower(), left, right))
    return sorted(out)


def words(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", text)


def near_by_hand(left, right):
    a, b = words(left[-100:].lower()), words(right[:100].lower())
    return (a if len(left) <= 100 else a[1:])[-8:], (b if len(right) <= 100 else b[:-1])[:8]


def terms_by_hand(texts, alpha=1.25, support=3):
    f = Counter(w for t in texts for w in words((t or "").lower()))
    total, places, n, phrases = sum(f.values()), Counter(), Counter(), defaultdict(set)
    for t in texts:
        for _, k, _, entity, left, right in base_by_hand(t):
            a, b = near_by_hand(left, right)
            places[k, entity] += len(a + b)
            for w in a + b:
                n[k, entity, w] += 1
                phrases[k, entity, w].add((tuple(a[-2:]), tuple(b[:2])))
    out = {}
    for (k, entity, w), c in n.items():
        value = 1 - math.log(min(1, c / f[w])) / math.log(places[k, entity] / total)
        if len(phrases[k, entity, w]) >= support and value >= 1 / alpha:
            out[w] = max(value, out.get(w, 0))
    return out


def spans_by_hand(text, terms):
    base = [x[:3] for x in base_by_hand(text)]
    more = [(m.start(), 4, m.end()) for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", text or "") if m[0].lower() in terms]
    return base, sorted(base + [x for x in more if all(x[2] <= b[0] or b[2] <= x[0] for b in base)])


def shown(spans):
    return ",".join(f"{[*NAMES, 'term'][k]}:{a}:{e}" for a, k, e in spans)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    word = lambda: rng.choice(common)
    common = ["".join(rng.choice("aeioust") for _ in range(rng.randint(2, 5))) for _ in range(60)] + ["b2", "c3x"]
    out = [" ".join(word() for _ in range(rng.randint(20, 80))) for _ in range(120)]
    for i in range(8):  # one person in several phrasings, and a passage that always repeats
        say = lambda n: " ".join(word() for _ in range(n))
        out.append(f"{say(30)} Zebulon Qwerty {say(2)} zq.{7}@mail.example.com {say(3)} Zebulon {say(30)}")
        out.append(f"{say(20)} call Plugh {say(i % 4)} +1 (523) 555-6210 {say(20)} or ask Plugh's friend")
        out.append(f"{say(9)} write to our frobnicating office at info@example.org for more {say(9)}")
        out.append(f"{say(9)} room XK{40 + 0}c {say(i)} 10.0.0.255 {say(9)} 4111 1111 1111 1111 {say(2)}")
    out += ["a@b.com._x@y.org a@b.c@d.e 1.2.3.4.5.6.7.8 1.2.3.400.5.6.7.8 +1 10.0.0.1 4 00000001.02.3.4"]
    out += ["4111-1111 1111--1111 4111111111111111 41111111111111112222 +49 (0)30 1234-5678 9. +1 2 +123456789012345678"]
    return out + [None, "", "😀 a@b.co 😀 é@é.com x@y-z.e.f. 1.1.1.1😀"]


def test_patterns_find_what_plain_ones_find(spark):
    rng = random.Random(2)
    rows = ["".join(rng.choice("a.@+-1 4(9\n%_") for _ in range(rng.randint(5, 60))) for _ in range(4000)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in sanitise.with_base(table).collect():
        assert [(b.start, b.kind, b.end, b.entity) for b in r.base] == [x[:4] for x in base_by_hand(r.row.text)]


def test_terms_and_spans_by_hand(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = terms_by_hand(texts)
    got = {r.term: r for r in sanitise.disclosing(table).collect()}
    assert {w: pytest.approx(v) for w, v in want.items()} == {w: r.disclosure for w, r in got.items()}
    assert {"zebulon", "qwerty", "plugh", "xk40c"} <= set(got) and "frobnicating" not in got
    assert (got["zebulon"].label, got["xk40c"].label) == ("WORD", "CODE")
    for r in sanitise.find(table, sanitise.disclosing(table)).collect():
        base, spans = spans_by_hand(r.row.text, want)
        assert ([(s.start, s.kind, s.end) for s in r.base], [(s.start, s.kind, s.end) for s in r.spans]) == (base, spans)


def test_sanitised_text(spark, texts):
    table = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, `odd name` long")
    out = {r.doc_id: r for r in sanitise.sanitise(table).collect()}
    assert len(out) == len(texts) and out[3]["odd name"] == 3
    assert out[texts.index(None)].text is None and out[texts.index("")].text == ""
    assert "[WORD] [WORD]" in out[120].text and "[EMAIL]" in out[120].text and "Zebulon" not in out[120].text
    assert "[PHONE]" in out[121].text and "[WORD]'s friend" in out[121].text
    assert "frobnicating office at [EMAIL] for" in out[122].text
    assert "[CODE]" in out[123].text and "[IP]" in out[123].text and "[CARD]" in out[123].text
    assert out[len(texts) - 1].text == "😀 [EMAIL] 😀 é@é.com [EMAIL]. [IP]😀"


def test_a_class_that_discloses_is_taken_out(spark):
    rows = [(i, f"{a} {b} k9 x@y.org {c} {a} some of many other words here {a} {b} {c}") for i, (a, b, c) in enumerate(zip("uvwxyz", "lmnopq", "abcdef", strict=True))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.term: r.label for r in sanitise.disclosing(table).collect()}["k9"] == ""
    assert all(" k9 " not in r.text and "  [EMAIL]" in r.text for r in sanitise.sanitise(table).collect())


def test_running_sums_over_blocks(spark):
    rows = [(n, [i % 7 for i in range(n)]) for n in (0, 1, 255, 256, 257, 1000)]
    table = spark.createDataFrame(rows, "n int, v array<int>")
    for r in table.select("v", sanitise.running("v").alias("s")).collect():
        assert r.s == [sum(r.v[:i]) for i in range(len(r.v))]


def test_long_runs_take_no_square(spark):
    rows = [(1, "a" * 3_000_000), (2, "1" * 3_000_000), (3, "1." * 1_500_000), (4, "+1 " * 300_000), (5, "a@b.c " * 3_000)]
    got = {r.row.doc_id: len(r.base) for r in sanitise.with_base(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 375_000, 4: 0, 5: 3_000}


def test_query_against_plain_search(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    terms = terms_by_hand(rows.values())
    got = sanitise.op11_personal_data(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        base, spans = spans_by_hand(rows[r.doc_id], terms)
        assert r.base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest() and r.spans == shown(spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in base) for j in range(4)]


def test_awkward_rows(spark):
    table = docs(spark)
    found = sanitise.find(table, sanitise.disclosing(table)).collect()
    assert len(found) == table.count() and all(r.spans == [] for r in found)
    clean = sanitise.sanitise(table)
    assert clean.columns == table.columns and clean.exceptAll(table).count() == 0
    none = docs(spark, [])
    assert sanitise.sanitise(none).count() == 0 and sanitise.disclosing(none).count() == 0
