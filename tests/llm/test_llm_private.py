"""Personal data and disclosing words against plain loops."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from corpus_rows import awkward, empty, prose
from staywise.llm import disclosure

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Letters only, between characters that are neither letters nor digits nor "@".
TERM = re.compile(r"^(?:[^\w@]|_)*([^\W\d_](?:[^\W\d_]|['-])*)(?:[^\w@]|_)*$")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10))
    return total % 10 == 0


def base_spans(text: str) -> list[tuple]:
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits or "0"),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def adversarial() -> list[str]:
    rng = random.Random(9)
    texts = [
        "a@b.c%d@e.f", "foo@bar baz@qux.de", "x@a..b x@a.b..c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.0255 001.2.3.4", "999999999999999999999.1.1.1",
        "4465758382889437", "4465 7583-8288 9437 1", "1 2 3 4 5", "9" * 5000, "1 " * 6000, "1-1 " * 3000, "+1 (743) 555-3824", "+1.......", "++1 (743) 555-3824 9", "+12345678901234567",
        "é🙂 me@mail.example.com 日本 +44 20 7946 0958 ß", "%@-.-", "a" * 3000 + "@", ("ab@c " * 900) + "z@y.x", "me@a.b " * 1000, "00.00.00.00", "1.1.1.1" * 50,
    ]
    for _ in range(150):
        texts.append("".join(rng.choice("0123456789.@+- ()aZ%é") for _ in range(rng.randint(1, 120))))
    return texts


def test_base_spans_equal_the_patterns(spark):
    texts = adversarial()
    docs = awkward(spark, *[(100 + k, t, "en", "a", 1) for k, t in enumerate(texts)])
    rows = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    got = disclosure.mentions(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert [tuple(s) for s in r.spans] == base_spans(rows[r.doc_id]), rows[r.doc_id][:200]
    assert disclosure.mentions(empty(spark)).count() == 0 and disclosure.spans_of(empty(spark)).count() == 0


def words_near(text: str, kind: str, spans: list) -> set:
    """(entity, term, start, end) beside the mentions of one kind, word by word."""
    out = set()
    cuts = [m.span() for m in re.finditer(PLAIN[kind], text)]
    for start, _, k, end in spans:
        if k != kind:
            continue
        at = cuts.index((start, end))
        low = cuts[at - 1][1] if at else 0
        high = cuts[at + 1][0] if at + 1 < len(cuts) else len(text)
        value = text[start:end]
        entity = f"{kind}:" + (value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value))
        sides = []
        for a, b, last in ((max(low, start - disclosure.REACH), start, True), (end, min(high, end + disclosure.REACH), False)):
            found = [(m.start() + a, m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text[a:b])]
            if last and start - low > disclosure.REACH:
                found = [f for f in found if f[0] > a]
            if not last and high - end > disclosure.REACH:
                found = [f for f in found if f[0] + len(f[1]) < b]
            sides += found[-disclosure.WINDOW :] if last else found[: disclosure.WINDOW]
        for s, word in sides:
            m = TERM.match(word)
            if m:
                out.add((entity, m[1].lower(), s + m.start(1), s + m.end(1)))
    return out


def test_disclosure_equals_counting(spark):
    rng = random.Random(4)
    texts = []
    for k in range(40):
        parts = prose(k, 60).split()
        for person in range(3):
            if rng.random() < 0.5:
                at = rng.randrange(len(parts))
                parts[at:at] = [f"Dr. {('Zebulon', 'Quimby', 'Prudence')[person]}", f"wrote p{person}@mail.example.com", "to us."]
        texts.append(" ".join(parts) + (" Zebra zeppelin" if k % 3 == 0 else ""))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spoken, near = Counter(), defaultdict(list)
    for k, t in enumerate(texts):
        for w in re.findall(r"[^\x20\x09-\x0D]+", t):
            m = TERM.match(w)
            if m:
                spoken[m[1].lower()] += 1
        for kind in PLAIN:
            for entity, term, _, _ in words_near(t, kind, base_spans(t)):
                near[entity, term].append(k)
    around = Counter()
    for (entity, _), at in near.items():
        around[entity] += len(at)
    n, expected = sum(spoken.values()), {}
    for (entity, term), at in near.items():
        tells = lambda c, of: math.log2(c * n / (of * around[entity])) / math.log2(n / around[entity])
        if len(set(at)) >= 3 and tells(len(at), spoken[term]) >= 0.9:
            alike = sum(len(a) for (e, t), a in near.items() if e == entity and t[:3] == term[:3])
            general = tells(alike, sum(c for t, c in spoken.items() if t[:3] == term[:3]))
            expected[term, entity] = "generalise" if general < 0.9 else "remove"
    found = disclosure.mentions(docs)
    got = {(r.term, r.entity): r.action for r in disclosure.disclosing(docs, found, disclosure.Disclosure()).collect()}
    assert got == expected
    assert {"zebulon", "quimby", "prudence"} <= {t for t, _ in got}


def test_sanitised_text_tells_no_more(spark):
    rows = [(k, f"{prose(k, 30)} Zebulon p@mail.example.com {prose(90 + k, 30)}") for k in range(5)]
    rows += [(5, None), (6, ""), (None, "call +1 (743) 555-3824 now"), (0, rows[0][1]), (0, "another 4465758382889437 text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit("own"), "print": F.lit("own"), "words": F.lit(1)})
    got = disclosure.sanitise(docs)
    assert got.columns == [*docs.columns, "sanitised", "disclosures"]
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        if r.text and "Zebulon" in r.text:
            assert "Zebulon" not in r.sanitised and "[email]" in r.sanitised and "example.com" not in r.sanitised
            assert r.sanitised.startswith(r.text[:20]) and r.sanitised.endswith(r.text[-20:])
    others = {(r.doc_id, r.text): r.sanitised for r in found}
    assert others[None, "call +1 (743) 555-3824 now"] == "call [phone] now" and others[5, None] == "" and others[0, "another 4465758382889437 text"] == "another [card] text"


def test_disclosure_stays_in_the_jvm(spark):
    plan = disclosure.spans_of(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
