import random
import re
import time

import brute

from ledgerloom.llm import personal

ODD = [
    None, "", "a@b.c", "x@y", "a@b.c_d@e.f", "a@b.cx.y@z.w", "..a@b.co.uk..", "mail me: some.one@mail.example.com, or call +1 (325) 555-8094.",
    "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.255 1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 5500000000000004", "4111111111111112", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0",
    "+1", "+12", "+123-", "+1234567", "+12 (34).56-78", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "++49 170 1234567 )", "é" * 5 + " +49 30 123456 ß a@b.de", "9" * 5000, "a." * 3000 + "@x", "x@" + "a." * 3000 + "b", "+" * 50 + "1" * 30,
    "write to jane (at) example (dot) com or call (325) 555-8094 / 325-555-8094",
]


def spans(text):
    return [(kind, lo, hi) for kind, lo, hi in brute.personal(text)]


def test_base_matches_plain_patterns(spark):
    r = random.Random(4)
    alphabet = ["@", ".", "-", " ", "+", "(", ")", "1", "2", "0", "255", "a", "b", "_", "é", "\n"]
    rows = ODD + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 120))) for _ in range(400)]
    rows += ["".join(r.choice(["4111111111111111", " ", "-", "5", "+", "1.1.1.1", "x"]) for _ in range(12)) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for x in personal.find_personal(df).collect():
        assert [tuple(s) for s in x.base] == spans(rows[x.doc_id]), rows[x.doc_id]
        assert set(map(tuple, x.base)) <= set(map(tuple, x.spans))
    assert personal.find_personal(df.limit(0)).count() == 0


def test_labelers_add_spans_beyond_the_strict_rules(spark):
    plain = [f"please call ({200 + i}) 555-{8000 + i} or mail to user{i} (at) example (dot) com, phone +1 {300 + i} 555 {1000 + i}, e-mail u{i}@example.com" for i in range(60)]
    noise = [f"release {i}.{i + 1} of 300-400-{5000 + i} rows" for i in range(3)]
    df = spark.createDataFrame(list(enumerate(plain + noise)), "doc_id long, text string")
    got = {r.doc_id: [s.kind for s in r.spans] for r in personal.find_personal(df).collect()}
    assert all(got[i].count("phone") == 2 and got[i].count("email") == 2 for i in range(60))


def test_estimate_tells_good_labelers_from_bad():
    # personal data votes shape, gazetteer, check; the rest only now and then one of them
    counts = {0b1011: 900, 0b1111: 80, 0b0000: 500, 0b0100: 60, 0b0001: 20, 0b1010: 10}
    p = personal.estimate(counts)
    assert p[0b1011] > 0.9 and p[0b1111] > 0.9 and p[0b0000] < 0.1 and p[0b0100] < 0.3
    assert personal.estimate({}) == {}


def test_texts_full_of_data_take_time_by_their_length(spark):
    pieces = ["a@b.co ", "1.2.3.4 ", "+1 555 123 4567, ", "jane (at) x (dot) com; ", "(325) 555-8094 ", "4111111111111111 ", 'token = "04dbebab91ab85687d" ']
    took = []
    for n in (1, 10_000, 20_000):
        rows = [p * n for p in pieces] + ["".join(pieces) * (n // 4)]
        df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        began = time.time()
        got = {r.doc_id: (r.n, r.hi) for r in personal.find_personal(df).selectExpr("doc_id", "size(base) AS n", "get(base, size(base) - 1).hi AS hi").collect()}
        took.append(time.time() - began)
        expected = [spans(t) for t in rows]
        assert got == {i: (len(x), x[-1][2] if x else None) for i, x in enumerate(expected)}
    assert took[2] < 2.5 * took[1] + 3 and took[2] < 60, took


def test_added_spans_of_the_table(spark):
    """Recall of personal data and secrets as the table plants them; texts without a digit and an at sign stay clean."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: (r.text, [(s.kind, s.lo, s.hi) for s in r.spans]) for r in personal.find_personal(docs).collect()}
    planted = clean = 0
    for text, spans in found.values():
        secret = [m.span() for m in re.finditer(r'token = "[0-9A-Fa-f]{40}"', text or "")]
        assert [x[1:] for x in spans if x[0] == "secret"] == secret
        planted += bool(secret)
        clean += not re.search(r"[0-9]", text or "")
        assert re.search(r"[0-9]", text or "") or not spans
    assert planted and clean
