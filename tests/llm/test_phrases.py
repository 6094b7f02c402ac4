import random
import re
from collections import Counter

import pytest
from data import documents

from ledgerloom.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, top=2000, least=10):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for (lang, *w), a in f.items():
        if len(w) > 1 and a >= least:
            around = max([c for (o, *v), c in f.items() if o == lang and len(v) == 3 and c >= least and tuple(w) in (tuple(v[:2]), tuple(v[1:]))], default=0) if len(w) == 2 else 0
            if 100 * around < 50 * a:
                score, k = min((1000000 * a * a // (f[lang, *w[:k]] * f[lang, *w[k:]]), k) for k in range(1, len(w)))
                out.append((lang, " ".join(w), a, f[lang, *w[:k]], f[lang, *w[k:]], n[lang], score))
    ranked = []
    for lang in sorted({o[0] for o in out}):
        best = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(best, 1)]
    return ranked


def mined(df, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in phrases.mine_phrases(df, **options).select(COLUMNS).collect())


@pytest.mark.parametrize("hot,cells", [(phrases.HOT, 1 << 12), (30, 1 << 12), (0, 1 << 12), (30, 1)])
def test_phrases_are_those_of_a_plain_count(spark, hot, cells):
    r = random.Random(3)
    words = ["the", "of", "The", "a", "a", "Öl", "x\x00y", "rare" + "z" * 50, *[f"w{i}" for i in range(12)]]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r"]) for _ in range(r.randrange(0, 200)))) for _ in range(60)]
    rows += [("en", None), (None, ""), ("en", " ,. \n"), ("fr", "same same " * 40), *[("es", "one two three")] * 12]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert mined(df, hot=hot, cells=cells) == sorted(brute(rows))


def test_best_few_and_ties(spark):
    rows = [("en", f"{a}{i} {b}{i}.") for i in range(9) for a, b in (("b", "c"), ("a", "z"), ("é", "é")) for _ in range(12)]
    df = spark.createDataFrame(rows, "lang string, text string")
    want = sorted(brute(rows, top=5))
    assert mined(df, top=5) == want and [w[2] for w in want] == [f"a{i} z{i}" for i in range(5)]


def test_counts_of_many_digits(spark):
    rows = spark.createDataFrame([("en", 10**14, 3 * 10**14, 10**14 + 7)], "lang string, a long, l long, r long")
    wide = lambda c: rows[c].cast("decimal(15,0)")
    from pyspark.sql import functions as F

    score = F.call_function("div", wide("a") * wide("a") * F.lit(1000000).cast("decimal(7,0)"), wide("l") * wide("r"))
    assert rows.select(score.alias("s")).first().s == 10**34 // (3 * 10**14 * (10**14 + 7))


def test_odd_tables(spark):
    docs, rows = documents(spark)
    assert mined(docs) == sorted(brute([(x[2], x[1]) for x in rows]))
    assert mined(docs.limit(0)) == []
    clashing = docs.selectExpr("*", "1 as a", "'x' as phrase", "2 as n", "3 as word", "4 as rank")
    assert mined(clashing) == mined(docs)
