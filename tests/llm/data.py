"""Fixtures with the odd cases: nulls, empty, very long, ties, repeated rows."""

import random

ALPHA = ["the", "of", "Rain", "stone", "river", "light", "and", "to", "field", "corn", "naïve", "straße", "x1", "42"]


def texts(n=120, seed=7):
    r = random.Random(seed)
    out = [None, "", "   \n\t ", "one", "two words", "MIT License", "a\x00b c\x1fd", "x" * 3000, "it's 10,5 % off -- now"]
    base = [" ".join(r.choice(ALPHA) + str(r.randrange(40)) for _ in range(r.randrange(3, 160))) for _ in range(n // 2)]
    for t in base:
        out.append(t)
        w = t.split()
        w[r.randrange(len(w))] = "changed"
        out.append(" ".join(w) if r.random() < 0.7 else t)
    out.append("\n".join(["same line of some words here", "", "same line of some words here", "other"] * 30))
    out.append(" ".join(r.choice(ALPHA) for _ in range(9000)))
    out.append("Licensed under the Apache License, Version 2.0 (the License) and the GNU General Public License; mit license MIT-LICENSE")
    return out


def documents(spark, n=120, seed=7):
    langs = ["en", "fr", "de", "es", None, "xx"]
    rows = [(i, t, langs[i % 6], f"src{i % 3}" if i % 7 else None) for i, t in enumerate(texts(n, seed))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5), rows
