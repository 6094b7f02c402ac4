"""Quality rules: how far a document's character classes and common words diverge from its language's reference.

Two histograms stand for a document: its characters (code points) by class, and the common words of its language by word.
Both are compared with the language's reference by Jensen-Shannon distance (base 2, so 0 to 1). References are the mean
histograms of all documents of the language that are long enough, or come as a table. A histogram speaks only if it is
based on `least_chars` characters, or on `least_common` common words or a text of `long_words` words; below that the
document is not judged by it. Base rules reject very short and very repetitive documents beforehand. Texts are read once:
what is measured is written, references are made from that, and so are the verdicts.

A null text has no words and fails. A null language is a language of its own (so is an empty one), and one without a word
list is judged by characters and all lists' words. Repeated rows are judged alike (and count each in the references);
empty tables give no rows; columns of docs named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, held, materialize

#: Common words by language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "was", "on", "with", "it", "as", "are", "this"],
    "fr": ["le", "la", "les", "de", "et", "un", "une", "des", "est", "que", "en", "du", "pour", "dans", "qui"],
    "de": ["der", "die", "das", "und", "in", "zu", "den", "mit", "von", "ist", "des", "ein", "für", "im", "dem"],
    "es": ["el", "la", "los", "de", "que", "y", "en", "un", "una", "por", "con", "para", "se", "las", "no"],
}
CLASSES = {"upper": "[A-Z]+", "digit": "[0-9]+", "symbol": r"[#*$%&|<>]+", "mark": r"[!-\"'-/:-;=?@\[-`{}~]+"}
#: Languages whose references are broadcast at most; a table with more is joined.
BROADCAST_LANGUAGES = 10_000
#: Words from which a text is judged by its common words, however few these are.
LONG_WORDS = 150
_SPACES = " \t\n\x0b\x0c\r"
_WHITE = r"[\x20\x09-\x0D]+"
_PLACE = (1 << 24) - 1


def _bytes_of(text: Column, pattern: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.regexp_replace(text, pattern, ""))


def _split(docs: DataFrame, text_col: str, lang_col: str, own: list[Column]) -> DataFrame:
    """own columns, text, lang, words and word_chars."""
    rows = docs.select(*own, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    trimmed = F.btrim("text", F.lit(_SPACES))
    rows = held(rows, words=F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _WHITE)))
    return held(rows, word_chars=F.char_length(F.array_join("words", "")))


def _histograms(rows: DataFrame) -> DataFrame:
    """rows of _split with `chars` and `common`: counts by class (the last is what is in none) and by common word."""
    white = F.char_length("text") - F.col("word_chars")
    other = F.char_length(F.regexp_replace("text", r"[\x00-\x7F]++", ""))
    every = sorted({w for words in COMMON.values() for w in words})
    # common words between spaces, two in between, so that each can be taken out and counted by the bytes that go
    seen = F.concat(F.lit(" "), F.array_join(F.filter(F.transform("words", F.lower), lambda w: w.isin(every)), "  "), F.lit(" "))
    rows = held(rows, classes=F.array(*[c.cast("double") for c in (*[_bytes_of(F.col("text"), p) for p in CLASSES.values()], white, other)]), seen=seen)
    count = lambda w: ((F.octet_length("seen") - F.octet_length(F.replace(F.col("seen"), F.lit(f" {w} "), F.lit("")))) / (len(w.encode()) + 2)).cast("double")
    by = F.when(F.lit(False), F.array().cast("array<double>"))
    for lang, words in COMMON.items():
        by = by.when(F.col("lang") == lang, F.array(*[count(w) for w in words]))
    rest = F.greatest(F.char_length("text") - _total("classes"), F.lit(0.0))
    return held(rows, chars=F.concat("classes", F.array(rest)), common=by.otherwise(F.array(*[count(w) for w in every]))).drop("classes", "seen")


def _repeated(rows: DataFrame) -> DataFrame:
    """rows with n_repeat_words: the words in 3-word windows that the text has twice or more.

    Windows are sorted by the upper bits of their hash with their place below, so that one sort of numbers brings equal
    ones together. Where two neighbours of equal upper bits have other words (or a text has more places than fit), the
    windows are sorted by their words instead.
    """
    at = lambda a, i: F.get(F.col(a), i)
    last = F.greatest(F.size("words") - 2, F.lit(0))
    rows = held(rows, h=F.transform(F.slice("words", 1, last), lambda x, i: F.xxhash64(x, at("words", i + 1), at("words", i + 2))))
    again = F.size(F.array_distinct("h")) < F.size("h")
    rows = held(rows, sorted=F.when(again, F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(i.cast("long"))))))
    place = lambda x: x.bitwiseAND(F.lit(_PLACE)).cast("int")
    near = lambda x, y: F.coalesce(x.bitwiseXOR(y).bitwiseAND(F.lit(~_PLACE)) == 0, F.lit(False))
    words = lambda i: F.struct(at("words", i), at("words", i + 1), at("words", i + 2))
    mixed = F.exists(F.transform("sorted", lambda x, i: near(x, at("sorted", i + 1)) & (words(place(x)) != words(place(at("sorted", i + 1))))), lambda x: F.coalesce(x, F.lit(False)))
    plainly = F.when((F.size("words") > _PLACE) | mixed, F.array_sort(F.transform(F.slice("words", 1, last), lambda x, i: F.struct(x.alias("a"), at("words", i + 1).alias("b"), at("words", i + 2).alias("c"), i.alias("i")))))
    rows = held(rows, by_words=plainly)
    both = lambda same, a, x, i: F.coalesce(same(x, at(a, i + 1)), F.lit(False)) | F.when(i > 0, same(x, at(a, i - 1))).otherwise(False)
    equal = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    found = F.transform(F.filter("sorted", lambda x, i: both(near, "sorted", x, i)), place)
    exact = F.transform(F.filter("by_words", lambda x, i: both(equal, "by_words", x, i)), lambda x: x["i"])
    rows = held(rows, places=F.sort_array(F.when(F.col("by_words").isNotNull(), exact).otherwise(found)))
    covered = F.aggregate(F.transform("places", lambda x, i: F.least(F.lit(3), F.coalesce(at("places", i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("h", "sorted", "by_words", "places")


def _total(c: Column | str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def references(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least_words: int = 50) -> DataFrame:
    """(lang, chars, common): the mean shares of all documents of `least_words` words, by language; each counts alike."""
    return _means(_histograms(_split(docs, text_col, lang_col, []).where(F.size("words") >= least_words)))


def _means(rows: DataFrame) -> DataFrame:
    sizes = {"chars": len(CLASSES) + 3, "common": max(len({w for v in COMMON.values() for w in v}), *map(len, COMMON.values()))}
    rows = held(rows, n_chars=_total("chars"), n_common=_total("common"))
    sums = rows.groupBy("lang").agg(*[F.avg(F.when(F.col(f"n_{c}") > 0, F.try_element_at(c, F.lit(i + 1)) / F.col(f"n_{c}"))).alias(f"{c}{i}") for c, n in sizes.items() for i in range(n)])
    share = lambda c, n: F.filter(F.array(*[F.col(f"{c}{i}") for i in range(n)]), lambda x: x.isNotNull())
    return sums.select("lang", *[share(c, n).alias(c) for c, n in sizes.items()])


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance of two histograms of the same bins (base 2); null where one is empty or has other bins."""
    tp, tq = _total(p), _total(q)
    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    each = F.zip_with(p, q, lambda a, b: term(a / tp, b / tq) + term(b / tq, a / tp))
    return F.when((tp > 0) & (tq > 0) & (F.size(p) == F.size(q)), F.sqrt(F.greatest(_total(each) / 2, F.lit(0.0))))


def score_quality(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least_words: int = 50, least_chars: int = 250, least_common: int = 20, most_char_distance: float = 0.17, most_word_distance: float = 0.55, long_words: int | None = LONG_WORDS, reference: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed and kept.

    A text of `long_words` words is judged by its common words however few it has; with none it is as far as can be.
    carry: the columns of docs in the result, all if not given (they are written once with what is measured).
    """
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")
    own = Carried(docs if carry is None else docs.select(*["`" + c.replace("`", "``") + "`" for c in carry]), results)
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_SPACES)) != "")
    rows = held(_repeated(_histograms(_split(docs, text_col, lang_col, own.into))), lines=lines)
    rows = rows.select(
        *own.names, "lang", "chars", "common", "n_repeat_words",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.element_at("chars", 1 + list(CLASSES).index("symbol")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    measured = materialize(rows, "measured")
    known = materialize(_means(measured.where(F.col("n_words") >= least_words)) if reference is None else reference.select("lang", "chars", "common"), "references")
    known = known.select(F.col("lang").alias("of"), F.col("chars").alias("ref_chars"), F.col("common").alias("ref_common"))
    if known.count() <= BROADCAST_LANGUAGES:
        known = F.broadcast(known)
    enough = _total("common") >= least_common
    if long_words is not None:
        enough = enough | (F.col("n_words") >= long_words)
    far = F.when((_total("common") == 0) & (_total("ref_common") > 0), 1.0).otherwise(jensen_shannon(F.col("common"), F.col("ref_common")))
    judged = measured.join(known, F.col("lang").eqNullSafe(F.col("of")), "left").select(
        *own.names, *results[:5],
        F.when(_total("chars") >= least_chars, jensen_shannon(F.col("chars"), F.col("ref_chars"))).alias("char_distance"),
        F.when(enough, far).alias("word_distance"),
    )
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    beyond = (F.coalesce("char_distance", F.lit(0.0)) > most_char_distance) | (F.coalesce("word_distance", F.lit(0.0)) > most_word_distance)
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~failed & ~beyond)
    return judged.select(*own.back, *results)


def keep_good(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that the rules keep, with their own columns, whatever these are called."""
    own = Carried(docs)
    rows = docs.select(*own.into)
    return score_quality(rows, text_col=own.of[text_col], lang_col=own.of[lang_col], **options).where("kept").select(*own.back)
