"""The queries of the operators in this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, licenses, line_dedup, pages, periodic, personal, phrases, quality, repeats, sharding, simhash, toxicity
from .common import held

#: Shards and slots of the placement query.
SHARDS = [f"shard-{i:02d}" for i in range(16)]
SLOTS = 4_099


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _sorted_join(c: str) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(c)), ",")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")
    found = decontaminate.decontaminate(docs.select("doc_id", "text"), items)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _sha(_sorted_join("items")).alias("items_sha256"), "contaminated")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = line_dedup.dedup_lines(docs.select("doc_id", "source", "text"), docs["source"])
    return found.select("doc_id", "source", "n_lines", "n_dropped", _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.score_quality(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), carry=["doc_id"])
    rounded = [F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")]
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *rounded)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decoded_col="decoded")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), _sha(F.array_join("ids", ",")).alias("ids_sha256"), _sha(F.col("decoded")).alias("decoded_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    starts = F.transform("places", lambda x: x["start"])
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), _sorted_join("base_labels").alias("base_labels"), _sorted_join("labels").alias("labels"), "score")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract_main(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["lo"].cast("string"), x["hi"].cast("string"))), ",")
    return found.select("doc_id", *map(number, personal.BASE), _sha(listed("base")).alias("base_sha256"), listed("spans").alias("spans"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", SHARDS, SLOTS)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    index = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_toxicity(docs, index)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.transform("evidence", lambda x: x["doc_id"].cast("long")).alias("evidence"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(_read(spark, sf_dir, "documents").select("lang", "text"))


def repeating(docs: DataFrame) -> DataFrame:
    """docs where one text in ten (by its id's CRC-32) goes on with a stretch of its own words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    rows = held(docs.select("doc_id", "text", F.floor(h / 10).alias("_g")), _w=words).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int"))
    rows = rows.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))
    rest = F.col("_n") - F.col("_a")
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.ceil(rest / F.col("_p")).cast("int")))
    text = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), rest)), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(repeating(_read(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda x: F.struct(x["length"].alias("length"), (-x["start"]).alias("start"), (-x["period"]).alias("period"))))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), "runs", "collapsed")
    length, start, period = F.col("best.length"), -F.col("best.start"), -F.col("best.period")
    listed = F.array_join(F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n"))), "")
    return rows.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"), _sha(listed).alias("runs_sha256"), _sha(F.col("collapsed")).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": op1,
    "op2_line_dedup": op2,
    "op3_quality_rules": op3,
    "op4_bpe_codec": op4,
    "op5_license_scan": op5,
    "op6_html_extraction": op6,
    "op7_suffix_array_dedup": op7,
    "op8_personal_data": op8,
    "op9_simhash_near_dedup": op9,
    "op10_sharding": op10,
    "op11_toxicity": op11,
    "op12_phrase_collocations": op12,
    "op13_periodic_runs": op13,
}

_TRIM = r"nullif(regexp_replace(line, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g'), '')"

#: Shards take their turns one by one: the state is each shard's place in its order and which slots are taken.
_N, _M = len(SHARDS), SLOTS
_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"
_TABLE = f"""WITH RECURSIVE s AS (SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({_N}) r(i)),
o AS (SELECT list({_HASH.format("'offset:' || name")} % {_M} ORDER BY i) AS place, list({_HASH.format("'skip:' || name")} % {_M - 1} + 1 ORDER BY i) AS skip FROM s),
t(turn, slot, owner, place, taken) AS (
  SELECT 0::BIGINT, NULL::BIGINT, NULL::BIGINT, place, list_transform(range({_M}), lambda x: FALSE) FROM o
  UNION ALL
  SELECT turn + 1, f, turn % {_N}, list_transform(place, lambda x, i: CASE WHEN i = turn % {_N} + 1 THEN f ELSE x END), list_transform(taken, lambda x, i: x OR i = f + 1)
  FROM (SELECT *, (p + j * k) % {_M} AS f FROM (SELECT *, list_position(list_transform(range({_M}), lambda x: taken[((p + x * k) % {_M}) + 1]), FALSE) - 1 AS j
    FROM (SELECT t.turn, t.place, t.taken, t.place[t.turn % {_N} + 1] AS p, o.skip[t.turn % {_N} + 1] AS k FROM t, o WHERE t.turn < {_M}))))"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(_LOWER)
_DECONTAMINATION = f"""WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE {_WORDS.format("text")} END AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT DISTINCT item_id, k, array_to_string(w[a:a + k - 1], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS a FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, k, a, array_to_string(w[a:a + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM c) WHERE len(w) >= k)),
m AS (SELECT g.doc_id, g.k, g.a, c.item_id FROM g JOIN c ON g.k = c.k AND g.win = c.win),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(a, a + k)) AS p FROM m) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), FALSE) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)"""


def _quality_sql() -> str:
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    lists = quality.COMMON | {"": sorted({w for words in quality.COMMON.values() for w in words})}
    common = "CASE lang " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in lists.items() if k) + f" ELSE {quoted(lists[''])} END"
    left = lambda p: "strlen(text) - strlen(regexp_replace(text, '{}', '', 'g'))".format(p.replace("'", "''"))
    classes = ", ".join(f"({left(p)})::DOUBLE" for p in quality.CLASSES.values())
    term = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
    distance = lambda p, q: f"CASE WHEN list_sum({p}) > 0 AND list_sum({q}) > 0 THEN sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(f'({p}[i] / list_sum({p}))', f'({q}[i] / list_sum({q}))')} + {term(f'({q}[i] / list_sum({q}))', f'({p}[i] / list_sum({p}))')})) / 2, 0)) END"
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ 	-
]+'), lambda x: x <> '') AS words, list_filter(string_split_regex(lower(text), '[ 	-
]+'), lambda x: x <> '') AS lowered, {common} AS listed FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM (SELECT doc_id, i, array_to_string(words[i:i + 2], ' ') AS tri FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2))),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-
]') GROUP BY 1),
c AS (SELECT *, length(array_to_string(words, '')) AS word_chars, [{classes}] AS part, list_transform(listed, lambda x: len(list_filter(lowered, lambda y: y = x))::DOUBLE) AS common FROM w),
e AS (SELECT *, list_concat(part, [(length(text) - word_chars)::DOUBLE, length(regexp_replace(text, '[\x00-\x7F]+', '', 'g'))::DOUBLE]) AS six FROM c),
h AS (SELECT *, list_append(six, greatest(length(text) - list_sum(six), 0)) AS chars FROM e),
a AS (SELECT lang, list(v ORDER BY i) AS ref FROM (SELECT lang, i, avg(v) AS v FROM (SELECT lang, unnest(range(1, len(chars) + 1)) AS i, unnest(list_transform(chars, lambda x: x / list_sum(chars))) AS v FROM h WHERE len(words) >= 50 AND list_sum(chars) > 0) GROUP BY 1, 2) GROUP BY 1),
b AS (SELECT lang, list(v ORDER BY i) AS ref FROM (SELECT lang, i, avg(v) AS v FROM (SELECT lang, unnest(range(1, len(common) + 1)) AS i, unnest(list_transform(common, lambda x: x / list_sum(common))) AS v FROM h WHERE len(words) >= 50 AND list_sum(common) > 0) GROUP BY 1, 2) GROUP BY 1),
j AS (SELECT h.doc_id, len(words)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, part[3]::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  CASE WHEN list_sum(chars) >= 250 THEN {distance("h.chars", "a.ref")} END AS char_distance, CASE WHEN list_sum(common) >= 20 OR len(words) >= {quality.LONG_WORDS} THEN CASE WHEN list_sum(common) = 0 AND list_sum(b.ref) > 0 THEN 1.0 ELSE {distance("h.common", "b.ref")} END END AS word_distance
  FROM h LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN a ON a.lang IS NOT DISTINCT FROM h.lang LEFT JOIN b ON b.lang IS NOT DISTINCT FROM h.lang),
k AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(char_distance, 0) <= 0.17 AND coalesce(word_distance, 0) <= 0.55 AS kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM k"""


_PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, phrase, count(*) AS c FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)) GROUP BY ALL),
c AS (SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND c >= 10),
x AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS around FROM x GROUP BY 1, 2),
k AS (SELECT c.* FROM c LEFT JOIN m USING (lang, phrase) WHERE around IS NULL OR 100 * around < 50 * a),
s AS (SELECT k.lang, k.phrase, a, l.c AS l, r.c AS r, j, 1000000::HUGEINT * a * a // (l.c::HUGEINT * r.c) AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM k) k JOIN g l ON l.lang = k.lang AND l.phrase = array_to_string(w[1:j], ' ') JOIN g r ON r.lang = k.lang AND r.phrase = array_to_string(w[j + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM g WHERE k = 1 GROUP BY 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= 2000"""


ORACLE_SQL: dict[str, str] = {
    "op12_phrase_collocations": _PHRASES,
    "op1_benchmark_decontamination": _DECONTAMINATION,
    "op3_quality_rules": _quality_sql(),
    "op2_line_dedup": f"""WITH p AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1 HAVING count(*) >= 20),
e AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
k AS (SELECT *, {_TRIM} AS kept FROM e),
h AS (SELECT source, kept, count(DISTINCT doc_id) AS held FROM k WHERE kept IS NOT NULL GROUP BY 1, 2),
b AS (SELECT h.source, kept FROM h JOIN p USING (source) WHERE held > 1 AND held > 0.08::DOUBLE * pages),
m AS (SELECT k.*, b.kept IS NOT NULL AS bad FROM k LEFT JOIN b ON k.source = b.source AND k.kept = b.kept),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT bad) AS text FROM m GROUP BY 1)
SELECT d.doc_id, d.source, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, sha256(coalesce(g.text, '')) AS kept_sha256 FROM documents d LEFT JOIN g USING (doc_id)""",
    "op10_sharding": f"""{_TABLE} SELECT d.doc_id, d.source, t.slot::INT AS slot, s.name AS shard FROM documents d JOIN t ON t.slot = {_HASH.format("d.doc_id::VARCHAR")} % {_M} JOIN s ON s.i = t.owner""",
}
