"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a span classifier decides.

Regular expressions propose spans of five kinds: strict ones, and between these wider ones such as written-out e-mail
addresses, phone numbers without a country code, 15-digit cards, and secrets given by name. Four labelers vote on each:
its shape (the strict rule holds), a gazetteer (top-level domains, calling and area codes, card issuers, address blocks,
names of secrets), the context (cue words before it) and a check of its parts. A span also has features that no labeler
uses: a usual length, free neighbours and even groups. Spans are counted by votes and features over the whole corpus (at
most 2048 patterns a corpus, whatever its size); from these counts expectation-maximisation estimates each labeler's hit
and false-alarm rate, and a logistic model of votes and features is fitted to the resulting probabilities. Spans that
pass the strict rule always stay; others are added where the model is for them.

All on the rows is DataFrame functions. Offsets are code points, end exclusive. A null text is empty. Matches of a kind
are leftmost and don't overlap; added spans never overlap a strict match of their kind. Repeated rows are judged alike
(and vote each); empty tables give no rows; columns of docs named as the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, held

#: The kinds that strict rules find, and those that only the method adds.
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "secret"]
#: Each pattern finds what its plain form finds, with possessive loops and a fixed place to start, so that no text makes it slow.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?i)(?<![a-z0-9_-])[a-z0-9_-]{0,40}?(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key) ?[=:] ?([\"'])[^\s\"']{8,}+\1",
}
#: What a text must have before a pattern is tried on it.
TRIGGERS = {("email", False): "@", ("ip", False): ".", ("card", False): None, ("phone", False): "+", ("email", True): "at", ("phone", True): None, ("secret", True): None}
#: Gazetteers and cue words.
DOMAINS = ["com", "org", "net", "edu", "gov", "mil", "info", "biz", "io", "co", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "be", "us", "ca", "au", "jp", "cn", "in", "br", "mx", "pl", "se"]
CALLING = ["1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "81", "82", "86", "90", "91"]
CUES = {"email": r"mail|contact|write|address", "ip": r"\bip\b|host|server|address|login", "card": r"card|visa|master|amex|credit|karte|tarjeta|carte", "phone": r"phone|\btel|call|mobile|fax|\bt[ée]l", "secret": r"login|auth|config|env|access|account|export|header"}
#: Code points that spans of a kind usually have.
LENGTHS = {"email": (8, 40), "ip": (7, 15), "card": (16, 19), "phone": (10, 20), "secret": (20, 90)}
_FOUND = "array<struct<lo:int,hi:int,s:string,before:string,after:string>>"
#: Matches of which running sums are built at once.
BLOCK = 64


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of 19 digits at most passes: every second digit from the right doubled, the sum a multiple of ten."""
    d = F.right(digits, F.lit(19))
    at = F.sequence(F.lit(1), F.char_length(d))
    value = F.transform(at, lambda i: F.substring(d, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x - F.when(x > 9, 9).otherwise(0)) % 10 == 0


def _let(name: str, value: str, use: str) -> str:
    """SQL for `use`, in which `name` is a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def _running(a: str, levels: int = 2) -> str:
    """SQL for the sum up to each place of a (an array of ints, not empty); by blocks, so that no long list is copied for each place."""
    some = lambda places: f"aggregate({places}, cast(array() AS array<int>), (o, i) -> concat(o, array(get({a}, i) + coalesce(try_element_at(o, -1), 0))))"
    if not levels:
        return some(f"sequence(0, size({a}) - 1)")
    blocks, last, sums = f"blocks{levels}", f"last{levels}", f"sums{levels}"
    added = f"flatten(transform({blocks}, (x, i) -> transform(x, y -> y + if(i > 0, get({sums}, i - 1), 0))))"
    whole = _let(last, f"transform({blocks}, x -> element_at(x, -1))", _let(sums, _running(last, levels - 1), added))
    every = some(f"sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size({a})) - 1)")
    return _let(blocks, f"transform(sequence(0, cast(floor((size({a}) - 1) / {BLOCK}) AS int)), b -> {every})", whole)


def _placed(matches: str, parts: str, at: str) -> str:
    """SQL for the matches with their offsets from `at` on, from what stands between them."""
    gaps = f"transform({matches}, (s, i) -> char_length(get({parts}, i)) + if(i > 0, char_length(get({matches}, i - 1)), 0))"
    lo = f"{at} + get(sums, i)"
    one = f"named_struct('lo', {lo}, 'hi', {lo} + char_length(s), 's', s, 'before', right(get({parts}, i), 40), 'after', left(get({parts}, i + 1), 1))"
    return f"if(size({matches}) > 0, {_let('gaps', gaps, _let('sums', _running('gaps'), f'transform({matches}, (s, i) -> {one})'))}, cast(array() AS {_FOUND}))"


def _votes(kind: str, wide: bool, x: Column) -> tuple[Column, list[Column]]:
    """Whether the strict rule holds, and the votes: shape, gazetteer, context, check; then the features."""
    s, d = x["s"], _digits(x["s"])
    context = F.lower(x["before"]).rlike(CUES[kind])
    if kind == "email":
        base = F.lit(not wide)
        gazetteer = F.regexp_extract(F.lower(s), r"([a-z]+)$", 1).isin(DOMAINS)
        check = ~s.rlike(r"^[.]|\.\.|\.@|@-|-\.")
    elif kind == "ip":
        parts = F.split(s, r"\.")
        base = F.forall(parts, lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
        gazetteer = ~s.rlike(r"^(0|2[3-5][0-9]|22[4-9])\.")
        check = ~s.rlike(r"(^|\.)0[0-9]")
    elif kind == "card":
        base = F.char_length(d).between(16, 19) & _luhn(d)
        gazetteer = d.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)")
        check = F.char_length(d).between(13, 19) & _luhn(d)
    elif kind == "phone":
        base = F.lit(False) if wide else F.char_length(d).between(8, 15)
        # without a country code: area and exchange of the numbering plan that writes them so
        gazetteer = d.rlike("^[2-9][0-9]{2}[2-9]") if wide else F.substring(d, 1, 1).isin(CALLING) | F.substring(d, 1, 2).isin(CALLING)
        check = F.char_length(d).between(10, 13)
    else:
        value = F.regexp_extract(s, "[\"'](.*)[\"']$", 1)
        base = F.lit(False)
        gazetteer = F.lower(s).rlike("(?:^|[_-])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key) ?[=:]")
        check = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)
    short, long = LENGTHS[kind]
    even = {"card": r"^[0-9]+$|^[0-9]{4}([ -])[0-9]{4}(\1[0-9]{4})+$", "phone": r"^\+?[0-9]+(?:[ .-]?\([0-9]+\))?(?:[ .-]?[0-9]+)+$|^\([0-9]+\)", "ip": r"^[1-9]", "email": r"^[A-Za-z0-9]", "secret": "[A-Fa-f0-9]{16}"}[kind]
    free = ~(F.right(x["before"], F.lit(1)).rlike("[A-Za-z0-9]") | x["after"].rlike("[A-Za-z0-9]"))
    return base, [base, gazetteer, context, check, F.char_length(s).between(short, long), free, s.rlike(even)]


def _candidates(docs: DataFrame, text_col: str, own: list[Column]) -> DataFrame:
    """docs with `spans`: candidates (kind, lo, hi, base, pattern), strict ones first; pattern codes kind, votes, features."""
    rows = docs.select(*own, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = held(rows, number=F.col("text").rlike("[0-9]"), named=(F.col("text").contains('"') | F.col("text").contains("'")) & (F.col("text").contains("=") | F.col("text").contains(":")))
    none, text = F.array().cast("array<string>"), F.col("text")
    # numbers are looked for only where there is a digit, addresses only where there is an at sign, and so on
    when = lambda k, w: (F.col("named") if k == "secret" else F.col("number") | F.lit(k == "email")) & (text.contains(TRIGGERS[k, w]) if TRIGGERS[k, w] else F.lit(True))
    rows = held(rows, **{f"m{k}": F.when(when(k, False), F.regexp_extract_all("text", F.lit(STRICT[k]), F.lit(0))).otherwise(none) for k in BASE})
    rows = held(rows, **{f"p{k}": F.when(F.size(f"m{k}") > 0, F.split("text", STRICT[k])).otherwise(F.array("text")) for k in BASE})
    rows = held(rows, **{f"f{k}": F.expr(_placed(f"m{k}", f"p{k}", "0")) for k in BASE})

    def between(k: str) -> Column:
        """What the wide pattern finds in the parts that the strict one leaves."""
        pattern = "'" + WIDE[k].replace("\\", "\\\\").replace("'", "\\'") + "'"
        parts, start = (f"p{k}", f"if(n > 0, get(f{k}, n - 1).hi, 0)") if k in BASE else ("array(text)", "0")
        one = _let("m", f"regexp_extract_all(part, {pattern}, 0)", f"if(size(m) > 0, {_let('q', f'split(part, {pattern})', _placed('m', 'q', start))}, cast(array() AS {_FOUND}))")
        return F.when(when(k, True), F.expr(f"flatten(transform({parts}, (part, n) -> {one}))")).otherwise(F.expr(f"cast(array() AS {_FOUND})"))

    rows = held(rows, **{f"w{k}": between(k) for k in WIDE})

    def judged(kind: str, wide: bool) -> Column:
        def one(x: Column) -> Column:
            base, signs = _votes(kind, wide, x)
            code = F.lit(256 * KINDS.index(kind) + 128 * wide)
            for bit, v in enumerate(signs):
                code = code + F.when(v, 1 << bit).otherwise(0)
            return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi"), base.alias("base"), code.alias("pattern"))

        return F.transform(f"{'w' if wide else 'f'}{kind}", one)

    return held(rows, spans=F.concat(*[judged(k, False) for k in BASE], *[judged(k, True) for k in WIDE]))


def estimate(counts: dict[int, int], rounds: int = 50) -> dict[int, float]:
    """For each pattern of votes and features, the probability that its spans are personal data; counts: spans by pattern.

    Expectation-maximisation over the votes of each kind (labelers independent given the truth, rates smoothed), then a
    logistic model of kind, width, votes and features fitted to what it says.
    """
    truth: dict[int, float] = {}
    for kind in range(len(KINDS)):
        own: dict[int, int] = {}
        for p, n in counts.items():
            if p // 256 == kind:
                own[p & 15] = own.get(p & 15, 0) + n
        bits = {p: [p >> b & 1 for b in range(4)] for p in own}
        q = {p: 0.1 + 0.2 * sum(bits[p]) for p in own}
        for _ in range(rounds if own else 0):
            yes = sum(n * q[p] for p, n in own.items())
            no = sum(n * (1 - q[p]) for p, n in own.items())
            # a prior of two hits in three, and of one false alarm in three, ties class 1 to personal data
            hit = [(2 + sum(n * q[p] * bits[p][b] for p, n in own.items())) / (3 + yes) for b in range(4)]
            alarm = [(1 + sum(n * (1 - q[p]) * bits[p][b] for p, n in own.items())) / (3 + no) for b in range(4)]
            prior = (1 + yes) / (2 + yes + no)
            for p in own:
                odds = math.log(prior / (1 - prior)) + sum(math.log(hit[b] / alarm[b]) if bits[p][b] else math.log((1 - hit[b]) / (1 - alarm[b])) for b in range(4))
                q[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        truth |= {p: q[p & 15] for p in counts if p // 256 == kind}
    # each kind has its own weights; of width, votes and features
    features = {p: [1.0, *(float(p >> b & 1) for b in range(8))] for p in counts}
    weights = {k: [0.0] * 9 for k in range(len(KINDS))}
    total = {k: max(1, sum(n for p, n in counts.items() if p // 256 == k)) for k in weights}
    score = lambda p: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w * f for w, f in zip(weights[p // 256], features[p]))))))
    for _ in range(400 if counts else 0):
        slope = {k: [0.0] * 9 for k in weights}
        for p, n in counts.items():
            error = n * (truth[p] - score(p)) / total[p // 256]
            for i, f in enumerate(features[p]):
                slope[p // 256][i] += error * f
        weights = {k: [w + 2.0 * (s - 1e-4 * w) for w, s in zip(weights[k], slope[k])] for k in weights}
    return {p: score(p) for p in counts}


def find_personal(docs: DataFrame, *, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """docs with `base` and `spans`: arrays of (kind, lo, hi) by kind as listed, then start; base are the strict ones."""
    own = Carried(docs, ["base", "spans"])
    counts = {r.pattern: r.n for r in _candidates(docs, text_col, []).select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    taken = [p for p, s in estimate(counts).items() if s >= least]
    rows = _candidates(docs, text_col, own.into)
    strict = F.filter("spans", lambda x: x["base"])
    every = F.filter("spans", lambda x: x["base"] | x["pattern"].isin(taken)) if taken else strict
    named = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(x["kind"].alias("n"), x["lo"].alias("lo"), x["hi"].alias("hi")))), lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["n"] + 1).alias("kind"), x["lo"].alias("lo"), x["hi"].alias("hi")))
    return rows.select(*own.back, named(strict).alias("base"), named(every).alias("spans"))
