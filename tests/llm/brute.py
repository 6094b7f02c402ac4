"""Plain versions of the operators' contracts, for small fixtures."""

import collections
import hashlib
import re

import xxhash

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
RAW = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def decontaminate(docs, items, window=13):
    cut = {}
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            cut.setdefault(tuple(w[a : a + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(c) for c in cut}:
            for a in range(len(w) - k + 1):
                if (own := cut.get(tuple(w[a : a + k]))) is not None:
                    hit.update(range(a, a + k))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def quality_base(text):
    w = RAW.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    count, covered, seen, again = collections.Counter(grams), set(), set(), 0
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if RAW.search(line):
            again += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered), n < 50 or 100 * len(covered) > 50 * n


def fingerprint(text):
    w = RAW.findall((text or "").translate(LOWER))
    own = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, most=3):
    """values: (id, fingerprint); the smallest id reachable of each."""
    root = {i: i for i, _ in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(values):
        for j, b in values[:n]:
            if (a ^ b).bit_count() <= most:
                u, v = find(i), find(j)
                root[max(u, v)] = min(u, v)
    return {i: find(i) for i, _ in values}


def licence_base(text):
    w = words(text)
    places = []
    for phrase, label in {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}.items():
        p = phrase.split()
        places += [(a, label) for a in range(len(w)) if w[a : a + len(p)] == p]
    starts = [a for a, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def repeats(docs, least=100):
    """docs: (id, bytes) by ascending id; the covered bytes of each."""
    seen, out = set(), []
    for i, b in docs:
        gone = bytearray(len(b))
        for a in range(len(b) - least + 1):
            s = b[a : a + least]
            if s in seen:
                gone[a : a + least] = b"\1" * least
            seen.add(s)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(b), sum(gone), spans, sha(bytes(c for c, g in zip(b, gone) if not g))))
    return out


def luhn(digits):
    total = 0
    for n, c in enumerate(reversed(digits)):
        d = int(c) * (1 + n % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def personal(text):
    text, spans = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        spans.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            spans.append(("phone", *m.span()))
    return spans
