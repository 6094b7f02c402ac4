"""Main text of web pages by wrappers inferred per host.

A host's wrapper is a union-free regular expression over block elements: a tree in which a child may be optional or
repeated and text is a slot. It is inferred by aligning token streams. A page's elements are a wrapper of their own
(equal siblings in a row fold into a repeated one); two wrappers are aligned child by child along a longest common
subsequence of labels, what has no partner becomes optional, and text that differs becomes a variable slot. Aligning is
a merge, so each task folds its pages into one tree for each shape, and these meet by host: no page is sent.

The wrapper then says where the host's main text is: its article and main elements or, where a host has none, the
smallest element that holds all text outside links, slots that never vary and parts named as menus, headers, footers,
sidebars, notices, adverts, forms or comments. Under that place, text that FIXED_PAGES pages or more have and that never
varies while other slots beside it do belongs to the wrapper and not to the page, and is left out. A page that lacks the
place is judged by itself.

Pages of one shape merge by sums, in any order; the shapes of a host are then aligned in the order of their hashes, in
BUCKETS parts that are aligned in order too. So the wrapper doesn't depend on how pages are dealt to tasks.

A null html is an empty page. A null url is a host of its own. Pages repeat freely (copies weigh in the statistics);
tags left open close as browsers close them, a tag whose quotes never close ends at its first `>`, and what is no tag
is text; elements nested more than DEPTH deep stand side by side there. Empty tables give no rows; columns of pages
named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Carried, materialize, slices

#: Bytes of places that a task is sent at once; with more, pages and wrappers are joined by host.
BROADCAST_BYTES = 16 << 20
#: Parts in which a host's shapes are aligned before these are; bounds what one task has of a host with most of the pages.
BUCKETS = 64
#: Tags with quotes that never close after which a page's quotes are plain characters.
BROKEN = 8
#: Children that a wrapper's element has at most; beyond it the rarest are folded into one repeated child for each tag,
#: which keeps their pages and text, so that no host's wrapper grows without bound.
MOST_CHILDREN = 60
DEPTH = 200
#: Pages from which text that never varies belongs to the wrapper (a title, h1, always belongs to the page).
FIXED_PAGES = 5
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/><]*+)([^<>]*+)>")
_HUGE = re.compile(r"&#[0-9]{4000,}+;?")
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements by what they are.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_RAW_END = {tag: re.compile(rf"</{tag}\b", re.I) for tag in RAW}
READERS = re.compile(r"(?:^|[-_ ])(?:comments?|repl(?:y|ies)|disqus)(?:$|[-_ ])", re.I)
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
OUT = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset"}
OUT_NAMES = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|menu|nav|navbar|navigation|breadcrumbs?|comments?|cookies?|consent|notices?|popup|modal|newsletter|subscribe|share|sharing|social|related|recommend\w*|footer|header|widget|disqus|repl(?:y|ies)|complementary|contentinfo|search)(?:$|[-_ ])", re.I)


class Element:
    __slots__ = ("tag", "label", "out", "items")

    def __init__(self, tag: str, label: str, out: bool):
        self.tag, self.label, self.out = tag, label, out
        self.items: list = []  # elements, and (text, in a link) pairs


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, text, attributes) of a page: texts, and opening and closing tags; each character is looked at a few times."""
    at, last, broken = 0, page.rfind(">"), 0
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last:  # no tag can end
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[lt + 1] in "!?":
            at = page.find(">", lt) + 1
            continue
        m = _TAG.match(page, lt) if broken < BROKEN else None
        if m is None:
            m = _PLAIN_TAG.match(page, lt)
            broken += m is not None
        if m is None:
            yield "text", "<", ""
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if tag in RAW and not m[1]:
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = _RAW_END[tag].search(page, at)
            at = page.find(">", end.end()) + 1 if end else len(page)
            at = at or len(page)
            continue
        yield "close" if m[1] else "open", tag, m[3]


def _unescape(text: str) -> str:
    return html.unescape(_HUGE.sub("\ufffd", text) if "&#" in text else text) if "&" in text else text


def parse(page: str | None) -> Element:
    """The block elements of a page with their text; scripts, styles, comments and tags are gone."""
    root = Element("", "", False)
    stack, link, cleared = [root], False, 0
    opened: dict[str, int] = {}

    def put(text: str, linked: bool) -> None:
        if len(stack) > DEPTH and stack[DEPTH - 1].items[-1] is not stack[-1]:  # goes on after a deeper element
            e = stack[-1]
            stack[-1] = Element(e.tag, e.label, e.out)
            stack[DEPTH - 1].items.append(stack[-1])
        stack[-1].items.append((text, linked))

    def close() -> None:
        opened[stack.pop().tag] -= 1

    for kind, tag, attributes in tokens(page or ""):
        if kind == "text":
            put(_unescape(tag), link)
            continue
        if tag == "a":
            link = kind == "open"
        if tag in INLINE or tag in VOID:
            if tag in ("br", "hr", "img"):
                put(" ", False)
            continue
        if kind == "close":
            if opened.get(tag, 0):
                while stack[-1].tag != tag:
                    close()
                close()
                link = False
            cleared = min(cleared, len(stack))
            continue
        while len(stack) > 1 and stack[-1].tag in CLOSED_BY and (CLOSED_BY[stack[-1].tag] is None or tag in CLOSED_BY[stack[-1].tag]):
            close()
        cleared = min(cleared, len(stack))
        names = " ".join(x[0] or x[1] or x[2] for x in _NAMES.findall(attributes))
        inside = opened.get("article", 0) or opened.get("main", 0)
        out = tag in OUT or tag == "header" and not inside or bool(names and tag not in ("html", "body") and (READERS if tag in ("article", "main") else OUT_NAMES).search(names))
        if tag in ("article", "main") and not out:
            for above in stack[cleared:]:  # what holds the main text is none of the parts beside it, whatever its names say
                above.out = above.out and above.tag in OUT
            cleared = len(stack)
        name = re.sub(r"\d+", "", names.split()[0]) if names.split() else ""  # post-12 and post-13 are one part of their host
        e = Element(tag, f"{tag}.{name}" if name else tag, out or len(stack) > DEPTH and stack[-1].out)
        stack[min(len(stack), DEPTH) - 1].items.append(e)
        stack.append(e)
        opened[tag] = opened.get(tag, 0) + 1
    return root


# A wrapper's element: label, tag, out, optional, repeated, pages, text (characters outside links), constant (its text
# if that never varied, else null) and children.
def wrapper(e: Element) -> dict:
    text = " ".join("".join(x[0] for x in e.items if isinstance(x, tuple) and not x[1]).split())
    children: list[dict] = []
    for x in e.items:
        if isinstance(x, Element):
            w = wrapper(x)
            if children and children[-1]["label"] == w["label"]:
                children[-1] = align(children[-1], w, repeated=True)
            else:
                children.append(w)
    children = bounded(children)
    return {"label": e.label, "tag": e.tag, "out": e.out, "optional": False, "repeated": False, "pages": 1, "text": len(text), "constant": hash_text(text), "children": children}


def hash_text(text: str) -> str:
    return text if len(text) <= 80 else hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()


def bounded(children: list[dict]) -> list[dict]:
    """At most MOST_CHILDREN children; what is folded (any of a tag: `div.*`, of all tags: `*`) stands at the end."""
    plain, wild = [c for c in children if not folded(c)], {}

    def fold(c: dict, tag: str) -> None:
        label = ("!" if c["out"] else "") + ("*" if tag == "*" else f"{tag}.*")
        w = {**c, "label": label, "tag": tag, "optional": True, "repeated": True}
        wild[label] = {**align(wild[label], w), "optional": True, "repeated": True} if label in wild else w

    for c in children:
        if folded(c):
            fold(c, c["tag"])
    if len(plain) + len(wild) > MOST_CHILDREN:
        often = {i for _, i in sorted((-c["pages"], i) for i, c in enumerate(plain))[: MOST_CHILDREN // 2]}
        for i, c in enumerate(plain):
            if i not in often:
                fold(c, c["tag"])
        plain = [c for i, c in enumerate(plain) if i in often]
        if len(plain) + len(wild) > MOST_CHILDREN:
            each, wild = list(wild.values()), {}
            for c in each:
                fold(c, c["tag"] if c["tag"] in ("article", "main") else "*")
    return plain + [wild[k] for k in sorted(wild)]


def folded(c: dict) -> bool:
    return c["label"].endswith("*")


def align(a: dict, b: dict, repeated: bool = False) -> dict:
    """The wrapper of what either of two elements of one label wraps; repeated: they stand in a row on one page."""
    pairs = _common(a["children"], b["children"])
    children: list[dict] = []
    i = j = 0
    for x, y in [*pairs, (len(a["children"]), len(b["children"]))]:
        for c in (*a["children"][i:x], *b["children"][j:y]):
            children.append({**c, "optional": True})
        if x < len(a["children"]):
            children.append(align(a["children"][x], b["children"][y]))
        i, j = x + 1, y + 1
    children = bounded(children)
    same = a["constant"] is not None and a["constant"] == b["constant"]
    return {
        "label": a["label"], "tag": a["tag"], "out": a["out"], "optional": a["optional"] or b["optional"], "repeated": repeated or a["repeated"] or b["repeated"],
        "pages": max(a["pages"], b["pages"]) if repeated else a["pages"] + b["pages"], "text": a["text"] + b["text"], "constant": a["constant"] if same else None, "children": children,
    }


def _common(a: list[dict], b: list[dict]) -> list[tuple[int, int]]:
    """A longest common subsequence of the labels, as pairs of places."""
    if [c["label"] for c in a] == [c["label"] for c in b]:
        return [(i, i) for i in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i]["label"] == b[j]["label"] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i]["label"] == b[j]["label"]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


#: The places of a host with article or main elements: all of these, wherever a page has them.
ARTICLES = [["article|main"]]


def _mass(w: dict) -> int:
    """Characters that can be main text: outside links, named parts and (on several pages) slots that never vary."""
    if w["out"]:
        return 0
    own = 0 if w["constant"] is not None and w["pages"] >= FIXED_PAGES and not w["repeated"] else w["text"]
    return own + sum(map(_mass, w["children"]))


def main_places(w: dict) -> list[list]:
    """Paths to where the host's main text is: ARTICLES if it has any, else one path of labels.

    A step into folded children is a list: their tag, then the labels beside them.
    """
    if any(x["tag"] in ("article", "main") for x in _all(w)):
        return ARTICLES
    path: list = []
    total = _mass(w)
    while total and w["children"]:
        best = max(w["children"], key=_mass)
        if _mass(best) < total:  # something beside it can be main text
            break
        path = [*path, [best["tag"], *(c["label"] for c in w["children"] if not folded(c))] if folded(best) else best["label"]]
        w = best
    return [path]


def _all(w: dict) -> Iterator[dict]:
    if not w["out"]:
        yield w
        for c in w["children"]:
            yield from _all(c)


def fixed_texts(w: dict) -> list[str]:
    """What never varies under the host's main places, as marks of (path, text), where other slots there do vary."""
    found: list[str] = []

    def walk(x: dict, path: tuple[str, ...], repeated: bool) -> bool:
        """Whether some slot here varies."""
        if x["out"]:
            return False
        path, repeated = (*path, x["label"]), repeated or x["repeated"]
        varies = x["text"] > 0 and x["constant"] is None
        own = len(found)
        for c in x["children"]:
            varies |= walk(c, path, repeated)
        if x["constant"] and x["text"] and x["pages"] >= FIXED_PAGES and x["tag"] != "h1" and not repeated and not any(map(folded, (x, *x["children"]))) and not any(p.endswith("*") for p in path):
            found.insert(own, _mark(path, x["constant"]))
        return varies

    return found if walk(w, (), False) else []


def _mark(path: tuple[str, ...], constant: str) -> str:
    return hashlib.blake2b("\0".join((*path, constant)).encode("utf-8", "replace"), digest_size=12).hexdigest()


def blocks(e: Element, places: list[list], fixed: frozenset[str] = frozenset()) -> list[str]:
    """The page's blocks of main text; an article or main element counts wherever the page has it."""
    found: list[str] = []

    def collect(x: Element, path: tuple[str, ...]) -> None:
        if fixed:
            own = " ".join("".join(i[0] for i in x.items if isinstance(i, tuple) and not i[1]).split())
            if own and _mark(path, hash_text(own)) in fixed:  # the wrapper's words, not the page's
                for item in x.items:
                    if isinstance(item, Element) and not item.out:
                        collect(item, (*path, item.label))
                return
        run: list[str] = []

        def end() -> None:
            text = " ".join("".join(run).split())
            if text:
                found.append(text)
            run.clear()

        for item in x.items:
            if isinstance(item, Element):
                end()
                if not item.out:
                    collect(item, (*path, item.label))
            else:
                run.append(item[0])
        end()

    def walk(x: Element, left: list[list[str]], path: tuple[str, ...]) -> None:
        if any(not p for p in left) or everywhere and x.tag in ("article", "main"):
            collect(x, path)
            return
        for item in x.items:
            if isinstance(item, Element) and not item.out:
                onward = left if everywhere else [p[1:] for p in left if fits(p[0], item)]
                if onward:
                    walk(item, onward, (*path, item.label))

    def fits(step: str | list[str], x: Element) -> bool:
        return step == x.label if isinstance(step, str) else step[0] in ("*", x.tag) and x.label not in step[1:]

    everywhere = places == ARTICLES
    walk(e, places, (e.label,))
    return found


def host(url: Column) -> Column:
    """The host of a URL in lower case; a null URL and one without a host have the empty one."""
    named = F.regexp_extract(url.cast("string"), r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\s]*)", 1)
    return F.coalesce(F.lower(F.substring_index(named, "@", -1)), F.lit(""))


_FOLDED = "host string, bucket int, shape string, wrapper string"


def _rows(values: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*values)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["host", "bucket", "shape", "wrapper"])


def _shape(w: dict) -> str:
    """A hash of a wrapper without its text and numbers."""
    bare = lambda x: [x["label"], x["out"], x["optional"], x["repeated"], [bare(c) for c in x["children"]]]
    return hashlib.blake2b(json.dumps(bare(w)).encode(), digest_size=12).hexdigest()


def _meet(by: int):
    """For rows sorted by their first `by` columns and shape: one wrapper for each value of these columns."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, whole, shape, part = None, None, None, None
        for b in batches:
            done = []
            for h, n, s, text in zip(*(b.column(c).to_pylist() for c in ("host", "bucket", "shape", "wrapper"))):
                key = (h, n)[:by]
                if key == now and s == shape:
                    part = align(part, json.loads(text))
                    continue
                if now is not None:
                    whole = part if whole is None else align(whole, part)
                    if key != now:
                        done.append((now[0], now[1] if by == 2 else 0, f"{now[1]:04d}" if by == 2 else "", json.dumps(whole)))
                        whole = None
                now, shape, part = key, s, json.loads(text)
            if done:
                yield _rows(done)
        if now is not None:
            whole = part if whole is None else align(whole, part)
            yield _rows([(now[0], now[1] if by == 2 else 0, f"{now[1]:04d}" if by == 2 else "", json.dumps(whole))])

    return meet


def infer_wrappers(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, wrapper as JSON)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[str, str], dict] = {}
        for b in slices(batches, 1):
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = wrapper(parse(page))
                key = h, _shape(w)
                by[key] = align(by[key], w) if key in by else w
            if len(by) > 5_000:  # a task holds so many shapes at most; the rest of a shape's pages follows in another row
                yield sent(by)
                by = {}
        yield sent(by)

    def sent(by: dict[tuple[str, str], dict]) -> pa.RecordBatch:
        return _rows([(h, int(s[:8], 16) % BUCKETS, s, json.dumps(w)) for (h, s), w in by.items()])

    part = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).cast("string").alias("html")).mapInArrow(fold, _FOLDED)
    part = part.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "shape", "wrapper").mapInArrow(_meet(2), _FOLDED)
    return part.repartition("host").sortWithinPartitions("host", "shape").mapInArrow(_meet(1), _FOLDED).select("host", "wrapper")


def extract_main(pages: DataFrame, *, url_col: str = "url", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """pages with the main text of html_col: blocks in page order, joined by line feeds."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [json.loads(x) for x in b.column("wrapper").to_pylist()]
            said = [json.dumps([main_places(x), fixed_texts(x)]) for x in w]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(said, pa.string())], names=["host", "places"])

    known = materialize(infer_wrappers(pages, url_col, html_col).mapInArrow(place, "host string, places string"), "wrappers")
    own = Carried(pages, [text_col])
    rows = pages.select(F.col(html_col).cast("string").alias("html"), host(F.col(url_col)).alias("host"), *own.into)
    few = known.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("places")), F.lit(0))).first()[0] <= BROADCAST_BYTES
    shared = pages.sparkSession.sparkContext.broadcast({r.host: r.places for r in known.collect()}) if few else None
    rows = rows.withColumn("places", F.lit(None).cast("string")) if few else rows.join(known, "host")
    names = own.names
    rows = rows.select("html", "host", "places", *names)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[list[list], frozenset[str]]] = {}
        for b in slices(batches, 0):
            texts = []
            for page, h, p in zip(*(b.column(i).to_pylist() for i in range(3))):
                p = shared.value[h] if shared else p
                if p not in memo:
                    if len(memo) > 1_000:
                        memo.clear()
                    places, fixed = json.loads(p)
                    memo[p] = places, frozenset(fixed)
                places, fixed = memo[p]
                e = parse(page)
                # a page that has none of its host's places, or only the wrapper's words there, is its own wrapper
                texts.append("\n".join(blocks(e, places, fixed) or blocks(e, places) or blocks(e, main_places(wrapper(e)))))
            yield pa.RecordBatch.from_arrays([*b.columns[3:], pa.array(texts, pa.string())], names=[*names, "text"])

    return rows.mapInArrow(extract, own.schema.add("text", "string")).select(*own.back, F.col("text").alias(text_col))
