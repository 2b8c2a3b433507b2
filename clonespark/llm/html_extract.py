"""HTML extraction by union-free regular expressions, one wrapper for each host.

Inference, from all pages of a host: a page is a tree of elements and texts;
phrase marks without a class belong to the text that they stand in.  Neighbouring
equal groups, of any length, fold into one repeated group, ``(...)+``.  Pages of
equal shape merge first, on the tasks that read them; the shapes of a host are
then aligned with each other, and each mismatch is resolved: different texts
become a text slot, what only one side has becomes an optional group ``(...)?``,
until the wrapper generates all pages.  The result has tags, constant texts,
slots, repeats and optionals, but no alternatives.

Extraction: every page is aligned with its host's wrapper.  Its slots belong to
the page's own content, as does what departs from the wrapper; texts that equal
a constant of the wrapper belong to the template, and blocks of nothing else are
left out.  A constant must stand on SUPPORT pages of different content, or on all
of a host that has fewer, two at least; copies of a page support nothing.  The
main region is the page's article or main element, if it has text of its own, or
else the element whose slots hold most text of the host outside menus, notices,
forms and the like; elements of that kind within the region are left out, unless
they hold the article itself.  On the tables' pages the lists of elements that
lie outside decide already; the wrapper decides where a template has text of its
own inside the region, or where no element tells the region.
"""

from __future__ import annotations

import html
import json
import sys
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonespark.llm.common import cut, mapped, text_of

NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
STOP = re.compile("[>\"']")
RAW = frozenset("script style noscript template svg iframe textarea".split())
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never part of the article.
OUTSIDE = frozenset("nav footer aside form script style noscript template svg iframe button select textarea head title menu dialog input option".split())
#: Elements that end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Words of class, id and role that name boilerplate.
NOTICE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|menu|nav|navbar|navigation|newsletter|notice|pagination|popup|promo|promoted|related|replies|reply|share|sharing|sidebar|social|sponsored|subscribe|widget)(?:$|[\s_-])", re.I
)
#: Marks within a text, transparent if they have no class, id or role.
PHRASE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: What an opening tag closes first, and what that may not lie beyond.
CLOSES = {n: ({"li"}, {"ul", "ol", "menu"}) for n in ("li",)} | {n: ({"dt", "dd"}, {"dl"}) for n in ("dt", "dd")} | {n: ({"td", "th"}, {"tr", "table"}) for n in ("td", "th")} | {"tr": ({"tr"}, {"table"})}
#: Elements nested deeper than this are read as part of the one around them (browsers nest 512 at most).
DEPTH = 2000
#: Pages of different content that make an equal text a constant of the template.
SUPPORT = 3
#: Wrappers that one task merges at once.
BLOCKS = 64


class Ends:
    """Where tags end: the first ``>`` outside quotes.  What has no end is
    remembered, so that a page is looked over once however many tags lack one."""

    def __init__(self, page: str):
        self.page, self.dead, self.none_from = page, set(), len(page)

    def close(self, at: int) -> int:
        """The place after the next ``>``, or -1."""
        if at >= self.none_from:
            return -1
        found = self.page.find(">", at)
        if found < 0:
            self.none_from = at
        return found + 1 or -1

    def tag(self, at: int) -> int:
        seen = []
        while at < self.none_from:
            m = STOP.search(self.page, at)
            if not m:
                self.none_from = at
                break
            if m.start() in self.dead:
                break
            if m[0] == ">":
                return m.end()
            seen.append(m.start())
            at = self.page.find(m[0], m.end()) + 1
            if not at:
                break
        self.dead.update(seen)
        return -1


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """("<name", "</name" or "#", text or class words, whether it is boilerplate)."""
    out, said, at, ends = [], [], 0, Ends(page)

    def tell(token: tuple[str, str, bool]) -> None:
        if said:
            out.append(("#", "".join(said), False))
            said.clear()
        out.append(token)

    while at < len(page):
        start = at
        if page[at] != "<":
            at = page.find("<", at) % (len(page) + 1)
            said.append(page[start:at])
            continue
        if page.startswith("<!--", at):
            at = page.find("-->", at + 4)
            at = at + 3 if at >= 0 else len(page)
            continue
        m = NAME.match(page, at)
        stop = ends.tag(m.end()) if m else ends.close(at) if page[at + 1 : at + 2] in ("!", "?") else -1
        if stop < 0:
            said.append("<")
            at += 1
            continue
        at = stop
        if not m:
            continue
        name, attributes = m[2].lower(), page[m.end() : stop - 1]
        if m[1]:
            tell((f"</{name}", "", False))
            continue
        marks = " ".join(next(filter(None, x[1:]), "") for x in ATTRIBUTE.findall(attributes)) if "=" in attributes else ""
        tell((f"<{name}", marks, name in OUTSIDE or bool(marks and NOTICE.search(marks))))
        if name in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{name}\b", re.I).search(page, at)
            at = ends.close(end.end()) if end else -1
            at = len(page) if at < 0 else at
            tell((f"</{name}", "", False))
    if said:
        out.append(("#", "".join(said), False))
    return out


# An item of a tree: [key, text, chars, pages, flags, kids, ids]
#   key: "#" a text, "<name marks" an element, "+keys" a repeated group of several
#   text: fingerprint of a constant, None for a slot; chars: of all texts seen here
#   pages: fingerprints of different pages that have the item, the SUPPORT smallest
#   ids: the page's tokens (texts only), empty in a wrapper
KEY, TEXT, CHARS, PAGES, FLAGS, KIDS, IDS = range(7)
REPEATED, OPTIONAL, BAD = 1, 2, 4
SEP = "\x1f"


def deepen() -> None:
    """Items are walked by calls, a few for each level."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * DEPTH))


def _print(data: bytes) -> int:
    return int.from_bytes(blake2b(data, digest_size=7).digest(), "big")


def tree(all_tokens: list[tuple[str, str, bool]]) -> list:
    """The page's root item: its elements nested and folded."""
    deepen()
    root = ["<", None, 0, [], 0, [], []]
    stack = [root]
    names = [""]
    deep: dict[str, int] = {}
    texts: list[tuple[list, bool]] = []
    bad_at = 0  # depth of the outermost boilerplate element

    def close(at: int) -> None:
        nonlocal bad_at
        del stack[at:], names[at:]
        if bad_at >= at:
            bad_at = 0

    for i, (name, text, bad) in enumerate(all_tokens):
        kids = stack[-1][KIDS]
        if name == "#":
            if not text.strip():
                if kids and kids[-1][KEY] == "#":
                    kids[-1][IDS].append(i)
            elif kids and kids[-1][KEY] == "#":
                kids[-1][IDS].append(i)
            else:
                kids.append(leaf := ["#", None, 0, [], 0, [], [i]])
                texts.append((leaf, bool(bad_at)))
        elif name.startswith("</"):
            tag = name[2:]
            if deep.get(tag):
                deep[tag] -= 1
                continue
            at = next((k for k in range(len(names) - 1, 0, -1) if names[k] == tag), 0)
            if at:
                close(at)
        else:
            tag = name[1:]
            marks = "" if tag in ("html", "body", "article", "main") else re.sub(r"\d+", "0", " ".join(text.split()))
            if tag in PHRASE and not marks:
                continue
            if tag in BLOCK:
                at = next((k for k in range(len(names) - 1, 0, -1) if names[k] in BLOCK), 0)
                if at and names[at] == "p":
                    close(at)
                ends, bar = CLOSES.get(tag, ((), ()))
                at = next((k for k in range(len(names) - 1, 0, -1) if names[k] in ends or names[k] in bar), 0) if ends else 0
                if at and names[at] in ends:
                    close(at)
            if len(stack) > DEPTH:
                if tag not in VOID:
                    deep[tag] = deep.get(tag, 0) + 1
                continue
            stack[-1][KIDS].append(item := [f"{name} {marks}", None, 0, [], BAD if bad else 0, [], []])
            if tag not in VOID:
                stack.append(item)
                names.append(tag)
                if bad and not bad_at:
                    bad_at = len(stack) - 1
    said = []
    for leaf, bad in texts:
        words = " ".join("".join(all_tokens[i][1] if all_tokens[i][0] == "#" else " " for i in leaf[IDS]).split())
        leaf[TEXT], leaf[CHARS] = _print(words.encode("utf-8", "replace")), len(words)
        if not bad:
            said.append(leaf[TEXT])
    page = [_print(repr(said).encode())]

    def settle(item: list) -> None:
        item[PAGES] = page
        for x in item[KIDS]:
            settle(x)
        if len(item[KIDS]) > 1:
            item[KIDS] = fold(item[KIDS])

    settle(root)
    return root


def square(codes: np.ndarray, size: int) -> bool:
    """Whether a stretch of ``size`` is followed by its equal.  Such a stretch
    holds a multiple of ``size``, so only those are looked at more closely."""
    ahead, here = codes[size:], codes[: len(codes) - size]
    for k in (np.flatnonzero(here[::size] == ahead[::size]) * size).tolist():
        run = 0
        for x, y in ((here[k:][:size], ahead[k:][:size]), (here[max(0, k - size) : k][::-1], ahead[max(0, k - size) : k][::-1])):
            at, step = 0, 16
            while at < len(x):
                differ = np.flatnonzero(x[at : at + step] != y[at : at + step])
                if len(differ):
                    at += int(differ[0])
                    break
                at, step = min(len(x), at + step), 2 * step
            run += at
        if run >= size:
            return True
    return False


def fold(items: list[list]) -> list[list]:
    """Neighbouring equal groups, shortest first, become repeats; texts that differ become slots."""
    size, codes = 1, None
    while 2 * size <= len(items):
        if codes is None:
            keys = [x[KEY] for x in items]
            number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
            if len(number) == len(keys):
                break
            codes = np.array([number[k] for k in keys])
        if size > 32 and not square(codes, size):
            size += 1
            continue
        same = np.concatenate([[0], np.cumsum(codes[:-size] == codes[size:])])
        at_all = same[size:] - same[:-size] == size  # the group here equals the next
        if not at_all.any():
            size += 1
            continue
        out, at, last = [], 0, len(at_all)
        while at < len(items):
            if at < last and at_all[at] and any(k != "#" for k in keys[at : at + size]):
                group, at = items[at : at + size], at + size
                while at - size < last and at_all[at - size]:
                    group = [join(x, y) for x, y in zip(group, items[at : at + size], strict=True)]
                    at += size
                if size > 1:
                    group = [["+" + SEP.join(keys[at - size : at]), None, 0, group[0][PAGES], 0, group, []]]
                group[0][FLAGS] |= REPEATED
                out += group
            else:
                out.append(items[at])
                at += 1
        items, codes = out, None
        size += 1
    return items


def _rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of ``a`` and every head of ``b``."""
    row = np.zeros(len(b) + 1, np.int32)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return row


def common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of keys, as index pairs, in linear space."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(k, len(number)) for k in side], np.int64) for side in (a, b))
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, p, j, q = todo.pop()
        while i < p and j < q and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < p and j < q and a[p - 1] == b[q - 1]:
            p, q = p - 1, q - 1
            out.append((p, q))
        if i == p or j == q:
            continue
        if p - i == 1 or q - j == 1:
            one = {a[k]: k for k in range(p - 1, i - 1, -1)}
            hit = next(((one[b[k]], k) for k in range(j, q) if b[k] in one), None)
            if hit:
                out.append(hit)
            continue
        middle = (i + p) // 2
        cut_at = j + int((_rows(x[i:middle], y[j:q]) + _rows(x[middle:p][::-1], y[j:q][::-1])[::-1]).argmax())
        todo += [(middle, p, cut_at, q), (i, middle, j, cut_at)]
    return sorted(out)


def grouped(items: list[list], others: list[list]) -> list[list]:
    """``items``, with single occurrences of the groups that ``others`` repeats as such groups."""
    for g in others:
        if g[KEY][0] == "+":
            keys = g[KEY][1:].split(SEP)
            out, at = [], 0
            while at < len(items):
                part = items[at : at + len(keys)]
                if [x[KEY] for x in part] == keys:
                    out.append([g[KEY], None, 0, part[0][PAGES], part[0][FLAGS] & OPTIONAL, part, []])
                    at += len(keys)
                else:
                    out.append(items[at])
                    at += 1
            items = out
    return items


def pairs(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    if len(a) == len(b) and all(x[KEY] == y[KEY] for x, y in zip(a, b, strict=True)):
        return [(i, i) for i in range(len(a))]
    return common([x[KEY] for x in a], [y[KEY] for y in b])


def join(x: list, y: list) -> list:
    """Two items of one key as one; ``x`` is changed."""
    if x[TEXT] != y[TEXT]:
        x[TEXT] = None
    x[CHARS] += y[CHARS]
    if x[PAGES] != y[PAGES]:
        x[PAGES] = sorted({*x[PAGES], *y[PAGES]})[:SUPPORT]
    x[FLAGS] |= y[FLAGS]
    x[IDS] += y[IDS]
    if x[KIDS] or y[KIDS]:
        x[KIDS] = merge(x[KIDS], y[KIDS])
    return x


def merge(a: list[list], b: list[list]) -> list[list]:
    """The wrapper that generates what ``a`` and ``b`` do."""
    a, b = grouped(a, b), grouped(b, a)
    out, i, j = [], 0, 0
    for p, q in [*pairs(a, b), (len(a), len(b))]:
        for x in (*a[i:p], *b[j:q]):
            x[FLAGS] |= OPTIONAL
            out.append(x)
        if p < len(a):
            out.append(join(a[p], b[q]))
        i, j = p + 1, q + 1
    return out


def shape(item: list) -> str:
    """What pages of one template share: keys and their nesting."""
    return f"{item[KEY]}({SEP.join(map(shape, item[KIDS]))})" if item[KIDS] else item[KEY]


def bare(item: list) -> list:
    """Without the page's tokens."""
    item[IDS] = []
    for x in item[KIDS]:
        bare(x)
    return item


def known(item: list) -> list:
    """Without items of one page only: what is not in the wrapper is a page's own too."""
    item[KIDS] = [known(x) for x in item[KIDS] if len(x[PAGES]) > 1]
    return item


def infer(pages: list[str]) -> list[list]:
    """The wrapper of these pages as an expression: ["<tag", marks], ["</tag", ""],
    ["#", fingerprint of a constant text or None for a slot], ["+", items], ["?", items]."""
    wrapper: list | None = None
    for page in pages:
        told = bare(tree(tokens(page)))
        wrapper = told if wrapper is None else join(wrapper, told)

    def said(items: list[list]) -> list[list]:
        out: list[list] = []
        for x in items:
            if x[KEY] == "#":
                one = [["#", x[TEXT]]]
            elif x[KEY][0] == "+":
                one = said(x[KIDS])
            else:
                name, _, marks = x[KEY].partition(" ")
                one = [[name, marks], *said(x[KIDS]), *([["</" + name[1:], ""]] if name[1:] not in VOID else [])]
            if x[FLAGS] & REPEATED:
                one = [["+", one]]
            out += [["?", one]] if x[FLAGS] & OPTIONAL else one
        return out

    return said(wrapper[KIDS]) if wrapper else []


def extract(page: str, wrapper: list | None) -> str:
    """The main text of a page under its host's wrapper."""
    all_tokens = tokens(page)
    root = tree(all_tokens)
    least = max(2, min(SUPPORT, len(wrapper[PAGES]))) if wrapper else 2
    own: dict[int, tuple[bool, int]] = {}  # a text item: whether it is the page's own, chars of the slot
    repeats: set[int] = set()

    def meet(item: list, told: list | None) -> None:
        if item[KEY] == "#":
            fixed = told is not None and told[TEXT] is not None and told[TEXT] == item[TEXT] and len(told[PAGES]) >= least
            own[id(item)] = (not fixed, told[CHARS] if told else item[CHARS])
        if (told or item)[FLAGS] & REPEATED:
            repeats.add(id(item))
        if not item[KIDS]:
            return
        if told is None or not told[KIDS]:
            for x in item[KIDS]:
                meet(x, None)
            return
        item[KIDS] = grouped(item[KIDS], told[KIDS])
        of = dict(pairs(item[KIDS], told[KIDS]))
        for i, x in enumerate(item[KIDS]):
            meet(x, told[KIDS][of[i]] if i in of else None)

    meet(root, wrapper)
    weights: dict[int, int] = {}
    places: list[tuple[list, int, bool]] = []  # elements outside boilerplate, depth, whether in a repeat
    trusted = True

    def left_out(item: list, inside: bool) -> bool:
        """Boilerplate by its tag or class, unless it is the article itself."""
        name = item[KEY].split(" ")[0]
        if not item[FLAGS] & BAD or name in ("<article", "<main") and not inside:
            return False
        return trusted or name[1:] in OUTSIDE and name != "<form"

    def weigh(item: list, depth: int, again: bool, inside: bool) -> int:
        """Chars of slots."""
        if item[KEY] == "#":
            mine, chars = own[id(item)]
            return chars if mine else 0
        name = item[KEY].split(" ")[0]
        weights[id(item)] = 0
        if left_out(item, inside) or name == "<header" and not inside:
            return 0
        again = again or id(item) in repeats
        inside = inside or name in ("<article", "<main")
        places.append((item, depth, again))
        weights[id(item)] = sum(weigh(x, depth + 1, again, inside) for x in item[KIDS])
        return weights[id(item)]

    total = weigh(root, 0, False, False)
    if not total and {"<article", "<main"} & {t[0] for t in all_tokens}:
        # classes and forms may hold the article; they are not believed where nothing else has text
        trusted = False
        places.clear()
        total = weigh(root, 0, False, False)
    main: list[list] = []
    for name in ("<article", "<main"):
        main = main or [x for x, _, _ in places if x[KEY].split(" ")[0] == name and weights[id(x)]]
    if not main:
        main = [x for x, _, again in places if not again and " main" in f" {x[KEY].partition(' ')[2]}" and 2 * weights[id(x)] > total][:1]
    if not main:
        fit = [(weights[id(x)] * depth, depth, x) for x, depth, again in places if not again and x[KEY].split(" ")[0][1:] in ("div", "section", "td", "body") and weights[id(x)]]
        main = [max(fit, key=lambda x: x[:2])[2]] if fit else [root]
    opens = {id(x) for x in main}
    state = bytearray(len(all_tokens))  # 0: left out, 1: of the template, 2: the page's own

    def mark(item: list, inside: bool, within: bool) -> None:
        if item[KEY] == "#":
            if inside:
                for i in item[IDS]:
                    state[i] = 2 if own[id(item)][0] else 1
            return
        name = item[KEY].split(" ")[0]
        inside = inside or id(item) in opens
        article = within or name in ("<article", "<main")
        # a page's own header stands outside the region, an article's header within it
        if left_out(item, within) or name == "<header" and not inside:
            return
        for x in item[KIDS]:
            mark(x, inside, article)

    mark(root, False, False)
    blocks: list[str] = []
    line: list[str] = []
    mine = False
    for i, (name, text, _) in enumerate(all_tokens):
        if name == "#":
            if state[i] or not text.strip():
                line.append(text)
                mine |= state[i] == 2
            continue
        tag = name.lstrip("</")
        if tag in BLOCK:
            if mine and (told := " ".join(html.unescape("".join(line)).split())):
                blocks.append(told)
            line.clear()
            mine = False
        elif tag == "br":
            line.append(" ")
    if mine and (told := " ".join(html.unescape("".join(line)).split())):
        blocks.append(told)
    return "\n".join(blocks)


def joined(group: pd.DataFrame) -> str:
    """The wrappers of a group merged into one, in the order of their shapes' hashes."""
    deepen()
    wrapper: list | None = None
    for told in group.sort_values(["h", "told"])["told"]:
        item = json.loads(told)
        wrapper = item if wrapper is None else join(wrapper, item)
    return json.dumps(wrapper, separators=(",", ":"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page, empty if there is none.

    Null html: as empty.  Null or odd urls: the host is what precedes the path,
    or empty.  A null page_id stays null, and repeated rows repeat.  Only the
    three named columns are read.  An empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html")).withColumn("host", host)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One wrapper for each host and shape that the task meets."""
        found: dict[tuple[str, int], list] = {}

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int64()), pa.array([json.dumps(x, separators=(",", ":")) for x in found.values()], pa.string())], names=["host", "h", "told"]
            )
            found.clear()
            return out

        for batch in batches:
            for name, page in zip(batch.column(0), batch.column(1), strict=True):
                item = bare(tree(tokens(page.as_py())))
                key = (name.as_py(), _print(shape(item).encode("utf-8", "replace")))
                found[key] = join(found[key], item) if key in found else item
                if len(found) >= 5000:
                    yield told()
        yield told()

    def of_shape(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "h": [group["h"].min()], "told": [joined(group)]})

    kind = "host string, h long, told string"
    shapes = mapped(rows.select("host", "html"), learn, kind)
    # a template that every task meets: some of its rows first, so that no task sees them all
    shapes = shapes.groupBy("host", "h", F.pmod(F.xxhash64("told"), F.lit(16))).applyInPandas(of_shape, kind)
    parts = cut(shapes.groupBy("host", "h").applyInPandas(of_shape, kind), "shapes")
    while True:
        n = parts.groupBy("host").agg(F.ceil(F.count("*") / BLOCKS).alias("n"))
        if parts.isEmpty() or n.agg(F.max("n")).first()[0] == 1:
            break
        parts = cut(parts.join(n, "host").groupBy("host", F.pmod("h", "n")).applyInPandas(of_shape, kind), "shapes")

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "told": [json.dumps(known(json.loads(joined(group))), separators=(",", ":"))]})

    wrappers = cut(parts.groupBy("host").applyInPandas(finish, "host string, told string"), "wrappers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list | None] = {}
        for batch in batches:
            texts = []
            for page, told in zip(batch.column(2), batch.column(3), strict=True):
                told = told.as_py() or "null"
                if told not in held:
                    if len(held) > 500:
                        held.clear()
                    held[told] = json.loads(told)
                texts.append(extract(page.as_py(), held[told]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    found = mapped(rows.join(wrappers, "host", "left").select("page_id", "url", "html", "told"), run, "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
