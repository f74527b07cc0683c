"""Operator 4: main text of HTML pages by wrappers inferred from pages of the same host.

A page is a stream of tags and texts, nested by its tags. The wrapper of a host is a union-free
regular expression over such streams: tags and constant texts, text slots, optional parts and repeated
groups. It starts as the host's first page and is aligned with one page after another: texts that
differ become slots, a part that one side lacks becomes optional, a part met again becomes a repeated
group whose members are optional. Two wrappers align in the same way, so every task infers wrappers
from its own pages and only wrappers are shuffled and merged.
"""

from __future__ import annotations

import html
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ldaplens.llm import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

# elements that are no part of an article: by tag, and by a word of their class, id or role
ASIDE_TAGS = frozenset("nav footer aside form script style noscript template head button select input textarea iframe svg canvas object menu dialog title".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header masthead menu modal nav navbar navigation newsletter notice notification popup promo promotion related reply replies responses share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
MAIN_WORDS = frozenset("article main content post entry story".split())


# words of readers' discussions, which may well hold more text than the article
DISCUSSION = frozenset("comment comments reply replies responses".split())
# elements that their words don't make asides: a body "right-sidebar" is no sidebar
WHOLE = frozenset(("", "html", "body", "main", "article"))


def words_of(label: str) -> set[str]:
    return set(re.split(r"[^a-z]+", label.partition("@")[2]))


def discussion(label: str) -> bool:
    """Whether the words tell of a discussion, and no name ("post", not "post-comments") of an article."""
    if DISCUSSION.isdisjoint(words_of(label)):
        return False
    names = [words_of("@" + name) for name in label.partition("@")[2].split()]
    return not any(ASIDE_WORDS.isdisjoint(n) and not MAIN_WORDS.isdisjoint(n) for n in names)


def aside(label: str) -> bool:
    tag = label.partition("@")[0]
    if tag in WHOLE:
        return tag == "article" and discussion(label)
    return tag in ASIDE_TAGS or not ASIDE_WORDS.isdisjoint(words_of(label))


def never(label: str) -> bool:
    """Asides that are so whatever they hold; a form may wrap the page, a class may tell of its layout."""
    tag = label.partition("@")[0]
    return tag in ASIDE_TAGS and tag != "form"


def parse(page: str) -> list:
    """The page as nested ``[label, children]``; a text is ``["#", string]``. A label is the tag
    and the words of its class, id and role; numbers in them count as equal. Every page parses:
    missing end tags are implied, end tags without a start are passed over."""
    root: list = ["", []]
    stack = [root]
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            kids = stack[-1][1]
            if kids and kids[-1][0] == "#":
                kids[-1][1] += s
            else:
                kids.append(["#", s])

    def tag(node) -> str:
        return node[0].partition("@")[0]

    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if tag(stack[k]) == name:
                    del stack[k:]
                    break
            continue
        if name in ENDS_P:
            for k in range(len(stack) - 1, 0, -1):
                if tag(stack[k]) == "p":
                    del stack[k:]
                    break
                if tag(stack[k]) not in INLINE:
                    break
        if name in SAME:
            for k in range(len(stack) - 1, 0, -1):
                if tag(stack[k]) in SAME[name]:
                    del stack[k:]
                    break
                if tag(stack[k]) in HOLDS[name]:
                    break
        said = " ".join(sorted({w for a in ATTR.finditer(m[3]) for w in (a[2] or a[3] or a[4] or "").lower().split()}))
        node = [name + ("@" + re.sub(r"\d+", "0", said) if said else ""), []]
        stack[-1][1].append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
    text(page[at:])
    return root


# A wrapper node: [label, mark, children, characters]. Mark: "" once, "?" optional, "+" repeated, "*"
# both. A text node is ["#", mark, constant or None for a slot, characters seen]. A repeated group of
# several labels is ["()", "+", members].


def stepped(call):
    """The value of a generator that yields the generators whose values it needs: nested calls on a
    stack of their own, since pages nest as deep as they like."""
    stack, value = [call], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def wrapper(node: list) -> list:
    """A page (or part of one) as a wrapper: repeated siblings fold into groups."""
    top: list = []
    todo: list = [(node, top, None)]  # a node, where its wrapper goes, those of its children
    while todo:
        n, out, kids = todo.pop()
        if n[0] == "#":
            words = " ".join(n[1].split())
            out.append(["#", "", words, len(words)])
        elif kids is None:
            kids = []
            todo.append((n, out, kids))
            todo += [(k, kids, None) for k in reversed(n[1]) if k[0] != "#" or k[1].strip()]
        else:
            out.append([n[0], "", fold([(k, -1) for k in kids]), sum(k[3] for k in kids)])
    return top[0]


def marks(a: str, b: str) -> str:
    """The mark of a part that has mark ``a`` on one side and ``b`` on the other."""
    plus, maybe = a in ("+", "*") or b in ("+", "*"), a in ("?", "*") or b in ("?", "*")
    return "*" if plus and maybe else "+" if plus else "?" if maybe else ""


def joined(a: list, b: list) -> list:
    """Two nodes with the same label as one."""
    return stepped(_joined(a, b))


def fold(items: list) -> list:
    """``(node, group)`` in order, group -1 for none, as children: what lies between two nodes with
    the same label, and what shares a group, becomes one repeated group."""
    return stepped(_fold(items))


def align(a: list, b: list) -> list:
    """Two lists of children as one: labels in the longest common order match, the others become
    optional, and a label that so comes twice makes a repeated group."""
    return stepped(_align(a, b))


def _text(a: list, b: list) -> list:
    return ["#", marks(a[1], b[1]), a[2] if a[2] == b[2] else None, a[3] + b[3]]


def _joined(a: list, b: list):
    if a[0] == "#":
        return _text(a, b)
    return [a[0], marks(a[1], b[1]), (yield _align(a[2], b[2])), a[3] + b[3]]


def _fold(items: list):
    spans: dict = {}
    for i, (node, group) in enumerate(items):
        for key in {("label", node[0]), ("group", group) if group >= 0 else ("label", node[0])}:
            spans[key] = (spans.get(key, (i, i))[0], i)
    out: list = []
    i = 0
    reach = sorted(spans.values())
    while i < len(items):
        end = i
        for a, b in reach:  # spans that overlap the part so far extend it
            if i <= a <= end:
                end = max(end, b)
        part = items[i : end + 1]
        members: dict = {}
        for node, _ in part:
            if node[0] not in members:
                members[node[0]] = node
            elif node[0] == "#":
                members["#"] = _text(members["#"], node)
            else:
                members[node[0]] = yield _joined(members[node[0]], node)
        if len(part) == 1 and part[0][1] < 0:
            out.append(part[0][0])
        elif len(members) == 1:
            node = next(iter(members.values()))
            out.append([node[0], "*" if "?" in (x[0][1] for x in part) or node[1] == "*" else "+", *node[2:]])
        else:
            kids = [[m[0], "?" if m[1] in ("", "?") else "*", *m[2:]] for m in members.values()]
            out.append(["()", "+", kids, sum(k[3] for k in kids)])
        i = end + 1
    return out


def _align(a: list, b: list):
    def spread(kids, base):
        out = []
        for i, k in enumerate(kids):
            out += [(m, base + i) for m in k[2]] if k[0] == "()" else [(k, -1)]
        return out

    x, y = spread(a, 0), spread(b, len(a))
    if [n[0] for n, _ in x] == [n[0] for n, _ in y]:  # the usual case
        pairs = [(i, i) for i in range(len(x))]
    else:
        # labels are distinct on each side, so the longest common order is the longest rising run
        place = {n[0]: j for j, (n, _) in enumerate(y)}
        best: list = []  # (last j, chain)
        for i, (n, _) in enumerate(x):
            j = place.get(n[0])
            if j is None:
                continue
            before = max((c for c in best if c[0] < j), key=lambda c: c[1], default=None)
            best.append((j, (before[1] if before else 0) + 1, i, before))
        top, pairs = max(best, key=lambda c: c[1], default=None), []
        while top:
            pairs.append((top[2], top[0]))
            top = top[3]
        pairs.reverse()
    out: list = []
    i = j = 0
    alone = lambda node: [node[0], marks(node[1], "?"), *node[2:]]
    for p, q in [*pairs, (len(x), len(y))]:
        out += [(alone(n), g) for n, g in x[i:p]] + [(alone(n), g) for n, g in y[j:q]]
        if p < len(x):
            g = x[p][1] if x[p][1] >= 0 else y[q][1]
            out.append((_text(x[p][0], y[q][0]) if x[p][0][0] == "#" else (yield _joined(x[p][0], y[q][0])), g))
        i, j = p + 1, q + 1
    return (yield _fold(out))


def measures(node: list) -> tuple[dict, dict, dict]:
    """By the ``id`` of each node: the slot text directly in it or in its inline children; all its slot
    text but that of links, asides by tag and discussions; whether it holds an article or a main."""
    own: dict[int, float] = {}
    slots: dict[int, float] = {}
    holds: dict[int, bool] = {}
    todo = [(node, False)]
    while todo:
        n, done = todo.pop()
        if n[0] == "#":
            own[id(n)] = slots[id(n)] = n[3] if n[2] is None else 0
            holds[id(n)] = False
        elif not done:
            todo.append((n, True))
            todo += [(k, False) for k in n[2]]
        else:
            a = b = 0
            c = False
            for k in n[2]:
                tag = k[0].partition("@")[0]
                if tag in ("#", "()") or tag in INLINE and tag != "a":
                    a += own[id(k)]
                if tag != "a" and not never(k[0]) and not (tag != "main" and discussion(k[0])):
                    b += slots[id(k)]
                    c = c or holds[id(k)] or tag in ("article", "main")
            own[id(n)], slots[id(n)], holds[id(n)] = a, b, c
    return own, slots, holds


def labels(link: tuple | None) -> list[str]:
    out = []
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def spared_in(node: list, slots: dict, whatever: bool = False) -> list[list[str]]:
    """Labels from ``node`` to each element in it that is named like an aside, but holds over half of
    its slot text; or to each but those that are asides whatever they hold."""
    out: list = []
    todo: list = [(k, None) for k in reversed(node[2])]
    while todo:
        n, path = todo.pop()
        if n[0] == "#":
            continue
        here = path if n[0] == "()" else (n[0], path)
        if aside(n[0]):
            if never(n[0]) or not (whatever or 2 * slots[id(n)] > slots[id(node)] and not discussion(n[0])):
                continue
            out.append(labels(here))
        todo += [(k, here) for k in reversed(n[2])]
    return out


def chosen(node: list) -> tuple[list[str], list[list[str]]]:
    """Labels from the root to the article's element in a wrapper, and the labels from there to each
    element in it that is named like an aside (or a form) but is none.

    First choice: an ``article``, else a ``main``, else an element named like one; of several the one
    with the most text. Without any: the element whose own slots and paragraphs hold the most text,
    other than links and asides. Constant text, the same on all pages, does not count there.

    An element named like an aside is none if it holds over half of the slot text; or if it holds an
    article with more text than is to be had outside; or, discussions too, if there is no other text."""
    own, slots, holds = measures(node)

    def most(n) -> bool:
        return 2 * slots[id(n)] > slots[id(node)] and not discussion(n[0])

    def walk(spared) -> tuple[int, list, tuple] | None:
        """Rank, node and labels (each with those before) of the best element."""
        found: dict[int, tuple[float, list, tuple]] = {}
        todo: list = [(node, None)]
        while todo:
            n, path = todo.pop()
            if n[0] == "#" or path and aside(n[0]) and (never(n[0]) or not spared(n)):
                continue
            name = n[0].partition("@")[0]
            here = path if n[0] == "()" else (n[0], path)
            if n[0] != "()":
                rank = 3 if name == "article" else 2 if name == "main" else 1 if not MAIN_WORDS.isdisjoint(words_of(n[0])) else 0
                if name in ("html", "body", ""):
                    rank = 0
                inner = [k for c in n[2] for k in (c[2] if c[0] == "()" else [c])]
                score = float(n[3]) if rank else sum(own[id(k)] for k in inner if k[0] == "#" or k[0].partition("@")[0] in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol", "br") or k[0].partition("@")[0] in INLINE)
                if rank not in found or score > found[rank][0]:
                    found[rank] = (score, n, here)
            todo += [(k, here) for k in reversed(n[2])]
        return next(((r, *found[r][1:]) for r in (3, 2, 1, 0) if r in found and found[r][0] > 0), None)

    best = walk(most)
    if (best is None or best[0] < 2) and holds[id(node)]:
        other = walk(lambda n: most(n) or holds[id(n)])
        if other and other[0] >= 2 and (best is None or slots[id(other[1])] > slots[id(best[1])]):
            best = other
    last = best is None
    if last:
        best = walk(lambda n: True)
    if best is None:
        return [""], []

    return labels(best[2]), spared_in(best[1], slots, last)


def main_path(node: list) -> list[str]:
    """Labels from the root to the article's element in a wrapper."""
    return chosen(node)[0]


def elements(node: list, path: list[str]) -> list:
    """All elements of a page under the labels of ``path``, in page order."""
    level = [node]
    for label in path[1:]:
        level = [k for n in level for k in n[1] if k[0] == label]
    return level


def blocks(node: list, spared: list | tuple = ()) -> list[str]:
    """The texts of the element's blocks; asides within it are left out, but for those at the labels
    of ``spared``."""
    out: list[str] = []
    now: list[str] = []

    def end():
        words = " ".join(html.unescape("".join(now)).split())
        if words:
            out.append(words)
        now.clear()

    todo: list = [(k, False, spared) for k in reversed(node[1])]
    while todo:
        n, closing, spare = todo.pop()
        if closing:
            end()
        elif n[0] == "#":
            now.append(n[1])
        elif n[0].partition("@")[0] in ("br", "wbr", "img"):
            now.append(" " if n[0].startswith("br") else "")
        else:
            below = [s[1:] for s in spare if s and s[0] == n[0]] if spare else ()
            if aside(n[0]) and [] not in below:
                continue
            block = n[0].partition("@")[0] not in INLINE
            if block:
                end()
                todo.append((n, True, ()))
            todo += [(k, False, below) for k in reversed(n[1])]
    end()
    return out


def main_text(page: str, path: list[str] | None, spared: list | tuple = ()) -> str:
    """The main text of a page by its host's path; a page without it chooses its own."""
    if not page:
        return ""
    tree = parse(page)
    found = elements(tree, path) if path else []
    if not found:
        path, spared = chosen(slotted(wrapper(tree)))
        found = elements(tree, path)
    out = [b for n in found for b in blocks(n, spared)]
    if not out:  # nothing but what this page alone names like asides
        out = [b for n in found for b in blocks(n, within(n))]
    return "\n\n".join(out)


def slotted(node: list) -> list:
    """A wrapper of one page with every text as a slot (one page can't tell constants)."""
    return built([["#", n[1], None, n[3]] if n[0] == "#" else n for n in flat(node)])


def flat(node: list) -> list:
    """The nodes of a wrapper from the first to the last, each with the number of its children."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if n[0] == "#":
            out.append(n)
        else:
            out.append([n[0], n[1], len(n[2]), n[3]])
            todo += reversed(n[2])
    return out


def built(nodes: list) -> list:
    """The wrapper of ``flat``'s nodes."""
    stack: list = []
    for n in reversed(nodes):
        stack.append(n if n[0] == "#" else [n[0], n[1], [stack.pop() for _ in range(n[2])], n[3]])
    return stack[0]


def within(node: list) -> list[list[str]]:
    """``spared_in`` of an element of one page."""
    w = slotted(wrapper(node))
    return spared_in(w, measures(w)[1])


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


#: Hosts whose wrapper a task holds at a time; the wrappers of others are sent on unfinished.
HOSTS_HELD = 2000
#: Wrappers of a host that one task merges in a round.
FAN_IN = 16


def wrappers(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, pages, wrapper`` (JSON of ``flat``): every page of ``pages`` is aligned into its host's wrapper.

    Each task aligns its own pages, so a host that holds a third of all pages is worked on by all
    tasks; their wrappers merge in rounds of ``FAN_IN``, and no task ever gets more of a host.
    """
    spark = pages.sparkSession
    common.python_ready(spark)
    slim = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    schema = "host string, pages long, wrapper string, number long"

    def infer(batches):
        from pyspark import TaskContext

        from ldaplens.llm.html_text import flat, joined, parse, wrapper

        part, held = TaskContext.get().partitionId(), {}

        def sent():
            rows = [(h, n, json.dumps(flat(w)), part) for h, (n, w) in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["host", "pages", "wrapper", "number"])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = wrapper(parse(page))
                n, w = held.get(host, (0, None))
                held[host] = (n + 1, one if w is None else joined(w, one))
                if len(held) >= HOSTS_HELD:
                    yield sent()
        if held:
            yield sent()

    def merge(pdf):
        from functools import reduce

        from ldaplens.llm.html_text import built, flat, joined

        pdf = pdf.sort_values("number")
        w = reduce(joined, (built(json.loads(w)) for w in pdf["wrapper"]))
        return pdf.iloc[:1].assign(pages=int(pdf["pages"].sum()), wrapper=json.dumps(flat(w)))

    found = common.written(slim.mapInArrow(infer, schema), "wrappers")
    number = F.row_number().over(_by_host()) - 1
    found = common.written(found.withColumn("number", number.cast("long")), "wrappers")
    while (found.agg(F.max("number")).first()[0] or 0) > 0:
        groups = found.withColumn("number", F.expr(f"number div {FAN_IN}"))
        found = common.written(groups.groupBy("host", "number").applyInPandas(merge, schema), "wrappers")
    return found.drop("number")


def _by_host():
    from pyspark.sql import Window

    return Window.partitionBy("host").orderBy("number", F.xxhash64("wrapper"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    The path to the article is chosen on the wrapper of the page's host and applied to the page; the
    table of paths is written, so the planner broadcasts it only if its size allows. Null or empty
    html: empty text. A null URL, or one without a host, belongs to the host "". Null ids and repeated
    rows are kept as they are; an empty table gives no rows; other columns are ignored.
    """
    found = wrappers(pages, id_col, url_col, html_col)

    def choose(batches):
        from ldaplens.llm.html_text import built, chosen, slotted

        for b in batches:
            out = []
            for n, w in zip(b.column("pages").to_pylist(), b.column("wrapper").to_pylist()):
                w = built(json.loads(w))
                out.append(json.dumps(chosen(slotted(w) if n < 2 else w)))
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(out, pa.string())], names=["host", "path"])

    paths = common.written(found.mapInArrow(choose, "host string, path string"), "paths")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host_of(F.col(url_col)).alias("host"))

    def apply(batches):
        from ldaplens.llm.html_text import main_text

        for b in batches:
            out = [main_text(h, *(json.loads(p) if p else (None,))) for h, p in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return slim.join(paths, "host", "left").select("page_id", "url", "html", "path").mapInArrow(apply, "page_id long, url string, text string, n_chars long")
