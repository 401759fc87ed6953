"""Main-text extraction by wrapper induction.

1. A sample of every host's pages: its html hashes fall into ``parts`` parts, the least and the greatest of each
   part are drawn (at most 2 * parts different pages, whatever the partitioning; one aggregation).
2. One wrapper a host, induced from its sample and stored as a row: the pages' DOM trees, runs of alike siblings
   folded into one repeated node, are aligned with a reference page by simple tree matching.  Texts that
   most of the different pages have at one node are constant: template.  Varying nodes are slots; the
   wrapper also says which node is the content: the one that most pages' article or main elements align
   with, else the node that all slots with text but one small rest stand in.
3. Every page, sampled or not, is aligned with its host's wrapper in the same way.  Its template nodes go,
   inside an article as well (but not headings and labels of what varies), and its content node is read, without menus, headers,
   footers, sidebars, notices, adverts, forms, scripts and comments.  A class name that tells of such a part only decides about
   slots, and not where the wrapper finds most of the host's text in it; inside an article, only if it names nothing else.

Pages that share an article (copies with edited words, one article in several frames) count as one page for step
2, so a popular article does not become template.

Text: character references decoded, white space inside a block made one space, blocks joined by an
empty line.  Whole pages are read; nothing is cut.

Defined cases: a null or empty html, or one without content, gives an empty text; a host with fewer
than three different pages has no wrapper, so only the page's own structure counts; a page of which nothing
would be left keeps its template nodes; repeated rows each give a row; a null url is a host of its own; columns
named like the operator's are replaced, others dropped (``keep`` names what stays).
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_key, checkpointed, map_rows
from .url_filter import host_of

PARTS = 32
MIN_PAGES, CONSTANT_SHARE = 3, 0.6
CONTENT_SHARE, COPY_SHARE = 0.8, 0.7
CONTENT, KEPT = 1, 2
#: Nodes nested deeper become siblings at this depth: their text stays.
MAX_DEPTH = 150
#: Bytes of wrappers that may be broadcast; above this the join with the pages shuffles.
BROADCAST_BYTES = 32 << 20
SALTS = 64
_TOKEN = re.compile(r"""<!--|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|[^<]++|<""", re.S)
#: Elements whose content is no text of the page, up to their end tag; only foreign ones can close themselves.
_RAW, _FOREIGN = frozenset("script style noscript template svg iframe textarea select title".split()), frozenset(["svg"])
_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table article section div main body".split())
_CONTAINER = frozenset("#root html body main article section div center table tbody tr td".split())
_HEADING = frozenset("h1 h2 h3".split())
_LABELS, _TABLE_PARTS = frozenset("h1 h2 h3 h4 h5 h6 dt".split()), frozenset("caption colgroup thead tbody tfoot tr th td".split())
_BOILERPLATE = frozenset("nav aside footer form button menu dialog head".split())
_HINT = re.compile(r"(?:^|[^a-z])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notice|newsletter|subscribe|share|sharing|social|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|repl(?:y|ies)|related|popup|modal|login|signup)(?:$|[^a-z])")

#: Words that say where a part stands or what it is made of, not what it tells.
_PLAIN = frozenset("ad ads advert box block list wrap wrapper container bar links link buttons button icons icon section area widget panel item items inner outer top bottom left right main header title form content body articles posts stories news site page article post user users reader readers your more this the row col column group count counter toggle inline slot unit holder frame small large".split())


def _of_frame(names: str) -> bool:
    """Whether a class name, inside an article, is made of words for a part of the frame only: share-buttons, but not market-share."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        hints = [w for w in words if _HINT.search(w)]
        if hints and all(w in _PLAIN or w in hints for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "names", "children", "template", "kept")

    def __init__(self, tag: str, names: str = ""):
        self.tag, self.names, self.children, self.template, self.kept = tag, names, [], False, False

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return " ".join("".join(out).split())


def parse(html: str | None) -> Node:
    """A tolerant DOM tree; scripts, styles, titles and comments are left out.

    A comment or raw element that is never closed ends where its tag does (with the text right after a raw one's)."""
    root = Node("#root")
    stack = [root]
    html = html or ""
    at, never = 0, set()  # never: what is not closed in the rest of the page
    skip = False
    while at < len(html):
        m = _TOKEN.match(html, at)
        at = m.end()
        if m[0] == "<!--":
            end = -1 if "<!--" in never else html.find("-->", at)
            if end < 0:
                never.add("<!--")
            at = at if end < 0 else end + 3
            continue
        tag = m[2]
        if tag is None:
            if (m[0][0] != "<" or m[0] == "<") and not skip:
                stack[-1].children.append(html_lib.unescape(m[0]) if "&" in m[0] else m[0])
            skip = False
            continue
        tag, skip = tag.lower(), False
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _RAW:
            if m[3].endswith("/") and tag in _FOREIGN:
                continue
            end = None if tag in never else _END[tag].search(html, at)
            if end is None:
                never.add(tag)
                skip = True
            else:
                at = end.end()
            continue
        if tag in _BLOCK:
            for i in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block begins
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in _SELF_CLOSING:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SELF_CLOSING[tag]:
                    del stack[i:]
                    break
                if stack[i].tag in _SCOPE:
                    break
        names = " ".join((a[1] or a[2] or a[3]).lower() for a in _ATTRIBUTE.findall(m[3])) if m[3] else ""
        node = Node(tag, names)
        stack[-1].children.append(node)
        if tag not in _VOID and not m[3].endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


#: Runs of one kind among siblings from which on all of the kind are one folded node: headings and paragraphs in turn, say.
RUNS = 3


class Folded:
    """A node with its alike siblings folded: neighbours, and all of a kind that comes in RUNS runs; nodes holds the DOM nodes it stands for.

    So a kind stands at most twice among a node's children, however many they are."""

    __slots__ = ("key", "children", "nodes")

    def __init__(self, nodes: list[Node]):
        self.key, self.nodes = (nodes[0].tag, nodes[0].names), nodes
        runs: list[tuple[tuple[str, str], list[Node]]] = []
        for n in nodes:
            for c in n.children:
                if isinstance(c, Node):
                    k = (c.tag, c.names)
                    if runs and runs[-1][0] == k:
                        runs[-1][1].append(c)
                    else:
                        runs.append((k, [c]))
        often = Counter(k for k, _ in runs)
        least = 2 if len(nodes) > 1 else RUNS  # children of repeated nodes: one folded child for each kind
        kinds: dict[tuple[str, str], list[Node]] = {}
        merged: list[tuple[tuple[str, str], list[Node]]] = []
        for k, own in runs:
            if often[k] < least:
                merged.append((k, own))
            elif k in kinds:
                kinds[k].extend(own)
            else:
                kinds[k] = own
                merged.append((k, own))
        runs = merged
        self.children = [Folded(own) for _, own in runs]


class Wrapper:
    """A node of a host's wrapper: hashes of its constant texts, its role, and the children that matter."""

    __slots__ = ("key", "children", "constants", "role")

    def __init__(self, key: tuple[str, str], constants: list[str], role: int, children: list[Wrapper]):
        self.key, self.constants, self.role, self.children = key, frozenset(constants), role, children

    def dump(self) -> list:
        return [*self.key, sorted(self.constants), self.role, [c.dump() for c in self.children]]

    @classmethod
    def load(cls, row: list) -> Wrapper:
        return cls((row[0], row[1]), row[2], row[3], [cls.load(c) for c in row[4]])


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _heaviest(pairs: list[tuple[int, int, int]], n: int) -> tuple[int, list[tuple[int, int]]]:
    """The heaviest chain of pairs (i, j, weight) that rises in both places, j below n: its weight, and its pairs.

    A Fenwick tree keeps the heaviest chain that ends before each j: as many steps as there are pairs, times log n."""
    tree: list[int] = [-1] * (n + 1)
    total, before = [0] * len(pairs), [-1] * len(pairs)
    best = -1
    for p in sorted(range(len(pairs)), key=lambda p: (pairs[p][0], -pairs[p][1])):
        _, j, weight = pairs[p]
        top, at = -1, j
        while at:  # chains whose last j is below this one
            if tree[at] >= 0 and (top < 0 or total[tree[at]] > total[top]):
                top = tree[at]
            at &= at - 1
        total[p], before[p] = weight + (total[top] if top >= 0 else 0), top
        at = j + 1
        while at <= n:
            if tree[at] < 0 or total[p] > total[tree[at]]:
                tree[at] = p
            at += at & -at
        if best < 0 or total[p] > total[best]:
            best = p
    size, out = total[best] if best >= 0 else 0, []
    while best >= 0:
        out.append(pairs[best][:2])
        best = before[best]
    return size, out


def tree_matching(a: Folded | Wrapper, b: Folded, memo: dict) -> int:
    """Size of the greatest top-down, order-preserving match of two trees (Yang 1991).

    Only children of one kind can match, and a kind stands at most twice on a side, so the pairs are few and the greatest
    match of the children is their heaviest rising chain."""
    if a.key != b.key:
        return 0
    got = memo.get((id(a), id(b)))
    if got is not None:
        return got[0]
    kinds: dict[tuple[str, str], list[int]] = {}
    for j, c in enumerate(b.children):
        kinds.setdefault(c.key, []).append(j)
    pairs = [(i, j, tree_matching(c, b.children[j], memo)) for i, c in enumerate(a.children) for j in kinds.get(c.key, ())]
    size, chosen = _heaviest(pairs, len(b.children))
    memo[id(a), id(b)] = (size + 1, chosen)
    return size + 1


def matched_pairs(a: Folded | Wrapper, b: Folded) -> list[tuple]:
    """The pairs of one greatest match."""
    memo: dict = {}
    if not tree_matching(a, b, memo):
        return []
    out, work = [], [(a, b)]
    while work:
        x, y = work.pop()
        out.append((x, y))
        work += [(x.children[i], y.children[j]) for i, j in memo[id(x), id(y)][1]]
    return out


def _grams(blocks: list[str]) -> set:
    words = " ".join(blocks).split()
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def _different(roots: list[Node]) -> list[Node]:
    """One page of each article: what a page has beside the common blocks tells it from the others."""
    blocks = [list(_blocks(_content_root(r) or r, True)) for r in roots]
    common = Counter(t for own in blocks for t in set(own))
    rest = [_grams([t for t in own if common[t] < CONSTANT_SHARE * len(roots)]) for own in blocks]
    out: list[int] = []
    for i, own in enumerate(rest):
        if own and all(len(own & rest[j]) <= COPY_SHARE * min(len(own), len(rest[j])) for j in out):
            out.append(i)
    return [roots[i] for i in out]


def _slot_length(node: Node) -> int:
    """Characters under node outside template nodes and boilerplate elements."""
    n, stack = 0, [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            n += len(x.strip())
        elif not x.template and x.tag not in _BOILERPLATE and x.tag != "a":
            stack.extend(x.children)
    return n


def _has_heading(f: Folded) -> bool:
    return f.key[0] in _HEADING or any(_has_heading(c) for c in f.children)


def induce(htmls: list[str]) -> Wrapper | None:
    """The wrapper of a host from sample pages; None where fewer than MIN_PAGES differ."""
    roots = _different([parse(h) for h in dict.fromkeys(htmls)])
    if len(roots) < MIN_PAGES:
        return None
    folded = [Folded([r]) for r in roots]
    reference = folded[0]
    met: dict[int, list[Folded]] = {}
    for f in folded:
        for x, y in matched_pairs(reference, f):
            met.setdefault(id(x), []).append(y)
    constants: dict[int, set[str]] = {}
    for x, own in met.items():
        seen = Counter(t for y in own for t in {n.text() for n in y.nodes} if t)
        constants[x] = {t for t, n in seen.items() if n >= MIN_PAGES and n >= CONSTANT_SHARE * len(own)}
        for y in own:
            for n in y.nodes:
                n.template = n.text() in constants[x]
    mains = {id(m) for r in roots if (m := _content_root(r)) is not None}
    roles: dict[int, int] = {}
    content = None
    work = [reference]
    while work:  # the node that most pages' own content elements align with
        x = work.pop()
        if sum(id(n) in mains for y in met[id(x)] for n in y.nodes) >= CONSTANT_SHARE * len(roots):
            content = x
        work.extend(c for c in x.children if id(c) in met)

    def mass(x: Folded) -> int:
        return sum(_slot_length(n) for y in met.get(id(x), []) for n in y.nodes)

    if content is None:
        content = reference
        while content.children:
            best = max(content.children, key=mass)
            rest = [c for c in content.children if c is not best]
            if best.key[0] not in _CONTAINER or mass(best) < CONTENT_SHARE * mass(content) or any(len(y.nodes) > 1 for y in met[id(best)]) or any(map(_has_heading, rest)):
                break
            content = best
    roles[id(content)] = CONTENT
    whole, work = mass(content), list(content.children)
    while work:
        x = work.pop()
        if _HINT.search(x.key[1]) and 2 * mass(x) > whole:
            roles[id(x)] = KEPT
        work.extend(x.children)

    def built(x: Folded) -> Wrapper | None:
        own = [w for c in x.children if (w := built(c)) is not None]
        if not own and not constants.get(id(x)) and id(x) not in roles:
            return None
        return Wrapper(x.key, [digest(t) for t in constants.get(id(x), ())], roles.get(id(x), 0), own)

    return built(reference)


def _keep_labels(root: Node) -> None:
    """Headings and labels that every page has, but that head what varies, are content: they are no template.

    A heading heads its siblings up to the next one; the constant rows and cells of a table that varies belong to it."""
    stack = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.template:
            continue
        varying = False
        for c in reversed(x.children):
            if isinstance(c, str):
                varying |= bool(c.strip())
            elif c.tag in _TABLE_PARTS:
                c.template = False
            elif c.tag in _LABELS:
                c.template &= not varying
                varying = False
            else:
                varying |= not c.template and not _boilerplate(c, True) and bool(c.text())
        stack.extend(x.children)


def mark(root: Node, wrapper: Wrapper) -> Node | None:
    """Mark the page's template nodes and kept slots; its content node, if it has the wrapper's."""
    start = None
    for w, y in matched_pairs(wrapper, Folded([root])):
        for n in y.nodes:
            n.template = bool(w.constants) and digest(n.text()) in w.constants
            n.kept = w.role == KEPT
        if w.role == CONTENT:
            start = max(y.nodes, key=lambda n: len(n.text()))
    return start


def _boilerplate(node: Node, inside: bool) -> bool:
    if node.tag in _BOILERPLATE or node.tag == "header" and not inside:
        return True
    if not node.names or node.kept or node.tag in ("html", "body", "main") or not _HINT.search(node.names):
        return False
    return not inside or _of_frame(node.names)


def _blocks(root: Node, inside: bool, drop_template: bool = False) -> Iterator[str]:
    """Text blocks in page order."""
    buffer: list[str] = []
    links = 0

    def flush() -> Iterator[str]:
        nonlocal links
        text = " ".join("".join(buffer).split())
        if text and (inside or 2 * links <= len(text)):
            yield text
        buffer.clear()
        links = 0

    stack: list = [(root, True)]
    in_link = 0
    while stack:
        x, opens = stack.pop()
        if isinstance(x, str):
            buffer.append(x)
            if in_link:
                links += len(" ".join(x.split()))
            continue
        block = x.tag in _BLOCK or x.tag == "#root"
        if not opens:
            in_link -= x.tag == "a"
            if block:
                yield from flush()
            continue
        if x is not root and (_boilerplate(x, inside) or drop_template and x.template):
            if block:
                yield from flush()
            continue
        if block:
            yield from flush()
        elif x.tag == "br":
            buffer.append(" ")
        in_link += x.tag == "a"
        stack.append((x, False))
        stack.extend((c, True) for c in reversed(x.children))
    yield from flush()


def _content_root(root: Node) -> Node | None:
    """The article or main element with the most text that stands in no boilerplate."""
    best, size, stack = None, 0, [root]
    while stack:
        x = stack.pop()
        if x.tag == "article" or x.tag == "main" or "main" in x.names.split():
            if (n := len(x.text())) > size:
                best, size = x, n
            if x.tag == "article":
                continue
        stack.extend(c for c in x.children if isinstance(c, Node) and not _boilerplate(c, False))
    if best is not None and best.tag != "article":  # an article inside it is closer
        inner = [c for c in best.children if isinstance(c, Node) and c.tag == "article"]
        if len(inner) == 1 and 2 * len(inner[0].text()) > size:
            return inner[0]
    return best


def content(root: Node, wrapper: Wrapper | None = None) -> str:
    """Main text of a parsed page, by its host's wrapper where there is one."""
    start = mark(root, wrapper) if wrapper else None
    main = _content_root(root)
    if start is None or start.tag not in ("article", "main") and main is not None:
        start = main  # the page has its own content element where the host as a whole has none
    at, inside = (root, False) if start is None else (start, start.tag == "article" or start is main)
    _keep_labels(at)
    got = list(_blocks(at, inside, True)) or list(_blocks(at, inside))
    return "\n\n".join(got)


def wrappers_of(pages: DataFrame, parts: int = PARTS) -> DataFrame:
    """__host, wrapper (JSON) of every host with enough different pages; pages: __host, __hash, __html."""
    full = pages.where(F.length("__html") > 0)
    drawn = full.groupBy("__host", F.pmod("__hash", F.lit(parts)).alias("part")).agg(F.array(F.min("__hash"), F.max("__hash")).alias("h"))
    drawn = checkpointed(drawn.select("__host", F.explode(F.array_distinct("h")).alias("__hash")))
    sample = by_key(full, drawn, "left_semi").dropDuplicates(["__host", "__hash"])

    def learn(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        wrapper = induce(rows.sort_values("__hash")["__html"].tolist())
        return pd.DataFrame({"__host": [key[0]], "wrapper": [json.dumps(wrapper.dump())]} if wrapper else {"__host": [], "wrapper": []}, dtype=object)

    return checkpointed(sample.groupBy("__host").applyInPandas(learn, "__host string, wrapper string"))


def extract_pages(pages: DataFrame, parts: int = PARTS, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Kept columns, text and n_chars of every page."""
    kept = [c for c in keep if c not in ("text", "n_chars")]
    html = F.col("html").cast("string")
    rows = pages.select(*kept, host_of(F.col("url").cast("string")).alias("__host"), html.alias("__html"))
    wrappers = wrappers_of(rows.select("__host", F.xxhash64("__html").alias("__hash"), "__html"), parts)
    size = wrappers.agg(F.sum(F.octet_length("wrapper"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(wrappers), "__host", "left")
    else:  # a host of many pages is many tasks
        salted = wrappers.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("__salt", F.pmod(F.xxhash64("__html"), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")
    joined = joined.select(*kept, "__html", "wrapper")
    schema = T.StructType([*joined.schema.fields[: len(kept)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        loaded: dict[str, Wrapper] = {}
        texts = []
        for h, w in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist(), strict=True):
            if w and w not in loaded:
                loaded[w] = Wrapper.load(json.loads(w))
            texts.append(content(parse(h), loaded[w] if w else None) if h else "")
        return pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.fieldNames())

    return map_rows(joined, run, schema)
