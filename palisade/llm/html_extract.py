"""HTML extraction: templates are deduced from equivalence classes of tokens, and the slots left between them extracted.

Pages of one host are handled in groups of about GROUP pages. A page becomes a sequence of tokens: its block tags, told apart by
name, class, id and role (digits apart) and by the tokens that enclose them, and the whole blocks of its text. A token that comes
equally often on each page that has it plays as many roles, told apart by their order, as a second column does beside a first.
Tokens that then occur on the same pages have the same occurrence vector and form an equivalence class. A class is valid if its
tokens are on most pages and in the same order everywhere; valid classes nest: the tokens of each lie in one slot of those kept
before it. The kept tokens are the template. It divides a page into fields: a field is all slots directly under one
element of the template, and what repeats inside a slot (paragraphs, items) belongs to it.

Which field is the main text is judged over the pages of the group: its weight is the number of words, on average, that are in
no link and in no block of text that another page has as well. The heaviest field of a page gives its container,
the element around it. The container is widened to the element around that one while nothing there is chrome, or while it has no
heading and there is one outside it; article, main and body end this. All text in the container counts, whatever its size, but for

- elements that HTML itself calls navigation, footer, aside, header (of the page), form or control, by tag or ARIA role;
- where no article or main encloses it: elements of the template below the container that are mostly links, or whose text comes
  again on other pages far more often than that of the field; and, directly under body, text that is itself a template token
  (a block in a valid class with tags, in the same slot on each page), unless that would leave a page without text.

article and main decide between fields only where the template has them: fields inside them go first. Pages that are equal or
have the same url count as one page in all this, so copies and revisions make no template and no repetition.

Skew: the pages and bytes of a host give its number of groups, and a hash of url and page_id the group of a page, so groups
of a large host are about equal, do not depend on the partitions of Spark, and are spread over many tasks. Hosts of more than
one group are broadcast: at most one row for GROUP_LEAST pages, and joined by shuffle where that is over BROADCAST_ROWS rows.
Pages of a group that are equal, url and all, are held and read once.

Defined cases: null or empty html, or html without text, gives an empty text; a page alone in its group is its own template;
unclosed and stray tags, quotes that never end, and pages cut off anywhere, are read as far as they go. A null url is a host
of its own. Rows are returned one for one, with repeated or null ids as they are; other columns are not looked at.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import load

GROUP, GROUP_BYTES = 64, 8 << 20
#: A host is not cut into groups of fewer pages than this on average, however large its pages are.
GROUP_LEAST, BROADCAST_ROWS = 32, 1_000_000
#: Pages of a group on which a template token occurs at least, as a share and as a number; fewest pages for text to count as template.
SUPPORT, LEAST_PAGES = 0.5, 4
#: Share of an element's words in links, and of its pages on which its text is that of another page, that make it chrome; the
#: latter also has to be so many times that of the main field.
LINKS, REPEATED, TIMES = 0.5, 0.25, 2

# What HTML says about its elements (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template iframe title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
CHROME = frozenset("nav footer aside form button menu dialog head label fieldset select textarea datalist".split())
#: Those of them that may stand in running text.
CONTROLS = frozenset("button label select textarea datalist".split())
CHROME_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
CLOSES_P = BLOCK - frozenset("body html head".split())
#: Blocks of running text, which are no sections of a page.
FLOW = frozenset("p li dt dd tr td th h1 h2 h3 h4 h5 h6 hr option optgroup caption figcaption legend summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|(?<=[\s\"'/]))(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
#: The page as a whole, an element around each page.
ROOT = "page"


class Page:
    """A page as it is read.

    tokens: keys of its block tags in page order. nodes: for each element its parent, its token, its name, whether HTML calls it
    chrome. blocks: (text, token before it, node around it, words, words in links, key as a token).
    """

    def __init__(self, source: str | None) -> None:
        self.tokens: list[str] = [ROOT]
        self.nodes: list[tuple[int, int, str, bool]] = [(-1, 0, ROOT, False)]
        self.blocks: list[tuple[str, int, int, int, int, str]] = []
        self._read(source or "")

    def _read(self, s: str) -> None:
        stack: list[tuple[str, int, str]] = [(ROOT, 0, ROOT)]  # name, node, key
        opened: Counter = Counter()
        text: list[tuple[str, bool]] = []
        at, n = 0, len(s)

        def hidden() -> bool:
            return any(opened[x] for x in CONTROLS)

        def add(t: str) -> None:
            if t and not hidden():
                text.append((t, opened["a"] > 0))

        def close() -> None:
            if text:
                joined = _SPACE.sub(" ", html.unescape("".join(t for t, _ in text))).strip()
                linked = sum(len(t.split()) for t, a in text if a)
                text.clear()
                if joined:
                    node = stack[next((k for k, x in enumerate(stack) if x[0] in CONTROLS), len(stack)) - 1][1] if hidden() else stack[-1][1]
                    words = joined.count(" ") + 1
                    self.blocks.append((joined, len(self.tokens) - 1, node, words, min(linked, words), f"={self.tokens[self.nodes[node][1]]} {joined}"))

        def leave(k: int) -> None:
            for name, _, _ in stack[k:]:
                opened[name] -= 1
            del stack[k:]

        while at < n:
            m = _TOKEN.search(s, at)
            if m is None:
                add(s[at:])
                break
            add(s[at : m.start()])
            at = m.end()
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            if m[2] is None:
                continue
            name, attributes = m[2].lower(), m[3] or ""
            if name in RAW and not m[1]:
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(s, at)
                at = end.end() if end else n
                if name == "title":
                    close()
                continue
            if name in BLOCK:
                close()
            elif name == "br":
                add(" ")
            if m[1]:
                key = name
                if opened[name]:
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == name:
                            key = stack[k][2]
                            leave(k)
                            break
                        if stack[k][0] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                            break
                if name in BLOCK:
                    self.tokens.append(f"/{key}")
                continue
            if name in CLOSES_P:
                k = len(stack)
                while k > 1 and stack[k - 1][0] not in BLOCK and stack[k - 1][0] not in CONTROLS:
                    k -= 1
                if stack[k - 1][0] == "p":
                    k -= 1
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack[k - 1][0] == name:
                    k -= 1
                leave(k)
            found = {a[1].lower(): next(filter(None, a.groups()[1:]), "") for a in _ATTRIBUTE.finditer(attributes)}
            _, parent, around = stack[-1]
            node, key = parent, around
            if name in BLOCK:
                key = f"{name} {_DIGITS.sub('#', ' '.join(v for _, v in sorted(found.items())))} {xxhash.xxh3_64_hexdigest(around)}"
                self.tokens.append(key)
            if name not in VOID and not attributes.rstrip().endswith("/"):
                chrome = name in CHROME or bool(CHROME_ROLES & set(found.get("role", "").lower().split()))
                if name in BLOCK and name not in FLOW or chrome:
                    self.nodes.append((parent, len(self.tokens) - 1 if name in BLOCK else self.nodes[parent][1], name, chrome))
                    node = len(self.nodes) - 1
                elif name in HEADINGS:
                    self.nodes.append((parent, len(self.tokens) - 1, name, False))
                    node = len(self.nodes) - 1
                if name in FLOW:
                    key = around
                stack.append((name, node, key))
                opened[name] += 1
        close()


def roles(pages: list[Page]) -> dict[str, int]:
    """How often each token comes that comes equally often on the pages that have it, if those are enough."""
    counts = [Counter(p.tokens) for p in pages]
    support = Counter(k for c in counts for k in c)
    least = max(1, SUPPORT * len(pages))
    out: dict[str, int] = {}
    for c in counts:
        for k, n in c.items():
            if support[k] >= least and out.get(k, n) != -1:
                out[k] = n if out.get(k, n) == n else -1
    return {k: n for k, n in out.items() if n > 0}


def played(page: Page, known: dict[str, int]) -> list[tuple[str, int] | None]:
    """The role of each token of a page: the token and its number among equal ones; None for what has no role."""
    counts, seen = Counter(page.tokens), Counter()
    out = []
    for k in page.tokens:
        seen[k] += 1
        out.append((k, seen[k]) if known.get(k) == counts[k] else None)
    return out


def template(pages: list[Page]) -> tuple[dict[str, int], set[tuple[str, int]], set[str]]:
    """Roles, tokens of the template (as roles), and text tokens of the template.

    A role's occurrence vector says on which pages it is; roles of one vector are a class, valid if they keep their order on all
    its pages. The class with the most support comes first; each next one is kept if it nests, that is, if its
    roles lie in one slot of what was kept, on each page. A text token belongs to the kept class of its vector if it follows
    the same tag of that class on all its pages.
    """
    known = roles(pages)
    at = [{r: i for i, r in enumerate(played(p, known)) if r} for p in pages]
    vectors: dict[tuple[str, int], tuple[int, ...]] = {}
    for i, roles_ in enumerate(at):
        for r in roles_:
            vectors[r] = (*vectors.get(r, ()), i)
    classes: dict[tuple[int, ...], list[tuple[str, int]]] = {}
    for r, v in vectors.items():
        classes.setdefault(v, []).append(r)
    kept: set[tuple[str, int]] = set()
    places: list[list[int]] = [[] for _ in pages]
    valid: dict[tuple[int, ...], set[tuple[str, int]]] = {}
    for v, own in sorted(classes.items(), key=lambda x: (-len(x[0]), x[0])):
        if len({tuple(sorted(own, key=at[i].__getitem__)) for i in v}) > 1:
            continue
        if kept and len(own) > 1 and any(len({bisect(places[i], at[i][r]) for r in own}) > 1 for i in v):
            continue
        kept.update(own)
        valid[v] = set(own)
        for i in v:
            places[i] = sorted([*places[i], *(at[i][r] for r in own)])
    by_class: dict[tuple[int, ...], set[str]] = {}
    said: dict[str, list[int]] = {}
    twice = set()
    for i, p in enumerate(pages):
        for key, n in Counter(b[5] for b in p.blocks).items():
            said.setdefault(key, []).append(i)
            if n > 1:
                twice.add(key)
    for key, v in said.items():
        if key not in twice and len(v) >= max(LEAST_PAGES, SUPPORT * len(pages)) and tuple(v) in valid:
            by_class.setdefault(tuple(v), set()).add(key)
    texts: set[str] = set()
    for v, keys in by_class.items():
        after: dict[str, set] = {k: set() for k in keys}
        for i in v:
            tags = sorted((at[i][r], r) for r in valid[v])
            for _, token, _, _, _, key in pages[i].blocks:
                if key in after:
                    after[key].add(tags[bisect(tags, token, key=lambda x: x[0]) - 1][1])
        texts |= {k for k, tags in after.items() if len(tags) == 1}
    return known, kept, texts


class Layout:
    """A page under a template: for each node its element of the template, that element's role, and whether HTML calls it chrome."""

    def __init__(self, page: Page, known: dict[str, int], kept: set) -> None:
        self.page = page
        mine = [r if r in kept else None for r in played(page, known)]
        self.element, self.role, self.chrome, self.marked = [], [], [], []
        headed = set()
        for parent, _, name, _ in page.nodes:
            if name in HEADINGS:
                headed.add(parent)
        for k, (parent, token, name, chrome) in enumerate(page.nodes):
            whole = k == 0 or mine[token] is not None and name not in HEADINGS
            self.role.append(mine[token] if k else (ROOT, 1))
            self.element.append(k if whole else self.element[parent])
            self.marked.append(k > 0 and (name in MAIN or self.marked[parent]))
            # The header of a page is chrome; that of an article, or one with the only heading around, is not.
            header = name == "header" and not self.marked[k] and k not in headed
            self.chrome.append(k > 0 and (chrome or header or self.chrome[parent]))


def _distinct(sources: list[str | None], urls: list[str | None]) -> list[int]:
    """The first of the pages that are equal or have one url."""
    out, seen = [], set()
    for i, (s, u) in enumerate(zip(sources, urls, strict=True)):
        if ("html", s) not in seen and ("url", u) not in seen:
            out.append(i)
        seen.add(("html", s))
        if u is not None:
            seen.add(("url", u))
    return out


class Judged:
    """What the pages of a group say about the elements of their template."""

    def __init__(self, layouts: list[Layout]) -> None:
        shared = Counter(t for x in layouts for t in {b[0] for b in x.page.blocks})
        weight, on, words, links = Counter(), Counter(), Counter(), Counter()
        texts: dict[tuple, Counter] = {}
        for x in layouts:
            nodes = x.page.nodes
            total = [[0, 0, 0] for _ in nodes]
            for text, _, node, n, linked, _ in x.page.blocks:
                total[node][0] += n
                total[node][1] += linked
                total[node][2] ^= xxhash.xxh3_64_intdigest(text)
                if shared[text] == 1 and not x.chrome[node]:
                    weight[x.role[x.element[node]]] += n - linked
            for k in range(len(nodes) - 1, -1, -1):
                if x.element[k] == k:
                    role = x.role[k]
                    on[role] += 1
                    words[role] += total[k][0]
                    links[role] += total[k][1]
                    if total[k][0]:
                        texts.setdefault(role, Counter())[total[k][2]] += 1
                if k:
                    up = total[nodes[k][0]]
                    up[0] += total[k][0]
                    up[1] += total[k][1]
                    up[2] ^= total[k][2]
        self.weight = {r: n / on[r] for r, n in weight.items()}
        self.linked = {r for r, n in words.items() if n and links[r] > LINKS * n}
        self.repeated = {r: sum(n for n in c.values() if n > 1) / sum(c.values()) for r, c in texts.items() if sum(c.values()) >= LEAST_PAGES}

    def is_chrome(self, role, field) -> bool:
        again = self.repeated.get(role, 0.0)
        return role in self.linked or again >= REPEATED and again >= TIMES * self.repeated.get(field, 0.0)


def chosen(x: Layout, judged: Judged, said: set[str]) -> list[str]:
    """The blocks of the main text of one page."""
    page, nodes = x.page, x.page.nodes
    open_ = [b for b in page.blocks if not x.chrome[b[2]]]
    if not open_:
        return []
    fields = {x.element[b[2]] for b in open_}
    fields = {k for k in fields if x.marked[k]} or fields
    field = max(fields, key=lambda k: (judged.weight.get(x.role[k], 0.0), -k))
    of = x.role[field]
    below: list[set[int]] = [set() for _ in nodes]  # elements of the template right below one
    heads: set[int] = set()
    for k in range(1, len(nodes)):
        up = x.element[nodes[k][0]]
        if x.element[k] == k:
            below[up].add(k)
        if nodes[k][2] in HEADINGS and not x.chrome[k]:
            while up not in heads:
                heads.add(up)
                if not up:
                    break
                up = x.element[nodes[up][0]]
    drop = [False] * len(nodes)
    container = field
    while container and nodes[container][2] not in ("article", "main", "body", "html"):
        up = x.element[nodes[container][0]]
        if not up or nodes[up][2] == "html":
            break
        bad = any(x.chrome[k] or judged.is_chrome(x.role[k], of) for k in below[up] if k != container)
        if bad and (container in heads or up not in heads) or nodes[up][2] == "body" and container in heads:
            break
        container = up
    inside = [False] * len(nodes)
    loose = not x.marked[container]
    for k in range(len(nodes)):
        inside[k] = k == container or k > 0 and inside[nodes[k][0]]
        if k and inside[k] and k != container:
            drop[k] = drop[nodes[k][0]] or loose and x.element[k] == k and not _around(x, field, k) and judged.is_chrome(x.role[k], of)
    main = [b for b in open_ if inside[b[2]] and not drop[b[2]]]
    if nodes[container][2] in ("body", "html", ROOT):
        main = [b for b in main if b[5] not in said] or main
    return [b[0] for b in main]


def _around(x: Layout, node: int, k: int) -> bool:
    """Whether element k is node or around it."""
    while node > k:
        node = x.page.nodes[node][0]
    return node == k


def extract(sources: list[str | None], urls: list[str | None] | None = None) -> list[str]:
    """The main texts of pages of one host."""
    pages = [Page(s) for s in sources]
    distinct = _distinct(sources, urls or [None] * len(sources))
    known, kept, said = template([pages[i] for i in distinct])
    layouts = [Layout(p, known, kept) for p in pages]
    judged = Judged([layouts[i] for i in distinct])
    return ["\n\n".join(chosen(x, judged, said)) for x in layouts]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    sources: dict[tuple, int] = {}
    now = None

    def emit() -> Iterator[pa.RecordBatch]:
        found = extract([s for s, _ in sources], [u for _, u in sources])
        for k in range(0, len(rows), GROUP):
            part = rows[k : k + GROUP]
            told = [found[r[2]] for r in part]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), pa.array(told, pa.string()), pa.array([len(t) for t in told], pa.int64())], ["page_id", "url", "text", "n_chars"])

    for batch in batches:
        for h, g, i, u, s in zip(*(batch.column(c).to_pylist() for c in ("host", "group", "page_id", "url", "html")), strict=True):
            if rows and (h, g) != now:
                yield from emit()
                rows, sources = [], {}
            now = h, g
            rows.append((i, u, sources.setdefault((s, u), len(sources))))
    if rows:
        yield from emit()


def grouped(pages: DataFrame) -> DataFrame:
    """host, group, page_id, url, html, mark (a hash of html) for each row of pages(page_id, url, html)."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(host.alias("host"), F.col("page_id").cast("long").alias("page_id"), "url", "html")
    sizes = rows.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")).alias("size"))
    by_size = F.least(F.ceil(F.col("size") / GROUP_BYTES), F.floor(F.col("n") / GROUP_LEAST))
    many = sizes.select("host", F.greatest(F.ceil(F.col("n") / GROUP), by_size).alias("groups")).where("groups > 1")
    at = F.pmod(F.xxhash64("url", "page_id"), F.coalesce("groups", F.lit(1)))
    few = many.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(many) if few else many.hint("merge"), "host", "left").select("host", at.alias("group"), "page_id", "url", "html", F.xxhash64("html").alias("mark"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    return grouped(pages).repartitionByRange("host", "group").sortWithinPartitions("host", "group", "page_id", "url", "mark").drop("mark").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(load(spark, sf_dir, "pages"))


SQL = None
