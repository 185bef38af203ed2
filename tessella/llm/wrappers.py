"""Main text of web pages by wrappers: union-free regular expressions over the token streams of a host's pages.

A page's tokens nest into elements; its expression has for each element its signature (tag and classes), for each
text a constant. Aligning the expressions of a host keeps what agrees, makes differing texts slots, elements that
only some have optional, and equal siblings, alone or in turns of up to three, repeated groups. Alignment is a fold: map tasks
fold their pages per host, then partial wrappers are folded by groups of FAN, again and again, so no task ever holds a
host's pages or all its partial wrappers. Nothing recurses, so tags may nest to any depth.

The wrapper decides twice. Constants that at least three different pages of a host have are template text; copies of one
page count once, as evidence is what else a page says at length. And on pages without article or main, the main block is the
innermost container that holds most of the text in slots; a page of a host without such a block is read whole.

Main text is what stands in the article, main or main block (else anywhere) outside of navigation, headers, footers,
sidebars, notices, adverts, forms, scripts and comments, as tags, classes, ids and roles name them, and isn't template text. An
article or main that is itself set apart, or that holds less running text than the rest of the page (a teaser), isn't the article.
No text inside article or main is dropped as template text, because it is hidden, or for a word within a longer class name. Null html is an empty page with an empty text; a null or odd url belongs
to one common host; repeated rows are the same page to the fold. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Fixed values of HTML: elements without content, with raw text, that start a block, and that close an open p.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html caption tbody td tfoot th thead tr option optgroup legend summary figcaption".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
#: Never main text, by element.
APART = frozenset("nav footer aside form script style noscript template head title button select option textarea iframe svg canvas object menu dialog input label fieldset".split())
#: Never main text, by a word of class, id or role.
APART_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promo(?:tion|s)?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|modals?|newsletter|subscribe|signup|login|nav|navbar|navigation|menus?|breadcrumbs?|sidebars?|aside|widgets?|related|recommended|share|sharing|social|comments?|commentlist|replies|reply|responses?|disqus|footers?|masthead|topbar|toolbar|pagination|pager|search|skip|copyright|legal|complementary|contentinfo|site-header|page-header)(?:$|[\s_-])",
    re.I,
)
#: Inside an article a name must say so whole, each of its parts one of these or of the words above ("social-history" doesn't), and
#: the weak ones need a second sign: that most of the element's text is links.
HELPERS = frozenset(
    "area article articles bar bars block blocks body bottom box btn button buttons col column container content desktop end entry form full group header holder icon icons inline inner item items left link links list main mobile module outer page panel post posts right row section site slot small sticky strip text thread title top unit wrap wrapper zone".split()
)
WEAK = frozenset("copyright legal reply response search skip social".split())
#: A name such as has-sidebar speaks of another element.
ABOUT = re.compile(r"^(?:has|with|without|no|not|is|non)[_-]?", re.I)
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?=/?[A-Za-z])[^<]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "sig", "words", "kids", "hidden")

    def __init__(self, tag: str, sig: str, words: str = "", hidden: bool = False):
        self.tag, self.sig, self.words, self.kids, self.hidden = tag, sig, words, [], hidden


def parse(source: str) -> Node:
    """A tree of elements and texts; forgiving about missing end tags and cut pages."""
    root = Node("", "")
    stack, at, n = [root], 0, len(source)
    open_tags: Counter[str] = Counter()

    def push(node: Node) -> None:
        stack.append(node)
        open_tags[node.tag] += 1

    def close(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        if not any(open_tags[x] for x in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                open_tags.subtract(x.tag for x in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in scope:
                return

    while at < n:
        m = TOKEN.search(source, at)
        end = m.start() if m else n
        if end > at:
            stack[-1].kids.append(source[at:end])
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            continue
        tag = tag.lower()
        if m.group(1):
            close((tag,), ("table", "td") if tag not in ("table", "td", "tr", "tbody", "html", "body", "article", "main") else ())
            continue
        names, hidden = "", False
        if m.group(3):
            found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m.group(3))}
            names = " ".join(found[k] for k in ("class", "id", "role") if found.get(k))
            hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag in CLOSES_P:
            close(("p",), ("table", "button", "object"))
        if tag in SIBLINGS:
            close(SIBLINGS[tag], SCOPE[tag])
        node = Node(tag, f"{tag}.{re.sub('[0-9]+', '0', names)}" if names else tag, names, hidden)
        stack[-1].kids.append(node)
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if m or tag not in ("title", "textarea"):
                at = m.end() if m else n
        elif tag not in VOID and not m.group(3).endswith("/"):
            push(node)
        elif tag in BLOCK and tag not in VOID:
            push(node)
    return root


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def set_apart(words: str) -> bool:
    """Whether a class, id or role names something that is no main text."""
    return any(APART_WORD.search(CAMEL.sub("-", w)) for w in words.split() if not (ABOUT.match(w) and ABOUT.match(w).end() < len(w)))


def _linked_share(node: Node) -> float:
    """The share of an element's text that is in links."""
    total = links = 0
    stack = [(node, False)]
    while stack:
        e, inside = stack.pop()
        for k in e.kids:
            if isinstance(k, str):
                n = len(clean(k))
                total, links = total + n, links + n * inside
            else:
                stack.append((k, inside or k.tag == "a"))
    return links / total if total else 1.0


def set_apart_inside(k: Node) -> bool:
    """set_apart for an element of an article: whole names only, and weak words with a second sign."""
    weak = False
    for w in k.words.split():
        if not set_apart(w):
            continue
        parts = [x for x in re.split("[_-]", CAMEL.sub("-", w).lower()) if x and not x.isdigit()]
        known = [x for x in parts if APART_WORD.search(x)]
        if all(x in known or x in HELPERS for x in parts):
            if any(x not in WEAK for x in known) or not known:
                return True
            weak = True
    return weak and _linked_share(k) >= 0.5


def _is_apart(k: Node, article: bool) -> bool:
    if article:  # what an article has is its text, but for what is named without doubt
        return k.tag in APART and k.tag not in ("label", "menu") or bool(k.words) and k.tag != "main" and set_apart_inside(k)
    return k.tag in APART or k.hidden or k.tag == "header" or bool(k.words and k.tag not in ("html", "body", "main") and set_apart(k.words))


def clean(raw: str) -> str:
    return SPACE.sub(" ", html_lib.unescape(raw)).strip()


# An expression is [signature, optional, repeated, constant or 0 for a slot, kids, evidence, characters, occurrences]:
# evidence are digests of up to three pages that have the constant, characters those of texts outside of links and of what is set
# apart. Texts have the signature "#".
SIG, OPTIONAL, REPEATED, CONSTANT, KIDS, PAGES, CHARS, TIMES = range(8)
EVIDENCE, TURN, FAN = 3, 3, 64
#: An optional part that fewer than this share of a host's pages have is dropped whenever another thousand pages have come: too
#: few to tell template text from.
RARE = 1000
#: Lists of siblings are halved until a table of their pairs has so many cells.
MOST_CELLS = 250_000


def expression(root: Node) -> list:
    """The expression of one page."""
    texts: list[list] = []
    top = [root.sig, False, False, 0, [], [], 0, 1]
    stack = [(root, top, False, False)]
    while stack:
        node, out, silent, article = stack.pop()
        for k in node.kids:
            if isinstance(k, str):
                if text := clean(k):
                    own = ["#", False, False, _digest(text), [], [], 0 if silent else len(text), 1]
                    texts.append(own)
                    out[KIDS].append(own)
            else:
                new = [k.sig, False, False, 0, [], [], 0, 1]
                out[KIDS].append(new)
                stack.append((k, new, silent or k.tag == "a" or _is_apart(k, article), article or k.tag in ("article", "main")))
    longest = [t[CONSTANT] for t in heapq.nlargest(EVIDENCE + 1, texts, key=lambda t: (t[CHARS], t[CONSTANT]))]
    for t in texts:
        t[PAGES] = [_digest(",".join(map(str, [d for d in longest if d != t[CONSTANT]][:EVIDENCE])))]
    return merged([top])


def _combined(sources: list[list], optional: bool, repeated: bool) -> list:
    first = sources[0]
    constant = first[CONSTANT] if all(s[CONSTANT] == first[CONSTANT] for s in sources) else 0
    pages = sorted({d for s in sources for d in s[PAGES]})[:EVIDENCE] if constant else []
    return [first[SIG], optional or any(s[OPTIONAL] for s in sources), repeated or any(s[REPEATED] for s in sources), constant, [], pages, sum(s[CHARS] for s in sources), sum(s[TIMES] for s in sources)]


def merged(sources: list[list]) -> list:
    """The expression that matches what any of some with the same signature matches."""
    top = _combined(sources, False, False)
    stack = [(top, sources)]
    while stack:
        out, sources = stack.pop()
        groups = [[k[SIG], [k], False, False] for k in sources[0][KIDS]]
        for s in sources[1:]:
            groups = _aligned(groups, s[KIDS])
        for _, some, optional, repeated in _turns(groups):
            child = _combined(some, optional, repeated)
            out[KIDS].append(child)
            if any(s[KIDS] for s in some):
                stack.append((child, some))
    return top


def _aligned(groups: list[list], kids: list[list]) -> list[list]:
    """Groups (signature, members, optional, repeated) with one more list of siblings dealt to them."""
    x, y = [g[0] for g in groups], [k[SIG] for k in kids]
    if x == y:
        for g, k in zip(groups, kids):
            g[1].append(k)
        return groups
    out, i, j = [], 0, 0
    for p, q in [*_matches(x, y), (len(x), len(y))]:
        for g in groups[i:p]:
            g[2] = True
            out.append(g)
        out += [[k[SIG], [k], True, False] for k in kids[j:q]]
        if p < len(x):
            groups[p][1].append(kids[q])
            out.append(groups[p])
        i, j = p + 1, q + 1
    return out


def _common(x: list[str], y: list[str]) -> np.ndarray:
    """For each n, the length of the longest common sequence of x and the first n of y: a bit for each element of y, worked on at once."""
    places: dict[str, int] = {}
    for j, s in enumerate(y):
        places[s] = places.get(s, 0) | 1 << j
    full = v = (1 << len(y)) - 1
    for s in x:
        if u := v & places.get(s, 0):
            v = (v + u | v - u) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common sequence, in ascending order. Long lists are halved where the parts have most in common."""
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    found = [(i, i) for i in range(lo)]
    todo = [(lo, len(x), lo, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if (b - a) * (d - c) <= MOST_CELLS or b - a < 2:
            found += [(a + i, c + j) for i, j in _longest_common(x[a:b], y[c:d])]
            continue
        half = (a + b) // 2
        at = c + int(np.argmax(_common(x[a:half], y[c:d]) + _common(x[half:b][::-1], y[c:d][::-1])[::-1]))
        todo += [(half, b, at, d), (a, half, c, at)]  # the first half is taken next
    return found


def _longest_common(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    if len(x) == 1:
        return [(0, y.index(x[0]))] if x[0] in y else []
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    found, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def _turns(groups: list[list]) -> list[list]:
    """Groups with turns of up to TURN signatures that follow each other taken together as repeated groups."""
    out: list[list] = []
    for g in groups:
        out.append(g)
        for n in range(1, TURN + 1):
            if len(out) >= 2 * n and [x[0] for x in out[-2 * n : -n]] == [x[0] for x in out[-n:]]:
                for a, b in zip(out[-2 * n : -n], out[-n:]):
                    a[1], a[2], a[3] = a[1] + b[1] if len(a[1]) < len(b[1]) else _extended(a[1], b[1]), a[2] and b[2], True
                del out[-n:]
                break
    return out


def _extended(a: list, b: list) -> list:
    a.extend(b)
    return a


def _nodes(wrapper: list) -> list[list]:
    """All nodes, parents before their kids."""
    out = [wrapper]
    for e in out:
        out += e[KIDS]
    return out


def packed_wrapper(wrapper: list) -> str:
    """The nodes by breadth, with their numbers of kids: flat, as JSON readers recurse."""
    return json.dumps([[*e[:KIDS], len(e[KIDS]), *e[PAGES:]] for e in _nodes(wrapper)])


def unpacked_wrapper(text: str) -> list:
    flat = json.loads(text)
    nodes, at = [[*e[:KIDS], [], *e[PAGES:]] for e in flat], 1
    for e, f in zip(nodes, flat):
        e[KIDS] = nodes[at : at + f[KIDS]]
        at += f[KIDS]
    return nodes[0]


def _add(state: list | None, new: list) -> list:
    if state is None:
        return new
    before = state[TIMES]
    state = merged([state, new])
    if before // RARE != state[TIMES] // RARE:
        for e in _nodes(state):
            e[KIDS] = [k for k in e[KIDS] if not k[OPTIONAL] or k[TIMES] * RARE >= state[TIMES]]
    return state


def fold(pages: list[str]) -> list | None:
    """The expression of a host's pages."""
    state = None
    for p in pages:
        state = _add(state, expression(parse(p)))
    return state


def _below(key: int, sig: str) -> int:
    return _digest(f"{key:x}/{sig}")


def _is_constant(e: list) -> bool:
    return bool(e[CONSTANT]) and not e[REPEATED] and len(e[PAGES]) >= EVIDENCE


#: Elements of which one may be a page's main block, and the share of the text in slots that the next inner one must hold.
CONTAINERS = frozenset("html body div section center table tbody tr td main article".split())
SHARE = 0.7


def constants(wrapper: list) -> list[int]:
    """Keys of the texts that the wrapper has as constants, each the digest of its path and text."""
    found, stack = [], [(wrapper, 0)]
    while stack:
        e, key = stack.pop()
        for k in e[KIDS]:
            if k[SIG] == "#":
                if _is_constant(k):
                    found.append(_digest(f"{key:x}#{k[CONSTANT]}"))
            elif k[SIG].partition(".")[0] not in ("article", "main"):
                stack.append((k, _below(key, k[SIG])))
    return sorted(set(found))


def main_block(wrapper: list) -> int:
    """The key of the innermost container that holds most text in slots; 0 if that is the whole page."""
    if wrapper[TIMES] < EVIDENCE:
        return 0
    slots: dict[int, int] = {}
    for e in reversed(_nodes(wrapper)):
        slots[id(e)] = sum(slots[id(k)] for k in e[KIDS]) if e[SIG] != "#" else 0 if _is_constant(e) else e[CHARS]
    at, key = wrapper, 0
    while True:
        inner = [k for k in at[KIDS] if k[SIG].partition(".")[0] in CONTAINERS and not k[REPEATED]]
        best = max(inner, key=lambda k: slots[id(k)], default=None)
        if best is None or not slots[id(best)] or slots[id(best)] < SHARE * slots[id(at)]:
            return key if at[SIG].partition(".")[0] not in ("", "html", "body") else 0
        at, key = best, _below(key, best[SIG])


def regular_expression(wrapper: list) -> str:
    """The wrapper in a readable form: ( )? optional, ( )+ repeated, #PCDATA a slot, "..." a constant."""
    out, stack = [], [(k, False) for k in reversed(wrapper[KIDS])]
    while stack:
        e, done = stack.pop()
        if not done:
            out.append("(" * (e[OPTIONAL] + e[REPEATED]))
            if e[SIG] != "#":
                out.append(f"<{e[SIG]}>")
            stack.append((e, True))
            stack += [(k, False) for k in reversed(e[KIDS])]
        else:
            out.append((f"</{e[SIG].split('.')[0]}>" if e[SIG] != "#" else f'"{e[CONSTANT]:x}"' if e[CONSTANT] else "#PCDATA") + ")+" * e[REPEATED] + ")?" * e[OPTIONAL])
    return "".join(out)


def _walk(root: Node, template: frozenset[int] | set[int], only: str, block: int) -> tuple[list[str], bool, bool]:
    """Blocks of text, whether the part to read was met, and whether it has an h1."""
    blocks: list[str] = []
    held: list[str] = []
    fixed: list[bool] = []
    met = headed = False

    def flush() -> None:
        text = clean("".join(held))
        held.clear()
        # a block goes if all of it is constant; constant words inside a sentence stay
        template_text = bool(fixed) and all(fixed)
        fixed.clear()
        if text and not template_text:
            blocks.append(text)

    keyed = bool(template) or bool(block)
    stack = [(root, iter(root.kids), 0, not only, False)]
    while stack:
        node, kids, key, inside, article = stack[-1]
        for k in kids:
            if isinstance(k, str):
                if inside:
                    held.append(k)
                    if text := clean(k):
                        fixed.append(bool(template) and not article and _digest(f"{key:x}#{_digest(text)}") in template)
                continue
            if k.tag == "br" or k.tag == "hr":
                held.append(" ")
                continue
            if k.tag in BLOCK:
                flush()
            if not _is_apart(k, article):
                below = _below(key, k.sig) if keyed else 0
                is_main = k.tag in ("article", "main")
                starts = is_main if only == "article" else only == "block" and below == block
                met = met or starts
                headed = headed or k.tag == "h1" and (inside or starts)
                stack.append((k, iter(k.kids), below, inside or starts, article or is_main))
                break
        else:
            stack.pop()
            if node.tag in BLOCK:
                flush()
    flush()
    return blocks, met, headed


def _tags(root: Node, template: frozenset[int] | set[int]) -> tuple[int, int, list[Node]]:
    """Characters of running text inside and outside of articles and mains, and the h1 outside of what is set apart. Links, template
    text and what is set apart don't count."""
    stack, inside, outside, first = [(root, 0, False)], 0, 0, []
    while stack:
        node, key, article = stack.pop()
        for k in node.kids:
            if isinstance(k, str):
                text = clean(k)
                if article:
                    inside += len(text)
                elif text and not (template and _digest(f"{key:x}#{_digest(text)}") in template):
                    outside += len(text)
            elif not _is_apart(k, article):
                if k.tag == "h1":
                    first.append(k)
                if k.tag != "a" or article:
                    stack.append((k, _below(key, k.sig) if template else 0, article or k.tag in ("article", "main")))
    return inside, outside, first


def main_text(source: str, template: frozenset[int] | set[int] = frozenset(), block: int = 0) -> str:
    """The main text, given the keys of the host's constants and main block. Articles are read where they hold as much text as the
    rest of the page; else the main block, else the whole page."""
    root = parse(source)
    inside, outside, first = _tags(root, template)
    if inside and inside >= outside:
        return "\n\n".join(_walk(root, template, "article", 0)[0])
    if block and not inside:
        blocks, met, headed = _walk(root, template, "block", block)
        if met and blocks:
            if not headed and len(first) == 1:
                blocks = _walk(first[0], frozenset(), "", 0)[0] + blocks
            return "\n\n".join(blocks)
    return "\n\n".join(_walk(root, template, "", 0)[0])


#: Wrappers' constants are broadcast up to so many keys in all; beyond, pages and wrappers meet by host in a shuffle, a
#: host's pages dealt to this many keys.
BROADCAST_KEYS = 500_000
SALTS = 64


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


PARTIAL = "host string, lane long, wrapper string, n long"


def _partials(rows: list[tuple[str, int, list, int]]) -> pa.RecordBatch:
    columns = [list(x) for x in zip(*rows)] if rows else [[]] * 4
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([packed_wrapper(w) for w in c] if i == 2 else c, k) for i, (c, k) in enumerate(zip(columns, kinds))], ["host", "lane", "wrapper", "n"])


def infer(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON), n: pages of the host."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lane, found = TaskContext.get().partitionId(), {}
        for b in batches:
            for host, source in zip(*(b.column(i).to_pylist() for i in (0, 1))):
                had, n = found.get(host, (None, 0))
                found[host] = _add(had, expression(parse(source))), n + 1
                if len(found) > 2_000:
                    yield _partials([(h, lane, w, n) for h, (w, n) in found.items()])
                    found = {}
        yield _partials([(h, lane, w, n) for h, (w, n) in found.items()])

    def again(table: pa.Table) -> pa.Table:
        state, n = None, 0
        for w, k in sorted(zip(table.column("wrapper").to_pylist(), table.column("n").to_pylist())):
            state, n = _add(state, unpacked_wrapper(w)), n + k
        return pa.Table.from_batches([_partials([(table.column("host")[0].as_py(), table.column("lane")[0].as_py() // FAN, state, n)])])

    chosen = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    lanes, partial = chosen.rdd.getNumPartitions(), chosen.mapInArrow(local, PARTIAL)
    while lanes > FAN:
        partial = partial.groupBy("host", F.floor(F.col("lane") / FAN).alias("group")).applyInArrow(again, PARTIAL)
        lanes = -(-lanes // FAN)
    return partial.groupBy("host").applyInArrow(again, PARTIAL).drop("lane")


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wrappers = [unpacked_wrapper(w) for w in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([constants(w) for w in wrappers], pa.list_(pa.int64())), pa.array([main_block(w) for w in wrappers], pa.int64())], ["host", "template", "block"])

    templates = infer(pages).mapInArrow(keys, "host string, template array<long>, block long")
    templates = written(templates.where((F.size("template") > 0) | (F.col("block") > 0)), "wrappers")
    size = templates.agg(F.sum(F.size("template") + 8)).first()[0] or 0
    p = pages.select("page_id", "url", "html", _host().alias("host"))
    if size <= BROADCAST_KEYS:
        joined = p.join(F.broadcast(templates), "host", "left")
    else:
        salted = templates.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS))).join(salted, ["host", "salt"], "left")
    kind = dict(pages.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(s or "", frozenset(t or ()), k or 0) for s, t, k in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "template", "block").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
