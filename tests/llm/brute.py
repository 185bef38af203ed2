"""Plain versions of the operators' contracts, over lists of rows."""

import base64
import hashlib
import re
from html.parser import HTMLParser
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {j for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n, rep = len(w), len(covered)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def pii(text):
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(m):
        d = [int(c) for c in digits(m)][::-1]
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0

    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m[0])]
    return [sum(f[1] == k for f in found) for k in range(4)], ",".join(f"{n}:{s}:{e}" for s, _, n, e in sorted(found))


def warc(rows):
    first = {}
    for page_id, html in rows:
        p = (html or "").encode()
        first[p] = min(first.get(p, page_id), page_id)
    return {i: (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if first[p] == i else "revisit", None if first[p] == i else first[p]) for i, h in rows for p in [(h or "").encode()]}


def substring(rows, size=13):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows}
    for i, w in words.items():
        for k in range(len(w) - size + 1):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - size + 1) if first[tuple(w[k : k + size])] < i for j in range(k, k + size)}
        out[i] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    w = WORD.findall(lower(text))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(rows, radius=2):
    fp = {i: fingerprint(t) for i, t in rows}
    by = defaultdict(list)
    for i, f in fp.items():
        by[f].append(i)
    root = {f: f for f in by}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(by)
    for a, x in enumerate(fps):
        for y in fps[:a]:
            if (x ^ y).bit_count() <= radius:
                root[find(x)] = find(y)
    least = {}
    for f in fps:
        least[find(f)] = min([least.get(find(f), 1 << 62), *by[f]])
    return {i: (f"{f:016x}", least[find(f)]) for i, f in fp.items()}


def lines(rows, max_ratio=0.02, min_pages=3):
    total, pages = Counter(), Counter()
    for _, host, text in rows:
        total[host] += 1
        pages.update((host, x) for x in set((text or "").split("\n")) if WORD.search(x))
    drop = {k for k, n in pages.items() if n >= min_pages and n > max_ratio * total[k[0]]}
    out = {}
    for i, host, text in rows:
        each = text.split("\n") if text is not None else []
        kept = [x for x in each if (host, x) not in drop]
        out[i] = (None if text is None else "\n".join(kept), len(each), len(each) - len(kept))
    return out


def contaminated(docs, items, threshold=0.8):
    def words(t):
        return [x for x in re.split(r"[^\w]|_", (t or "").lower()) if x]

    bag = lambda w: Counter(" ".join(w[i : i + 5]) for i in range(len(w) - 4))
    found = set()
    want = [(i, words(t)) for i, t in items]
    keys = defaultdict(set)
    for n, (i, w) in enumerate(want):
        for s in bag(w):
            keys[s].add(n)
    for d, t in docs:
        w = words(t)
        for n in {n for s in bag(w) for n in keys.get(s, ())}:
            i, x = want[n]
            a = bag(x)
            for k in range(max(1, len(w) - len(x) + 1)):
                b = bag(w[k : k + len(x)])
                union = sum(max(a[s], b[s]) * len(s) for s in a | b)
                if union and sum(min(a[s], b[s]) * len(s) for s in a | b) / union >= threshold:
                    found.add((d, i))
                    break
    return found


class Article(HTMLParser):
    """The blocks of text inside article of well-marked pages, by the standard library's parser."""

    BLOCKS = set("article div p h1 h2 h3 h4 ul ol li blockquote pre table tr td th section header footer aside form nav".split())
    APART = set("script style nav aside footer form".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.held, self.inside, self.apart = [], [], 0, 0

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.flush()
        self.inside += tag == "article"
        self.apart += tag in self.APART
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.flush()
        self.inside -= tag == "article"
        self.apart -= tag in self.APART

    def handle_data(self, data):
        if self.inside and not self.apart:
            self.held.append(data)


def article(html):
    p = Article()
    p.feed(html or "")
    p.close()
    p.flush()
    return "\n\n".join(p.blocks)
