"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page's DOM.

A page is cut into leaf blocks, each with the tags, classes and ids above it. The field's features are those, the
block's own tag and the shape of its text; neighbouring labels are tied by transition weights. It is trained by
gradient ascent on labelled pages (``labelled_pages`` lays out pages whose labels are known) and decoded by Viterbi.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import set_aside

#: Fixed: elements without content, elements whose content holds no markup and is no text of the page, other elements
#: whose content is no text of the page (form fields, drawings, what is not shown), and elements that don't break a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("template svg select datalist canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var math mi mn mo ms mtext mrow mfrac msup msub".split())
#: Fixed: elements that hold a line or paragraph of the element around them.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split())
#: Fixed: an element that one of these opens closes an open one of the others.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<>]*+"|'[^'<>]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?][^>]*>|([^<]+|<)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)


@dataclass
class Block:
    """The decoded text of a leaf block, what stands above it from the outside in, its share of linked characters, and the number of the element that holds it and its like."""

    text: str
    path: tuple[tuple[str, str], ...]
    linked: float
    parent: int = 0


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of a whole page that have text, in page order; markup may be broken and nested to any depth.

    Of a block more than 200 elements deep, the outer 100 and the inner 100 are its path. An element of RAW that is
    never closed holds the rest of the page; one of UNSEEN ends with the element around it. As in browsers a ``/`` before
    ``>`` ends an element in a drawing and a drawing, and nothing else.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    numbers = [0]  # of the page and of each open element
    serial = 0
    opened: Counter[str] = Counter()
    parts: list[str] = []
    links = in_link = unseen = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text and not unseen:
                path = stack if len(stack) <= 200 else stack[:100] + stack[-100:]
                out.append(Block(text, tuple(path), min(1.0, links / len(text)), numbers[max(0, len(stack) - (bool(stack) and stack[-1][0] in LINES))]))
            parts.clear()
        links = 0

    def close(depth: int) -> None:
        nonlocal unseen
        for tag, _ in stack[depth:]:
            opened[tag] -= 1
            unseen -= tag in UNSEEN
        del stack[depth:], numbers[depth + 1 :]

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            if m[7]:
                text = entities.unescape(m[7]) if "&" in m[7] else m[7]
                parts.append(text)
                if in_link:
                    links += len(text)
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        if closing:
            if opened[tag] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
                in_link = 0
        elif tag in RAW:
            if not (opened["svg"] and attributes.endswith("/")):
                over = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = over.end() if over else end
        elif tag not in VOID and not (attributes.endswith("/") and (tag == "svg" or opened["svg"])):
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                if stack[i][0] in CLOSED_BY.get(tag, ()):
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
            names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower() if "=" in attributes else ""
            stack.append((tag, names))
            serial += 1
            numbers.append(serial)
            opened[tag] += 1
            unseen += tag in UNSEEN
    flush()
    return out


def path_features(path: tuple[tuple[str, str], ...]) -> list[str]:
    """Ancestor tags and the words of their classes and ids, once each, and what the innermost telling one tells."""
    out = {f"in:{t}" for t, _ in path} | {f"is:{w}" for _, names in path for w in re.split(r"[\s_\-]+", names) if w}
    if path:
        out.add(f"own:{path[-1][0]}")
        section = next((t for t, _ in reversed(path) if t in ("nav", "aside", "footer", "header", "form", "article", "main", "section", "dialog")), "none")
        out.add(f"section:{section}")
        told = next((x for x in map(_telling, reversed(path)) if x), "nothing")
        out |= {f"told:{told}", f"told:{told} own:{path[-1][0]}"}
    return sorted(out)


def _telling(element: tuple[str, str]) -> str:
    """What an element's tag and names are common for: the article (main), other things (aside), both, or nothing."""
    tag, names = element
    words = {tag, *re.split(r"[\s_\-]+", names)}
    main, aside = words & _words()[0], words & _words()[1]
    return "both" if main and aside else "main" if main else "aside" if aside else ""


@lru_cache(maxsize=1)
def _words() -> tuple[frozenset[str], frozenset[str]]:
    """Tags and words of names that MAIN and ASIDE tell apart."""
    main, aside = ({t for t, *_ in kinds} | {w for _, names, *_ in kinds for w in re.split(r"[|\-]", names)} for kinds in (MAIN, ASIDE))
    plain = {"", "div", "section", "ol", "ins"}
    return frozenset(main - aside - plain), frozenset(aside - main - plain)


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    return [f"chars:{min(9, n.bit_length())}", f"linked:{int(b.linked * 3.99)}", "ends:" + ("stop" if b.text[-1] in ".!?…。" else "bare")]


def kin_features(blocks: list[Block]) -> list[list[str]]:
    """Of each block, how much text, links and paragraphs the element that holds it has, and whether the page's heading."""
    held: dict[int, list] = {}
    for b in blocks:
        k = held.setdefault(b.parent, [0, 0.0, 0, False])
        own = b.path[-1][0] if b.path else ""
        k[0] += len(b.text)
        k[1] += b.linked * len(b.text)
        k[2] += own == "p"
        k[3] = k[3] or own == "h1"
    most = max((k[0] for k in held.values()), default=0)
    told = {i: [f"kin:{min(12, n.bit_length())}", f"kin_linked:{int(linked / n * 3.99)}", f"kin_p:{min(4, p)}", f"kin_h1:{h1}", f"kin_most:{n == most}", f"kin_h1:{h1} kin_p:{min(4, p)}"] for i, (n, linked, p, h1) in held.items()}
    return [told[b.parent] for b in blocks]


@dataclass
class Field:
    """Weights for main against other: of features, of both labels' transitions, and of the first block."""

    weights: dict[str, float] = field(default_factory=dict)
    step: list[float] = field(default_factory=lambda: [0.0] * 4)  # from other, main to other, main
    paths: dict = field(default_factory=dict)

    def scores(self, blocks: list[Block]) -> list[float]:
        w, out = self.weights, []
        for b, kin in zip(blocks, kin_features(blocks), strict=True):
            s = self.paths.get(b.path)
            if s is None:
                if len(self.paths) > 20_000:
                    self.paths.clear()
                s = self.paths[b.path] = sum(w.get(f, 0.0) for f in path_features(b.path))
            out.append(s + sum(w.get(f, 0.0) for f in text_features(b)) + sum(w.get(f, 0.0) for f in kin))
        return out

    def decode(self, scores: list[float]) -> list[bool]:
        """The most likely labels, by Viterbi."""
        other, main, back, (oo, om, mo, mm) = 0.0, 0.0, [], self.step
        for i, s in enumerate(scores):
            if i:
                a, b = (other + oo, 0) if other + oo >= main + mo else (main + mo, 1)
                c, d = (other + om, 0) if other + om >= main + mm else (main + mm, 1)
                back.append((b, d))
                other, main = a, c
            main += s
        label = int(main > other)
        out = [bool(label)] * bool(scores)
        for b in reversed(back):
            label = b[label]
            out.append(bool(label))
        return out[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], epochs: int = 25, rate: float = 4.0, decay: float = 1e-3) -> Field:
    """Conditional log likelihood by stochastic gradient ascent, with forward and backward sums."""
    f, chance = Field(), random.Random(1)
    soft = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    data = [([path_features(b.path) + text_features(b) + kin for b, kin in zip(blocks, kin_features(blocks), strict=True)], labels) for blocks, labels in pages if blocks]
    for epoch in range(epochs):
        lr = rate / (1 + epoch)
        for k in chance.sample(range(len(data)), len(data)):
            features, labels = data[k]
            s = [sum(f.weights.get(x, 0.0) for x in fs) for fs in features]
            oo, om, mo, mm = f.step
            fwd = [(0.0, s[0])]
            for x in s[1:]:
                o, m = fwd[-1]
                fwd.append((soft(o + oo, m + mo), soft(o + om, m + mm) + x))
            bwd = [(0.0, 0.0)]
            for x in reversed(s[1:]):
                o, m = bwd[-1]
                bwd.append((soft(oo + o, om + x + m), soft(mo + o, mm + x + m)))
            bwd.reverse()
            z = soft(*fwd[-1])
            for i, fs in enumerate(features):
                g = labels[i] - math.exp(min(0.0, fwd[i][1] + bwd[i][1] - z))
                for x in fs:
                    w = f.weights.get(x, 0.0)
                    f.weights[x] = w + lr * (g - decay * w) / len(fs)
                if i:
                    for a in (0, 1):
                        for b in (0, 1):
                            p = math.exp(min(0.0, fwd[i - 1][a] + f.step[2 * a + b] + (s[i] if b else 0.0) + bwd[i][b] - z))
                            f.step[2 * a + b] += lr * 0.1 * ((labels[i - 1] == a and labels[i] == b) - p)
            f.step = [max(-3.0, min(3.0, x)) for x in f.step]
    return f


#: Fixed: how common page designs name what is not the article, and where they put the article.
ASIDE = [
    ("nav", "nav|menu|main-menu|navbar|breadcrumb|site-navigation", "links"), ("div", "menu|topbar|navigation|breadcrumbs|pagination|toc|skip", "links"),
    ("header", "header|site-header|masthead|page-header|", "text"), ("div", "header|top-header|logo|masthead|branding", "text"),
    ("footer", "footer|site-footer|page-footer|", "text"), ("div", "footer|copyright|colophon|bottom|legal", "text"),
    ("aside", "sidebar|aside|widget|related|", "text"), ("div", "sidebar|side|widget|related|recommended|popular|tags|share|social|author-box", "text"),
    ("div", "ad|ads|advert|advertisement|banner|sponsored|promo|sponsor|ad-slot|adsbygoogle", "text"), ("ins", "ad|adsbygoogle", "text"), ("noscript", "", "text"),
    ("div", "cookie|cookie-notice|notice|consent|gdpr|alert|cookie-banner|popup|modal|overlay|notification", "text"), ("dialog", "dialog|consent|", "text"),
    ("form", "search|newsletter|login|subscribe|signup|", "text"), ("div", "newsletter|subscribe|signup|paywall", "text"),
    ("section", "comments|comment-list|responses|discussion|reviews", "comments"), ("div", "comments|comment|disqus|respond|comment-thread", "comments"), ("ol", "comments|comment-list|commentlist", "comments"),
]
MAIN = [("article", "|post|article|entry"), ("main", "|main|content"), ("div", "content|article|post|entry|article-body|post-content|entry-content|story|main|text|body"), ("section", "content|article|story|post-body")]


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Pages with the texts of their main blocks, which are all distinct from the other blocks' texts.

    Most other things have names that tell, articles less than half; the rest have invented ones or none; some articles stand in the page itself.
    """
    r, serial = random.Random(seed), iter(range(10**9))

    def words(low: int, high: int) -> str:
        text = " ".join("".join(r.choice("abdegiklmnoprstuvz") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high)))
        return f"{text} {next(serial)}{r.choice(['.', '.', '.', '!', '?', ''])}".capitalize()

    def named(names: str, telling: float = 0.45) -> str:
        x = r.random()
        name = r.choice(names.split("|")) if x < telling else "".join(r.choice("abcdefgmnoprstuvwxyz0123456789-_") for _ in range(r.randint(2, 12))) if x < (1 + telling) / 2 else ""
        return f' {r.choice(["class", "class", "id"])}="{name}"' if name else ""

    def aside() -> str:
        tag, names, kind = r.choice(ASIDE)
        if kind == "links":
            body = "<ul>" + "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(r.randint(2, 8))) + "</ul>"
        elif kind == "comments":
            body = "".join(f'<{t}><p>{words(3, 60)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 5)))
        else:
            body = "".join(r.choice(["<p>{}</p>", "<div>{}</div>", "{}<br>", "<h3>{}</h3>", "<a href='/y'>{}</a>", "<ul><li>{}</li></ul>"]).format(words(1, r.choice([4, 15, 60]))) for _ in range(r.randint(1, 4)))
        return f"<{tag}{named(names, 0.8)}>{body}</{tag}>"

    pages = []
    for _ in range(n):
        main, kept = [], []

        def own(low: int, high: int, kept: list[str] = kept) -> str:
            kept.append(words(low, high))
            return kept[-1]

        if r.random() < 0.9:
            main.append(f"<h1>{own(2, 10)}</h1>")
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.7:
                main.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(own(1, r.choice([3, 40, 120]))))
            elif x < 0.78:
                main.append(f"<h2>{own(1, 8)}</h2>")
            elif x < 0.84:
                main.append("<ul>" + "".join(f"<li>{own(1, 20)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif x < 0.9:
                main.append(r.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>"]).format(own(1, 30)))
            else:  # an aside in the article, often with a short paragraph after it, which may be the last
                main.append(aside())
                if r.random() < 0.6:
                    main.append(r.choice(["<p>{}</p>", "<p>{}", "<div>{}</div>"]).format(own(1, 6)))
        if r.random() < 0.3:
            main += [aside(), r.choice(["<p>{}</p>", "<p>{}"]).format(own(1, r.choice([2, 8, 40])))]
        tag, names = r.choice(MAIN)
        article = "".join(main) if r.random() < 0.1 else f"<{tag}{named(names)}>{''.join(main)}</{tag}>"
        body = [aside() for _ in range(r.randint(0, 4))] + [article] + [aside() for _ in range(r.randint(0, 4))]
        if r.random() < 0.4:
            body = [f"<div{named('wrapper|container|page|site|row|')}>{''.join(body)}</div>"]
        pages.append((f"<html><head><title>{words(2, 5)}</title></head><body>{''.join(body)}</body></html>", kept))
    return pages


@lru_cache(maxsize=1)
def trained_field(n: int = 1000, seed: int = 7) -> Field:
    """The field that labelled_pages(n, seed) teach."""
    data = []
    for page, kept in labelled_pages(n, seed):
        texts, blocks = {" ".join(k.split()) for k in kept}, leaf_blocks(page)
        data.append((blocks, [b.text in texts for b in blocks]))
    return train(data)


def main_text(page: str | None, f: Field) -> str:
    """The main blocks of a whole page, in page order, with an empty line between them."""
    blocks = leaf_blocks(page or "")
    return "\n\n".join(b.text for b, main in zip(blocks, f.decode(f.scores(blocks)), strict=True) if main)


def extract(pages: DataFrame, html_col: str = "html", model: Field | None = None) -> DataFrame:
    """pages with text and n_chars (code points) for html_col, whose column goes; columns of those names are replaced.

    A null or empty page has an empty text. Rows are judged one by one: repeated rows stay, empty tables give none. Very
    long and very deep pages are read whole, in time that grows with their length.
    """
    f = model or trained_field()

    @F.pandas_udf("string")
    def text_of(html):
        return html.map(lambda page: main_text(page, f), na_action=None)

    own, names = set_aside(pages)
    out = own.withColumn("text", text_of(F.coalesce(F.col(names[html_col]), F.lit("")))).withColumn("n_chars", F.length("text").cast("long"))
    kept = [F.col(new).alias(old) for old, new in names.items() if old not in ("text", "n_chars", html_col)]
    return out.select(*kept, "text", "n_chars")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
