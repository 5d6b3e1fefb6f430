"""HTML extraction by template deduction over pages of the same host.

Tokens are tags and the texts between them, with their path of elements.  Over the pages of a host,
each token has an occurrence vector (how often it is on each page); tokens with equal
vectors form an equivalence class.  Classes that are large enough and on nearly all pages
belong to the template, nested by their paths: a class whose paths lie under a path of
another is inside it.  The element whose slots hold most text that varies, without that of
classes inside it, is the article; the names article and main decide where that is close, and
on hosts of too few pages.  Texts in it that are template tokens themselves are no data and go.

Vectors are never gathered: a page adds a hash of (page, count) to two sums per token, and
equal sums stand for equal vectors, so a host with a third of all pages combines in every
task and no group is collected.  A host's template is as small as one page.

Pages are counted as different pages: copies of one HTML text on a host are one page, or
an article that fills nine tenths of a host's rows would be taken for its template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.skew import skew_join
from shelfcast.session import materialise

# A host needs so many different pages before texts can count as template.
LEAST_PAGES = 5
# A class is on this share of a host's pages at least, and has so many tokens.
SUPPORT = 0.9
LEAST_TOKENS = 4
# Templates of so many hosts are broadcast; beyond that they are joined by shuffle.
BROADCAST_HOSTS = 20_000
# Hashes of pages found more than once are broadcast up to this count; beyond it they are joined by shuffle.
BROADCAST_COPIES = 500_000
# Tokens a task holds before it passes its sums on; a bound on memory only.
HELD = 100_000

# Element names of the HTML standard by their role here.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary table tbody td template tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
CLOSE_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
SELF_CLOSING_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
DROPPED = frozenset(
    "nav header footer aside form script style noscript template button select textarea iframe object embed svg math canvas audio video "
    "dialog menu search head title input label fieldset noembed noframes xmp".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Classes and ids that name such a part of a page, as whole tokens.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside widget footer header masthead share sharing social related recommended recommendations comment comments disqus "
    "discussion replies reply respond pagination pager toolbar skip".split()
) | frozenset(
    # Known compounds.  Others that hold such a word (has-comments, no-sidebar) tell of a layout or state.
    "ad-banner ad-block ad-box ad-container ad-slot ad-unit ad-wrapper ads-container banner-ad google-ad cookie-banner cookie-bar "
    "cookie-consent cookie-message cookie-notice cookie-popup consent-banner gdpr-banner gdpr-notice privacy-notice share-bar share-box "
    "share-buttons share-links sharing-buttons social-bar social-buttons social-icons social-links social-media social-share "
    "related-articles related-content related-links related-posts related-stories recommended-articles recommended-posts comment-body "
    "comment-form comment-list comment-respond comment-section comments-area comments-list comments-section disqus-thread reply-form "
    "newsletter-box newsletter-form newsletter-signup signup-box signup-form subscribe-box subscribe-form site-footer site-header "
    "site-nav site-navigation page-footer global-footer global-header global-nav main-menu main-nav main-navigation nav-bar nav-links "
    "nav-menu post-navigation posts-navigation side-bar side-nav sidebar-widget sub-menu top-nav widget-area breadcrumb-nav skip-link "
    "skip-links skip-nav modal-dialog popup-overlay promo-banner promo-box sponsored-content sponsored-links".split()
)
# Elements that can span an article; others are parts of a text.
SLOTS = frozenset("html body main article section div center td".split())
# Paths are spelt out for so many nested block elements; deeper ones bear a hash of what they lie in, so that a path
# stays short.  They are told apart all the same, but none of them is taken for the article.
DEEP = 64
LONG_MARK = 200
# Elements that no class or id makes a part to drop.
KEPT = frozenset("html body main article".split())

_MARKUP = r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
_QUOTED = r"<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
_PLAIN = r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
_NEVER = r"(?!)()()()"
_TOKEN = re.compile(rf"{_MARKUP}|{_QUOTED}|{_PLAIN}|[^<]+|<", re.S)
# After a tag whose quotes never close, quotes count no more: each such tag would be read to the end of the page.
_UNQUOTED = re.compile(rf"{_MARKUP}|{_NEVER}|{_PLAIN}|[^<]+|<", re.S)
# Behind the last > of a page nothing is a tag.
_REST = re.compile(rf"{_MARKUP}|{_NEVER}|{_NEVER}|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_LAST = re.compile("/([^/.]*)[^/]*$")
# Between the words of a class, and the number at its end (ad-2, comment_17).
_JOINT = re.compile("[-_]+")
_NUMBER = re.compile("[-_]*[0-9]+$")


def host_of(url: str | None) -> str:
    """Host of a URL in lower case; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _named(attributes: str) -> tuple[str, bool, bool, bool]:
    """Mark for the path, whether the element is one to drop by its role, or by its names, whether it says it is the main part."""
    if "=" not in attributes:
        return "", False, False, False
    found = {k.lower(): entities.unescape(a or b or c or "").lower() for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    names = f"{found.get('class', '')} {found.get('id', '')}"
    role = found.get("role", "")
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    named = any(_JOINT.sub("-", _NUMBER.sub("", n)).strip("-") in DROPPED_NAMES for n in names.split())
    mark = "." + ".".join(sorted(found.get("class", "").replace("/", "|").split())) if found.get("class") else ""
    if len(mark) > LONG_MARK:
        mark = f".~{_hash(mark):x}"
    return mark, role in DROPPED_ROLES or hidden, named, role == "main"


class _Element:
    """An open element: its path, what it lies in, and whether it is dropped as an element or by its names."""

    __slots__ = ("above", "barred", "base", "depth", "dropped", "name", "named", "path")

    def __init__(self, name: str, step: str, above: _Element | None, barred: bool, named: bool):
        self.name, self.above, self.named = name, above, named
        self.depth = above.depth + 1 if above is not None else 1
        if self.depth <= DEEP:
            self.base = self.path = f"{above.path if above is not None else ''}/{step}"
        else:
            self.base = above.base
            self.path = f"{self.base}/~{_hash(above.path):x}/{step}"
        self.barred = barred or (above is not None and above.barred)
        self.dropped = self.barred or named or (above is not None and above.dropped)

    def around(self) -> Iterator[_Element]:
        e = self
        while e is not None:
            yield e
            e = e.above


def _spare(elements: list[_Element], found: list[tuple[_Element | None, str, list[str]]]) -> None:
    """Lift the names of what the article lies in.

    That is what the first main element lies in, and the article with the most text if it
    has more than all that the names leave.
    """
    spared = next((list(e.around()) for e in elements if e.path.endswith("/main") or "/main." in e.path[e.path.rfind("/") :]), [])
    if not any(e.named and not e.barred for e in spared):
        held = Counter()
        for e, text, _ in found:
            if e is not None and e.dropped and not e.barred:
                held.update({a: len(text) for a in e.around() if a.name == "article"})
        best = max(held, key=held.__getitem__, default=None)
        left = sum(len(text) for e, text, _ in found if e is None or not e.dropped)
        if best is not None and held[best] > left:
            spared = list(best.around())
    if any(e.named for e in spared):
        for e in spared:
            e.named = False
        for e in elements:  # outer ones come first
            e.dropped = e.barred or e.named or (e.above is not None and e.above.dropped)


def blocks(page: str | None) -> Iterator[tuple[str, bool, str, list[str]]]:
    """The blocks of a page in order: path, whether it lies in a part to drop, text, tags opened before it.

    Paths name block elements only, with their classes.  Unclosed elements end where the
    standard ends them; comments, scripts and styles give nothing.  A part that isn't closed
    by the end of the page ends there.  The html, body, main and article elements, and what
    the article lies in, are no parts to drop whatever their classes and ids.
    """
    stack: list[_Element] = []
    elements: list[_Element] = []
    found: list[tuple[_Element | None, str, list[str]]] = []
    text: list[str] = []
    opened: list[str] = []

    def flush():
        words = entities.unescape("".join(text)).split()
        text.clear()
        if words or opened:
            found.append((stack[-1] if stack else None, " ".join(words), list(opened)))
            opened.clear()

    names: Counter = Counter()  # of the open elements: what isn't open is not looked for

    def close(first: int) -> None:
        names.subtract(e.name for e in stack[first:])
        del stack[first:]

    page = page or ""
    at, end, last, token = 0, len(page), page.rfind(">"), _TOKEN
    while at < end:
        m = (token if at <= last else _REST).match(page, at)
        at = m.end()
        name = m.group(2) or m.group(5)
        if m.group(5):
            token = _UNQUOTED
        if name is None:
            if m.group()[0] != "<" or m.group() == "<":
                text.append(m.group())
            continue
        name = name.lower()
        closing = m.group(1) or m.group(4)
        if not closing and name in RAW:
            # Raw text runs to its end tag, whatever stands inside.
            stop = re.compile(f"</{re.escape(name)}[^>]*>", re.I).search(page, at) if at <= last else None
            at = stop.end() if stop else end
            continue
        if name not in BLOCKS and name not in DROPPED:
            if name == "br":
                text.append(" ")
            continue
        flush()
        if closing:
            if names[name] > 0:
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name))
            continue
        if name in VOID:
            continue
        if name in CLOSE_P and names["p"] > 0:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name == "p":
                    close(i)
                    break
                if stack[i].name in ("td", "th", "li", "div", "article", "section", "body"):
                    break
        if name in SELF_CLOSING_SIBLINGS and any(names[n] > 0 for n in SELF_CLOSING_SIBLINGS[name]):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i].name in SELF_CLOSING_SIBLINGS[name]:
                    close(i)
                    break
                if stack[i].name in ("ul", "ol", "dl", "table", "select", "menu", "tr" if name in ("td", "th") else "tbody"):
                    break
        mark, drop, named, main = _named(m.group(3) or m.group(6) or "")
        above = stack[-1] if stack else None
        step = f"{'main' if main else name}{mark}"
        stack.append(_Element(name, step, above, drop or name in DROPPED, named and not main and name not in KEPT))
        names[name] += 1
        elements.append(stack[-1])
        opened.append(stack[-1].path)
        if (m.group(3) or m.group(6) or "").endswith("/") and name not in BLOCKS:
            close(len(stack) - 1)
    flush()
    if any(e.named and not e.barred for e in elements):
        _spare(elements, found)
    for e, said, tags in found:
        yield (e.path, e.dropped, said, tags) if e is not None else ("", False, said, tags)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def said_hash(path: str, text: str) -> int:
    """A text with its path as a signed 64-bit number."""
    x = _hash(f"{path} {text}")
    return x - (1 << 64) if x >= 1 << 63 else x


def _around(path: str) -> list[str]:
    """A path and the paths it lies in, outer ones first."""
    parts = path.split("/")
    return ["/".join(parts[:i]) for i in range(2, len(parts) + 1)]


def spanning(tags: dict[str, tuple[int, bool]], texts: list[tuple[int, int]], pages: int) -> str | None:
    """The path of the element that spans the article of a host.

    ``tags`` has for each path on nearly all pages the characters under it and whether it is
    in a class; ``texts`` the path's hash and the characters of each text of the template.
    """
    last = {p: _LAST.search(p).group(1) for p in tags}
    named = sorted((p for p in tags if last[p] in ("article", "main")), key=lambda p: (last[p] != "article", len(p), p))
    if pages < LEAST_PAGES:
        return named[0] if named else None
    varying = {p: n for p, (n, _) in tags.items()}
    places = {said_hash(p, ""): p for p in tags}
    for at, n in texts:
        for p in _around(places.get(at, "")):
            if p in varying:
                varying[p] -= n
    # Each class element's parent is the longest path around it; a slot is what its children leave.
    nodes = {p for p, (_, valid) in tags.items() if (valid and last[p] in SLOTS) or p in named}
    parents = {p: next((q for q in reversed(_around(p)[:-1]) if q in nodes), None) for p in nodes}
    slots = {p: varying[p] for p in nodes}
    for p, q in parents.items():
        if q is not None:
            slots[q] -= varying[p]
    best = min(nodes, key=lambda p: (-slots[p], last[p] != "article", last[p] != "main", -len(p), p), default=None)
    if best is None or slots[best] <= 0:
        return named[0] if named else None
    # Names decide between elements of about as much text: an article has its title and notes, too.
    for p in sorted(named, key=lambda p: (last[p] != "article", -varying[p], p)):
        spans = best == p or best.startswith(p + "/")
        if last[p] == "article" and (slots[best] if spans else varying[p]) * 2 >= (varying[p] if spans else slots[best]):
            return p
        if last[p] == "main" and spans and slots[best] * 10 >= varying[p] * 9:
            return p
    # A title beside the text belongs to it.
    up = parents[best]
    while up is not None:
        titles = [p for p in tags if last[p] == "h1" and p.startswith(up + "/") and not p.startswith(best + "/")]
        if varying[up] - varying[best] != sum(varying[p] for p in titles):
            break
        if titles:
            best = up
            break
        up = parents[up]
    return best


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host its article and the template's texts, from its tokens on nearly all pages."""
    for batch in batches:
        hosts, pages, tokens = (batch.column(i).to_pylist() for i in range(3))
        articles, texts = [], []
        for n, found in zip(pages, tokens, strict=True):
            said = [t for t in found if t["said"] is not None] if n >= LEAST_PAGES else []
            tags = {t["path"]: (t["chars"], t["valid"]) for t in found if t["path"] is not None}
            articles.append(spanning(tags, [(t["at"], t["chars"]) for t in said], n))
            texts.append([t["said"] for t in said] or None)
        yield pa.record_batch(
            [pa.array(hosts, pa.string()), pa.array(articles, pa.string()), pa.array(texts, pa.list_(pa.int64()))], names=["host", "article", "texts"]
        )


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host and token (a tag's path or a text's hash): pages with it, two sums that stand for its vector, characters
    (of the text, or of all undropped text under the path) over all pages, and a hash of the token's path."""
    sums: dict[tuple, list[int]] = {}

    def out() -> pa.RecordBatch:
        keys, values = list(sums), list(sums.values())
        sums.clear()
        return pa.record_batch(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.string()),
                pa.array([k[2] for k in keys], pa.int64()),
                *[pa.array([v[i] for v in values], pa.int64()) for i in range(5)],
            ],
            names=["host", "path", "said", "pages", "v1", "v2", "chars", "at"],
        )

    for batch in batches:
        for host, page, key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts, chars, places = Counter(), Counter(), {}
            for path, dropped, text, opened in blocks(page):
                counts.update((p, None) for p in opened)
                if not dropped and text:
                    token = (None, said_hash(path, text))
                    counts[token] += 1
                    chars[token] += len(text)
                    places[token] = path
                    chars.update(dict.fromkeys(((p, None) for p in _around(path)), len(text)))
            counts[("", None)] = 1  # stands for the page itself
            for token, n in counts.items():
                v = _hash(f"{key} {n}")
                s = sums.get((host, *token))
                if s is None:
                    s = sums[(host, *token)] = [0, 0, 0, 0, said_hash(places.get(token, token[0]), "")]
                s[0] += 1
                s[1] += v >> 32
                s[2] += v & 0xFFFFFFFF
                s[3] += chars[token]
            if len(sums) >= HELD:
                yield out()
    yield out()


@F.arrow_udf(T.StringType())
def _host(urls: pa.Array) -> pa.Array:
    return pa.array([host_of(u) for u in urls.to_pylist()], pa.string())


def different_pages(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """``host``, ``html`` and ``key`` (a hash of the HTML): one row for all copies of a page on a host.

    Only hashes of all pages are shuffled, and the HTML of pages that have copies; those
    combine before they move.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        _host(F.col(url)).alias("host"), body.alias("html"), F.xxhash64(body).alias("key"), F.xxhash64(F.lit(1), body).alias("key2")
    )
    same = ["host", "key", "key2"]
    copies = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*same, F.lit(True).alias("_copied"))
    copies = materialise(copies, "copies")
    n = copies.count()
    if n == 0:
        return rows.select("host", "html", "key")
    # A broadcast moves no HTML; copies of a hot host differ by hash, so they don't meet in one task.
    marked = rows.join(F.broadcast(copies) if n <= BROADCAST_COPIES else copies, same, "left")
    alone = marked.where("_copied IS NULL").select("host", "html", "key")
    return alone.unionByName(marked.where("_copied").dropDuplicates(same).select("host", "html", "key"))


def templates(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Per host ``pages`` (different ones), ``article`` (path of the element that spans the article, null if there is none) and
    ``texts`` (hashes of the template's texts with their paths).

    A class needs ``LEAST_TOKENS`` tokens and ``SUPPORT`` of the host's pages; of hosts with
    fewer than ``LEAST_PAGES`` pages only the named elements count.
    """
    rows = different_pages(pages, url=url, html=html)
    kinds = "host string, path string, said long, pages long, v1 long, v2 long, chars long, at long"
    sums = [F.sum(c).alias(c) for c in ("pages", "v1", "v2", "chars")]
    tokens = rows.mapInArrow(_vectors, kinds).groupBy("host", "path", "said").agg(*sums, F.max("at").alias("at"))
    tokens = materialise(tokens, "tokens")
    hosts = tokens.where("path = ''").select("host", F.col("pages").alias("all"))
    # What is on nearly all pages of a host: as much as one page has, whatever the host's size.
    # A host with a third of the pages has a large share of the tokens: hot hosts are spread.
    own = tokens.where("path IS NULL OR path <> ''")
    common = skew_join(own, hosts, ["host"], spread=["said", "path"]).where(F.col("pages") >= F.col("all") * SUPPORT)
    classes = common.groupBy("host", "v1", "v2", "pages").agg(F.count(F.lit(1)).alias("_size")).where(F.col("_size") >= LEAST_TOKENS)
    classes = classes.select("host", "v1", "v2", "pages", F.lit(True).alias("_valid"))
    marked = common.join(classes, ["host", "v1", "v2", "pages"], "left").withColumn("valid", F.col("_valid").isNotNull())
    # A host's tokens on nearly all pages are as many as one page has: they are nested together.
    kept = marked.where("path IS NOT NULL OR valid").groupBy("host").agg(
        F.max("all").alias("all"), F.collect_list(F.struct("path", "said", "chars", "at", "valid")).alias("tokens")
    )
    found = kept.select("host", "all", "tokens").mapInArrow(_nested, "host string, article string, texts array<long>")
    return hosts.select("host", F.col("all").alias("pages")).join(found, "host", "left")


_ARTICLE = re.compile(r"/(?:article|main)(?=[./]|$)")


def main_text(page: str | None, article: str | None, texts: frozenset[int] | set[int]) -> str:
    """The slots of a page inside the template's article, joined by one space.

    A page without the template's article uses its own article or main element, and one
    without either everything outside the parts to drop.
    """
    found = [(path, text) for path, dropped, text, _ in blocks(page) if text and not dropped]
    for inside in (
        lambda p: article is not None and (p == article or p.startswith(article + "/")),
        lambda p: _ARTICLE.search(p) is not None,
        lambda p: True,
    ):
        chosen = [(p, t) for p, t in found if inside(p)]
        if chosen:
            break
    if texts:
        chosen = [(p, t) for p, t in chosen if said_hash(p, t) not in texts]
    return " ".join(t for _, t in chosen)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, urls, pages, articles, said = (batch.column(i).to_pylist() for i in range(5))
        texts = [main_text(page, article, frozenset(s or ())) for page, article, s in zip(pages, articles, said, strict=True)]
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``id_col`` (long), ``url`` and ``text`` for each row of ``pages``.

    A null or empty page has an empty text; pages of null or unreadable URLs share the empty
    host.  Repeated rows and ids each get their text; other columns are left behind.
    """
    found = materialise(templates(pages, url=url, html=html).select("host", "article", "texts"), "templates")
    few = found.count() <= BROADCAST_HOSTS
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), _host(F.col(url)).alias("host")
    )
    joined = rows.join(F.broadcast(found) if few else found, "host", "left").select("id", "url", "html", "article", "texts")
    texts = joined.mapInArrow(_texts, "id long, url string, text string")
    return texts.select(F.col("id").alias(id_col), F.col("url").alias("url"), "text")
