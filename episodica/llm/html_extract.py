"""HTML extraction by template deduction over the pages of a host.

A page is read as tokens: each tag, and each run of text, under its path of open elements. A token's occurrence vector
counts it on every page of its host; it is kept as a sum of page hashes times counts, so vectors merge on the map side
and are never collected. Tokens of a host with equal vectors form an equivalence class. A class is valid when it has
enough tokens, is found on enough of the host's pages, and keeps the same number on each page that has it. A second look
at the pages keeps the classes that nest: their tokens come in one order, and each lies in one slot of the class around
it. The class found once on all pages is the root of the template, and the others lie in its slots. The root cuts
every page in slots, one behind each of its tokens. The same look sums the text of each slot over the host's pages;
elements, headings and links only weigh it (``WEIGHTS``). The slots that hold a share of the heaviest one's weight are
the content of the host; text of the root is its frame on every page. But an article may hold text that all pages share:
root text is kept where it stands in the page's article, or, on a page without one, in a block that also holds blocks of
content (and is not the body), unless it is a link.

Inside a kept slot, elements that are menus, notices, forms, comments and the like are left out, and an article or main
element, where the page has one, bounds what is kept; a class in a slot of an article is content, elsewhere it is frame.
A host without a template, and a page whose kept slots are empty, are read by their elements alone.

Defined cases: null html is empty and gives empty text; null urls and such without a host have no template; tags left open end where their parent does; a host of few pages
has no template; equal pages of a host are one page to its template, and are extracted each; very long pages are read
whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, urls

#: A host needs so many pages for a template, and a class so many tokens and such a share of the host's pages.
MIN_PAGES = 4
MIN_TOKENS = 2
MIN_SHARE = 0.3
#: Weight of a character of text: in a frame element, a link, a heading, an article or main element, elsewhere.
WEIGHTS = {"frame": 0.05, "link": 0.1, "heading": 4.0, "article": 4.0, "text": 1.0}
#: Share of the heaviest slot's weight from which a slot is content.
SLOT_SHARE = 0.05
#: Numbers of tokens up to which all templates may be broadcast.
BROADCAST_TOKENS = 2_000_000
#: Share of the pages of a class on which its order and its slots must be the same.
AGREE = 0.9
#: The shape of a class that is out of order, and of two that cross.
BROKEN = -(1 << 62)

_MARKUP = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|"
    r"</?[a-zA-Z][^\s/>]*(?:(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?:>|$)|[^>]*+(?:>|$))",
    re.S,
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
#: A tag that ends itself; a slash behind a value without quotes is that value's.
_CLOSED = re.compile(r"(?:<[^\s/>]+|[\s\"'])/>$")
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block.
_BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is not the article's.
_FRAME = set(
    "script style noscript template head title nav aside footer form button select option textarea input label iframe "
    "object embed canvas svg math dialog menu noembed noframes xmp audio video map".split()
)
#: Words of a class, id or role whose element is not the article's; of an article element only the second kind counts.
_FRAME_WORDS = re.compile(
    r"(?:^|[_-])(?:ads?|adverts?|advertisements?|advertising|banners?|cookies?|consent|notices?|gdpr|popup|modal|side-?bar|"
    r"menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|footer|masthead|respond|share|sharing|social|subscribe|"
    r"newsletter|signup|login|search|skip-?link|toolbar|widgets?|contentinfo|complementary|alert)(?:$|[_-])",
    re.I,
)
_ASIDE_WORDS = re.compile(r"(?:^|[_-])(?:comments?|disqus|reply|replies|related|recommended|sponsor(?:ed)?|promo(?:tion)?s?|ad|advert)(?:$|[_-])", re.I)
#: Names that say what else a layout holds.
_LAYOUT = re.compile(r"^(?:no|has|with|without|is|js)[_-]|[_-](?:with|without|no|has)[_-]", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=>/])|\sstyle\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
#: Elements that close an open element of the same kind before them.
_SIBLING = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"},
}
_HOLDS = {"ul", "ol", "dl", "table", "select", "menu"}


def _is_frame(kind: str, marks: str) -> bool:
    if not marks or kind in ("html", "body", "main"):
        return False
    for mark in marks.split():
        if not _LAYOUT.search(mark) and (_ASIDE_WORDS.search(mark) or kind != "article" and _FRAME_WORDS.search(mark)):
            return True
    return False


@functools.lru_cache(1 << 14)
def _tag(tag: str) -> tuple[str, bool, str, bool, bool] | None:
    """Name, whether it closes, label in a path, whether its element is frame, whether it holds nothing; None if no tag."""
    name = _NAME.match(tag)
    if not name:
        return None
    kind = name.group(1).lower()
    if tag[1] == "/":
        return kind, True, "", False, False
    marks = " ".join(v for _, a, b, c in _ATTRIBUTE.findall(tag[name.end() :]) for v in (a, b, c) if v)
    own = kind in _FRAME or _is_frame(kind, marks) or (kind not in ("html", "body") and bool(_HIDDEN.search(tag)))
    return kind, False, "/" + kind + ("." + marks if marks else ""), own, kind in _VOID or bool(_CLOSED.search(tag))


Run = tuple[str, str, bool, bool, bool, int, int]


def parse(page: str) -> list[Run]:
    """The text runs of a page: (path, text, in frame, in article, starts a block, block, block around it), and tags as
    runs without text.

    The path joins the open elements and their class or id; a run of text keeps its white space and references. Blocks
    are numbered by page; the body is none (0).
    """
    out: list[Run] = []
    stack: list[tuple[str, str, bool, bool, int, int]] = []  # name, path, in frame, in article, block, block around
    path, framed, article, fresh, block, around, blocks = "", False, False, True, 0, 0, 0
    at, n = 0, len(page)

    def reopen() -> None:
        nonlocal path, framed, article, block, around
        _, path, framed, article, block, around = stack[-1] if stack else ("", "", False, False, 0, 0)

    while at < n:
        m = _MARKUP.search(page, at)
        end = m.start() if m else n
        if end > at:
            out.append((path, page[at:end], framed, article, fresh, block, around))
            fresh = False
        if not m:
            break
        at = m.end()
        tag = m.group()
        found = _tag(tag)
        if not found:
            continue
        kind, closes, label, own, holds_nothing = found
        if kind in _BLOCK:
            fresh = True
        if closes:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == kind:
                    del stack[k:]
                    reopen()
                    break
            continue
        if kind in _BLOCK and stack and stack[-1][0] != kind or kind == "p":  # a block ends an open paragraph
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    reopen()
                    break
                if stack[k][0] in _BLOCK:
                    break
        if kind in _SIBLING:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in _SIBLING[kind]:
                    del stack[k:]
                    reopen()
                    break
                if stack[k][0] in _HOLDS:
                    break
        out.append((path + label, "", framed, article, False, block, around))
        if kind == "br":
            out.append((path, " ", framed, article, fresh, block, around))
        if holds_nothing:
            continue
        own |= kind == "header" and not article
        path, framed, article = path + label, framed or own, (article or kind in ("article", "main")) and not own
        if kind in _BLOCK and kind not in ("html", "body"):
            blocks += 1
            block, around = blocks, block
        stack.append((kind, path, framed, article, block, around))
        if kind in _RAW:
            close = re.compile(rf"</{re.escape(kind)}(?=[\s/>])", re.I).search(page, at)
            stop = close.start() if close else n
            if stop > at:
                out.append((path, page[at:stop], framed, article, fresh, block, around))
            at = stop
    return out


def token_hash(path: str, text: str) -> int:
    """A signed 64-bit name of a token: its path, and its text without outer and repeated white space."""
    h = xxhash.xxh3_64_intdigest(path + "\0" + _SPACE.sub(" ", text).strip())
    return h - (1 << 64) if h >> 63 else h


def tokens_of(page: str) -> Counter[int]:
    return Counter(token_hash(path, text) for path, text, *_ in parse(page) if not text or not text.isspace())


def occurrence_vectors(pages: DataFrame) -> DataFrame:
    """host, token, its pages, its least and most occurrences on one, and its vector as a hash; from page_id, host, html."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # what a batch has is summed before it leaves the worker
            sums: dict[tuple[str, int], list[int]] = {}
            for host, page in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = xxhash.xxh3_64_intdigest(page or "")  # ids may be null or repeat
                for token, n in tokens_of(page or "").items():
                    s = sums.setdefault((host, token), [0, n, n, 0])
                    s[0] += 1
                    s[1], s[2] = min(s[1], n), max(s[2], n)
                    s[3] = (s[3] + own * n) & (1 << 64) - 1
            rows = [(h, t, a, b, c, v - (1 << 64) if v >> 63 else v) for (h, t), (a, b, c, v) in sums.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = (pa.string(), *[pa.int64()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["host", "token", "pages", "least", "most", "vector"])

    parts = pages.mapInArrow(count, "host string, token long, pages long, least long, most long, vector long")
    # vectors are sums modulo 2^64; summed here as wide decimals, whose remainder is the same
    wide = F.sum(F.col("vector").cast("decimal(20,0)"))
    return parts.groupBy("host", "token").agg(
        F.sum("pages").alias("pages"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.pmod(wide, F.lit("18446744073709551616").cast("decimal(20,0)")).alias("vector"),
    )


def once(pages: DataFrame) -> DataFrame:
    """page_id, host, html: each page of a host once, however often it is copied there.

    Only pages that have copies are shuffled.
    """
    keyed = pages.select("page_id", "host", "html", F.xxhash64("html").alias("copy"))
    copies = keyed.groupBy("host", "copy").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = common.materialize(copies.select(F.col("host").alias("copy_host"), F.col("copy").alias("copied")), "html-copies")
    known = common.maybe_broadcast(copies, copies.count(), 500_000)
    match = (F.col("copy") == F.col("copied")) & F.col("host").eqNullSafe(F.col("copy_host"))
    repeated = keyed.join(known, match, "left_semi").dropDuplicates(["host", "copy"])
    return keyed.join(known, match, "left_anti").unionByName(repeated).drop("copy")


def classes_of(pages: DataFrame) -> DataFrame:
    """host and its equivalence classes, one row a host: structs (o, tokens, root), those of most pages first.

    A page holds each token of a class that covers a share of the host's pages, so a host has few such tokens whatever
    the number of its pages.
    """
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages")).where(F.col("host_pages") >= MIN_PAGES)
    vectors = occurrence_vectors(pages).where((F.col("least") == F.col("most")) & (F.col("pages") >= MIN_PAGES))
    common_tokens = vectors.join(sizes, "host").where(F.col("pages") >= MIN_SHARE * F.col("host_pages"))
    root = (F.col("pages") == F.col("host_pages")) & (F.col("least") == 1)
    classes = common_tokens.groupBy("host", "vector", "pages", root.alias("root"), "least").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    valid = classes.where(F.size("tokens") >= MIN_TOKENS)
    order = F.struct((-F.col("pages")).alias("o"), F.col("least").alias("n"), "tokens", "root")
    return valid.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("classes"))


def shapes(page: str, places: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """How the classes lie on a page, as (a, b, shape), from the class and member of each token.

    For a class with itself the shape names the order of its tokens; for a class and the one right around it, the lesser
    first, it is the slot of the one around (negative if that is the second). A broken order, a crossing and more than
    one slot are ``BROKEN``. There are as many as the page has classes and occurrences of them, not as pairs of these.
    """
    yield from _shapes([token_hash(path, text) if not text or not text.isspace() else None for path, text, *_ in parse(page)], places)


def _shapes(tokens: list[int | None], places: dict[int, tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    seen = [place for token in tokens if (place := places.get(token))]
    members: dict[int, list[int]] = {}
    for a, k in seen:
        members.setdefault(a, []).append(k)
    last: dict[int, int] = {}  # of the classes in order: the member that ends them
    first: dict[int, int] = {}
    for a, member in members.items():
        m = len(set(member))
        if len(member) % m or member != member[:m] * (len(member) // m):
            yield a, a, BROKEN
        else:
            yield a, a, xxhash.xxh3_64_intdigest(repr(member[:m])) >> 2
            first[a], last[a] = member[0], member[m - 1]

    lies: dict[int, set[tuple[int, int]]] = {}  # the class around, and its slot
    crossed: set[tuple[int, int]] = set()
    open_ones: list[list[int]] = []  # class and members seen
    is_open: set[int] = set()
    for a, k in seen:
        if a not in first:
            continue
        if k == first[a]:
            if open_ones:
                lies.setdefault(a, set()).add((open_ones[-1][0], open_ones[-1][1]))
            open_ones.append([a, 0])
            is_open.add(a)
        elif a not in is_open:  # it was crossed
            continue
        while open_ones[-1][0] != a:
            other = open_ones.pop()[0]
            is_open.discard(other)
            crossed.add((min(a, other), max(a, other)))
        open_ones[-1][1] += 1
        if k == last[a]:
            open_ones.pop()
            is_open.discard(a)
    for b, found in lies.items():
        for a, slot in found:
            pair = (min(a, b), max(a, b))
            if len(found) > 1:
                crossed.add(pair)
            elif pair not in crossed:
                yield *pair, slot if a < b else -slot
    for pair in crossed:
        yield *pair, BROKEN


_LINK = re.compile(r"/a(?:[./]|$)")
_HEADING = re.compile(r"/h[12](?:[./]|$)")


def slot_texts(runs: list[Run], tokens: list[int | None], root: set[int]) -> dict[int, list[float]]:
    """For the slot behind each token of the root (0: before the first): weight, characters, and those in an article."""
    out: dict[int, list[float]] = {}
    slot = 0
    for (path, text, framed, article, *_), token in zip(runs, tokens, strict=True):
        if token in root:
            slot = token
        elif text and token is not None:
            if framed:
                kind = "frame"
            elif _LINK.search(path):
                kind = "link"
            else:
                kind = "heading" if _HEADING.search(path) else "article" if article else "text"
            n = len(text.strip())
            sums = out.setdefault(slot, [0.0, 0.0, 0.0])
            sums[0] += WEIGHTS[kind] * n
            sums[1] += n
            sums[2] += n * article
    return out


def chosen_slots(slots: dict[int, list[float]]) -> list[int]:
    """The slots that are content: those of a share of the heaviest one's weight, and, if that is an article, all of it."""
    if not slots:
        return []
    best = max(slots.values())
    in_article = lambda s: s[2] > 0.5 * s[1]
    return sorted(t for t, s in slots.items() if s[0] >= SLOT_SHARE * best[0] or in_article(best) and in_article(s))


def nested(classes: DataFrame, pages: DataFrame) -> DataFrame:
    """host and its template: tokens of the root (``root``), its slots that are content (``kept``, by the token before),
    and tokens of the classes in its slots (``inner``).

    A class stays if its tokens keep one order, and it keeps one slot of each class that it is found right in, on ``AGREE``
    of the pages.
    """
    kinds = "host string, a int, b int, shape long, n long, weight double, chars double, article double"
    names = [x.split()[0] for x in kinds.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[tuple[str, int, int, int]] = Counter()
            slots: dict[tuple[str, int], list[float]] = {}
            known: dict[str, tuple[dict[int, tuple[int, int]], set[int]]] = {}
            for i, (host, page) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if host not in known:
                    own = batch.column(2)[i].as_py()
                    known[host] = {t: (a, k) for a, c in enumerate(own) for k, t in enumerate(c["tokens"])}, {t for c in own if c["root"] for t in c["tokens"]}
                places, root = known[host]
                runs = parse(page or "")
                tokens = [token_hash(path, text) if not text or not text.isspace() else None for path, text, *_ in runs]
                seen.update((host, *x) for x in _shapes(tokens, places))
                for slot, found in slot_texts(runs, tokens, root).items():
                    sums = slots.setdefault((host, slot), [0.0, 0.0, 0.0])
                    for k, x in enumerate(found):
                        sums[k] += x
            rows = [(*k, n, 0.0, 0.0, 0.0) for k, n in seen.items()] + [(h, -1, -1, t, 1, *x) for (h, t), x in slots.items()]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, list[int], list[int], list[int]]] = []
            for row in batch.to_pylist():
                agreed = {(x["a"], x["b"]): x["agreed"] for x in row["looks"]}
                kept: list[int] = []
                for b in range(len(row["classes"])):
                    if agreed.get((b, b)) and all(agreed.get((a, b), True) for a in kept):  # most never lie right in each other
                        kept.append(b)
                root, inner = ([t for k in kept for t in row["classes"][k]["tokens"] if row["classes"][k]["root"] == root] for root in (True, False))
                slots = {x["shape"]: [x["weight"], x["chars"], x["article"]] for x in row["slots"]}
                out.append((row["host"], root, chosen_slots(slots) if root else [], inner))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            types = (pa.string(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["host", "root", "kept", "inner"])

    named = classes.withColumnRenamed("host", "class_host")
    tokens = named.agg(F.sum(F.aggregate("classes", F.lit(0), lambda s, c: s + F.size(c["tokens"])))).first()[0] or 0
    asked = pages.join(common.maybe_broadcast(named, tokens, BROADCAST_TOKENS), F.col("host") == F.col("class_host")).select("host", "html", "classes")
    sums = [F.sum(c).alias(c) for c in ("n", "weight", "chars", "article")]
    seen = common.materialize(asked.mapInArrow(look, kinds).groupBy("host", "a", "b", "shape").agg(*sums), "html-looks")
    most = F.max(F.struct("n", "shape"))
    agreed = (most["n"] >= AGREE * F.sum("n")) & (most["shape"] != BROKEN)
    looks = seen.where("a >= 0").groupBy("host", "a", "b").agg(agreed.alias("agreed"))
    looks = looks.groupBy("host").agg(F.collect_list(F.struct("a", "b", "agreed")).alias("looks"))  # at most as many as its pages have classes and occurrences of them
    slots = seen.where("a < 0").groupBy(F.col("host").alias("slot_host")).agg(F.collect_list(F.struct("shape", "weight", "chars", "article")).alias("slots"))  # as many as a page has
    both = looks.join(named, F.col("host") == F.col("class_host")).join(slots, F.col("host") == F.col("slot_host"), "left")
    both = both.select("host", "classes", "looks", F.coalesce("slots", F.array().cast("array<struct<shape:bigint,weight:double,chars:double,article:double>>")).alias("slots"))
    return both.mapInArrow(choose, "host string, root array<long>, kept array<long>, inner array<long>")


def templates(pages: DataFrame) -> DataFrame:
    """host, root, kept and inner: its template, one row a host. Copies of a page add no support."""
    distinct = once(pages)
    return nested(common.materialize(classes_of(distinct), "html-classes"), distinct)


def main_text(page: str, root: set[int], inner: set[int] | frozenset[int] = frozenset(), kept: set[int] | None = None) -> str:
    """The blocks of the slots that are kept (all, without ``kept``), joined by two line ends.

    The root's text, and that of a class in a slot, is content in an article, or beside content in a block; else frame.
    """
    runs = parse(page)
    found = _blocks(runs, root, inner, kept)
    if not found and root and kept is not None:  # the page does not follow the template
        found = _blocks(runs, root, inner, None) or _blocks(runs, set(), frozenset(), None)
    return "\n\n".join(found)


def _blocks(runs: list[Run], root: set[int], inner: set[int] | frozenset[int], kept: set[int] | None) -> list[str]:
    has_article = any(article and text and not text.isspace() for _, text, _, article, *_ in runs)
    parts: list[tuple[bool, str, bool, int, int]] = []  # starts a block, text, shared by pages, block, block around it
    broken, chosen = True, kept is None or 0 in kept
    for path, text, framed, article, fresh, block, around in runs:
        token = token_hash(path, text) if (root or inner) and (not text or not text.isspace()) else None
        of_root = token in root
        if of_root:
            chosen = kept is None or token in kept
        if not text:
            continue
        broken |= fresh
        shared = of_root or token in inner
        if framed or (has_article and not article) or not (chosen or of_root) or (shared and not has_article and _LINK.search(path)):
            continue
        parts.append((broken, text, shared and not has_article, block, around))
        broken = False
    # what pages share is content where the block around it holds content too
    own = {block for _, text, shared, block, _ in parts if not shared and not text.isspace()}
    beside = {around for _, text, shared, _, around in parts if not shared and not text.isspace()}
    blocks: list[list[str]] = []
    lost = False
    for starts, text, shared, block, around in parts:
        starts |= lost
        lost = shared and not (block and block in own or around and around in beside)
        if lost:
            lost = starts
            continue
        if starts or not blocks:
            blocks.append([])
        blocks[-1].append(text)
    whole = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks)
    return [b for b in whole if b]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``."""
    slim = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))
    slim = slim.withColumn("host", urls.host_of(F.col("url")))
    found = common.materialize(templates(slim.where("host <> ''").select("page_id", "host", "html")).withColumnRenamed("host", "template_host"), "html-templates")
    tokens = found.agg(F.sum(F.size("root") + F.size("kept") + F.size("inner"))).first()[0] or 0
    joined = slim.join(common.maybe_broadcast(found, tokens, BROADCAST_TOKENS), F.col("host") == F.col("template_host"), "left")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, known = batch.column(3).to_pylist(), {}
            texts = []
            for i, (page, host) in enumerate(zip(batch.column(2).to_pylist(), hosts, strict=True)):
                if host not in known:
                    root, kept, inner = (batch.column(c)[i].as_py() for c in (4, 5, 6))
                    known[host] = set(root or ()), set(inner or ()), set(kept) if root else None
                texts.append(main_text(page or "", *known[host]))
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], ["page_id", "url", "text", "n_chars"])

    own = slim.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "host", "root", "kept", "inner").mapInArrow(read, f"page_id {own}, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages"))
