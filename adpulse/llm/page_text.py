"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags.  Each word scores +1, each tag a
negative weight, and the main content is the contiguous run of tokens with the
highest sum, found in one scan.  The weights of the tags are learned from
labelled pages: pages whose own markup names the main content (an element
``article`` or ``main``, or a role saying so).  They begin as log-odds of
standing within the labelled region, counted over all labelled pages, and are then
corrected on a bounded sample of them, page by page, where the best region is not
the labelled one (tags that it wrongly holds lose weight, tags that it wrongly
leaves out regain it).  A tag that no labelled region holds tells little of what
pages unlike these use it for, so it begins no lower than a floor; only the tags
of whole parts of a page keep all that the counts say.

Elements that are never main text (menus, headers, footers, side bars, notices,
adverts, forms, scripts, comments) are left out: neither their words nor their
tags score.  They are told by element and role, and block-level ones also by a
class or id that is, ends in, or has before a word for a container, one of a list
of names; inline elements are never left out by name.  The rest of the region is
cut into blocks at block-level tags.  An element that holds the page's largest
content element is not left out whatever its name; on a page without one, neither
is a form, or an element so named, that holds most of the page's words.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adpulse.llm.runtime import keep, prepare

TRAIN_PAGES = 400         # labelled pages that the weights are corrected on; they are counted over all
ROUNDS = 12               # passes of corrections over them
MARGIN = 3.0              # weight of a word outside the labelled region while learning
UNKNOWN_BLOCK, UNKNOWN_INLINE = -0.5, -0.1   # opening tags that no labelled page has; their closing tags weigh nothing
FLOOR_BLOCK, FLOOR_INLINE = -1.0, -0.3       # where tags begin that no labelled region holds
LEAST = -0.02             # no tag weighs more than this

# --- fixed values: HTML element names, and names that pages give to parts ---------
RAW = ("script", "style", "template", "textarea", "title", "iframe")
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul caption".split())
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big button canvas cite code data datalist del dfn em font i ins kbd label map mark math meter nobr noscript object output picture "
    "progress q rp rt ruby s samp slot small span strike strong sub sup svg time tt u var video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LEFT_OUT = frozenset("nav header footer aside form menu button select option dialog head".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead "
    "footer sidebar aside widget cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended comment comments disqus reply replies respond form search pagination pager toolbar copyright disclaimer".split())
CONTAINERS = frozenset("list box bar area section wrapper container block widget links buttons form menu panel slot unit zone".split())   # words after a name
PARTS = frozenset("html head body main article nav header footer aside".split())      # elements that are parts of a page
CONTENT = frozenset(("article", "main"))
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},   # open elements that a tag ends
            "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "p": BLOCKS}
# --- end fixed values --------------------------------------------------------------

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*(?:>|\Z)",
    re.S | re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")


def _named(value: str) -> str:
    """The name of a part that never is main text which a class or id says, if it does."""
    for whole in value.split():
        words = _NAME.findall(whole)
        if words and words[-1] in LEFT_OUT_NAMES:
            return words[-1]
        if len(words) == 2 and words[0] in LEFT_OUT_NAMES and words[1] in CONTAINERS:
            return words[0]
    return ""


class Token:
    """A tag (``key`` names its weight) or a stretch of text (``key`` is None)."""

    __slots__ = ("key", "name", "close", "text", "words", "out")

    def __init__(self, key: str | None, name: str = "", close: bool = False, text: str = ""):
        self.key, self.name, self.close, self.text = key, name, close, text
        self.words = len(text.split())
        self.out = False          # within an element that is never main text


def tokens(page: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """The tokens of a page, and the token ranges inside elements marked as content."""
    found: list[Token] = []
    opened: list[tuple[str, int, bool, bool, bool]] = []     # (name, token, left out, only by name or as a form, content)
    outs, regions, plain, at = [], [], [], 0           # plain: content elements whose names don't tell of another part

    def text(end: int) -> None:
        if end > at:
            found.append(Token(None, text=entities.unescape(page[at:end])))

    def end(depth: int, last: int) -> None:
        """Ends the open elements from ``depth`` on before the token ``last``."""
        for _, start, out, named, content in opened[depth:]:
            if out:
                outs.append((start, last, named))
            if content:
                regions.append((start + 1, last))
                if not named:
                    plain.append((start, last))
        del opened[depth:]

    for m in _TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        if m["raw"]:
            found.append(Token(m["raw"].lower(), m["raw"].lower()))
            found[-1].out = True
            continue
        if not m["name"]:
            continue                                    # comment, doctype, or a broken tag
        name, close = m["name"].lower(), bool(m["close"])
        if close:
            found.append(Token("/" + name, name, True))
            depth = next((d for d in range(len(opened) - 1, -1, -1) if opened[d][0] == name), None)
            if depth is not None:
                end(depth + 1, len(found) - 1)          # those that were never closed
                if opened[depth][2]:
                    outs.append((opened[depth][1], len(found), opened[depth][3]))
                    opened[depth] = (*opened[depth][:2], False, *opened[depth][3:])
                end(depth, len(found) - 1)
            continue
        mark, role, hidden = "", "", False
        for a in _ATTR.finditer(m["attrs"] or ""):
            value = (a[2] or a[3] or a[4] or "").lower()
            kind = a[1].lower()
            if kind in ("class", "id"):
                mark = mark or (_named(value) if name in BLOCKS else "")
            elif kind == "role":
                role = value.strip()
            else:
                hidden |= value in ("", "true", "hidden")
        for d in range(len(opened) - 1, -1, -1):
            if name in ENDED_BY.get(opened[d][0], ()) or (opened[d][0] in ("td", "th") and name == "tr"):
                end(d, len(found))
            elif opened[d][0] in BLOCKS:
                break
        found.append(Token(name + ("." + mark if mark else ""), name))
        if name not in VOID:
            content = name in CONTENT or role in CONTENT
            always = name in LEFT_OUT - {"form"} or role in LEFT_OUT_ROLES - {"form", "search"} or hidden
            named = bool(mark) or name == "form" or role in ("form", "search")
            out = not content and name not in ("html", "body") and (always or named)
            opened.append((name, len(found) - 1, out, named and not always, content))
    text(len(page))
    end(0, len(found))                                  # never closed: they reach to the end
    if outs:
        upto = [0]
        for t in found:
            upto.append(upto[-1] + t.words)
        words = lambda a, b: upto[b] - upto[a]
        main = max(plain, key=lambda r: (words(*r), -r[0]), default=None)
        main = main if main and words(*main) else None
        for a, b, named in outs:
            if a < main[0] and main[1] <= b if main else named and 2 * words(a, b) > upto[-1]:
                continue
            for t in found[a:b]:
                t.out = True
    return found, regions


def _weight(token: Token, weights: dict[str, float]) -> float:
    got = weights.get(token.key)
    if got is None:
        got = weights.get(("/" if token.close else "") + token.name)
    if got is None:
        got = 0.0 if token.close else UNKNOWN_BLOCK if token.name in BLOCKS else UNKNOWN_INLINE
    return got


def best_region(found: list[Token], scores: list[float]) -> tuple[int, int]:
    """The contiguous range with the highest sum, the first and shortest of equals; (0, 0) if none is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def _scores(found: list[Token], weights: dict[str, float]) -> list[float]:
    """What is left out neither adds to a region nor parts it."""
    return [0.0 if t.out else float(t.words) if t.key is None else _weight(t, weights) for t in found]


def label(page: str) -> tuple[list[Token], tuple[int, int]] | None:
    """Tokens and content region of a page whose markup names one; None if it doesn't."""
    found, regions = tokens(page)
    regions = [(a, b) for a, b in regions if any(t.words for t in found[a:b])]
    if not regions:
        return None
    return found, max(regions, key=lambda r: (sum(t.words for t in found[r[0]: r[1]]), -r[0]))


def _known(key: str) -> str:
    """A tag as it is counted: names beyond HTML's own, of which a table may hold any number, are one."""
    name = key.lstrip("/").split(".")[0]
    return key if name in BLOCKS or name in VOID or name in RAW or name in INLINE else "?"


def counted(labelled: list[tuple[list[Token], tuple[int, int]]]) -> dict[str, tuple[int, int]]:
    """How often each tag stands within and outside the labelled regions; tags that are left out don't count."""
    inside, outside = Counter(), Counter()
    for found, (a, b) in labelled:
        for i, t in enumerate(found):
            if t.key is not None and not t.out:
                (inside if a <= i < b else outside)[_known(t.key)] += 1
    return {k: (inside[k], outside[k]) for k in inside | outside}


def initial(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of standing within a labelled region; a tag that never does begins at its floor at the lowest."""
    weights = {}
    for k in sorted(counts):
        inside, outside = counts[k]
        w = math.log((inside + .5) / (outside + .5))
        name = k.lstrip("/").split(".")[0]
        if not inside and name not in PARTS:
            w = max(w, FLOOR_BLOCK if name in BLOCKS else FLOOR_INLINE)
        weights[k] = min(LEAST, w)
    weights.pop("?", None)                             # tags of any name weigh what unknown ones do
    return weights


def learn(pages: list[str], counts: dict[str, tuple[int, int]] | None = None) -> dict[str, float]:
    """Tag weights corrected on labelled pages, from counts over all of them (else over these); empty if none is labelled."""
    labelled = [x for x in map(label, pages) if x]
    weights = initial(counted(labelled) if counts is None else counts)
    for _ in range(ROUNDS):
        wrong = 0
        for found, (a, b) in labelled:
            hard = [s if t.key is not None or t.out else s * (1 / MARGIN if a <= i < b else MARGIN) for i, (t, s) in enumerate(zip(found, _scores(found, weights)))]
            c, d = best_region(found, hard)
            words = lambda x, y: [i for i in range(x, y) if found[i].key is None and found[i].words and not found[i].out]
            if words(a, b) == words(c, d):
                continue
            wrong += 1
            tags = lambda x, y: Counter(found[i].key for i in range(x, y) if found[i].key in weights and not found[i].out)
            change = tags(a, b)
            change.subtract(tags(c, d))
            for k, n in change.items():
                weights[k] = min(LEAST, weights[k] + .25 * ((n > 0) - (n < 0)))
        if not wrong:
            break
    return weights


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, in page order, joined by two line breaks."""
    found, _ = tokens(page or "")
    a, b = best_region(found, _scores(found, weights))
    blocks, now = [], []
    for t in found[a:b]:
        if t.key is None:
            if not t.out:
                now.append(t.text)
        elif t.name in BLOCKS:
            blocks.append(now)
            now = []
        elif t.name == "br":
            now.append(" ")
    texts = (" ".join("".join(x).split()) for x in [*blocks, now])
    return "\n\n".join(x for x in texts if x)


def train(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> dict[str, float]:
    """Weights counted over every labelled page and corrected on ``train_pages`` different ones.

    Tasks add up their tags' counts, of a fixed set of names.  The sample is the
    labelled skeletons of the smallest hashes: each task sends its own smallest,
    equal ones once, so neither a repeated page nor a repeated id fills it.
    """
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, smallest = Counter(), {}
        for b in batches:
            for x in b.column(0).to_pylist():
                found = label(x or "")
                if found is None:
                    continue
                for k, (i, o) in counted([found]).items():
                    total["i " + k] += i
                    total["o " + k] += o
                page = _skeleton(x)
                smallest[xxhash.xxh64_intdigest(page) >> 1] = page
                if len(smallest) > 2 * train_pages:
                    smallest = dict(sorted(smallest.items())[:train_pages])
        rows = [(k, n, None) for k, n in sorted(total.items())] + [("page", h, p) for h, p in sorted(smallest.items())[:train_pages]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                                         names=["kind", "n", "page"])

    found = keep(pages.select(html_col).mapInArrow(run, "kind string, n long, page string"), "labelled_pages")
    counts: dict[str, list[int]] = {}
    for r in found.where("kind != 'page'").groupBy("kind").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(r["kind"][2:], [0, 0])[r["kind"][0] == "o"] = r["n"]
    sample = found.where("kind = 'page'").groupBy("n").agg(F.min("page").alias("page")).orderBy("n").limit(train_pages)
    return learn([r["page"] for r in sample.collect()], {k: tuple(v) for k, v in counts.items()})


def _skeleton(page: str) -> str:
    """The page with every word cut to one letter: the same tokens, word for word."""
    out, at = [], 0
    for m in _TOKEN.finditer(page):
        out += [" w" * len(entities.unescape(page[at: m.start()]).split()), m[0] if m["name"] else f"<{m['raw']}></{m['raw']}>" if m["raw"] else ""]
        at = m.end()
    return "".join([*out, " w" * len(entities.unescape(page[at:]).split())])


def extract(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null html, or no main text, gives an empty text.

    ``weights`` are learned from the pages themselves if none are given.
    """
    prepare(pages.sparkSession)
    weights = train(pages, html_col) if weights is None else weights
    narrow = pages.select(id_col, url_col, html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x, weights) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    kinds = [f.dataType.simpleString() for f in narrow.schema]
    return narrow.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
