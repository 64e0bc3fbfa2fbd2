"""Main text of web pages, with boilerplate found by suffix arrays over the pages of a host.

1. A page's html becomes blocks of words, each with a place: inside an article or main element (``body``), inside a part
   that markup names as something else - menu, header, footer, sidebar, advert, notice, form, comments - (``aside``), or
   neither (``open``).
2. Substrings of at least ``REPEAT`` tokens that stand on two distinct pages of a host or more cover tokens. The token
   streams of up to about ``CHUNK`` pages are concatenated and their suffixes sorted (prefix doubling). A host of more pages
   is cut into such chunks by a hash of the page; what its chunks share is found by 64-bit hashes of all windows of
   ``REPEAT`` tokens, which meet by host and hash and are sent back to the chunks that hold them. So repeats count over the
   whole host at every size.
3. Of aside blocks nothing is kept, of body blocks everything: an article that two pages carry is still their text. Of
   open blocks the covered tokens go and the unique runs stay.

Pages travel to their host without markup, and only if some page of the host has open text: repeats decide nothing elsewhere.
A window that stands on every page of a large host is one row a chunk before it is gathered, so no host or passage gathers in
one task. A host is what ``host_of`` says, for counting as for grouping, the empty host included.

Null and empty html and pages without main text give an empty text. Repeated rows (equal page_id, url, html) are one page
for step 2, and each gets the same text. A url without a host belongs to the empty host. Other columns are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shingles import hash_words, shingle_hashes
from seriesloom.llm.tables import stored

REPEAT = 8
CHUNK = 256
#: Hosts up to this number are sent to all tasks; beyond, Spark joins them.
BROADCAST_HOSTS = 10_000

#: Elements whose text is never shown or never prose (fixed values of the HTML standard and of the contract).
SILENT = frozenset("script style noscript template head title iframe object svg math canvas audio video select option textarea button datalist".split())
RAW = frozenset("script style noscript template iframe textarea svg title".split())
ASIDE = frozenset("nav footer aside form dialog menu".split())
BODY = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
#: Elements that a start tag of the named kind ends, where they are still open.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
#: Words of class, id and role that name something beside the article.
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation "
    "breadcrumb breadcrumbs sidebar aside complementary footer header masthead contentinfo notice notices cookie cookies "
    "consent gdpr popup modal overlay alert newsletter subscribe subscription signup login search comment comments reply "
    "replies disqus respond share sharing social related recommended recommendations widget toolbar pagination pager "
    "copyright disclaimer hidden skip form".split()
)
#: Words that say where or how large such a part is, and nothing about what it is.
QUALIFIERS = frozenset(
    "site page global top bottom left right primary secondary box bar area container wrapper wrap list section block inner outer "
    "item items link links posts articles stories".split()
)
#: Elements that stay beside the article even if they hold one: cards in a sidebar are not the page's text.
ALWAYS_ASIDE = frozenset("nav footer aside dialog".split())
_TAG = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][A-Za-z0-9:-]*))")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""\s(?:hidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true)""", re.I)
_QUOTED = re.compile(r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>""")


def _names_aside(tag: str, attributes: str, in_body: bool) -> bool:
    if tag in ASIDE or (tag == "header" and not in_body):
        return True
    if tag in ("html", "body"):
        return False
    for match in _ATTRIBUTE.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            parts = [w for w in re.split(r"[^a-z0-9]+", name) if w]
            named = [w for w in parts if w in WORDS and not (w == "header" and in_body)]
            # the whole name must say so: an article may be comments-open, a page may have has-sidebar
            if named and all(w in WORDS or w in QUALIFIERS for w in parts):
                return True
    return bool(_HIDDEN.search(attributes))


def blocks(page: str) -> list[tuple[str, str]]:
    """(place, text) of the blocks of a page in order; place is ``body``, ``aside`` or ``open``.

    An element that names itself as something beside the article but holds the first article is not beside it. Inline
    elements beside the article leave the block around them whole.
    """
    out: list[tuple[str, frozenset[int], str]] = []
    words: list[tuple[frozenset[int], str]] = []  # with the open elements that are beside the article
    stack: list[tuple[str, str | None, int]] = []  # element, the place it opens, its number
    where: tuple[bool, bool, frozenset[int]] = (False, False, frozenset())  # silent, in a body, beside which elements
    holds_article: set[int] = set()
    seen_body, number = False, 0

    def flush() -> None:
        by: dict[frozenset[int], list[str]] = {}
        for ids, text in words:
            by.setdefault(ids, []).append(text)
        words.clear()
        for ids, parts in by.items():
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(("body" if where[1] else "open", ids, text))

    def now() -> tuple[bool, bool, frozenset[int]]:
        kinds = {k for _, k, _ in stack}
        return "silent" in kinds, "body" in kinds, frozenset(i for _, k, i in stack if k == "aside")

    def close(name: str) -> None:
        nonlocal where
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                where = now()
                return

    at = 0
    while True:
        match = _TAG.search(page, at)
        if not where[0]:
            words.append((where[2], page[at : match.start() if match else len(page)]))
        if not match:
            break
        if match[0] == "<!--":
            end = page.find("-->", match.end())
            at = len(page) if end < 0 else end + 3
            continue
        whole = _QUOTED.match(page, match.end())
        at = whole.end() if whole else (page.find(">", match.end()) + 1 or len(page))
        if not match[2]:
            continue
        name, attributes = match[2].lower(), page[match.end() : at]
        if match[1]:
            if name in BLOCK:
                flush()
            close(name)
            continue
        if name == "br" or name == "wbr":
            words.append((where[2], " " if name == "br" else ""))
            continue
        if name in BLOCK:
            flush()
            for open_name, ends in ENDS.items():
                if name in ends:
                    _end_implied(stack, open_name)
            where = now()
        if name in VOID or attributes.endswith("/>") and name not in BLOCK:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        is_body = name in BODY or _is_main(attributes)
        names_aside = _names_aside(name, attributes, where[1])
        if is_body and names_aside and seen_body:
            is_body = False  # a comment or an advert that is marked up as an article
        if is_body and not seen_body and not where[0]:
            holds_article.update(i for n, k, i in stack if k == "aside" and n not in ALWAYS_ASIDE)
            seen_body = where[2] <= holds_article
        kind = "silent" if name in SILENT else "body" if is_body else "aside" if names_aside else None
        number += 1
        stack.append((name, kind, number))
        where = now()
    flush()
    return [("aside" if ids - holds_article else place, text) for place, ids, text in out]


def _is_main(attributes: str) -> bool:
    return bool(re.search(r"""\brole\s*=\s*["']?(?:main|article)\b""", attributes, re.I))


def _end_implied(stack: list[tuple[str, str | None, int]], open_name: str) -> None:
    """End the nearest open element of ``open_name``, unless another block stands between."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == open_name:
            del stack[i:]
            return
        if stack[i][0] in BLOCK:
            return


def repeated(pages: list[int], tokens: np.ndarray, length: int = REPEAT) -> np.ndarray:
    """Which tokens lie inside a substring of ``length`` tokens that stands on two distinct pages.

    ``tokens`` are numbers; ``pages`` says for each token which page it is of, ascending. Suffixes are ranked by prefix
    doubling until ``length`` tokens count; a substring does not run over the end of its page.
    """
    page = np.asarray(pages)
    n = len(tokens)
    if not n:
        return np.zeros(0, bool)
    _, rank = np.unique(tokens, return_inverse=True)
    width = 1
    while width < length:
        step = min(width, length - width)
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        after[: n - step][page[step:] != page[: n - step]] = 0
        order = np.lexsort((after, rank))
        new = np.r_[False, (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        width += step
    suffixes = np.lexsort((page, rank))
    r, p = rank[suffixes], page[suffixes]
    first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
    shared = np.repeat(np.minimum.reduceat(p, first) != np.maximum.reduceat(p, first), np.diff(np.r_[first, n]))
    start = np.zeros(n, bool)
    start[suffixes] = shared
    whole = np.zeros(n, bool)
    whole[: max(0, n - length + 1)] = page[length - 1 :] == page[: max(0, n - length + 1)]
    start &= whole
    return _cover(np.flatnonzero(start), n, length)


def _cover(at: np.ndarray, n: int, length: int) -> np.ndarray:
    """Which of ``n`` tokens the substrings of ``length`` tokens that start at ``at`` cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + length, -1)
    return np.cumsum(edge[:n]) > 0


def window_hashes(tokens: list[str]) -> np.ndarray:
    """Hashes of the windows of ``REPEAT`` tokens, by position."""
    return shingle_hashes(hash_words([t.encode("utf-8", "surrogatepass") for t in tokens]), REPEAT)


def host_of(url: str | None) -> str:
    from urllib.parse import urlsplit

    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


_BLOCKS = "page_id long, url string, host string, page binary, undecided boolean, places array<string>, texts array<string>"


def _parse(batches):
    from hashlib import blake2b

    for batch in batches:
        hosts, keys, places, texts = [], [], [], []
        for i, (url, html) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            hosts.append(host_of(url))
            name = f"{batch.column(0)[i].as_py()} {url} {html}".encode("utf-8", "surrogatepass")
            keys.append(blake2b(name, digest_size=8).digest())
            found = blocks(html or "")
            places.append([p for p, _ in found if p != "aside"])
            texts.append([t for p, t in found if p != "aside"])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(hosts, pa.string()),
                pa.array(keys, pa.binary()),
                pa.array(["open" in p for p in places], pa.bool_()),
                pa.array(places, pa.list_(pa.string())),
                pa.array(texts, pa.list_(pa.string())),
            ],
            names=["page_id", "url", "host", "page", "undecided", "places", "texts"],
        )


def _windows(batches):
    """The distinct windows of each page, and whether an open token stands in them."""
    for batch in batches:
        host, chunk, places, texts = (batch.column(i).to_pylist() for i in range(4))
        for i in range(batch.num_rows):
            tokens, is_open = [], []
            for place, text in zip(places[i], texts[i], strict=True):
                words = text.split(" ")
                tokens += words
                is_open += [place == "open"] * len(words)
            h = window_hashes(tokens)
            if not len(h):
                continue
            upto = np.r_[0, np.cumsum(is_open)]
            some_open = upto[REPEAT:] > upto[:-REPEAT]
            order = np.lexsort((~some_open, h))
            h, some_open = h[order], some_open[order]
            first = np.r_[True, h[1:] != h[:-1]]
            h, some_open = h[first].view(np.int64), some_open[first]
            yield pa.RecordBatch.from_arrays(
                [pa.array([host[i]] * len(h), pa.string()), pa.array(np.full(len(h), chunk[i])), pa.array(h), pa.array(some_open)],
                names=["host", "chunk", "hash", "undecided"],
            )


def _unique_runs(rows: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
    """One chunk of a host: cover repeated tokens, keep the rest of open blocks and all of body blocks.

    ``elsewhere`` has the hashes of windows that other chunks of the host hold too.
    """
    number = {}
    pages, tokens, spans = [], [], []
    for i in rows.sort_values("page").index:
        page = number.setdefault(rows.at[i, "page"], len(number))
        for b, text in enumerate(rows.at[i, "texts"]):
            words = text.split(" ")
            spans.append((i, b, len(tokens), words))
            tokens += words
            pages += [page] * len(words)
    codes, _ = pd.factorize(np.array(tokens, dtype=object)) if tokens else (np.zeros(0, np.int64), None)
    covered = repeated(pages, codes)
    if len(elsewhere) and len(tokens) >= REPEAT:
        page = np.asarray(pages)
        whole = page[REPEAT - 1 :] == page[: len(page) - REPEAT + 1]
        shared = np.isin(window_hashes(tokens).view(np.int64), elsewhere["hash"].to_numpy(np.int64))
        covered |= _cover(np.flatnonzero(whole & shared), len(tokens), REPEAT)
    kept: dict = {i: [] for i in rows.index}
    for i, b, at, words in spans:
        if rows.at[i, "places"][b] == "open":
            words = [w for w, gone in zip(words, covered[at : at + len(words)].tolist(), strict=True) if not gone]
        if words:
            kept[i].append(" ".join(words))
    out = rows[["page_id", "url"]].copy()
    out["text"] = ["\n\n".join(kept[i]) for i in rows.index]
    return out


def _small_host(rows: pd.DataFrame) -> pd.DataFrame:
    return _unique_runs(rows, rows.iloc[:0])


def _few(hosts: DataFrame) -> DataFrame:
    return F.broadcast(hosts) if hosts.count() <= BROADCAST_HOSTS else hosts


def by_size(parsed: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parsed pages of large hosts with their ``chunk``, those of other hosts with open text, and the rest."""
    hosts = parsed.groupBy("host").agg(F.max("undecided").alias("repeats"), F.ceil(F.count("*") / chunk).alias("chunks"))
    hosts = stored(hosts, "html-hosts")
    marked = parsed.join(_few(hosts.where("chunks > 1")), "host", "left")
    part = F.pmod(F.xxhash64("page"), F.col("chunks"))
    large = marked.where("chunks > 1 AND repeats").withColumn("chunk", part)
    small = marked.where("chunks IS NULL").select(*parsed.columns)
    open_hosts = _few(hosts.where("chunks = 1 AND repeats").select("host"))
    plain = marked.where("NOT repeats").select(*parsed.columns).unionByName(small.join(open_hosts, "host", "left_anti"))
    return large, small.join(open_hosts, "host", "left_semi"), plain


def main_text(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``page_id, url, text`` for every row of ``pages`` (``page_id``, ``url``, ``html``)."""
    parsed = stored(pages.select("page_id", "url", "html").mapInArrow(_parse, _BLOCKS), "html-blocks")
    large, small, plain = by_size(parsed, chunk)
    windows = large.select("host", "chunk", "places", "texts").mapInArrow(_windows, "host string, chunk long, hash long, undecided boolean")
    shared = (
        windows.groupBy("host", "hash")
        .agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.max("undecided").alias("decides"))
        .where("low < high AND decides")
        .select("host", "hash")
    )
    back = windows.where("undecided").select("host", "chunk", "hash").distinct().join(shared, ["host", "hash"], "left_semi")
    kind = "page_id long, url string, text string"
    of_large = large.groupBy("host", "chunk").cogroup(back.groupBy("host", "chunk")).applyInPandas(_unique_runs, kind)
    of_small = small.groupBy("host").applyInPandas(_small_host, kind)
    return plain.select("page_id", "url", F.array_join("texts", "\n\n").alias("text")).unionByName(of_small).unionByName(of_large)
