"""Main text of web pages, with a suffix array per host for boilerplate.

A page's markup gives blocks of text and is a prior. Blocks in an article or main element are likely content, a form or widget around it or not; what is marked as a menu,
header, footer, aside, form, advert, notice or comment goes; all other blocks are loose, and so are those whose class or id only hints at such
(share-price, search-results). Repeats over the pages of a host decide about loose text, with or without an article on the page:

* The token streams of a host's pages (all of their blocks outside articles, the marked ones too, for they show what repeats) are
  concatenated and their suffixes sorted, the suffix array, with the length of the prefix that neighbours share. A suffix is carried to a depth of
  DEPTH tokens, which finds every repeat: tokens covered by repeats of RUN or more tokens are covered by their parts of RUN to
  DEPTH tokens. For each suffix the longest prefix of RUN or more tokens that occurs on enough distinct pages of the host is boilerplate.
* Enough is one law at every size: a share SHARE of the host's distinct pages, at least MIN_PAGES and on a host of fewer pages all of them, two at least.
  Rows of a host with the same html are one page.
* What is left of a loose block are its unique runs. Beside an article, a loose block of fewer than RUN tokens goes if it is a whole block of as many pages.
* A block inside an article is content, copied articles and shared passages too, unless it stands on at least half of the host's
  distinct pages and NOTICE_PAGES of them: then it is a notice of the site. Where such blocks would be half of an article or more, the article is a
  copied one and keeps them.

The suffix array of a host is partitioned: suffixes are dealt by their first RUN tokens to groups of about GROUP_PAGES pages, after equal
suffixes of a batch of pages are counted together, so neither a large host nor a footer on all of its pages meets in one task whole. Pages are weighed by one over the
number of their copies, so counts of distinct pages are sums. Results do not depend on how the rows are partitioned.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed, empty ones dropped,
the rest joined by a line feed. Null html and pages without text give the empty string. A null url has no host;
such pages share one. Repeated rows are answered one by one; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import _text as T
from ledgerloom.llm._spark import small, store, store_counted

RUN = 6
DEPTH = 16
MIN_PAGES = 3
SHARE = 0.01
NOTICE_SHARE = 0.5
NOTICE_PAGES = 5
GROUP_PAGES = 2048
#: So much boilerplate of all hosts is held as one table by every task.
NAMES = 1_000_000

_RAW = "script|style|noscript|template|textarea|select|iframe|object|canvas|title"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>?"
    r"|[^<]+|<",
    re.S | re.I,
)
#: Drawings and formulas: their text is not content; they end where the block around them ends if they are left open.
_DRAWN = frozenset(("svg", "math"))
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav aside footer form menu head button dialog audio video map".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
_MARKED = frozenset(
    "ad ads adv advert advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted "
    "promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_MAIN = re.compile(r"(?:^|\s)role\s*=\s*(?:\"main\"|'main'|main(?=[\s/]|$))", re.I)
_SPACE = re.compile(r"\s+")
_WORDS = re.compile(r"[\s_-]+")
#: What may stand beside a marked word in the name of a class or id that is marked as a whole.
_PARTS = frozenset("area bar block body bottom box btn button buttons col column container content footer form group head header inner item items left link links list main menu nav outer page panel right row section site top widget wrap wrapper".split())

CONTENT, LOOSE, MARKED = "main", "loose", "marked"


def _marks(name: str, attributes: str, rooted: bool) -> int:
    """3 for an element marked as something other than content, 2 for one that may also wrap a page (a form, a widget), 1 for one that a class or id hints at, otherwise 0."""
    if name in _OUT or name == "header" and not rooted:
        return 2 if name == "form" else 3
    if not attributes or name in ("html", "body", "main", "article"):
        return 0
    most = 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        key = key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "role" and value in _ROLES:
            return 3
        if key in ("class", "id"):
            for token in value.split():
                words = set(_WORDS.split(token)) - {""}
                found = words & _MARKED or not rooted and "header" in words
                if found and words <= _MARKED | _PARTS:
                    if found != {"widget"}:
                        return 3
                    most = 2
                most = max(most, int(bool(found)))
    return most


def ordered_blocks(source: str) -> list[tuple[str, str]]:
    """Kind (main, loose or marked) and text of all blocks in page order."""
    found = []
    stack: list[tuple[str, bool, int]] = []
    open_: Counter[str] = Counter()
    rooted, out = False, 0
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = _SPACE.sub(" ", _html.unescape("".join(text))).strip()
            text.clear()
            if joined:
                found.append((MARKED if out >= 2 else CONTENT if rooted and not out else LOOSE, joined))

    def close(to: int) -> None:
        nonlocal rooted, out
        for name, _, _ in stack[to:]:
            open_[name] -= 1
        del stack[to:]
        rooted, out = stack[-1][1:] if stack else (False, 0)

    def leave_drawing() -> None:
        """A block's tag inside an open drawing: the drawing was left open."""
        at = next((i for i, x in enumerate(stack) if x[0] in _DRAWN), None)
        if at is not None:
            flush()
            close(at)

    for m in _TOKEN.finditer(source):
        name = m.group(3)
        if name is None:
            got = m.group()
            if got[0] != "<" or got == "<":
                text.append(got)
            continue
        name = name.lower()
        drawn = open_["svg"] + open_["math"] > 0
        if drawn and name in _BLOCK and name != "title":
            leave_drawing()
        if m.group(2):
            if name in _BLOCK:
                flush()
            if open_[name] > 0:
                at = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name)
                if stack[at - 1][1:] != stack[-1][1:] if at else stack[-1][1:] != (False, 0):
                    flush()
                close(at)
            continue
        closed = m.group(4).endswith("/")
        if name in _BLOCK:
            flush()
            if name != "br":
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p" or stack[i][0] == name == "li":
                        close(i)
                        break
                    if stack[i][0] in _BLOCK:
                        break
        if name in _VOID or closed and name not in _BLOCK:
            continue
        whole = name == "main" or _MAIN.search(m.group(4)) is not None
        inner = rooted or name == "article" or whole
        # a page's main, and an article within a form or widget around the page, begin anew
        around = 0 if not rooted and (whole or name == "article" and out == 2) else out
        skip = 3 if name in _DRAWN else max(around, _marks(name, m.group(4), rooted))
        if (inner, skip) != (rooted, out):
            flush()
        rooted, out = inner, skip
        stack.append((name, rooted, out))
        open_[name] += 1
    flush()
    return found


HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


@lru_cache(maxsize=1 << 16)
def _token(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") | 1


def _whole(kind: str, text: str) -> int:
    """The name of a whole block: a digest of its kind and text."""
    return int.from_bytes(hashlib.blake2b(f"{kind}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Pages:
    """The blocks of a batch of pages and their token stream outside articles, tokens as 64-bit hashes and DEPTH zeros after each page. at has
    the places of the suffixes of RUN or more tokens, page their pages, suffixes their first DEPTH tokens."""

    def __init__(self, sources: list[str]) -> None:
        self.blocks = [ordered_blocks(x) for x in sources]
        flat: list[int] = []
        self.starts, at, page = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, blocks in enumerate(self.blocks):
            start = len(flat)
            for kind, text in blocks:
                if kind != CONTENT:
                    flat.extend(map(_token, text.split(" ")))
            self.starts.append(start)
            n = len(flat) - start - RUN + 1
            if n > 0:
                at.append(np.arange(start, start + n))
                page.append(np.full(n, i))
            flat.extend([0] * DEPTH)
        self.tokens = np.array(flat, np.uint64)
        self.at, self.page = np.concatenate(at), np.concatenate(page)
        windows = np.lib.stride_tricks.sliding_window_view(self.tokens, DEPTH) if len(flat) else np.zeros((0, DEPTH), np.uint64)
        self.suffixes = np.ascontiguousarray(windows[self.at])

    def ranks(self) -> np.ndarray:
        """Numbers of the suffixes in the order of their first DEPTH tokens, by prefix doubling."""
        rank, length = np.unique(self.tokens, return_inverse=True)[1].astype(np.int64), 1
        while length < DEPTH:
            after = np.zeros(len(rank), np.int64)
            after[: len(rank) - length] = rank[length:]
            rank, length = np.unique(rank * (len(rank) + 1) + after, return_inverse=True)[1].astype(np.int64), 2 * length
        return rank[self.at]

    def whole(self, i: int) -> set[int]:
        """Names of the whole blocks of a page that repeats decide about: those of articles and short loose ones."""
        return {_whole(kind, text) for kind, text in self.blocks[i] if kind == CONTENT or kind == LOOSE and text.count(" ") < RUN - 1}


def suffix_names(suffixes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the first k tokens of each suffix."""
    h = np.full(len(suffixes), k, np.uint64)
    for j in range(k):
        h = T.mix((h ^ suffixes[:, j]) * np.uint64(0x9E3779B97F4A7C15))
    return h


def suffix_array(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their tokens and the length of the prefix that each shares with the one before it."""
    order = np.lexsort(suffixes.T[::-1])
    same = (suffixes[order][1:] == suffixes[order][:-1]) & (suffixes[order][1:] != 0)
    return order, np.concatenate([[0], np.cumprod(same, axis=1).sum(1)]).astype(np.int64) if len(order) else np.zeros(0, np.int64)


def covered_lengths(suffixes: np.ndarray, pages: np.ndarray, least: int) -> np.ndarray:
    """For each of distinct suffixes the longest prefix of RUN or more tokens that is on least pages; 0 if none.
    pages has a row for each suffix and, as its columns, the pages counted with it for prefixes of RUN to DEPTH tokens."""
    order, shared = suffix_array(suffixes)
    out = np.zeros(len(order), np.int64)
    for depth in range(DEPTH, RUN - 1, -1):
        whole = suffixes[order][:, depth - 1] != 0
        node = np.cumsum(shared < depth) - 1
        total = np.bincount(node, weights=pages[order, depth - RUN], minlength=1)[node] if len(order) else np.zeros(0)
        hit = whole & (total > least - 0.5) & (out[order] == 0)
        out[order[hit]] = depth
    return out


_SUFFIXES = "host string, grp int, suffixes binary, weights binary, pages double, notice long"


def shared_prefixes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of tokens that suffixes share from their beginning."""
    return np.cumprod((a == b) & (a != 0), axis=1).sum(1).astype(np.int64)


def distinct_suffixes(pages: Pages, host: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hosts (numbers), distinct suffixes and how many pages have each prefix of RUN to DEPTH tokens: a page counts, by its
    weight, with the first of its suffixes that has the prefix. host and weight are by page."""
    rank = pages.ranks()
    order = np.lexsort((rank, pages.page))
    x, page = pages.suffixes[order], pages.page[order]
    shared = np.zeros(len(order), np.int64)
    shared[1:] = np.where(page[1:] == page[:-1], shared_prefixes(x[1:], x[:-1]), 0)
    counted = weight[page][:, None] * (shared[:, None] < np.arange(RUN, DEPTH + 1)[None, :])
    own, rank = host[page], rank[order]
    order = np.lexsort((rank, own))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(rank[order]) != 0) | (np.diff(own[order]) != 0)])) if len(order) else order
    sums = np.add.reduceat(counted[order], new, axis=0) if len(order) else counted
    return own[order][new], x[order][new], sums


def _emit(batches):
    """Of pages (host, groups, weight, html): for each host and group of suffixes of a batch the distinct suffixes, and how many pages have each
    prefix of RUN to DEPTH tokens; and the names of whole blocks that repeats decide about, with their pages."""
    for batch in batches:
        pages = Pages([x.as_py() or "" for x in batch.column(3)])
        hosts = batch.column(0).dictionary_encode()
        names, code = hosts.dictionary.to_pylist(), hosts.indices.to_numpy()
        weight = batch.column(2).to_numpy()
        groups = np.zeros(len(names), np.int64)
        groups[code] = batch.column(1).to_numpy()
        host, x, counted = distinct_suffixes(pages, code, weight)
        to = (suffix_names(x, RUN) % groups[host].astype(np.uint64)).astype(np.int64)
        order = np.lexsort((to, host))
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(host[order]) != 0) | (np.diff(to[order]) != 0)])) if len(order) else order
        cut = np.append(cut, len(order))
        data = [[], []]
        for a, b in zip(cut[:-1], cut[1:]):
            data[0].append(x[order[a:b]].tobytes())
            data[1].append(counted[order[a:b]].astype(np.float32).tobytes())
        first = order[cut[:-1]]
        whole: Counter = Counter()
        for i, h in enumerate(code.tolist()):
            for name in pages.whole(i):
                whole[(h, name)] += weight[i]
        n, m = len(first), len(whole)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*(names[h] for h in host[first]), *(names[h] for h, _ in whole)], pa.string()), pa.array([*to[first].tolist(), *[None] * m], pa.int32()),
                *(pa.array([*T.pack(pa.array(d, pa.binary()))[0].to_pylist(), *[None] * m], pa.binary()) for d in data),
                pa.array([*np.diff(cut).astype(float).tolist(), *map(float, whole.values())], pa.float64()), pa.array([*[None] * n, *(name for _, name in whole)], pa.int64()),
            ],
            ["host", "grp", "suffixes", "weights", "pages", "notice"],
        )


def _repeats(table: pa.Table) -> pa.Table:
    """Of one group of a host: the names of suffixes that begin with boilerplate, and its length in tokens."""
    n = [int(x) for x in table.column("pages").to_pylist()]
    width = DEPTH - RUN + 1
    data = [T.unpack(table.column(c).combine_chunks(), pa.array([m * size for m in n])).to_pylist() for c, size in (("suffixes", DEPTH * 8), ("weights", width * 4))]
    x = np.frombuffer(b"".join(data[0]), np.uint64).reshape(-1, DEPTH)
    pages = np.frombuffer(b"".join(data[1]), np.float32).reshape(-1, width).astype(np.float64)
    x, back = np.unique(x, axis=0, return_inverse=True)
    total = np.zeros((len(x), width))
    np.add.at(total, back.ravel(), pages)
    length = covered_lengths(x, total, table.column("least")[0].as_py())
    some = np.flatnonzero(length)
    host = pa.array([table.column("host")[0].as_py()] * len(some), pa.string())
    return pa.table({"host": host, "name": suffix_names(x[some], DEPTH).view(np.int64), "length": pa.array(length[some], pa.int32())})


def _names(batches):
    """Of pages (key, host, html): key, host, the names of the page's suffixes and of the whole blocks that repeats decide about."""
    for batch in batches:
        pages = Pages([x.as_py() or "" for x in batch.column(2)])
        name = suffix_names(pages.suffixes, DEPTH).view(np.int64)
        whole = [(i, n) for i in range(batch.num_rows) for n in pages.whole(i)]
        row = np.concatenate([pages.page, np.array([i for i, _ in whole], np.int64)])
        name = np.concatenate([name, np.array([n for _, n in whole], np.int64)])
        both = np.unique(np.column_stack([row, name]), axis=0)
        take = pa.array(both[:, 0])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(both[:, 1])], ["key", "host", "name"])


def _whole_runs(flags: np.ndarray, run: int = RUN) -> np.ndarray:
    """Flags of one block without the stubs of repeats that reach over from its neighbours: a covered run counts if it
    is run tokens long or is the whole block."""
    out = flags.copy()
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a < run and b - a < len(flags):
            out[a:b] = False
    return out


def page_text(blocks: list[tuple[str, str]], covered: np.ndarray, whole: dict[int, int]) -> str:
    """The main text of a page. covered tells which tokens outside its articles are boilerplate; whole has the names of whole blocks on as many
    pages as such a run (-1) or as a notice (0)."""
    content = [text for kind, text in blocks if kind == CONTENT]
    notices = {text for text in content if whole.get(_whole(CONTENT, text)) == 0} if whole else set()
    if 2 * sum(len(text) for text in content if text in notices) >= sum(map(len, content)):
        notices = set()
    out, at = [], 0
    for kind, text in blocks:
        if kind == CONTENT:
            if text not in notices:
                out.append(text)
            continue
        n = text.count(" ") + 1
        own, at = covered[at : at + n], at + n
        if kind == MARKED or content and n < RUN and whole and _whole(LOOSE, text) in whole:
            continue
        left = " ".join(t for t, x in zip(text.split(" "), _whole_runs(own)) if not x) if own.any() else text
        if left:
            out.append(left)
    return "\n".join(out)


def _texts(pages: Pages, reach: np.ndarray, whole: list[dict[int, int]]) -> list[str]:
    """The pages' texts; reach has the boilerplate tokens that begin at each suffix."""
    edge = np.zeros(len(pages.tokens) + 1, np.int64)
    some = np.flatnonzero(reach)
    np.add.at(edge, pages.at[some], 1)
    np.add.at(edge, pages.at[some] + reach[some], -1)
    covered = np.cumsum(edge)[:-1] > 0
    ends = [*pages.starts[1:], len(pages.tokens)]
    return [page_text(b, covered[s:e], w) for b, s, e, w in zip(pages.blocks, pages.starts, ends, whole)]


def _met(batches):
    """Texts of pages (page_id, url, html, found), found being the page's names (name, length) that are boilerplate."""
    for batch in batches:
        pages = Pages([x.as_py() or "" for x in batch.column(2)])
        found = [{x["name"]: x["length"] for x in f or []} for f in batch.column(3).to_pylist()]
        name = suffix_names(pages.suffixes, DEPTH).view(np.int64).tolist()
        reach = np.array([max(0, found[i].get(n, 0)) for i, n in zip(pages.page.tolist(), name)], np.int64)
        whole = [{n: x for n, x in f.items() if x <= 0} for f in found]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_texts(pages, reach, whole), pa.string())], ["page_id", "url", "text"])


def _looked_up(shared):
    """Texts of pages (page_id, url, html, host) by a table of all boilerplate: sorted names under their hosts, and lengths."""

    def run(batches):
        keys, lengths = shared.value
        for batch in batches:
            pages = Pages([x.as_py() or "" for x in batch.column(2)])
            hosts = batch.column(3).dictionary_encode()
            salt = np.array([_token(h) for h in hosts.dictionary.to_pylist()], np.uint64)[hosts.indices.to_numpy()]
            wholes = [pages.whole(i) for i in range(batch.num_rows)]
            row = np.repeat(np.arange(len(wholes)), [len(w) for w in wholes])
            name = np.concatenate([suffix_names(pages.suffixes, DEPTH), np.array([n for w in wholes for n in w], np.int64).view(np.uint64)])
            page = np.concatenate([pages.page, row])
            key = T.mix(name ^ salt[page])
            i = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            length = np.where(keys[i] == key, lengths[i], 1 - DEPTH) if len(keys) else np.full(len(key), 1 - DEPTH)
            n = len(pages.at)
            found: list[dict[int, int]] = [{} for _ in wholes]
            for j in np.flatnonzero(length[n:] >= -1):
                found[row[j]][int(name[n + j].view(np.int64))] = int(length[n + j])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(_texts(pages, np.maximum(length[:n], 0), found), pa.string())], ["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages (page_id, url, html)."""
    url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))
    key = F.unhex(F.md5(F.concat_ws("\n", host, html)))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), html.alias("html"), host.alias("host"), key.alias("key"))
    keys = store(pages.groupBy("host", "key").agg(F.count(F.lit(1)).alias("copies")), "page-keys")
    hosts, seen = store_counted(keys.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts", n=F.count(F.lit(1)))
    copied, many = store_counted(keys.where("copies > 1").select("key", "copies"), "copied", n=F.count(F.lit(1)))
    at = pages.join(small(hosts, seen["n"]), "host").join(small(copied, many["n"]), "key", "left").select(
        "host", F.ceil(F.col("n") / F.lit(GROUP_PAGES)).cast("int").alias("groups"), (F.lit(1.0) / F.coalesce("copies", F.lit(1))).alias("weight"), "html"
    )
    emitted = store(at.mapInArrow(_emit, _SUFFIXES), "suffixes")
    n = F.col("n").cast("double")
    least = F.ceil(F.greatest(F.lit(2.0), F.least(F.lit(float(MIN_PAGES)), n), F.lit(SHARE) * n)).cast("long")
    notices = F.ceil(F.greatest(F.lit(float(NOTICE_PAGES)), F.lit(NOTICE_SHARE) * n)).cast("long")
    limits = small(hosts.select("host", least.alias("least"), notices.alias("notices")), seen["n"])
    grouped = emitted.where("grp is not null").join(limits, "host").select("host", "grp", "suffixes", "weights", "pages", "least")
    runs = grouped.groupBy("host", "grp").applyInArrow(_repeats, "host string, name long, length int")
    return _answer(pages, emitted, limits, runs)


def _answer(pages: DataFrame, emitted: DataFrame, limits: DataFrame, runs: DataFrame) -> DataFrame:
    """Meets pages with the runs and whole blocks of their hosts that are boilerplate: by a table that every task has if it is within NAMES, otherwise by
    a join of each page's names."""
    spark = pages.sparkSession
    blocks = emitted.where("notice is not null").groupBy("host", "notice").agg(F.sum("pages").alias("pages")).where("pages > 1.5").join(limits, "host")
    # an article's block goes as a notice; a short loose one by the limit of runs. The names of both kinds differ
    short, long = F.col("pages") > F.col("least") - F.lit(0.5), F.col("pages") > F.col("notices") - F.lit(0.5)
    names = blocks.where(short | long).select("host", F.col("notice").alias("name"), F.when(long, 0).otherwise(-1).alias("length"))
    found, seen = store_counted(runs.unionByName(names), "boilerplate", n=F.count(F.lit(1)))
    if seen["n"] <= NAMES:
        table = found.toArrow()
        hosts = table.column("host").combine_chunks().dictionary_encode()
        salt = np.array([_token(h) for h in hosts.dictionary.to_pylist()], np.uint64)[hosts.indices.to_numpy()]
        key = T.mix(table.column("name").to_numpy().view(np.uint64) ^ salt)
        order = np.argsort(key)
        shared = spark.sparkContext.broadcast((key[order], table.column("length").to_numpy()[order].astype(np.int64)))
        out = pages.select("page_id", "url", "html", "host").mapInArrow(_looked_up(shared), "page_id long, url string, text string")
    else:
        own = pages.select("key", "host", "html").mapInArrow(_names, "key binary, host string, name long")
        hits = own.join(found, ["host", "name"]).groupBy("key").agg(F.collect_set(F.struct("name", "length")).alias("found"))
        hits, some = store_counted(hits, "hits", n=F.count(F.lit(1)))
        out = pages.join(small(hits, some["n"]), "key", "left").select("page_id", "url", "html", "found")
        out = out.mapInArrow(_met, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
