"""Main text of web pages: structure first, then a suffix array over each host's token streams.

A page is cut into blocks in one pass. Menus, headers, footers, sidebars, notices, adverts, forms and
comments go by their element or by a whole class token; an element that only bears such a name but
holds most of the article (where a page has none, of its text) is no chrome, comments excepted.
Blocks inside the page's article stay as they are: articles quote each other and share paragraphs.

The other blocks of a page are its token stream. The streams of a host's pages are concatenated and
sorted into a suffix array by prefix doubling, as deep as ``RUN`` tokens: neighbours there with one
rank share at least so many. Runs in several pages cover what repeats; what a page has besides (its
article and the tokens that no run covers) names its content. Pages alike in content count once, and
so do all pages with too few tokens of their own (below ``OWN_SHARE`` of the page, at least ``OWN[0]``
and at most ``OWN[1]``), which near copies are. A run is boilerplate if it is in ``FEW`` contents, or in both where the host has only two, however large the
host. Covered runs are removed and unique ones stay: a block that is covered to ``COVERED`` goes, of others
a stretch of at least two runs.

A host is worked on in shards of at most about ``SHARD_PAGES`` pages and ``SHARD_BYTES`` of html,
by a hash of the page, so a host with a third of all pages is many groups. A shard's suffix array
gives its runs and their contents; they are counted over the whole host, and the repeats go back to
the shards, so the shards do not change any text.

Defined results: null html and pages without text give an empty text; a null or unreadable url
is a host of its own; a tag that is never closed is text; rows alike give rows alike; a table without rows an empty one.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import if_small, store
from salesloom.llm.textscan import Words, mix, run_hashes, signed

RUN, COVERED, FEW = 8, 0.8, 3
OWN, OWN_SHARE = (4, 32), 0.05
SHARD_PAGES, SHARD_BYTES = 200, 1 << 20

# The elements and names that mark the parts of a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead title tr ul".split()
)
HARD = set("script style noscript template iframe svg head title button select textarea object canvas math datalist".split())
SOFT = set("nav footer aside menu dialog header form".split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
MAIN = {"article", "main"}
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption table tbody tr td th dl dt dd li".split())
COMMENTS = set("comment comments commentlist respond reply replies disqus".split())
ADVERTS = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner banners cookie cookies consent gdpr "
    "newsletter subscribe subscription".split()
)
CHROME_NAMES = COMMENTS | ADVERTS | set(
    "notice notices alert popup modal overlay sidebar sidenav aside menu menus nav navbar navigation breadcrumb breadcrumbs footer "
    "share sharing social related recommended recommendations signup login widget widgets pagination pager toolbar "
    "complementary contentinfo search masthead".split()
)
HEADER_NAMES = {"header", "masthead", "banner", "topbar"}
#: A class token with one of these speaks of a state of the page, not of the element's own kind.
STATES = set("has with no without is not are show hide enabled disabled open opened closed on off active visible".split())
#: A class token that ends in none of the names above and holds one of these is the frame around several parts.
FRAMES = set("content page layout main body post article entry site wrap wrapper columns grid".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[>=]")
_BLANK = re.compile(r"\s*")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_UNSEEN = re.compile(r"""(?<![\w-])(?:style\s*=\s*(?:"[^"]*?display\s*:\s*none|'[^']*?display\s*:\s*none)|aria-hidden\s*=\s*["']?true)""", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_CLOSERS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def _kinds(attributes: str, names: set[str]) -> set[str]:
    """Which of the names an element's class tokens stand for."""
    found = set()
    for m in _NAMES.finditer(attributes):
        for token in (m[1] or m[2] or m[3] or "").split():
            parts = [part.lower() for part in _SPLIT.split(token) if part]
            hit = names.intersection(parts)
            if hit and not STATES.intersection(parts) and (parts[-1] in names or not FRAMES.intersection(parts)):
                found |= hit
    return found


def _role(tag: str, attributes: str, in_main: bool) -> str:
    """main; chrome; or chrome unless the element holds an article (tag), most of the text too (name); comments are never kept."""
    if tag in HARD:
        return "chrome"
    if tag in SOFT and not (tag == "header" and in_main):
        return "name" if tag == "form" else "tag"
    if not attributes or tag in ("html", "body"):
        return "main" if tag in MAIN else ""
    if tag in MAIN:
        return "comments" if _kinds(attributes, COMMENTS) else "main"
    if _HIDDEN.search(_QUOTED.sub("=", attributes)) or _UNSEEN.search(attributes):
        return "chrome"
    found = _kinds(attributes, ADVERTS if in_main and tag in PROSE else CHROME_NAMES | (set() if in_main else HEADER_NAMES))
    if not found:
        return "main" if any("main" in (m[1] or m[2] or m[3] or "").lower().split() for m in _NAMES.finditer(attributes) if m[0][:4].lower() == "role") else ""
    if tag not in BLOCK:
        return "chrome"
    return "comments" if found & COMMENTS else "tag" if found & ADVERTS else "name"


class _Tags:
    """The mark-up of a page from left to right, each character read a fixed number of times."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, outside quoted values; where they never end, of the next one."""
        first = at
        while self.quotes:
            stop = _STOP.search(self.page, at)
            if stop and stop[0] == ">":
                return stop.start()
            at = _BLANK.match(self.page, stop.end()).end() if stop else len(self.page)
            if self.page[at : at + 1] in ('"', "'"):
                at = self.page.find(self.page[at], at + 1) + 1
                self.quotes = at > 0
            elif not stop:
                self.quotes = False
        return self.page.find(">", first)

    def next(self, at: int):
        """(start, end, closing, name, attributes) of the next tag or comment (no name) from a place on, or None."""
        while (start := self.page.find("<", at)) >= 0:
            if self.page.startswith("<!--", start):
                end = self.page.find("-->", start + 4)
                return start, end + 3 if end >= 0 else len(self.page), False, "", ""
            if start >= self.last:
                return None
            closing = self.page.startswith("/", start + 1)
            name = _NAME.match(self.page, start + 1 + closing)
            if name:
                end = self.page.find(">", name.end()) if closing else self.end(name.end())
                return start, end + 1, closing, name[0].lower(), self.page[name.end() : end]
            if closing or self.page[start + 1 : start + 2] in ("!", "?"):
                return start, self.page.find(">", start) + 1, False, "", ""
            at = start + 1
        return None


def page_blocks(page: str) -> list[tuple[str, bool]]:
    """(text, inside an article or main) of each block of a page that is not chrome, in order."""
    blocks: list[tuple[str, bool, int]] = []  # text, inside, characters outside links
    stack: list[tuple[str, str, int]] = []  # tag, role, number of the element among the doubtful ones
    depths: dict[str, list[int]] = {}  # where each tag, the blocks and the chrome are open
    doubtful: list[list] = []  # role, first block, block behind the last, whether inside main
    words: list[str] = []
    tags = _Tags(page)
    at = chrome = main = links = plain = 0

    def flush():
        nonlocal plain
        text = " ".join(entities.unescape("".join(words)).split())
        words.clear()
        if text:
            blocks.append((text, main > 0, plain))
        plain = 0

    def push(tag: str, role: str):
        nonlocal chrome, main, links
        for key in _keys(tag, role):
            depths.setdefault(key, []).append(len(stack))
        stack.append((tag, role, len(doubtful)))
        if role in ("tag", "name", "comments"):
            doubtful.append([role, len(blocks), None, main > 0])
        chrome += role == "chrome"
        main += role == "main"
        links += tag == "a"

    def pop_to(depth: int):
        nonlocal chrome, main, links
        while len(stack) > depth:
            tag, role, number = stack.pop()
            for key in _keys(tag, role):
                depths[key].pop()
            if role in ("tag", "name", "comments"):
                doubtful[number][2] = len(blocks)
            chrome -= role == "chrome"
            main -= role == "main"
            links -= tag == "a"

    def top(key: str) -> int:
        return depths[key][-1] if depths.get(key) else -1

    while True:
        found = tags.next(at)
        if not chrome:
            part = page[at : found[0] if found else len(page)]
            words.append(part)
            plain += 0 if links else len(part)
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        breaks = tag in BLOCK or tag in HARD
        if breaks:
            flush()
        elif tag == "br" and not chrome:
            words.append(" ")
        if closing:
            if top(tag) >= 0 and (breaks or top("#block") <= top(tag)):
                pop_to(top(tag))
            continue
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and top("#block") >= 0 and top("#block") >= top("#chrome"):
            if stack[top("#block")][0] in ("p", *SAME.get(tag, ())):  # an open paragraph ends where a block begins, an item where the next does
                pop_to(top("#block"))
        if tag in RAW:  # its content is no markup
            closer = _CLOSERS[tag].search(page, at)
            at = closer.end() if closer else len(page)
            continue
        push(tag, _role(tag, attributes, main > 0))
    flush()
    pop_to(0)
    return _without_chrome(blocks, doubtful)


def _keys(tag: str, role: str):
    yield tag
    if tag in BLOCK:
        yield "#block"
    if role == "chrome":
        yield "#chrome"


def _without_chrome(blocks: list[tuple[str, bool, int]], doubtful: list[list]) -> list[tuple[str, bool]]:
    """The blocks in none of the doubtful elements but those that hold most of the article, or of the text."""
    n = len(blocks)

    def covered(roles) -> np.ndarray:
        steps = np.zeros(n + 1, np.int64)
        for role, first, last, _ in doubtful:
            if role in roles:
                steps[first] += 1
                steps[last] -= 1
        return np.cumsum(steps)[:n] > 0

    if doubtful:
        inside = np.array([b[1] for b in blocks], bool)
        chars = np.where(covered(("comments",)), 0, np.array([b[2] for b in blocks], np.int64))
        article = bool((inside * chars).any())
        sums = np.concatenate([[0], np.cumsum(chars * inside if article else np.where(covered(("tag",)), 0, chars))])

        def holds(role, first, last, in_main) -> bool:
            most = 2 * (sums[last] - sums[first]) > sums[-1]
            return bool(most) and (role == "name" or role == "tag" and article and not in_main)

        doubtful = [d for d in doubtful if not holds(*d)]
        gone = covered(("tag", "name", "comments"))
        return [(text, m) for (text, m, _), g in zip(blocks, gone) if not g]
    return [(text, m) for text, m, _ in blocks]


def suffix_ranks(tokens: np.ndarray, run: int = RUN) -> np.ndarray:
    """The rank of the suffix at each place by its first ``run`` tokens or more, by prefix doubling."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < run and len(rank):
        step = min(length, run - length)
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        length += step
    return rank


def repeated(tokens: np.ndarray, page: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that starts in several distinct pages."""
    n = len(tokens)
    if n < run:
        return np.zeros(n, bool)
    rank = suffix_ranks(tokens, run)
    inside = np.zeros(n, bool)
    inside[: n - run + 1] = page[: n - run + 1] == page[run - 1 :]
    low, high = np.full(rank.max() + 1, np.iinfo(np.int64).max), np.full(rank.max() + 1, -1)
    np.minimum.at(low, rank[inside], page[inside])
    np.maximum.at(high, rank[inside], page[inside])
    start = inside & (low[rank] < high[rank])
    return _cover(start, run)


def _cover(start: np.ndarray, run: int = RUN) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens from one of the marked places."""
    n = len(start)
    steps = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(start)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + run, -1)
    return np.cumsum(steps)[:n] > 0


def _tokens(blocks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token stream of blocks (a mark before each block's words) and the block of each token."""
    raw = [b.encode() for b in blocks]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    words = Words(data, offsets, "space", False)
    block = words.text_of()
    place = np.arange(len(block)) + block + 1
    stream = np.full(len(block) + len(blocks), np.uint64(1))
    stream[place] = words.hashes
    owner = np.empty(len(stream), np.int64)
    owner[place] = block
    owner[words.first[:-1] + np.arange(len(blocks))] = np.arange(len(blocks))
    return stream, owner


def _least(stream: np.ndarray) -> int:
    """The name of a token stream, which most near copies share: its two least hashes of runs."""
    at = np.arange(max(1, len(stream) - RUN + 1))
    hashes = run_hashes(stream, at, np.minimum(at + RUN, len(stream)))
    least = np.array([hashes.min(), mix(hashes + np.uint64(1)).min()])
    return int(signed(mix(least[:1] + mix(least[1:])))[0])


def _identity(blocks: list[tuple[str, bool]]) -> int | None:
    """A hash of a page's blocks; None where none is outside its article."""
    if all(m for _, m in blocks):
        return None
    text = "\n".join(f"{m:d}{t}" for t, m in blocks)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _streams(shard: pa.Table):
    """The blocks of each page outside articles, their tokens, the block and page of each token, and the places where runs begin."""
    outside = [[t for t, m in zip(own, inside) if not m] for own, inside in zip(shard.column("blocks").to_pylist(), shard.column("inside").to_pylist())]
    stream, owner = _tokens([b for own in outside for b in own])
    page = np.repeat(np.arange(len(outside)), [len(own) for own in outside])[owner]
    n = max(0, len(stream) - RUN + 1)
    return outside, stream, owner, page, np.flatnonzero(page[:n] == page[RUN - 1 :][:n])


def _runs(shard: pa.Table) -> pa.Table:
    """The distinct (run, content) of one shard of a host, by its suffix array."""
    _, stream, _, page, at = _streams(shard)
    content = shard.column("content").to_numpy()[page[at]]
    rank = suffix_ranks(stream)[at]
    order = np.lexsort((content, rank))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(rank[order]) != 0) | (content[order][1:] != content[order][:-1])
    at, content = at[order][new], content[order][new]
    place = np.argsort(at)
    run = np.empty(len(at), np.int64)
    run[place] = signed(run_hashes(stream, at[place], at[place] + RUN))
    keys = {c: pa.repeat(shard.column(c)[0], len(at)) for c in ("host", "shard")}
    return pa.table(keys | {"run": pa.array(run), "content": pa.array(content)})


def _starts(stream: np.ndarray, at: np.ndarray, runs: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the run at each place, and the tokens where one of the given runs begins."""
    hashes = signed(run_hashes(stream, at, at + RUN))
    start = np.zeros(len(stream), bool)
    start[at] = np.isin(hashes, runs.column("run").to_numpy())
    return hashes, start


def _vouch(shard: pa.Table, candidates: pa.Table) -> pa.Table:
    """The distinct (run, content) of one shard for runs that are in several pages; the contents alone with a null run."""
    outside, stream, _, page, at = _streams(shard)
    hashes, start = _starts(stream, at, candidates)
    own = ~_cover(start)
    first = np.searchsorted(page, np.arange(len(outside) + 1))
    name = np.zeros(len(outside), np.int64)
    for i, (blocks, inside) in enumerate(zip(shard.column("blocks").to_pylist(), shard.column("inside").to_pylist())):
        article = _tokens([t for t, m in zip(blocks, inside) if m])[0]
        rest = stream[first[i] : first[i + 1]][own[first[i] : first[i + 1]]]
        rest = np.concatenate([article, rest[rest != 1]])  # without the marks of blocks
        size = len(article) + first[i + 1] - first[i]
        if len(rest) >= max(OWN[0], min(OWN[1], OWN_SHARE * size)):
            name[i] = _least(rest)
    seen = start[at]
    pairs = np.unique(np.stack([hashes[seen], name[page[at][seen]]]), axis=1)
    names = np.unique(name)
    run = pa.concat_arrays([pa.array(pairs[0], pa.int64()), pa.nulls(len(names), pa.int64())])
    return pa.table({"host": pa.repeat(shard.column("host")[0], len(run)), "run": run, "content": pa.array(np.concatenate([pairs[1], names]), pa.int64())})


def _unique_words(block: str, covered: np.ndarray) -> str:
    """A block without its covered stretches of at least two runs."""
    edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0))
    drop = np.zeros(len(covered), bool)
    for low, high in edges.reshape(-1, 2):
        drop[low:high] = high - low >= 2 * RUN
    return " ".join(w for w, d in zip(block.split(" "), drop[1:].tolist()) if not d) if drop.any() else block  # the first token is the block's mark


def _judge(shard: pa.Table, repeats: pa.Table) -> pa.Table:
    """The text of each page of one shard of a host, by the host's repeats that are in the shard."""
    outside, stream, owner, _, at = _streams(shard)
    covered = _cover(_starts(stream, at, repeats)[1])
    first = np.searchsorted(owner, np.arange(sum(map(len, outside)) + 1))
    kept = []
    for block, low, high in zip((b for own in outside for b in own), first[:-1], first[1:]):
        part = covered[low:high]
        kept.append(block if not part.any() else "" if part.mean() >= COVERED else _unique_words(block, part))
    kept = iter(kept)
    texts, cut = [], []
    for own, inside in zip(shard.column("blocks").to_pylist(), shard.column("inside").to_pylist()):
        left = [b if m else next(kept) for b, m in zip(own, inside)]
        texts.append("\n".join(b for b in left if b))
        cut.append(sum(b != c for b, c in zip(own, left)))
    return pa.table(
        {
            "page_id": shard.column("page_id"),
            "url": shard.column("url"),
            "text": pa.array(texts, pa.string()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "n_blocks": pa.array([len(o) for o in shard.column("blocks").to_pylist()], pa.int64()),
            "n_repeated": pa.array(cut, pa.int64()),
        }
    )


def main_text(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text, n_chars, and how many blocks it has and how many outside articles lost repeats of the host."""
    host = F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit(""))
    keyed = pages.select("page_id", "url", "html", host.alias("host"))
    size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
    hosts = keyed.groupBy("host").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    shards = F.greatest(F.ceil(F.col("n") / SHARD_PAGES), F.ceil(F.col("bytes") / SHARD_BYTES)).cast("int")
    hosts = if_small(store(hosts.select("host", shards.alias("shards")), "hosts"))

    def parse(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                found = [page_blocks(p or "") for p in part.column("html").to_pylist()]
                blocks = pa.array([[t for t, _ in own] for own in found], pa.list_(pa.string()))
                inside = pa.array([[m for _, m in own] for own in found], pa.list_(pa.bool_()))
                content = pa.array([_identity(own) for own in found], pa.int64())
                columns = [*(part.column(c) for c in ("page_id", "url", "host", "shard")), blocks, inside, content]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "shard", "blocks", "inside", "content"])

    spread = keyed.join(hosts, "host").withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), F.col("shards")).cast("int"))
    parsed = spread.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "host", "shard").mapInArrow(
        parse, "page_id long, url string, host string, shard int, blocks array<string>, inside array<boolean>, content long"
    )
    parsed = store(parsed, "parsed")
    settled = parsed.where("content IS NULL").withColumn("text", F.array_join("blocks", "\n"))
    settled = settled.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), F.size("blocks").cast("long").alias("n_blocks"), F.lit(0).cast("long").alias("n_repeated"))
    mixed = parsed.where("content IS NOT NULL")
    runs = mixed.groupBy("host", "shard").applyInArrow(_runs, "host string, shard int, run long, content long")
    runs = store(runs, "runs")
    spots = runs.select("host", "shard", "run").distinct()
    # the pages of a run are counted as distinct hashes of pages, its contents by what else those pages have
    several = runs.groupBy("host", "run").agg(F.min("content").alias("low"), F.max("content").alias("high")).where("low < high").select("host", "run")
    several = store(spots.join(several, ["host", "run"]), "several")
    shape = mixed.groupBy("host", "shard")
    vouched = shape.cogroup(several.groupBy("host", "shard")).applyInArrow(_vouch, "host string, run long, content long")
    vouched = store(vouched.distinct(), "vouched")
    contents = if_small(store(vouched.where("run IS NULL").groupBy("host").agg(F.count("*").alias("n")), "contents"))
    seen = vouched.where("run IS NOT NULL").groupBy("host", "run").agg(F.count("*").alias("seen")).where("seen >= 2")
    repeats = store(seen.join(contents, "host").where(F.col("seen") >= F.least(F.lit(FEW), F.col("n"))).select("host", "run"), "repeats")
    back = several.join(if_small(repeats), ["host", "run"])
    judged = shape.cogroup(back.groupBy("host", "shard")).applyInArrow(
        _judge, "page_id long, url string, text string, n_chars long, n_blocks long, n_repeated long"
    )
    return settled.unionByName(judged)
