"""HTML extraction: the article's blocks, and runs that a host's template repeats, found in suffix arrays.

Each page is read once, in linear time, by a tolerant tokenizer into blocks of text, in page order, without what is
never main text by its markup: scripts, styles, menus, page headers, footers, sidebars, notices, adverts, forms,
reader comments. An element that encloses an article or main is not dropped with it. Blocks inside an article (else
main) element are the page's text; all others are its frame. Where a page has neither, all its remaining blocks are
candidates, and repetition on its host decides.

Every page goes through suffix arrays. Those of pages with an article (``frame_runs``) are built over the token streams of
their texts and of their frames: a run that is in the texts and in the frames of ``RUN_PAGES`` distinct pages of
the host and of ``RUN_SHARE`` of them each is a notice, menu or footer that the template puts inside articles too, and blocks
covered by such runs go. Repetition among texts alone says nothing against a block: quotations, licence lines and copied
articles are text. Streams are dealt by ranges of host and page, so that a busy host lies in many tasks and
buckets; runs found there are counted exactly over the whole host from the pages themselves.

Pages without an article are gathered by host, copies of a page once, a busy host in several buckets of a bounded size. The
token streams of a bucket are concatenated, and a suffix array over them, sorted as deep as the least length of a run,
brings equal runs together. A run is boilerplate if it is on ``RUN_PAGES`` distinct pages of its host and on
``RUN_SHARE`` of them, whatever the number of buckets: one that is must be on that share of some bucket's pages (the
pigeonhole again), such runs are counted in all of the host's buckets, and the counts are summed. Blocks of which
``BLOCK_SHARE`` is covered by boilerplate go; any other block stays whole, with the quotations in it. A page that
would lose ``PAGE_SHARE`` of its words is a near copy rather than a frame, and stays whole.

Defined results: null html is empty and gives an empty text; malformed markup is read as far as it goes, a tag or
quoted value that never ends takes the rest of the page, as in browsers; a null url is a host of its own; repeated
rows are each extracted, and copies of a page (equal html, without an article equal blocks) count as one page; pages of any length are read whole; an empty table
gives an empty table; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.urls import host_of
from palimpsest.session import spool

RUN = 8  # tokens
RUN_PAGES, RUN_SHARE = 3, 0.2  # distinct pages of a host, at least, and of all its distinct candidate pages
BLOCK_SHARE, PAGE_SHARE = 0.8, 0.9
BUCKET_CHARS, BUCKET_PAGES = 3 << 20, 200  # of a bucket, on average: characters of text, pages
BROADCAST_BYTES = 16 << 20

#: Quotes count only after =, as in browsers; what was scanned is never given back, so that reading is linear.
_ATTRS = r"(?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(?P<raw>script|style|textarea|title|noscript|template|iframe|svg|select|object|canvas|math|audio|video)(?=[\s/>]|\Z)"
    rf"{_ATTRS}(?:(?<=/)>|>.*?(?:</(?P=raw)\s*+>|\Z)|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?"
    rf"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attrs>{_ATTRS})(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?i)(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav aside footer form menu head dialog button".split())
DROPPED_OUTSIDE = frozenset(["header"])
#: Whole names in class, id and role that mark an element as no part of the main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored promo promos sidebar aside menu"
    " nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices popup modal newsletter"
    " subscribe subscription share sharing social related recommended comment comments disqus replies respond form login"
    " search pagination pager widget toolbar complementary contentinfo alert alertdialog paywall".split()
)
MARKS_OUTSIDE = frozenset("header banner masthead topbar hero".split())
NEVER = frozenset(["html", "body", "main"])
#: Elements that hold no main text even if they hold an article, where another article or main is on the page.
ASIDE = DROPPED - {"form"} | DROPPED_OUTSIDE


def _dropped(tag: str, attrs: str, inside: bool) -> bool:
    if tag in NEVER:
        return False
    if tag in DROPPED or (tag in DROPPED_OUTSIDE and not inside):
        return True
    if not attrs:
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
            continue
        words = set(value.split())
        if words & MARKS and not (tag == "article" and "comment" not in words and "comments" not in words):
            return True
        if not inside and tag != "article" and words & MARKS_OUTSIDE:
            return True
    return False


def blocks_of(html: str | None) -> list[str]:
    """The page's blocks of possible main text, white space collapsed, in page order; the first item
    says what they are: "article" or "page"."""
    kind, blocks, _ = parts_of(html)
    return [kind, *blocks]


def parts_of(html: str | None) -> tuple[str, list[str], list[str]]:
    """"article" or "page", its blocks of possible main text, and the blocks of its frame."""
    out: list[tuple[int, str]] = []  # 4 in an article, 3 in main, 2 and 1 the same in a menu and the like, 0 elsewhere, -1 dropped
    stack: list[tuple[str, bool, int, bool]] = []  # tag, dropped here or above, zone, in a menu and the like
    opened: dict[str, int] = {}  # of each tag, how often it is on the stack
    held: list[str] = []
    away: list[str] = []
    dropped, zone, aside = False, 0, False

    def end_block() -> None:
        for texts, level in ((held, zone), (away, -1)):
            if texts:
                words = unescape("".join(texts)).split()
                texts.clear()
                if words:
                    out.append((level, " ".join(words)))

    def leave(k: int) -> None:
        nonlocal dropped, zone, aside
        for tag, *_ in stack[k:]:
            opened[tag] -= 1
        del stack[k:]
        dropped, zone, aside = stack[-1][1:] if stack else (False, 0, False)

    for m in _TOKEN.finditer(html or ""):
        kind = m.lastgroup
        if kind == "text":
            (away if dropped else held).append(m["text"])
        elif kind == "attrs":
            tag = m["start"].lower()
            attrs = m["attrs"]
            if tag in VOID:
                if not dropped:
                    if tag in BLOCK:
                        end_block()
                    elif tag in ("br", "img"):
                        held.append(" ")
                continue
            block = tag in BLOCK
            if block:
                end_block()
                k = len(stack)
                while k and stack[k - 1][0] == "p":  # a block ends an open paragraph
                    k -= 1
                if tag in ("li", "dt", "dd", "td", "th", "tr") and k and stack[k - 1][0] == tag:
                    k -= 1
                if k < len(stack):
                    leave(k)
            if attrs.endswith("/") and not block:
                continue
            gone = _dropped(tag, attrs, zone > 0)
            if dropped and not gone and zone in (0, 3) and tag in ("article", "main"):  # what encloses it doesn't count
                dropped = False
                zone = (2 if tag == "article" else 1) if aside else zone
            if block or gone:
                if gone and not block:
                    end_block()
                zone = max(zone, (2 if tag == "article" and not gone else 1 if tag == "main" else 0) + 2 * (zone not in (1, 2)) * (tag in ("article", "main") and not gone))
                dropped = dropped or gone
                aside = aside or (dropped and tag in ASIDE)
                stack.append((tag, dropped, zone, aside))
                opened[tag] = opened.get(tag, 0) + 1
        elif kind == "end":
            tag = m["end"].lower()
            if not opened.get(tag):
                if tag in BLOCK:
                    end_block()
                continue
            end_block()
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            leave(k)
        elif kind == "cdata" and not dropped:
            held.append(m["cdata"].replace("&", "&amp;"))
    end_block()
    for level in (4, 3, 2, 1):
        if any(z >= level for z, _ in out):
            return "article", [t for z, t in out if z >= level], [t for z, t in out if z < level]
    return "page", [t for z, t in out if z >= 0], [t for z, t in out if z < 0]


def ranks(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Rank of each position's suffix by its first ``depth`` tokens: prefix doubling, as for a suffix
    array, that stops once the order is deep enough. Equal ranks: equal runs of ``depth`` tokens."""
    rank, have = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while have < depth:
        step = min(have, depth - have)
        later = np.full(len(rank), -1, np.int64)
        later[: len(rank) - step] = rank[step:]
        key = rank * (len(rank) + 1) + later + 1
        rank, have = np.unique(key, return_inverse=True)[1].astype(np.int64), have + step
    return rank


class Streams:
    """The concatenated token streams of distinct pages, each given as its blocks, and their suffix array."""

    def __init__(self, pages: list[list[str]], run: int = RUN):
        number: dict[str, int] = {}
        stream, owner, self.spans = [], [], []
        for k, blocks in enumerate(pages):
            at = []
            for b in blocks:
                words = b.split(" ")
                at.append((len(stream), len(stream) + len(words)))
                stream += [number.setdefault(w, len(number)) for w in words]
            stream.append(-1 - k)  # pages are parted by tokens of their own, so that no run spans two
            owner += [k] * (len(stream) - len(owner))
            self.spans.append(at)
        self.run, self.size = run, len(stream)
        tokens, page = np.array(stream, dtype=np.int64), np.array(owner, dtype=np.int64)
        if self.size < run:
            self.rank, self.pages, self.hashes = (np.empty(0, dtype=np.int64) for _ in range(3))
            return
        self.rank = ranks(tokens, run)
        order = np.lexsort((page, self.rank))  # the suffix array, ties by page
        r, p = self.rank[order], page[order]
        fresh = np.ones(len(r), dtype=np.int64)
        fresh[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
        self.pages = np.bincount(r, weights=fresh).astype(np.int64)  # of each rank's run
        where = order[np.searchsorted(r, np.arange(len(self.pages)))]
        parts = np.concatenate([[0], np.cumsum(tokens < 0)])
        ends = np.minimum(where + run, len(tokens))
        whole = (ends == where + run) & (parts[ends] == parts[where])
        self.pages[~whole] = 0  # what runs over a page's end is no run
        names = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in number] or [0], dtype=np.uint64)
        values = np.concatenate([names[np.maximum(tokens, 0)], np.zeros(run, dtype=np.uint64)])
        self.hashes = np.zeros(len(where), dtype=np.uint64)  # of each rank's run, the same in any bucket
        for k in range(run):
            self.hashes = self.hashes * np.uint64(0x9E3779B97F4A7C15) + values[where + k]
        self.hashes = self.hashes.view(np.int64)

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs that are on ``least`` pages or more, and on how many."""
        often = np.nonzero(self.pages >= max(least, 1))[0]
        return self.hashes[often], self.pages[often]

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """On how many pages each wanted run is."""
        known = np.nonzero(self.pages > 0)[0]
        if not len(known):
            return np.zeros(len(wanted), dtype=np.int64)
        known = known[np.argsort(self.hashes[known])]
        at = known[np.minimum(np.searchsorted(self.hashes[known], wanted), len(known) - 1)]
        return np.where(self.hashes[at] == wanted, self.pages[at], 0)

    def covered(self, common: np.ndarray) -> np.ndarray:
        """Positions in one of the runs ``common``."""
        edge = np.zeros(self.size + 1, dtype=np.int64)
        if len(self.rank) and len(common):
            hits = np.nonzero((np.isin(self.hashes, common) & (self.pages > 0))[self.rank])[0]
            np.add.at(edge, hits, 1)
            np.add.at(edge, np.minimum(hits + self.run, self.size), -1)
        return np.cumsum(edge[:-1]) > 0

    def kept(self, pages: list[list[str]], common: np.ndarray) -> list[str]:
        """The pages' texts without their covered blocks."""
        gone = self.covered(common)
        texts = []
        for blocks, spans in zip(pages, self.spans, strict=True):
            left = [b for b, (i, j) in zip(blocks, spans, strict=True) if gone[i:j].sum() < BLOCK_SHARE * (j - i)]
            words = sum(j - i for i, j in spans)
            lost = words - sum(b.count(" ") + 1 for b in left)
            texts.append("\n".join(blocks if lost >= PAGE_SHARE * words else left))
        return texts


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of an odd number and of its inverse modulo 2^64."""
    base = 0x9E3779B97F4A7C15
    made = (np.full(size, x, dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))
    return tuple(np.cumprod(x, dtype=np.uint64) for x in made)


_BYTES = np.random.default_rng(5).integers(0, 1 << 63, 256, dtype=np.uint64)


def numbers_of(blocks: list[str]) -> np.ndarray:
    """The blocks' words as 32-bit hashes: polynomials of their bytes, from differences of running sums."""
    if not blocks:
        return np.empty(0, dtype=np.uint32)
    data = np.frombuffer(" ".join(blocks).encode("utf-8", "surrogatepass"), dtype=np.uint8)
    power, back = _powers(1 << max(len(data).bit_length(), 16))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * power[: len(data)], out=sums[1:])
    ends = np.append(np.nonzero(data == 32)[0], len(data))
    starts = np.append(0, ends[:-1] + 1)
    h = (sums[ends] - sums[starts]) * back[starts]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(32)).astype(np.uint32)


def run_hashes(numbers: np.ndarray) -> np.ndarray:
    """Of each run of ``RUN`` words."""
    n = max(len(numbers) - RUN + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(RUN):
        h = (h ^ numbers[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def runs_of_pages(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of pages' streams, by hash, and on how many pages each is: equal ranks of the suffix array over all streams."""
    long = [s for s in streams if len(s) >= RUN]
    if not long:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    tokens = np.concatenate([np.append(s.astype(np.int64), -1 - k) for k, s in enumerate(long)])
    page = np.repeat(np.arange(len(long)), [len(s) + 1 for s in long])
    within = np.concatenate([np.arange(len(s), -1, -1) for s in long]) >= RUN  # what runs over a page's end is no run
    rank, page = ranks(tokens, RUN)[within], page[within]
    hashes = np.concatenate([run_hashes(s) for s in long])
    order = np.lexsort((page, rank))
    r, p = rank[order], page[order]
    first = np.append(True, r[1:] != r[:-1])
    fresh = first | np.append(True, p[1:] != p[:-1])
    return hashes[order[first]], np.add.reduceat(fresh.astype(np.int64), np.nonzero(first)[0])


OWN, FRAME, SIZE, BOTH, LOOSE = range(5)  # what a row of ``frame_candidates`` tells of its host


def frame_candidates(named: DataFrame, bucket_chars: int, bucket_pages: int) -> DataFrame:
    """host, run, what, pages: for each bucket of a host's distinct pages with an article its number of pages (SIZE), runs on
    ``RUN_SHARE`` of its texts (OWN) and of its frames (FRAME); for a host that is one bucket only the runs it wants (BOTH). What is on
    that share of a host is so on that of some bucket. LOOSE: there are pages without an article."""

    def read(batches):
        for batch in batches:
            rows = []
            for html in batch.column(2):
                kind, *parts = parts_of(html.as_py())
                rows.append([numbers_of(p).tobytes() for p in parts] if kind == "article" else (None, None))
            made = [pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["host", "page", "own", "frame"])

    def told(host, whole, pages):
        (own, frame), n = zip(*pages, strict=True), len(pages)
        least = max(RUN_PAGES if whole else 1, int(np.ceil(n * RUN_SHARE)))
        rows = [(np.zeros(1, dtype=np.int64), np.full(1, n), SIZE)]
        often = []
        for what, streams in ((OWN, own), (FRAME, frame)):
            runs, count = runs_of_pages(list(streams))
            often.append(runs[count >= least])
            rows.append((often[-1], count[count >= least], what))
        if whole:
            both = np.intersect1d(*often)
            rows = [rows[0], (both, np.zeros(len(both), dtype=np.int64), BOTH)]
        for runs, count, what in rows:
            k = len(runs)
            yield pa.RecordBatch.from_arrays([pa.array([host] * k, pa.string()), pa.array(runs, pa.int64()), pa.array([what] * k, pa.int32()), pa.array(count, pa.int64())], names=["host", "run", "what", "pages"])

    def frequent(batches):
        held, words, at, last, begun, loose = [], 0, None, None, False, False  # begun: the host's first page is here
        for batch in batches:
            for host, page, own, frame in zip(*(batch.column(k) for k in range(4)), strict=True):
                host, page, own = host.as_py(), page.as_py(), own.as_py()
                if own is None:
                    loose = True
                    continue
                if (host, page) == (at, last):
                    continue
                if held and (host != at or len(held) >= bucket_pages or words >= bucket_chars // 6):
                    yield from told(at, begun and host != at, held)
                    held, words = [], 0
                    begun = host != at
                held.append((np.frombuffer(own, np.uint32), np.frombuffer(frame.as_py(), np.uint32)))
                words += len(own) // 4
                at, last = host, page
        if held:
            yield from told(at, False, held)
        if loose:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([LOOSE], pa.int32()), pa.array([1], pa.int64())], names=["host", "run", "what", "pages"])

    streams = named.select("host", F.xxhash64("html").alias("page"), "html").mapInArrow(read, "host string, page bigint, own binary, frame binary")
    dealt = streams.repartitionByRange("host", "page").sortWithinPartitions("host", "page")
    return spool(dealt.mapInArrow(frequent, "host string, run bigint, what int, pages bigint"), "frame-candidates")


def by_host(runs: DataFrame) -> DataFrame:
    """host, runs: sorted; to be broadcast if that is small. ``runs``: written (host, run)."""
    size = runs.agg(F.sum(F.coalesce(F.octet_length("host"), F.lit(0)) + 16)).first()[0] or 0
    lists = runs.groupBy("host").agg(F.sort_array(F.collect_set("run")).alias("runs"))  # at most five pages' worth
    return F.broadcast(lists) if size <= BROADCAST_BYTES else lists


def frame_runs(named: DataFrame, found: DataFrame) -> DataFrame:
    """host, run: those in the texts and in the frames of enough of the host's distinct pages. ``found``: ``frame_candidates``."""
    of = lambda what: found.where(F.col("what") == what).select("host", "run")
    wanted = spool(of(OWN).distinct().join(of(FRAME).distinct(), ["host", "run"], "left_semi"), "wanted-runs")
    if wanted.isEmpty():
        return spool(of(BOTH), "frame-runs")

    def hits(batches):
        for batch in batches:
            rows = []
            for html, runs in zip(batch.column(2), batch.column(3), strict=True):
                kind, *parts = parts_of(html.as_py())
                wanted = runs.values.to_numpy()
                rows.append([np.intersect1d(run_hashes(numbers_of(p)), wanted) for p in parts] if kind == "article" else [[], []])
            made = [pa.array([r[k] for r in rows], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["host", "page", "own", "frame"])

    met = named.select("host", F.xxhash64("html").alias("page"), "html").join(by_host(wanted), "host").mapInArrow(hits, "host string, page bigint, own array<bigint>, frame array<bigint>")
    met = met.where(F.size("own") + F.size("frame") > 0).dropDuplicates(["host", "page"])
    tagged = lambda c: F.transform(c, lambda x: F.struct(x.alias("run"), F.lit(c == "own").cast("int").alias("own")))
    counts = met.select("host", F.explode(F.concat(tagged("own"), tagged("frame"))).alias("x")).groupBy("host", "x.run")
    counts = counts.agg(F.sum("x.own").alias("own"), F.sum(1 - F.col("x.own")).alias("frame"))
    least = found.where(F.col("what") == SIZE).groupBy("host").agg(F.greatest(F.lit(RUN_PAGES), F.ceil(F.sum("pages") * F.lit(RUN_SHARE))).alias("least"))
    common = counts.join(least, "host").where("own >= least and frame >= least").select("host", "run")
    return spool(common.unionByName(of(BOTH)).distinct(), "frame-runs")


def without_frame(blocks: list[str], common: np.ndarray) -> list[str]:
    """The blocks that runs of the frame don't cover; all, if next to nothing were left."""
    size = np.array([b.count(" ") + 1 for b in blocks], dtype=np.int64)
    edge = np.zeros(size.sum() + 1, dtype=np.int64)
    hits = np.nonzero(np.isin(run_hashes(numbers_of(blocks)), common))[0]
    if not len(hits):
        return blocks
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + RUN, -1)
    gone = np.add.reduceat((np.cumsum(edge[:-1]) > 0).astype(np.int64), np.cumsum(size) - size)
    stays = gone < BLOCK_SHARE * size
    return blocks if size[~stays].sum() >= PAGE_SHARE * size.sum() else [b for b, k in zip(blocks, stays, strict=True) if k]


def clean_hosts(loose: DataFrame, bucket_chars: int, bucket_pages: int) -> DataFrame:
    """host, page, text: the cleaned text of each distinct page (host, page, blocks) of ``loose``."""
    chars = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.length(b) + 1)
    distinct = spool(loose.select("host", "page", "blocks").dropDuplicates(["host", "page"]), "distinct-pages")
    number = F.greatest(F.ceil(F.sum(chars) / bucket_chars), F.ceil(F.count("*") / bucket_pages), F.lit(1)).cast("int")
    limit = F.greatest(F.lit(RUN_PAGES), F.ceil(F.count("*") * F.lit(RUN_SHARE))).cast("long")
    hosts = spool(distinct.groupBy("host").agg(number.alias("n"), limit.alias("least")), "host-sizes")
    dealt = distinct.join(hosts, "host").select("host", F.pmod("page", "n").cast("int").alias("bucket"), "n", "least", "page", "blocks")
    buckets = lambda rows: rows.groupBy("host", "bucket")

    def often(table: pa.Table) -> pa.Table:
        n, least = table.column("n")[0].as_py(), table.column("least")[0].as_py()
        runs, pages = Streams(table.column("blocks").to_pylist()).runs(-(-least // n))
        host = pa.array([table.column("host")[0].as_py()] * len(runs), pa.string())
        return pa.table({"host": host, "run": pa.array(runs, pa.int64()), "pages": pa.array(pages, pa.int64())})

    def count(pages: pa.Table, runs: pa.Table) -> pa.Table:
        wanted = runs.column("run").to_numpy()
        found = Streams(pages.column("blocks").to_pylist()).counts(wanted) if pages.num_rows else np.zeros(len(wanted), dtype=np.int64)
        return pa.table({"host": runs.column("host"), "run": runs.column("run"), "pages": pa.array(found, pa.int64())})

    def cut(pages: pa.Table, runs: pa.Table) -> pa.Table:
        blocks = pages.column("blocks").to_pylist()
        texts = Streams(blocks).kept(blocks, runs.column("run").to_numpy()) if blocks else []
        return pa.table({"host": pages.column("host"), "page": pages.column("page"), "text": pa.array(texts, pa.string())})

    def sent(runs: DataFrame) -> DataFrame:
        """To every bucket of their host."""
        return buckets(runs.join(hosts, "host").select("host", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("bucket"), "run"))

    fields = "host string, run bigint, pages bigint"
    found = spool(buckets(dealt).applyInArrow(often, fields), "frequent-runs")
    split = hosts.where("n > 1").select("host")
    wanted = found.join(split, "host", "left_semi").select("host", "run").distinct()
    counted = buckets(dealt.where("n > 1")).cogroup(sent(wanted)).applyInArrow(count, fields).groupBy("host", "run").agg(F.sum("pages").alias("pages"))
    common = counted.unionByName(found.join(split, "host", "left_anti")).join(hosts, "host").where("pages >= least").select("host", "run")
    return buckets(dealt).cogroup(sent(spool(common, "common-runs"))).applyInArrow(cut, "host string, page bigint, text string")


def extract(
    pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", bucket_chars: int = BUCKET_CHARS, bucket_pages: int = BUCKET_PAGES
) -> DataFrame:
    """id, url, text for each row of ``pages``. Pages with an article are read twice, only their streams are shuffled; what was
    read of others is written once."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def parse(batches):
        for batch in batches:
            found = [parts_of(h.as_py())[:2] for h in batch.column(3)]
            whole = pa.array([kind == "article" for kind, _ in found], pa.bool_())
            texts = []
            for (kind, blocks), runs in zip(found, batch.column(4), strict=True):
                cut = kind == "article" and blocks and runs.is_valid
                texts.append("\n".join(without_frame(blocks, runs.values.to_numpy()) if cut else blocks) if kind == "article" else None)
            loose = pa.array([None if kind == "article" else blocks for kind, blocks in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), whole, pa.array(texts, pa.string()), loose], names=["id", "url", "host", "whole", "text", "blocks"])

    named = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    found = frame_candidates(named, bucket_chars, bucket_pages)
    common = frame_runs(named, found)
    none = F.lit(None).cast("array<bigint>").alias("runs")
    led = named.select("*", none) if common.isEmpty() else named.join(by_host(common), "host", "left").select(*named.columns, "runs")
    parsed = led.mapInArrow(parse, f"id {kinds[id_col]}, url {kinds[url_col]}, host string, whole boolean, text string, blocks array<string>")
    out = lambda rows: rows.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
    whole = parsed.where("whole")
    if found.where(F.col("what") == LOOSE).isEmpty():
        return out(whole)
    loose = spool(parsed.where("not whole").select("id", "url", "host", F.xxhash64("blocks").alias("page"), "blocks"), "pages")
    cleaned = spool(clean_hosts(loose, bucket_chars, bucket_pages), "clean-pages")
    return out(whole).unionByName(out(loose.drop("blocks").join(cleaned, ["host", "page"])))
