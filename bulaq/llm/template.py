"""HTML extraction by deduced templates: tokens with equal occurrence vectors across the pages of a host.

A token is a tag, a run of text between two tags, or a word of such a run, together with the path of tags above it.
Its occurrence vector (how often it is on each page of the host) is summed up as support, total and sums of page
hashes, so that vectors are built by one grouping over all pages; identical pages of a host count once. Tokens of one
host with the same vector form an equivalence class; a class of two or more tokens is part of the template. Tags need
to be on ``MIN_SHARE`` of the host's pages, runs of text on more than ``MIN_TEXT_SHARE``, words too, on a host of at
least ``MIN_WORD_PAGES`` pages: on fewer, the words of the content have equal vectors by chance.

A task hands over the tokens that are on at least half of that share of the host's pages it saw. What it keeps back
can be on less than that; if the share a token may have in all is still enough, its vector is counted again, whole, in
a second pass over the pages of its host. So vectors are exact, and the words of the content are not shuffled.

The class that is once on each of most pages is the root. Its tokens, in the order of their mean position, give the
gaps. Any other class is nested where it opens: an instance begins with the class's first token, goes through the
others in their order and ends with the last one or where the instance around it goes on; a token out of that order
opens nothing. ``at`` of a slot is the path of instances around it: the root's gap, then for each nested instance the
class, how many of it came before on the page, and the place in it. The texts between template tokens are the slots;
tokens of text that belong to the template are left out of them wherever they stand.

Time is linear in a page, whatever its markup: an unfinished comment, quote or script ends the attempt to read such a
thing for the rest of the page. Defined results: a null page gives null text and no slots, an empty one empty text; a
page whose URL is null or has no host belongs to the host ''; a host with one distinct page has no template, so all
its text is in slots; repeated rows are one page to the template and are each extracted; an empty table gives an empty
result; other columns are carried along, and result columns whose names are taken get underscores.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as A
from .tables import BROADCAST_IDS, extended, kept, scope, staged

MIN_SHARE = 0.3
MIN_TEXT_SHARE = 0.5
MIN_WORD_PAGES = 8
#: Vectors that a task holds at most before it hands them over, about 60 bytes each.
HELD_TOKENS = 2_000_000
#: Characters of pages that are taken apart at once, unless one page has more.
RUN_CHARS = 6_000_000
#: Tokens of all templates that are sent to every executor at most, about 40 bytes each; more are joined by host,
#: where adaptive execution splits the pages of a large host, whose template is one row.
BROADCAST_TOKENS = 2_000_000
TAG, WORD, NODE = 0, 1, 2

_VALUE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
_STRICT = re.compile(rf"<(/?[a-zA-Z][^\s/>]*+)({_VALUE})>")
_LENIENT = re.compile(r"<(/?[a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAME = re.compile(r"</?[a-zA-Z]")
_KEPT = re.compile(r"""\b(class|id|itemprop|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++)""")
_RAW = {n: re.compile(rf"</{n}\s*+>", re.I) for n in ("script", "style", "noscript")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A tag that ends an open one of the second column, unless one of the third was opened since.
_CLOSES = {
    "p": (("p",), ("td", "th", "table", "button", "caption", "object")), "li": (("li",), ("ul", "ol", "menu")), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table",)), "th": (("td", "th"), ("table",)), "option": (("option",), ("select",)), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
}
#: A page's weight is two numbers of so many bits, whose sums over 2**35 occurrences fit 64 bits.
_HALF = 28
_PLACES = 1 << 20
_SALT = (A.U64(0x243F6A8885A308D3), A.U64(0x13198A2E03707344), A.U64(0xA4093822299F31D0))
_ODD = A.U64(0x9E3779B97F4A7C15)
_PATHS: dict[tuple[int, str], int] = {}
_TAGS: dict[tuple[str, int], int] = {}


def host_column(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _below(path: int, name: str) -> int:
    """Number of the path ``path``/``name``, whatever its depth."""
    got = _PATHS.get((path, name))
    if got is None:
        if len(_PATHS) > 200_000:
            _PATHS.clear()
        got = _PATHS[path, name] = _digest(f"{path:x}/{name}")
    return got


def runs(page: str) -> Iterator[tuple[str, str, int, bool]]:
    """(tag token or '', text or '', path, whether it is of the title) in order, without scripts, styles and comments."""
    stack: list[str] = []
    paths = [0]
    open_at: dict[str, list[int]] = {}
    at = i = 0
    last = page.rfind(">")
    lenient, endless = False, set()

    def cut(to: int) -> None:
        while len(stack) > to:
            open_at[stack.pop()].pop()
            paths.pop()

    def title() -> bool:
        return bool(stack) and stack[-1] == "title" and not open_at.get("body")

    while True:
        j = page.find("<", i)
        if j < 0 or j >= last:
            break
        c = page[j + 1]
        if c == "!" or c == "?":
            end = -1
            if c == "!" and "--" not in endless and page.startswith("<!--", j):
                end = page.find("-->", j + 4)
                if end < 0:
                    endless.add("--")
            if j > at:
                yield "", page[at:j], paths[-1], title()
            if end >= 0:
                at = i = end + 3
                continue
            at = i = page.find(">", j) + 1
            yield page[j:at].lower(), "", paths[-1], False
            continue
        m = None if lenient else _STRICT.match(page, j)
        if m is None:
            if not _NAME.match(page, j):
                i = j + 1
                continue
            lenient = True
            m = _LENIENT.match(page, j)
        if j > at:
            yield "", page[at:j], paths[-1], title()
        at = i = m.end()
        name = m.group(1).lower()
        if name[0] == "/":
            where = open_at.get(name[1:])
            if where:
                cut(where[-1])
            yield f"<{name}>", "", paths[-1], False
            continue
        more = m.group(2)
        if name in _RAW and name not in endless:
            end = _RAW[name].search(page, at)
            if end:
                at = i = end.end()
                continue
            endless.add(name)
        if name in _CLOSES:
            of, within = _CLOSES[name]
            here = max((open_at[n][-1] for n in of if open_at.get(n)), default=-1)
            if here >= 0 and here > max((open_at[n][-1] for n in within if open_at.get(n)), default=-1):
                cut(here)
        yield (f"<{name} {' '.join(a + b for a, b in _KEPT.findall(more))}>" if "=" in more else f"<{name}>"), "", paths[-1], False
        if name not in _VOID and not more.endswith("/"):
            open_at.setdefault(name, []).append(len(stack))
            stack.append(name)
            paths.append(_below(paths[-1], name))
    if at < len(page):
        yield "", page[at:], paths[-1], title()


class Parts:
    """Pages taken apart: the keys of all their tokens as arrays, page by page."""

    def __init__(self, pages: list[str]):
        tags: list[int] = []
        tag_page, tag_place, node_page, node_place, node_path = [], [], [], [], []
        self.nodes: list[str] = []
        #: For each page its events: the number of a tag, or of a node as -1 - number.
        self.events: list[list[int]] = []
        self.titles: list[list[str]] = []
        for p, page in enumerate(pages):
            events: list[int] = []
            titles: list[str] = []
            for tag, text, path, title in runs(page):
                if tag:
                    key = _TAGS.get((tag, path))
                    if key is None:
                        if len(_TAGS) > 200_000:
                            _TAGS.clear()
                        key = _TAGS[tag, path] = _digest(f"{path:x}\0{tag}")
                    tag_page.append(p), tag_place.append(len(events))
                    events.append(len(tags))
                    tags.append(key)
                elif title:
                    titles.append(text)
                elif not text.isspace():
                    node_page.append(p), node_place.append(len(events)), node_path.append(path)
                    events.append(-1 - len(self.nodes))
                    self.nodes.append(text)
            self.events.append(events)
            self.titles.append(titles)
        ints = lambda a: np.array(a, np.int64)
        self.tag_key = A.mix(np.array(tags, A.U64) + _SALT[TAG])
        codes, offsets = A.code_points(pa.array(self.nodes, pa.string()))
        kind = A.kinds()[codes]
        starts, ends = A.word_spans((kind != A.SPACE) & (kind != A.NEWLINE), offsets)
        h = A.span_hashes(codes, starts, ends)
        self.word_node = np.searchsorted(offsets, starts, side="right") - 1
        self.first_word = np.searchsorted(self.word_node, np.arange(len(self.nodes) + 1))
        within = np.arange(len(h)) - self.first_word[self.word_node]
        path = np.array(node_path, A.U64)
        self.word_key = A.mix((h ^ path[self.word_node]) + _SALT[WORD]) if len(h) else h
        runs_of = np.add.reduceat(A.mix(h + within.astype(A.U64) * _ODD), self.first_word[:-1]) if len(h) else h
        self.node_key = A.mix((runs_of ^ path) + _SALT[NODE])
        node_page, node_place, tag_place = ints(node_page), ints(node_place), ints(tag_place)
        size = np.array([max(1, len(e)) for e in self.events], np.int64)
        tag_page = ints(tag_page)
        count = np.diff(self.first_word)
        #: key, kind, page and place (in parts of _PLACES) of all tokens, by page.
        page = np.concatenate([tag_page, node_page, node_page[self.word_node]])
        place = np.concatenate([tag_place.astype(float), node_place.astype(float), node_place[self.word_node] + (within + 1) / (count[self.word_node] + 1)])
        key = np.concatenate([self.tag_key, self.node_key, self.word_key])
        sort = np.repeat(np.array([TAG, NODE, WORD], np.int8), [len(tag_page), len(node_page), len(h)])
        order = np.lexsort((place, page))
        self.page, self.key, self.kind = page[order], key[order], sort[order]
        self.place = (place[order] / size[self.page] * _PLACES).astype(np.int64) if len(page) else page


def token_key(kind: int, token: str, path: int) -> int:
    """The key of one token, as Parts has it."""
    if kind == TAG:
        return int(A.mix(np.array([_digest(f"{path:x}\0{token}")], A.U64) + _SALT[TAG])[0])
    h = np.array([A.hash_word(w) for w in token.split()], A.U64)
    if kind == NODE:
        h = np.array([np.add.reduce(A.mix(h + np.arange(len(h), dtype=A.U64) * _ODD))], A.U64)
    return int(A.mix((h ^ A.U64(path)) + _SALT[kind])[0])


def _of_host(key: np.ndarray, host: np.ndarray) -> np.ndarray:
    return A.mix(key + host)


_HOSTS: dict[str, int] = {}


def _host_hash(host: str) -> int:
    got = _HOSTS.get(host)
    if got is None:
        if len(_HOSTS) > 200_000:
            _HOSTS.clear()
        got = _HOSTS[host] = _digest(host)
    return got


_FIELDS = ["kind", "support", "total", "print", "print2", "place", "covered"]
_VECTOR = "host string, key bigint, " + ", ".join(f"{f} bigint" for f in _FIELDS)
_PAGES = -1


class _Held:
    """Vectors of the tokens of all hosts on the pages seen since the last flush."""

    def __init__(self, only: A.HashIndex | None, local: float):
        self.only, self.local = only, local
        self.clear()

    def clear(self) -> None:
        self.hosts: dict[str, int] = {}
        self.pages: list[int] = []
        self.rows: list[np.ndarray] = []  # columns: key of host and token, host, key, kind, support, total, print, print2, place
        self.n = 0

    def add(self, hosts: list[str], pages: list[str]) -> None:
        for h in hosts:
            i = self.hosts.setdefault(h, len(self.hosts))
            if i == len(self.pages):
                self.pages.append(0)
            self.pages[i] += 1
        parts = Parts(pages)
        host = np.array([self.hosts[h] for h in hosts], np.int64)
        full = _of_host(parts.key, np.array([_host_hash(h) for h in hosts], A.U64)[parts.page])
        page, key, kind, place = parts.page, parts.key, parts.kind, parts.place
        if self.only is not None:
            some = np.flatnonzero(self.only.find(full) >= 0)
            full, page, key, kind, place = full[some], page[some], key[some], kind[some], place[some]
        if not len(full):
            return
        weight = np.array([_digest(p) for p in pages], A.U64)
        order = np.argsort(full, kind="stable")  # pages stay in order within a token
        f, p = full[order], page[order]
        edge = np.flatnonzero(np.append(True, (f[1:] != f[:-1]) | (p[1:] != p[:-1])))
        count = np.diff(np.append(edge, len(f)))
        f, p, at = f[edge], p[edge], order[edge]
        token = np.flatnonzero(np.append(True, f[1:] != f[:-1]))
        add = lambda v: np.add.reduceat(v, token)
        w0, w1 = (weight & A.U64((1 << _HALF) - 1)).astype(np.int64)[p], (weight >> A.U64(64 - _HALF)).astype(np.int64)[p]
        rep = at[token]
        self.rows.append(np.stack([f[token].view(np.int64), host[page[rep]], key[rep].view(np.int64), kind[rep].astype(np.int64), np.diff(np.append(token, len(f))), add(count), add(w0 * count), add(w1 * count), add(place[at])], 1))
        self.n += len(token)

    def merge(self) -> None:
        rows = np.concatenate(self.rows)
        order = np.argsort(rows[:, 0], kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        self.rows = [np.concatenate([rows[first, :4], np.add.reduceat(rows[:, 4:], first, axis=0)], 1)]
        self.n = len(first)

    def out(self) -> pa.RecordBatch | None:
        if not self.pages:
            return None
        names, seen = pa.array(list(self.hosts), pa.string()), np.array(self.pages, np.int64)
        n = len(seen)
        zero = np.zeros(n, np.int64)
        cols = [np.arange(n), zero, zero + _PAGES, seen, seen, zero, zero, zero, seen]
        if self.rows:
            self.merge()
            r = self.rows[0]
            least = self.local * np.where(r[:, 3] == TAG, MIN_SHARE, MIN_TEXT_SHARE) * seen[r[:, 1]]
            r = r[r[:, 4] >= least]
            cols = [np.concatenate([c, x]) for c, x in zip(cols, [*(r[:, i] for i in range(1, 9)), seen[r[:, 1]]])]
        got = [names.take(pa.array(cols[0])), *(pa.array(np.ascontiguousarray(c)) for c in cols[1:])]
        self.clear()
        return pa.RecordBatch.from_arrays(got, names=["host", "key", *_FIELDS])


def _page_runs(pages: pa.Array) -> Iterator[tuple[int, int]]:
    return A.row_runs(A.as_text(pages), RUN_CHARS)


def vectors(pages: DataFrame, only: A.HashIndex | None = None, local: float = 0.5, held_tokens: int = HELD_TOKENS) -> DataFrame:
    """_VECTOR of pages (host, html), one row for each task's share of a token's pages.

    ``covered`` is how many pages of the host that share had; rows of the kind _PAGES only count pages. Tokens on less
    than ``local`` times the share that a template needs are kept back, and all but those of ``only``, if that is given.
    """
    shared = None if only is None else pages.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(None if shared is None else shared.value, local)
        for batch in batches:
            hosts, text = batch.column(0), batch.column(1)
            for lo, hi in _page_runs(text):
                held.add(hosts.slice(lo, hi - lo).to_pylist(), text.slice(lo, hi - lo).to_pylist())
                if held.n > held_tokens:
                    held.merge()
                    if held.n > held_tokens // 2:
                        yield held.out()
        got = held.out()
        if got is not None:
            yield got

    return pages.select("host", "html").mapInArrow(run, _VECTOR)


def _distinct_pages(rows: DataFrame) -> DataFrame:
    """Pages (host, html) without null ones, identical pages of a host once; only such pages are shuffled."""
    rows = rows.where("html is not null").withColumn("h", F.xxhash64("html"))
    copies = staged(rows.groupBy("host", "h").count().where("count > 1").select("host", "h"))
    n = copies.count()
    if not n:
        return rows.select("host", "html")
    copies = F.broadcast(copies) if n <= BROADCAST_IDS // 4 else copies
    once = rows.join(copies, ["host", "h"], "left_semi").groupBy("host", "h").agg(F.first("html").alias("html"))
    return rows.join(copies, ["host", "h"], "left_anti").select("host", "html").union(once.select("host", "html"))


def templates(pages: DataFrame, url: str = "url", html: str = "html", local: float = 0.5, held_tokens: int = HELD_TOKENS, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """(host, keys, classes, places, sizes), staged: one row per host with a template; class 0 is the root."""
    with scope():
        return kept(_templates(pages, url, html, local, held_tokens, broadcast_tokens))


def _summed(v: DataFrame) -> DataFrame:
    return v.groupBy("host", "key", "kind").agg(*[F.sum(f).alias(f) for f in _FIELDS[1:]])


def _templates(pages: DataFrame, url: str, html: str, local: float, held_tokens: int, broadcast_tokens: int) -> DataFrame:
    rows = _distinct_pages(pages.select(host_column(url).alias("host"), F.col(html).cast("string").alias("html")))
    v = staged(_summed(vectors(rows, None, local, held_tokens)))
    of = v.where(F.col("kind") == _PAGES).select("host", F.col("support").alias("pages")).where("pages > 1")
    share = F.when(F.col("kind") == TAG, MIN_SHARE).otherwise(MIN_TEXT_SHARE)
    # What was kept back may be added to a token's support; where that decides, the vector is counted again.
    most = F.col("support") + local * share * (F.col("pages") - F.col("covered"))
    v = staged(v.where(F.col("kind") != _PAGES).join(of, "host").where((most >= share * F.col("pages")) & ((F.col("kind") != WORD) | (F.col("pages") >= MIN_WORD_PAGES))))
    again = v.where("covered < pages").select("host", "key", "kind", "pages")
    n = again.count()
    if n:
        hosts = F.broadcast(again.select("host").distinct()) if n <= BROADCAST_IDS // 4 else again.select("host").distinct()
        index = None
        if n <= broadcast_tokens:
            got = again.select("host", "key").toArrow()
            host = np.array([_host_hash(h) for h in got.column("host").to_pylist()], A.U64)
            index = A.HashIndex(np.unique(_of_host(got.column("key").to_numpy().view(A.U64), host)))
        whole = _summed(vectors(rows.join(hosts, "host", "left_semi"), index, 0.0, held_tokens)).join(again, ["host", "key", "kind"])
        v = v.where("covered = pages").unionByName(whole.select(v.columns))
    enough = F.when(F.col("kind") == TAG, F.col("support") >= MIN_SHARE * F.col("pages")).otherwise(F.col("support") > MIN_TEXT_SHARE * F.col("pages"))
    v = v.where(enough & (F.col("support") > 1))
    v = v.withColumn("size", F.expr("count(*) over (partition by host, support, total, print, print2)")).where("size > 1")
    v = v.withColumn("cls", F.expr("dense_rank() over (partition by host order by (total = support) desc, support desc, size desc, total, print, print2)").cast("int"))
    v = v.withColumn("cls", F.col("cls") - F.expr("int(max(int(total = support)) over (partition by host))"))  # no class 0 if none is a root
    v = v.withColumn("nth", F.expr("row_number() over (partition by host, cls order by place / support, key)").cast("int") - 1)
    each = F.sort_array(F.collect_list(F.struct("key", "cls", "nth", F.col("size").cast("int").alias("size"))))
    return staged(v.groupBy("host").agg(each.alias("t")).select("host", F.col("t.key").alias("keys"), F.col("t.cls").alias("classes"), F.col("t.nth").alias("places"), F.col("t.size").alias("sizes")))


class Templates:
    """The templates of some hosts: class, place in it and size of the class of each token."""

    def __init__(self, hosts: list[str], keys: list[np.ndarray], classes: list[np.ndarray], places: list[np.ndarray], sizes: list[np.ndarray]):
        join = lambda a, kind: np.concatenate(a).astype(kind) if a else np.zeros(0, kind)
        host = np.repeat(np.array([_host_hash(h) for h in hosts], A.U64), [len(k) for k in keys]) if hosts else np.zeros(0, A.U64)
        self.index = A.HashIndex(_of_host(join(keys, np.int64).view(A.U64), host))
        self.classes, self.places, self.sizes = join(classes, np.int32), join(places, np.int32), join(sizes, np.int32)

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch) -> Templates:
        lists = [[np.array(x, np.int64) for x in table.column(n).to_pylist()] for n in ("keys", "classes", "places", "sizes")]
        return cls(table.column("host").to_pylist(), *lists)


def slots(hosts: list[str], pages: list[str], of: Templates) -> list[tuple[list[dict], str]]:
    """(slots, title) of each page."""
    parts = Parts(pages)
    host = np.array([_host_hash(h) for h in hosts], A.U64)
    page = np.repeat(np.arange(len(pages)), [len(e) for e in parts.events])
    order = np.array([e for events in parts.events for e in events], np.int64)
    tag_page, node_page = np.zeros(len(parts.tag_key), np.int64), np.zeros(len(parts.nodes), np.int64)
    tag_page[order[order >= 0]] = page[order >= 0]
    node_page[-1 - order[order < 0]] = page[order < 0]
    tags = of.index.find(_of_host(parts.tag_key, host[tag_page])).tolist()
    whole = of.index.find(_of_host(parts.node_key, host[node_page])).tolist()
    words = of.index.find(_of_host(parts.word_key, host[node_page[parts.word_node]]))
    some = (np.maximum.reduceat(words, parts.first_word[:-1]) >= 0).tolist() if len(words) else []
    classes, places, sizes = of.classes, of.places, of.sizes
    out = []
    for events, title in zip(parts.events, parts.titles):
        found: list[dict] = []
        part: list[str] = []
        gap = 0
        inside: list[list[int]] = []  # open instances: class, number, place
        seen: dict[int, int] = {}

        def end() -> None:
            if part:
                text = entities.unescape(" ".join(" ".join(part).split()))
                part.clear()
                if text:
                    found.append({"gap": gap, "at": "/".join([str(gap), *(f"{c}.{n}.{i}" for c, n, i in inside)]), "text": text})

        def token(t: int) -> None:
            nonlocal gap
            c, i = int(classes[t]), int(places[t])
            if c == 0:
                if i >= gap:
                    end()
                    inside.clear()
                    gap = i + 1
                return
            k = next((k for k in range(len(inside) - 1, -1, -1) if inside[k][0] == c), -1)
            if k >= 0 and i > inside[k][2]:
                end()
                del inside[k + 1 :]
                inside[k][2] = i
                if i == sizes[t] - 1:
                    inside.pop()
            elif i == 0:
                end()
                if k >= 0:
                    del inside[k:]
                n = seen[c] = seen.get(c, -1) + 1
                inside.append([c, n, 0])

        for e in events:
            if e >= 0:
                if tags[e] >= 0:
                    token(tags[e])
                continue
            e = -1 - e
            if whole[e] >= 0:
                end()
                token(whole[e])
            elif some[e]:
                for word, t in zip(parts.nodes[e].split(), words[parts.first_word[e] : parts.first_word[e + 1]].tolist()):
                    if t < 0:
                        part.append(word)
                    else:
                        end()
                        token(t)
            else:
                part.append(parts.nodes[e])
        end()
        out.append((found, entities.unescape(" ".join(" ".join(title).split()))))
    return out


def extract(pages: DataFrame, url: str = "url", html: str = "html", broadcast_tokens: int = BROADCAST_TOKENS) -> tuple[DataFrame, dict[str, str]]:
    """``pages`` without the HTML, with ``host``, ``title``, ``slots`` (gap, at, text) and ``text``; the names of those columns."""
    found = templates(pages, url, html, broadcast_tokens=broadcast_tokens)
    slot = T.StructType([T.StructField("gap", T.IntegerType()), T.StructField("at", T.StringType()), T.StructField("text", T.StringType())])
    schema, names = extended(pages.drop(html), {"host": T.StringType(), "title": T.StringType(), "slots": T.ArrayType(slot), "text": T.StringType()})
    carried = pages.drop(html).columns
    left = pages.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col(html).cast("string").alias("html"), host_column(url).alias("host"))
    shared = None
    if (found.agg(F.sum(F.size("keys"))).first()[0] or 0) <= broadcast_tokens:
        shared = pages.sparkSession.sparkContext.broadcast(Templates.of(found.toArrow()))
    else:
        left = left.join(found, "host", "left").select("row", "html", "host", "keys", "classes", "places", "sizes")
    kind = pa.list_(pa.struct([("gap", pa.int32()), ("at", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html, host = batch.column("html"), batch.column("host")
            for lo, hi in _page_runs(html):
                part = batch.slice(lo, hi - lo)
                hosts = part.column("host").to_pylist()
                if shared is not None:
                    of = shared.value
                else:
                    first = [i for h, i in {h: i for i, h in reversed(list(enumerate(hosts)))}.items()]
                    own = part.take(pa.array(first, pa.int64()))
                    of = Templates.of(own.filter(own.column("keys").is_valid()))
                texts = part.column("html").to_pylist()
                got = slots(hosts, ["" if t is None else t for t in texts], of)
                null = [t is None for t in texts]
                row = part.column("row")
                cols = [row.field(i) for i in range(row.type.num_fields)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *cols, part.column("host"), pa.array([None if no else t for (_, t), no in zip(got, null)], pa.string()), pa.array([s for s, _ in got], kind),
                        pa.array([None if no else "\n".join(x["text"] for x in s) for (s, _), no in zip(got, null)], pa.string()),
                    ],
                    names=schema.fieldNames(),
                )

    return left.mapInArrow(run, schema), names
