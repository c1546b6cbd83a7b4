"""Main text of web pages by union-free wrappers.

A page is a balanced stream of block tags and text slots. Its tandem repeats are folded into repeated groups, which leaves its
skeleton. The different skeletons of a host are aligned one after the other: what mismatches becomes optional, another round of
a repeated group becomes part of it, and text against text is one slot. That gives the host's wrapper, a regular expression
without unions. Every skeleton is then aligned with its host's wrapper, which says for each of its slots which slot of the
wrapper it is, and slots are judged for the host as a whole by what they hold on all of its pages:

- a slot in a navigating or interactive element (OUT_TAGS, OUT_ROLES), or in a part that names itself an advert, comments or
  the like as a whole class name (OUT_NAMES), is out;
- a slot of one and the same text on three or more different pages is the template's, unless it is a paragraph, heading, list item
  or the like within an article (pages may repeat an article);
- a slot with most of its text in links is a menu;
- of the others, main text is what stands in article or main elements. Where a page has none, it is the smallest container
  that holds most of the host's text, and the first headings above it.

There is no other path: a host with one page has a wrapper too. Work is by skeleton and not by page: pages give their skeletons
and what their slots hold (sums, least and greatest text hash), combined in tasks and then by a shuffle; skeletons of a host are
aligned in SHARES shares and these wrappers with each other, whatever the table's size, so that no host is a single task's
whole work; masks return to the pages by a broadcast of checked size, or beyond BROADCAST bytes by a salted join.

Defined results: a null html has an empty text; a null url is a host of its own; repeated rows give repeated results, and copies
of a page count as one where different pages are asked for; an empty table gives an empty result; a very long page is read as a
whole (beyond DEPTH open blocks, further ones only part lines); equal slots are told apart by their place; columns other than
page_id, url and html are not looked at, whatever their names.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settle

#: Shares that a host's skeletons are aligned in, open blocks that make structure, longest repeated unit, bytes of masks broadcast, salts of the join.
SHARES, DEPTH, LONGEST, BROADCAST, SALTS = 16, 150, 8, 32 << 20, 32
#: Different pages that show a text to be the template's, share of a container's text that a child must hold to be gone into.
SHOWN_BY, MOST = 3, 0.6

# What HTML and ARIA say of elements.
OUT_TAGS = frozenset("head nav footer aside form menu dialog".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu".split())
MAIN_TAGS = frozenset("article main".split())
RAW = "script|style|noscript|template|svg|iframe|textarea|select|title|object|button"
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
LEAVES = frozenset("p li dt dd td th tr h1 h2 h3 h4 h5 h6 pre blockquote hr".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6 th dt caption figcaption summary".split())
CONTAINERS = frozenset("html body div section main article center table tbody tr td details fieldset".split())
#: What a part may call itself, as a whole class name or id, if it is not main text.
OUT_NAMES = frozenset("ad ads advert adverts advertisement sponsored promo sidebar menu navbar breadcrumb breadcrumbs cookie cookies cookie-notice cookie-banner consent newsletter share social comment comments comment-list pagination".split())
#: A tag that ends an open one of its own kind.
SELF_ENDING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}

_token = re.compile(rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<[/!?]?[a-zA-Z](?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|<[/!?]?[a-zA-Z][^>]*+>", re.S | re.I)
_name = re.compile(r"</?\s*([a-zA-Z][a-zA-Z0-9:-]*)")
_attr = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_digits = re.compile(r"[-_]*[0-9]+")

# Nodes: ["#", optional, id] is a text slot, ["e", key, nodes, optional] an element, ["r", nodes, optional] a group of one or more rounds.
Node = list


def key_of(node: Node) -> str:
    """What a node is aligned by; a repeated element goes with a single one."""
    if node[0] == "r":
        return key_of(node[1][0]) if len(node[1]) == 1 else f"({key_of(node[1][0])})"
    return "#" if node[0] == "#" else node[1]


def size_of(nodes: list[Node]) -> int:
    return sum(1 if n[0] == "#" else 1 + size_of(n[2 if n[0] == "e" else 1]) for n in nodes)


class Same(dict):
    """Which slot stands for another."""

    def of(self, k: int) -> int:
        while (n := self.get(k, k)) != k:
            k = n
        return k


def _optional(node: Node) -> Node:
    return [*node[:-1], True] if node[0] != "#" else ["#", True, node[2]]


def _is_optional(node: Node) -> bool:
    return node[1] if node[0] == "#" else node[-1]


def merge(a: Node, b: Node, same: Same) -> Node:
    """One node for two of one key."""
    maybe = _is_optional(a) or _is_optional(b)
    if a[0] == "#":
        same[b[2]] = a[2]
        return ["#", maybe, a[2]]
    if a[0] == b[0] == "e":
        return ["e", a[1], align(a[2], b[2], same), maybe]
    return ["r", align(a[1] if a[0] == "r" else [a], b[1] if b[0] == "r" else [b], same), maybe]


def _pairs(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence."""
    if a == b:
        return [(k, k) for k in range(len(a))]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [(k, k) for k in range(head)] + [(len(a) - k, len(b) - k) for k in range(1, tail + 1)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y:
        numbers = {k: n for n, k in enumerate(dict.fromkeys(x + y))}
        p, q = np.array([numbers[k] for k in x]), np.array([numbers[k] for k in y])
        best = np.zeros((len(p) + 1, len(q) + 1), np.int32)
        for i, symbol in enumerate(p):
            best[i + 1, 1:] = np.maximum.accumulate(np.where(q == symbol, best[i, :-1] + 1, best[i, 1:]))
        i, j = len(p), len(q)
        while i and j:
            if p[i - 1] == q[j - 1] and best[i, j] == best[i - 1, j - 1] + 1:
                i, j = i - 1, j - 1
                found.append((head + i, head + j))
            elif best[i, j] == best[i - 1, j]:
                i -= 1
            else:
                j -= 1
    return sorted(found)


def align(a: list[Node], b: list[Node], same: Same) -> list[Node]:
    """Nodes for what either side matches; slots of ``b`` are noted as those of ``a`` that they fall on."""
    a, b = gather(a, b, same), gather(b, a, same)
    out, i, j = [], 0, 0
    for m, n in [*_pairs([key_of(x) for x in a], [key_of(x) for x in b]), (len(a), len(b))]:
        out += map(_optional, a[i:m])
        out += map(_optional, b[j:n])
        if m < len(a):
            out.append(merge(a[m], b[n], same))
        i, j = m + 1, n + 1
    return out


def gather(nodes: list[Node], others: list[Node], same: Same) -> list[Node]:
    """Single rounds of what repeats on the other side become repeated groups."""
    for group in (n for n in others if n[0] == "r" and len(n[1]) > 1):
        out, k = [], 0
        while k < len(nodes):
            end, at, took = k, 0, 0
            for unit in group[1]:
                if end < len(nodes) and key_of(nodes[end]) == key_of(unit):
                    end, took = end + 1, took + 1
                elif not _is_optional(unit):
                    break
                at += 1
            if took > 1 and at == len(group[1]):
                round_ = ["r", nodes[k:end], any(map(_is_optional, nodes[k:end]))]
                if out and key_of(out[-1]) == key_of(round_):
                    out[-1] = merge(out[-1], round_, same)
                else:
                    out.append(round_)
                k = end
            else:
                out.append(nodes[k])
                k += 1
        nodes = out
    return nodes


def fold(nodes: list[Node], same: Same) -> list[Node]:
    """Tandem repeats become repeated groups: first runs of like siblings, then longer units."""
    out: list[Node] = []
    for node in nodes:
        if out and node[0] == "e" and out[-1][0] != "#" and key_of(out[-1]) == node[1]:
            last = out[-1] if out[-1][0] == "e" else out[-1][1][0]
            trial = Same()
            both = merge(last, node, trial)
            if node[1].partition(".")[0] in LEAVES or size_of([both]) <= 1.5 * min(size_of([last]), size_of([node])):
                same.update(trial)
                out[-1] = ["r", [both], False]
                continue
        out.append(node)
    for width in range(2, min(LONGEST, len(out) // 2) + 1):
        keys, nodes, out, k = [key_of(n) for n in out], out, [], 0
        while k < len(nodes):
            unit, n = nodes[k : k + width], 1
            while len(unit) == width and keys[k + n * width : k + (n + 1) * width] == keys[k : k + width]:
                unit = [merge(x, y, same) for x, y in zip(unit, nodes[k + n * width : k + (n + 1) * width], strict=True)]
                n += 1
            if n > 1:
                out.append(["r", unit, False])
            else:
                out.append(nodes[k])
            k += n * width if n > 1 else 1
    return out


def number(nodes: list[Node], take) -> list[Node]:
    """The same nodes with slots numbered by ``take(old number)`` in order."""
    return [["#", n[1], take(n[2])] if n[0] == "#" else ["e", n[1], number(n[2], take), n[3]] if n[0] == "e" else ["r", number(n[1], take), n[2]] for n in nodes]


def written(nodes: list[Node]) -> str:
    return json.dumps(number(nodes, lambda _: 0), separators=(",", ":"), ensure_ascii=False)


def loaded(text: str, first: int = 0) -> tuple[list[Node], int]:
    """Nodes as written, with slots numbered from ``first`` on, and the next number."""
    at = [first]

    def take(_: int) -> int:
        at[0] += 1
        return at[0] - 1

    return number(json.loads(text), take), at[0]


class Page:
    """Lines of a page, how many characters of each stand in links, the slot that each line fills, and the skeleton."""

    def __init__(self, html: str | None):
        self.lines: list[str] = []
        self.linked: list[int] = []
        same = Same()
        nodes = self._read(html or "", same)
        numbers: dict[int, int] = {}
        self.nodes = number(nodes, lambda old: numbers.setdefault(same.of(old), len(numbers)))
        self.slots = [numbers[same.of(k)] for k in range(len(self.lines))]
        self.skeleton = written(self.nodes)
        self.key = xxhash.xxh64_intdigest(self.skeleton.encode("utf-8", "surrogatepass")) - (1 << 63)

    def _read(self, html: str, same: Same) -> list[Node]:
        root: list[Node] = []
        stack: list[tuple[str, str, list[Node] | None]] = []  # name, key, nodes of a block that makes structure
        place, blocks, links = [root], 0, 0
        held: list[str] = []
        in_links = at = 0

        def line() -> None:
            nonlocal in_links
            if held and (words := " ".join("".join(held).split())):
                place[-1].append(["#", False, len(self.lines)])
                self.lines.append(words), self.linked.append(min(in_links, len(words)))
            held.clear()
            in_links = 0

        def end(k: int) -> None:
            nonlocal blocks, links
            while len(stack) > k:
                name, key, own = stack.pop()
                links -= name == "a"
                if name in BLOCKS:
                    line()
                    blocks -= 1
                if own is not None:
                    place.pop()
                    place[-1].append(["e", key, fold(own, same), False])

        for m in _token.finditer(html):
            if m.start() > at:
                held.append(text := entities.unescape(html[at : m.start()]))
                if links:
                    in_links += len(text.strip())
            at = m.end()
            tag = m[0]
            if m[1] or tag[1] in "!?":
                continue
            name = _name.match(tag)[1].lower()
            if tag[1] == "/":
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        end(k)
                        break
                else:
                    if name in BLOCKS:
                        line()
                continue
            if name in BLOCKS:
                line()
                for k in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                    if stack[k][0] == "p":
                        end(k)
                        break
                    if stack[k][0] in BLOCKS:
                        break
                if name in SELF_ENDING and stack and stack[-1][0] in SELF_ENDING[name]:
                    end(len(stack) - 1)
                own = None
                if blocks < DEPTH:
                    own = []
                    key = name
                    for a, v in _attr.findall(tag) if " " in tag else ():
                        words = _digits.sub("", v.strip("\"'").lower()).split()
                        key += "".join(f".{'@' if a.lower() == 'role' else ''}{w}" for w in sorted(words))
                if name in VOID:
                    continue
                stack.append((name, key if own is not None else "", own))
                blocks += 1
                if own is not None:
                    place.append(own)
            elif name == "br":
                held.append(" ")
            elif name not in VOID and not tag.endswith("/>"):
                stack.append((name, "", None))
                links += name == "a"
        if len(html) > at:
            held.append(text := entities.unescape(html[at:]))
            in_links += len(text) if links else 0
        line()
        end(0)
        line()
        return fold(root, same)

    def render(self, main) -> str:
        return "\n".join(x for x, slot in zip(self.lines, self.slots, strict=True) if main[slot])


# --- wrappers -------------------------------------------------------------------------------------------------------------


def infer(skeletons: list[str]) -> str:
    """The wrapper of all of them."""
    wrapper: list[Node] = []
    for n, text in enumerate(skeletons):
        nodes, _ = loaded(text)
        wrapper = align(wrapper, nodes, Same()) if n else nodes
    return written(wrapper)


def match(wrapper: str, skeleton: str) -> list[int]:
    """For each slot of the skeleton that of the wrapper; -1 if it falls on none."""
    nodes, n = loaded(wrapper)
    own, upto = loaded(skeleton, n)
    same = Same()
    align(nodes, own, same)
    return [x if (x := same.of(k)) < n else -1 for k in range(n, upto)]


def places(wrapper: str) -> list[tuple[bool, bool, bool, bool]]:
    """For each slot: out by its elements, in an article or main element, a heading, in a paragraph or the like."""
    out = []

    def visit(nodes: list[Node], gone: bool, within: bool, head: bool, leaf: bool) -> None:
        for n in nodes:
            if n[0] == "#":
                out.append((gone, within, head, leaf))
            elif n[0] == "r":
                visit(n[1], gone, within, head, leaf)
            else:
                tag, *words = n[1].split(".")
                roles = {w[1:] for w in words if w[0] == "@"}
                bad = tag in OUT_TAGS or bool(roles & OUT_ROLES) or not OUT_NAMES.isdisjoint(words) or (tag == "header" and not within)
                visit(n[2], gone or bad, within or tag in MAIN_TAGS or "main" in roles, head or tag in HEADS, leaf or tag in LEAVES or tag in HEADS)

    visit(json.loads(wrapper), False, False, False, False)
    return out


def judge(wrapper: str, seen: dict[int, tuple[int, int, bool, int]]) -> tuple[list[bool], list[bool]]:
    """(main text on pages with an article, on pages without) by slot. ``seen``: characters, of them in links, always one text?, characters on pages without article."""
    where = places(wrapper)
    usable = []
    for k, (gone, within, _, leaf) in enumerate(where):
        chars, linked, fixed, _ = seen.get(k, (0, 0, False, 0))
        usable.append(chars > 0 and not gone and 2 * linked <= chars and not (fixed and not (within and leaf)))
    with_article = [u and w for u, (_, w, *_) in zip(usable, where, strict=True)]
    nodes, _ = loaded(wrapper)
    mass = [seen.get(k, (0, 0, False, 0))[3] if u else 0 for k, u in enumerate(usable)]

    def slots(nodes: list[Node]) -> list[int]:
        return [k for n in nodes for k in ([n[2]] if n[0] == "#" else slots(n[2] if n[0] == "e" else n[1]))]

    region, headings = nodes, []
    while True:
        total = sum(mass[k] for k in slots(region))
        for n, child in enumerate(region):
            inner = child[1] if child[0] == "r" else child[2] if child[0] == "e" and child[1].partition(".")[0] in CONTAINERS else None
            if inner and sum(mass[k] for k in slots(inner)) > MOST * total:
                headings += [k for k in slots(region[:n]) if where[k][2]]
                region = inner
                break
        else:
            break
    chosen = {*slots(region), *headings}
    return with_article, [u and k in chosen for k, u in enumerate(usable)]


# --- jobs -----------------------------------------------------------------------------------------------------------------

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
HELD = "host string, skel long, slot int, skeleton string, chars long, linked long, low long, high long, pages array<long>"
RESULT = "page_id long, url string, text string, n_chars long"


def rows_in(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.col("html").cast("string").alias("html"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)).alias("host"))


def least_of(pages: str) -> Column:
    """The SHOWN_BY least of arrays that have no more each: one a batch of pages, then one a skeleton."""
    return F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(pages)))), 1, SHOWN_BY)


def held_by_slots(rows: DataFrame) -> DataFrame:
    """What the slots of each skeleton hold. ``pages``: the SHOWN_BY least hashes of different pages, so whether there are as many is known exactly; slot -1 carries the skeleton."""

    least = lambda pages: pages if len(pages) <= SHOWN_BY else set(sorted(pages)[:SHOWN_BY])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, list] = {}
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(html)
                one = {xxhash.xxh64_intdigest((html or "").encode("utf-8", "surrogatepass")) - (1 << 63)}
                own = found.setdefault((host, page.key, -1), [page.skeleton, 0, 0, 0, 0, set()])
                own[5] = least(own[5] | one)
                for text, linked, slot in zip(page.lines, page.linked, page.slots, strict=True):
                    digest = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    own = found.setdefault((host, page.key, slot), [None, 0, 0, digest, digest, set()])
                    own[1] += len(text)
                    own[2] += linked
                    own[3], own[4] = min(own[3], digest), max(own[4], digest)
                    own[5] = least(own[5] | one)
            columns = list(zip(*((*k, *v[:5], sorted(v[5])) for k, v in found.items()), strict=True)) or [()] * 9
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split(" ")[0] for x in HELD.split(", ")])

    sums = [F.max("skeleton").alias("skeleton"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.min("low").alias("low"), F.max("high").alias("high"), least_of("pages").alias("pages")]
    return rows.select("host", "html").mapInArrow(run, HELD).groupBy("host", "skel", "slot").agg(*sums)


def aligned(parts: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for all ``nodes`` of equal ``keys``, read as a stream in the order of ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, wrapper = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([group[0]], pa.string()), pa.array([written(wrapper)], pa.string())], ["host", "nodes"])
        for batch in batches:
            for *own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if wrapper is not None and own != group:
                    yield row()
                    wrapper = None
                nodes, _ = loaded(text)
                group, wrapper = own, nodes if wrapper is None else align(wrapper, nodes, Same())
        if wrapper is not None:
            yield row()

    return parts.repartition(*keys).sortWithinPartitions(*keys, "nodes").select(*keys, "nodes").mapInArrow(run, "host string, nodes string")


def host_wrappers(held: DataFrame) -> DataFrame:
    """(host, nodes: the wrapper)."""
    skeletons = held.where("slot = -1").select("host", F.pmod(F.col("skel"), F.lit(SHARES)).alias("share"), F.col("skeleton").alias("nodes"))
    return aligned(aligned(skeletons, ["host", "share"]), ["host"])


def masks(held: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, skel, mask): for each slot of each skeleton whether it holds main text, as a string of 0 and 1."""

    def fall(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, known, article = [], None, None
            for host, skel, skeleton, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known != wrapper:
                    known, article = wrapper, places(wrapper)
                slots = match(wrapper, skeleton)
                has = any(x >= 0 and article[x][1] and not article[x][0] for x in slots)
                rows += [(host, skel, k, x, has) for k, x in enumerate(slots)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()], strict=True)], ["host", "skel", "slot", "at", "has"])

    skeletons = held.where("slot = -1").select("host", "skel", "skeleton").join(wrappers, "host").select("host", "skel", "skeleton", "nodes")
    falls = settle(skeletons.mapInArrow(fall, "host string, skel long, slot int, at int, has boolean"))
    by_slot = falls.where("at >= 0").join(held.drop("skeleton"), ["host", "skel", "slot"]).groupBy("host", "at")
    fixed = (F.min("low") == F.max("high")) & (F.size(least_of("pages")) >= SHOWN_BY)
    seen = by_slot.agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), fixed.alias("fixed"), F.sum(F.when(F.col("has"), 0).otherwise(F.col("chars"))).alias("bare"))
    listed = seen.groupBy("host").agg(F.collect_list(F.struct("at", "chars", "linked", "fixed", "bare")).alias("seen"))  # the slots of a wrapper

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, wrapper, seen in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = judge(wrapper, {x["at"]: (x["chars"], x["linked"], x["fixed"], x["bare"]) for x in seen})
                rows += [(host, k, a, b) for k, (a, b) in enumerate(zip(*both, strict=True))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.string(), pa.int32(), pa.bool_(), pa.bool_()], strict=True)], ["host", "at", "with_article", "without"])

    judged = wrappers.join(listed, "host").select("host", "nodes", "seen").mapInArrow(verdicts, "host string, at int, with_article boolean, without boolean")
    main = F.coalesce(F.when(F.col("has"), F.col("with_article")).otherwise(F.col("without")), F.lit(False))
    slots = falls.join(judged, ["host", "at"], "left").select("host", "skel", "slot", main.cast("int").cast("string").alias("main"))
    return slots.groupBy("host", "skel").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "main"))), lambda x: x["main"]), "").alias("mask"))


def _result(rows: list[tuple], texts: list[str]) -> pa.RecordBatch:
    ids, urls = [r[0] for r in rows], [r[1] for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def _rendered(page: Page, mask: str | None) -> str:
    return page.render([x == "1" for x in mask]) if mask else ""


def main_text(pages: DataFrame, broadcast: int = BROADCAST) -> DataFrame:
    """page_id, url, main text and its code points, for every page."""
    rows = rows_in(pages)
    held = settle(held_by_slots(rows))
    found = settle(masks(held, settle(host_wrappers(held))))
    if (found.agg(F.sum(F.length("mask") + F.length("host") + 100)).first()[0] or 0) <= broadcast:
        known = rows.sparkSession.sparkContext.broadcast({(r.host, r.skel): r.mask for r in found.collect()})  # its size was checked

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
                yield _result(own, [_rendered(p := Page(r[2]), known.value.get((r[3], p.key))) for r in own])

        return rows.mapInArrow(run, RESULT)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [Page(x).key for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["page_id", "url", "html", "host", "skel"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            yield _result(own, [_rendered(Page(r[2]), r[3]) for r in own])

    salted = rows.mapInArrow(keyed, "page_id long, url string, html string, host string, skel long").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    spread = found.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(spread, ["host", "skel", "salt"], "left").select("page_id", "url", "html", "mask").mapInArrow(read, RESULT)


def extract(pages: list[str | None]) -> list[str]:
    """Main texts of pages of one host, without Spark: the same steps over lists."""
    read = [Page(x) for x in pages]
    wrapper = infer(sorted({p.skeleton for p in read}))
    falls = [match(wrapper, p.skeleton) for p in read]
    where, seen, texts = places(wrapper), {}, {}
    has = [any(x >= 0 and where[x][1] and not where[x][0] for x in fall) for fall in falls]
    for html, page, fall, article in zip(pages, read, falls, has, strict=True):
        for text, linked, slot in zip(page.lines, page.linked, page.slots, strict=True):
            own = seen.setdefault(fall[slot], [0, 0, set(), set(), 0])
            own[0] += len(text)
            own[1] += linked
            own[2].add(text), own[3].add(html)
            own[4] += 0 if article else len(text)
    both = judge(wrapper, {k: (a, b, len(c) == 1 and len(d) >= SHOWN_BY, e) for k, (a, b, c, d, e) in seen.items()})
    return [p.render([x >= 0 and both[0 if article else 1][x] for x in fall]) for p, fall, article in zip(read, falls, has, strict=True)]


#: The supplied pages hold one article each, whose blocks are h1 and p and whose references are named ones.
SQL = r"""
WITH lines AS (
  SELECT page_id, url, list_transform(
    regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:h1|p)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))) AS found
  FROM pages), texts AS (SELECT page_id, url, array_to_string(list_filter(found, lambda x: x <> ''), chr(10)) AS text FROM lines)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
