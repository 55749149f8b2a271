"""Benchmark decontamination with a generalised suffix automaton.

The automaton of all normalised test items is built once and sent to the tasks;
the words of every training text run through it, and the longest match length
at each word tells which item windows end there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ._common import kept, utf8

#: Lower-cases A-Z and turns every byte that is no word character into a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(data: bytes) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return data.translate(_FOLD).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences.

    After :meth:`seal`, ``windows[state]`` lists the items that hold the
    ``window``-word string of a state, and ``shorts`` the items under ``window``
    words, by the state of their whole word sequence.
    """

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link = [-1]
        self.len = [0]

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        cur = len(length)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, w)
        return cur

    def _split(self, p: int, q: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(length)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        link[q] = clone
        return clone

    def add(self, seq: list[bytes]) -> None:
        last = 0
        for w in seq:
            last = self._extend(last, w)

    def seal(self, items: Iterable[tuple[str, list[bytes]]]) -> None:
        n, link, length, k = len(self.len), self.link, self.len, self.window
        order = sorted(range(n), key=length.__getitem__)
        self.at = [-1] * n  # the state whose strings include the last `window` words
        for s in order[1:]:
            self.at[s] = self.at[link[s]] if self.at[link[s]] != -1 else s if length[s] >= k else -1
        self.windows: dict[int, set[str]] = {}
        short: dict[int, dict[int, list[str]]] = {}
        for item, seq in items:
            v = 0
            for i, w in enumerate(seq):
                v = self.next[v][w]
                while length[link[v]] >= k:  # only the last `window` words matter here
                    v = link[v]
                if i + 1 >= k:
                    self.windows.setdefault(self.at[v], set()).add(item)
            if seq and len(seq) < k:
                short.setdefault(v, {}).setdefault(len(seq), []).append(item)
        self.shorts = [()] * n  # (words, items) that end at a state, longest first
        for s in order[1:]:
            own = tuple(sorted(short.get(s, {}).items(), reverse=True))
            self.shorts[s] = own + self.shorts[link[s]]
        self.has_short = bool(short)

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged hit ranges (first word, end) of ``seq`` and the items found."""
        nxt, link, length, k, at, has_short = self.next, self.link, self.len, self.window, self.at, self.has_short
        root = nxt[0]
        v = size = 0
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for i, w in enumerate(seq):
            if not v:
                t = root.get(w)
                if t is None:
                    continue
                v, size = t, 1
            else:
                t = nxt[v].get(w)
                if t is None:
                    while t is None and v:
                        v = link[v]
                        t = nxt[v].get(w)
                    size = length[v]
                    if t is None:
                        v = size = 0
                        continue
                v = t
                size += 1
            if size >= k:
                found.append((i - k + 1, i + 1))
                items |= self.windows[at[v]]
            if has_short:
                for n, names in self.shorts[v]:
                    if n <= size:
                        found.append((i - n + 1, i + 1))
                        items.update(names)
        return merge(found), items


def build(rows: Iterable[Row], window: int) -> SuffixAutomaton:
    items = [(str(r[0]), words(r[1].encode())) for r in rows if r[1]]
    sam = SuffixAutomaton(window)
    for _, seq in items:
        sam.add(seq)
    sam.seal(items)
    return sam


def without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """A text without the given word ranges, each cut from its first to its last word."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(data)]
    parts, end = [], 0
    for a, b in ranges:
        parts.append(data[end:at[a][0]])
        end = at[b - 1][1]
    parts.append(data[end:])
    return b"".join(parts)


def _scanner(sent: Broadcast[SuffixAutomaton], clean: bool) -> Callable[..., Column]:
    @F.arrow_udf("n_words long, hits array<struct<a:int,b:int>>, items array<string>, clean string")
    def scan(text: pa.Array, before: pa.Array) -> pa.Array:
        kept("benchmark", dict)
        sam = sent.value
        n_words, hits, names, cleaned = [], [], [], []
        for data, old in zip(utf8(text), before.to_pylist()):
            seq = words(data) if data else []
            found, got = sam.scan(seq)
            if old:
                got = got | set(old["items"])
                found = merge(found + [(x["a"], x["b"]) for x in old["hits"]])
            n_words.append(len(seq))
            hits.append([{"a": a, "b": b} for a, b in found])
            names.append(sorted(got))
            cleaned.append(without(data, found) if clean and found else None)
        return pa.StructArray.from_arrays(
            [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
             pa.array(names, pa.list_(pa.string())), pa.array(cleaned, pa.binary()).cast(pa.string())], ["n_words", "hits", "items", "clean"])

    return scan.asNondeterministic()


def scan_benchmark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10,
                   shard_chars: int = 2_000_000, clean: bool = False) -> DataFrame:
    """``docs`` plus ``scan``: struct of n_words, hits (word ranges), items (ids as strings, sorted) and clean
    (with ``clean``: the text without the hits, cut from a range's first to its last word; null without hits).

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window.  Every document word inside an occurrence is
    hit.  Items are dealt into shards of about ``shard_chars`` characters, one
    automaton each, so what is sent to a task has a fixed bound; texts run
    through the automata one after the other.

    Defined cases: null or empty texts and items have no words; items with a
    null id are named ``null``; equal items count by their ids; an empty
    benchmark hits nothing.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n_shards = -(-int(total) // shard_chars) or 1
    out = docs.withColumn("scan", F.lit(None).cast("struct<n_words:long,hits:array<struct<a:int,b:int>>,items:array<string>,clean:string>"))
    for s in range(n_shards):
        part = items.where(F.pmod(F.xxhash64("item", "t"), F.lit(n_shards)) == s).collect()
        sent = sc.broadcast(build(part, window))
        # not repeated by the optimizer where a filter reads it
        out = out.withColumn("scan", _scanner(sent, clean and s == n_shards - 1)(F.col(text_col), F.col("scan")))
    return out


def merge(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def n_hit() -> Column:
    return F.aggregate("scan.hits", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = 10,
                  max_coverage: float = 0.5) -> DataFrame:
    """``docs`` without benchmark spans: matched ranges are cut out, and texts of which more than
    ``max_coverage`` of the words are hit are dropped.  Clean rows stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("text"))
    scanned = scan_benchmark(rows, benchmark, "text", window, clean=True)
    kept = scanned.where((F.size("scan.hits") == 0) | (n_hit() <= max_coverage * F.col("scan.n_words")))
    return kept.select(*[F.coalesce("scan.clean", "text").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
