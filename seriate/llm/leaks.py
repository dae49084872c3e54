"""Test items that leak into a corpus, found by streaming its words through suffix automata of the items.

The corpus is read once. A document whose words hold no run of ``min_words`` words of any item is left out at once: the codes of its runs are looked
up in a filter of the codes of the items' runs (a Bloom filter of bounded size, broadcast; it may let too many through, never too few). The others,
with their text, go on to the blocks of items that have one of these runs, found by a join of codes. Items are spread over blocks of about
``BLOCK_WORDS`` words, none of which ever sees the driver; a task builds the automaton of its block and follows its documents through it.

The items' words, normalised like the corpus, form a generalised suffix automaton: every run of words of any item is a path in it. A document's
words are followed through it; the automaton keeps the longest run ending at each word that occurs in an item. A run of at least
``min_words`` names the items that contain its last ``min_words`` words. The time is linear in the document, whatever the number of items.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriate.session import materialize

#: Words and items of an automaton, about (some 0.3 KB a word in a task; state sets of at most that many items).
BLOCK_WORDS, BLOCK_ITEMS = 200_000, 2_000
#: Documents of a block that one task follows, about.
DOCUMENTS = 2_000
#: Bits of the filter for a run of an item, and most bits of all: 16 MB. With more than a million different runs it lets more documents through to the exact search.
RUN_BITS, MOST_BITS = 64, 1 << 27
#: A document's runs are looked up in the filter at so many places; the runs of so many words of documents at a time.
PROBES, TOGETHER = (0, 21, 42), 500_000

_HTML = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]*>|<![a-zA-Z][^<>]*>", re.S)
_BBCODE = re.compile(r"\[/?(?:quote|b|i|u|s|url|img|code|list|size|color|font|center|left|right|spoiler|email|youtube|table|tr|td|sup|sub|pre|hr|li|ul|ol|\*)(?:[=\s][^\[\]]*)?/?\]", re.I)
_CHAIN = re.compile(r"&(?:amp;|#0*38;|#x0*26;)+", re.I)
#: Zero-width characters, the byte order mark, and the soft hyphen.
_UNSEEN = [0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD]
_UNSEEN_RUN = re.compile("[" + "".join(map(chr, _UNSEEN)) + "]+")
_WORD = re.compile(r"[^\W_]+")


def decode_entities(text: str) -> str:
    """Entities decoded until none is left; chains of encoded ampersands are taken in one step."""
    while "&" in text:
        new = html.unescape(_CHAIN.sub("&", text))
        if new == text:
            break
        text = new
    return text


def strip_tags(text: str) -> str:
    """HTML and BBCode tags replaced by a blank."""
    if "<" in text:
        text = _HTML.sub(" ", text)
    return _BBCODE.sub(" ", text) if "[" in text else text


def without_unseen(text: str) -> str:
    """Without zero-width characters and soft hyphens."""
    return text if text.isascii() else _UNSEEN_RUN.sub("", text)


def normal_words(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits, after entities, tags, unseen characters and compatibility forms are dealt with."""
    if not text:
        return []
    text = strip_tags(decode_entities(text))
    if not text.isascii():
        text = unicodedata.normalize("NFKC", without_unseen(text))
    return _WORD.findall(text.lower())


class Automaton:
    """Generalised suffix automaton over the words of many items."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.words: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[int]] = [set()]
        for item, words in items:
            last = 0
            for w in words:
                last = self._add(last, self.words.setdefault(w, len(self.words)), ends)
                ends[last].add(item)
        # Items flow from longer runs to their ends, no further than runs of min_words.
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.length[self.link[s]] >= min_words:
                ends[self.link[s]] |= ends[s]
        # What a run ending in a state says: the items of the state that holds its last min_words words.
        self.items: list[tuple[int, ...]] = [()] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            if self.length[s] >= min_words:
                up = self.link[s]
                self.items[s] = self.items[up] if self.length[up] >= min_words else tuple(sorted(ends[s]))

    def _new(self, length: int, link: int, following: dict[int, int], ends: list[set[int]]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        ends.append(set())
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int, ends: list[set[int]]) -> int:
        """A state of its own for the runs of q that are one word longer than p's."""
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]), ends)
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _add(self, last: int, w: int, ends: list[set[int]]) -> int:
        q = self.next[last].get(w)
        if q is not None:  # another item has this run
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q, ends)
        state = self._new(self.length[last] + 1, 0, {}, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q, ends)
        return state

    def runs(self, words: list[str]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """At each word that ends a run of at least min_words: its place, the longest run's length, and the items."""
        known, following, link, length, least, items = self.words.get, self.next, self.link, self.length, self.min_words, self.items
        s = n = 0
        for i, word in enumerate(words):
            w = known(word)
            if w is None:
                s = n = 0
                continue
            t = following[s].get(w)
            while t is None and s:
                s = link[s]
                n = length[s]
                t = following[s].get(w)
            if t is None:
                continue
            s, n = t, n + 1
            if n >= least:
                yield i, n, items[s]


# Where the normalised words stand in the original text

_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


class _Placed:
    """A text of which each character knows from where to where its origin stands in the original."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def sub(self, pattern: re.Pattern, replace: Callable[[str], str]) -> None:
        parts, start, end, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            a, b = m.span()
            new = replace(m.group())
            parts += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        if at:
            self.text = "".join([*parts, self.text[at:]])
            self.start, self.end = start + self.start[at:], end + self.end[at:]

    def compatible(self) -> None:
        """Compatibility forms, a character with what composes with it at a time."""
        groups: list[tuple[int, int, str]] = []
        first, form = 0, ""
        for i, c in enumerate(self.text):
            own = c if c.isascii() else unicodedata.normalize("NFKC", c)
            apart = not form or (c.isascii() or not unicodedata.combining(unicodedata.normalize("NFKD", c)[0]) and unicodedata.normalize("NFKC", self.text[first : i + 1]) == form + own)
            if apart:
                if i:
                    groups.append((first, i, form))
                first, form = i, own
            else:
                form = unicodedata.normalize("NFKC", self.text[first : i + 1])
        if self.text:
            groups.append((first, len(self.text), form))
        self.start, self.end = [self.start[a] for a, _, f in groups for _ in f], [self.end[b - 1] for _, b, f in groups for _ in f]
        self.text = "".join(f for _, _, f in groups)


def placed_words(text: str | None) -> list[tuple[str, int, int]]:
    """The words of :func:`normal_words`, and from where to where each stands in ``text``."""
    if not text:
        return []
    t = _Placed(text)
    while "&" in t.text:
        before = t.text
        t.sub(_CHAIN, lambda _: "&")
        t.sub(_REFERENCE, html.unescape)
        if t.text == before:
            break
    t.sub(_HTML, lambda _: " ")
    t.sub(_BBCODE, lambda _: " ")
    if not t.text.isascii():
        t.sub(_UNSEEN_RUN, lambda _: "")
        t.compatible()
    origin = [i for i, c in enumerate(t.text) for _ in c.lower()]
    return [(m.group(), t.start[origin[m.start()]], t.end[origin[m.end() - 1]]) for m in _WORD.finditer(t.text.lower())]


# Codes of runs of words

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Codes(dict):
    """64-bit codes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        code = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return code


def run_codes(lists: list[list[str]], n: int, codes: _Codes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all runs of ``n`` words in the lists, and which list each is of."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    total = int(sizes.sum())
    if total < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    words = np.fromiter((codes[w] for one in lists for w in one), np.uint64, total)
    out = np.zeros(total - n + 1, np.uint64)
    for j in range(n):
        out = out * _FACTOR + words[j : total - n + 1 + j]
    owner = np.repeat(np.arange(len(lists)), sizes)
    whole = owner[: total - n + 1] == owner[n - 1 :]
    return out[whole], owner[: total - n + 1][whole]


class RunFilter:
    """The codes of the items' runs as bits."""

    def __init__(self, width: int, places: np.ndarray, words: np.ndarray):
        """``width``: the number of bits is a power of two. ``words``: those 64 bits at ``places`` that aren't all 0."""
        self.width, self.bits = width, np.zeros((1 << width) // 64, np.uint64)
        self.bits[places] = words

    def holds(self, codes: np.ndarray) -> np.ndarray:
        found = np.ones(len(codes), bool)
        for r in PROBES:
            turned = codes << np.uint64(r) | codes >> np.uint64(64 - r) if r else codes
            at = turned >> np.uint64(64 - self.width)
            found &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) == 1
        return found


def _run_filter(runs: DataFrame) -> RunFilter:
    """The filter of the column ``code``; built by an aggregate, at most ``MOST_BITS / 64`` numbers come to the driver."""
    codes = runs.select("code").distinct()
    width = min(MOST_BITS, 1 << max(16, math.ceil(math.log2(max(1, codes.count()) * RUN_BITS)))).bit_length() - 1
    turned = [F.call_function("shiftleft", "code", F.lit(r)).bitwiseOR(F.call_function("shiftrightunsigned", "code", F.lit(64 - r))) if r else F.col("code") for r in PROBES]
    at = codes.select(F.explode(F.array(*[F.call_function("shiftrightunsigned", t, F.lit(64 - width)) for t in turned])).alias("at"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))
    table = at.groupBy(F.call_function("shiftright", "at", F.lit(6)).alias("place")).agg(F.bit_or(bit).alias("word")).toArrow()
    return RunFilter(width, table.column("place").to_numpy(), table.column("word").to_numpy().view(np.uint64))


# The search

@dataclass(frozen=True)
class Leaks:
    """``documents``: those that may hold a run of an item, with a number ``cid`` and their ``text``. ``spans``: with ``cid``, and the columns of :func:`leaked_spans`."""

    documents: DataFrame
    spans: DataFrame


def find_leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, min_words: int = 10) -> Leaks:
    """The search of :func:`leaked_spans`."""
    known = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(passage).cast("string").alias("passage")).where("item_id IS NOT NULL AND passage IS NOT NULL")
    known = materialize(known.mapInArrow(_item_words(min_words), "item_id long, words string, n_words long"), "items")
    size = known.agg(F.sum("n_words").alias("words"), F.count(F.lit(1)).alias("items")).first()
    blocks = max(1, math.ceil((size["words"] or 0) / BLOCK_WORDS), math.ceil(size["items"] / BLOCK_ITEMS))
    known = known.withColumn("block", F.pmod(F.xxhash64("item_id", "words"), F.lit(blocks)).cast("int"))
    runs = materialize(known.select("words", "block").mapInArrow(_item_runs(min_words), "code long, block int").distinct(), "runs")

    kind = docs.schema[doc_id].dataType
    flat = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("text IS NOT NULL")
    shared = docs.sparkSession.sparkContext.broadcast(_run_filter(runs))
    documents = flat.mapInArrow(_may_leak(shared, min_words), f"doc {kind.simpleString()}, text string, codes array<long>")
    documents = materialize(documents.withColumn("cid", F.monotonically_increasing_id()), "may_leak")

    pairs = materialize(documents.select("cid", F.explode("codes").alias("code")).join(runs, "code").select("cid", "block").distinct(), "pairs")
    # The documents of a block are spread over as many tasks as they need, each with the items of the block. A number for each block.
    salts = F.broadcast(pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / DOCUMENTS).cast("int").alias("salts")))
    salted = pairs.join(salts, "block").select("cid", "block", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int").alias("salt"))
    there = salted.join(documents.select("cid", "doc", "text"), "cid").select("block", "salt", "cid", F.lit(None).cast("long").alias("item_id"), "doc", "text")
    each = known.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("cid"), "item_id", F.lit(None).cast(kind).alias("doc"), F.col("words").alias("text"))
    # Items have no cid and so come before the documents.
    work = each.unionByName(there).repartition("block", "salt").sortWithinPartitions("block", "salt", F.col("cid").asc_nulls_first(), "item_id")
    spans = work.mapInArrow(_follow(min_words), f"cid long, `{doc_id}` {kind.simpleString()}, item_id long, first_word int, n_words int, doc_words int")
    return Leaks(documents.withColumnRenamed("doc", doc_id), spans)


def leaked_spans(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, min_words: int = 10) -> DataFrame:
    """Runs of at least ``min_words`` consecutive words that a document shares with an item, longest runs, one row per document, item and run.

    Columns ``doc_id, item_id, first_word, n_words, doc_words`` (places count words from 0). Null, empty or blank texts and items of fewer words
    than ``min_words`` give no rows. A document or item given twice with one id has its runs twice. Only documents that may leak are shuffled.
    """
    return find_leaks(docs, doc_id, text, items, item_id, passage, min_words).spans.drop("cid")


def _item_words(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, w in zip(b.column(0).to_pylist(), map(normal_words, b.column(1).to_pylist())) if len(w) >= min_words]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([" ".join(w) for _, w in rows], pa.string()), pa.array([len(w) for _, w in rows], pa.int64())], names=["item_id", "words", "n_words"])

    return run


def _item_runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes()
        for b in batches:
            found, owner = run_codes([w.split(" ") for w in b.column(0).to_pylist()], min_words, codes)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), b.column(1).take(pa.array(owner))], names=["code", "block"])

    return run


def _may_leak(shared, min_words: int):
    """Documents with a run that the filter holds, with the codes of these runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, codes = shared.value, _Codes()

        def looked_up(batch: pa.RecordBatch, rows: list[int], lists: list[list[str]]) -> Iterator[pa.RecordBatch]:
            found, owner = run_codes(lists, min_words, codes)
            hit = known.holds(found)
            if not hit.any():
                return
            found, owner = found[hit].view(np.int64), owner[hit]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            each = [np.unique(part) for part in np.split(found, starts[1:])]
            at = pa.array(np.array(rows)[owner[starts]])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(each, pa.list_(pa.int64()))], names=["doc", "text", "codes"])

        for b in batches:
            rows, lists, size = [], [], 0
            for i, text in enumerate(b.column(1).to_pylist()):
                words = normal_words(text)
                if len(words) < min_words:
                    continue
                rows.append(i)
                lists.append(words)
                size += len(words)
                if size >= TOGETHER:
                    yield from looked_up(b, rows, lists)
                    rows, lists, size = [], [], 0
            if lists:
                yield from looked_up(b, rows, lists)

    return run


def _item_spans(auto: Automaton, words: list[str], min_words: int) -> Iterator[tuple[int, int, int]]:
    """Item, first word and number of words of each run."""
    open_runs: dict[int, list[int]] = {}
    for i, _, hit in auto.runs(words):
        for item in hit:
            run = open_runs.get(item)
            if run and run[1] == i - 1:
                run[1] = i
                continue
            if run:
                yield item, run[0], run[1] - run[0] + 1
            open_runs[item] = [i - min_words + 1, i]
    for item, (a, e) in open_runs.items():
        yield item, a, e - a + 1


def _follow(min_words: int):
    """Follow documents through the automaton of their block, whose items come first; one automaton at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, items, auto = None, [], None
        for b in batches:
            rows = []
            cols = [b.column(c).to_pylist() for c in ("block", "salt", "cid", "item_id", "text")]
            for i, (block, salt, cid, item, text) in enumerate(zip(*cols)):
                if (block, salt) != now:
                    now, items, auto = (block, salt), [], None
                if cid is None:
                    items.append((item, text.split(" ")))
                    continue
                if auto is None:
                    auto = Automaton(items, min_words)
                words = normal_words(text)
                rows += [(i, *span, len(words)) for span in _item_spans(auto, words, min_words)]
            if rows:
                at, *values = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cid").take(pa.array(at)), b.column("doc").take(pa.array(at)), pa.array(values[0], pa.int64()), *[pa.array(v, pa.int32()) for v in values[1:]]],
                    names=["cid", "doc", "item_id", "first_word", "n_words", "doc_words"],
                )

    return run


def without_leaks(leaks: Leaks, doc_id: str, max_share: float = 0.2) -> DataFrame:
    """What of each leaking document can stay: ``doc_id, removed_words, share, dropped, kept_text``.

    ``kept_text`` is the document's own text less its spans, from the first character of a span's first word to the last of its last; all else stays as it was,
    mark-up included. A document of which spans cover more than ``max_share`` of the words is ``dropped`` as a whole and keeps an empty text. Overlapping
    spans count once. Documents without a span have no row; a document given twice has two.
    """
    # Of the spans that begin at a word the longest: no more than the document has words.
    longest = leaks.spans.groupBy("cid", "first_word").agg(F.max("n_words").alias("n_words"))
    cuts = longest.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("cuts"))
    joined = leaks.documents.select("cid", doc_id, "text").join(cuts, "cid").select(doc_id, "text", "cuts")
    kind = joined.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, cut in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = placed_words(text)
                merged: list[list[int]] = []
                for c in cut:
                    a, e = c["first_word"], c["first_word"] + c["n_words"]
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([a, e])
                covered = sum(e - a for a, e in merged)
                share = covered / len(words)
                kept, at = [], 0
                for a, e in merged:
                    kept.append(text[at : words[a][1]])
                    at = words[e - 1][2]
                drop = share > max_share
                rows.append((len(words) if drop else covered, share, drop, "" if drop else "".join([*kept, text[at:]])))
            cols = list(zip(*rows)) if rows else [[]] * 4
            kinds = [pa.int32(), pa.float64(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[doc_id, "removed_words", "share", "dropped", "kept_text"])

    return joined.mapInArrow(run, f"`{doc_id}` {kind}, removed_words int, share double, dropped boolean, kept_text string")
