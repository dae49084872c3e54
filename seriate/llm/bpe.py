"""Byte-level BPE by prefix dynamic programming.

For every prefix of a word's bytes there is exactly one token that can end the prefix's encoding. It is found left to right: token t, ending at e, is
the one if the token that ends the prefix before it and t could stand side by side (no merge across their border would have come
first). The table of these last tokens is all that encoding needs: the ids are read off backwards; bytes appended to a word extend the
table; and after an edit only words near it are done again. Words are cut off by the vocabulary's pattern, so equal words are encoded once.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie; on every node.
FOLDER = "/opt/tokenizers"
#: Fixed value: the pattern by which this family of vocabularies cuts text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Most entries of the memories of words and of pairs, and the longest word remembered; they bound memory and change no result.
MEMORY, LONGEST = 400_000, 64


def _bytes_of_letters() -> dict[str, int]:
    """The letters by which the vocabulary file writes bytes: printable ones stand for themselves, the others come after 255 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = _bytes_of_letters()
        spell = lambda s: bytes(letters[c] for c in s)
        self.ids: dict[bytes, int] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        by_name = model["vocab"]
        for name, i in by_name.items():
            if all(c in letters for c in name) and len(name) == 1:
                self.ids[spell(name)] = i
                self.rank[i] = -1
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i = by_name[a + b]
            if i in self.rank:  # a later way to a token that exists already
                self.merged.setdefault((by_name[a], by_name[b]), r)
                continue
            self.ids[spell(a + b)] = i
            self.rank[i] = r
            self.halves[i] = (by_name[a], by_name[b])
            self.merged[(by_name[a], by_name[b])] = r
        self.bytes_of = {i: b for b, i in self.ids.items()}
        # Which lengths the tokens with a certain end have, the longest first.
        ends: dict[bytes, set[int]] = {}
        for b in self.ids:
            ends.setdefault(b[-2:], set()).add(len(b))
        self.lengths = {k: sorted(v | ({1} if k[-1:] in self.ids else set()), reverse=True) for k, v in ends.items()}
        self._beside: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def beside(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: undoing the merges inside both, latest first, no merge across the border would have been earlier."""
        key = a << 32 | b
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) >= MEMORY * 4:
                self._beside.clear()
            known = self._beside[key] = self._check(a, b)
        return known

    def _check(self, left: int, right: int, until: float = float("inf")) -> bool:
        rank, merged, halves = self.rank, self.merged, self.halves
        # `left` and `right` touch the border from the rank at which the later of them was made up to `until`. Among merges of one rank
        # the leftmost comes first.
        while True:
            across = merged.get((left, right))
            if across is not None and across < until:
                return False
            rl, rr = rank[left], rank[right]
            if rl < 0 and rr < 0:
                return True
            if rl > rr:
                until, left = rl, halves[left][1]
            else:
                until, right = rr + 0.5, halves[right][0]

    def extend(self, word: bytes, last: list[int]) -> list[int]:
        """Last tokens of all prefixes of ``word``; ``last`` has those of its first bytes and is extended in place."""
        ids, beside, lengths = self.ids, self.beside, self.lengths
        for e in range(len(last) + 1, len(word) + 1):
            for n in lengths.get(word[max(e - 2, 0) : e], (1,)):
                t = ids.get(word[e - n : e]) if n <= e else None
                if t is None:
                    continue
                if self.alone(t) and (e == n or beside(last[e - n - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError(f"no token ends the first {e} bytes of {word[:100]!r}")
        return last

    def alone(self, t: int) -> bool:
        """Whether a token's own bytes are encoded as the token: so are its halves, and no merge across their border comes before its own."""
        known = self._alone.get(t)
        if known is None:
            pair = self.halves.get(t)
            known = self._alone[t] = pair is None or (self.alone(pair[0]) and self.alone(pair[1]) and self._check(*pair, self.rank[t]))
        return known

    def read(self, word: bytes, last: list[int]) -> tuple[int, ...]:
        out, e = [], len(word)
        while e:
            t = last[e - 1]
            out.append(t)
            e -= len(self.bytes_of[t])
        return tuple(reversed(out))

    def word(self, word: str) -> tuple[int, ...]:
        found = self._words.get(word)
        if found is None:
            raw = word.encode("utf-8")
            whole = self.ids.get(raw)
            found = (whole,) if whole is not None and self.alone(whole) else self.read(raw, self.extend(raw, []))
            if len(word) <= LONGEST:
                if len(self._words) >= MEMORY:
                    self._words.clear()
                self._words[word] = found
        return found


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once per Python worker."""
    return Vocabulary(path)


@lru_cache(maxsize=4)
def cutter(pattern: str):
    return regex.compile(pattern)


def encode(text: str, vocab: Vocabulary, pattern: str = PATTERN) -> list[int]:
    """The ids of ``text``; what looks like a special token is plain text."""
    out: list[int] = []
    known, word = vocab._words.get, vocab.word
    for w in cutter(pattern).findall(text):
        out += known(w) or word(w)
    return out


def decode(ids: list[int], vocab: Vocabulary) -> str:
    return b"".join(vocab.bytes_of[i] for i in ids).decode("utf-8")


class Encoded:
    """A text with its encoding, for appends and edits that redo only the words they touch."""

    def __init__(self, vocab: Vocabulary, text: str = "", pattern: str = PATTERN):
        self.vocab, self.pattern, self.text = vocab, cutter(pattern), ""
        self.words: list[str] = []
        self.tables: list[list[int]] = []
        self.redone = 0
        self.splice(0, 0, text)

    def ids(self) -> list[int]:
        return [i for w, t in zip(self.words, self.tables) for i in self.vocab.read(w.encode(), t)]

    def append(self, more: str) -> Encoded:
        return self.splice(len(self.text), len(self.text), more)

    def splice(self, start: int, end: int, new: str) -> Encoded:
        """Replace the characters ``start`` to ``end`` by ``new``."""
        text = self.text[:start] + new + self.text[end:]
        # A word is decided by its characters and the two after it: the first that may change ends at start - 1 or later. It is looked for from the nearer end.
        if start < len(self.text) // 2:
            k = at = 0
            while k < len(self.words) and at + len(self.words[k]) + 1 < start:
                at += len(self.words[k])
                k += 1
        else:
            k, at = len(self.words), len(self.text)
            while k and at + 1 >= start:
                k -= 1
                at -= len(self.words[k])
        # Where a new border behind the edit meets an old one, the rest is as before.
        j, old_at, moved = k, at, len(new) - (end - start)
        words, tables, tail = [], [], len(self.words)
        self.redone = 0
        for m in self.pattern.finditer(text, at):
            if m.start() >= start + len(new):
                while j < len(self.words) and old_at < m.start() - moved:
                    old_at += len(self.words[j])
                    j += 1
                if j < len(self.words) and old_at == m.start() - moved:
                    tail = j
                    break
            w = m.group()
            raw = w.encode()
            old = self.words[k + len(words)] if k + len(words) < len(self.words) else ""
            # A word that goes on as it began keeps the table of its old bytes.
            table = list(self.tables[k + len(words)]) if old and w.startswith(old) else []
            words.append(w)
            tables.append(self.vocab.extend(raw, table))
            self.redone += 1
        self.text = text
        self.words[k:tail], self.tables[k:tail] = words, tables
        return self

    def flat(self) -> np.ndarray:
        """The last token of each byte prefix of each word, one after the other: with the text, all there is to know."""
        return np.fromiter((t for table in self.tables for t in table), np.int32)

    @classmethod
    def of(cls, vocab: Vocabulary, text: str, flat: np.ndarray, pattern: str = PATTERN) -> Encoded:
        """From a text and its :meth:`flat` tables, without encoding anything."""
        out = cls(vocab, pattern=pattern)
        out.text, out.words = text, out.pattern.findall(text)
        ends = np.cumsum([0, *[len(w.encode()) for w in out.words]])
        if ends[-1] != len(flat):
            raise ValueError("the tables are not those of the text")
        out.tables = [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
        return out


_TABLES = {"text": pa.string(), "ids": pa.list_(pa.int32()), "tables": pa.list_(pa.int32())}
_TABLES_SQL = "text string, ids array<int>, tables array<int>"


def _of_rows(df: DataFrame, id_col: str, columns: list, one, path: str | None) -> DataFrame:
    path = path or os.path.join(FOLDER, "byte_bpe_50k.json")
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                b = batch.slice(at, 500)
                made = [one(vocab, *row) for row in zip(*[b.column(i).to_pylist() for i in range(1, b.num_columns)])]
                cols = [[e.text for e in made], [e.ids() for e in made], [e.flat() for e in made]]
                yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, t) for c, t in zip(cols, _TABLES.values())]], names=[id_col, *_TABLES])

    return df.select(F.col(id_col), *columns).mapInArrow(run, f"`{id_col}` {kind}, {_TABLES_SQL}")


def encode_tables(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """``id_col``, ``text``, ``ids`` and ``tables``, from which later appends and edits go on; a null text counts as empty. ``tables`` has a number for each byte."""
    return _of_rows(df, id_col, [text_col], lambda vocab, text: Encoded(vocab, text or ""), path)


def splice_column(df: DataFrame, id_col: str, start: str, end: str, new: str, path: str | None = None) -> DataFrame:
    """Edits rows of :func:`encode_tables`: the characters ``start`` to ``end`` (columns; null: the end of the text, and negative ones 0) become those of ``new``.

    Only words near the edit are encoded; the result has the same columns and is exactly that of encoding the new text. A null ``new`` adds nothing.
    """
    def one(vocab: Vocabulary, text: str | None, tables: list | None, a: int | None, b: int | None, more: str | None) -> Encoded:
        e = Encoded.of(vocab, text or "", np.array(tables or [], np.int32))
        size = len(e.text)
        a = size if a is None else min(size, max(0, a))
        return e.splice(a, size if b is None else min(size, max(a, b)), more or "")

    return _of_rows(df, id_col, ["text", "tables", start, end, new], one, path)


def encode_column(df: DataFrame, id_col: str, text_col: str, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """``id_col`` and ``ids`` (array of int) of every row; an empty list for an empty or null text. Rows with a null id keep it.

    Nothing is shuffled; the vocabulary is read from ``path``, a file on every node, once per worker.
    """
    path = path or os.path.join(FOLDER, "byte_bpe_50k.json")
    kind = df.schema[id_col].dataType.simpleString()
    ids_type = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            # Very long texts make few rows a batch of output.
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                lists = [encode(t, vocab, pattern) if t else [] for t in b.column(1).to_pylist()]
                offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.fromiter((i for x in lists for i in x), np.int32, count=int(offsets[-1]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], schema=pa.schema([pa.field(id_col, b.column(0).type), pa.field("ids", ids_type)]))

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
