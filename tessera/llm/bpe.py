"""BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array. In each round a binary search over the sorted pair
keys gives every adjacent pair its rank, a segmented minimum finds each word's lowest rank, and all
places of that pair are merged at once; words without a known pair leave the array.

Rows: a null or empty text has no ids and decodes to the empty text. Rows are independent: repeated
rows, ties and empty tables need no care, and very long texts take numpy arrays of their own size.
Columns of the input other than the outputs pass through; an input column that has an output's name
is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import lean, release

#: Characters that the short way of splitting knows; texts with any other go through the library's normalizer.
KNOWN = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2028), 0x20AC)]
SPACES = "".join(c for c in KNOWN if ord(c) in (*range(9, 14), 0x20, 0x85, 0xA0))
UNKNOWN = re.compile("[^\x00-ɏ‐-‧€]")
#: Characters of text that one set of numpy arrays takes, and words that a worker remembers.
CHUNK_CHARS, CACHE_WORDS = 1_000_000, 250_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if it prints, else the next free one from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    names = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Words(dict):
    """Numbers words as they come; new holds those without ids."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i


class WordBPE:
    """A byte-level BPE vocabulary with an end-of-word suffix, as a tokenizers JSON file holds it."""

    def __init__(self, spec: bytes):
        from tokenizers import Tokenizer

        parsed = json.loads(spec)
        model = parsed["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        lib = Tokenizer.from_str(spec.decode())
        self.normalizer, self.splitter = lib.normalizer, lib.pre_tokenizer
        names = byte_symbols()
        self.of_name = {n: b for b, n in enumerate(names)}
        self.inner = np.array([self.vocab[n] for n in names], np.int64)
        self.last = np.array([self.vocab[n + self.suffix] for n in names], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([self.vocab[a + b] for a, b in merges], np.int64)[order]
        tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        texts = [tokens.get(i, "").encode() + b" " for i in range(max(tokens) + 1)]
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.token_len = np.array([len(t) for t in texts], np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        letters = "".join(re.escape(c) for c in KNOWN if unicodedata.category(c)[0] == "L")
        numbers = "".join(re.escape(c) for c in KNOWN if unicodedata.category(c)[0] == "N")
        spaces = re.escape(SPACES)
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall
        self.forget()

    def forget(self) -> None:
        self.words = Words()
        self.flat, self.at, self.len = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        """A text's words. Words that begin with \\0\\0 stand for special tokens' ids."""
        if self.at_special is not None and self.at_special.search(text):
            return [w for i, part in enumerate(self.at_special.split(text)) for w in ([f"\0\0{self.special[part]}"] if i % 2 else self.split(part))]
        if text.isascii() or not UNKNOWN.search(text):
            words = self.find(text.lower())
            return words if "\0" not in text else ["\0" + w if w.startswith("\0") else w for w in words]
        of = self.of_name
        found = (bytes(of[c] for c in w).decode() for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)))
        return ["\0" + w if w.startswith("\0") else w for w in found]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one flat array, and each word's number of ids."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[raw], np.repeat(np.arange(len(words)), n)
        ends = np.cumsum(n) - 1
        sym[ends] = self.last[raw[ends]]
        done_word, done_sym = [], []
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (word[:-1] == word[1:]), self.ranks[at], len(self.keys))
            rank = np.append(rank, len(self.keys))
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, start)
            sizes = np.diff(np.append(start, len(sym)))
            lowest = np.repeat(low, sizes)
            live = lowest < len(self.keys)
            if not live.all():
                done_word.append(word[~live])
                done_sym.append(sym[~live])
            hit = np.flatnonzero((rank == lowest) & live)
            if not len(hit):
                break
            # where places overlap (a pair of equal symbols), every second one from the left counts
            run = np.append(True, np.diff(hit) > 1)
            first = np.repeat(np.flatnonzero(run), np.diff(np.append(np.flatnonzero(run), len(hit))))
            hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
            sym[hit] = self.made[at[hit]]
            live[hit + 1] = False
            sym, word = sym[live], word[live]
        all_word, all_sym = np.concatenate([*done_word, word[:0]]), np.concatenate([*done_sym, sym[:0]])
        order = np.argsort(all_word, kind="stable")
        return all_sym[order].astype(np.int32), np.bincount(all_word, minlength=len(words))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one flat array, and where each text's ids begin and end."""
        if len(self.words) > CACHE_WORDS:
            self.forget()
        split = [self.split(t) for t in texts]
        index = np.fromiter((i for words in split for i in map(self.words.__getitem__, words)), np.int64)
        if new := self.words.new:
            self.words.new = []
            given = {i: int(w[2:]) for i, w in enumerate(new) if w.startswith("\0\0") and w[2:].isdigit()}
            ids, n = self.merge([(w[1:] if w.startswith("\0") else w).encode("utf-8", "replace") if i not in given else b"x" for i, w in enumerate(new)])
            at = np.cumsum(n) - n
            for i, special in given.items():
                ids[at[i]] = special
            self.at = np.append(self.at, at + len(self.flat))
            self.flat, self.len = np.append(self.flat, ids), np.append(self.len, n)
        n = self.len[index]
        ids = self.flat[spread(self.at[index], n)]
        ends = np.cumsum(np.append(0, np.fromiter(map(len, split), np.int64, len(split))))
        return ids, np.append(0, np.cumsum(n))[ends]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.StringArray:
        """Each text's tokens, joined by a space."""
        n = self.token_len[ids]
        full = np.flatnonzero(np.diff(bounds))
        n[bounds[full + 1] - 1] -= 1
        data = self.token_bytes[spread(self.token_at[ids], n)]
        offsets = np.append(0, np.cumsum(n))[bounds].astype(np.int32)
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes()))


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (n[0] of them), at[1], ..."""
    total = int(n.sum())
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(total)


_loaded: dict[bytes, WordBPE] = {}


def loaded(spec: bytes) -> WordBPE:
    """A worker's vocabulary, parsed once."""
    if spec not in _loaded:
        _loaded.clear()
        _loaded[spec] = WordBPE(spec)
        release()  # of what parsing took
    return _loaded[spec]


def pieces(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_CHARS; a longer row stands alone."""
    i, total = 0, np.append(0, np.cumsum(lengths))
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(total, total[i] + CHUNK_CHARS, "right")) - 1)
        yield i, j
        i = j


def _spec(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, a few MB


def _schema(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name not in more] + [T.StructField(k, v) for k, v in more.items()])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of column text (null: none) as array<int>, and with decoded the text that these ids decode to."""
    spec = _spec(df, path)
    kept = [c for c in df.columns if c not in (ids, decoded)]
    order = {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            column = batch.column(order[text])
            for i, j in pieces(np.asarray(pa.compute.coalesce(pa.compute.binary_length(column), 0), np.int64)):
                flat, bounds = bpe.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                out = [batch.column(order[c]).slice(i, j - i) for c in kept]
                out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32())))
                if decoded:
                    out.append(bpe.decode(flat, bounds))
                yield pa.RecordBatch.from_arrays(out, [*kept, ids, *([decoded] if decoded else [])])

    more = {ids: T.ArrayType(T.IntegerType())} | ({decoded: T.StringType()} if decoded else {})
    return df.mapInArrow(lean(run), _schema(df, **more))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text that column ids (array<int>; null: none) decodes to, special tokens included."""
    spec = _spec(df, path)
    kept = [c for c in df.columns if c != decoded]
    order = {c: i for i, c in enumerate(df.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(spec.value)
        for batch in batches:
            column = batch.column(order[ids])
            sizes = np.asarray(pa.compute.coalesce(pa.compute.list_value_length(column), 0), np.int64)
            for i, j in pieces(sizes * 8):
                part = column.slice(i, j - i)
                flat = np.asarray(part.flatten(), np.int64)
                bounds = np.append(0, np.cumsum(sizes[i:j]))
                yield pa.RecordBatch.from_arrays([*(batch.column(order[c]).slice(i, j - i) for c in kept), bpe.decode(flat, bounds)], [*kept, decoded])

    return df.mapInArrow(lean(run), _schema(df, **{decoded: T.StringType()}))
