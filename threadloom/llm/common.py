"""Shared pieces: hashing of texts in numpy, cached tokenization, shard exchange, shared files."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from threadloom.runtime import scratch_path

_RNG = np.random.default_rng(20240229)
_BYTE_WEIGHT = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept per worker up to the longest text seen."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(12, int(n).bit_length())
        for name, step in (("up", _BASE), ("down", _INVERSE)):
            powers = np.full(size, step, np.uint64)
            powers[0] = 1
            _POWERS[name] = np.multiply.accumulate(powers)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _times_base(k: int) -> np.uint64:
    return np.uint64(k * int(_BASE) & (1 << 64) - 1)


class Rolling:
    """Hashes of any substring of one byte string after a single pass over it."""

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        self.n = len(raw)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTE_WEIGHT[raw] * up[: self.n], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _BASE)

    def grams(self, k: int) -> np.ndarray:
        """The hash of every substring of k bytes, by start."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1] + _times_base(k))


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words (runs without ASCII white space) of a lower-cased text, in order."""
    if not data:
        return np.zeros(0, np.uint64)
    start, end = word_bounds(data)
    return Rolling(data).span(start, end)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _SPACE[np.frombuffer(data, np.uint8)]
    return np.flatnonzero(blank[:-2] & ~blank[1:-1]), np.flatnonzero(~blank[1:-1] & blank[2:]) + 1


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Order-dependent hashes of every k words in a row; a shorter text is one shingle."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * _BASE + words[i: len(words) - k + 1 + i])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every run, one run after another."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1])


def _byte_chars() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies: itself if it is a visible
    Latin-1 character, else the next free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


_BYTE_CHARS = dict(enumerate(_byte_chars())) | {10: "\n"}  # a space is \u0120; a line break stays: it parts the words that are spelled at once
_WORD = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\\[-`{-~][!-/:-@\\[-`{-~]*)?(?:\n(.+))?", re.S)
_BLANKS = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "] + ["\x1c", "\x1d", "\x1e", "\x1f"]


def _blank_beside_space(text: str) -> bool:
    return " " in (text[0], text[-1]) or "  " in text or any(c in text and (c + " " in text or " " + c in text) for c in _BLANKS)


class ChunkTokenizer:
    """Encodes texts with a public tokenizer file, each distinct chunk once per worker.

    A chunk ends before a single space that has no other white space beside it. Neither the
    normalizers nor the pre-tokenizers of word-level and byte-level BPE files look across such a
    place, so the ids of a text are those of its chunks in order. A text with any other place
    where a space touches white space is encoded whole. A chunk of a word, the marks after it and more after
    a line break is put together from the ids of these. Beyond `limit` entries the cache keeps the more used half; it
    never changes a result. Strings of special tokens inside a text are ordinary text.

    A key of the cache is a string without the space that byte-level words carry before them; one that has no space
    before it, at the start of a text or inside a chunk, has a space as a mark of that.
    """

    def __init__(self, path: str, limit: int = 400_000):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            pre = json.dumps(json.load(f)["pre_tokenizer"])
        self.lead = " " if '"use_regex": true' in pre else ""  # byte-level words carry the space before them
        self.limit, self.model = limit, self.tokenizer.model
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length, self.uses = (np.zeros(1 << 14, np.int64) for _ in range(3))

    @property
    def width(self) -> int:
        """Bytes that hold every id."""
        return 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4

    def _text(self, key: str) -> str:
        return key if not self.lead else key[1:] if key[0] == " " else " " + key

    def _add_words(self, keys: list[str], at_once: int = 4096) -> None:
        """Latin letters with at most a space before them: one pre-token each."""
        for a in range(0, len(keys), at_once):
            some = keys[a: a + at_once]
            spelled = "\n".join(map(self._text, some)).encode().decode("latin-1").translate(_BYTE_CHARS).split("\n")
            found = list(map(self.model.tokenize, spelled))
            self._add(some, np.fromiter(map(len, found), np.int64, len(found)), np.array([t.id for tokens in found for t in tokens], np.uint32))

    def _add(self, keys: list[str], lengths: np.ndarray, flat: np.ndarray) -> None:
        first = len(self.index)
        last = first + len(keys)
        self.index.update(zip(keys, range(first, last)))
        while last > len(self.start):
            self.start, self.length, self.uses = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.length, self.uses))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used: self.used + len(flat)] = flat
        self.length[first: last], self.uses[first: last] = lengths, 0
        self.start[first: last] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)

    def _learn(self, missing: set[str]) -> None:
        index, lead, words, others = self.index, self.lead, {}, {}
        made, parts, counts = [], [], []  # chunks put together, the keys of their parts, how many each has
        for key in missing:
            if lead and key.isalpha() and key.isascii():
                words[key] = None
                continue
            text, first, whole = self._text(key), len(parts), True
            while text and whole:
                m = _WORD.fullmatch(text)
                whole = m is not None
                if whole:  # a word, the marks after it and what follows a line break
                    word, marks, text = m.groups()
                    parts.append(word.lower() if not lead else word[1:] if word[0] == " " else " " + word)
                    if parts[-1] not in index:
                        words[parts[-1]] = None
                    for tail in (marks, text and "\n"):
                        if tail:
                            parts.append(lead + tail)
                            if parts[-1] not in index:
                                others[parts[-1]] = None
            if first < len(parts) and whole and parts[first:] != [key]:
                made.append(key)
                counts.append(len(parts) - first)
            else:
                if first == len(parts) or not whole:
                    others[key] = None
                del parts[first:]
        self._add_words(list(words))
        keys = list(others)
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([self._text(c) for c in keys], add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(keys, lengths, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())))
        at = np.fromiter(map(index.__getitem__, parts), np.int64, len(parts))
        np.add.at(self.uses, at, 1)
        total = np.concatenate([[0], np.cumsum(self.length[at])])[np.cumsum([0, *counts])]
        self._add(made, np.diff(total), self.ids[ragged(self.start[at], self.length[at])])

    def _shrink(self) -> None:
        """Keep what was used more often than the median entry; uses count half from then on."""
        uses = self.uses[: len(self.index)]
        keep = np.flatnonzero(uses > np.median(uses))
        keys, lengths, uses = list(self.index), self.length[keep], uses[keep] // 2
        flat = self.ids[ragged(self.start[keep], lengths)]
        self._clear()
        self._add([keys[i] for i in keep.tolist()], lengths, flat)
        self.uses[: len(keep)] = uses

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > self.limit:
            self._shrink()
        whole = [" " in text and _blank_beside_space(text) for text in texts]
        cut = [("", "", "") if w else text.partition(" ") for text, w in zip(texts, whole)]
        parts = pc.split_pattern(pa.array([rest if space else None for _, space, rest in cut], pa.large_string()), " ")
        codes = parts.flatten().dictionary_encode()
        chunks = [*(self.lead + first for first, _, _ in cut), *codes.dictionary.to_numpy(False).tolist()]  # to_pylist makes a scalar of each
        at = np.fromiter(map(self.index.get, chunks, repeat(-1)), np.int64, len(chunks))
        unseen = np.flatnonzero(at < 0)
        if len(unseen):
            new = [chunks[i] for i in unseen.tolist()]
            self._learn(set(new))
            at[unseen] = [self.index[c] for c in new]
        counts = np.asarray(pc.fill_null(pc.list_value_length(parts), 0).to_numpy(False), np.int64)
        at = np.insert(at[len(cut):][codes.indices.to_numpy(False)], np.cumsum(counts) - counts, at[: len(cut)])
        self.uses[: len(self.index)] += np.bincount(at, minlength=len(self.index))
        lengths = self.length[at]
        flat = self.ids[ragged(self.start[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts + 1)])]
        out = [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]
        for i in np.flatnonzero(whole).tolist():
            out[i] = np.asarray(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def tokenizer(path: str) -> ChunkTokenizer:
    """One per Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkTokenizer(path)
    return _TOKENIZERS[path]


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text (one row at least), so memory is bound."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(False), np.int64)
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a task; at their end Arrow gives its unused memory back, as the Python worker stays for the tasks of other stages."""
    yield from batches
    pa.default_memory_pool().release_unused()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def kept(df: DataFrame, name: str, **options) -> DataFrame:
    """Written to shared storage and read back: lineage ends here and sizes are known to the planner. `options` are the writer's."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it, for folders on shared storage."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def commit_file(folder: str, name: str, write: Callable) -> int:
    """Write through a temporary name, then rename; a retried task replaces its own file. Returns bytes."""
    fs, base = store(folder)
    temporary = posixpath.join(base, f"_temporary-{name}-{uuid.uuid4().hex}")
    with fs.open_output_stream(temporary) as out:
        write(out)
    size = fs.get_file_info(temporary).size
    fs.move(temporary, posixpath.join(base, name))
    return size


def make_folder(spark: SparkSession, name: str) -> str:
    folder = scratch_path(spark, name)
    fs, base = store(folder)
    fs.create_dir(base, recursive=True)
    return folder


def in_fold(doc_id, folds: int, fold: int):
    """crc32 of the id as text, modulo `folds`, equals `fold`; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))
