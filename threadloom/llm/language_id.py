"""Language identification with a byte convolutional network, trained and applied in numpy.

Text is lower-cased, encoded as UTF-8 and cut into windows of fixed length that cover all of it.
Bytes are embedded, filters of several widths run over them, each filter keeps its largest value
in the window, and a softmax layer gives the languages' probabilities. A document's probabilities
are the means over its windows, weighted by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from threadloom.llm.common import kept, released, slices

UNKNOWN = "und"


@dataclass
class ByteNet:
    """Weights: embed (256, e), kernel (widest * e, filters) with zeros beyond each filter's width,
    bias (filters), out (filters, languages), out_bias (languages)."""

    languages: list[str]
    window: int
    embed: np.ndarray
    kernel: np.ndarray
    mask: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @property
    def widest(self) -> int:
        return self.kernel.shape[0] // self.embed.shape[1]

    def columns(self, windows: np.ndarray) -> np.ndarray:
        """(windows, positions, widest * e): what each place of the filters sees; zeros past the end."""
        padded = np.zeros((len(windows), self.window + self.widest - 1), np.uint8)
        padded[:, : self.window] = windows
        vectors = self.embed[padded]
        e = self.embed.shape[1]
        view = np.lib.stride_tricks.sliding_window_view(vectors.reshape(len(windows), -1), self.widest * e, axis=1)[:, ::e]
        return np.ascontiguousarray(view)

    def probabilities(self, windows: np.ndarray, at_once: int = 128) -> np.ndarray:
        result = np.empty((len(windows), len(self.languages)), np.float32)
        for a in range(0, len(windows), at_once):
            seen = self.columns(windows[a: a + at_once])
            found = (seen.reshape(-1, seen.shape[2]) @ self.kernel).reshape(len(seen), -1, self.kernel.shape[1]).max(axis=1)
            result[a: a + at_once] = softmax(np.maximum(found + self.bias, 0) @ self.out + self.out_bias)
        return result


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def windows_of(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of the texts, each one's text number and its bytes in use."""
    data = [t.lower().encode("utf-8", "replace") for t in texts]
    counts = np.array([-(-len(d) // size) for d in data], np.int64)
    flat = b"".join(d.ljust(n * size, b"\0") for d, n in zip(data, counts.tolist()))
    used = np.full(int(counts.sum()), size, np.int64)
    last = np.cumsum(counts)[counts > 0] - 1
    sizes = np.array([len(d) for d in data], np.int64)[counts > 0]
    used[last] = sizes - (counts[counts > 0] - 1) * size
    return np.frombuffer(flat, np.uint8).reshape(-1, size), np.repeat(np.arange(len(texts)), counts), used


def fit(texts: list[str], labels: list[str], window: int = 128, embedding: int = 8, widths: tuple[int, ...] = (2, 3, 4),
        filters: int = 16, epochs: int = 6, rate: float = 0.01, batch: int = 64, per_text: int = 6, seed: int = 7) -> ByteNet:
    """Train with Adam on at most `per_text` windows of each text; languages count alike."""
    rng = np.random.default_rng(seed)
    x, of, used = windows_of(texts, window)
    order = rng.permutation(len(x))
    rank = np.empty(len(x), np.int64)  # place of a window among those of its text, in random order
    grouped = order[np.argsort(of[order], kind="stable")]
    starts = np.searchsorted(of[grouped], np.arange(len(texts)))
    rank[grouped] = np.arange(len(x)) - starts[of[grouped]]
    chosen = np.flatnonzero(rank < per_text)
    return _fit(x[chosen], [labels[i] for i in of[chosen]], rng, embedding, widths, filters, epochs, rate, batch)


def _fit(x: np.ndarray, labels: list[str], rng: np.random.Generator, embedding: int = 8, widths: tuple[int, ...] = (2, 3, 4),
         filters: int = 16, epochs: int = 6, rate: float = 0.01, batch: int = 64) -> ByteNet:
    """Train on all the given windows, each with its label."""
    languages, window = sorted(set(labels)), x.shape[1]
    y = np.searchsorted(languages, np.asarray(labels))
    weight = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)).clip(1)).astype(np.float32)
    wide, n = max(widths), filters * len(widths)
    mask = np.zeros((wide, embedding, n), np.float32)
    for i, w in enumerate(widths):
        mask[:w, :, i * filters: (i + 1) * filters] = 1
    mask = mask.reshape(wide * embedding, n)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    net = ByteNet(languages, window, draw(256, embedding, scale=0.5), draw(wide * embedding, n, scale=0.2) * mask, mask,
                  np.zeros(n, np.float32), draw(n, len(languages), scale=0.1), np.zeros(len(languages), np.float32))
    net.embed[0] = 0
    names = ["embed", "kernel", "bias", "out", "out_bias"]
    first = {k: np.zeros_like(getattr(net, k)) for k in names}
    second = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(order), batch):
            rows = order[a: a + batch]
            step += 1
            for k, g in _gradients(net, x[rows], y[rows], weight).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                change = first[k] / (1 - 0.9 ** step) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, k, getattr(net, k) - rate * change.astype(np.float32))
            net.kernel *= net.mask
            net.embed[0] = 0
    return net


def _gradients(net: ByteNet, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    seen = net.columns(x)
    m, places, width = seen.shape
    values = (seen.reshape(-1, width) @ net.kernel).reshape(m, places, -1)
    top = values.argmax(axis=1)
    pooled = np.take_along_axis(values, top[:, None, :], 1)[:, 0] + net.bias
    hidden = np.maximum(pooled, 0)
    p = softmax(hidden @ net.out + net.out_bias)
    p[np.arange(m), y] -= 1
    p *= (weight[y] / m)[:, None]
    back = (p @ net.out.T) * (pooled > 0)
    at = seen[np.arange(m)[:, None], top]  # (m, filters, width): what each filter saw at its maximum
    kernel = np.einsum("mfw,mf->wf", at, back) * net.mask
    e = net.embed.shape[1]
    spread = (back[:, :, None] * net.kernel.T[None]).reshape(m, -1, net.widest, e)
    padded = np.zeros((m, places + net.widest - 1), np.uint8)
    padded[:, : net.window] = x
    read = padded[np.arange(m)[:, None, None], top[:, :, None] + np.arange(net.widest)]
    embed = np.zeros_like(net.embed)
    np.add.at(embed, read.ravel(), spread.reshape(-1, e))
    return {"embed": embed, "kernel": kernel, "bias": back.sum(axis=0), "out": hidden.T @ p, "out_bias": p.sum(axis=0)}


def train(labelled: DataFrame, per_language: int = 400, most: int = 20_000, window: int = 128, per_text: int = 6, seed: int = 7,
          **settings) -> ByteNet | None:
    """Fit on a bounded sample of (text, lang), see `sample`. None if there is no labelled text with a letter."""
    rows = sample(labelled, per_language, most, window, per_text, seed).orderBy("_h", "lang").collect()
    if not rows:
        return None
    x = np.frombuffer(b"".join(bytes(r.windows) for r in rows), np.uint8).reshape(-1, window)
    return _fit(x, [r.lang for r in rows for _ in range(len(r.windows) // window)], np.random.default_rng(seed), **settings)


def sample(labelled: DataFrame, per_language: int, most: int, window: int, per_text: int, seed: int) -> DataFrame:
    """(lang, _h, windows): of each language the `per_language` distinct texts that come first by their hash, or all if
    it has fewer; `most` texts in all. `windows` has `per_text` windows drawn from the whole of a text.

    A share of the hashes that should hold four times the wanted texts is ranked; it is taken of the distinct texts,
    so copies do not shrink it, and it is widened if a language has too few. Texts are not moved, only their windows.
    """
    usable = labelled.filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("_h"))
    hashes = kept(usable.select("lang", "_h").distinct(), "hashes")
    counts = kept(hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    place, share = Window.partitionBy("lang").orderBy("_h"), 4
    while True:
        some = hashes.join(counts, "lang").filter(F.col("_h").cast("double") * F.col("n") < float(share * per_language << 40))
        ranked = kept(some.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= per_language).select("lang", "_h", "_n"), "ranked")
        found = ranked.groupBy("lang").agg(F.count(F.lit(1)).alias("found"))
        short = F.coalesce("found", F.lit(0)) < F.least("n", F.lit(per_language))
        if counts.join(found, "lang", "left").filter(short).isEmpty():
            break
        share *= 16
    last = kept(ranked.orderBy("_n", "lang").limit(most).groupBy("lang").agg(F.max("_h").alias("_last")), "last")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in released(batches):
            rows = []
            for lang, h, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "_h", "text"))):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    data = text.lower().encode("utf-8", "replace")
                    n = -(-len(data) // window)
                    some = np.random.default_rng([seed, h]).choice(n, min(n, per_text), replace=False)
                    rows.append((lang, h, b"".join(data[i * window: (i + 1) * window].ljust(window, b"\0") for i in sorted(some.tolist()))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))],
                                                 ["lang", "_h", "windows"])

    drawn = usable.join(last, "lang").filter("_h <= _last").select("lang", "_h", "text").mapInArrow(draw, "lang string, _h long, windows binary")
    return drawn.groupBy("lang", "_h").agg(F.min("windows").alias("windows"))


def identify(docs: DataFrame, net: ByteNet | None, text: str = "text") -> DataFrame:
    """`docs` plus lang_pred and score (the mean probability of that language, 0 to 1).

    `und` with score 0 if the text is null, has no letter, or nothing was learned. Every window of
    a text counts, whatever its length. Columns named lang_pred or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for part in slices(batch, text, 1 << 18):
                texts = part.column(text).to_pylist()
                found = [UNKNOWN] * len(texts)
                scores = np.zeros(len(texts))
                usable = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
                if net is not None and usable:
                    x, of, used = windows_of([texts[i] for i in usable], net.window)
                    total = np.zeros((len(usable), len(net.languages)))
                    np.add.at(total, of, net.probabilities(x) * used[:, None])
                    mean = total / np.bincount(of, used, len(usable))[:, None]
                    best = mean.argmax(axis=1)
                    for j, i in enumerate(usable):
                        found[i], scores[i] = net.languages[best[j]], min(1.0, float(mean[j, best[j]]))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.string()), pa.array(scores)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(predict, schema)
