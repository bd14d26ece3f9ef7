"""Key phrases of whole documents: n-grams ranked by TF-IDF cosine, spread by marginal relevance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from threadloom.functions.text import tokens
from threadloom.runtime import spread, stored

BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20  # a block of documents that share one list of word weights


def pick_phrases(words: list[str], weight: dict[str, float], top: int, diversity: float, max_n: int) -> list[str]:
    """Greedy choice of `top` phrases of 1..max_n words from one document's tokens."""
    if not len(words):
        return []
    vocab = sorted(set(words))
    place = {v: i for i, v in enumerate(vocab)}
    ids = np.fromiter((place[v] for v in words), "int64", len(words))
    w = np.array([weight.get(v, 0.0) for v in vocab])
    doc = np.bincount(ids, minlength=len(vocab)) * w
    doc_norm = np.sqrt((doc * doc).sum())
    # candidates as rows of word ids, padded with an extra word of weight 0
    pad = len(vocab)
    w, doc = np.append(w, 0.0), np.append(doc, 0.0)
    base = pad + 1  # a phrase is a number in this base, so distinct phrases are distinct numbers
    codes = []
    for n in range(1, min(max_n, len(ids)) + 1):
        code = np.zeros(len(ids) - n + 1, dtype="int64")
        for j in range(max_n):
            code = code * base + (ids[j:len(ids) - n + 1 + j] if j < n else pad)
        codes.append(code)
    code = np.unique(np.concatenate(codes))  # in vocabulary order, so ties are settled by text
    cand = np.stack([code // base ** (max_n - 1 - j) % base for j in range(max_n)], axis=1)
    cw = w[cand]
    squares = (cw * cw).sum(axis=1)
    for i in range(max_n):
        for j in range(i):  # a word that is in the phrase twice
            squares += 2 * (cand[:, i] == cand[:, j]) * cw[:, i] * cw[:, j]
    norm = np.sqrt(squares)
    ok = norm > 0
    cand, cw, norm = cand[ok], cw[ok], norm[ok]
    if not len(cand) or doc_norm == 0:
        return []
    relevance = np.round((cw * doc[cand]).sum(axis=1) / (norm * doc_norm), 9)
    closest = np.zeros(len(cand))
    chosen: list[int] = []
    for _ in range(min(top, len(cand))):
        score = relevance if not chosen else (1 - diversity) * relevance - diversity * closest
        score = np.round(score, 9)
        score[chosen] = -np.inf
        best = int(score.argmax())
        chosen.append(best)
        held = np.bincount(cand[best], cw[best], minlength=len(w))
        sim = (cw * held[cand]).sum(axis=1) / (norm * norm[best])
        closest = np.maximum(closest, sim) if len(chosen) > 1 else sim
    return [" ".join(vocab[i] for i in cand[c] if i != pad) for c in chosen]


def word_weights(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(term, idf) over all documents. Store it and pass it to `keyphrases`, so that a batch of any size
    gives a document the same phrases as the whole table."""
    seen = spread(docs.select(key, text)).select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    return _weights(docs, seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")))


def _weights(docs: DataFrame, frequency: DataFrame) -> DataFrame:
    total = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    return frequency.select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) rows with the number of their block: consecutive rows of one task."""
    block, rows, size = TaskContext.get().partitionId() << 33, 0, 0
    for b in batches:
        number = []
        for n in pc.fill_null(pc.binary_length(b.column(1)), 0).to_pylist():
            if rows and (rows == BLOCK_DOCS or size + n > BLOCK_BYTES):
                block, rows, size = block + 1, 0, 0
            rows, size = rows + 1, size + n
            number.append(block)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number, pa.int64())], [*b.schema.names, "_block"])


def keyphrases(docs: DataFrame, key: str, text: str, top: int = 5, diversity: float = 0.5, max_n: int = 3,
               idf: DataFrame | None = None) -> DataFrame:
    """(key, keywords): key phrases per document; a document that fails gets an empty list.

    `idf` holds weights counted elsewhere (`word_weights`); a word that it lacks is left out.

    Document frequencies are a partial aggregate. Documents are cut into blocks, and a block's distinct
    words ask for their weights once, however many of its documents hold them; texts and weights of a
    block then meet in one task, where the greedy choice runs per document.
    """
    key_type = dict(docs.dtypes)[key]
    # stored, as the numbers of the blocks are read twice
    cut = stored(spread(docs.select(key, F.col(text).alias("_text"))).mapInArrow(_blocks, f"`{key}` {key_type}, _text string, _block bigint"), "blocks")
    asked = cut.select("_block", F.explode(F.array_distinct(tokens(F.col("_text")))).alias("term")).groupBy("_block", "term").agg(F.count(F.lit(1)).alias("n"))
    if idf is None:  # the weights of `word_weights`, from the same count
        asked = stored(asked, "asked")
        idf = stored(_weights(cut, asked.groupBy("term").agg(F.sum("n").alias("df"))), "idf")
    weights = asked.join(idf, "term").select(F.col("_block").alias("_of"), "term", "idf")
    # texts are cut into words after their shuffle
    texts = cut.repartition("_block").select("_block", key, tokens(F.col("_text")).alias("words"))

    def run(rows: pa.Table, known: pa.Table) -> pa.Table:
        weight = dict(zip(known.column("term").to_pylist(), known.column("idf").to_pylist()))
        keys, out = rows.column(key), []
        for own, words in zip(keys, rows.column("words")):
            try:
                out.append(pick_phrases(words.as_py(), weight, top, diversity, max_n) if own.is_valid else [])
            except Exception:
                out.append([])
        return pa.table({key: keys, "keywords": pa.array(out, pa.list_(pa.string()))})

    return texts.groupBy("_block").cogroup(weights.groupBy("_of")).applyInArrow(run, f"`{key}` {key_type}, keywords array<string>")


def attach_keywords(docs: DataFrame, phrases: DataFrame, key: str) -> DataFrame:
    """Documents with their phrase texts; none is an empty list."""
    return docs.join(phrases.select(key, "keywords"), key, "left").withColumn(
        "keywords", F.coalesce("keywords", F.array().cast("array<string>")))
