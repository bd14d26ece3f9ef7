"""Pluggable per-batch functions: embedding, inference with retries, query expansion."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from threadloom.functions.text import tokens
from threadloom.operators.extract import pain_point_filter, pain_points_of, persona_filter, personas_of
from threadloom.runtime import commit_text, has_file, make_dir, spread


def hashed_terms(dims: int) -> Callable[[pd.Series], list[np.ndarray]]:
    """Default offline embedding of token lists: term counts by hashed bucket, unit length."""

    def embed(token_lists: pd.Series) -> list[np.ndarray]:
        bucket: dict[str, int] = {}
        out = []
        for words in token_lists:
            for w in words:
                if w not in bucket:
                    bucket[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dims
            v = np.bincount([bucket[w] for w in words], minlength=dims).astype("float64") if len(words) else np.zeros(dims)
            n = np.sqrt((v * v).sum())
            out.append(v / n if n > 0 else v)
        return out

    return embed


def embed_column(
    df: DataFrame, text: str, out: str = "v", fn: Callable[[pd.Series], list] | None = None,
    dims: int = 256, prefix: str = "",
) -> DataFrame:
    """Add a vector of a text column. `fn` gets a series of prefixed texts and returns vectors,
    which are cut to `dims` without scaling; without `fn` the hashed-term vector is used."""
    default = fn is None
    call = hashed_terms(dims) if default else fn

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.asarray(v, dtype="float64")[:dims] for v in call(batch)])

    source = F.concat(F.lit(prefix), F.col(text))
    return spread(df).withColumn(out, embed(tokens(source) if default else source))


def _asker(key: str, text: str, fn: Callable[[list[str]], list[str]], batch_rows: int, attempts: int, pause: float):
    """Answers of one list of rows: the list at once, else row by row."""
    def attempt(texts: list[str]):
        last = ""
        for n in range(attempts):
            try:
                got = list(fn(texts))
                if len(got) != len(texts):
                    raise ValueError("one result per text is needed")
                return got, None
            except Exception as e:
                last = f"{type(e).__name__}: {e}"
                if pause:
                    time.sleep(pause * (n + 1))
        return None, last

    def ask(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
        got, error = attempt(part[text].tolist())
        if got is not None:
            yield pd.DataFrame({key: part[key], "ok": True, "result": got, "error": None})
            return
        rows = []
        for k, value in zip(part[key], part[text]):
            one, error = attempt([value])
            rows.append((k, one is not None, one[0] if one else "", error))
        yield pd.DataFrame(rows, columns=[key, "ok", "result", "error"])

    return ask


def batch_infer(
    df: DataFrame, key: str, text: str, fn: Callable[[list[str]], list[str]], key_type: str = "bigint",
    batch_rows: int = 32, attempts: int = 3, pause: float = 0.0, concurrency: int | None = None,
) -> DataFrame:
    """Run `fn` on lists of texts; rows of a list that still fails after `attempts` get an error.

    A failing list is then tried row by row, so one bad row does not cost its neighbours.
    At most `concurrency` calls run at once when given; otherwise one per core.
    """
    if concurrency:
        df = df.select(key, text).coalesce(concurrency)
    ask = _asker(key, text, fn, batch_rows, attempts, pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                yield from ask(pdf.iloc[start:start + batch_rows])

    return df.select(key, text).mapInPandas(run, f"{key} {key_type}, ok boolean, result string, error string")


def infer_with_ledger(
    df: DataFrame, key: str, text: str, fn: Callable[[list[str]], list[str]], path: str, key_type: str = "bigint",
    batch_rows: int = 32, attempts: int = 3, pause: float = 0.0, concurrency: int | None = None,
) -> DataFrame:
    """`batch_infer` whose answers are committed under `path`, list by list, as they come.

    A list's answers are one file, written under a temporary name and renamed. A restart asks only for keys without
    an answer; a task that runs again (a lost executor) finds the files of its lists and does not ask for them again.
    `concurrency` bounds the calls in flight by merging input splits, without shuffling the table. Keys must be
    unique; a key with an error counts as answered.
    """
    spark = df.sparkSession
    fields = f"{key} {key_type}, ok boolean, result string, error string"
    make_dir(path)
    done = spark.read.schema(fields).option("pathGlobFilter", "*.json").json(path)
    missing = df.select(key, text).join(done.select(F.col(key)), key, "left_anti")
    if concurrency:
        missing = missing.coalesce(concurrency)
    ask = _asker(key, text, fn, batch_rows, attempts, pause)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start:start + batch_rows]
                name = hashlib.md5("|".join(map(str, part[key])).encode()).hexdigest() + ".json"
                if not has_file(path, name):
                    commit_text(path, name, "".join(json.dumps({k: (v.item() if hasattr(v, "item") else v) for k, v in r.items()}) + "\n"
                                                    for got in ask(part) for r in got.to_dict("records")))
                yield pd.DataFrame({"n": [len(part)]})

    missing.mapInPandas(run, "n bigint").agg(F.sum("n")).collect()
    return spark.read.schema(fields).option("pathGlobFilter", "*.json").json(path)


def structured_extract(
    df: DataFrame, key: str, text: str, fn: Callable[[list[str]], list[str]], known: DataFrame,
    kind: str = "pain_points", key_type: str = "bigint",
) -> DataFrame:
    """Answers of `fn` -> typed rows -> the ones that pass the quality rules."""
    answered = batch_infer(df, key, text, fn, key_type)
    if kind == "pain_points":
        return pain_point_filter(pain_points_of(answered, "result", [key]), known)
    return persona_filter(personas_of(answered, "result", [key]), known)


# default query expansion when no generator is given
QUERY_TEMPLATES = ("{q}", "problems with {q}", "best way to {q}", "why {q}", "alternatives to {q}")


def expand_queries(
    requests: DataFrame, key: str, text: str, templates: tuple[str, ...] = QUERY_TEMPLATES,
    hypothetical: str = "A post about {q}.",
) -> DataFrame:
    """Each request becomes several query texts, each paired with one hypothetical document."""
    filled = F.array(*[F.replace(F.lit(t), F.lit("{q}"), F.col(text)) for t in templates])
    return requests.select(key, F.posexplode(filled).alias("query_no", "query")).select(
        key, F.col("query_no").cast("bigint").alias("query_no"), "query",
        F.replace(F.lit(hypothetical), F.lit("{q}"), F.col("query")).alias("hypothetical"),
    )


def flatten_lists(df: DataFrame, key: str, lists: str) -> DataFrame:
    """One row per list element with its place, ready for a batched function."""
    return df.select(key, F.posexplode(lists).alias("pos", "value"))


def regroup_lists(df: DataFrame, key: str) -> DataFrame:
    """Elements back to one list per row, in place; a list is as long as its own input list."""
    items = F.array_sort(F.collect_list(F.struct("pos", "value")))
    return df.groupBy(key).agg(F.transform(items, lambda x: x["value"]).alias("values"))
