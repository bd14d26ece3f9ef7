"""Reading and writing files of the pipeline."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from threadloom import schemas
from threadloom.functions.vectors import parse_vector_text, vector_text
from threadloom.operators.ranking import with_row_index


def scan_by_suffix(spark: SparkSession, directory: str, suffix: str, schema: T.StructType) -> DataFrame:
    """All `*<suffix>.parquet` of a directory as one table, read with a fixed schema; none is empty."""
    try:
        return spark.read.schema(schema).parquet(f"{directory}/*{suffix}.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_threads(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    """Posts and comments of a landing directory; an error when there is neither row."""
    posts = scan_by_suffix(spark, directory, "-posts", schemas.POSTS)
    comments = scan_by_suffix(spark, directory, "-comments", schemas.COMMENTS)
    if posts.isEmpty() and comments.isEmpty():
        raise ValueError("no posts and no comments to process")
    return posts, comments


def project_fields(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the fields of `schema`, in order and typed; a missing one is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def audit_files(spark: SparkSession, patterns: list[str], rows: int = 10) -> DataFrame:
    """One row per file: can its first rows be read?

    Files are listed without their content and spread over tasks; each task opens the footer
    and one small batch of its own files. Store names are mapped to those the reader knows
    (`s3a`, `s3n` to `s3`); a store that it cannot open at all is an error, not a broken file.
    """
    listed = spark.read.format("binaryFile").load(patterns).select("path", "length")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        import pyarrow.parquet as pq
        from pyarrow import fs

        for pdf in batches:
            ok = []
            for path in pdf["path"]:
                known = re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "file:///", path))
                system, inner = fs.FileSystem.from_uri(known)  # outside the try: not the file's fault
                try:
                    with system.open_input_file(inner) as f:
                        next(pq.ParquetFile(f).iter_batches(batch_size=rows), None)
                    ok.append(True)
                except Exception:
                    ok.append(False)
            yield pd.DataFrame({"path": pdf["path"], "length": pdf["length"], "readable": ok})

    return listed.repartition("path").mapInPandas(check, "path string, length bigint, readable boolean")


def write_parquet(
    df: DataFrame, path: str, codec: str = "snappy", index_by: list[Column] | None = None, mode: str = "errorifexists"
) -> None:
    """Parquet with a codec; `index_by` adds a 0-based `row_index` in that order."""
    if index_by:
        df = with_row_index(df, index_by, "row_index", start=0)
    df.write.mode(mode).option("compression", codec).parquet(path)


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_rows: int = 10_000
) -> DataFrame:
    """Run `fn` on batches of at most `batch_rows` rows; a failed batch is run again row by row, and a
    row that fails alone gives one error row with its own values where `schema` names its columns.

    Output is `schema` plus `error`; the size is cut inside the task, so the session's Arrow
    batch size does not have to be changed.
    """
    names = [f.name for f in T.StructType.fromDDL(schema).fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start:start + batch_rows]
                try:
                    out = fn(part)[names].copy()
                    out["error"] = None
                    yield out
                    continue
                except Exception:  # the job goes on, and only rows that fail alone are errors
                    pass
                for at in range(len(part)):
                    one = part.iloc[at:at + 1]
                    try:
                        out = fn(one)[names].copy()
                        out["error"] = None
                    except Exception as e:
                        own = {n: one[n].iloc[0] if n in one else None for n in names}
                        out = pd.DataFrame([{**own, "error": f"{type(e).__name__}: {e}"}])
                    yield out

    return df.mapInPandas(run, f"{schema}, error string")


def search_document(df: DataFrame) -> DataFrame:
    return project_fields(df, schemas.SEARCH_DOCUMENT)


def put_lines(docs: DataFrame, namespace: str, doc_type: str, key: str) -> DataFrame:
    """One JSON line per document: `{"put": id, "fields": {...}}`; null fields are written as null."""
    # fixed values: the shapes of the feed lines here and below
    put = F.concat(F.lit(f"id:{namespace}:{doc_type}::"), F.col(key).cast("string"))
    line = F.to_json(
        F.struct(put.alias("put"), F.struct(*docs.columns).alias("fields")), {"ignoreNullFields": "false"}
    )
    return docs.select(line.alias("value"))


def update_vector_lines(df: DataFrame, key: str, vector: str, namespace: str, doc_type: str) -> DataFrame:
    """Partial-update lines that assign a vector printed with six decimals."""
    doc = F.concat(F.lit(f"id:{namespace}:{doc_type}::"), F.col(key).cast("string"))
    return df.select(F.concat(
        F.lit('{"update": "'), doc, F.lit('", "fields": {"embedding": {"assign": { "values": ['),
        vector_text(F.col(vector), 6), F.lit("]} }}}"),
    ).alias("value"))


def put_user_vector_lines(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Full user documents with their id and vector."""
    k = F.col(key).cast("string")
    return df.select(F.concat(
        F.lit('{"put": "id:user:user::'), k, F.lit('", "fields": {"user_id":"'), k,
        F.lit('", "embedding": {"values": ['), vector_text(F.col(vector), 6), F.lit("]} }}"),
    ).alias("value"))


def update_category_lines(df: DataFrame, key: str, category: str, parent: str) -> DataFrame:
    """Partial-update lines with a parent reference and a one-hot category map."""
    fields = F.struct(
        F.struct(F.lit(parent).alias("assign")).alias("category_ctr_ref"),
        F.struct(F.struct(F.array(F.struct(
            F.struct(F.col(category).alias("category")).alias("address"), F.lit(1.0).alias("value")
        )).alias("cells")).alias("assign")).alias("category_tensor"),
    )
    update = F.concat(F.lit("id:news:news::"), F.col(key).cast("string"))
    return df.select(F.to_json(F.struct(update.alias("update"), fields.alias("fields"))).alias("value"))


def ctr_document(ctr: DataFrame) -> DataFrame:
    """The parent document: one map cell per category (as many as there are categories)."""
    cells = F.array_sort(F.collect_list(F.struct(
        F.struct(F.col("category").alias("category")).alias("address"), F.col("ctr").alias("value")
    )))
    return ctr.agg(cells.alias("cells")).select(F.to_json(F.struct(
        F.lit("id:category_ctr:category_ctr::global").alias("put"),
        F.struct(F.struct("cells").alias("ctrs")).alias("fields"),
    )).alias("value"))


def scan_tsv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Headerless tab-separated text with a fixed field list; quotes mean nothing."""
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").option("escape", "").csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("quote", "").option("escapeQuotes", "false").option(
        "emptyValue", "").option("nullValue", "").csv(path)


def write_vector_tsv(df: DataFrame, key: str, vector: str, path: str, digits: int = 6) -> None:
    df.select(F.concat_ws("\t", F.col(key).cast("string"), vector_text(F.col(vector), digits)).alias("value")).write.text(path)


def read_vector_tsv(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split(F.col("value"), "\t")
    return spark.read.text(path).select(parts[0].alias("id"), parse_vector_text(parts[1]).alias("vector"))
