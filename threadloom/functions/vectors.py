"""Column functions over array<float|double> vectors; arithmetic is in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null when either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def euclidean(a: Column, b: Column) -> Column:
    sq = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def l2_normalise(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(as_double(v))


def closeness(distance: Column) -> Column:
    return 1 / (1 + distance)


def angular_closeness(a: Column, b: Column) -> Column:
    return closeness(1 - cosine(a, b))


def truncate_dims(v: Column, n: int) -> Column:
    """The first n components, not scaled again."""
    return F.slice(v, 1, n)


def binarise(v: Column, dims: int, word: int = 64) -> Column:
    """Sign bits packed into array<bigint>; the first component is the highest bit of its word."""
    bits = as_double(v)
    words = []
    for start in range(0, dims, word):
        width = min(word, dims - start)
        piece = F.aggregate(
            F.slice(bits, start + 1, width), F.lit(0).cast("bigint"),
            lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("bigint")),
        )
        words.append(piece)
    return F.array(*words)


def code_bytes(v: Column, dims: int) -> Column:
    """The same sign bits as bytes 0..255, eight components each."""
    return binarise(v, dims, word=8)


def signed_bytes(v: Column, dims: int) -> Column:
    return F.transform(code_bytes(v, dims), lambda b: b - 128)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two packed codes."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("bigint")),
        F.lit(0).cast("bigint"), lambda s, x: s + x,
    )


def unpack_signs(code: Column, dims: int, word: int = 64) -> Column:
    """Packed bits back to -1 / +1."""

    def signs(bits: Column, width: int) -> Column:
        return F.transform(
            F.sequence(F.lit(width - 1), F.lit(0)), lambda i: F.getbit(bits, i).cast("double") * 2 - 1
        )

    return F.concat(*[
        signs(code[n], min(word, dims - start)) for n, start in enumerate(range(0, dims, word))
    ])


def unpack_dot(code: Column, query: Column, dims: int) -> Column:
    return dot(unpack_signs(code, dims), query)


def sigmoid_dot(a: Column, b: Column) -> Column:
    return 1 / (1 + F.exp(-dot(a, b)))


def zero_vector(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def vector_text(v: Column, digits: int = 6) -> Column:
    """`v1,v2,...` with a fixed number of decimals."""
    return F.array_join(F.transform(as_double(v), lambda x: F.format_string(f"%.{digits}f", x)), ",")


def parse_vector_text(text: Column) -> Column:
    return F.split(text, ",").cast("array<float>")
