"""Column functions over strings, JSON and times. All stay inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F, types as T

from threadloom.constants import EMOTION_POLARITY, SITE_BASE, SQUASH_PI, UUID_NAMESPACE_DNS


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, of the whole text."""
    # cutting at the gaps is several times faster than collecting regex matches
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def strip_type_prefix(link_id: Column) -> Column:
    return F.split_part(link_id, F.lit("_"), F.lit(2))


def title_case(text: Column) -> Column:
    """Capital after every non-letter, unlike initcap, which looks at spaces only."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def post_slug_title(url: Column) -> Column:
    slug = F.nullif(F.regexp_extract(url, r"/r/[^/]+/comments/[^/]+/([^/]+)/", 1), F.lit(""))
    words = F.regexp_replace(slug, "[_-]", " ")
    return title_case(F.regexp_replace(words, r"\.\w+$", ""))


def permalink_title(url: Column) -> Column:
    slug = F.nullif(F.regexp_extract(url, r"/comments/[^/]+/([^/]+)/", 1), F.lit(""))
    return F.replace(slug, F.lit("_"), F.lit(" "))


def full_link(permalink: Column) -> Column:
    return F.concat(F.lit(SITE_BASE), permalink)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def rerank_text(community: Column, title: Column, body: Column) -> Column:
    """What a relevance scorer reads: the whole body."""
    # fixed values: the labels
    return F.concat(F.lit("Subreddit:"), community, F.lit(" Title:"), title, F.lit(" Post: "), body)


def rerank_value(community: Column, title: Column, body: Column, keep: int = 2000) -> Column:
    """The copy kept for display, whose body is cut; scoring never sees this one."""
    return rerank_text(community, title, F.substring(body, 1, keep))


def post_block(fields: list[tuple[str, Column]]) -> Column:
    """A block of labelled lines, one per field."""
    # fixed value: the head line
    lines = [F.concat(F.lit(f"- {label}: "), value.cast("string")) for label, value in fields]
    return F.concat_ws("\n", F.lit("- POST:"), *lines)


def template_fill(template: Column, values: dict[str, Column]) -> Column:
    """Replace `{name}` by its value; a null value leaves the placeholder alone."""
    return reduce(
        lambda t, kv: F.when(kv[1].isNotNull(), F.replace(t, F.lit("{%s}" % kv[0]), kv[1])).otherwise(t),
        values.items(), template,
    )


def choose_template(name: Column, templates: dict[str, str], message: str = "Unknown template") -> Column:
    pairs = [F.lit(x) for kv in templates.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.lit(message))


def parse_bracket_list(text: Column) -> Column:
    """`[a,b,]` -> ['a','b','None']; anything else is a list of itself."""
    s = F.trim(F.replace(text, F.lit("<Finish>"), F.lit("")))
    none_if_blank = lambda c: F.when(c == "", F.lit("None")).otherwise(c)
    inner = F.split(F.substring(s, F.lit(2), F.length(s) - 2), ",")
    items = F.transform(inner, lambda x: none_if_blank(F.trim(x)))
    return F.when(s.startswith("[") & s.endswith("]"), items).otherwise(F.array(none_if_blank(s)))


def tagged_json(text: Column) -> Column:
    """Text between the first <json> and the next </json>, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?s)<json>(.*?)</json>", 1)), F.lit(""))


def tagged_json_list(text: Column, key: str, element: T.DataType) -> Column:
    """The list under `key` of the tagged JSON; empty when anything is missing or broken."""
    schema = T.StructType([T.StructField(key, T.ArrayType(element))])
    return F.coalesce(F.from_json(tagged_json(text), schema)[key], F.array().cast(T.ArrayType(element)))


def escape_quotes(text: Column) -> Column:
    return F.regexp_replace(text, r'(?<!\\)"', r'\\"')


def json_or_empty(text: Column, schema: T.StructType) -> Column:
    """Struct with the fields of `schema` plus `json_ok`; broken text gives nulls and false.

    Text after a complete JSON value is ignored, as in lenient answer parsers.
    """
    ok = F.try_parse_json(text).isNotNull()
    parsed = F.from_json(text, schema)
    fields = [F.when(ok, parsed[f.name]).alias(f.name) for f in schema.fields]
    return F.struct(*fields, ok.alias("json_ok"))


def epoch_to_utc(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def iso_utc(seconds: Column) -> Column:
    return F.date_format(epoch_to_utc(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def day_number(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def parse_us_time(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit("M/d/yyyy h:mm:ss a"))


def squash(score: Column) -> Column:
    return 2 * F.atan(score / 8) / F.lit(SQUASH_PI)


def emotion_polarity(emotion: Column, values: dict[str, float] = EMOTION_POLARITY) -> Column:
    """Number of an emotion; `{"enum": [...]}` uses its first; a number is itself; unknown is 0."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    first = F.when(emotion.startswith("{"), F.get_json_object(emotion, "$.enum[0]"))
    name = F.coalesce(first, emotion)
    return F.coalesce(F.try_element_at(table, name), name.try_cast("double"), F.lit(0.0))


def join_keywords(keywords: Column) -> Column:
    return F.concat_ws(", ", keywords)


def text_stats(text: Column) -> Column:
    """Struct of word, sentence and paragraph counts; null for blank text."""
    parts = F.filter(F.split(text, r"\n\s*\n"), lambda p: p.rlike("[a-zA-Z]"))
    kept = F.array_join(parts, "\n\n")
    count = lambda rx: F.size(F.regexp_extract_all(kept, F.lit(rx), F.lit(0)))
    stats = F.struct(
        count(r"\b[a-zA-Z0-9']+\b").alias("word_count"),
        count("[.!?]").alias("sentence_count"),
        F.size(parts).alias("paragraph_count"),
    )
    return F.when(F.trim(F.regexp_replace(text, r"\s", "")) != "", stats)


def bold_matches(text: Column, words: Column, open_: str = "<hi>", close: str = "</hi>") -> Column:
    """Mark whole-word matches of any of `words` (plain letters and digits) in `text`.

    The text is cut once into word and non-word runs and each run is looked up, so
    the cost does not depend on how many words there are.
    """
    runs = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    mark = lambda r: F.when(
        F.array_contains(words, F.lower(r)), F.concat(F.lit(open_), r, F.lit(close))
    ).otherwise(r)
    return F.array_join(F.transform(runs, mark), "")


def phrase_in(token_list: Column, phrase: Column) -> Column:
    """True when the tokens of `phrase` stand next to each other, in order."""
    fence = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    return (F.size(phrase) > 0) & F.contains(fence(token_list), fence(phrase))


def uuid5(name: Column, namespace: str = UUID_NAMESPACE_DNS) -> Column:
    """RFC 4122 name-based id (version 5) of a string."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex(digit.bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def md5_number(*parts: Column, digits: int = 8) -> Column:
    """A repeatable pseudo-random integer from the given values (first hex digits of an md5)."""
    key = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, digits), 16, 10).cast("bigint")
