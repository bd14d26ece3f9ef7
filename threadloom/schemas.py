"""Explicit schemas of everything that is read from files. Nothing is inferred."""

from pyspark.sql import types as T

S, L, D, B, I = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.IntegerType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


# fixed values: field lists of the data model
POSTS = _struct(
    ("author", S), ("archived", B), ("title", S), ("score", L), ("selftext", S), ("permalink", S),
    ("subreddit", S), ("created_utc", L), ("gilded", L), ("id", S), ("num_comments", L),
)
COMMENTS = _struct(
    ("author", S), ("score", L), ("created_utc", L), ("permalink", S), ("body", S),
    ("subreddit", S), ("id", S), ("parent_id", S), ("link_id", S),
)
SEARCH_DOCUMENT = _struct(
    ("reddit_id", S), ("link_id", S), ("subreddit_name", S), ("title", S), ("author", S),
    ("created_utc", L), ("url", S), ("body", S), ("score", I), ("num_comments", I),
    ("is_post", B), ("parent_post", S), ("archived", B), ("keywords", T.ArrayType(S)),
)
NEWS_TSV = _struct(
    ("news_id", S), ("category", S), ("subcategory", S), ("title", S), ("abstract", S),
    ("url", S), ("title_entities", S), ("abstract_entities", S),
)
BEHAVIORS_TSV = _struct(
    ("impression_id", S), ("user_id", S), ("time", S), ("history", S), ("impressions", S),
)
PAIN_POINT = _struct(
    ("quote", S), ("description", S), ("title", S), ("post_id", S), ("persona", S),
    ("issue_emotion", S), ("is_quote_relevant", B), ("issue_topic", S),
)
PERSONA = _struct(
    ("quote", S), ("title", S), ("post_id", S), ("description", S), ("is_quote_relevant", B),
)
TOPIC = _struct(
    ("name", S), ("topic_type", S), ("match_space_topic", B), ("match_quote_pain", B),
)
JUDGEMENT = _struct(
    ("space_match_reasoning", S), ("space_match", B),
    ("perspective_match_reasoning", S), ("perspective_match", B),
)
