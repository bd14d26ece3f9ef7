"""Click logs: counts, rates, indexes, samples, models and ranking quality.

Impressions are rows (imp_id, user_id, item, label, ...). An impression is never gathered
into a list: positions inside one come from range-partitioned numbering, so a group with a
third of the log is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.functions import vectors as V
from threadloom.functions.text import md5_number
from threadloom.operators.nearest import label_centroids, nearest
from threadloom.operators.ranking import dense_index, sample_bernoulli, top_k_per_group, with_group_position
from threadloom.runtime import durable, stored


def parse_behaviors(df: DataFrame) -> DataFrame:
    """Packed `id-label` lists to rows (impression_id, user_id, pos, item, label)."""
    parts = F.split("impressions", " ")
    cut = F.split("_p", "-")
    return df.select("impression_id", "user_id", "time", "history", F.posexplode(parts).alias("pos", "_p")).select(
        "impression_id", "user_id", "time", "history", "pos", cut[0].alias("item"), cut[1].cast("int").alias("label"))


def lookup_vectors(items: DataFrame, vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """Items keep their row; one without a vector gets zeros, a vector without an item is unused."""
    return items.join(vectors, key, "left").withColumn(vector, F.coalesce(vector, V.zero_vector(dims)))


def first_clicks(impressions: DataFrame) -> DataFrame:
    """(user_id, item, first_day): what a user's history is built from."""
    return impressions.filter("label > 0").groupBy("user_id", "item").agg(F.min("day").alias("first_day"))


def not_in_history(impressions: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Rows whose item the same user had not clicked on an earlier day."""
    h = (history if history is not None else first_clicks(impressions)).select(
        F.col("user_id").alias("_u"), F.col("item").alias("_i"), "first_day")
    cond = (F.col("user_id") == F.col("_u")) & (F.col("item") == F.col("_i")) & (F.col("first_day") < F.col("day"))
    return impressions.join(h, cond, "left_anti")


def mixed_label_groups(impressions: DataFrame, group: str = "imp_id") -> DataFrame:
    """Impressions with at least one click and one non-click."""
    mixed = impressions.groupBy(group).agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).filter("_lo = 0 AND _hi > 0")
    return impressions.join(stored(mixed.select(group), "mixed"), group, "left_semi")


def click_counts(items: DataFrame, impressions: DataFrame) -> DataFrame:
    """(item, impressions, clicks) for every item; 0, 0 when never shown."""
    seen = impressions.groupBy("item").agg(F.count(F.lit(1)).alias("impressions"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("clicks"))
    return items.select("item").join(seen, "item", "left").fillna(0, ["impressions", "clicks"])


def ratio(clicks: Column, shown: Column) -> Column:
    return F.when(shown > 0, clicks / shown).otherwise(F.lit(0.0))


def popularity(counts: DataFrame) -> DataFrame:
    return counts.withColumn("popularity", ratio(F.col("clicks"), F.col("impressions")))


def impressions_by_category(impressions: DataFrame, news: DataFrame) -> DataFrame:
    """Impressions of known items with their category."""
    return impressions.join(news.select("item", "category"), "item")


def ctr_by_category(impressions: DataFrame, news: DataFrame) -> DataFrame:
    """(category, impressions, clicks, ctr). Items are counted before the join, so the log is
    reduced by a partial aggregate and never shuffled as rows."""
    per_item = impressions.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("c"))
    by_cat = per_item.join(news.select("item", "category"), "item").groupBy("category").agg(
        F.sum("n").alias("impressions"), F.sum("c").alias("clicks"))
    return by_cat.withColumn("ctr", ratio(F.col("clicks"), F.col("impressions")))


def import_parent_ctr(news: DataFrame, ctr: DataFrame) -> DataFrame:
    """Child rows read their category's rate from the parent table; no rate is 0."""
    return news.join(ctr.select("category", "ctr"), "category", "left").fillna(0.0, ["ctr"])


def score_impressions(impressions: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """Adds `score` = user vector . item vector; null when either is unknown."""
    u = users.select(F.col("id").alias("user_id"), F.col("v").alias("_u"))
    i = items.select(F.col("id").alias("item"), F.col("v").alias("_i"))
    return impressions.join(u, "user_id", "left").join(i, "item", "left").withColumn(
        "score", V.dot(F.col("_u"), F.col("_i"))).drop("_u", "_i")


def index_impressions(impressions: DataFrame) -> DataFrame:
    """Users and items as 0..n-1 in order of first sight; items already read are left out."""
    users = dense_index(impressions, "user_id", ["seen"], "user_index")
    items = dense_index(impressions, "item", ["seen"], "item_index")
    return not_in_history(impressions).join(users, "user_id").join(items, "item")


def news_features(news: DataFrame, entities: Column) -> DataFrame:
    """(item, category_index, subcategory_index, entity_1, entity_2); `entities` is a 2-element array."""
    base = news.withColumn("_e", entities)
    cats = dense_index(base, "category", ["item"], "category_index")
    subs = dense_index(base, "subcategory", ["item"], "subcategory_index")
    long = base.select("item", F.posexplode("_e").alias("_pos", "entity"))
    index = dense_index(long, "entity", ["item", "_pos"], "_ei")
    pairs = long.join(index, "entity").groupBy("item").agg(
        F.max(F.when(F.col("_pos") == 0, F.col("_ei"))).alias("entity_1"), F.max(F.when(F.col("_pos") == 1, F.col("_ei"))).alias("entity_2"))
    return base.join(cats, "category").join(subs, "subcategory").join(pairs, "item").select(
        "item", "category_index", "subcategory_index", "entity_1", "entity_2")


def negative_sampling(impressions: DataFrame, k: int = 4, seed: int = 1, group: str = "imp_id") -> DataFrame:
    """(group, positive, item, label): each click and min(k, available) skipped items, without replacement.

    Skipped items are shuffled once per impression by a keyed hash and numbered; a click takes
    k neighbours on that circle from its own random start. So a click makes k rows, not one per
    skipped item, and the join key (group, number) is spread evenly.
    """
    pos = impressions.filter("label > 0").select(group, F.col("item").alias("positive"))
    neg = impressions.filter("label = 0").select(group, "item")
    mixed = md5_number(F.lit(seed), F.col(group), F.col("item"))
    numbered = with_group_position(neg, [group], [mixed, F.col("item")], "_no").select(group, "item", (F.col("_no") - 1).alias("_no"))
    sizes = neg.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    start = md5_number(F.lit(seed), F.lit("start"), F.col(group), F.col("positive"))
    drawn = pos.join(stored(sizes, "sizes"), group).select(
        group, "positive", "_n", start.alias("_s"), F.explode(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(k)).cast("int") - 1)).alias("_j")
    ).select(group, "positive", F.pmod(F.col("_s") + F.col("_j"), F.col("_n")).alias("_no"))
    negatives = drawn.join(numbered, [group, "_no"]).select(group, "positive", "item", F.lit(0).alias("label"))
    return pos.select(group, "positive", F.col("positive").alias("item"), F.lit(1).alias("label")).unionByName(negatives)


def training_pairs(impressions: DataFrame, features: DataFrame, prob: float = 1.0, seed: int = 1, k: int = 4) -> DataFrame:
    """Labelled (user_id, item, features) rows of one epoch; `md5_number` of a row's keys gives a seeded order."""
    chosen = sample_bernoulli(mixed_label_groups(impressions), "imp_id", prob, seed) if prob < 1 else mixed_label_groups(impressions)
    pairs = negative_sampling(chosen, k, seed).join(impressions.select("imp_id", "user_id").distinct(), "imp_id")
    return pairs.join(features, "item")


def train_factors(impressions: DataFrame, rank: int = 50, seed: int = 1, iterations: int = 10) -> tuple[DataFrame, DataFrame]:
    """(id, v) of users and of items: implicit-feedback factors from clicks.

    Ids of any size or type are numbered 0..n-1 first, as the solver takes 32-bit numbers, and
    mapped back.
    """
    from pyspark.ml.recommendation import ALS

    clicks = impressions.groupBy("user_id", "item").agg(F.sum("label").cast("float").alias("clicks")).filter("clicks > 0")
    users = stored(dense_index(clicks, "user_id", ["user_id"], "user"), "users")
    items = stored(dense_index(clicks, "item", ["item"], "no"), "items")
    ints = clicks.join(users, "user_id").join(items, "item").select(F.col("user").cast("int"), F.col("no").cast("int").alias("item"), "clicks")
    als = ALS(rank=rank, implicitPrefs=True, seed=seed, maxIter=iterations, userCol="user", itemCol="item", ratingCol="clicks", coldStartStrategy="drop")
    model = als.fit(durable(ints))
    factors = lambda df: df.select(F.col("id").alias("_no"), F.col("features").cast("array<double>").alias("v"))
    return (factors(model.userFactors).join(users, F.col("_no") == F.col("user")).select(F.col("user_id").alias("id"), "v"),
            factors(model.itemFactors).join(items, F.col("_no") == F.col("no")).select(F.col("item").alias("id"), "v"))


def content_vectors(news: DataFrame, vectors: DataFrame, dims: int, buckets: int = 32) -> DataFrame:
    """(id, v): the text vector followed by hashed one-hot category, subcategory and first entity."""
    base = lookup_vectors(news, vectors.select(F.col("id").alias("item"), "v"), "item", "v", dims)
    def one_hot(name: str) -> Column:
        slot = (md5_number(F.lit(name), F.col(name)) % buckets).cast("int")
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        return F.concat(zeros(slot), F.array(F.lit(1.0)), zeros(F.lit(buckets - 1) - slot))

    return base.select(F.col("item").alias("id"), F.concat("v", *[one_hot(n) for n in ("category", "subcategory", "entity")]).alias("v"))


def user_profiles(impressions: DataFrame, items: DataFrame) -> DataFrame:
    """(id, v): mean content vector of the items a user clicked."""
    clicked = impressions.filter("label > 0").join(items.select(F.col("id").alias("item"), "v"), "item")
    return label_centroids(clicked, "user_id").select(F.col("user_id").alias("id"), F.col("centroid").alias("v"))


def train_content_model(pairs: DataFrame, users: DataFrame, items: DataFrame, iterations: int = 15, reg: float = 1e-5):
    """Logistic model on user-item crosses, so items nobody clicked can be scored.

    Returns the model and a function that adds `features` to (user_id, item) rows.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    first = items.select(F.size("v").alias("n")).first()
    width = first.n if first else 1

    def featurise(df: DataFrame) -> DataFrame:
        u = users.select(F.col("id").alias("user_id"), F.col("v").alias("_u"))
        i = items.select(F.col("id").alias("item"), F.col("v").alias("_i"))
        # a user without clicks or an unknown item has the zero vector: the row is scored all the same
        zero = F.array_repeat(F.lit(0.0), width)
        known = df.join(u, "user_id", "left").join(i, "item", "left").withColumn("_u", F.coalesce("_u", zero)).withColumn("_i", F.coalesce("_i", zero))
        cross = F.zip_with("_u", "_i", lambda a, b: a * b)
        return known.withColumn("features", array_to_vector(F.concat(cross, F.col("_i")))).drop("_u", "_i")

    # read once per iteration, so it is computed once and kept on shared storage
    training = durable(featurise(pairs.withColumn("label", F.col("label").cast("double"))).select("features", "label"))
    return LogisticRegression(maxIter=iterations, regParam=reg).fit(training), featurise


def top_n_for_user(users: DataFrame, items: DataFrame, n: int = 10, read: DataFrame | None = None) -> DataFrame:
    """(qid, id, score): n best items per user by dot product, without items already `read` (qid, id)."""
    return nearest(items, users, k=n, metric="dot", skip=read)


def recommend_with_ctr(users: DataFrame, items: DataFrame, n: int = 10) -> DataFrame:
    """(qid, id, closeness, ctr, score): dot product times the category's rate, n best per user.

    `items` has (id, v, ctr). The rate scales the item's vector before the search, which gives the
    same products; the two factors are then read back for the few hits.
    """
    scaled = items.withColumn("v", F.transform("v", lambda x: x * F.col("ctr")))
    hits = nearest(scaled, users, k=n, metric="dot")
    pairs = hits.join(items.select("id", "ctr", F.col("v").alias("_i")), "id").join(users.select("qid", F.col("v").alias("_u")), "qid")
    return pairs.select("qid", "id", V.dot(F.col("_u"), F.col("_i")).alias("closeness"), "ctr", "score")


# ---- ranking quality ---------------------------------------------------------

def ranked_impressions(scored: DataFrame, group: str = "imp_id") -> DataFrame:
    """Adds `pos` (1 = best score, lowest item on a tie) and the impression's size `n`."""
    base = scored.select(group, "item", "label", F.round("score", 9).alias("score"))
    return with_group_position(base, [group], [F.desc("score"), F.col("item")], "pos", size="n")


def discounts(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("reciprocal", 1.0 / F.col("pos")).withColumn("log_discount", 1.0 / F.log2(F.col("pos") + 1.0))


def auc_by_group(ranked: DataFrame, group: str = "imp_id") -> DataFrame:
    """(group, auc): rank statistic; equal scores share the mean of their ranks."""
    ties = ranked.groupBy(group, "score", "n").agg(
        ((F.min("pos") + F.max("pos")) / 2).alias("_mid"), F.sum("label").alias("_p"), F.count(F.lit(1)).alias("_c"))
    per = ties.groupBy(group, "n").agg(
        F.sum(F.col("_p") * (F.col("n") + 1 - F.col("_mid"))).alias("_r"), F.sum("_p").alias("_pos"))
    p, n = F.col("_pos"), F.col("n")
    return per.filter((p > 0) & (p < n)).select(group, ((F.col("_r") - p * (p + 1) / 2) / (p * (n - p))).alias("auc"))


def ndcg_by_group(ranked: DataFrame, ks: tuple[int, ...] = (5, 10), group: str = "imp_id") -> DataFrame:
    """(group, ndcg<k> ...): only the best rows by score and by label are ever needed."""
    top = max(ks)
    gain = F.pow(F.lit(2.0), F.col("label")) - 1
    dcg = lambda pos, k: F.sum(F.when(F.col(pos) <= k, gain / F.log2(F.col(pos) + 1.0)).otherwise(0.0))
    actual = ranked.filter(F.col("pos") <= top).groupBy(group).agg(*[dcg("pos", k).alias(f"_a{k}") for k in ks])
    ideal = top_k_per_group(ranked.select(group, "item", "label"), [group], [F.desc("label"), F.col("item")], top, "_i")
    best = ideal.groupBy(group).agg(*[dcg("_i", k).alias(f"_b{k}") for k in ks]).filter(F.col(f"_b{ks[0]}") > 0)
    return best.join(actual, group).select(group, *[(F.col(f"_a{k}") / F.col(f"_b{k}")).alias(f"ndcg{k}") for k in ks])


def mrr_by_group(ranked: DataFrame, group: str = "imp_id") -> DataFrame:
    """(group, mrr): mean of 1/position over all clicks, not only the first."""
    return ranked.groupBy(group).agg((F.sum(F.col("label") / F.col("pos")) / F.sum("label")).alias("mrr")).filter(F.col("mrr").isNotNull())


def evaluate(scored: DataFrame, group: str = "imp_id", split: str | None = None) -> DataFrame:
    """Mean AUC, MRR, nDCG@5 and nDCG@10 over impressions with both labels, to 4 places.

    One row, or one per value of `split`, a column that is constant inside an impression.
    """
    kept = mixed_label_groups(scored, group)
    ranked = ranked_impressions(kept, group)
    parts = (
        auc_by_group(ranked, group)
        .join(mrr_by_group(ranked, group), group)
        .join(ndcg_by_group(ranked, (5, 10), group), group)
    )
    if split:
        parts = parts.join(kept.select(group, split).distinct(), group)
    means = [F.round(F.avg(m), 4).alias(m) for m in ("auc", "mrr", "ndcg5", "ndcg10")]
    return parts.groupBy(*([split] if split else [])).agg(F.count(F.lit(1)).alias("n_impressions"), *means)
