"""Fixed values that results depend on."""

# fixed value: site root put before permalinks
SITE_BASE = "https://www.reddit.com"

# fixed values: polarity of each emotion
EMOTION_POLARITY = {
    "Joy": 1.0, "Trust": 0.8, "Gratitude": 0.8, "Excitement": 0.8, "Admiration": 0.7,
    "Relief": 0.7, "Satisfaction": 0.7, "Hope": 0.6, "Optimism": 0.6, "Pride": 0.6,
    "Curiosity": 0.5, "Anticipation": 0.5, "Sympathy": 0.4, "Surprise": 0.4, "Neutral": 0.0,
    "Concern": -0.3, "Skepticism": -0.4, "Confusion": -0.4, "Embarrassment": -0.4,
    "Apprehension": -0.5, "Frustration": -0.5, "Envy": -0.5, "Wariness": -0.3, "Sadness": -0.5,
    "Worry": -0.3, "Disappointment": -0.6, "Boredom": -0.3, "Resentment": -0.7,
    "Distrust": -0.7, "Anxiety": -0.3, "Fear": -0.8, "Disgust": -0.9, "Anger": -0.9,
}

# fixed values: per-leg settings of the three-field hybrid search (alpha, maximum vector distance)
HYBRID_LEGS = {"keywords": (0.6, 0.43), "body": (0.9, 0.50), "title": (0.7, 0.40)}
# fixed values: weights of the combined score, over 12
LEG_WEIGHTS = {"body": 9, "keywords": 2, "title": 1}

# fixed value: the squashing function uses this literal, not pi
SQUASH_PI = 3.14159

# fixed values: BM25 defaults
BM25_K1, BM25_B = 1.2, 0.75

# fixed value: RFC 4122 DNS namespace
UUID_NAMESPACE_DNS = "6ba7b8109dad11d180b400c04fd430c8"
