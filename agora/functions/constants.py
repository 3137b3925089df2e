"""Fixed values shared by the operators and by the SQL oracle.

Everything here is a plain literal; change it only together with the
oracle SQL in ``__spark_entry__.py``.
"""

# Fixed value: token pattern — runs of two or more letters, digits or '_'
# (Unicode aware; not ``\w``, which is ASCII-only in RE2 and in Java).
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

# English stop words — Spark's own default list
# (pyspark.ml.feature.StopWordsRemover.loadDefaultStopWords("english")),
# in its natural order.
ENGLISH_STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your",
    "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs",
    "themselves", "what", "which", "who", "whom", "this", "that", "these", "those",
    "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if",
    "or", "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before", "after",
    "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over",
    "under", "again", "further", "then", "once", "here", "there", "when", "where",
    "why", "how", "all", "any", "both", "each", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than", "too",
    "very", "s", "t", "can", "will", "just", "don", "should", "now", "i'll",
    "you'll", "he'll", "she'll", "we'll", "they'll", "i'd", "you'd", "he'd",
    "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's", "it's", "we're",
    "they're", "i've", "we've", "you've", "they've", "isn't", "aren't", "wasn't",
    "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't",
    "won't", "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't",
    "cannot", "could", "here's", "how's", "let's", "ought", "that's", "there's",
    "what's", "when's", "where's", "who's", "why's", "would",
)

# The six category queries of the category report, in order.
CATEGORY_QUERIES = (
    ("Transportation", "EV, transportation, transit, transport, vehicles, buses, airplane, bicycles, emissions"),
    ("Clean Energy", "renewable energy, clean energy, solar power, wind turbines, electricity, energy policy"),
    ("Forestry", "deforestation, forest conservation, tree planting, reforestation"),
    ("Activism", "activism, protests, environmental advocacy, Greta Thunberg"),
    ("Policy", "policy, carbon tax, international agreements"),
    ("Fossil Fuels", "oil, coal, gas, fossil fuels"),
)

# Defaults of the reference's operators.
CATEGORY_THRESHOLD = 0.55
OTHER_CATEGORY = "Other Topics"
UNKNOWN = "Unknown"
NOISE = -1
EXCERPT_CHARS = 900
EXCERPT_WIDTH = 100
CHUNK_WORDS = 512
MAX_TOKENS = 1024
QUANT_BITS = 16
TOP_TERMS = 15
TOP_BIGRAMS = 30
MAX_FEATURES = 4999
MIN_DF = 10
MAX_DF = 0.6
MMR_DIVERSITY = 0.8
SENTIMENT_CLASSES = ("Negative", "Neutral", "Positive")

# Search space of the parameter sweep (low, high, step).
SWEEP_SPACE = {
    "n_neighbors": (10, 60, 5),
    "n_components": (50, 200, 10),
    "min_cluster_size": (5, 60, 5),
    "min_samples": (1, 20, 1),
}
SWEEP_EVALS = 100
SWEEP_ALPHA = 1.0
