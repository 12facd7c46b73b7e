"""Fixed values of the data model; results depend on them."""

# Fixed values.
K1 = 1.2
B = 0.75
TOP_K = 5
SUGGESTIONS = 5
MAX_DISTANCE = 3
HALF_WINDOW = 25
PLAIN_SNIPPET = 50
RELAXED_PERCENT = 60
JACCARD_WEIGHT = 0.5
EDIT_WEIGHT = 0.3
FREQUENCY_WEIGHT = 0.2
FINGERPRINT_DISTANCE = 3
BYTES_PER_KEYWORD = 120
LEAST_KEYWORDS = 5
MOST_KEYWORDS = 200
KEYWORD_REQUEST = 0
PAGE_REQUEST = 1
KEYWORD_RESPONSE = 2
PAGE_RESPONSE = 3

#: Digits to which scores are rounded before they are compared or shown.
DIGITS = 6
#: A short list of our own; pass another one wherever stop words are taken.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
