"""Settings shared by the operators."""

# Report and evaluation settings.
SEED = 42
SAMPLE_SIZE = 1500
TEST_SIZE = 0.30
GROUP_FOLDS = 5
STRONG_PCTS = tuple(range(0, 101, 5))
TARGETS = (0.90, 0.95)
REPLICATES = 1000
FALLBACK_PCT = 50.0
WEAK_TOO_GOOD = 0.90
NEAR_CHANCE_MARGIN = 0.05
WORST_EXAMPLES = 15
MIN_SUBJECT_ROWS = 20
MIN_SUBJECT_POSITIVES = 3
INSTRUCTION = "Answer with one letter only."
LETTERS = "ABCDE"
NO_LETTER = "(no valid letter)"
ENCODE_PREFIX = "query: "
ENCODE_BATCH = 16
MAX_FEATURES = 50_000
HASH_BUCKETS = 1 << 18

# Sizing of the distributed ordering (see operators/ordered.py).
ROWS_PER_BUCKET = 1_000_000
FAN_OUT = 4096
MAX_LEVELS = 6
SAMPLES_PER_BUCKET = 64
