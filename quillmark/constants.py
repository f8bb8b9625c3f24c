"""Defaults and lookup values shared by all operators."""

# --- Fixed values: accepted column names, in priority order -----------------
CODE_COLUMNS = ("code", "source_code", "sample_code", "text", "snippet", "content", "sample", "source")
LABEL_COLUMNS = ("label", "class", "is_ai", "ai_generated", "generated", "target", "y")
LANGUAGE_COLUMNS = ("language", "lang", "programming_language", "prog_lang")
HUMAN_CODE_COLUMNS = ("human_code", "human", "human_written_code")
AI_CODE_COLUMNS = ("ai_code", "ai", "ai_generated_code", "llm_code")

# --- Fixed values: label and language aliases -------------------------------
HUMAN, AI = 0, 1
LABEL_NAMES = {HUMAN: "human", AI: "ai"}
HUMAN_ALIASES = ("human", "human-written", "human_written", "0", "false")
AI_ALIASES = ("ai", "ai-generated", "ai_generated", "llm", "gpt", "chatgpt", "1", "true")
PYTHON_ALIASES = ("python", "py", "python3")
UNKNOWN = "unknown"

# --- Fixed values: file suffixes and CSV missing-value tokens ---------------
SUFFIXES = ("csv", "tsv", "json", "jsonl", "ndjson", "parquet")
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- Fixed values: cleaning, splitting, model and report defaults -----------
MIN_CODE_LENGTH = 3
TRAIN_RATIO, VALIDATION_RATIO, TEST_RATIO = 0.70, 0.15, 0.15
SEED = 42
SPLITS = ("train", "validation", "test")
MAX_TOKENS = 512
THRESHOLD = 0.5
PATIENCE = 2
MIN_IMPROVEMENT = 1e-6
MAX_ERROR_ROWS = 200
HISTOGRAM_BINS = 60
LENGTH_METRICS = ("n_chars", "n_lines", "n_whitespace_tokens")
BATCH_SIZE = 32

# --- Fixed values: special token ids of the encoded table -------------------
BEGIN_ID, PAD_ID, END_ID, UNKNOWN_ID, FIRST_TOKEN_ID = 0, 1, 2, 3, 4

# --- Fixed values: code points that count as whitespace when stripping and splitting
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
