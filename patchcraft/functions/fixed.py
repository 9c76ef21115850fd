"""Fixed values.

These must stay equal to the behaviour being reproduced; they are listed
plainly and in their natural order.  Regular expressions are written so that
both the JVM regex engine (Spark) and RE2 (DuckDB, used by the oracle) read
them the same way.
"""

# --- fixed values: Java keywords that can never take part in a rename (53) ---
JAVA_KEYWORDS = [
    "abstract", "assert", "boolean", "break", "byte", "case", "catch", "char",
    "class", "const", "continue", "default", "do", "double", "else", "enum",
    "extends", "false", "final", "finally", "float", "for", "goto", "if",
    "implements", "import", "instanceof", "int", "interface", "long", "native",
    "new", "null", "package", "private", "protected", "public", "return",
    "short", "static", "strictfp", "super", "switch", "synchronized", "this",
    "throw", "throws", "transient", "true", "try", "void", "volatile", "while",
]

# --- fixed values: punctuation that the tokeniser splits around ---
# ASCII punctuation without the underscore; newline is a token of its own.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"

# --- fixed values: numbers collapsed to "1" before tokenising ---
NUMBER_RE = r"\b\d+(\.\d*)?\b"
NUMBER_REPLACEMENT = "1"

# --- fixed values: other constants ---
HUNK_PREFIX = "@@"
GIT_SECTION_PREFIX = "diff --git "
NO_EOF_NEWLINE_MARKER = "\\ No newline at end of file"
DEFAULT_MAX_RENAMES = 2          # 1..2 renames -> "y", more -> "skip"
DEFAULT_SEED = 977
DEFAULT_MAX_FILE_KB = 10         # patches larger than this are not loaded for learning
PRESUMED_NEGATIVE_MAX_BYTES = 5 * 1024
PRESUMED_NEGATIVE_COUNT = 1000
VOCAB_SIZE = 20000               # includes padding (0) and unknown (1)
HOLDOUT_DIVISOR = 10             # validation = n // 10
TRAIN_FRACTION = (4, 5)          # train = int(n / 5 * 4)
BALANCE_TOLERANCE = 1.1


def _class_escape(chars: str) -> str:
    return "".join("\\" + c for c in chars)


# A token is one punctuation character or newline, or a maximal run of
# characters that are neither space/tab nor punctuation nor newline.
_PUNCT_CLASS = _class_escape(PUNCTUATION) + "\\n"
TOKEN_RE = "([" + _PUNCT_CLASS + "]|[^ \\t" + _PUNCT_CLASS + "]+)"

# Word tokens of a line: maximal identifier-character runs, or any single
# other character.  Joining all tokens rebuilds the line exactly.
WORD_RE = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_])"

# A word that may be an identifier: starts with a letter or underscore.
IDENTIFIER_START_RE = r"^[\p{L}_]"

# Whole words only (no single-character separators).
IDENT_WORD_RE = r"([\p{L}\p{N}_]+)"
# Vocabulary words start with an ASCII letter or underscore; short ones with a
# letter and are at most SHORT_IDENTIFIER_MAX characters long.
VOCAB_START_RE = r"^[A-Za-z_]"
SHORT_VOCAB_START_RE = r"^[A-Za-z]"
SHORT_IDENTIFIER_MAX = 10

# The same word sets extracted in one pass (no per-word filter): a maximal
# word is one not preceded by a word character.
_NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
LETTER_WORD_RE = _NOT_AFTER_WORD + r"(\p{L}[\p{L}\p{N}_]*)"
VOCAB_WORD_RE = _NOT_AFTER_WORD + r"([A-Za-z_][\p{L}\p{N}_]*)"
SHORT_VOCAB_WORD_RE = _NOT_AFTER_WORD + r"([A-Za-z][\p{L}\p{N}_]*)"
