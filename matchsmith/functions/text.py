"""Text cleaning as Spark column expressions (JVM side, inside whole-stage codegen).

Every function takes and returns a ``Column``; none is a Python UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# They must equal the ones the matching code was written against.
# ASCII punctuation (the characters of Python's ``string.punctuation``).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# HTML entities deleted before tokenising, and literal sequences replaced by a space.
DROPPED_ENTITIES = ["&amp;", "&reg;", "&quot;"]
SPACED_SEQUENCES = ["\t;", "\n;"]
# English stop words (the NLTK English list, in its published order).
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "you're", "you've",
    "you'll", "you'd", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself",
    "she", "she's", "her", "hers", "herself", "it", "it's", "its", "itself", "they", "them",
    "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "that'll",
    "these", "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against",
    "between", "into", "through", "during", "before", "after", "above", "below", "to", "from",
    "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "don't", "should", "should've", "now",
    "d", "ll", "m", "o", "re", "ve", "y", "ain", "aren", "aren't", "couldn", "couldn't", "didn",
    "didn't", "doesn", "doesn't", "hadn", "hadn't", "hasn", "hasn't", "haven", "haven't", "isn",
    "isn't", "ma", "mightn", "mightn't", "mustn", "mustn't", "needn", "needn't", "shan",
    "shan't", "shouldn", "shouldn't", "wasn", "wasn't", "weren", "weren't", "won", "won't",
    "wouldn", "wouldn't",
]
# Unicode white space as Python's str.split() sees it (also valid RE2 for the SQL oracle).
WHITESPACE_RUN = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+")
# Name normaliser patterns, applied in this order: link removed, non-word runs to a space,
# mixed letter/digit tokens to LETTERNUMBER, stand-alone numbers to NUMBER. (?U) makes Java's
# \w, \d and \s Unicode-aware, as they are in Python.
LINK_PATTERN = r"(?U)\w+:\/{2}[\d\w-]+(\.[\d\w-]+)*(?:(?:\/[^\s/]*))*"
NON_WORD_RUN = r"(?U)\W+"
MIXED_TOKEN = r"(?U)([A-Za-z]+[\d@]+[\w@]*|[\d@]+[A-Za-z]+[\w@]*)"
NUMBER_TOKEN = r"(?U)(?<!\S)\d+(?!\S)"
# Word pattern of the occurrence vectoriser: two or more word characters.
VOCAB_TOKEN = r"[\p{L}\p{N}_]{2,}"
# ---------------------------------------------------------------------------------------------


def strip_punctuation_word(word: str) -> str:
    return word.lower().translate(str.maketrans("", "", PUNCTUATION))


def normalized_stop_words(words: list[str] | None = None) -> list[str]:
    """Stop words lower-cased and without punctuation (``don't`` -> ``dont``), order kept."""
    out: list[str] = []
    for w in words if words is not None else ENGLISH_STOP_WORDS:
        n = strip_punctuation_word(w)
        if n not in out:
            out.append(n)
    return out


def split_ws(c: Column) -> Column:
    """White-space split without empty tokens (Python ``str.split()``)."""
    return F.filter(F.split(c, WHITESPACE_RUN), lambda t: t != F.lit(""))


def word_count(c: Column) -> Column:
    return F.size(split_ws(F.coalesce(c, F.lit(""))))


def more_words_than(c: Column, n: int) -> Column:
    """``word_count(c) > n``, without cutting what follows the first ``n + 1`` words."""
    first = F.split(F.coalesce(c, F.lit("")), WHITESPACE_RUN, n + 2)
    return F.size(F.filter(first, lambda t: t != F.lit(""))) > n


def tokenize(c: Column) -> Column:
    """Null to []; drop entities; lower; delete ASCII punctuation; split on white space."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    for ent in DROPPED_ENTITIES:
        s = F.replace(s, F.lit(ent), F.lit(""))
    for seq in SPACED_SEQUENCES:
        s = F.replace(s, F.lit(seq), F.lit(" "))
    s = F.translate(F.lower(s), PUNCTUATION, "")
    return split_ws(s)


def remove_stop_words(tokens: Column, stop_words: list[str] | None = None) -> Column:
    """Keep repeats and order (``array_except`` would drop repeats)."""
    stop = F.array(*[F.lit(w) for w in normalized_stop_words(stop_words)])
    return F.filter(tokens, lambda t: ~F.array_contains(stop, t))


def clean_text(c: Column, stop_words: list[str] | None = None) -> Column:
    """Tokenize, drop stop words, join by one space. Null stays null."""
    joined = F.array_join(remove_stop_words(tokenize(c), stop_words), " ")
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(joined)


def clean_column(df, col: str, out: str | None = None, stop_words: list[str] | None = None):
    """DataFrame form of ``clean_text``: the stop-word test runs in Spark ML's
    ``StopWordsRemover`` (a JVM hash-set lookup; order and repeats kept) instead of scanning
    the stop list per token. Null stays null."""
    from pyspark.ml.feature import StopWordsRemover
    out = out or col
    tk, kept = f"__{col}_tk", f"__{col}_kept"
    swr = StopWordsRemover(inputCol=tk, outputCol=kept, caseSensitive=True,
                           stopWords=normalized_stop_words(stop_words))
    t = swr.transform(df.withColumn(tk, tokenize(F.col(col))))
    cleaned = F.when(F.col(col).isNull(), F.lit(None).cast("string")) \
        .otherwise(F.array_join(F.col(kept), " "))
    return t.withColumn(out, cleaned).drop(tk, kept)


def clean_columns(df, cols: list[str], stop_words: list[str] | None = None):
    for c in cols:
        df = clean_column(df, c, c, stop_words)
    return df


def null_to_empty(df, cols: list[str] | None = None):
    cols = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.na.fill("", subset=cols)


def alnum_only(c: Column) -> Column:
    """Every run outside [0-9a-zA-Z] becomes one space; trimmed; null to ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^0-9a-zA-Z]+", " "))


def normalize_name(c: Column, empty_as_none: bool = True) -> Column:
    """Remove links; non-word runs to one space; trim, lower; tokens mixing letters and digits
    to LETTERNUMBER; stand-alone numbers to NUMBER; optionally '' to NONE."""
    s = F.coalesce(c, F.lit(""))
    # the costly patterns run only on texts that hold what they need
    s = F.when(s.contains("://"), F.regexp_replace(s, LINK_PATTERN, "")).otherwise(s)
    s = F.lower(F.trim(F.regexp_replace(s, NON_WORD_RUN, " ")))
    numbered = F.trim(F.regexp_replace(F.regexp_replace(s, MIXED_TOKEN, "LETTERNUMBER"), NUMBER_TOKEN, "NUMBER"))
    s = F.when(s.rlike(r"[\p{Nd}@]"), numbered).otherwise(s)
    if not empty_as_none:
        return s
    return F.when(F.length(s) == 0, F.lit("NONE")).otherwise(s)


def combine(cols: list[Column]) -> Column:
    """Join attributes by one space and strip the ends (inner double spaces are kept)."""
    return F.trim(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in cols]))


def filled_count(cols: list[Column]) -> Column:
    """Number of non-null, non-empty attributes in a row."""
    return reduce(lambda a, b: a + b,
                  [F.when(x.isNotNull() & (x.cast("string") != ""), 1).otherwise(0) for x in cols])


def null_word_cleanup(c: Column) -> Column:
    """Text that starts and ends with ``null`` becomes ''."""
    return F.when(c.startswith("null") & c.endswith("null"), F.lit("")).otherwise(c)


def vocab_tokens(c: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(VOCAB_TOKEN), 0)


def seeded_key(seed, *parts: Column | str) -> Column:
    """Deterministic pseudo-random order key: md5 of 'seed|part|...' (same hex in DuckDB)."""
    cols = [F.lit(str(seed))] + [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", *[x.cast("string") for x in cols]))
