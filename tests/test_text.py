from pyspark.sql import functions as F

from matchsmith.functions import text as T


# Offer texts and the words that the tokenizer's rules give, by hand.
TOKENS = [
    (None, []),
    ("", []),
    ("   ", []),
    ("AT&amp;T Router&reg; 5G", ["att", "router", "5g"]),
    ("&quot;Mega&quot; pack & more", ["mega", "pack", "more"]),
    ("Café Crème  -- don't stop!", ["café", "crème", "dont", "stop"]),
    ("a\t;b\n;c", ["a", "b", "c"]),
    ("left;right", ["leftright"]),
    ("The quick, brown fox; jumps", ["the", "quick", "brown", "fox", "jumps"]),
    ("x y\u3000z\xa0w", ["x", "y", "z", "w"]),
    ("ÉTÉ 42 été", ["été", "42", "été"]),
]


def test_tokenize_by_the_rules(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(TOKENS)], "i int, s string")
    got = {r.i: list(r.t) for r in df.select("i", T.tokenize(F.col("s")).alias("t")).collect()}
    for i, (text, words) in enumerate(TOKENS):
        assert got[i] == words, text


def test_clean_text_drops_normalised_stop_words_keeps_repeats(spark):
    stop = set(T.normalized_stop_words())
    assert "dont" in stop and "youre" in stop
    df = spark.createDataFrame([("The the cat and THE hat, don't!",), (None,)], "s string")
    col_form = [r[0] for r in df.select(T.clean_text(F.col("s"))).collect()]
    df_form = [r[0] for r in T.clean_column(df, "s", "c").select("c").collect()]
    assert col_form == ["cat hat", None]
    assert df_form == col_form


def test_alnum_and_combine_and_filled(spark):
    df = spark.createDataFrame([("a--b  c!", "x", None), (None, "", "y")], "a string, b string, c string")
    r = df.select(T.alnum_only(F.col("a")).alias("al"),
                  T.combine([F.col("a"), F.col("b"), F.col("c")]).alias("cm"),
                  T.filled_count([F.col("a"), F.col("b"), F.col("c")]).alias("n")).collect()
    assert [x.al for x in r] == ["a b c", ""]
    assert [x.cm for x in r] == ["a--b  c! x", "y"]
    assert [x.n for x in r] == [2, 1]


def test_normalize_name(spark):
    rows = [("Buy at https://shop.example.com/item/1 now",), ("iPhone 12 Pro 256GB",),
            ("!!!",), ("price 100 usd",), (None,)]
    df = spark.createDataFrame(rows, "s string")
    got = [r[0] for r in df.select(T.normalize_name(F.col("s"))).collect()]
    assert got == ["buy at now", "iphone NUMBER pro LETTERNUMBER", "NONE", "price NUMBER usd",
                   "NONE"]


def test_null_word_cleanup_and_vocab_tokens(spark):
    df = spark.createDataFrame([("null foo null",), ("nullish",), ("ok",)], "s string")
    got = [r[0] for r in df.select(T.null_word_cleanup(F.col("s"))).collect()]
    assert got == ["", "nullish", "ok"]
    v = spark.createDataFrame([("A b CD e_f 12 été",)], "s string") \
        .select(T.vocab_tokens(F.col("s"))).first()[0]
    assert list(v) == ["cd", "e_f", "12", "été"]


def test_word_count_and_seeded_key(spark):
    df = spark.createDataFrame([("a  b c",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(T.word_count(F.col("s"))).collect()] == [3, 0, 0]
    k = spark.range(1).select(T.seeded_key(42, F.lit("x"))).first()[0]
    import hashlib
    assert k == hashlib.md5(b"42|x").hexdigest()
