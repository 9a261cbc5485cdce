"""Secret scans: candidates by pattern, false positives removed by a random forest.

DataFrame operations and Spark ML only. Patterns find candidates (named assignments, vendor
formats, key blocks, long mixed tokens) with the text on both sides. A forest tells secrets
from look-alikes by candidate length, character transitions, dictionary coverage (share of its
letters in words that the corpus uses), path (URL or file path around it) and neighbouring words.

The forest is trained on labelled findings, any table ``text, label`` whose texts hold a
candidate. ``labelled_findings`` makes one by distant supervision: it sets values of known making
(random keys; identifiers, checksums, placeholders, paths) among words of at most
``FINDINGS`` documents of the corpus. That bound is the only sample: candidates, word counts and verdicts
cover all texts.

Values of any length count: a quoted one reaches to its closing quote in the line, another to the next space, quote or
angle bracket, without sentence marks at its end; a password in a URL to the ``@``. Neighbouring words are
those within ``CONTEXT`` characters.

Null texts have no candidates. Rows are told apart by key and text, so repeated rows have
one set of findings, and all of them are redacted. Null keys are carried. Empty tables give empty results.
Columns besides the named ones are kept by ``redact`` and not read otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchsmith.llm.common import Scratch
from matchsmith.operators.joins import bounded_broadcast

FINDINGS = 1500
TREES, DEPTH, SEED = 40, 8, 7
CONTEXT = 80
# A word that stands this often in the corpus is in the dictionary.
DICTIONARY_USES = 5
DICTIONARY_BROADCAST_ROWS = 200_000
SECRET_SCORE = 0.5
MASK = "[SECRET]"

# Names that announce a secret, formats of well-known keys, words beside look-alikes.
NAMES = "api[_-]?key|access[_-]?key|secret|token|passwd|password|passphrase|pwd|auth(?!ors?(?![a-z]))|credential|private[_-]?key|bearer"
VENDORS = (r"AKIA[0-9A-Z]{16}", r"gh[pousr]_[A-Za-z0-9]{36,}", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}",
           r"AIza[0-9A-Za-z_-]{35}", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"glpat-[A-Za-z0-9_-]{20}")
BENIGN = "commit|sha|sha1|sha256|md5|checksum|digest|hash|etag|uuid|guid|revision|build|version|license|example|sample|dummy|test|placeholder|id"

_KEY_BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?"
# An identifier that holds a name, taken whole and once, so that long ones cost one pass.
_NAMED = rf"(?<![A-Za-z0-9_-])(?=(?i:[a-z0-9_-]*?(?:{NAMES})))[A-Za-z0-9_-]++[\"']?\s{{0,3}}(?:=>|:=|=|:)\s{{0,3}}(?i:bearer\s{{1,3}})?"
# What it is set to: a quoted string to its closing quote, or characters without space or quotes but for sentence marks at the end.
_QUOTED = "|".join(f"{q}[^{q}\n]+(?={q})" for q in "\"'`")
_PLAIN = r"[^\s\"'`<>]*[^\s\"'`<>,;.!?)\]}]"
_ASSIGNED = f"{_NAMED}(?:{_QUOTED}|[\"'`]?{_PLAIN})"
_URL_USER = r"://[^\s/:@\"'<>]*+:"
_IN_URL = rf"{_URL_USER}[^\s/@\"'<>]+(?=@)"
_MIXED = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{16,}"
CANDIDATE = "|".join([_KEY_BLOCK, _IN_URL, _ASSIGNED, *(f"(?<![A-Za-z0-9]){v}" for v in VENDORS), _MIXED])
_LEAD = f"^(?:{_NAMED}[\"'`]?|{_URL_USER})"

FEATURES = ["log_length", "digit_share", "upper_share", "symbol_share", "class_changes", "vowel_changes", "entropy", "distinct_share",
            "longest_run", "hex_only", "dictionary_share", "vendor", "key_block", "named", "quoted", "in_url", "url_user", "spaces", "in_path", "dotted",
            "secret_word_near", "benign_word_near"]


def _chunks(text: Column) -> tuple[Column, Column]:
    """(candidates, texts between them)."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)), F.split(t, CANDIDATE, -1)


def candidates(df: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """``key, text_hash, nth, start, length, value`` and the text on both sides of every candidate;
    ``start`` counts code points from 0."""
    found, between = _chunks(F.col(text))
    rows = df.select(F.col(key), *extra, F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"),
                     found.alias("found"), between.alias("between")).filter(F.size("found") > 0)
    # start of each candidate: the lengths of all before it
    sizes = F.zip_with("between", "found", lambda b, f: F.length(b) + F.coalesce(F.length(f), F.lit(0)))
    item = F.transform("found", lambda f, i: F.struct(
        i.alias("nth"), f.alias("whole"), F.element_at("between", i + 1).alias("before"), F.element_at("between", i + 2).alias("after"),
        (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(F.element_at("between", i + 1))).alias("at")))
    out = rows.withColumn("sizes", sizes).select(key, *extra, "text_hash", F.explode(item).alias("c"))
    lead = F.regexp_extract("c.whole", _LEAD, 0)
    return out.select(
        key, *extra, "text_hash", F.col("c.nth").alias("nth"), (F.col("c.at") + F.length(lead)).cast("long").alias("start"),
        (F.length("c.whole") - F.length(lead)).cast("long").alias("length"), lead.alias("lead"),
        F.substring("c.whole", F.length(lead) + 1, F.length("c.whole")).alias("value"),
        F.right("c.before", F.lit(CONTEXT)).alias("before"), F.left("c.after", F.lit(CONTEXT)).alias("after"),
        # the run of characters without space that ends at the candidate, read backwards
        F.reverse("c.before").rlike(r"^\S*?//:").alias("url_before"))


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.greatest(F.length("value"), F.lit(1))


def letter_runs(found: DataFrame, *columns: str) -> DataFrame:
    """``run``: the letter runs of candidates, one a row."""
    return found.select(*columns, F.explode(F.regexp_extract_all(F.lower("value"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("run"))


def dictionary(texts: DataFrame, text: str, runs: DataFrame) -> DataFrame:
    """``run`` of those letter runs that the texts use as words ``DICTIONARY_USES`` times or more."""
    words = texts.select(F.explode(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+")).alias("run"))
    few = bounded_broadcast(runs.select("run").distinct(), DICTIONARY_BROADCAST_ROWS)
    return (words.join(few, "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("uses"))
            .filter(F.col("uses") >= DICTIONARY_USES).select("run"))


def features(found: DataFrame, known_words: DataFrame) -> DataFrame:
    """Candidates (a stored table) with the forest's features; ``known_words`` is a ``dictionary``."""
    rows = found.withColumn("cid", F.monotonically_increasing_id())
    known = letter_runs(rows, "cid").join(bounded_broadcast(known_words, DICTIONARY_BROADCAST_ROWS), "run")
    covered = known.groupBy("cid").agg(F.sum(F.length("run")).alias("covered"))
    rows = rows.join(covered, "cid", "left").drop("cid")
    n = F.greatest(F.length("value"), F.lit(1))
    letters = F.filter(F.split("value", ""), lambda c: c != "")
    # uses of each character: the runs of the sorted characters
    uses = F.transform(F.regexp_extract_all(F.array_join(F.array_sort(letters), ""), F.lit(r"(?s)((.)\2*)"), F.lit(1)), lambda r: F.length(r) / n)
    entropy = F.aggregate(F.transform(uses, lambda p: -p * F.log2(p)), F.lit(0.0), lambda a, b: a + b)
    near = F.lower(F.concat_ws(" ", "before", "lead", F.left("after", F.lit(20))))
    flag = lambda c: c.cast("double")
    return rows.withColumns({
        "log_length": F.log2(n.cast("double")), "digit_share": _share("[0-9]"), "upper_share": _share("[A-Z]"),
        "symbol_share": _share("[^A-Za-z0-9]"),
        "class_changes": _share("(?<=[a-z])[A-Z0-9]|(?<=[A-Z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[A-Za-z0-9])[^A-Za-z0-9]"),
        "vowel_changes": _share("(?i)(?<=[aeiou])[^aeiou0-9\\W_]|(?<=[b-df-hj-np-tv-z])[aeiou]"),
        "entropy": entropy,
        "distinct_share": F.size(F.array_distinct(letters)) / n,
        "longest_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all("value", F.lit(r"((.)\2*)"), F.lit(1)), F.length)), F.lit(0)) / n,
        "hex_only": flag(F.col("value").rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "dictionary_share": F.coalesce(F.col("covered"), F.lit(0)) / n,
        "vendor": flag(F.col("value").rlike("^(?:" + "|".join(VENDORS) + ")")), "key_block": flag(F.col("value").startswith("-----BEGIN")),
        "named": flag(F.length("lead") > 0), "quoted": flag(F.col("after").rlike("^[\"'`]")),
        "in_url": flag(F.col("url_before") | F.col("value").contains("://")), "url_user": flag(F.col("lead").startswith("://")),
        "spaces": _share(r"\s"),
        "in_path": flag(F.col("before").rlike(r"[/\\.]$") | F.col("after").rlike(r"^(?:/|\.[a-z]{2,4}\b)")),
        "dotted": flag(F.col("value").contains(".")),
        "secret_word_near": flag(near.rlike(rf"\b[a-z0-9_-]*(?:{NAMES})")), "benign_word_near": flag(near.rlike(rf"\b(?:{BENIGN})\b")),
    }).drop("covered")


def labelled_findings(texts: DataFrame, key: str = "doc_id", text: str = "text", bound: int = FINDINGS) -> DataFrame:
    """``finding, text, label``: values of known making among words of at most ``bound`` texts."""
    words = F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    # a share of the texts by hash first, so that few rows meet in the task that cuts at the bound
    share = min(1.0, 4 * bound / max(texts.count(), 1))
    near = F.pmod(F.col("h"), F.lit(1 << 31)) < F.lit(int(share * (1 << 31)))
    rows = (texts.withColumn("h", F.xxhash64(key, text)).filter(near).select("h", words.alias("w"))
            .filter(F.size("w") >= 8).select("h", F.slice("w", (F.pmod("h", F.size("w") - 7) + 1).cast("int"), F.lit(8)).alias("w")).distinct().orderBy("h").limit(bound))
    hexed = F.sha2(F.concat(F.lit("finding"), F.col("h").cast("string")), 512)
    b64 = F.regexp_replace(F.base64(F.unhex(hexed)), "[\\s=]", "")
    plain = F.regexp_replace(b64, "[+/]", "x")
    w = lambda i: F.regexp_replace(F.lower(F.element_at("w", i)), r"[^\p{L}]", "")
    secret = [  # value as it stands in the text
        F.concat(F.lit('token = "'), F.left(hexed, F.lit(40)), F.lit('"')),
        F.concat(F.lit("api_key: "), F.left(b64, F.lit(40))),
        F.concat(F.lit("password='"), F.left(plain, F.lit(20)), F.lit("'")),
        F.concat(F.lit("ghp_"), F.left(plain, F.lit(36))),
        F.concat(F.lit("AKIA"), F.upper(F.left(plain, F.lit(16)))),
        F.concat(F.lit("Authorization: bearer "), F.left(plain, F.lit(48))),
        F.concat(F.lit("sk_live_"), F.left(plain, F.lit(24))),
        F.concat(F.lit("secret="), F.left(hexed, F.lit(64))),
        F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), b64, F.lit("\n-----END RSA PRIVATE KEY-----")),
        F.concat(F.lit("TOKEN = \""), F.upper(F.left(hexed, F.lit(40))), F.lit("\"!!")),
        F.concat(F.lit('password = "'), F.left(plain, F.lit(6)), F.lit(","), F.right(plain, F.lit(5)), F.lit('!"')),
        F.concat(F.lit('DB_PASSWORD: "'), F.substring(plain, 9, 4), F.lit("$"), F.left(hexed, F.lit(3)), F.lit('"')),
        F.concat(F.lit("pwd="), w(1), F.substring(hexed, 5, 2)),
        F.concat(F.lit('SECRET_KEY_BASE_PRODUCTION = "'), F.substring(plain, 3, 12), F.lit('"')),
        F.concat(F.lit("postgres://app:"), F.substring(plain, 2, 9), F.lit("!@db.host/x")),
        F.concat(F.lit('password = "'), w(1), F.substring(hexed, 9, 1), F.lit('"')),
    ]
    alike = [
        F.concat(F.lit("commit "), F.left(hexed, F.lit(40))),
        F.concat(F.lit("sha256 checksum "), F.left(hexed, F.lit(64))),
        F.concat(F.lit("uuid "), F.regexp_replace(F.left(hexed, F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")),
        F.concat(w(1), F.lit("_"), w(2), F.lit("_"), w(3), F.lit("_"), w(4), F.lit("_20240101")),
        F.concat(F.lit('token = "your_'), w(1), F.lit("_"), w(2), F.lit('_here"')),
        F.concat(F.lit("password: changeme"), w(2)),
        F.concat(F.lit("api_key = xxxxxxxxxxxxxxxxxxxx")),
        F.concat(F.lit("https://www.example.com/static/"), w(1), F.lit("/"), w(2), F.lit("-"), w(3), F.lit("-123456.html")),
        F.concat(F.lit("secret: "), w(1), w(2), w(3)),
        F.concat(F.lit("build-2024-01-01-"), w(1), F.lit("-"), w(2), F.lit("-release1")),
        F.concat(F.lit("the secret: "), w(1)),
        F.concat(F.lit('token = "'), w(1), F.lit(" "), w(2), F.lit(" "), w(3), F.lit('"')),
        F.concat(F.lit('password: "'), w(1), F.lit('"')),
        F.concat(F.lit("author: "), w(1), F.lit(" "), w(2)),
        F.concat(F.lit("authors="), w(1), F.lit(","), w(2)),
        F.concat(F.lit("https://docs:"), F.lit("8080/"), w(1), F.lit("/"), w(2)),
    ]
    both = [(c, 1.0) for c in secret] + [(c, 0.0) for c in alike]
    item = F.array(*[F.struct(F.lit(i).alias("i"), c.alias("v"), F.lit(label).alias("label")) for i, (c, label) in enumerate(both)])
    out = rows.select("h", "w", F.explode(item).alias("x")).filter(F.pmod(F.col("h") + F.col("x.i") * 7, F.lit(5)) == 0).filter("x.v is not null")
    around = F.concat(F.array_join(F.slice("w", 1, 4), " "), F.lit(" "), F.col("x.v"), F.lit(" "), F.array_join(F.slice("w", 5, 4), " "))
    return out.select(F.xxhash64("h", "x.i").alias("finding"), around.alias("text"), F.col("x.label").alias("label"))


def found_in_findings(findings: DataFrame) -> DataFrame:
    """Candidates of labelled findings; of a finding's candidates the longest bears the label."""
    found = candidates(findings, "finding", "text", ("label",))
    top = found.groupBy("finding").agg(F.max_by("nth", F.struct("length", "nth")).alias("nth"))
    return found.join(top, ["finding", "nth"])


def train(rows: DataFrame, trees: int = TREES, depth: int = DEPTH):
    """Forest from candidates with features and ``label``; none if there aren't two labels."""
    data = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("finding", "label", "features")
    data = Scratch(rows.sparkSession, "forest").table(data.orderBy("finding"), "features")
    if data.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt").fit(data)


def judge(rows: DataFrame, model) -> DataFrame:
    """Candidates with features, and their ``score`` and ``is_secret``. Without a model (nothing
    to learn from) every candidate counts."""
    if model is None:
        return rows.withColumns({"score": F.lit(1.0), "is_secret": F.lit(True)})
    rows = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows))
    rows = rows.withColumn("score", vector_to_array("probability")[1])
    return rows.withColumn("is_secret", F.col("score") >= SECRET_SCORE).drop("features", "rawPrediction", "probability", "prediction")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """Every candidate with ``score`` and ``is_secret``; without ``findings`` (``finding, text, label``)
    the forest is trained on some made from ``df``."""
    scratch = Scratch(df.sparkSession, "secrets")
    found = scratch.table(candidates(df, key, text).dropDuplicates([key, "text_hash", "nth"]), "candidates")
    findings = labelled_findings(df, key, text) if findings is None else findings
    taught = scratch.table(found_in_findings(findings), "findings")
    runs = letter_runs(found).unionByName(letter_runs(taught))
    words = scratch.table(dictionary(df, text, runs), "dictionary")
    return judge(features(found, words), train(features(taught, words)))


def redact(df: DataFrame, verdicts: DataFrame, key: str = "doc_id", text: str = "text", mask: str = MASK) -> DataFrame:
    """``df`` with every secret replaced by ``mask``; names before a secret stay."""
    hits = (verdicts.filter("is_secret").groupBy(F.col(key).alias("__key"), F.col("text_hash").alias("__hash"))
            .agg(F.collect_set("nth").alias("__hits")))
    rows = df.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(hits, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__text_hash") == F.col("__hash")), "left")
    found, between = _chunks(F.col(text))
    masked = F.transform(found, lambda f, i: F.when(F.array_contains("__hits", i), F.concat(F.regexp_extract(f, _LEAD, 0), F.lit(mask))).otherwise(f))
    whole = F.array_join(F.zip_with(between, masked, lambda b, f: F.concat(b, F.coalesce(f, F.lit("")))), "")
    return rows.withColumn(text, F.when(F.col("__hits").isNull(), F.col(text)).otherwise(whole)).select(*df.columns)
