"""Quality rules against a brute-force version."""
import math
import re
from collections import Counter

from matchsmith.llm import quality, queries
from matchsmith.llm.common import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, sp):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    held = set()
    for i, w in enumerate(zip(words, words[1:], words[2:])):
        if windows[w] > 1:
            held |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    ids = sp.encode(text)
    counts = Counter(ids)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": dup, "n_repeat_words": len(held), "n_chars": len(text), "n_tokens": len(ids),
            "n_bytes": sum(sp.is_byte(i) for i in ids), "token_entropy": entropy,
            "base_failed": len(words) < 50 or 100 * len(held) > 50 * len(words)}


def same(row, want):
    for k, v in want.items():
        assert row[k] == v if not isinstance(v, float) else math.isclose(row[k], v, abs_tol=1e-9), (k, row[k], v)


def processor():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(quality.MODEL))


def test_measures_of_awkward_texts(awkward, no_documents):
    sp = processor()
    rows = quality.measures(awkward).collect()
    want = {(r["doc_id"], len(r["text"] or ""), WORD.findall(r["text"] or "").__len__()): brute(r["text"], sp) for r in awkward.collect()}
    assert len(rows) == awkward.count()
    for r in rows:
        same(r, want[r["doc_id"], r["n_chars"], r["n_words"]])
    assert quality.quality(no_documents).count() == 0
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(awkward).collect()}
    assert kept[3] is False and kept[4] is False and kept[8] is False


def test_op4_query(spark, small):
    sp = processor()
    texts = spark.read.parquet(f"{small}/documents.parquet").toPandas().set_index("doc_id")["text"]
    for r in queries.op4_quality(spark, small).collect():
        same(r, brute(texts[r["doc_id"]], sp))
        assert not (r["base_failed"] and r["kept"])


def test_verdicts_against_labels(spark):
    """Held against the labels: junk goes, good documents stay."""
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("n_words >= 50").toPandas()
    good, junk = rows[rows["quality"] == 1], rows[rows["quality"] == 0]
    assert good["kept"].mean() > 0.97 and junk["kept"].mean() < 0.15


def test_repeats_of_many_words():
    import numpy as np
    codes = np.array([0, 1, 2, 3, 0, 1, 2, 0, 1, 2])
    rows = np.array([0, 0, 0, 0, 0, 0, 0, 1, 1, 1])
    assert quality._repeats(codes, rows, 2).tolist() == [6, 0]
    assert quality._repeats(codes + (1 << 22), rows, 2).tolist() == [6, 0]  # too many words for packed keys


def prose(spark, n, lang="en"):
    """Clean texts of ``n`` documents of the given tables."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(f"lang = '{lang}'")
    good = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1")
    rows = docs.join(good, "doc_id").filter("size(split(text, ' ')) between 100 and 140").orderBy("doc_id").dropDuplicates(["text"])
    return [r["text"] for r in rows.limit(n).collect()]


def test_copies_have_one_vote(spark):
    """A group of copies larger than its class decides neither on itself nor on others."""
    clean = prose(spark, 60)
    assert len(clean) >= 40
    junk = " ".join(f"#{i}$%&|x<{i * 7919 % 1000}>*" for i in range(40)) + " " + " ".join(f"q{i}z{i}" for i in range(20))
    schema = "doc_id long, text string, lang string"
    alone = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + [junk])], schema)
    copied = spark.createDataFrame([(i, t, "en") for i, t in enumerate(clean + [junk] * 300 + [clean[0]] * 300)], schema)
    once = {r["doc_id"]: r["kept"] for r in quality.quality(alone).collect()}
    got = {r["doc_id"]: r["kept"] for r in quality.quality(copied).collect()}
    n = len(clean)
    assert not once[n] and sum(once.values()) > 0.9 * n
    assert all(got[i] == once[min(i, n)] for i in range(n + 300)) and all(got[i] == once[0] for i in range(n + 300, n + 600))


def in_script(text, first):
    """The text with its Latin letters replaced by those from ``first``."""
    return text.lower().translate({97 + i: first + i for i in range(26)})


def test_scripts_of_texts(spark):
    texts = ["plain words", "ελληνικά and one", "русский текст", "हिन्दी पाठ", "日本語のテキスト", "12 34 #$%", "", None, "ﬁne ＡＢＣ 😀",
             "العربية", "한국어 글", "µª 1"]
    rows = quality.measures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect()
    assert [r["script"] for r in sorted(rows, key=lambda r: r["doc_id"])] == [
        "LATIN", "GREEK", "CYRILLIC", "DEVANAGARI", "HAN", "", "", "", "LATIN", "ARABIC", "HANGUL", ""]


def test_no_band_of_another_script_rejects(spark):
    """Clean texts in a rare script stay, with a language, without one, and under a wrong one; symbols without letters go."""
    clean = prose(spark, 60)
    rows = [(t, "en") for t in clean]
    n = len(rows)
    rows += [(in_script(t, 0x3B1), "el") for t in clean[:5]] + [(in_script(t, 0x430), None) for t in clean[:5]]
    rows += [(in_script(t, 0x627), "en") for t in clean[:5]]
    many = len(rows)
    rows += [(in_script(t, 0x905), None) for t in clean[:40]]
    symbols = len(rows)
    rows += [(" ".join(f"#{i}$%&|{i * 7919 % 1000}*" for i in range(j, j + 90)), lang) for j, lang in ((0, "en"), (100, None))]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")).collect()}
    assert sum(kept[i] for i in range(n)) > 0.9 * n
    assert all(kept[i] for i in range(n, many))
    assert sum(kept[i] for i in range(many, symbols)) >= 36
    assert not kept[symbols] and not kept[symbols + 1]
