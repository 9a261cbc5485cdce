"""HTML extraction, WARC archives and chat formatting."""
import base64
import hashlib
import html as entities
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from matchsmith.llm import chat, extraction, queries, warc
from matchsmith.llm.common import Scratch

CASES = [
    ("", ""), (None, ""), ("plain text only", "plain text only"), ("<p>a<p>b", "a\nb"), ("a &amp b <!-- c --> d <br> e &am", "a & b d e &am"),
    ("<p>words that stay</p><p", "words that stay"),
    ("<div id=sidebar><p>x y z</p></div><div id=content><h1>T</h1><p>Long text here about things, with words.</p><p>Sh.</p>"
     "<div class=share><a>x</a></div></div><div class='comments'><p>first comment, long enough to be text</p></div>",
     "T\nLong text here about things, with words.\nSh."),
    ("<body><header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>one &lt;b&gt; &#233;\n\t two</p>"
     "<aside>no</aside><section><p>three</p></section><article class='comment'>c</article></article></main><form>q<input></form>",
     "Title\none <b> é two\nthree"),
    ("<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class='cookie-notice'>We use cookies, lots of them, and say so.</div>"
     "<article><h1>H</h1><p><b>Bold start.<br>next</b><p>Tail.</article><footer>foot</footer>", "H\nBold start. next\nTail."),
    ("<table><tr><td><a>l1</a> <a>l2</a></td><td><p>Cell text that is long enough to be the article.</p><p>Two.</p></td></tr></table>",
     "Cell text that is long enough to be the article.\nTwo."),
    ("<script>var a = '<p>no</p>';</script><style>p{}</style><noscript>n</noscript><p>yes</p>", "yes"),
    ("<p style='display: none'>hidden</p><p hidden>h</p><p>seen &nbsp; text</p>", "seen text"),
    ("</p></div><p>stray ends</p></article>", "stray ends"),
    ("<article><p>Body text of the page, long enough.</p><ol class='commentlist'><li>me too, said a reader of this page</li></ol></article>",
     "Body text of the page, long enough."),
]


@pytest.mark.parametrize("page,text", CASES)
def test_main_text(page, text):
    assert extraction.main_text(page) == text


def test_smoothing():
    flat = extraction.smoothed(extraction.np.array([3.0] * 7))
    assert extraction.np.allclose(flat, 3.0)
    spike = extraction.smoothed(extraction.np.array([0, 0, 0, 9.0, 0, 0, 0]))
    assert spike[3] == spike.max() < 9 and spike[2] == pytest.approx(spike[4])


def test_op1_query(spark, small):
    """Against a plain reading of the one article element of each page."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in queries.op1_html_text(spark, small).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", pages[r["page_id"]], re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " ")))).strip()
                  for b in re.split(r"</?p>|</?h1>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_extraction_of_awkward_rows(spark):
    long = "<article>" + "<p>some words of a long page</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, 5), (2, None, "", 5), (None, "u", "<p>x</p>", 5), (3, "u", "<p>x</p>", 5), (3, "u", "<p>x</p>", 5), (4, "u", long, 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted((r["page_id"] or 0, r["n_chars"]) for r in extraction.extract(df).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1), (4, len("some words of a long page") * 20_000 + 19_999)]
    assert extraction.extract(df.limit(0)).count() == 0


def archive(spark, df, compression="gzip", **kw):
    folder = Scratch(spark, "test").path("archive")
    warc.register(spark)
    warc.deduplicated(df, **kw).write.format("warc").option("compression", compression).mode("append").save(folder)
    return folder


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


PAGES = [(1, "u", None), (2, "u%41 \n\r\x7f", ""), (3, None, "xé"), (4, "v", "xé"), (None, "w", "xé"), (4, "v", "xé"), (5, "z", "a\r\n\r\nWARC/1.1\r\n\r\n" * 3)]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_round_trip(spark, compression):
    df = spark.createDataFrame([(*p, "record_type") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3)
    folder = archive(spark, df, compression)
    rows = spark.read.format("warc").option("verify", "true").load(folder).collect()
    got = sorted((r["record_id"] or "", r["url"] or "", r["record_type"], r["refers_to"] or "", r["payload_digest"], r["payload_bytes"]) for r in rows)
    want = []
    for i, u, h in PAGES:
        payload = (h or "").encode()
        top = {"": 2, "xé": 4}.get(h or "", i)
        kind = "response" if i == top else "revisit"
        want.append((str(i) if i is not None else "", u or "", kind, str(top) if kind == "revisit" else "", b32(payload), len(payload)))
    assert got == sorted(want)
    payloads = {(r["record_id"], bytes(r["payload"])) for r in rows if r["record_type"] == "response"}
    assert payloads == {("2", b""), ("4", "xé".encode()), ("5", PAGES[-1][2].encode())}


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive_filters_and_options(spark, compression):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = archive(spark, df, compression)
    read = spark.read.format("warc").load(folder)
    for condition, n in (("record_type = 'revisit'", 3), ("record_id in ('4', '5')", 3), ("url like 'u%'", 2), ("refers_to is not null", 3),
                         ("record_type = 'response' and url = 'z'", 1), ("payload_bytes > 3", 1)):
        assert read.filter(condition).count() == n, condition
    assert "Filter " not in read.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    bare = spark.read.format("warc").option("payload", "false").load(folder)
    assert bare.filter("payload is not null").count() == 0 and bare.count() == len(PAGES)
    many = spark.read.format("warc").option("splitBytes", "1").load(folder)
    assert many.count() == len(PAGES)
    assert archive(spark, df, least_bytes=3) and spark.read.format("warc").load(archive(spark, df, least_bytes=3)).filter("record_type = 'revisit'").count() == 2
    assert spark.read.format("warc").load(archive(spark, df.limit(0))).count() == 0


class Counted:
    """A file that counts the bytes read."""

    def __init__(self, raw):
        import io
        self.f, self.n = io.BytesIO(raw), 0

    def read(self, n):
        out = self.f.read(n)
        self.n += len(out)
        return out

    def seek(self, at):
        self.f.seek(at)

    def tell(self):
        return self.f.tell()


def reader(**kw):
    return warc.WarcReader("x", kw.get("payload", True), False, 1)


@pytest.mark.parametrize("pack", [warc.gzip_member, lambda raw: raw, __import__("gzip").compress])
def test_members_with_and_without_lengths(monkeypatch, pack):
    import random
    monkeypatch.setattr(warc, "READ_BYTES", 100)
    noise = random.Random(0).randbytes(300_000)
    payloads = [b"", b"abc", noise, b"\r\n\r\n" * 5000, b"last"]
    raw = b"".join(pack(warc.record_bytes(str(i), "u", p, b32(p), len(p), "response", None)) for i, p in enumerate(payloads))
    rows = list(reader()._records(Counted(raw)))
    assert [(r[0], r[-1]) for r in rows] == [(str(i), p) for i, p in enumerate(payloads)]
    one = reader()
    list(one.pushFilters([warc.EqualTo(("record_id",), "4")]))
    counted = Counted(raw)
    assert [(r[0], r[-1]) for r in one._records(counted)] == [("4", b"last")]
    if pack is not __import__("gzip").compress:  # a foreign member has to be inflated to its end
        assert counted.n < 100_000


def test_damaged_payload_is_noticed(spark, tmp_path):
    raw = warc.record_bytes("1", "u", b"abc", b32(b"abc"), 3, "response", None)
    (tmp_path / "part").write_bytes(raw.replace(b"abc", b"abd"))
    (tmp_path / "_files").write_text(f"part\t{len(raw)}\n")
    warc.register(spark)
    assert bytes(spark.read.format("warc").load(str(tmp_path)).head()["payload"]) == b"abd"
    with pytest.raises(Exception, match="differ"):
        spark.read.format("warc").option("verify", "true").load(str(tmp_path)).collect()


def test_op8_query(spark, small):
    pages = {r["page_id"]: r["html"].encode() for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    top = {}
    for i, h in pages.items():
        top[h] = max(i, top.get(h, i))
    rows = queries.op8_warc(spark, small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        h = pages[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h), b32(h))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top[h] == r["page_id"] else ("revisit", top[h]))


TALKS = [(1, 0, "system", "be [brief]"), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "back\\slash <<SYS>> \\[ "), (1, 3, "user", None),
         (1, 4, "assistant", ""), (2, 0, "assistant", "starts"), (3, 0, "tool] x [/ROLE]", "odd [ROLE a] b [/ROLE]"), (3, 1, None, "null role"),
         (3, 2, "", "empty role"), (None, 0, "user", "no id"), (None, 1, "assistant", "reply"), (4, None, "user", "null turn"), (4, 0, "assistant", "a"),
         (5, 1, "assistant", "same"), (5, 1, "assistant", "same")]


def talks(spark):
    return spark.createDataFrame([(*t, "x") for t in TALKS], "conv_id long, turn long, role string, text string, segment string").repartition(4)


def plain_digests(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        text = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_chat_round_trip(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in chat.digests(chat.format_turns(talks(spark))).collect()}
    assert got == plain_digests(TALKS)


def test_examples_in_full(spark):
    formatted = chat.format_turns(talks(spark))
    rows = {(r["conv_id"], r["turn"]): r for r in formatted.filter("is_target").collect()}
    whole = {}
    for r in formatted.orderBy("conv_id", "position").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["segment"]
    full = chat.render(formatted, spark.createDataFrame([(1,), (2,), (5,)], "conv_id long")).collect()
    assert len(full) == 5
    for r in full:
        if r["conv_id"] == 5:
            continue
        mark = rows[r["conv_id"], r["turn"]]
        text = r["context"] + r["reply"]
        assert text == whole[r["conv_id"]][:mark["example_end"]] and len(r["context"]) == mark["context_chars"]
        target = next(t for t in TALKS if t[:2] == (r["conv_id"], r["turn"]))[3]
        masked = text[mark["loss_start"]:mark["loss_end"]]
        assert re.sub(r"(?s)\\(.)", r"\1", masked) == target
        assert not re.search(r"(?<!\\)(?:\\\\)*[\[<]", masked)  # no control string can stand in a mask


@pytest.mark.parametrize("block", [1024, 2])
def test_every_assistant_turn_is_written_with_its_context(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    formatted = chat.format_turns(talks(spark))
    whole, want = {}, {}
    for r in formatted.orderBy("conv_id", "position").collect():
        whole[r["conv_id"]] = whole.get(r["conv_id"], "") + r["segment"]
        if r["is_target"] or r["is_last"]:
            want[r["conv_id"], r["position"]] = (whole[r["conv_id"]], whole[r["conv_id"]][r["loss_start"]:r["loss_end"]] if r["is_target"] else None)
    got = {}
    for r in chat.examples(formatted).orderBy("part").collect():
        text, loss = got.get((r["conv_id"], r["position"]), ("", None))
        assert r["loss_start"] is None or loss is None
        got[r["conv_id"], r["position"]] = (text + r["text"], loss if r["loss_start"] is None else r["text"][r["loss_start"]:r["loss_end"]])
    assert got == want and sum(loss is not None for _, loss in got.values()) == sum(t[2] == "assistant" for t in TALKS)


def test_op10_reads_written_examples(spark, small, monkeypatch):
    seen, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, label, **kw: seen.append(table(self, df, label, **kw)) or seen[-1])
    got = queries.op10_chat_format(spark, small).agg(F.sum("example_chars")).head()[0]
    assert seen[-1].where("is_target").agg(F.sum(F.length("text"))).head()[0] == got
    turns = spark.read.parquet(f"{small}/conversations.parquet").where("role = 'assistant'").count() + 1
    assert seen[-1].where("is_target").select("conv_id", "position").distinct().count() == turns


def test_op10_query(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{small}/conversations.parquet')")
    want = con.execute(queries.ORACLES["op10_chat_format"]).fetchdf()
    got = queries.op10_chat_format(spark, small).toPandas()
    assert sorted(got[want.columns].itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))
    own = got.set_index("conv_id").loc[-7]
    assert own["n_turns"] == 2 and own["loss_chars"] == len(queries.CONTROL_TEXT)
    assert chat.digests(chat.format_turns(talks(spark).limit(0))).count() == 0


P = ["This paragraph number %d of the article is long enough to be taken for running prose by any measure of it." % i for i in range(12)]
BODY = "".join(f"<p>{p}</p>" for p in P)


def test_class_words_of_wrappers():
    from matchsmith.llm.extraction import main_text
    nav = "<nav><a href=/>Home</a></nav>"
    want = "\n".join(["Title", *P])
    for page in (f"<body>{nav}<div class='layout has-sidebar'><h1>Title</h1>{BODY}</div></body>",
                 f"<body>{nav}<div id='page' class='with-sidebar'><article><h1>Title</h1>{BODY}</article><div class=sidebar>Aside text</div></div></body>",
                 f"<body>{nav}<article class='post comments-open'><h1>Title</h1>{BODY}</article><footer>Foot</footer></body>",
                 f"<body><form id=aspnetForm><h1>Title</h1>{BODY}</form></body>",
                 f"<head><title>T</title><meta charset=utf-8><body>{nav}<article><h1>Title</h1>{BODY}</article></body>",
                 f"<html><head><title>T</title><div><h1>Title</h1>{BODY}</div></html>"):
        assert main_text(page) == want, page[:80]
    long = "<div class='comment-list'>" + "".join(f"<article class='comment-body'><p>{p} Indeed, {p}</p></article>" for p in P * 3) + "</div>"
    assert main_text(f"<body><article><h1>Title</h1>{BODY}</article>{long}</body>") == want
    assert main_text(f"<body><h1>Title</h1><div>{BODY}</div><div class=comments>{BODY * 3}</div></body>") == want


def test_regions_without_article_hold_the_whole_cluster():
    from matchsmith.llm.extraction import main_text
    lead = "A lead that says in one sentence what the whole of the article below is going to be about."
    many = "".join(f"<li>{p}</li>" for p in P * 5)
    cases = [(f"<div class=post><h1>Title</h1><p>{lead}</p><div class=body>{BODY}</div></div>", ["Title", lead, *P]),
             (f"<div class=post><h1>Title</h1><p>By A.</p><div class=body>{BODY}</div></div>", ["Title", "By A.", *P]),
             (f"<div><h1>Title</h1><p>{P[0]}</p><p>{P[1]}</p><ul>{many}</ul><p>{P[2]}</p></div>", ["Title", P[0], P[1], *P * 5, P[2]]),
             (f"<main><article>{BODY}</article><section><p>{P[0]}</p><p>{P[1]}</p></section></main>", [*P, P[0], P[1]]),
             (f"<div><article>{BODY}</article><div><p>{P[0]}</p><p>{P[1]}</p></div></div>", [*P, P[0], P[1]])]
    for page, want in cases:
        assert main_text(f"<body><nav><a href=/>Home</a></nav>{page}</body>").split("\n") == want, page[:80]


def test_names_made_from_titles_and_topics_keep_prose():
    from matchsmith.llm.extraction import main_text
    for inner in (f"<p class='social-history'>{P[0]}</p>", f"<h2 id='search-results'>{P[0]}</h2>", f"<p id='related-work'>{P[0]}</p>",
                  f"<h2 id='comments'>{P[0]}</h2>", f"<section id='login'><h2>Logging in</h2><p>{P[0]}</p></section>",
                  f"<section class='search-engines'><p>{P[0]}</p></section>", f"<div id='cookie-recipes'><p>{P[0]}</p></div>"):
        want = re.sub("<[^>]+>", "\n", inner).split("\n")
        page = f"<body><nav><a href=/>Home</a></nav><article><h1>Title</h1>{BODY}{inner}<p>{P[1]}</p></article></body>"
        assert main_text(page).split("\n") == ["Title", *P, *[w for w in want if w], P[1]], inner
    for inner in (f"<section id=comments><p>{P[0]}</p></section>", f"<div class=comment-list><p>{P[0]}</p></div>", f"<p class=advert>{P[0]}</p>",
                  f"<div class=sidebar><p>{P[0]}</p></div>", "<div class='related-posts'><a href=a>One more thing to read</a><a href=b>And another one</a></div>"):
        assert main_text(f"<body><article><h1>Title</h1>{BODY}{inner}</article></body>").split("\n") == ["Title", *P], inner


def test_comments_without_an_end():
    from matchsmith.llm.extraction import main_text
    whole = "\n".join(["Title", *P])
    for tail in ("<!-- unclosed <p>L", "<!-- one --><!-- two <p>L <!-- three", "<!-->kept-->"[:5] + "<!-- x"):
        assert main_text(f"<body><article><h1>Title</h1>{BODY}{tail}") == whole, tail
    assert main_text(f"<body><script>var a = '<!-- ';</script><article><h1>Title</h1>{BODY}</article></body>") == whole
    assert main_text(f"<body><!-- a --!><article><h1>Title</h1>{BODY}</article></body>") == whole


def plain_smoothed(ratios):
    reach = max(1, int(np.ceil(3 * extraction.SIGMA)))
    out = []
    for i in range(len(ratios)):
        w = [(np.exp(-0.5 * ((j - i) / extraction.SIGMA) ** 2), ratios[j]) for j in range(max(0, i - reach), min(len(ratios), i + reach + 1))]
        out.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
    return out


def test_smoothing_equals_a_plain_version():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40):
        ratios = rng.random(n) * 50
        assert np.allclose(extraction.smoothed(ratios), plain_smoothed(ratios))


def foreign(kind, block, content="text/plain", extra=b""):
    return (b"WARC/1.0\r\nWARC-Type: " + kind + b"\r\nWARC-Record-ID: <urn:uuid:" + kind + b">\r\nWARC-Target-URI: http://h/a%20b/\xe9\r\n"
            b"Content-Type: " + content.encode() + b"\r\n" + extra + b"Content-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


FOREIGN = [(b"warcinfo", b"software: x\r\n", "application/warc-fields"), (b"metadata", b"abcdef", "text/plain"),
           (b"resource", b"hello\r\n\r\nworld", "text/html"), (b"response", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore", "application/http; msgtype=response"),
           (b"request", b"GET / HTTP/1.1\r\nHost: h\r\n\r\n", "application/http; msgtype=request"), (b"conversion", b"", "text/plain")]
FOREIGN_PAYLOADS = {"warcinfo": b"software: x\r\n", "metadata": b"abcdef", "resource": b"hello\r\n\r\nworld", "response": b"body\r\n\r\nmore",
                    "request": b"", "conversion": None}


@pytest.mark.parametrize("packed", [False, True])
def test_archives_of_others(spark, tmp_path, packed):
    """No list of files, headers that are not UTF-8 or folded, blocks that are not HTTP messages."""
    import gzip
    raw = [foreign(*f, extra=b"WARC-Payload-Digest: sha256:00\r\nX-Long: one\r\n two\r\n") for f in FOREIGN]
    (tmp_path / "in").mkdir()
    for name, part in (("a.warc", raw[:3]), ("in/b.warc", raw[3:])):
        data = b"".join(map(gzip.compress, part)) if packed else b"".join(part)
        (tmp_path / (name + ".gz" * packed)).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no archive")
    warc.register(spark)
    rows = spark.read.format("warc").option("verify", "true").load(str(tmp_path)).collect()
    assert {r["record_type"]: r["payload"] and bytes(r["payload"]) for r in rows} == {k: v or (b"" if k == "request" else None) for k, v in FOREIGN_PAYLOADS.items()}
    assert {r["url"] for r in rows} == {"http://h/a%20b/é"} and all(r["headers"]["x-long"] == "one two" for r in rows)
    one = spark.read.format("warc").load(str(tmp_path / ("a.warc" + ".gz" * packed))).filter("record_type = 'metadata'").collect()
    assert [bytes(r["payload"]) for r in one] == [b"abcdef"]
