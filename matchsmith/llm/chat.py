"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own, written out: all turns before it are its
context, and only its own text is trainable (``examples``). Turns after the last assistant turn
stand in one further row, the whole conversation without a loss mask. An example of a very long
conversation is cut into rows (``part``) of ``BLOCK`` turns at most, and the rows are made by as
many tasks as there are parts, since all its examples together are quadratic in its length.
``format_turns`` places the formatted turns, ``render`` gives chosen conversations' examples in
one row each, and ``read_back`` recovers turns and loss texts from the examples.

The template marks turns by control strings that begin with ``[`` or ``<``. Inside texts (and
unusual roles) a backslash goes before every backslash, ``[`` and ``<`` (in roles before ``]`` too), so no text can form a
control string and ``read_back`` gives every text back exactly.

Null texts count as empty, a null role as the empty one. Turns are in the order of ``turn``
(null first), equal ones by role and text, so repeated rows are turns of their own. A null
conversation id is one conversation. Empty tables give empty results. Further columns aren't
read. Running positions are sums within blocks of ``BLOCK`` turn numbers, offset by the blocks'
totals, so a very long conversation isn't one task's window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchsmith.operators.joins import bounded_broadcast

BLOCK = 1024

# Template: role, string before the text, string after it.
TEMPLATE = (
    ("system", "<<SYS>>\n", "\n<</SYS>>\n"),
    ("user", "[INST] ", " [/INST]"),
    ("assistant", " ", " </s>"),
)
OTHER = ("[ROLE ", "] ", " [/ROLE]")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _by_role(role: Column, values: list, other: Column) -> Column:
    out = None
    for (name, _, _), value in zip(TEMPLATE, values):
        out = F.when(role == name, value) if out is None else out.when(role == name, value)
    return out.otherwise(other)


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """One row a turn: ``conv_id, turn, position, is_target, is_last, segment, segment_start`` and, for
    targets, ``context_chars, loss_start, loss_end, example_end``."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), r.alias("role"), t.alias("text"))
    before = _by_role(F.col("role"), [F.lit(b) for _, b, _ in TEMPLATE],
                      F.concat(F.lit(OTHER[0]), F.regexp_replace(escape(F.col("role")), r"\]", r"\\]"), F.lit(OTHER[1])))
    after = _by_role(F.col("role"), [F.lit(a) for _, _, a in TEMPLATE], F.lit(OTHER[2]))
    rows = rows.withColumns({
        "segment": F.concat(before, escape(F.col("text")), after), "lead": F.length(before), "tail": F.length(after),
        "is_target": F.col("role") == "assistant", "block": F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 62))) / BLOCK)})
    rows = rows.withColumn("chars", F.length("segment").cast("long"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    running = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({
        "nth": F.row_number().over(inside).cast("long") - 1,
        "chars_before": F.coalesce(F.sum("chars").over(running), F.lit(0))})
    totals = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("conv_id").alias("conv"), F.col("block").alias("blk"),
                           F.when(F.lead("block").over(Window.partitionBy("conv_id").orderBy("block")).isNull(), F.col("n") - 1).alias("end"),
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"),
                           F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"))
    rows = rows.join(totals, rows["conv_id"].eqNullSafe(totals["conv"]) & (rows["block"] == totals["blk"]))
    start = F.col("c0") + F.col("chars_before")
    target = lambda c: F.when(F.col("is_target"), c)
    return rows.select(
        "conv_id", "turn", (F.col("n0") + F.col("nth")).alias("position"), "is_target", F.coalesce(F.col("nth") == F.col("end"), F.lit(False)).alias("is_last"),
        "segment", start.alias("segment_start"),
        target(start).alias("context_chars"), target(start + F.col("lead")).alias("loss_start"),
        target(start + F.col("chars") - F.col("tail")).alias("loss_end"), target(start + F.col("chars")).alias("example_end"))


def examples(formatted: DataFrame) -> DataFrame:
    """Every assistant turn as an example with all turns before it, written out: ``conv_id, turn, position``
    (of the assistant turn), ``is_target, is_last, part, text, loss_start, loss_end``. ``text`` is the
    example, or its ``part``-th run of ``BLOCK`` turns; code points ``loss_start`` to ``loss_end`` of it are
    trainable (null: none). ``is_last`` marks the rows that hold a whole conversation: the example of its
    last turn, or, where that is no target, a row of its own without a mask (``is_target`` false)."""
    rows = formatted.withColumn("part", F.floor(F.col("position") / BLOCK))
    is_end = F.col("is_target") | F.col("is_last")
    end = F.struct("position", "turn", "is_target", "is_last", "loss_start", "loss_end",
                   (F.col("segment_start") + F.length("segment")).alias("stop"))
    texts = [F.array_sort(F.collect_list(F.struct("position", "segment"))).alias("segments"), F.min("segment_start").alias("start")]
    ends = F.array_sort(F.collect_list(F.when(is_end, end))).alias("ends")
    whole = F.array_join(F.transform("segments", lambda x: x["segment"]), "").alias("whole")
    named = ["conv_id", "e.turn", "e.position", "e.is_target", "e.is_last", "part"]

    own = rows.groupBy("conv_id", "part").agg(*texts, ends).select("conv_id", "part", "start", "ends", whole)
    own = own.select("conv_id", "part", "start", "whole", F.explode("ends").alias("e"))
    inside = lambda c: (F.col(c) - F.col("start")).cast("int")
    own = own.select(*named, F.substring(F.col("whole"), F.lit(1), inside("e.stop")).alias("text"),
                     inside("e.loss_start").alias("loss_start"), inside("e.loss_end").alias("loss_end"))
    # examples of long conversations that end in a later part hold this one whole
    later = rows.where((F.col("part") > 0) & is_end).select(
        F.col("conv_id").alias("c"), F.col("part").alias("l"), F.struct("turn", "position", "is_target", "is_last").alias("e"))
    later = later.groupBy("c", "l").agg(F.collect_list("e").alias("ends"))
    later = later.select("c", "ends", F.explode(F.sequence(F.lit(0).cast("long"), F.col("l") - 1)).alias("p"))
    long = bounded_broadcast(rows.where("part > 0").select(F.col("conv_id").alias("c")).distinct())
    before = rows.join(long, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    before = before.groupBy("conv_id", "part").agg(*texts).select("conv_id", "part", whole)
    before = before.join(later, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")))
    before = before.select("conv_id", "part", "whole", F.explode("ends").alias("e"))
    return own.unionByName(before.select(*named, F.col("whole").alias("text"), F.lit(None).cast("int").alias("loss_start"),
                                         F.lit(None).cast("int").alias("loss_end")))


# A formatted turn: in texts and roles no bracket stands without a backslash before it.
_BODY = r"[^\\\[<]*+(?:\\.[^\\\[<]*+)*+"
SEGMENT = (r"(?s)(?:<<SYS>>\n|\[INST\] |\[ROLE [^\\\]]*+(?:\\.[^\\\]]*+)*+\] | )" + _BODY
           + r"(?:<</SYS>>\n|\[/INST\]|\[/ROLE\]|</s>)")


def parse(seg: Column) -> tuple[Column, Column]:
    """Role and text back from a formatted turn."""
    found_role, found_text = None, None
    for name, lead, tail in TEMPLATE:
        at = seg.startswith(lead)
        body = F.substring(seg, F.lit(len(lead) + 1), F.length(seg) - F.lit(len(lead) + len(tail)))
        found_role = F.when(at, F.lit(name)) if found_role is None else found_role.when(at, F.lit(name))
        found_text = F.when(at, body) if found_text is None else found_text.when(at, body)
    # the first bracket that no backslash precedes ends an unusual role
    named = r"(?s)^\[ROLE ([^\\\]]*(?:\\.[^\\\]]*)*)\] (.*) \[/ROLE\]$"
    return (found_role.otherwise(unescape(F.regexp_extract(seg, named, 1))),
            unescape(found_text.otherwise(F.regexp_extract(seg, named, 2))))


def render(formatted: DataFrame, conversations: DataFrame) -> DataFrame:
    """Examples in full, ``conv_id, turn, position, context, reply``, of the conversations whose
    ``conv_id`` stands in ``conversations``, each in one row however long."""
    chosen = formatted.join(conversations.select("conv_id").distinct(), "conv_id", "left_semi")
    targets = chosen.filter("is_target").select("conv_id", "turn", "position", F.col("segment").alias("reply"))
    earlier = chosen.select(F.col("conv_id").alias("c"), F.col("position").alias("at"), "segment")
    rows = targets.join(earlier, (F.col("conv_id") == F.col("c")) & (F.col("at") < F.col("position")), "left")
    parts = F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "segment"))))
    return (rows.groupBy("conv_id", "turn", "position", "reply")
            .agg(F.array_join(F.transform(parts, lambda p: p["segment"]), "").alias("context"))
            .select("conv_id", "turn", "position", "context", "reply"))


def read_back(written: DataFrame) -> DataFrame:
    """Per conversation: its turns, parsed from the example that holds them all, and the texts under the
    loss masks of all its examples, as digests. A digest of a whole conversation needs its text in one row."""
    def line(seg: Column) -> Column:
        role, text = parse(seg)
        return F.concat(role, F.lit("\n"), text, F.lit("\n"))
    segments = F.regexp_extract_all("text", F.lit(SEGMENT), F.lit(0))
    masked = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    chars = F.length("text").cast("long")
    rows = written.select(
        "conv_id", F.when(F.col("is_last"), chars).alias("formatted"), F.when(F.col("is_target"), chars).alias("example"),
        F.when(F.col("loss_start").isNotNull(), F.struct("position", unescape(masked).alias("text"))).alias("loss"),
        F.when(F.col("is_last"), F.struct("part", segments.alias("segments"))).alias("turns"))
    rows = rows.withColumn("turns", F.when(F.col("turns").isNotNull(), F.struct(
        "turns.part", F.size("turns.segments").cast("long").alias("n"), F.array_join(F.transform("turns.segments", line), "").alias("text"))))
    per = rows.groupBy("conv_id").agg(
        F.sum("turns.n").alias("n_turns"), F.array_sort(F.collect_list("turns")).alias("turns"), F.array_sort(F.collect_list("loss")).alias("loss"),
        F.sum("formatted").alias("formatted_chars"), F.coalesce(F.sum("example"), F.lit(0)).alias("example_chars"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")
    return per.select("conv_id", "n_turns", F.sha2(joined("turns"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("long").alias("loss_chars"),
                      F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars", "example_chars")


def digests(formatted: DataFrame) -> DataFrame:
    """``read_back`` of the examples of formatted turns."""
    return read_back(examples(formatted))
