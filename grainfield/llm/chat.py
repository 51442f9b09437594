r"""Chat formatting in budgeted windows.

A turn of a conversation is written as ``<|turn|>role<|text|>text<|end|>`` and a line end; a turn that an earlier
window has had already begins with ``<|again|>``. In roles and texts a backslash becomes ``\b`` and ``<|`` becomes ``\l``, so no
text can hold a marker, and both read back as they were.

Prefix sums of turn tokens choose the windows: half of what is left of the budget after the system turn (its own
length, and at least ``Settings.system``) and the history is one stride, and a turn belongs to the stride in which it begins. Turns above a stride stand alone. Every
window but the first repeats the conversation's system turn (its first turn, if its role is ``system``) and the last turns of
the window before, as far as they are within the history budget. Repeated turns are never in the loss mask, so every
assistant text is a target exactly once.

Only built-in functions run. A conversation's turns meet in one window partition, a window's in one row; no
conversation is gathered as a whole but for the digests of op3, which are of whole conversations.

Nulls and odd cases: null texts and roles count as empty. Turns are ordered by number (null first), then role
and text, so ties and repeated rows have a defined order. Rows with a null id form one conversation. Empty
tables give empty results. A single turn above the budget makes a window above the budget, as turns are never cut;
a system turn that leaves no room is repeated all the same, and strides are one token, so each turn has its own window.
Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count

# fixed values: the markers of the template
TURN, AGAIN, TEXT, END = "<|turn|>", "<|again|>", "<|text|>", "<|end|>\n"


@dataclass(frozen=True)
class Settings:
    """budget: tokens of a window; system, history: tokens of it kept for the system turn, if it has no more, and for repeated turns."""

    budget: int = 1024
    system: int = 128
    history: int = 128

    @property
    def stride(self) -> int:
        return max(1, (self.budget - self.system - self.history) // 2)


def escaped(text: Column) -> Column:
    """The text without any marker in it."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<|"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """What ``escaped`` was given."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<|")), F.lit("\\b"), F.lit("\\"))


def _after(text: Column, mark: str) -> Column:
    return F.substring(text, F.locate(mark, text) + len(mark), F.length(text))


def windows(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(conv_id, window, formatted, loss): the text of each window and its loss mask, structs (start, length) in code points."""
    s = settings
    own = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("tokens", word_count(F.col("text")))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    own = own.withColumn("nth", F.row_number().over(order))
    order = W.partitionBy("conv_id").orderBy("nth")
    before = F.sum("tokens").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("tokens")
    every = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    is_system = (F.col("nth") == 1) & (F.col("role") == "system")
    kept = F.greatest(F.lit(s.system), F.max(F.when(is_system, F.col("tokens"))).over(every))
    own = own.withColumn("room", F.greatest(F.lit(1), F.floor((s.budget - s.history - kept) / 2)))
    own = own.withColumn("stride", F.floor(before / F.col("room"))).withColumn("alone", F.col("tokens") > F.col("room"))
    new = (F.col("stride") != F.lag("stride").over(order)) | F.col("alone") | F.lag("alone").over(order)
    own = own.withColumn("window", F.sum(F.coalesce(new, F.lit(False)).cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    back = W.partitionBy("conv_id", "window").orderBy(F.col("nth").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = own.withColumn("tail", F.sum("tokens").over(back))
    own = own.withColumn("last", F.max("window").over(every))
    repeats = (
        F.when(is_system, F.sequence(F.col("window"), F.col("last")))
        .when((F.col("tail") <= s.history) & (F.col("window") < F.col("last")), F.array(F.col("window"), F.col("window") + 1))
        .otherwise(F.array("window"))
    )
    placed = own.withColumn("at", F.explode(repeats))
    fresh = F.col("at") == F.col("window")
    head = F.concat(F.when(fresh, F.lit(TURN)).otherwise(F.lit(AGAIN)), escaped(F.col("role")), F.lit(TEXT))
    placed = placed.select("conv_id", F.col("at").alias("window"), "nth", head.alias("head"), escaped(F.col("text")).alias("body"), (fresh & (F.col("role") == "assistant")).alias("target"))
    lengths = placed.withColumn("size", F.length("head") + F.length("body") + F.lit(len(END)))
    inside = W.partitionBy("conv_id", "window").orderBy("nth")
    start = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size") + F.length("head")
    spans = lengths.withColumn("start", start)
    piece = F.struct("nth", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("target"), F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length"))).alias("span"))
    packed = spans.groupBy("conv_id", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    return packed.select("conv_id", "window", F.array_join("p.piece", "").alias("formatted"), F.filter("p.span", lambda x: x.isNotNull()).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a window that are no repeats, structs (role, text), read back from its text."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda x: F.startswith(x, F.lit(TURN)))
    return F.transform(parts, lambda x: F.struct(unescaped(F.substring(x, F.lit(len(TURN) + 1), F.locate(TEXT, x) - F.lit(len(TURN) + 1))).alias("role"), unescaped(_after(x, TEXT)).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda x: unescaped(F.substring(formatted, x["start"] + 1, x["length"]))), "")


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold markers, formatted and read back."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marked = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marked).alias("text"))
    out = windows(turns.unionByName(more))
    read = out.select("conv_id", "window", F.length("formatted").alias("size"), read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", "window", "size", F.size("turns").alias("n"), said.alias("said"), "loss")
    whole = read.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("size").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("window", "said", "loss"))).alias("w"))
    loss = F.array_join("w.loss", "")
    return whole.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM t),
r AS (SELECT *, greatest(1, (1024 - 128 - greatest(128, coalesce(max(tokens) FILTER (nth = 1 AND role = 'system') OVER (PARTITION BY conv_id), 0))) // 2) AS room FROM a),
b AS (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth) - tokens) // room AS stride, tokens > room AS alone FROM r),
c AS (SELECT *, coalesce(stride <> lag(stride) OVER w OR alone OR lag(alone) OVER w, false)::INT AS new FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY nth)),
d AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY nth) AS win FROM c),
e AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id, win ORDER BY nth DESC) AS tail, max(win) OVER (PARTITION BY conv_id) AS last FROM d),
f AS (
  SELECT *, length(replace(replace(role, '\', '\b'), '<|', '\l')) + length(replace(replace(text, '\', '\b'), '<|', '\l')) + 16 AS size,
    CASE WHEN nth = 1 AND role = 'system' THEN last - win WHEN tail <= 128 AND win < last THEN 1 ELSE 0 END AS again FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum((size + 8) * 1 + (size + 9) * again)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
