"""Chat formatting by prefix-target expansion: one example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's control strings: start of a turn, end of its role, end of the turn.
OPEN, SAYS, CLOSE = "<s>", "[INST]", "</s>"


def escape(text: Column) -> Column:
    """Text without `<` and `[`, so that it can hold no control string; unescape() gives it back exactly."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant") -> DataFrame:
    """conv_id, turns: the formatted turns (segment) in order, those of target_role with loss_start and loss_end.

    Each turn of target_role is an example: the text of all segments up to its own, all preceding turns as
    context, of which only the reply between loss_start and loss_end (code points in that text) is trainable. All
    examples of a conversation are prefixes of one text, which is stored once: expansion grows with the turns
    and not with their square. expand() gives their whole texts, examples() their last segments. Turns come in
    order of turn, role and text, nulls first; a null role or text is empty; a null conv_id is one conversation;
    repeated rows are turns of their own. A conversation is one output row, so it has to fit one; the sort
    within it may spill.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    body = escape(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", "text", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(SAYS), body, F.lit(CLOSE)).alias("segment"), F.length(body).alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = F.sum(F.length("segment").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - len(CLOSE)
    rows = rows.withColumns({"no": F.row_number().over(order), "upto": upto})
    target = F.col("role") == target_role
    segment = F.struct("no", "segment", F.when(target, F.col("upto") - F.col("body")).alias("loss_start"), F.when(target, F.col("upto")).alias("loss_end"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(segment)).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: t.dropFields("no")).alias("turns"))


def examples(formatted: DataFrame) -> DataFrame:
    """conv_id, n_segments, segment, before, loss_start, loss_end: a row for each turn, exploded; loss_start is null where nothing is trainable.

    before counts the code points of the segments before, as they are in the output, so an example's text is
    before + length(segment) long and its last segment starts at before.
    """
    rows = formatted.select("conv_id", F.posexplode("turns").alias("no", "t")).select("conv_id", (F.col("no") + 1).alias("n_segments"), "t.*")
    earlier = Window.partitionBy("conv_id").orderBy("n_segments").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length("segment").cast("long")).over(earlier), F.lit(0).cast("long"))
    return rows.select("conv_id", "n_segments", "segment", before.alias("before"), "loss_start", "loss_end")


def expand(formatted: DataFrame) -> DataFrame:
    """conv_id, n_segments, text, loss_start, loss_end: every example with its whole text, as a trainer reads it."""
    return expand_all(formatted).where(F.col("loss_start").isNotNull()).drop("final")


def expand_all(formatted: DataFrame) -> DataFrame:
    """The rows of expand(), and one without loss for any turns after a conversation's last example, which holds these alone.

    final: does a turn that no example before has end this text last; the final texts of a conversation hold each turn once.
    """
    upto = F.filter(F.transform("turns", lambda t, i: F.when(t["loss_start"].isNotNull(), i + 1)), lambda i: i.isNotNull())
    rows = formatted.select("conv_id", "turns", upto.alias("upto"), F.coalesce(F.array_max(upto), F.lit(0)).alias("last"), F.size("turns").alias("size"))
    row = lambda first, n, final: F.struct(first.alias("first"), n.alias("n"), final.alias("final"))
    rest = F.when(F.col("last") < F.col("size"), F.array(row(F.col("last"), F.col("size"), F.lit(True))))
    examples = F.transform("upto", lambda n: row(F.lit(0), n, n == F.col("last")))
    rows = rows.select("conv_id", "turns", F.explode(F.concat(examples, F.coalesce(rest, F.array().cast("array<struct<first:int,n:int,final:boolean>>")))).alias("x"))
    text = F.array_join(F.transform(F.slice("turns", F.col("x.first") + 1, F.col("x.n") - F.col("x.first")), lambda t: t["segment"]), "")
    end = F.get("turns", F.col("x.n") - 1)
    return rows.select("conv_id", F.col("x.n").alias("n_segments"), text.alias("text"), end["loss_start"].alias("loss_start"), end["loss_end"].alias("loss_end"), "x.final")


def read_turns(text: Column) -> Column:
    """The turns (role, text) of formatted text, parsed by the control strings."""
    fields = F.transform(F.split(F.substr(text, F.lit(1), F.length(text) - len(CLOSE)), CLOSE), lambda t: F.split(F.substr(t, F.lit(len(OPEN) + 1)), r"\[INST\]"))
    return F.transform(fields, lambda f: F.struct(unescape(f[0]).alias("role"), unescape(f[1]).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """The digests of a formatted table, all read back from its examples with their whole texts. formatted_chars counts these, and any turns after the last.

    A reply is what stands between the loss offsets of its example's text.
    """
    reply = unescape(F.substr("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    row = F.struct("n_segments", reply.alias("reply"), F.when(F.col("final"), F.col("text")).alias("text"), F.length("text").cast("long").alias("chars"))
    g = expand_all(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    joined = lambda c: F.array_join(F.transform("rows", lambda r: r[c]), "")  # noqa: E731  # nulls are left out
    g = g.select("conv_id", read_turns(joined("text")).alias("turns"), joined("reply").alias("loss"), F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["chars"]).alias("chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return g.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("chars").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
s AS (SELECT *, 13 + length(replace(replace(replace(text, chr(92), chr(92) || 'e'), '<', chr(92) || 'l'), '[', chr(92) || 'b'))
    + length(replace(replace(replace(role, chr(92), chr(92) || 'e'), '<', chr(92) || 'l'), '[', chr(92) || 'b')) AS n FROM c),
u AS (SELECT *, sum(n) OVER w AS upto, max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS used
  FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant'), 0) + coalesce(sum(n) FILTER (used = 0), 0) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""
