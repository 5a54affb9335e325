"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example's context is all that comes before the turn, and only the reply is trainable. All examples of a
conversation are prefixes of one rendering, so they are kept as that rendering with the offsets of each example;
``explode_examples`` writes them out, a row for each. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Escapes, in this order: what opens a mark of this template or of another common one never stands in a text or role.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
OPEN, MIDDLE, CLOSE = "<|turn|>", "<|says|>", "<|end|>"


def escape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[1]), F.lit(pair[0])), reversed(ESCAPES), text)


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def prefix_targets(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted (the whole conversation), examples: array of (stop, first, last).

    Turns come in the order of turn (null first), then role and text. Example k is the prefix of ``formatted`` of
    length ``stop``; its trainable characters are those after ``first`` up to ``last`` (equal, if none). Each turn of
    the role ``assistant`` is the end of one example. Turns after the last reply, or of a conversation without one,
    are the end of one more example with nothing trainable, so no turn is lost. Null texts and roles count as empty;
    null conv_ids are one conversation; repeated rows are repeated turns; an empty table gives no rows. A conversation
    is one row, as its digest needs it whole; conversations are spread by a hash of their ids.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumn("rendered", render_turn(F.col("role"), F.col("text"))).withColumn("head", F.length(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))).cast("long"))
    # The ends of the turns are running sums over the sorted turns; what follows needs no other shuffle.
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    stop = F.sum(F.length("rendered").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = rows.select("conv_id", F.struct(F.row_number().over(order).alias("place"), "rendered", (F.col("role") == "assistant").alias("reply"), "head", stop.alias("stop")).alias("t"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    example = lambda t: F.struct(t["stop"].alias("stop"), (t["stop"] - F.length(t["rendered"]) + t["head"]).alias("first"), (t["stop"] - len(CLOSE)).alias("last"))
    replies = F.transform(F.filter("turns", lambda t: t["reply"]), example)
    end = F.element_at("turns", -1)
    rest = F.array(F.struct(end["stop"].alias("stop"), end["stop"].alias("first"), end["stop"].alias("last")))
    examples = F.when(end["reply"], replies).otherwise(F.concat(replies, rest))
    return grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"), examples.alias("examples"))


def explode_examples(targets: DataFrame) -> DataFrame:
    """A row for each example: conv_id, example, formatted (context and reply), loss_first, loss_last.

    Rows of ``targets`` with one conv_id are each expanded; no rows give none.
    """
    rows = targets.select("conv_id", "formatted", F.posexplode("examples").alias("example", "e"))
    return rows.select("conv_id", "example", F.substring("formatted", F.lit(1), F.col("e.stop").cast("int")).alias("formatted"), F.col("e.first").alias("loss_first"), F.col("e.last").alias("loss_last"))


def parse_turns(formatted: Column) -> Column:
    """The turns of a rendering: array of (role, text), unescaped."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x: x != "")

    def turn(part: Column) -> Column:
        role = F.substring_index(part, MIDDLE, 1)
        body = F.substring(part, F.length(role) + len(MIDDLE) + 1, F.length(part) - F.length(role) - len(MIDDLE) - len(CLOSE))
        return F.struct(unescape(role).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_back(targets: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples), n_examples.

    All are read from the examples as ``explode_examples`` writes them: the turns from the last one, which is the whole
    conversation, the trainable text from each one's own span. Empty roles and texts read back as such; a conversation
    without a reply has one example and no trainable text; no rows give none.
    """
    loss = unescape(F.substring("formatted", (F.col("loss_first") + 1).cast("int"), (F.col("loss_last") - F.col("loss_first")).cast("int")))
    parts = explode_examples(targets).select("conv_id", "example", "formatted", loss.alias("loss"))
    rows = parts.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("whole"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"), F.count(F.lit(1)).alias("n_examples"),
    )
    rows = rows.withColumn("turns", parse_turns(F.col("whole"))).withColumn("loss", F.array_join("losses.loss", ""))
    turns = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")
