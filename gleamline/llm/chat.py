"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are context, and only its
reply is trainable.  A turn is written as ``<s>role``, a line break, the text and ``</s>``.  Control
strings inside a text get a backslash after their first character, and one more if they have some
already, so the marks of the template never occur in a text and ``unescape`` gives it back.

``format_turns`` writes every turn once, with its place in the formatted conversation.
``expand`` has a row per assistant turn, with the whole formatted text of all turns before it as its context,
of whatever length, and its reply.  All contexts of a conversation together grow with its square; they are made
where they are read, block by block of turns, and the query writes none.  The digests are read from the
examples' texts: the losses from each example's own, the turns from that of the last reply, which holds all up
to it.

Places are found by blocks of turns: counts are summed within a block, and over the blocks.  A
conversation that holds a third of all rows so spreads over many tasks.

Defined cases: a null text or role counts as empty.  Turns are ordered by turn, role and text, null
turns first; rows that repeat a turn are turns of their own.  Null conversation numbers are one
conversation.  An empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleamline.llm.common import column
from gleamline.session import stage

# The control strings that texts may not contain.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")

_FIRST = r"([<\[])"
_REST = r"(s>|/s>|INST\]|/INST\])"
BLOCK = 1024
_NO_TURN = -(1 << 62)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"(\\*)" + _REST, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _FIRST + r"\\(\\*)" + _REST, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role stands on one line."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # \\ and \n are told apart by parking double backslashes behind a mark no escaped role has.
    parked = F.replace(role, F.lit("\\\\"), F.lit("<s>"))
    return unescape(F.replace(F.replace(parked, F.lit("\\n"), F.lit("\n")), F.lit("<s>"), F.lit("\\")))


def _before(df: DataFrame, part: list[str], order: list, what: str) -> Column:
    rows = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(what).over(rows), F.lit(0))


def format_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, block, position, piece, start, target, example): each turn as written, staged.

    ``position`` counts turns and ``start`` characters of the formatted conversation, both from 0;
    ``target`` marks assistant turns; ``example`` counts the assistant turns before this one.
    """
    turns = convs.select(
        column("conv_id").alias("conv_id"),
        F.coalesce(F.floor(column("turn") / BLOCK), F.lit(_NO_TURN)).alias("block"),
        column("turn").alias("turn"),
        F.coalesce(column("role"), F.lit("")).alias("role"),
        F.coalesce(column("text"), F.lit("")).alias("text"),
    ).select(
        "conv_id", "block", "turn", "role", "text",
        F.concat(F.lit("<s>"), _escape_role(F.col("role")), F.lit("\n"), escape(F.col("text")), F.lit("</s>")).alias("piece"),
        (F.col("role") == "assistant").alias("target"),
    )
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    part = ["conv_id", "block"]
    local = stage(
        turns.withColumns({"chars": F.char_length("piece").cast("long"), "targets": F.col("target").cast("long")})
        .withColumns(
            {
                "nth": F.row_number().over(Window.partitionBy(*part).orderBy(*order)) - 1,
                "start_in": _before(turns, part, order, "chars"),
                "example_in": _before(turns, part, order, "targets"),
            }
        )
        .select(*part, "nth", "piece", "target", "chars", "targets", "start_in", "example_in")
    )
    blocks = local.groupBy(*part).agg(
        F.count("*").alias("rows"), F.sum("chars").alias("chars"), F.sum("targets").alias("targets")
    )
    over = [["conv_id"], ["block"]]
    offsets = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        _before(blocks, *over, "rows").alias("rows_before"),
        _before(blocks, *over, "chars").alias("chars_before"),
        _before(blocks, *over, "targets").alias("targets_before"),
    )
    return stage(
        local.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).select(
            "conv_id", "block",
            (F.col("rows_before") + F.col("nth")).alias("position"),
            "piece",
            (F.col("chars_before") + F.col("start_in")).alias("start"),
            "target",
            (F.col("targets_before") + F.col("example_in")).alias("example"),
        )
    )


def expand(turns: DataFrame) -> DataFrame:
    """One example per assistant turn of ``format_turns``' result.

    (conv_id, block, example, context_turns, context_chars, context, reply, loss_start, loss_chars, last): the
    example's text is its context and its reply; ``loss_start`` counts in that text from 0; ``last`` marks the
    last example of a conversation.
    """
    kept = ["position", "start", "target", "example", "piece"]
    blocks = turns.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("turns"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.instr("t.piece", "\n")
    return (
        blocks.withColumn("own", F.concat_ws("", F.col("turns.piece")))
        .withColumn("before", F.concat_ws("", F.collect_list("own").over(before)))
        .withColumn("targets", F.filter("turns", lambda t: t["target"]))
        .withColumn("final", F.max(F.array_max(F.col("targets.example"))).over(whole))
        .select("conv_id", "block", "before", "own", "targets", "final")
        # The blocks of a long conversation are expanded in tasks of their own.
        .repartition("conv_id", "block")
        .select("conv_id", "block", F.concat("before", "own").alias("text"), "final", F.explode("targets").alias("t"))
        .select(
            "conv_id", "block", "t.example",
            F.col("t.position").alias("context_turns"),
            F.col("t.start").alias("context_chars"),
            F.substring(F.col("text"), F.lit(1), F.col("t.start").cast("int")).alias("context"),
            F.col("t.piece").alias("reply"),
            (F.col("t.start") + head).alias("loss_start"),
            (F.char_length("t.piece") - head - F.lit(len("</s>"))).cast("long").alias("loss_chars"),
            (F.col("t.example") == F.col("final")).alias("last"),
        )
    )


def contexts(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv_id, context_turns, context): the whole context of each of ``examples``."""
    return examples.select("conv_id", "context_turns", "context")


def turns_of(text: Column) -> Column:
    """(role, text) of each turn in a formatted text, as an array: control strings in it are all the template's."""

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(4), cut - 4)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substring(piece, cut + 1, F.char_length(piece))).alias("text"))

    pieces = F.split(text, "</s>")
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_losses(examples: DataFrame) -> DataFrame:
    """(conv_id, block, example, loss): each example's text, context and reply, under its loss mask."""
    text = F.concat("context", "reply")
    loss = F.substring(text, (F.col("loss_start") + 1).cast("int"), F.col("loss_chars").cast("int"))
    return examples.select("conv_id", "block", "example", unescape(loss).alias("loss"))


def _joined(rows: DataFrame, key: list[str], order: str, text: Column, also: dict[str, Column]) -> DataFrame:
    """Texts in order, first by block, then by ``key``: a digest needs them in one string."""

    def glue(name: str) -> Column:
        return F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("at", name))), lambda x: x[name]))

    blocks = rows.select(*key, "block", F.col(order).alias("at"), text.alias("t"), *(c.alias(n) for n, c in also.items()))
    blocks = blocks.groupBy(*key, "block").agg(glue("t").alias("t"), *(F.sum(n).alias(n) for n in also))
    return blocks.withColumnRenamed("block", "at").groupBy(*key).agg(glue("t").alias("t"), *(F.sum(n).alias(n) for n in also))


def digests(turns: DataFrame, examples: DataFrame) -> DataFrame:
    """What the written examples say, one row per conversation.

    Turns are read out of the last example's text, context and reply, and the turns that follow it.
    A digest of a conversation is one value over its whole text, which so meets in one row.
    """
    key = ["conv_id"]
    whole = examples.filter("last").select(*key, "context_turns", F.concat("context", "reply").alias("upto"))
    last = whole.select(*key, "context_turns")
    upto = whole.select(F.col("conv_id").alias("u"), "upto")
    ends = last.select(F.col("conv_id").alias("c"), "context_turns")
    after = turns.join(ends, F.col("conv_id").eqNullSafe(F.col("c")), "left").filter(
        F.col("context_turns").isNull() | (F.col("position") > F.col("context_turns"))
    )
    after = _joined(after, key, "position", F.col("piece"), {}).select(F.col("conv_id").alias("a"), F.col("t").alias("after"))
    loss = _joined(read_losses(examples), key, "example", F.col("loss"), {"n": F.char_length("loss").cast("long")})
    loss = loss.select(F.col("conv_id").alias("l"), F.col("t").alias("loss"), F.col("n").alias("loss_chars"))
    empty = F.lit("")
    read = turns_of(F.concat(F.coalesce("upto", empty), F.coalesce("after", empty)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return (
        upto.join(after, F.col("u").eqNullSafe(F.col("a")), "full")
        .select(F.coalesce("u", "a").alias("conv_id"), "upto", "after")
        .join(loss, F.col("conv_id").eqNullSafe(F.col("l")), "left")
        .withColumn("turns", read)
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
            F.coalesce("loss_chars", F.lit(0).cast("long")).alias("loss_chars"),
            F.sha2(F.coalesce("loss", empty), 256).alias("loss_sha256"),
            (F.coalesce(F.char_length("upto"), F.lit(0)) + F.coalesce(F.char_length("after"), F.lit(0))).cast("long").alias("formatted_chars"),
        )
    )
