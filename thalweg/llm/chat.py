r"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role
merged with an array aggregation. The template writes each merged turn as

    ### role: text</turn>\n

In texts a backslash becomes ``\b``, ``###`` becomes ``\h``, ``</turn>`` becomes ``\t``
and ``<join>`` becomes ``\j``, so no control string survives inside one and the way
back is exact. Turns merged into one are joined by ``<join>``, so the template can be
read back turn by turn. The loss mask lists the spans of the assistant's texts.

Defined cases: a null text is empty; a null role reads as the role ``null``; turns are
ordered by turn number (null first), then role, then text, so repeated rows stay, next
to each other; a null conv_id is a conversation of its own; an empty table gives no
conversation; other columns are ignored. One conversation has to fit one task's memory,
as its formatted text is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed strings of the template.
OPEN, MIDDLE, CLOSE, JOIN = "### ", ": ", "</turn>", "<join>"


#: What stands for each of them, and for the escape itself, inside a text.
ESCAPES = (("\\", "\\b"), ("###", "\\h"), (CLOSE, "\\t"), (JOIN, "\\j"))


def escape(text: Column) -> Column:
    """The text without control strings."""
    for control, code in ESCAPES:
        text = F.replace(text, F.lit(control), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given: every backslash left in it starts a code."""
    for control, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(control))
    return text


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its sorted turns: array of (turn, role, text)."""
    role = F.coalesce(F.col("role").cast("string"), F.lit("null"))
    turn = F.struct(F.col("turn"), role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def merged(turns: DataFrame) -> DataFrame:
    """conv_id and ``merged``: adjacent turns of one role as (role, texts), both escaped.

    A run of turns starts where the role changes; each is one slice of the array, so the
    work is in proportion to the turns.
    """
    role_of = lambda turn: F.replace(escape(turn["role"]), F.lit(":"), F.lit("\\c"))
    c = turns.withColumn("roles", F.transform("turns", role_of)).withColumn("n", F.size("turns"))
    every = F.sequence(F.lit(0), F.col("n") - 1)
    c = c.withColumn("starts", F.filter(every, lambda i: (i == 0) | (F.get("roles", i) != F.get("roles", i - 1))))

    def run(start: Column, k: Column) -> Column:
        after = F.coalesce(F.get("starts", k + 1), F.col("n"))
        own = F.slice("turns", start + 1, after - start)
        return F.struct(F.get("roles", start).alias("role"), F.transform(own, lambda t: escape(t["text"])).alias("texts"))

    return c.select("conv_id", F.transform("starts", run).alias("merged"))


def starts_of(frame: DataFrame, lengths: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of all entries before each one of the array ``lengths``.

    An aggregation that grows an array copies it at every step, so sums are made in
    chunks of about the root of the length, and the chunks are summed likewise.
    """
    n = F.size(lengths)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    grown = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("before"))
    add = lambda done, x: F.struct((done["at"] + x).alias("at"), F.concat(done["before"], F.array(done["at"])).alias("before"))
    chunks = F.transform(F.sequence(F.lit(1), n, step), lambda i: F.aggregate(F.slice(lengths, i, step), grown, add))
    frame = frame.withColumn("chunks", F.when(n > 0, chunks).otherwise(F.array().cast("array<struct<at:bigint,before:array<bigint>>>")))
    frame = frame.withColumn("chunk_starts", F.aggregate("chunks", grown, lambda done, x: add(done, x["at"]))["before"])
    each = F.zip_with("chunks", "chunk_starts", lambda c, s: F.transform(c["before"], lambda b: b + s))
    return frame.withColumn(out, F.flatten(each)).drop("chunks", "chunk_starts")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, formatted text, and the loss mask as (start, length) spans of code points."""

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(turn: Column) -> Column:
        head = piece(F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE)), F.lit(False))
        body = F.flatten(F.transform(turn["texts"], lambda x, i: F.array(
            piece(F.when(i > 0, F.lit(JOIN)).otherwise(F.lit("")), F.lit(False)), piece(x, turn["role"] == "assistant")
        )))
        return F.concat(F.array(head), body, F.array(piece(F.lit(CLOSE + "\n"), F.lit(False))))

    c = merged(conversations(turns)).select("conv_id", F.flatten(F.transform("merged", pieces)).alias("p"))
    c = starts_of(c.withColumn("lengths", F.transform("p", lambda x: F.length(x["text"]).cast("long"))), "lengths", "at")
    spans = F.zip_with(F.zip_with("p", "lengths", lambda x, n: F.struct(x["loss"].alias("loss"), n.alias("length"))), "at", lambda x, s: F.struct(x["loss"].alias("loss"), s.alias("start"), x["length"].alias("length")))
    lost = F.transform(F.filter(spans, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return c.select("conv_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("formatted"), lost.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text) and loss_text, from the formatted text and mask alone."""
    blocks = F.filter(F.split("formatted", CLOSE + "\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, MIDDLE, 1)
        body = F.substr(block, F.length(head) + len(MIDDLE) + 1)
        role = unescape(F.replace(F.substr(head, F.lit(len(OPEN) + 1)), F.lit("\\c"), F.lit(":")))
        return F.transform(F.split(body, JOIN), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    def under(span: Column) -> Column:
        # four bytes a character: a span is cut out at once, wherever it starts
        return unescape(F.decode(F.substr("wide", (span["start"] * 4 + 1).cast("int"), (span["length"] * 4).cast("int")), "UTF-32"))

    return formatted.withColumn("wide", F.encode("formatted", "UTF-32")).select(
        "conv_id", "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"),
        F.array_join(F.transform("loss_spans", under), "").alias("loss_text"),
    )
