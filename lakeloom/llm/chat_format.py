"""Chat formatting of multi-party dialogues by perspective rotation.

For every participant of a conversation the dialogue is rendered once with that
speaker as ``assistant`` and all others as named users; masks mark the
characters to learn from, the assistant's own words and their end markers.
System turns stay system turns in each rendering.

Turns are numbered along one global sort.  A rendering is stored in blocks of a
bounded number of turns, so neither a conversation with a large share of all
rows nor its renderings meet in one task; the blocks are storage only.  Joined in
order they are the rendering of the whole dialogue, and masks are places in that
whole: ``block_start`` is where a block begins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, number_rows

START, END = "<|im_start|>", "<|im_end|>"  # markers of the common chat markup
SYSTEM = "system"
BLOCK_TURNS = 256
VIEW_CHARS = 4_000_000  # characters of renderings in one Arrow batch
SUPER_BLOCKS = 4096  # blocks of a conversation whose starts are summed together
WHITE = r"[\x20\x09-\x0D]+"
SCHEMA = "conv_id long, perspective string, block long, block_start long, n_turns long, n_assistant long, rendered string, mask array<struct<start:long,stop:long>>"


def plain(text: str | None) -> str:
    """Text that cannot be read as markup: the opening of a marker is parted."""
    return (text or "").replace("<|", "< |")


def plain_name(role: str) -> str:
    """A role as a user's name: on one line, without markup."""
    return plain(re.sub(WHITE, " ", role).strip(" "))


def render(turns: list[tuple[str | None, str | None]], speaker: str, at: int = 0) -> tuple[str, list[tuple[int, int]], int]:
    """Markup of (role, text) turns as seen by ``speaker``, its mask in code points from ``at`` on, and the speaker's turns."""
    parts: list[str] = []
    mask: list[tuple[int, int]] = []
    own = 0
    for role, text in turns:
        if role == speaker:
            head = f"{START}assistant\n"
        elif role == SYSTEM:
            head = f"{START}system\n"
        elif not role:
            head = f"{START}user\n"
        else:
            head = f"{START}user name={plain_name(role)}\n"
        body = f"{plain(text)}{END}"
        if role == speaker:
            own += 1
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "\n"]
        at += len(head) + len(body) + 1
    return "".join(parts), mask, own


def _shown(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _starts(views: DataFrame) -> DataFrame:
    """Start of each block (conv_id, perspective, block, n_chars) in its rendering: sums within runs of blocks, and over the runs."""
    runs = views.withColumn("run", F.expr(f"block div {SUPER_BLOCKS}"))
    view = ["conv_id", "perspective"]
    before = (Window.unboundedPreceding, -1)
    whole = runs.groupBy(*view, "run").agg(F.sum("n_chars").alias("all"))
    whole = whole.withColumn("first", F.coalesce(F.sum("all").over(Window.partitionBy(*view).orderBy("run").rowsBetween(*before)), F.lit(0)))
    inner = F.coalesce(F.sum("n_chars").over(Window.partitionBy(*view, "run").orderBy("block").rowsBetween(*before)), F.lit(0))
    first = whole.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("run").alias("_r"), "first")
    placed = runs.withColumn("inner", inner).join(first, F.expr("conv_id <=> _c and perspective = _p and run = _r"))
    return placed.select(F.col("conv_id").alias("_c"), F.col("perspective").alias("_p"), F.col("block").alias("_b"), (F.col("first") + F.col("inner")).alias("block_start"))


def format_conversations(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Render conversations (conv_id, turn, role, text) from every participant's perspective.

    A row for each conversation, participant and block of ``block_turns`` turns:
    conv_id, perspective, block, block_start, n_turns, n_assistant, rendered,
    mask.  The blocks of a conversation and participant, joined in order, are the
    rendering of the whole; ``mask`` has start and stop in code points of that
    whole, ``block_start`` the place of the block's first.  Participants are the
    distinct roles but ``system``; a null or empty role speaks as an unnamed user
    and is no participant, so conversations with only such and system turns give
    no row.  A role's white space is one space each in its name.  Turns follow
    (turn, role, text), nulls first; turns that tie or repeat all stay.  A null
    text is an empty turn; rows with a null conv_id are one conversation.  Other
    columns are not read.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    numbered, _ = number_rows(rows, [F.col(c) for c in ("conv_id", "turn", "role", "text")], "row_number")
    first = numbered.groupBy("conv_id").agg(F.min("row_number").alias("first"), F.count(F.lit(1)).alias("all")).withColumnRenamed("conv_id", "_c")
    placed = numbered.join(first, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("seq", F.col("row_number") - F.col("first"))
    placed = placed.withColumn("block", F.expr(f"seq div {int(block_turns)}"))
    blocks = placed.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "role", "text"))).alias("turns"))
    speakers = rows.filter(F.col("role") != "").filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_c"), F.col("role").alias("perspective")).distinct()
    views = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "perspective", "block", "turns")

    # Where blocks begin, for conversations of more than one: from the sizes of their turns, before anything is rendered.
    role = F.col("role")
    name = F.length(F.concat(F.lit(f"{START}user name="), _shown(F.trim(F.regexp_replace(role, WHITE, " "))), F.lit("\n")))
    other = F.when(role == SYSTEM, len(f"{START}system\n")).when(F.coalesce(role, F.lit("")) == "", len(f"{START}user\n")).otherwise(name)
    long = placed.filter(F.col("all") > block_turns).select("conv_id", "block", "role", other.alias("head"), (F.length(_shown(F.col("text"))) + len(END) + 1).alias("body"))
    sizes = long.groupBy("conv_id", "block").agg(F.sum(F.col("head") + F.col("body")).alias("n_chars"))
    own = long.groupBy("conv_id", "block", "role").agg(F.sum(F.lit(len(f"{START}assistant\n")) - F.col("head")).alias("more"))
    sizes = sizes.join(speakers, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    own = own.select(F.col("conv_id").alias("_c"), F.col("block").alias("_b"), F.col("role").alias("_p"), "more")
    sizes = sizes.join(own, F.expr("conv_id <=> _c and block = _b and perspective = _p"), "left").withColumn("n_chars", F.col("n_chars") + F.coalesce("more", F.lit(0)))
    starts = materialize(_starts(sizes.select("conv_id", "perspective", "block", "n_chars")), "starts")
    views = views.join(starts, F.expr("conv_id <=> _c and perspective = _p and block = _b"), "left")
    views = views.select("conv_id", "perspective", "block", F.coalesce("block_start", F.lit(0)).cast("long").alias("block_start"), "turns")
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        size = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                conv, speaker, block, start, said = (c[i].as_py() for c in batch.columns)
                text, mask, own = render([(t["role"], t["text"]) for t in said], speaker, start)
                made.append((conv, speaker, block, start, len(said), own, text, [{"start": a, "stop": b} for a, b in mask]))
                size += len(text)
                if size >= VIEW_CHARS:
                    yield batch_of(made)
                    made, size = [], 0
        if made:
            yield batch_of(made)

    return views.mapInArrow(run, SCHEMA)
