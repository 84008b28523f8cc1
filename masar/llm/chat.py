"""Chat formatting by perspective rotation.

Every participant of a conversation gets a rendering of it in which this speaker is the assistant and all others are users of their names;
loss masks cover what the assistant says and its end marks.  System turns belong to every rendering and are nobody's perspective.
A rendering is one text of the whole conversation, returned in pages of ``PAGE`` turns, so no task holds an unbounded conversation and a hot
one is dealt out over many tasks.  A page has its place in the rendering, and masks are places in the rendering: the pages in order, joined, are the text they index.

Defined results: turns are in the order of turn (null first), then role, then text; repeated rows are repeated turns; a null text is empty; a null role is
the speaker ``unknown``; a null conversation id is a conversation of its own; ``<|`` in texts and names becomes ``< |``, so that texts can't
forge marks; a conversation of system turns alone has no rendering; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from masar.llm.ranks import grouped_rank
from masar.llm.shared import materialize

PAGE = 256
SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"


def render(turns: list[tuple[str, str]], speaker: str, system: str = SYSTEM) -> tuple[str, list[tuple[int, int]]]:
    """The text from one speaker's view, and the spans (code points, end exclusive) that train the assistant."""
    parts, masks, at = [], [], 0
    for role, text in turns:
        role, text = role.replace("<|", "< |"), text.replace("<|", "< |")
        own = role == speaker.replace("<|", "< |")
        head = START + ("assistant\n" if own else "system\n" if role == system else f"user name={role}\n")
        if own:
            masks.append((at + len(head), at + len(head) + len(text) + len(END) - 1))
        parts.append(head + text + END)
        at += len(parts[-1])
    return "".join(parts), masks


def _shown(role: Column) -> Column:
    return F.replace(role, F.lit("<|"), F.lit("< |"))


def _starts(lengths: DataFrame) -> DataFrame:
    """(conv, perspective, page, char_start): lengths summed over the pages before, in stretches of pages first, so that no window is long."""
    part, one = ["conv", "perspective"], Window.unboundedPreceding
    cut = lengths.withColumn("stretch", F.floor(F.col("page") / PAGE))
    whole = cut.groupBy(*part, "stretch").agg(F.sum("length").alias("length"))
    before = whole.withColumn("before", F.coalesce(F.sum("length").over(Window.partitionBy(*part).orderBy("stretch").rowsBetween(one, -1)), F.lit(0)))
    within = cut.withColumn("within", F.coalesce(F.sum("length").over(Window.partitionBy(*part, "stretch").orderBy("page").rowsBetween(one, -1)), F.lit(0)))
    other = before.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("stretch").alias("s"), "before")
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("stretch") == F.col("s"))
    return within.join(other, same).select("conv", "perspective", "page", (F.col("before") + F.col("within")).cast("long").alias("char_start"))


def rotate(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", page: int = PAGE, system: str = SYSTEM) -> DataFrame:
    """conv, perspective, page, n_turns, char_start (of the page in the rendering), rendered, masks (start:end, comma-joined), masked_chars."""
    turns = conversations.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranked = materialize(grouped_rank(turns, "conv", ["turn", "role", "text"], "rank").withColumn("page", F.floor(F.col("rank") / page).cast("long")), "chat")
    blocks = materialize(ranked.groupBy("conv", "page").agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns")), "chat-pages")
    # lengths as all but the speaker see a turn, and what it differs by where the speaker's own
    head = F.when(F.col("role") == system, len(system) + 1).otherwise(F.char_length(_shown(F.col("role"))) + len("user name=") + 1)
    sizes = ranked.groupBy("conv", "page").agg(F.sum(head + F.char_length(_shown(F.col("text"))) + len(START + END)).alias("size"))
    own = ranked.filter(F.col("role") != system).groupBy("conv", "role", "page").agg(F.count("*").alias("n"))
    speakers = own.select(F.col("conv").alias("c"), F.col("role").alias("perspective")).distinct()
    seen = sizes.join(speakers, F.col("c").eqNullSafe(F.col("conv"))).select("conv", "perspective", "page", "size")
    mine = own.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("page").alias("p"), "n")
    less = F.coalesce(F.col("n"), F.lit(0)) * (len("assistant") - len("user name=") - F.char_length(_shown(F.col("perspective"))))
    lengths = seen.join(mine, F.col("c").eqNullSafe(F.col("conv")) & (F.col("r") == F.col("perspective")) & (F.col("p") == F.col("page")), "left").select("conv", "perspective", "page", (F.col("size") + less).alias("length"))
    starts = materialize(_starts(materialize(lengths, "chat-lengths")), "chat-starts").select(F.col("conv").alias("c"), "perspective", F.col("page").alias("p"), "char_start")
    views = starts.join(blocks, F.col("c").eqNullSafe(F.col("conv")) & (F.col("p") == F.col("page"))).select("conv", "perspective", "page", "char_start", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [render([(t["role"], t["text"]) for t in turns], who, system) for who, turns in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            masks = [",".join(f"{at + a}:{at + b}" for a, b in m) for at, (_, m) in zip(batch.column(3).to_pylist(), rows, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([len(t) for t in batch.column(4)], pa.int64()), batch.column(3), pa.array([r for r, _ in rows], pa.string()), pa.array(masks, pa.string()), pa.array([sum(b - a for a, b in m) for _, m in rows], pa.int64())],
                names=["conv", "perspective", "page", "n_turns", "char_start", "rendered", "masks", "masked_chars"],
            )

    kind = conversations.schema[conv].dataType.simpleString()
    return views.mapInArrow(run, f"conv {kind}, perspective string, page long, n_turns long, char_start long, rendered string, masks string, masked_chars long").withColumnRenamed("conv", conv)


def oracle() -> str:
    """DuckDB SQL for the query on ``conversations``."""
    return f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS r,
         coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
v AS (
  SELECT t.conv_id, s.perspective, r // {PAGE} AS page, r, text, role = perspective AS own,
         '{START}' || CASE WHEN role = perspective THEN 'assistant' WHEN role = '{SYSTEM}' THEN 'system' ELSE 'user name=' || replace(role, '<|', '< |') END || chr(10) AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
w AS (
  SELECT *, coalesce(sum(length(head) + length(text) + {len(END)}) OVER (PARTITION BY conv_id, perspective ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at
  FROM v)
SELECT conv_id, perspective, page, count(*) AS n_turns, CAST(min(at) AS BIGINT) AS char_start, string_agg(head || text || '{END.strip()}' || chr(10), '' ORDER BY r) AS rendered,
       coalesce(string_agg((at + length(head)) || ':' || (at + length(head) + length(text) + {len(END) - 1}), ',' ORDER BY r) FILTER (WHERE own), '') AS masks,
       CAST(coalesce(sum(length(text) + {len(END) - 1}) FILTER (WHERE own), 0) AS BIGINT) AS masked_chars
FROM w GROUP BY conv_id, perspective, page"""
