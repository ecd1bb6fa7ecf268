"""Chat formatting: multi-party perspective rotation.

Every participant of a conversation gets a rendering of the whole dialogue in
which that speaker is the assistant and all others are named users; what the
assistant says is marked by character spans to train on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import StructType

from .common import staged, table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM, UNKNOWN = "system", "unknown"
#: Turns and characters of a chunk at most (a single longer turn is a chunk of its own), and perspectives that a chunk is sent for at once.
CHUNK_TURNS, CHUNK_CHARS, CAST = 2_000, 1 << 20, 500
#: Summaries up to this many rows are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def plain(c: Column) -> Column:
    """Text that can't be taken for a control marker."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def plain_name(c: Column) -> Column:
    """A speaker's name, as plain text on one line, since it stands in a head line."""
    return F.regexp_replace(plain(c), r"[\r\n]+", " ")


def head(kind: str, speaker: str) -> str:
    return f"{OPEN}{kind}" + (f" name={speaker}" if kind == "user" else "") + "\n"


def rotate_perspectives(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per participant's perspective and turn of each conversation.

    Columns: conv_id, perspective, turn, speaker, role, segment, seg_start,
    seg_end, mask_start, mask_end. A perspective's segments, in the order of
    seg_start, are its rendering without gaps; the mask is the span that the
    assistant says, with its end marker, and null in other turns. System turns
    stay system turns and are nobody's perspective: a conversation of these
    alone has no row.

    Turns are ordered by turn, speaker and text, so ties and repeated rows have
    one order; null turns come first. A null role is a speaker of its own
    (``unknown``), a null text is empty, rows without a conversation are one
    conversation. ``<|`` in names and texts becomes ``< |``, line breaks in names
    become spaces. Extra columns are not looked at.

    Texts move once, into a range partitioning by conversation and order, where
    each conversation's turns are packed into chunks of bounded size. A chunk
    alone in its conversation renders all perspectives by itself. The chunks of
    longer conversations get where each perspective stands from their sums; one
    is sent for ``CAST`` perspectives at a time, so that a conversation may hold
    any share of the rows and any number of speakers.
    """
    speaker = plain_name(F.coalesce(F.col(role), F.lit(UNKNOWN)))
    turns = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), speaker.alias("speaker"), plain(F.col(text)).alias("content"))
    order = ("conv_id", "turn", "speaker", "content")
    types = {f.name: f.dataType.simpleString() for f in turns.schema}
    chunk = f"array<struct<turn: {types['turn']}, speaker: string, content: string>>"
    packed = f"conv_id {types['conv_id']}, part int, seq int, turns {chunk}, alone boolean, total bigint, spoken array<struct<speaker: string, less: bigint>>"

    def pack(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq, held, chars, conv_id, out, ready = TaskContext.get().partitionId(), 0, [], 0, None, [], 0

        def close(alone: bool) -> None:
            nonlocal seq, held, chars, ready
            total, less = 0, {}
            for t in held:
                kind = SYSTEM if t["speaker"] == SYSTEM else "user"
                size = len(head(kind, t["speaker"])) + len(t["content"]) + len(CLOSE) + 1
                total += size
                if kind == "user":  # what the turn is shorter by as the assistant's
                    less[t["speaker"]] = less.get(t["speaker"], 0) + len(head("user", t["speaker"])) - len(head("assistant", ""))
            out.append({"conv_id": conv_id, "part": part, "seq": seq, "turns": held, "alone": alone, "total": total, "spoken": [{"speaker": k, "less": v} for k, v in less.items()]})
            seq, held, chars, ready = seq + 1, [], 0, ready + chars

        first = whole = True  # of the task's conversations, and of the current one
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["conv_id"] != conv_id:
                    # the first conversation of a task may have begun in another one
                    close(whole and not first)
                    first, whole = False, True
                elif held and (len(held) >= CHUNK_TURNS or chars + len(row["content"]) > CHUNK_CHARS):
                    close(False)
                    whole = False
                conv_id = row.pop("conv_id")
                held.append(row)
                chars += len(row["content"])
                if len(out) >= 5_000 or ready > 4 * CHUNK_CHARS:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, ready = [], 0
        if held:
            close(False)  # the last one may go on in another task
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(packed))
    chunks = staged(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, packed), "chat")

    # Chunks that may share a conversation: the few at the ends of tasks, and those of long conversations.
    parts = chunks.where("not alone").select("conv_id", "part", "seq", "total", "spoken")
    sums = parts.select("conv_id", "part", "seq", "total")
    before = W.partitionBy("conv_id").orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("total").over(before), F.lit(0)))
    spoken = parts.select("conv_id", "part", "seq", F.explode("spoken").alias("x")).select("conv_id", "part", "seq", F.col("x.speaker").alias("perspective"), "x.less")
    cast = spoken.select(F.col("conv_id").alias("c"), "perspective").distinct()
    each = sums.join(cast, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    same = [F.col("s.conv_id").eqNullSafe(F.col("e.conv_id")), *(F.col(f"s.{k}") == F.col(f"e.{k}") for k in ("part", "seq", "perspective"))]
    each = each.alias("e").join(spoken.alias("s"), same, "left").select("e.*", "s.less")
    own = W.partitionBy("conv_id", "perspective").orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("start", F.col("base") - F.coalesce(F.sum("less").over(own), F.lit(0)))
    who = F.struct("perspective", "start")
    sent = each.withColumn("g", F.pmod(F.xxhash64("perspective"), F.ceil(F.count("*").over(W.partitionBy("part", "seq")) / CAST).cast("bigint"))).groupBy("part", "seq", "g").agg(F.collect_list(who).alias("cast"))
    sent = staged(sent.drop("g"), "chat-casts")
    if sent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        sent = F.broadcast(sent)
    alone = chunks.where("alone").select("conv_id", "turns", F.transform("spoken", lambda x: F.struct(x["speaker"].alias("perspective"), F.lit(0).cast("bigint").alias("start"))).alias("cast"))
    rest = chunks.where("not alone").join(sent, ["part", "seq"]).select("conv_id", "turns", "cast")
    result = (
        f"conv_id {types['conv_id']}, perspective string, turn {types['turn']}, speaker string, role string, segment string, seg_start bigint, seg_end bigint, mask_start bigint, mask_end bigint"
    )
    rendered = to_arrow_schema(StructType.fromDDL(result))

    def render(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            out, chars = [], 0
            for row in batch.to_pylist():
                # heads and segments of users are alike from all perspectives
                users = [head(SYSTEM if t["speaker"] == SYSTEM else "user", t["speaker"]) for t in row["turns"]]
                segments = [h + t["content"] + CLOSE + "\n" for h, t in zip(users, row["turns"])]
                mine = head("assistant", "")
                for p in row["cast"]:
                    who, at = p["perspective"], p["start"]
                    for t, user in zip(row["turns"], segments):
                        says = t["speaker"] == who
                        kind = "assistant" if says else SYSTEM if t["speaker"] == SYSTEM else "user"
                        segment = mine + t["content"] + CLOSE + "\n" if says else user
                        end = at + len(segment)
                        mask = (at + len(mine), end - 1) if says else (None, None)
                        out.append((row["conv_id"], who, t["turn"], t["speaker"], kind, segment, at, end, *mask))
                        at, chars = end, chars + len(segment)
                    if chars > 4 * CHUNK_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), rendered)], schema=rendered)
                        out, chars = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), rendered)], schema=rendered)

    return alone.union(rest).mapInArrow(render, result)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All perspectives of all ``conversations``."""
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS content FROM conversations),
cast_of AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM turns WHERE speaker <> 'system'),
seen AS (
  SELECT *, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM turns JOIN cast_of ON conv_id IS NOT DISTINCT FROM c),
heads AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM seen),
segments AS (SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM heads),
placed AS (
  SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS seg_end FROM segments)
SELECT conv_id, perspective, turn, speaker, role, segment, seg_end - length(segment) AS seg_start, seg_end,
  CASE WHEN role = 'assistant' THEN seg_end - length(segment) + length(head) END AS mask_start,
  CASE WHEN role = 'assistant' THEN seg_end - 1 END AS mask_end
FROM placed
"""
