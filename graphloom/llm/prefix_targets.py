"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, whose context is all turns
before it and whose reply alone is trainable.

A conversation is stored once, as formatted segments with running places; an example is a span of that text (its context
reaches from the start to the reply) and a loss span within it. So the expansion grows with the number of turns, not with
their square, and a conversation of any length is read as a stream.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN = re.compile(r"<turn ([^<>\n]*)>\n(.*)\n</turn>\n", re.DOTALL)


def escape(text: Column) -> Column:
    """Backslash, less-than, greater-than, number sign and line ends of roles become escapes; no control string survives in a text."""
    for plain, code in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("#", "\\h")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"\\": "\\", "l": "<", "g": ">", "h": "#", "n": "\n"}[m[1]], text, flags=re.DOTALL)


def parse_segment(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn; ValueError where it is none."""
    found = TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """Segments (conv_id, pos, role, formatted, start, target, loss_start, loss_end), one for each row.

    pos counts from 0 in order of turn (nulls first), then role and text, so ties and repeated rows have a fixed order.
    start is the place of the segment in the conversation's formatted text; for a target (a row of target_role),
    loss_start and loss_end bound its escaped reply there. Null role and text are empty; rows with a null conversation id
    form one conversation. Other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit("<turn "), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit(">\n"))
    rows = rows.withColumns({"head": F.length(head), "body": F.length(escape(F.col("text"))), "formatted": F.concat(head, escape(F.col("text")), F.lit("\n</turn>\n"))})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumns({"pos": F.row_number().over(order) - 1, "start": F.coalesce(F.sum(F.length("formatted")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    target = F.col("role") == target_role
    loss = F.col("start") + F.col("head")
    return rows.select("conv_id", F.col("pos").cast("long").alias("pos"), "role", "formatted", "start", target.alias("target"), F.when(target, loss).alias("loss_start"), F.when(target, loss + F.col("body")).alias("loss_end"))


def expand_targets(segments: DataFrame) -> DataFrame:
    """Examples (conv_id, example, target_pos, context_end, loss_start, loss_end): one for each target.

    An example's text is formatted[0:end of its target] of the conversation: its context ends at context_end.
    """
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("pos")) - 1
    return segments.where("target").select("conv_id", rank.cast("long").alias("example"), F.col("pos").alias("target_pos"), F.col("start").alias("context_end"), "loss_start", "loss_end")


def render_examples(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """(conv_id, example, context, target): the examples as text. Grows with the square of a conversation's turns, as its
    result does; for conversations that fit a row. context and target are formatted text, the reply's mark-up included."""
    parts = examples.select(F.col("conv_id").alias("c"), "example", "target_pos").join(segments, F.expr("c <=> conv_id and pos <= target_pos"))
    before = F.array_sort(F.collect_list(F.when(F.col("pos") < F.col("target_pos"), F.struct("pos", "formatted"))))
    out = parts.groupBy("conv_id", "example").agg(before.alias("parts"), F.max(F.when(F.col("pos") == F.col("target_pos"), F.col("formatted"))).alias("target"))
    return out.select("conv_id", "example", F.array_join(F.transform("parts", lambda p: p["formatted"]), "").alias("context"), "target")


def read_back(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """Per conversation, parsed from the formatted text: n_turns, turns_sha256 (role, line feed, text, line feed), loss_chars and
    loss_sha256 of all text under the loss spans (unescaped), n_examples, formatted_chars. An example is read as what it is: its context,
    the text up to context_end, must end where its reply's turn begins and hold target_pos turns, all parsed before, and the loss span
    must lie within that turn. A conversation passes one task as a stream of turns, whatever its length: its digests are sequential
    by definition."""

    def run(batches):
        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "n_examples", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        conv, state = object(), None

        def row():
            return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            rows = []
            for c, formatted, start, example, context_end, target_pos, a, b in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or c != conv:
                    if state is not None:
                        rows.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                if start != state[5]:
                    raise ValueError("segments do not join")
                role, text = parse_segment(formatted)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[5] += len(formatted)
                if example is not None:
                    if (example, target_pos, context_end) != (state[4], state[0] - 1, start) or not start <= a <= b <= state[5]:
                        raise ValueError("an example does not fit its conversation")
                    reply = unescape(formatted[a - start : b - start])
                    state[2] += len(reply)
                    state[3].update(reply.encode())
                    state[4] += 1
            if rows:
                yield batch_of(rows)
        if state is not None:
            yield batch_of([row()])

    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = ["example", "context_end", "target_pos", "loss_start", "loss_end"]
    told = examples.select(F.col("conv_id").alias("c"), *wanted)
    rows = segments.drop("loss_start", "loss_end").join(told, F.expr("c <=> conv_id and target_pos = pos"), "left").select("conv_id", "pos", "formatted", "start", *wanted)
    rows = rows.repartition(tasks, "conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "formatted", "start", *wanted)
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, n_examples long, formatted_chars long")
