"""Chat transcripts from event logs: fold streamed deltas, edits and regenerations into messages, then render.

Template: a conversation is `<s>` and its turns; an assistant's turn is `[OUT]text</s>`, any other
`[INST]role, newline, text[/INST]`. In roles and texts `\\`, `<` and `[` become `\\\\`, `\\l` and `\\b` (a role's newline
`\\n`), so no control string can occur inside them and the format can be read back.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TURN = re.compile(r"\[INST\](.*?)\n(.*?)\[/INST\]|\[OUT\](.*?)</s>", re.S)
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
TURNS = "turns array<struct<seq: long, role: string, text: string>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans (start, length) of it that count in the loss: assistants' texts."""
    parts, spans, n = ["<s>"], [], 3
    for role, text in turns:
        if role == "assistant":
            text = escape(text)
            spans.append((n + 5, len(text)))
            parts.append(f"[OUT]{text}</s>")
        else:
            parts.append("[INST]" + escape(role).replace("\n", "\\n") + "\n" + escape(text) + "[/INST]")
        n += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    return [("assistant", unescape(m[3])) if m[3] is not None else (unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def fold_events(events: DataFrame) -> DataFrame:
    """events (conv_id, seq, message_id, event, role, text) -> messages (conv_id, seq, message_id, role, text).

    open starts a message (its seq orders the message, its role holds); delta adds text; edit puts its text in place of
    all before; regenerate drops all before. What an edit or regeneration overrides is dropped before texts are gathered.
    Defined cases: nulls in text add nothing and a null role is ''; messages without an open, or opened twice, count from
    their first event with the first role given; events of equal seq hold in the order open, regenerate, edit, delta,
    then by text; identical rows hold each; unknown events are ignored; very long texts stay whole; empty tables give no
    rows; other columns are ignored.
    """
    rank = F.when(F.col("event") == "open", 0).when(F.col("event") == "regenerate", 1).when(F.col("event") == "edit", 2).when(F.col("event") == "delta", 3)
    ev = events.select("conv_id", F.col("seq").cast("long").alias("seq"), "message_id", rank.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).where("kind is not null")
    at = F.struct("seq", "kind")
    head = ev.groupBy("conv_id", "message_id").agg(F.min("seq").alias("seq"), F.min_by("role", F.when(F.col("role").isNotNull(), at)).alias("role"), F.max(F.when(F.col("kind").isin(1, 2), at)).alias("reset"))
    h = head.select(F.col("conv_id").alias("hc"), F.col("message_id").alias("hm"), "reset")
    alive = ev.join(h, F.col("conv_id").eqNullSafe(F.col("hc")) & F.col("message_id").eqNullSafe(F.col("hm"))).where((F.col("kind") >= 2) & (F.col("reset").isNull() | (at >= F.col("reset"))))
    texts = alive.groupBy(F.col("hc"), F.col("hm")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "kind", "text"))), lambda x: x["text"]), "").alias("text"))
    return head.join(texts, F.col("conv_id").eqNullSafe(F.col("hc")) & F.col("message_id").eqNullSafe(F.col("hm")), "left").select("conv_id", "seq", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """messages (conv_id, seq, message_id, role, text) -> conv_id, formatted, loss_spans array<struct<start, length>>.

    One row per conversation, the unit of output: what gathers is its final text alone. Defined cases: messages of equal seq
    are ordered by role, text and message_id; identical rows are turns each; a null conv_id is a conversation too, null roles
    and texts are empty; a very long text stays whole; empty tables give no rows; other columns are ignored.
    """
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "message_id"))).alias("turns"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            got = [render([(t["role"] or "", t["text"] or "") for t in x.as_py()]) for x in b.column(1)]
            spans = pa.array([[{"start": s, "length": n} for s, n in x[1]] for x in got], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), spans], ["conv_id", "formatted", "loss_spans"])

    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns")).mapInArrow(run, "conv_id long, formatted string, loss_spans array<struct<start: long, length: long>>")


def event_log(conversations: DataFrame) -> DataFrame:
    """The event log that ends in the rows (conv_id, turn, role, text): a draft and its regeneration in two deltas for an
    assistant's turn, a wrong text and its edit for any other.

    A message's events are numbered from 8 times its turn, so no conversation is numbered in one task. Defined cases: rows of
    one turn, and identical rows, are messages each, in order of role and text; a null turn comes first; a null text is
    empty, a null role none; a very long text is one message; empty tables give no rows; other columns are ignored.
    """
    rows = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 59))).alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).agg(F.count(F.lit(1)).alias("n"))
    name = F.concat_ws("-", F.md5(F.concat_ws("|", F.col("turn").cast("string"), F.col("role").isNull().cast("string"), "role", "text")), F.col("i").cast("string"))
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).withColumn("message_id", name)
    half = F.floor(F.length("text") / 2).cast("int")
    event = lambda k, name, role, text: F.struct(F.lit(k).alias("k"), F.lit(name).alias("event"), role.cast("string").alias("role"), text.cast("string").alias("text"))
    none = F.lit(None)
    assistant = F.array(event(0, "open", F.col("role"), none), event(1, "delta", none, F.reverse("text")), event(2, "regenerate", none, none), event(3, "delta", none, F.col("text").substr(F.lit(1), half)), event(4, "delta", none, F.expr("substring(text, cast(floor(length(text) / 2) as int) + 1)")))
    other = F.array(event(0, "open", F.col("role"), none), event(1, "delta", none, F.concat(F.col("text"), F.lit("?"))), event(2, "edit", none, F.col("text")))
    log = rows.select("conv_id", "turn", "message_id", F.explode(F.when(F.col("role") == "assistant", assistant).otherwise(other)).alias("e"))
    return log.select("conv_id", (F.col("turn") * 8 + F.col("e.k")).alias("seq"), "message_id", "e.event", "e.role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.
    Repeated rows are read each; empty tables give no rows; other columns are ignored."""

    def run(batches):
        from hashlib import sha256

        import pyarrow as pa

        for b in batches:
            rows = []
            for c, f, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(f)
                loss = "".join(unescape(f[s["start"] : s["start"] + s["length"]]) for s in spans)
                rows.append((c, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), sha256(loss.encode()).hexdigest(), len(f)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
