"""Conversations as arrays of turns: normalised, extended and rendered as Catalyst expressions.

A turn is struct<role, content>, its content an array of elements struct<type, text,
text_stream, image, video>. A rendered conversation takes turns of struct<role, text>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("type", "text", "text_stream", "image", "video")
#: Fixed value: what a conversation without a system turn starts with.
DEFAULT_SYSTEM = "You are a helpful assistant."


def element(kind: str, **values: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(kind).alias("type"), *[values.get(f, none).cast("string").alias(f) for f in FIELDS[1:]])


def turn(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def _filled(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def normalised(turns: Column) -> Column:
    """Turns of known roles, a system turn first; texts from ``text`` or else ``text_stream``, images and videos as bare marks.

    A system turn keeps its texts only; empty texts and elements of other types go.
    """
    says = lambda e: F.coalesce(_filled(e["text"]), _filled(e["text_stream"]))

    def system(t):
        return F.transform(F.filter(t["content"], lambda e: (e["type"] == "text") & e["text"].isNotNull()), lambda e: element("text", text=e["text"]))

    def other(t):
        kept = F.filter(t["content"], lambda e: e["type"].isin("image", "video") | (e["type"] == "text") & says(e).isNotNull())
        return F.transform(kept, lambda e: F.when(e["type"] == "text", element("text", text=says(e))).when(e["type"] == "image", element("image")).otherwise(element("video")))

    kept = F.filter(turns, lambda t: t["role"].isin("user", "assistant", "system"))
    clean = F.transform(kept, lambda t: turn(t["role"], F.when(t["role"] == "system", system(t)).otherwise(other(t))))
    first = F.array(turn(F.lit("system"), F.array(element("text", text=F.lit(DEFAULT_SYSTEM)))))
    return F.when(F.get(turns, F.lit(0))["role"].eqNullSafe(F.lit("system")), clean).otherwise(F.concat(first, clean))


def first_video_turn(turns: Column) -> Column:
    """Place from 1 of the first user turn with a video; 0 without one."""
    return F.array_position(F.transform(turns, lambda t: (t["role"] == "user") & F.exists(t["content"], lambda e: e["type"] == "video")), F.lit(True)).cast("int")


def expand_slot(turns: Column, labels: Column) -> Column:
    """The videos of the first user turn that has any become a (label, video) pair for each of ``labels``."""
    at = first_video_turn(turns)
    pairs = F.flatten(F.transform(labels, lambda s: F.array(element("text", text=s), element("video"))))
    wide = lambda t: F.flatten(F.transform(t["content"], lambda e: F.when(e["type"] == "video", pairs).otherwise(F.array(e))))
    return F.transform(turns, lambda t, i: turn(t["role"], F.when(i + 1 == at, wide(t)).otherwise(t["content"])))


def insert_question(turns: Column, question: Column, answer: Column) -> Column:
    """A new question and answer at the first video turn; its own question and answer move behind them.

    Without a video turn the turn after the system's counts as it. A conversation
    that has no turn after it stays as it is.
    """
    fallback = F.when(F.get(turns, F.lit(0))["role"] == "system", 2).otherwise(1)
    found = first_video_turn(turns)
    at = F.when(found > 0, found).otherwise(fallback).cast("int")
    own = F.get(turns, at - 1)
    asked = F.concat(F.slice(own["content"], F.lit(1), F.greatest(F.size(own["content"]) - 1, F.lit(0))), F.array(element("text", text=question)))
    new = F.array(
        turn(own["role"], asked),
        turn(F.lit("assistant"), F.array(element("text", text=answer))),
        turn(F.lit("user"), F.array(element("text", text=F.get(own["content"], F.size(own["content"]) - 1)["text"]))),
    )
    longer = F.concat(F.slice(turns, F.lit(1), F.greatest(at - 1, F.lit(0))), new, F.slice(turns, at + 1, F.size(turns)))
    return F.when(F.size(turns) > at, longer).otherwise(turns)


def outline(turns: Column) -> Column:
    """One line: role[type:text|…] of each turn."""
    line = lambda e: F.concat(e["type"], F.lit(":"), F.coalesce(e["text"], F.lit("")))
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("["), F.array_join(F.transform(t["content"], line), "|"), F.lit("]"))), " ")


# rendered conversations; an empty text is a slot for the answer


def _joined(turns: Column, line) -> Column:
    return F.array_join(F.transform(turns, line), "")


def _said(t: Column) -> Column:
    return F.coalesce(F.length(t["text"]) > 0, F.lit(False))


def _either(i: Column, a: str, b: str) -> Column:
    return F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b))


def render_two(turns: Column, system: str, sep: str = " ", sep2: str = "</s>") -> Column:
    return F.concat(F.lit(system + sep), _joined(turns, lambda t, i: F.when(_said(t), F.concat(t["role"], F.lit(": "), t["text"], _either(i, sep, sep2))).otherwise(F.concat(t["role"], F.lit(":")))))


def render_plain(turns: Column, system: str, sep: str = "</s>", sep2: str = "</s>") -> Column:
    return F.concat(F.lit(system), _joined(turns, lambda t, i: F.when(_said(t), F.concat(t["text"], _either(i, sep, sep2))).otherwise("")))


def render_chatml(turns: Column, system: str, sep: str = "<|im_end|>") -> Column:
    start = f"{system}{sep}\n" if system else ""
    return F.concat(F.lit(start), _joined(turns, lambda t: F.concat(t["role"], F.lit("\n"), F.when(_said(t), F.concat(t["text"], F.lit(f"{sep}\n"))).otherwise(""))))


def render_llama2(turns: Column, system: str, sep: str = "<s>", sep2: str = "</s>") -> Column:
    """Even turns are instructions, the first with the system text; characters of ``sep`` at the start go."""
    head = f"<<SYS>>\n{system}\n<</SYS>>\n\n" if system else ""

    def line(t, i):
        ask = F.concat(F.lit(f"{sep}[INST] "), F.when(i == 0, F.lit(head)).otherwise(""), t["text"], F.lit(" [/INST]"))
        return F.when(~_said(t), "").when(i % 2 == 0, ask).otherwise(F.concat(F.lit(" "), t["text"], F.lit(f" {sep2}")))

    return F.ltrim(_joined(turns, line), F.lit(sep))


def render_llama3(turns: Column, system: str, sep2: str = "<|eot_id|>") -> Column:
    header = lambda role: F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"))
    start = F.concat(F.lit("<|begin_of_text|>"), F.concat(header(F.lit("system")), F.lit(f"{system}<|eot_id|>")) if system else F.lit(""))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.concat(start, _joined(turns, lambda t: F.concat(header(t["role"]), F.when(_said(t), F.concat(bare(t["text"]), F.lit(sep2))).otherwise(""))))


def render_qwen2(turns: Column, system: str) -> Column:
    """An end-of-text mark at the end of a text goes behind the turn."""
    open_, end, stop = "<|im_start|>", "<|im_end|>\n", "<|endoftext|>"
    said = lambda t: F.when(t["text"].endswith(stop), F.concat(F.replace(t["text"], F.lit(stop), F.lit("")), F.lit(end + stop))).otherwise(F.concat(t["text"], F.lit(end)))
    return F.concat(F.lit(f"{open_}system\n{system}{end}"), _joined(turns, lambda t: F.concat(F.lit(open_), t["role"], F.lit("\n"), F.when(_said(t), said(t)).otherwise(""))))


STYLES = {"two": render_two, "plain": render_plain, "chatml": render_chatml, "llama_2": render_llama2, "llama_3": render_llama3, "qwen2": render_qwen2}
