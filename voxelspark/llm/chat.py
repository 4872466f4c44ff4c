"""Chat formatting with typed content parts.

A turn's content is an ordered list of parts. The visitor writes text parts escaped and every other part as
the placeholder of its type, in order, and records what each placeholder stands for and how many tokens it
expands to. A turn becomes::

    <|turn|>ROLE\\n BODY <|end|>\\n        (without the spaces)

Inside roles and texts ``\\`` becomes ``\\\\`` and ``|`` becomes ``\\|`` (in roles a line feed becomes
``\\n``), so ``<|`` stands in the output only where the template put it, whatever a text holds or wherever a
part ends, and reading back is exact. The loss mask is a list of spans of the output, in characters: the text parts
of assistant turns.

The output has a row per turn. A conversation's rows are never gathered: its digests are made in one pass
over rows sorted by conversation and turn, holding one turn at a time. SHA-256 over a whole conversation
admits no other order, so one conversation is read by one task.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowconf import bound_batches

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
LEARNT = "assistant"
#: Pixels on the side of an image patch, audio frames a second, tokens a document page.
PATCH, FRAMES, PAGE = 28, 25, 512
_HEAD, _END = "<|turn|>", "<|end|>\n"


def text_part(text: Column) -> Column:
    """A content of one text part; a null text is an empty one."""
    null = F.lit(None)
    part = F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
        null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
    )
    return F.array(part)


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def _tokens(p: Column) -> Column:
    """Tokens that a part's placeholder expands to; a missing measure counts as none, at least one token each."""
    side = lambda c: F.ceil(F.coalesce(p[c], F.lit(0)) / F.lit(PATCH))
    n = (
        F.when(p["type"] == "image", side("width") * side("height"))
        .when(p["type"] == "audio", F.ceil(F.coalesce(p["seconds"], F.lit(0.0)) * FRAMES))
        .when(p["type"] == "document", F.coalesce(p["pages"], F.lit(0)) * PAGE)
    )
    return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("long")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parts) to (conv_id, turn, formatted, loss, attachments, n_tokens), a row per turn.

    parts is an array of ``PART``; types beyond text, image, audio and document are written ``<|file|>``. A null
    part list is an empty one; null roles and texts are empty. attachments lists (position among the turn's
    placeholders, type, ref, tokens). n_tokens counts the words of texts and the expanded placeholders.
    """
    parts = F.filter(F.coalesce("parts", F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    kind = lambda p: F.coalesce(p["type"], F.lit("file"))
    name = lambda p: F.when(kind(p).isin("image", "audio", "document"), kind(p)).otherwise(F.lit("file"))
    shown = lambda p: F.when(kind(p) == "text", _escaped(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), name(p), F.lit("|>")))
    words = lambda p: F.size(F.filter(F.split(F.coalesce(p["text"], F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    role = F.replace(_escaped(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\n"))
    body = F.array_join(F.transform(parts, shown), "")
    others = F.filter(parts, lambda p: kind(p) != "text")
    attached = F.transform(others, lambda p, i: F.struct(i.alias("position"), name(p).alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    count = F.aggregate(F.transform(parts, lambda p: F.when(kind(p) == "text", words(p)).otherwise(_tokens(p))), F.lit(0).cast("long"), lambda a, b: a + b)
    # places of the parts, as each starts where the one before ends
    whole = F.transform(parts, lambda p: F.struct((kind(p) == "text").alias("text"), F.length(shown(p)).alias("n")))
    start = F.struct((F.lit(len(_HEAD) + 1) + F.length(role)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(s, p):
        span = F.array(F.struct(s["at"].alias("start"), (s["at"] + p["n"]).alias("end")))
        return F.struct((s["at"] + p["n"]).alias("at"), F.when(p["text"] & (p["n"] > 0), F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate(whole, start, add)["spans"]
    return turns.select(
        "conv_id",
        "turn",
        F.concat(F.lit(_HEAD), role, F.lit("\n"), body, F.lit(_END)).alias("formatted"),
        F.when(F.coalesce("role", F.lit("")) == LEARNT, spans).otherwise(F.array().cast("array<struct<start:int,end:int>>")).alias("loss"),
        attached.alias("attachments"),
        count.alias("n_tokens"),
    )


_UNESCAPE = re.compile(r"\\(.)", re.S)
_PLACE = re.compile(r"<\|(?:image|audio|document|file)\|>")


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1], text)


def read_back(formatted: str) -> tuple[str, list[str]]:
    """(role, texts between placeholders) of a formatted turn."""
    head, _, body = formatted.removeprefix(_HEAD).removesuffix(_END).partition("\n")
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], head), [unescaped(x) for x in _PLACE.split(body)]


def _digests(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, open_, state = None, False, None

    def row():
        n, turns, chars, loss, formatted = state
        return now, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    for batch in batches:
        rows = []
        for conv, text, loss in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not open_ or conv != now:
                if open_:
                    rows.append(row())
                now, open_, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, texts = read_back(text)
            said = "".join(texts)
            state[0] += 1
            state[1].update(f"{role}\n{said}\n".encode())
            for span in loss:
                learnt = unescaped(text[span["start"] : span["end"]])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(text)
        yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
    if open_:
        yield pa.record_batch([pa.array([v], t) for v, t in zip(row(), kinds)], names)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation of :func:`format_turns`' output, read back from it; turns in order, equal ones by what they say."""
    bound_batches(formatted.sparkSession)
    rows = formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "formatted", "loss", "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted").select("conv_id", "formatted", "loss")
    return rows.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
