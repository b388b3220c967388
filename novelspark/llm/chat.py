"""Chat formatting with a black-box template.

A template is any function from turns, (role, text) pairs, to one string. It is rendered on successive prefixes of a
conversation; where an output continues the one before, the difference is the newest turn's span. A probe in place of
the newest text shows which part of the span is text. A template whose longer output doesn't begin with the shorter one
rewrites history: it is reported, and a turn's span is that in the first rendering that holds the turn, from where it
parts from the one before.

A turn's prefix holds all turns before it, so a conversation costs the square of its number of turns: a template that is
a black box may rewrite history at any length, and only rendering every length shows where.

Null texts and roles count as empty; turns come in order of turn, then role, then text; repeated rows are turns of their
own; a conversation without turns doesn't exist; rows without a conversation are one, of a null conv_id. Columns besides the four are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from novelspark.llm.common import ship, small

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

#: Strings that steer a model in common chat formats, and so may not come from a text as they are.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
#: A text that begins like the first one is looked for with the second one.
PROBES = ("\x02probe\x03", "\x03probe\x02")


def escape(text: str) -> str:
    """Doubles backslashes, and puts one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: Turns) -> str:
    """The default template: <|im_start|>role, a new line, text, <|im_end|>, a new line. A role's new lines are written out, so that the first one ends it."""
    return "".join(f"<|im_start|>{_role(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


def _role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


@dataclass
class Span:
    """Where a turn stands in the output: start to end, its text from text_start to text_end."""

    start: int
    end: int
    text_start: int
    text_end: int


@dataclass
class Rendered:
    output: str
    spans: list[Span]
    rewrites: bool


def render(turns: Turns, template: Template = marked_turns) -> Rendered:
    """The whole conversation and each turn's span, from the renderings of all its prefixes."""
    spans: list[Span] = []
    before, rewrites = template([]), False
    for i, (role, text) in enumerate(turns):
        probe = PROBES[text[:1] == PROBES[0][0]]
        after, probed = template(turns[: i + 1]), template([*turns[:i], (role, probe)])
        common = len(before)
        if not after.startswith(before):
            rewrites = True
            common = _shared(before, after)
        same = common if probed.startswith(after[:common]) else 0
        # The outputs part where the probe begins, or inside it.
        at = probed.find(probe, max(0, same + _shared(after[same:], probed[same:]) - len(probe)))
        lo, hi = (max(at, common), len(after) - (len(probed) - at - len(probe))) if at >= 0 else (common, len(after))
        spans.append(Span(common, len(after), lo, max(lo, hi)))
        before = after
    return Rendered(before, spans, rewrites)


def _shared(a: str, b: str) -> int:
    """The length of the common beginning, by bisection."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def read_back(output: str) -> Turns:
    """The turns of an output of marked_turns."""
    out = []
    for part in output.split("<|im_start|>")[1:]:
        role, _, rest = part.partition("\n")
        out.append((_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role), unescape(rest.removesuffix("<|im_end|>\n"))))
    return out


FORMATTED = "conv_id bigint, formatted string, spans array<struct<start:int,end:int,text_start:int,text_end:int>>, roles array<string>, rewrites boolean"


def format_conversations(conversations: DataFrame, template: Template = marked_turns) -> DataFrame:
    """(conv_id, formatted, spans, roles, rewrites), one row a conversation. A conversation is one output, so its turns meet in one row."""
    ship(conversations.sparkSession)
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for row in batch.to_pylist():
                r = render([(t["role"], t["text"]) for t in row["turns"]], template)
                rows.append({"conv_id": row["conv_id"], "formatted": r.output, "spans": [vars(s) for s in r.spans], "roles": [t["role"] for t in row["turns"]], "rewrites": r.rewrites})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return grouped.mapInArrow(run, FORMATTED)


_SPAN = pa.struct([(n, pa.int32()) for n in ("start", "end", "text_start", "text_end")])
_ARROW = pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("spans", pa.list_(_SPAN)), ("roles", pa.list_(pa.string())), ("rewrites", pa.bool_())])


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    formatted = format_conversations(conversations.unionByName(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for row in batch.to_pylist():
                output = row["formatted"]
                turns = read_back(output)
                loss = "".join(unescape(output[s["text_start"] : s["text_end"]]) for s, (role, _) in zip(row["spans"], turns, strict=True) if role == "assistant")
                every = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append(
                    {
                        "conv_id": row["conv_id"], "n_turns": len(turns), "turns_sha256": hashlib.sha256(every.encode()).hexdigest(), "loss_chars": len(loss),
                        "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(), "formatted_chars": len(output), "rewrites": row["rewrites"],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=_READ)

    return formatted.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites boolean")


_READ = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())]
)
