"""Chat formatting with a grammar round trip.

A turn is rendered as ``open text close`` and a line feed, the marks depending on
its role. A deterministic parser reads rendered text back. Every turn is rendered
as it is and parsed; if what comes back differs, what conflicts in it is escaped
and it is parsed again, until both are identical: a mark inside a text gets a
backslash, backslashes before a mark or at the end of a text are doubled. In
parsing, a mark after an odd number of backslashes is text.

The loss mask covers the assistants' texts. Turns are formatted in a stream
sorted by conversation and turn, so one very long conversation needs no more
memory than its longest turn.

A null text counts as empty, a null role as the empty role. A null conversation
is one of its own. Turns with the same number follow each other by role and
text; repeated rows are repeated turns; null turn numbers come first. A very long
text is rendered and parsed whole. One conversation is digested by one task, as its
hash is sequential. An empty table gives an empty result. Other columns, of whatever
name, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm.common import batched, table

#: Marks of the known roles; any other role is named in its opening mark, in hex.
OPEN = {"user": "[INST]", "assistant": "<s>", "system": "<<SYS>>"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "<</SYS>>"}
ROLE_CLOSE = "[/ROLE]"
MARK = re.compile(r"(\\*)(\[/?INST\]|</?s>|<</?SYS>>|\[ROLE=[0-9a-f]*\]|\[/ROLE\])")
ENDS = re.compile(r"\\+\Z")
LEARNT = "assistant"
#: Characters of turns that are joined before they are parsed again.
BLOCK = 1 << 20


def escape(text: str) -> str:
    text = MARK.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    return ENDS.sub(lambda m: m[0] * 2, text)


def opening(role: str) -> str:
    return OPEN.get(role) or f"[ROLE={role.encode().hex()}]"


def closing(role: str) -> str:
    return CLOSE.get(role, ROLE_CLOSE)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn; begin and end say where its escaped text stands. Raises ValueError if the grammar doesn't fit."""
    out: list[tuple[str, str, int, int]] = []
    role, begin, parts, at = None, 0, [], 0
    for m in MARK.finditer(rendered):
        slashes, mark = m[1], m[2]
        if role is None:
            if m.start() != at or slashes:
                raise ValueError("text between turns")
            known = [r for r, o in OPEN.items() if o == mark]
            if not known and not mark.startswith("[ROLE="):
                raise ValueError("a turn must open")
            role, begin, parts = (known[0] if known else bytes.fromhex(mark[6:-1]).decode()), m.end(), []
        else:
            parts.append(rendered[at : m.start()] + "\\" * (len(slashes) // 2))
            if len(slashes) % 2:
                parts.append(mark)
            elif mark != closing(role):
                raise ValueError("another mark inside a turn")
            else:
                if rendered[m.end() : m.end() + 1] != "\n":
                    raise ValueError("a turn must end its line")
                out.append((role, "".join(parts), begin, m.end() - len(mark)))
                role, at = None, m.end() + 1
                continue
        at = m.end()
    if role is not None or at != len(rendered):
        raise ValueError("a turn stays open")
    return out


def render(role: str, text: str) -> tuple[str, str, int, int]:
    """(rendered turn, text read back from it, begin, end): escaped only as far as the parser needs it."""
    for body in (text, escape(text)):
        turn = f"{opening(role)}{body}{closing(role)}\n"
        try:
            got = parse(turn)
        except ValueError:
            continue
        if len(got) == 1 and got[0][:2] == (role, text):
            return turn, got[0][1], got[0][2], got[0][3]
    raise ValueError(f"a turn of role {role!r} doesn't survive its rendering")


def ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_begin, loss_end), one row a turn: a conversation's text is the concatenation of its turns in this order. The loss mask is [loss_begin, loss_end) within the turn, null if nothing is learnt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("formatted", pa.string()), ("loss_begin", pa.int32()), ("loss_end", pa.int32())])

        def rows(b: pa.RecordBatch) -> Iterator[tuple]:
            for conv, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                rendered, _, begin, end = render(role, text)
                yield conv, turn, role, rendered, begin if role == LEARNT else None, end if role == LEARNT else None

        for b in batches:
            yield from batched(rows(b), schema, 2000)

    return ordered(conversations).mapInArrow(run, "conv_id bigint, turn bigint, role string, formatted string, loss_begin int, loss_end int")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): whole texts, for conversations that fit into a row."""
    turns = format_turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "formatted", "loss_begin", "loss_end"))).alias("t"))
    step = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.length(t["formatted"])).alias("at"),
            F.when(t["loss_begin"].isNull(), a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct((a["at"] + t["loss_begin"]).alias("begin"), (a["at"] + t["loss_end"]).alias("end"))))).alias("spans"),
        ),
    )
    return turns.select("conv_id", F.array_join(F.transform("t", lambda t: t["formatted"]), "").alias("formatted"), step["spans"].alias("loss_spans"))


def unescape(role: str, body: str) -> str:
    """What the parser reads from the body of a turn."""
    got = parse(f"{opening(role)}{body}{closing(role)}\n")
    if len(got) != 1:
        raise ValueError("more than one turn")
    return got[0][1]


def digest_turns(turns: DataFrame) -> DataFrame:
    """digests() of the rows of format_turns, which lie in their order. Turns are joined to texts of BLOCK characters or one conversation and parsed as such; what is learnt is cut from these by the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def take(state: list, held: list[str], spans: list[tuple[str, int, int]]) -> None:
            text = "".join(held)
            for role, back, _, _ in parse(text):
                state[0] += 1
                state[1].update(f"{role}\n{back}\n".encode())
            for role, begin, end in spans:
                learnt = unescape(role, text[begin:end])
                state[2] += len(learnt)
                state[3].update(learnt.encode())
            state[4] += len(text)
            held.clear()
            spans.clear()

        def rows() -> Iterator[tuple]:
            now, state, size, held, spans = None, None, 0, [], []
            for b in batches:
                for conv, role, formatted, begin, end in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "formatted", "loss_begin", "loss_end")), strict=True):
                    if state is None or conv != now:
                        if state is not None:
                            take(state, held, spans)
                            yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]
                        now, state, size = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], 0
                    elif size > BLOCK:
                        take(state, held, spans)
                        size = 0
                    if begin is not None:
                        spans.append((role, size + begin, size + end))
                    held.append(formatted)
                    size += len(formatted)
            if state is not None:
                take(state, held, spans)
                yield now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        yield from batched(rows(), schema)

    return turns.mapInArrow(run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


def digests(conversations: DataFrame) -> DataFrame:
    """What is read back from the formatted conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    return digest_turns(format_turns(conversations))


#: A conversation whose texts are the template's own marks.
ADVERSARY = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(conversations.unionByName(spark.createDataFrame(ADVERSARY, "conv_id long, turn long, role string, text string")))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, regexp_replace(regexp_replace(text, '(\\*)(\[/?INST\]|</?s>|<</?SYS>>|\[ROLE=[0-9a-f]*\]|\[/ROLE\])', '\1\1\\\2', 'g'), '(\\+)$', '\1\1') AS body,
  CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 14 + 2 * octet_length(encode(role)) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(body) + marks + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
