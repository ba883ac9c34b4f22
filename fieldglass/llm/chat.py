"""Chat formatting: incremental rendering of turn prefixes through a black-box template, spans from consecutive outputs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

#: Strings that steer the format. In texts and roles each gets a backslash after its first character, and a backslash doubles.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TURN]", "[/TURN]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\?)")

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undoes escape(): two backslashes are one, a single one goes."""
    return _ESCAPED.sub(r"\1", text)


def template(turns: list[Turn]) -> str:
    """[TURN][ROLE]role[/ROLE]text[/TURN] for each turn; control strings inside roles and texts are escaped."""
    return "<s>" + "".join(f"[TURN][ROLE]{escape(role)}[/ROLE]{escape(text)}[/TURN]" for role, text in turns)


_TURN = re.compile(r"\[TURN\]\[ROLE\](.*?)\[/ROLE\](.*?)\[/TURN\]", re.S)


def parse(formatted: str) -> list[Turn]:
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def _common(a: str, b: str) -> int:
    """Length of the longest common start, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def locate(turns: list[Turn], render: Template = template, learn_from: str = "assistant") -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """(formatted, turn spans, loss spans, rewrote) of a conversation under a template known only by its outputs.

    Each prefix of the turns is rendered; where an output starts with the one before, what follows is the new turn's span.
    Where it doesn't, the template has rewritten history: `rewrote` is set, and the turn's span starts where the outputs part.
    Within its span, a turn's text lies between what it shares with a rendering of the same turn with another text, from both
    ends. Under a template that rewrites history, spans hold for the prefix that ends with their turn, and only the last turn
    gives loss: earlier places are no longer certain.
    """
    before, spans, loss, rewrote = render([]), [], [], False
    for k, (role, text) in enumerate(turns):
        now = render(turns[: k + 1])
        start = len(before) if now.startswith(before) else _common(before, now)
        if not now.startswith(before):
            rewrote = True
            spans, loss = [], []
        spans.append((start, len(now)))
        if role == learn_from and text:
            tail = now[start:]
            # two other texts: what both renderings share with this one belongs to the template
            a, b = (render([*turns[:k], (role, other)])[start:] for other in ("\x00", "\x01"))
            head = _common(a, b)
            foot = len(a) - head - 1
            loss.append((start + head, start + len(tail) - foot))
        before = now
    return before, spans, loss, rewrote


def format_conversations(rows: DataFrame, render: Template = template) -> DataFrame:
    """One row per conversation: conv_id, formatted, turn_starts, turn_ends, loss_starts, loss_ends, rewrote.

    Turns are ordered by number, then role and text (null first); a null text or role counts as empty; repeated rows are turns
    of their own; rows without conv_id form one conversation. No rows give no rows; other columns are not read. A conversation
    is one training text and so lies in one task; conversations are dealt by a hash of their number.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for turns in batch["turns"]:
                formatted, spans, loss, rewrote = locate([(t["role"] or "", t["text"] or "") for t in turns], render)
                out.append((formatted, [a for a, _ in spans], [b for _, b in spans], [a for a, _ in loss], [b for _, b in loss], rewrote))
            got = pd.DataFrame(out, columns=["formatted", "turn_starts", "turn_ends", "loss_starts", "loss_ends", "rewrote"])
            yield pd.concat([batch[["conv_id"]].reset_index(drop=True), got], axis=1)

    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    spans = "array<int>"
    return turns.mapInPandas(run, f"conv_id bigint, formatted string, turn_starts {spans}, turn_ends {spans}, loss_starts {spans}, loss_ends {spans}, rewrote boolean")


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are parsed again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, starts, ends in zip(batch["formatted"], batch["loss_starts"], batch["loss_ends"], strict=True):
                turns = parse(text)
                said = hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest()
                learnt = "".join(unescape(text[a:b]) for a, b in zip(starts, ends, strict=True))
                out.append((len(turns), said, len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            got = pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            yield pd.concat([batch[["conv_id", "rewrote"]].reset_index(drop=True), got], axis=1)

    return formatted.mapInPandas(run, "conv_id bigint, rewrote boolean, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: A conversation whose texts are made of control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id bigint, turn bigint, role string, text string")
    return digest(stored(format_conversations(rows.unionByName(probe)), "formatted"))


SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
f AS (SELECT *, length(text) + length(role)
    + length(text) - length(replace(text, chr(92), '')) + length(role) - length(replace(role, chr(92), ''))
    + len(regexp_extract_all(text, '<s>|</s>|\\[INST\\]|\\[/INST\\]|\\[ROLE\\]|\\[/ROLE\\]|\\[TURN\\]|\\[/TURN\\]|<<SYS>>|<</SYS>>|<\\|im_start\\|>|<\\|im_end\\|>|<\\|endoftext\\|>'))
    + length('[TURN][ROLE][/ROLE][/TURN]') AS n FROM e)
SELECT conv_id, false AS rewrote, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
