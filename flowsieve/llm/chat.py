"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to one text. Turn by turn the prefixes
are rendered and compared: what a longer prefix adds is the span of its last turn. A template that
changes what it said before rewrites history; that is found by the same comparison.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.session import ship_package

Turns = list[tuple[str, str]]
#: Turns that a render looks back on: all. A number bounds memory and time, and is right only for a template
#: that states that it looks back no further.
HISTORY = None

# What opens and closes a turn, and the sign that escapes them inside texts.
OPEN, COLON, CLOSE, ESCAPE = "### ", ": ", " </turn>\n", "\\"
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
SENTINEL = "\x1a"
BATCH = 1000
TURN = re.compile(r"### (.*?): (.*?) </turn>\n", re.S)


def escape(text: str) -> str:
    """Every control string gets the sign in front, the sign itself too; ``unescape`` undoes it exactly."""
    return CONTROL.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def _role(role: str) -> str:
    """Roles also must not hold the colon that ends them."""
    return role.replace("%", "%25").replace(":", "%3A")


def _unrole(role: str) -> str:
    return role.replace("%3A", ":").replace("%25", "%")


def plain_template(turns: Turns) -> str:
    return "".join(f"{OPEN}{escape(_role(r))}{COLON}{escape(t)}{CLOSE}" for r, t in turns)


def rendered(
    turns: Iterable[tuple[str, str]], template: Callable[[Turns], str] = plain_template, history: int | None = HISTORY
) -> Iterator[tuple[str, int, int, bool]]:
    """What each turn adds to the rendering, where its text lies in that, and whether history changed.

    With ``history`` None whole prefixes are rendered and compared; else the last ``history`` turns and
    the new one. If the longer rendering does not start with the shorter, the turn rewrote history and
    all of the longer one is returned. The text is located by rendering the turn with a sentinel
    instead: what stands around it must stand around the text. Where it does not, the span is empty.
    """
    past: deque = deque(maxlen=history)
    after = template([])
    for role, text in turns:
        # the last rendering was of the same turns, unless the first of them is out of sight now
        before = after if history is None or len(past) < history else template(list(past))
        after = template([*past, (role, text)])
        kept = after.startswith(before)
        base = len(before) if kept else 0
        segment = after[base:]
        probe = template([*past, (role, SENTINEL)])[base:]
        head = probe.find(SENTINEL)
        tail = len(probe) - head - len(SENTINEL)
        fits = head >= 0 and segment[:head] == probe[:head] and segment.endswith(probe[head + len(SENTINEL) :])
        yield segment, head if fits else 0, len(segment) - tail if fits else 0, not kept
        past.append((role, text))


SEGMENTS = ["conv", "seq", "segment", "loss_start", "loss_end", "rewrote"]
DIGESTS = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrote"]


def format_conversations(
    turns: DataFrame,
    *,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    template: Callable[[Turns], str] = plain_template,
    history: int | None = HISTORY,
    learned: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per turn: ``conv`` (as text), ``seq``, ``segment``, the loss mask in it, and ``rewrote``.

    The segments of a conversation in the order of ``seq`` make its formatted text. Turns are ordered by
    ``turn`` (null first), then role and text, so ties have one order and repeated rows are turns of
    their own. Null roles and texts are empty. Rows without conversation id are one conversation. Other columns are not read. The
    loss mask (code points in the segment) covers the texts of ``learned`` roles; elsewhere it is
    empty. Rows are streamed; a conversation takes the memory of ``history`` turns, and whole prefixes
    (the default) take time with the square of its turns.
    """
    ship_package(turns.sparkSession)
    cut = turns.select(
        F.col(conv).cast("string").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )

    def run(batches):
        flow = (row for b in batches for row in zip(b["conv"], b["role"], b["text"]))
        rows = []
        for c, own in groupby(flow, key=lambda row: row[0]):
            roles: deque = deque()

            def pairs(own=own, roles=roles):
                for _, r, t in own:
                    roles.append(r)
                    yield r, t

            for seq, (segment, start, end, rewrote) in enumerate(rendered(pairs(), template, history)):
                if roles.popleft() not in learned:
                    start = end = 0
                rows.append((c, seq, segment, start, end, rewrote))
                if len(rows) >= BATCH:
                    yield pd.DataFrame(rows, columns=SEGMENTS)
                    rows = []
        yield pd.DataFrame(rows, columns=SEGMENTS)

    ordered = cut.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.mapInPandas(
        run, "conv string, seq bigint, segment string, loss_start bigint, loss_end bigint, rewrote boolean"
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, read from its formatted text alone.

    ``conv``, ``n_turns``, ``turns_sha256`` (role, line end, text, line end per turn), ``loss_chars`` and
    ``loss_sha256`` (all text under the loss mask, unescaped), ``formatted_chars``, ``rewrote`` (some
    turn rewrote history). ``segments`` must be ordered by conversation and seq within partitions,
    as ``format_conversations`` returns them, and made by the plain template.
    """

    def digest(c, rows):
        everything, loss, n, chars, size, changed = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, False
        for segment, a, b, rewrote in rows:
            for role, text in TURN.findall(segment):
                n += 1
                everything.update(f"{_unrole(unescape(role))}\n{unescape(text)}\n".encode())
            masked = unescape(segment[a:b])
            chars += len(masked)
            loss.update(masked.encode())
            size += len(segment)
            changed |= bool(rewrote)
        return c, n, everything.hexdigest(), chars, loss.hexdigest(), size, changed

    def run(batches):
        names = ["segment", "loss_start", "loss_end", "rewrote"]
        flow = (row for b in batches for row in zip(b["conv"], *[b[x] for x in names]))
        rows = []
        for c, own in groupby(flow, key=lambda row: row[0]):
            rows.append(digest(c, (row[1:] for row in own)))
            if len(rows) >= BATCH:
                yield pd.DataFrame(rows, columns=DIGESTS)
                rows = []
        yield pd.DataFrame(rows, columns=DIGESTS)

    return segments.mapInPandas(
        run,
        "conv string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, rewrote boolean",
    )


#: A conversation whose texts hold the control strings.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


#: What reading back gives for table ``conversations`` and the probe, in SQL.
SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all values (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), s as (
  select *, replace(replace(r, '%', '%25'), ':', '%3A') e from t
)
select conv_id, count(*) n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn nulls first, r, x)) turns_sha256,
  coalesce(sum(len(x)) filter (r = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(x, '' order by turn nulls first, r, x) filter (r = 'assistant'), '')) loss_sha256,
  sum(15 + len(e) + len(x) + len(regexp_extract_all(e, '\\|###|</turn>')) + len(regexp_extract_all(x, '\\|###|</turn>')))::bigint formatted_chars,
  false rewrote
from s group by conv_id
"""
