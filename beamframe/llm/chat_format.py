"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: a message begins, text deltas are streamed onto it, it is edited,
regenerated or removed. Events are partitioned by conversation and sorted; folding them gives the
final messages, which are rendered in turn order.

    message     a whole message of turn `turn` with `role` and `text`, after any that the turn has
    begin       opens the message with `role` and `text`, in place of what it has
    delta       appends `text` to the message
    edit        replaces the text of the message
    regenerate  starts the message again with `text`; all that later turns had by then goes
    remove      takes the message away

A turn may hold several messages; `message`, a number, tells which one an event is about, and null is
the last one of the turn.

Within a conversation events are sorted by turn, then by sequence number. Only regenerations reach
beyond their own turn, and only forwards, so the fold keeps one number from turn to turn, the latest
sequence number of a regeneration: events of later turns before it are void. A task therefore holds
the messages of one turn, however long a conversation is; the sort spills.

The template marks a turn by a line `### Role:` before its text and `</turn>` after it. Whatever
looks like a mark inside a text is escaped by a backslash before its first character, and
backslashes that stand before such a place are doubled, so `read_back` restores every text.
Roles are escaped too. The loss mask covers the texts of assistant turns. Digests are taken from what
`Reader` reads back out of the conversation's rendered string, which it gets in pieces that need not
end where turns do.

Defined cases: null texts and roles are empty; a null conversation id is a conversation of its own; a
null turn comes first and is not voided by regenerations; a null sequence number sorts first; events
of a turn with equal sequence numbers are folded in the order of message, kind, role and text; messages
that began with equal sequence numbers are rendered in the order of role and text; a delta, edit or
regeneration without a message opens one with an empty role; a null or unknown kind raises; repeated
rows are messages each; `streamed_events` numbers turns of up to 2^60, a turn beyond raises; extra columns
are ignored; an empty table gives no rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from beamframe.llm.common import small_batches

KINDS = ("message", "begin", "delta", "edit", "regenerate", "remove")
EVENTS = "conv_id bigint, seq bigint, kind string, turn bigint, message bigint, role string, text string"
PIECE = 1 << 16  # characters of a rendered string that are read at once
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
#: control strings: at the place of a match a text could be taken for a mark
_CONTROL = re.compile(r"(\\*)(###|</turn>)")
_ESCAPED = re.compile(r"(\\+)(###|</turn>)")
_TURN = re.compile(r"### ((?:[^:\\\n]|\\.)*):\n(.*?)(?<!\\)((?:\\\\)*)</turn>\n", re.S)


def escape(text: str) -> str:
    """Backslashes before a control string are doubled and one more is put before it; backslashes at
    the very end, which would meet the closing mark, are doubled as well."""
    out = _CONTROL.sub(lambda m: m[1] * 2 + "\\" + m[2], text)
    tail = len(out) - len(out.rstrip("\\"))
    return out + "\\" * tail


def unescape(text: str) -> str:
    body = text.rstrip("\\")
    tail = (len(text) - len(body)) // 2
    return _ESCAPED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], body) + "\\" * tail


def escape_role(role: str) -> str:
    return re.sub(r"[:\\]", lambda m: "\\" + m[0], role).replace("\n", "\\n").replace("###", "#\\##")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def render_turn(role: str, text: str) -> str:
    return f"### {escape_role(role)}:\n{escape(text)}</turn>\n"


def read_back(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end of the text as rendered) of each turn of a rendered string."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescape_role(m[1]), unescape(m[2] + m[3]), m.start(2), m.end(3)
        at = m.end()


class Reader:
    """Reads turns back from a rendered string that comes in pieces."""

    def __init__(self) -> None:
        self.held: list[str] = []
        self.size = 0

    def feed(self, piece: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that are complete by now."""
        self.held.append(piece)
        self.size += len(piece)
        if self.size < PIECE and not last:
            return
        joined, at = "".join(self.held), 0
        while m := _TURN.match(joined, at):
            yield unescape_role(m[1]), unescape(m[2] + m[3])
            at = m.end()
        if last and at < len(joined):
            raise ValueError(f"no turn at {at} of the last {len(joined)} characters")
        self.held, self.size = ([joined[at:]], len(joined) - at) if not last else ([], 0)


class Message:
    """One message of a turn while it is folded."""

    def __init__(self, name: int | None, begun: int | None, role: str):
        self.name, self.begun, self.role = name, begun, role
        self.parts: list[str] = []


class TurnFold:
    """Folds the events of one turn, in their order, into its messages."""

    def __init__(self) -> None:
        self.messages: list[Message] = []

    def apply(self, seq: int | None, kind: str, name: int | None, role: str | None, text: str | None) -> None:
        role, text = role or "", text or ""
        had = self.messages[-1:] if name is None else [m for m in self.messages if m.name == name][-1:]
        if kind not in KINDS:
            raise ValueError(f"unknown kind of event {kind!r}")
        if kind == "remove":
            self.messages = [m for m in self.messages if m not in had]
            return
        if kind == "message" or not had:
            had = [Message(name, seq, role if kind in ("message", "begin") else "")]
            self.messages += had
        m = had[0]
        if kind == "begin":
            m.role = role
        m.parts = [*m.parts, text] if kind == "delta" and len(m.parts) < 64 else ["".join(m.parts), text] if kind == "delta" else [text]

    def final(self) -> list[tuple[str, str]]:
        done = [(m.begun is not None, m.begun or 0, m.role, "".join(m.parts)) for m in self.messages]
        if len(done) > 1 and len({d[:2] for d in done}) < len(done):
            done.sort()
        return [d[2:] for d in done]


def _ordered(events: DataFrame) -> DataFrame:
    """Every conversation in one partition, its events by turn and sequence number."""
    rows = events.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in EVENTS.split(", ")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "message", "kind", "role", "text")


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, bool, str, str]]:
    """(conv_id, whether it is the conversation's first, role, text) of final messages."""
    at: tuple | None = None  # conversation and turn
    fold, first = TurnFold(), True
    void: int | None = None  # events of later turns before this sequence number are void
    later: int | None = None  # the same from this turn on

    for b in batches:
        for c, seq, kind, turn, name, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if (c, turn) != at:
                for said in fold.final():
                    yield at[0], first, *said
                    first = False
                fold, void = TurnFold(), later
                if at is None or c != at[0]:
                    first, void, later = True, None, None
                at = (c, turn)
            if void is not None and turn is not None and (seq is None or seq < void):
                continue
            if kind == "regenerate" and turn is not None and seq is not None:
                later = seq if later is None else max(later, seq)
            fold.apply(seq, kind, name, role, text)
    if at is not None:
        for said in fold.final():
            yield at[0], first, *said
            first = False


def events_of_turns(conversations: DataFrame) -> DataFrame:
    """A finished table (conv_id, turn, role, text) as a log: a `message` a row, in turn order."""
    turn = F.col("turn").cast("bigint")
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("seq"), F.lit("message").alias("kind"), turn.alias("turn"), F.lit(None).cast("bigint").alias("message"), "role", "text")


def streamed_events(conversations: DataFrame) -> DataFrame:
    """A finished table as the log of a chat that streamed it: an assistant's message begins as a draft, is
    regenerated and streamed in two deltas; every other message begins with its first half and
    is either streamed on or, in odd turns, opened with another text and edited. Folding the log gives the table."""
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    left, right = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    event = lambda step, kind, said: F.struct(F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("text"))
    draft = F.lit("(draft)")
    log = (
        F.when(F.col("role") == "assistant", F.array(event(0, "begin", draft), event(1, "delta", draft), event(2, "regenerate", F.lit("")), event(3, "delta", left), event(4, "delta", right)))
        .when(F.col("turn") % 2 != 0, F.array(event(0, "begin", draft), event(1, "edit", text)))
        .otherwise(F.array(event(0, "begin", left), event(1, "delta", right)))
    )
    # a row's own number tells messages of one turn apart
    rows = conversations.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("message"))
    rows = rows.select("conv_id", "turn", "role", "message", F.explode(log).alias("e"))
    return rows.select("conv_id", (F.coalesce("turn", F.lit(0)) * 8 + F.col("e.step")).alias("seq"), "e.kind", "turn", "message", F.when(F.col("e.step") == 0, F.col("role")).alias("role"), "e.text")


def format_conversations(events: DataFrame) -> DataFrame:
    """events -> conv_id, turn_no, formatted, loss_start, loss_end: a rendered row per final message.

    The formatted rows of a conversation in the order of turn_no are its string; the loss span is
    within the row, null but for assistants."""
    small_batches(events.sparkSession)
    names = ["conv_id", "turn_no", "formatted", "loss_start", "loss_end"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        rows: list[tuple] = []
        size = no = 0
        for conv, first, role, text in _messages(batches):
            no = 0 if first else no + 1
            out = render_turn(role, text)
            a, z = len(f"### {escape_role(role)}:\n"), len(out) - len("</turn>\n")
            rows.append((conv, no, out, *((a, z) if role == "assistant" else (None, None))))
            size += len(out)
            if size > 4_000_000:
                yield batch()
                rows, size = [], 0
        if rows:
            yield batch()

    return _ordered(events).mapInArrow(run, "conv_id bigint, turn_no bigint, formatted string, loss_start bigint, loss_end bigint")


def format_digests(events: DataFrame) -> DataFrame:
    """events -> per conversation the digests of what `Reader` finds in the rendered string."""
    small_batches(events.sparkSession)
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    class Digest:
        def __init__(self, conv: object):
            self.conv, self.reader = conv, Reader()
            self.n = self.loss_chars = self.chars = 0
            self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, piece: str, last: bool = False) -> None:
            self.chars += len(piece)
            for role, text in self.reader.feed(piece, last):
                self.n += 1
                self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if role == "assistant":
                    self.loss_chars += len(text)
                    self.loss.update(text.encode("utf-8", "surrogatepass"))

        def row(self) -> tuple:
            self.add("", True)
            return self.conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if "sha" in n else pa.int64()) for n, c in zip(names, zip(*done, strict=True), strict=True)], names)

        done: list[tuple] = []
        digest: Digest | None = None
        for c, first, role, text in _messages(batches):
            if first:
                if digest is not None:
                    done.append(digest.row())
                digest = Digest(c)
                if len(done) >= 20_000:
                    yield batch()
                    done = []
            digest.add(render_turn(role, text))
        if digest is not None:
            done.append(digest.row())
        if done:
            yield batch()

    return _ordered(events).mapInArrow(run, DIGESTS)


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -7: both texts hold this template's own control strings."""
    said = "\\### Assistant: </turn> ok"
    return spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
