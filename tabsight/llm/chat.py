"""Chat formatting: conversations as training windows of a token budget.

Every turn is formatted by a template whose control strings are escaped inside texts, and its tokens are counted. Prefix sums of these counts choose
spans of whole turns: a window holds the system turn again, a limited stretch of the turns before (both without loss) and as many new turns as the budget
takes. Only the texts of new assistant turns are under the loss mask, so each is learnt once however often it is repeated.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.lineage import written
from ..functions.ordered import CHUNK, with_chunks
from ..options import DEFAULTS, Options
from .token_counts import text_counts

BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 1024, 256, 4
SYSTEM, LEARNT = "system", "assistant"
START, END = "<|im_start|>", "<|im_end|>"
# Control strings of this template and of others in use: none of them survives inside a text.
CONTROLS = (START, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# A control string, or one that holds marks behind its first character, gets a mark more there; so marks can be taken off again.
MARK = "\\"
_ESCAPE = re.compile("|".join(f"{re.escape(c[0])}{re.escape(MARK)}*{re.escape(c[1:])}" for c in CONTROLS))
_UNESCAPE = re.compile("|".join(f"{re.escape(c[0])}{re.escape(MARK)}+{re.escape(c[1:])}" for c in CONTROLS))
_TURN = re.compile(f"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.DOTALL)

BUFFER_TURNS, BUFFER_CHARS = 4096, 4_000_000
SYSTEM_ROW, HISTORY_ROW, NEW_ROW = 0, 1, 2
WINDOW = ("conv_id long, part int, window int, text string, loss_starts array<int>, loss_ends array<int>, n_repeated int, n_turns int, n_tokens int, "
          "over_budget boolean")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + MARK + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0] + m[0][2:], text)


def escape_role(role: str) -> str:
    return escape(role.replace(MARK, MARK + MARK).replace("\n", MARK + "n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.DOTALL)


def turns_of(window: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted window's turns."""
    return [(unescape_role(role), unescape(text)) for role, text in _TURN.findall(window)]


def spans(tokens: np.ndarray, first: int, fixed: int, budget: int, history_tokens: int, history_turns: int) -> list[tuple[int, int, int]]:
    """(start of the history, start of the new turns, end) of the windows over turns with these token counts, new from ``first`` on.

    ``fixed`` tokens are in every window. History is shortened, oldest turns first, where the next new turn wouldn't fit otherwise; a turn that doesn't fit
    alone is a window without history.
    """
    total = np.concatenate(([0], np.cumsum(tokens)))
    out, at, room = [], first, budget - fixed
    while at < len(tokens):
        reach = min(history_tokens, room - int(tokens[at]))
        back = int(np.searchsorted(total[:at + 1], total[at] - reach, side="left")) if reach >= 0 else at
        back = min(max(back, at - history_turns), at)
        end = int(np.searchsorted(total, total[back] + room, side="right")) - 1
        end = max(end, at + 1)
        out.append((back, at, end))
        at = end
    return out


class Conversation:
    """Turns of one conversation (or of a part of it) that come in order; gives its windows."""

    def __init__(self, key: tuple, limits: tuple[int, int, int]):
        self.key, self.limits = key, limits
        self.system: list[tuple] = []
        self.turns: list[tuple] = []  # (formatted text, begin and end of the text in it, learnt, tokens): history, then new ones from ``first`` on
        self.first, self.window, self.chars = 0, 0, 0
        self.begun = self.own_system = False  # own_system: the system turn is new in this part's first window
        self.most_turns, self.most_chars = BUFFER_TURNS, BUFFER_CHARS

    def add(self, kind: int, role: str, turn: tuple) -> None:
        if kind == SYSTEM_ROW or not self.begun and kind == NEW_ROW and role == SYSTEM:
            self.system, self.own_system = [(*turn[:3], False, turn[4])], kind == NEW_ROW
        elif kind == HISTORY_ROW:
            self.turns.append(turn)
            self.first += 1
        else:
            self.turns.append(turn)
            self.chars += len(turn[0])
        self.begun = True

    def full(self) -> bool:
        return len(self.turns) - self.first >= self.most_turns or self.chars >= self.most_chars

    def windows(self, last: bool):
        """Windows whose end is certain; with ``last`` all that are left."""
        budget, history_tokens, history_turns = self.limits
        fixed = sum(t[4] for t in self.system)
        found = spans(np.array([t[4] for t in self.turns], dtype=np.int64), self.first, fixed, budget, history_tokens, history_turns)
        if last and not found and self.own_system and not self.window:
            found = [(0, 0, 0)]  # nothing but the system turn
        elif not last:
            found = found[:-1]
        for back, start, end in found:
            new_system = self.own_system and not self.window
            parts = [*self.system, *self.turns[back:end]]
            repeated = len(self.system) + start - back - new_system
            at, begins, ends = 0, [], []
            for i, (text, a, b, learnt, _) in enumerate(parts):
                if learnt and i >= len(self.system) + start - back:
                    begins.append(at + a)
                    ends.append(at + b)
                at += len(text)
            tokens = sum(t[4] for t in parts)
            yield (*self.key, self.window, "".join(t[0] for t in parts), begins, ends, repeated, len(parts) - repeated, tokens, tokens > budget)
            self.window += 1
        if not found:  # one window so far: what a budget takes is held in any case
            self.most_turns, self.most_chars = 2 * self.most_turns, 2 * self.most_chars
        elif not last:
            begin = found[-1][2]
            keep = max(0, begin - history_turns)
            self.turns, self.first = self.turns[keep:], begin - keep
            self.chars = sum(len(t[0]) for t in self.turns[self.first:])


def _batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [f.split()[0] for f in WINDOW.split(", ")])


def _parts(turns: DataFrame, history_turns: int, opts: Options) -> tuple[DataFrame, int]:
    """Adds the part of the order of all turns that a row lies in, so that no task gets an unbounded conversation; returns the number of parts too. A
    conversation that a border cuts has its system turn and its last turns copied into the next part; there are as few of them as borders."""
    order = ["_conv", "_turn", "_hash"]
    chunked, parts = with_chunks(turns, order, opts)
    rows = chunked.withColumn("_kind", F.lit(NEW_ROW))
    if parts == 1:
        return rows, 1
    edges = chunked.groupBy(CHUNK).agg(F.min(F.struct("_conv")).alias("first"), F.max(F.struct("_conv")).alias("last")).orderBy(CHUNK).collect()  # one row per part
    goes_on = [(b["first"]["_conv"], a[CHUNK], b[CHUNK]) for a, b in zip(edges, edges[1:]) if a["last"]["_conv"] == b["first"]["_conv"]]
    if not goes_on:
        return rows, parts
    cut = turns.sparkSession.createDataFrame(goes_on, "_cut long, _from int, _to int")
    same = F.col("_conv").eqNullSafe(F.col("_cut"))
    inside = chunked.join(F.broadcast(cut.select("_cut").distinct()), same).drop("_cut")
    place = F.struct(*order, "_role", "_text")
    head = written(inside.groupBy("_conv").agg(F.min(place).alias("_row")).where(F.col("_row._role") == SYSTEM).select("_row.*"), "chat-heads")
    behind = Window.partitionBy("_conv", CHUNK).orderBy(*[F.desc(c) for c in (*order, "_role", "_text")])  # cut inside the tasks before anything moves
    tail = inside.withColumn("_back", F.row_number().over(behind)).where(F.col("_back") <= max(1, history_turns))
    columns = [*order, "_role", "_text", F.col("_to").alias(CHUNK)]
    heads = head.join(F.broadcast(cut), same).select(*columns).withColumn("_kind", F.lit(SYSTEM_ROW))
    tails = tail.join(F.broadcast(cut), same & (F.col(CHUNK) == F.col("_from"))).select(*columns).withColumn("_kind", F.lit(HISTORY_ROW))
    system = head.select(F.col("_conv").alias("_c"), F.col("_turn").alias("_t"), F.col("_hash").alias("_h"))
    is_system = F.col("_conv").eqNullSafe(F.col("_c")) & F.col("_turn").eqNullSafe(F.col("_t")) & (F.col("_hash") == F.col("_h"))
    return rows.unionByName(heads).unionByName(tails.join(system, is_system, "left_anti")), parts


def _windows(turns: DataFrame, vocabulary: str, limits: tuple[int, int, int], opts: Options) -> tuple[DataFrame, int]:
    """Windows, and the number of parts of the order of all turns."""
    rows = turns.select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").cast("long").alias("_turn"),
                        F.coalesce(F.col("role"), F.lit("")).alias("_role"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    rows, parts = _parts(rows.withColumn("_hash", F.xxhash64("_role", "_text")), limits[2], opts)
    dealt = rows.repartition("_conv", CHUNK).sortWithinPartitions("_conv", CHUNK, "_kind", "_turn", "_hash", "_role", "_text")

    def windows(batches):
        talk, out, size = None, [], 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            formatted = [(f"{START}{escape_role(role)}\n", escape(text)) for role, text in zip(columns[3], columns[4])]
            whole = [f"{head}{text}{END}\n" for head, text in formatted]
            tokens = text_counts(whole, vocabulary)
            for conv, part, kind, role, (head, text), full, n in zip(*columns[:4], formatted, whole, tokens):
                if talk is None or talk.key != (conv, part):
                    if talk is not None:
                        out += talk.windows(True)
                    talk = Conversation((conv, part), limits)
                turn = (full, len(head), len(head) + len(text), role == LEARNT and kind == NEW_ROW, n)
                talk.add(kind, role, turn)
                size += len(full)
                if talk.full():
                    out += talk.windows(False)
                if size >= BUFFER_CHARS and out:
                    yield _batch(out)
                    out, size = [], 0
        if talk is not None:
            out += talk.windows(True)
        if out:
            yield _batch(out)

    return dealt.select("_conv", CHUNK, "_kind", "_role", "_text").mapInArrow(windows, WINDOW), parts


def format_conversations(turns: DataFrame, vocabulary: str, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
                         history_turns: int = HISTORY_TURNS, opts: Options = DEFAULTS) -> DataFrame:
    """Windows of all conversations: conv_id, part, window (ascending within a part), text, loss_starts and loss_ends (code points of ``text`` under the loss
    mask), n_repeated (leading turns that an earlier window has as new ones), n_turns (new turns), n_tokens, over_budget.

    ``turns`` has conv_id, turn, role and text; rows of a conversation come in the order of turn (null first), rows of one turn in the order of a hash of role and
    text, repeated rows are turns each. Null texts and roles count as empty. A null conv_id is a conversation of its own. The system turn is the first
    one if its role is ``system``; it is in every window, later ones are turns like others. A window is over budget only if its system turn and one new
    turn already are. Tokens are those of the formatted turns, one by one. Whole texts are kept, however long. Very long conversations are cut into parts
    of about ``opts.chunk_rows`` turns, where a window ends early. An empty table gives no windows; other columns are not read.
    A partition's windows are in the order of conv_id, part and window, and one partition has all windows of a part.
    """
    return _windows(turns, vocabulary, (budget, history_tokens, history_turns), opts)[0]


def digest(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation, read back from its windows: conv_id, n_turns, turns_sha256 (of role, newline, text, newline of each turn), loss_chars, loss_sha256 (of
    all text under the loss mask), formatted_chars and n_windows.

    A hash is made from front to back, so one task reads a conversation's windows, one at a time. ``in_order`` says that the partitions hold whole conversations with their
    windows in order already; else they are dealt by conversation and sorted.
    """
    if not in_order:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "window")

    def read(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for conv, text, starts, ends, repeated in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if state is None or conv != key:
                    if state is not None:
                        done.append(_digest_row(key, state))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                new = turns_of(text)[repeated:]
                state[0] += len(new)
                for role, own in new:
                    state[1].update(f"{role}\n{own}\n".encode())
                for a, b in zip(starts, ends):
                    learnt = unescape(text[a:b])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
                state[5] += 1
            if done:
                yield _digest_batch(done)
        if state is not None:
            yield _digest_batch([_digest_row(key, state)])

    return windows.select("conv_id", "text", "loss_starts", "loss_ends", "n_repeated").mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def conversation_digest(turns: DataFrame, vocabulary: str, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS,
                        history_turns: int = HISTORY_TURNS, opts: Options = DEFAULTS) -> DataFrame:
    """``digest`` of the windows of ``turns``. While no conversation is cut, windows are read where they were made, so texts are shuffled once."""
    windows, parts = _windows(turns, vocabulary, (budget, history_tokens, history_turns), opts)
    return digest(windows, in_order=parts == 1)


def _digest_row(key, state) -> tuple:
    return key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5]


def _digest_batch(rows: list) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
