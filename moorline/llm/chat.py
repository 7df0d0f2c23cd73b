"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

A conversation is formatted once, in pieces; expand() explodes every assistant turn into an example, whose context is
all formatted text before the reply and of which only the reply is trainable. An example names its context by length
and digest instead of repeating it: contexts grow with the square of the turns, what is stored only in proportion.
contexts() writes examples out with their contexts as texts.

Reading back takes the pieces of a conversation as one text, wherever they were cut: its control strings alone part
turns. It checks each example's context against the text read so far, and takes what is trainable from the examples.

Turns are ordered by turn, then role and text; null turns come first. A null role or text is empty; rows with a null
conv_id are one conversation. Repeated rows are turns of their own. Conversations of any length stream through a task,
which holds one turn at a time: a digest of all turns in order can't be split.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import large_batches, tune

#: A turn: role and text between control strings.
TURN = "<s>{role}[INST]{text}[/INST]</s>"
BEGIN, MIDDLE, END = "<s>", "[INST]", "[/INST]</s>"
_CONTROL = re.compile(r"<(?=/?s>|</?SYS>>)|\[(?=/?INST\])")


def escape(text: str) -> str:
    """Backslashes doubled, then one put behind the first character of each control string, which ends it as such."""
    return _CONTROL.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


class Parser:
    """Parts a conversation's text into turns by its control strings; feed() takes pieces cut anywhere."""

    def __init__(self):
        self.rest, self.at, self.seen = "", 0, 0

    def feed(self, piece: str):
        """The turns that end in piece: role, text as formatted, and where that text stands in the whole."""
        # An end that lies across two pieces begins less than its length before the new one.
        self.rest, look = self.rest + piece, max(0, len(self.rest) - len(END) + 1)
        taken = 0
        while (stop := self.rest.find(END, max(look, taken))) >= 0:
            middle = self.rest.find(MIDDLE, taken, stop)
            if middle < 0 or not self.rest.startswith(BEGIN, taken):
                raise ValueError("not a formatted turn")
            start = middle + len(MIDDLE)
            yield unescape(self.rest[taken + len(BEGIN) : middle]), self.rest[start:stop], self.at + start
            taken = stop + len(END)
        self.rest, self.at = self.rest[taken:], self.at + taken

    def close(self) -> None:
        if self.rest:
            raise ValueError("the text ends within a turn")


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame) -> DataFrame:
    """The conversations' texts: conv_id, seq (from 0) and formatted, a turn each, which follow each other in one partition."""
    kind = turns.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("seq", pa.int64()), ("formatted", pa.string())])

    def rows(batches):
        now, seq = None, 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if (conv_id,) != now:
                    now, seq = (conv_id,), 0
                yield conv_id, seq, TURN.format(role=escape(role), text=escape(text))
                seq += 1

    return _ordered(turns).mapInArrow(lambda batches: large_batches(rows(batches), schema), f"conv_id {kind.simpleString()}, seq bigint, formatted string")


EXAMPLE = "struct<example:bigint,context_chars:bigint,context_sha256:string,target_end:bigint>"


def expand(formatted: DataFrame) -> DataFrame:
    """formatted with examples: of the assistant turns that end in a piece, the number (from 0), length and digest of the
    context, which is all text before the reply, and where the reply ends. The reply alone is trainable."""
    kind = formatted.schema["conv_id"].dataType
    example = pa.struct([("example", pa.int64()), ("context_chars", pa.int64()), ("context_sha256", pa.string()), ("target_end", pa.int64())])
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("seq", pa.int64()), ("formatted", pa.string()), ("examples", pa.list_(example))])

    def rows(batches):
        now, parser, context, n = None, None, None, 0
        for batch in batches:
            for conv_id, seq, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (conv_id,) != now:
                    now, parser, context, n = (conv_id,), Parser(), Context(), 0
                own = []
                context.add(piece)
                for role, text, start in parser.feed(piece):
                    if role == "assistant":
                        own.append({"example": n, "context_chars": start, "context_sha256": context.digest(start), "target_end": start + len(text)})
                        n += 1
                    context.drop(start + len(text))
                yield conv_id, seq, piece, own

    names = f"conv_id {kind.simpleString()}, seq bigint, formatted string, examples array<{EXAMPLE}>"
    return formatted.mapInArrow(lambda batches: large_batches(rows(batches), schema), names)


class Context:
    """The running digest of a conversation's text: of every prefix that ends in what isn't dropped yet."""

    def __init__(self):
        self.hash, self.at, self.rest = hashlib.sha256(), 0, ""

    def add(self, piece: str) -> None:
        self.rest += piece

    def drop(self, end: int) -> None:
        """Nothing before end will be asked for again."""
        self.hash.update(self.rest[: end - self.at].encode())
        self.rest, self.at = self.rest[end - self.at :], end

    def digest(self, end: int) -> str:
        self.drop(end)
        return self.hash.hexdigest()


def examples(expanded: DataFrame) -> DataFrame:
    """Per example: conv_id, example, context_chars, context_sha256, target_end."""
    return expanded.select("conv_id", F.explode("examples").alias("x")).select("conv_id", "x.*")


def contexts(expanded: DataFrame) -> DataFrame:
    """Examples as texts: conv_id, example, context, target. Text that many examples share is written for each."""
    own = expanded.select("conv_id", F.col("seq").alias("last"), F.explode("examples").alias("x"))
    joined = own.join(expanded.select(F.col("conv_id").alias("of"), "seq", F.col("formatted").alias("part")), F.col("of").eqNullSafe(F.col("conv_id")) & (F.col("seq") <= F.col("last")))
    whole = joined.groupBy("conv_id", "x").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "").alias("text"))
    cut = lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int"))
    return whole.select("conv_id", "x.example", cut(F.lit(0), F.col("x.context_chars")).alias("context"), cut(F.col("x.context_chars"), F.col("x.target_end")).alias("target"))


def read_back(expanded: DataFrame) -> DataFrame:
    """Per conversation, from expand's output alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples.

    What is under the loss mask comes from the examples: each must be a whole turn's text whose context is what was read before it."""
    kind = expanded.schema["conv_id"].dataType
    schema = pa.schema([("conv_id", to_arrow_type(kind)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])

    def rows(batches):
        now, own = None, None
        for batch in batches:
            for conv_id, _, piece, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (conv_id,) != now:
                    if now:
                        yield now[0], *own.result()
                    now, own = (conv_id,), Reader()
                own.read(piece, found)
        if now:
            yield now[0], *own.result()

    names = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_examples bigint"
    return expanded.mapInArrow(lambda batches: large_batches(rows(batches), schema), names)


class Reader:
    """Digests of one conversation that is read back piece by piece."""

    def __init__(self):
        self.parser, self.context = Parser(), Context()
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.chars = self.total = self.count = 0

    def read(self, piece: str, found: list[dict]) -> None:
        self.context.add(piece)
        self.total += len(piece)
        wanted = {x["context_chars"]: x for x in found}
        for role, text, start in self.parser.feed(piece):
            self.turns.update(f"{role}\n{unescape(text)}\n".encode())
            self.n += 1
            example = wanted.pop(start, None)
            if example is not None:
                if example["target_end"] != start + len(text) or example["example"] != self.count or example["context_sha256"] != self.context.digest(start):
                    raise ValueError("an example doesn't fit its conversation")
                target = unescape(text)
                self.loss.update(target.encode())
                self.chars += len(target)
                self.count += 1
            self.context.drop(start + len(text))
        if wanted:
            raise ValueError("an example isn't a turn of its conversation")

    def result(self) -> tuple:
        self.parser.close()
        return self.n, self.turns.hexdigest(), self.chars, self.loss.hexdigest(), self.total, self.count


def round_trip(turns: DataFrame) -> DataFrame:
    """All conversations formatted, expanded into examples, and read back."""
    tune(turns.sparkSession)
    return read_back(expand(format_turns(turns)))
