"""Chat formatting: roles of raw transcripts by a hidden Markov model.

A transcript is a text whose lines belong to turns.  Some turns begin with a
speaker marker ("User:", "### Assistant", "[system]", "Speaker 1:"), others
with none, and the words of markers differ.  The hidden state of a line is its
role and whether it begins a turn.  What is seen of it is the class of its
marker, its length, whether it asks, and whether it follows an empty line.
Transitions and emissions are counted on labelled transcripts; Viterbi finds
the likeliest states, which are rendered in one canonical form.

A transcript of any length is a row for each of its pieces.  The likeliest way
through a piece from each state to each other is a small matrix; those of one
transcript are composed in a tree, from whose top the states between pieces
follow down to the pieces.  So the states are those of the whole transcript,
and no task sees all of it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trailmark.llm.common import cut, fresh, table, without

ROLES = ("system", "user", "assistant")
#: State 2 * role + 1 begins a turn, 2 * role goes on with it.
STATES = 2 * len(ROLES)
#: Words of speaker markers and what they hint at (fixed values).
NAMES = {
    "user": 1, "human": 1, "question": 1, "q": 1, "customer": 1, "client": 1,
    "assistant": 2, "ai": 2, "bot": 2, "answer": 2, "a": 2, "agent": 2, "model": 2,
    "system": 3, "instructions": 3, "context": 3,
    "speaker 1": 4, "person 1": 4,
    "speaker 2": 5, "person 2": 5,
}
#: Class of a marker whose word isn't known, such as a name.
UNKNOWN = 6
MARKER = re.compile(r"^(?:(?:#{1,6} ?|\*\*|\[|<\|?)(?P<decked>[A-Za-z]+(?: [0-9])?)(?:\*\*|\]|\|?>)?:?(?: |$)|(?P<plain>[A-Za-z]+(?: [0-9])?):(?: |$))")
#: Values of each thing seen of a line: marker class, length, question, after an empty line.
SIZES = (7, 8, 2, 2)
#: Turns of one piece of a transcript, and pieces that are composed at once.
PIECE_TURNS, FAN = 256, 256
#: Labelled pieces that fitting reads, on average; chosen by a hash of the id.
SAMPLE_PIECES = 5000
TRANSCRIPTS_AT_ONCE = 256


def marker_of(line: str) -> tuple[int, int]:
    """Class of the line's marker (0: none), and where the rest of the line begins."""
    m = MARKER.match(line)
    return (NAMES.get((m["decked"] or m["plain"]).lower(), UNKNOWN), m.end()) if m else (0, 0)


def see(lines: list[str], blank: bool = False) -> np.ndarray:
    """What is seen of each line; ``blank`` says whether the line before the first one is empty."""
    out = np.zeros((len(lines), len(SIZES)), np.int64)
    for i, line in enumerate(lines):
        kind, at = marker_of(line)
        rest = line[at:].strip()
        out[i] = kind, min(7, len(rest).bit_length()), rest.endswith("?"), blank
        blank = not line.strip()
    return out


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        log = lambda x, axis: np.log((x + 0.1) / (x + 0.1).sum(axis=axis, keepdims=True))
        self.start, self.move, self.emit = log(start, 0), log(move, 1), [log(e, 1) for e in emit]
        # no transcript goes on with a turn that hasn't begun, and a turn goes on in its own role
        self.start[0::2] = -np.inf
        for s in range(STATES):
            self.move[s, [t for t in range(0, STATES, 2) if t // 2 != s // 2]] = -np.inf

    def _scores(self, seen: np.ndarray) -> np.ndarray:
        return sum(e[:, seen[:, k]].T for k, e in enumerate(self.emit))

    def matrix(self, seen: np.ndarray, first: bool) -> np.ndarray:
        """[a, b]: score of the likeliest way through a piece to state b, if the line before it has state a; the first piece has none before."""
        scores = self._scores(seen)
        best = (np.tile(self.start, (STATES, 1)) if first else self.move) + scores[0]
        for s in scores[1:]:
            best = (best[:, :, None] + self.move).max(axis=1) + s
        return best

    def viterbi(self, seen: list[np.ndarray], entry: list[int | None] | None = None, leave: list[int | None] | None = None) -> list[np.ndarray]:
        """The likeliest states of each transcript or piece, all of which move on together.

        ``entry`` is the state of the line before, ``leave`` that of the last line, where they are known.
        """
        entry, leave = ([None] * len(seen) if x is None else x for x in (entry, leave))
        order = sorted(range(len(seen)), key=lambda i: -len(seen[i]))
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seen)
        for at in range(0, len(order), TRANSCRIPTS_AT_ONCE):
            some = [i for i in order[at : at + TRANSCRIPTS_AT_ONCE] if len(seen[i])]
            if not some:
                continue
            size = np.array([len(seen[i]) for i in some])
            scores = [self._scores(seen[i]) for i in some]
            best = np.stack([(self.start if entry[i] is None else self.move[entry[i]]) + s[0] for i, s in zip(some, scores, strict=True)])
            back = []
            for t in range(1, size[0]):
                n = int(np.searchsorted(-size, -t, side="left"))  # longer ones come first
                ways = best[:n, :, None] + self.move
                back.append(ways.argmax(axis=1).astype(np.int8))
                best[:n] = ways.max(axis=1) + np.stack([s[t] for s in scores[:n]])
            for r, i in enumerate(some):
                states = np.zeros(size[r], np.int64)
                states[-1] = best[r].argmax() if leave[i] is None else leave[i]
                for t in range(size[r] - 1, 0, -1):
                    states[t - 1] = back[t - 1][r, states[t]]
                out[i] = states
        return out


def compose(matrices: np.ndarray) -> np.ndarray:
    """The matrix of pieces in a row."""
    total = matrices[0]
    for m in matrices[1:]:
        total = (total[:, :, None] + m).max(axis=1)
    return total


def between(matrices: np.ndarray, entry: int, leave: int) -> list[tuple[int, int]]:
    """(state before, last state) of each of the pieces in a row, of which the first comes after ``entry`` and the last ends in ``leave``."""
    best, back = matrices[0][entry], []
    for m in matrices[1:]:
        ways = best[:, None] + m
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0)
    ends = [leave]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.append(entry)
    ends.reverse()
    return [*zip(ends[:-1], ends[1:], strict=True)]


def render(lines: list[str], states: np.ndarray) -> tuple[list[tuple[str, str]], str]:
    """Turns (role, text) of a decoded transcript or piece, and their canonical text.

    The marker of a line that begins a turn goes; empty lines around a turn go
    as well.  A piece that begins within a turn begins with a turn of that role.
    """
    turns: list[tuple[str, list[str]]] = []
    for line, state in zip(lines, states, strict=True):
        if state % 2:
            turns.append((ROLES[state // 2], [line[marker_of(line)[1] :]]))
        elif turns:
            turns[-1][1].append(line)
        else:
            turns.append((ROLES[state // 2], [line]))
    clean = [(role, "\n".join(x).strip()) for role, x in turns]
    return clean, "".join(f"<|{role}|>\n{text}\n<|end|>\n" for role, text in clean)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of each row among those of its conversation, of rows in order of it."""
    last, seen = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.column("conv_id")
        code = own.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(np.diff(code, prepend=-1))
        size = np.diff(np.append(begin, len(code)))
        place = np.arange(len(code)) - np.repeat(begin, size)
        if own[0].as_py() == last:
            place[: size[0]] += seen
        last, seen = own[-1].as_py(), int(place[-1]) + 1
        yield pa.record_batch([*batch.columns, pa.array(place, pa.int64())], names=[*batch.schema.names, "place"])


def ranked_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, role, text) from (conv_id, turn, role, text): turns numbered from 0 in each conversation, in order of turn, role and text.

    Rows are sorted over all partitions, numbered within each, and the numbers
    of a conversation that lies in several are shifted; at most one such begins
    in each partition, so their table is as short as the list of partitions.
    A null turn comes last, a null text is empty, a null or unknown role is
    ``user``; repeated rows are turns of their own.
    """
    rows = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit((1 << 63) - 1)).alias("turn"), F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user").alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "turn", "role", "text", "tie"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", F.spark_partition_id().alias("part"))
    kind = conversations.schema["conv_id"].dataType.simpleString()
    placed = cut(dealt.mapInArrow(_places, f"conv_id {kind}, role string, text string, part int, place long"))
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    wide = sizes.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts")).where(F.size("parts") > 1)
    before = F.transform("parts", lambda p, i: F.struct(p["part"].alias("part"), F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("shift")))
    shifts = wide.select("conv_id", F.explode(before).alias("s")).select(F.col("conv_id").alias("c"), F.col("s.part").alias("p"), "s.shift")
    found = placed.join(F.broadcast(shifts), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p")), "left")
    return found.select("conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("rank"), "role", "text")


def pieces(turns: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """(conv_id, piece, turns) of :func:`ranked_turns`: ``piece_turns`` turns in order as array<struct<rank, role, text>>."""
    piece = F.floor(F.col("rank") / piece_turns).cast("long").alias("piece")
    return turns.groupBy("conv_id", piece).agg(F.array_sort(F.collect_list(F.struct("rank", "role", "text"))).alias("turns"))


#: How raw transcripts mark their speakers: system, user, assistant.
STYLES = (
    ("System: {}", "User: {}", "Assistant: {}"),
    ("Context: {}", "Human: {}", "AI: {}"),
    ("### System\n{}", "### User\n{}", "### Assistant\n{}"),
    ("[system] {}", "Q: {}", "A: {}"),
    ("<|system|> {}", "<|user|> {}", "<|assistant|> {}"),
    ("Instructions: {}", "Speaker 1: {}", "Speaker 2: {}"),
    ("Setup: {}", "Alice: {}", "Robert: {}"),
)
#: Styles of held-out transcripts only, so that none of their words is learnt.
NEW_STYLES = (
    ("Background: {}", "Maria: {}", "Jonas: {}"),
    ("## Rules\n{}", "**Visitor** {}", "**Clerk** {}"),
)
#: Of a hundred turns after the first, so many lack their marker.
UNMARKED = 10


def style_of(conv_id: str) -> int:
    """The number of the style of a conversation; that of a new one only if it is held out."""
    h = zlib.crc32(conv_id.encode())
    return h // 3 % (len(STYLES) + len(NEW_STYLES) * (h % 3 == 1))


def raw_transcript(conv_id: str, turns: list[tuple[str, str]], first: int = 0) -> tuple[list[str], list[int]]:
    """Lines of a raw transcript, or of a piece from turn ``first`` on, of (role, text) turns and their states; style and gaps follow from the id."""
    style = (*STYLES, *NEW_STYLES)[style_of(conv_id)]
    lines, states = [], []
    for i, (role, text) in enumerate(turns, first):
        k = ROLES.index(role)
        bare = i > 0 and zlib.crc32(f"{conv_id}/{i}".encode()) % 100 < UNMARKED
        own = (text if bare else style[k].format(text)).split("\n")
        lines += own
        states += [2 * k + 1, *[2 * k] * (len(own) - 1)]
        if zlib.crc32(f"{conv_id}|{i}".encode()) % 3 == 0:
            lines.append("")
            states.append(2 * k)
    return lines, states


def raw_transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, text, states, new_style) of :func:`pieces`: raw transcripts and the truth about their lines."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ["" if c is None else str(c) for c in batch.column("conv_id").to_pylist()]
            made = [raw_transcript(c, [(t["role"], t["text"]) for t in x], x[0]["rank"]) for c, x in zip(ids, batch.column("turns").to_pylist(), strict=True)]
            new = [style_of(c) >= len(STYLES) for c in ids]
            yield pa.record_batch([batch.column("conv_id"), batch.column("piece"), pa.array(["\n".join(x) for x, _ in made], pa.string()), pa.array([s for _, s in made], pa.list_(pa.int32())), pa.array(new)], names=["conv_id", "piece", "text", "states", "new_style"])

    return turns.mapInArrow(run, f"conv_id {kind}, piece long, text string, states array<int>, new_style boolean")


def held_out(conv_id: Column) -> Column:
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(labelled: DataFrame, sample: int = SAMPLE_PIECES) -> Model:
    """A model from about ``sample`` rows of (conv_id, piece, text, states); tasks return tables of counts of fixed size."""
    width = STATES + STATES * STATES + STATES * sum(SIZES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for piece, text, states in zip(*(batch.column(c).to_pylist() for c in ("piece", "text", "states")), strict=True):
                s, seen = np.array(states, np.int64), see(text.split("\n"))
                if not len(s):
                    continue
                if piece == 0:
                    total[s[0]] += 1
                np.add.at(total, STATES + s[:-1] * STATES + s[1:], 1)
                at = STATES + STATES * STATES
                for k, size in enumerate(SIZES):
                    np.add.at(total, at + s * size + seen[:, k], 1)
                    at += STATES * size
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])

    share = min(1.0, sample / max(1, labelled.count()))
    some = labelled.where(F.pmod(F.xxhash64("conv_id", "piece"), F.lit(1 << 20)) < int(share * (1 << 20))).select("piece", "text", "states")
    total = np.zeros(width)
    for r in some.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    start, rest = total[:STATES], total[STATES:]
    move, rest = rest[: STATES * STATES].reshape(STATES, STATES), rest[STATES * STATES :]
    emit = []
    for size in SIZES:
        emit.append(rest[: STATES * size].reshape(STATES, size))
        rest = rest[STATES * size :]
    return Model(start, move, emit)


def _per_row(docs: DataFrame, fields: str, make):
    """``docs``, a row at a time, as tables of ``fields``; ``make`` gets a row as a dict and returns rows."""
    schema = to_arrow_schema(T.DataType.fromDDL(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [out for row in batch.to_pylist() for out in make(row)]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return docs.mapInArrow(run, fields)


def _states_between(rows: DataFrame, model: Model, last: int, fan: int) -> DataFrame:
    """(id, piece, entry, leave) of the transcripts of several pieces: states before a piece, and of its last line.

    ``rows`` has (id, piece, after_blank, text) of those, with pieces from 0 to at most ``last``.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["id"].dataType.simpleString()
    fields = f"id {kind}, at long, m array<double>"
    lines = lambda r: see((r["text"] or "").split("\n"), bool(r["after_blank"]))
    level = cut(_per_row(rows.select("id", "piece", "after_blank", "text"), fields, lambda r: [(r["id"], r["piece"], shipped.value.matrix(lines(r), r["piece"] == 0).ravel().tolist())]))
    read = lambda r: np.array([x["m"] for x in r["below"]]).reshape(-1, STATES, STATES)
    levels = []
    while last > 0:
        last //= fan
        grouped = level.groupBy("id", F.floor(F.col("at") / fan).cast("long").alias("above")).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("below"))
        levels.append(grouped)
        level = cut(_per_row(grouped, fields, lambda r: [(r["id"], r["above"], compose(read(r)).ravel().tolist())]))
    known = _per_row(level, f"id {kind}, at long, entry int, leave int", lambda r: [(r["id"], r["at"], 0, int(np.argmax(r["m"][:STATES])))])
    for grouped in reversed(levels):
        both = grouped.join(known.select(F.col("id").alias("i"), "at", "entry", "leave"), F.col("id").eqNullSafe(F.col("i")) & (F.col("above") == F.col("at"))).drop("i", "at")
        known = _per_row(both, f"id {kind}, at long, entry int, leave int", lambda r: [(r["id"], x["at"], a, b) for x, (a, b) in zip(r["below"], between(read(r), r["entry"], r["leave"]), strict=True)])
    return known.select("id", F.col("at").alias("piece"), F.when(F.col("at") > 0, F.col("entry")).alias("entry"), "leave")


def parse_transcripts(docs: DataFrame, model: Model, text_col: str = "text", id_col: str | None = None, piece_col: str | None = None, fan: int = FAN) -> DataFrame:
    """``docs`` with ``_states`` (of each line), ``_turns`` array<struct<role, text>> and ``_rendered``.

    A null or empty text is one empty line; it is a turn without text.  Rows are
    transcripts of their own, parsed one by one, repeated ones alike, whole
    texts however long, unless ``id_col`` and ``piece_col`` say which rows are
    pieces 0, 1, 2, ... of one transcript; then states are those of the whole
    one (of repeated rows of a piece, any stands for it).  An empty table stays empty.  Other columns stay, whatever their names,
    but for the three added, which are replaced.
    """
    docs = without(docs, "_states", "_turns", "_rendered")
    blank, entry, leave = fresh(docs, "after_blank", "entry", "leave")
    none = F.lit(None).cast("int")
    rows = docs.select("*", F.lit(False).alias(blank), none.alias(entry), none.alias(leave))
    if id_col is not None:
        bare = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{piece_col}`").cast("long").alias("piece"), F.col(f"`{text_col}`").alias("text"))
        last = bare.agg(F.max("piece")).first()[0] or 0
        if last > 0:
            wide = bare.where("piece > 0").select(F.col("id").alias("w")).distinct()
            more = bare.join(wide, F.col("id").eqNullSafe(F.col("w")), "left_semi").dropDuplicates(["id", "piece"])
            # a piece after one that ends with an empty line
            ends = more.select(F.col("id").alias("i"), (F.col("piece") + 1).alias("p"), F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)(?:^|\n)[\s\x1c-\x1f]*\z").alias("after_blank"))
            more = more.join(ends, F.col("id").eqNullSafe(F.col("i")) & (F.col("piece") == F.col("p")), "left").select("id", "piece", "text", F.coalesce("after_blank", F.lit(False)).alias("after_blank"))
            states = _states_between(more, model, last, fan).join(more.select(F.col("id").alias("i"), F.col("piece").alias("p"), "after_blank"), F.col("id").eqNullSafe(F.col("i")) & (F.col("piece") == F.col("p")))
            states = cut(states.select(F.col("i").alias("state_id"), F.col("p").alias("state_piece"), F.col("after_blank").alias("state_blank"), F.col("entry").alias("state_entry"), F.col("leave").alias("state_leave")))
            on = F.col(f"`{id_col}`").eqNullSafe(F.col("state_id")) & (F.col(f"`{piece_col}`") == F.col("state_piece"))
            rows = docs.join(states, on, "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce("state_blank", F.lit(False)).alias(blank), F.col("state_entry").alias(entry), F.col("state_leave").alias(leave))
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [(t.as_py() or "").split("\n") for t in batch.column(at)]
            after, before, end = (c.to_pylist() for c in batch.columns[-3:])
            states = shipped.value.viterbi([see(x, b) for x, b in zip(lines, after, strict=True)], before, end)
            made = [render(x, s) for x, s in zip(lines, states, strict=True)]
            turns = pa.array([[{"role": r, "text": t} for r, t in m[0]] for m in made], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.record_batch([*batch.columns[:-3], pa.array([s.tolist() for s in states], pa.list_(pa.int32())), turns, pa.array([m[1] for m in made], pa.string())], names=[*batch.schema.names[:-3], "_states", "_turns", "_rendered"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return rows.mapInArrow(run, f"{fields}, _states array<int>, _turns array<struct<role: string, text: string>>, _rendered string")


def op8_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every piece of PIECE_TURNS turns of a conversation; nearly all conversations have one."""
    raw = cut(raw_transcripts(pieces(ranked_turns(table(spark, sf_dir, "conversations")))))
    model = fit(raw.where(~held_out(F.col("conv_id"))))
    parsed = parse_transcripts(raw, model, id_col="conv_id", piece_col="piece")
    right = F.size(F.filter(F.zip_with("states", "_states", lambda a, b: F.floor(a / 2) == F.floor(b / 2)), lambda x: x))
    return parsed.select(
        "conv_id",
        "piece",
        held_out(F.col("conv_id")).alias("held_out"),
        "new_style",
        F.size("states").cast("long").alias("n_lines"),
        right.cast("long").alias("n_lines_right"),
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: t["role"]), ",").alias("roles"),
        F.col("_rendered").alias("rendered"),
    )
