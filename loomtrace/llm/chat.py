"""Chat formatting: roles of a transcript's lines by a hidden Markov model.

States say whose line it is and whether the line begins a turn. A line shows a
speaker marker or none, whether a blank line stands before it, how long it is
and how it ends. Viterbi finds the likeliest states; lines of one turn are
joined, without their markers, and rendered in the canonical form

    <|role|>
    text
    <|end|>

All probabilities come from counts over lines of labelled transcripts, smoothed by
one; the model is some hundred numbers.

``transcripts`` writes a conversations table as plain transcripts: markers in
one of several styles, dropped from some turns (``unmarked`` in 100, by a hash),
blank lines between turns. Parts of ``PART`` turns spread a very long conversation
over tasks. The chain goes on over them: each part gives the best score from every
state before it to every state at its end, a conversation's parts are folded in
order, and each is then parsed from and to the states that the best path has there.

Cases: null roles count as user; roles are lower-cased, and ones other than user,
assistant and system are read as user. Null and blank texts are empty turns and
aren't rendered; a conversation of nothing else has one row with no turns, or one a
part. A null turn comes first. A very long text is a turn like any other. A null or empty transcript has no turns.
Repeated turns stay, in order of text. An empty table gives no rows. Other columns
of conversations are not read; those of given transcripts pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.shared import added, crc_remainder, held_out, table, without, written
from loomtrace.llm.text import slices
from loomtrace.operators.ordering import row_numbers

ROLES = ("system", "user", "assistant")
#: Speaker names of each role, as transcripts have them (fixed values).
NAMES = {"system": ("system", "instructions"), "user": ("user", "human", "customer", "q"), "assistant": ("assistant", "ai", "bot", "a")}
STYLES = ("{name}: ", "[{name}] ", "### {name}\n", "**{name}:** ")
PART, UNMARKED = 64, 20
_ROLE_OF = {n: r for r, names in NAMES.items() for n in names}
_ANY = "(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + ")"
_MARKER = re.compile(rf"\s*(?:\*\*{_ANY}:\*\*|\[{_ANY}\]|#{{1,4}}\s*{_ANY}\s*:?\s*$|{_ANY}\s*:)\s*", re.IGNORECASE)

#: Emissions of a line: marker (0 none, 1 + role), blank before, question, length class; and their numbers of values.
SHAPE = (4, 2, 2, 3)
#: Turn-beginning lines are states 0 to 2, lines inside a turn 3 to 5.
N_STATES = 6
#: Where a chain comes from before its first line.
START = N_STATES
#: What is counted, by state: markers, blank lines before, shapes, the state after; and first states.
_COUNTED = {"marker": (N_STATES, 4), "blank": (N_STATES, 2), "shape": (N_STATES, 2, 3), "move": (N_STATES, N_STATES), "start": (N_STATES,)}


def marker(line: str) -> tuple[int, str]:
    """1 + the role that a line's speaker marker names (0: none), and the line without it."""
    m = _MARKER.match(line)
    return (1 + ROLES.index(_ROLE_OF[m[m.lastindex].lower()]), line[m.end() :]) if m else (0, line)


def observed(lines: list[str]) -> tuple[np.ndarray, list[int]]:
    """Emissions of the lines that aren't blank, and their places."""
    rows, places, blank = [], [], True
    for i, line in enumerate(lines):
        if not line.strip():
            blank = True
            continue
        n = len(line)
        rows.append((marker(line)[0], int(blank), int(line.rstrip().endswith("?")), 0 if n < 80 else 1 if n < 400 else 2))
        places.append(i)
        blank = False
    return np.array(rows, np.int64).reshape(-1, 4), places


def line_states(turns: list[tuple[str, str]]) -> list[int]:
    """The states of the lines of (role, text) turns that aren't blank."""
    return [ROLES.index(role) + 3 * (k > 0) for role, text in turns for k in range(sum(1 for x in text.split("\n") if x.strip()))]


def counts_of(turns: list[tuple[str, str]], first: bool) -> dict[str, np.ndarray]:
    """Counts over one transcript of labelled turns; ``first``: whether a conversation begins with it."""
    out = {k: np.zeros(v) for k, v in _COUNTED.items()}
    rows, _ = observed("\n\n".join(text for _, text in turns).split("\n"))
    states = np.array(line_states(turns), np.int64)
    if len(states):
        np.add.at(out["marker"], (states, rows[:, 0]), 1)
        np.add.at(out["blank"], (states, rows[:, 1]), 1)
        np.add.at(out["shape"], (states, rows[:, 2], rows[:, 3]), 1)
        np.add.at(out["move"], (states[:-1], states[1:]), 1)
        out["start"][states[0]] += first
    return out


def log_model(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Log start, move and emission tables from counts; what has none is as likely as one in so many."""
    share = lambda x, n: (x + 1) / (x + 1).reshape(len(x), -1).sum(1).reshape(-1, *[1] * n)
    emit = share(counts["marker"], 1)[:, :, None, None, None] * share(counts["blank"], 1)[:, None, :, None, None] * share(counts["shape"], 2)[:, None, None]
    # a line inside a turn follows a line of its role; a conversation begins with a turn
    can = np.ones((N_STATES, N_STATES), bool)
    can[:, 3:] = np.arange(N_STATES)[:, None] % 3 == np.arange(3)
    move = np.where(can, counts["move"] + 1, 0)
    start = np.where(np.arange(N_STATES) < 3, counts["start"] + 1, 0)
    with np.errstate(divide="ignore"):
        return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(1, keepdims=True)), "emit": np.log(emit)}


def _emitted(model: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    return model["emit"][:, rows[:, 0], rows[:, 1], rows[:, 2], rows[:, 3]].T


def viterbi(model: dict[str, np.ndarray], rows: np.ndarray, entry: int = START, exit: int | None = None) -> list[int]:
    """The likeliest states from the state before the rows to that of the last one, where it is given; ties go to the lower state."""
    if not len(rows):
        return []
    emitted = _emitted(model, rows)
    best, back = (model["start"] if entry == START else model["move"][entry]) + emitted[0], []
    for e in emitted[1:]:
        ways = best[:, None] + model["move"]
        back.append(ways.argmax(0))
        best = ways.max(0) + e
    states = [int(best.argmax()) if exit is None else exit]
    for b in reversed(back):
        states.append(int(b[states[-1]]))
    return states[::-1]


def transfer(model: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray | None:
    """Best scores from each state before the rows (START too) to each at their end; null without rows."""
    if not len(rows):
        return None
    emitted = _emitted(model, rows)
    best = np.concatenate([model["move"], model["start"][None]]) + emitted[0]
    for e in emitted[1:]:
        best = (best[:, :, None] + model["move"]).max(1) + e
    return best


def boundaries(transfers: list[np.ndarray | None]) -> list[tuple[int, int]]:
    """The states before and at the end of each part on the best path over all of them."""
    scores = np.append(np.full(N_STATES, -np.inf), 0.0)
    forward = []
    for m in transfers:
        forward.append(scores)
        if m is not None:
            scores = np.append((scores[:, None] + m).max(0), -np.inf)
    state, out = int(scores.argmax()), []
    for m, before in zip(reversed(transfers), reversed(forward)):
        entry = state if m is None else int((before + m[:, state]).argmax())
        out.append((entry, state))
        state = entry
    return out[::-1]


def parse(model: dict[str, np.ndarray], transcript: str | None, entry: int = START, exit: int | None = None) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript, or of a part that the best path enters and leaves in these states."""
    lines = (transcript or "").split("\n")
    rows, places = observed(lines)
    states = viterbi(model, rows, entry, exit)
    starts = [i for i, s in enumerate(states) if s < 3] or [0]
    if starts[0] != 0:
        starts.insert(0, 0)
    turns = []
    for a, b in zip(starts, [*starts[1:], len(states)]):
        if not states:
            break
        first = places[a]
        body = lines[first : places[b] if b < len(places) else len(lines)]
        if rows[a, 0]:
            body = [marker(body[0])[1], *body[1:]]
        turns.append((ROLES[states[a] % 3], "\n".join(body).strip("\n")))
    return turns


def rendered(turns: list[tuple[str, str]]) -> str:
    return "\n".join(f"<|{role}|>\n{text}\n<|end|>" for role, text in turns)


def _role():
    role = F.lower(F.trim("role"))
    return F.when(role.isin(*ROLES), role).otherwise("user")


def transcripts(conversations: DataFrame, unmarked: int = UNMARKED) -> DataFrame:
    """conv_id, part (from 0), transcript, and turns: role and text as written of those with text."""
    names = F.create_map(*[x for r in ROLES for x in (F.lit(r), F.array(*map(F.lit, (NAMES[r] * 2)[:2])))])
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES))).cast("int")
    name = F.element_at(names[F.col("role")], F.pmod(F.xxhash64("conv_id", F.lit(1)), F.lit(2)).cast("int") + 1)
    mark = F.coalesce(*[F.when(style == k, F.concat(F.lit(s.split("{name}")[0]), F.initcap(name), F.lit(s.split("{name}")[1]))) for k, s in enumerate(STYLES)])
    turns = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), _role().alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(100)) < unmarked
    turns = turns.withColumn("line", F.when(F.trim("text") != "", F.concat(F.when(bare, "").otherwise(mark), "text")))
    # a part is a stretch of the table's order, so it is bounded however many turns tie; a number tells equal rows apart
    turns = turns.withColumn("row", F.monotonically_increasing_id())
    placed = row_numbers(turns, [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "line", "role", "row")], "place")
    rows = placed.groupBy("conv_id", F.expr(f"place div {PART}").alias("stretch")).agg(F.sort_array(F.collect_list(F.struct("place", "role", "line"))).alias("turns"))
    low = rows.groupBy("conv_id").agg(F.min("stretch").alias("low")).toDF("of_conv", "low")
    rows = rows.join(low, F.col("conv_id").eqNullSafe(F.col("of_conv")))
    told = F.filter("turns", lambda x: x["line"].isNotNull())
    turns = F.transform(told, lambda x: F.struct(x["role"].alias("role"), x["line"].alias("text")))
    return rows.select("conv_id", (F.col("stretch") - F.col("low")).alias("part"), F.array_join(F.transform(told, lambda x: x["line"]), "\n\n").alias("transcript"), turns.alias("turns"))


def fit(parts: DataFrame) -> dict[str, np.ndarray]:
    """The model from labelled transcripts (part, turns: role and text as written); as many counts come to the driver as the model has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = {k: np.zeros(v) for k, v in _COUNTED.items()}
            for part, turns in zip(batch.column("part").to_pylist(), batch.column("turns").to_pylist()):
                for k, v in counts_of([(x["role"], x["text"]) for x in turns or []], part == 0).items():
                    total[k] += v
            flat = np.concatenate([v.ravel() for v in total.values()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "n"])

    found = dict(map(tuple, parts.select("part", "turns").mapInArrow(run, "at long, n double").groupBy("at").agg(F.sum("n")).collect()))
    counts, at = {}, 0
    for k, shape in _COUNTED.items():
        size = int(np.prod(shape))
        counts[k] = np.array([found.get(i, 0.0) for i in range(at, at + size)]).reshape(shape)
        at += size
    return log_model(counts)


def formatted(texts: DataFrame, model: dict[str, np.ndarray], states: bool = False) -> DataFrame:
    """The columns of ``texts`` (transcript among them), parsed_roles and chat, the canonical rendering.

    ``states``: its columns entry and exit say where the best path enters and leaves a part.
    """
    texts = without(texts, {"parsed_roles", "chat"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "transcript"):
            given = zip(batch.column("entry").to_pylist(), batch.column("exit").to_pylist()) if states else [(START, None)] * batch.num_rows
            turns = [parse(model, t, *ends) for t, ends in zip(batch.column("transcript").to_pylist(), given)]
            roles = pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, roles, pa.array([rendered(t) for t in turns], pa.string())], [*batch.schema.names, "parsed_roles", "chat"])

    return texts.mapInArrow(run, added(texts, "parsed_roles array<string>, chat string"))


def formatted_parts(parts: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """``formatted`` for parts of conversations (conv_id, part, transcript), as if each conversation were parsed whole."""

    def transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "transcript"):
            found = [transfer(model, observed((t or "").split("\n"))[0]) for t in batch.column("transcript").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array([None if m is None else m.ravel().tolist() for m in found], pa.list_(pa.float64()))], ["conv_id", "part", "scores"])

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        ends = boundaries([None if m is None else np.asarray(m, float).reshape(N_STATES + 1, N_STATES) for m in rows["scores"]])
        return pd.DataFrame({"conv_id": rows["conv_id"], "part": rows["part"], "entry": [a for a, _ in ends], "exit": [b for _, b in ends]})

    kind = parts.schema["conv_id"].dataType.simpleString()
    # one short row for PART turns, whatever their texts; a conversation of one part needs none
    several = parts.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("of_conv"))
    rows = parts.join(several, F.col("conv_id").eqNullSafe(F.col("of_conv")), "left_semi")
    scores = rows.select("conv_id", "part", "transcript").mapInArrow(transfers, f"conv_id {kind}, part long, scores array<double>")
    ends = scores.groupBy("conv_id").applyInPandas(fold, f"conv_id {kind}, part long, entry int, exit int").toDF("of_conv", "of_part", "entry", "exit")
    met = parts.join(ends, F.col("conv_id").eqNullSafe(F.col("of_conv")) & (F.col("part") == F.col("of_part")), "left").drop("of_conv", "of_part")
    met = met.withColumn("entry", F.coalesce("entry", F.lit(START)))
    return formatted(met, model, states=True).drop("entry", "exit")


def op3_hmm_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of all conversations; the model learns from those that aren't held out."""
    parts = written(transcripts(table(spark, sf_dir, "conversations")), "transcripts")
    model = fit(parts.where(F.coalesce(crc_remainder("conv_id"), F.lit(0)) != 1))
    found = formatted_parts(parts, model)
    roles = F.transform("turns", lambda x: x["role"])
    return found.select("conv_id", "part", held_out("conv_id").alias("held_out"), F.size("turns").alias("n_turns"), F.size("parsed_roles").alias("n_parsed"), F.array_join("parsed_roles", ",").alias("roles"), (roles == F.col("parsed_roles")).alias("recovered"), "chat")


QUERIES = {"op3_hmm_chat": op3_hmm_chat}
SQL: dict[str, str] = {}
