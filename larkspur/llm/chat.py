"""Chat formatting: roles recovered from transcripts by a hidden Markov model, then canonical turns.

The states are roles. A turn is observed through its speaker marker (a leading `User:`, `### Assistant`, `<|system|>` and
the like, or none), the size of its text, whether it asks, how many lines it has, and whether the conversation begins
with it. Start, transition and emission probabilities are smoothed counts over labelled turns; the marker's emissions are
counts too, on top of prior counts by which a marker that names a role speaks for it until the turns say otherwise. A
conversation is held out or learned from as a whole. Viterbi's best path gives the roles, and each turn is rendered in one
canonical form.

Viterbi is run in chunks, so that a conversation of any length is spread over many tasks: every chunk gives the matrix of
its best scores from each state before it to each state at its end, the matrices of a conversation are chained, which
fixes the states at the chunks' borders, and every chunk is then solved between its borders. The result equals Viterbi
over the whole conversation.

Defined results: null text counts as empty; turns are ordered by turn number (null first) and then by text; turns with a
null conversation form one conversation; rows repeated in full are separate turns; an empty table gives an empty result;
with nothing to learn from the probabilities are even.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import materialise, prefix_ranks

ROLES = ("system", "user", "assistant")
CHUNK = 256
#: Ids of conversations with markers that may be broadcast, and the lots in which more of them meet their turns.
BROADCAST_CONVERSATIONS = 200_000
LOTS = 16
#: Names of speakers in markers, by role.
MARKERS = {
    "system": "system|instructions?|context",
    "user": "user|human|you|question|q|customer|prompter|me",
    "assistant": "assistant|bot|ai|answer|a|model|agent|gpt|response",
}
_MARKER = r"(?i)^\s*(?:#{1,6}\s*|\*\*|\[|<\|?(?:im_start\|>)?)?(%s)(?:\s*(?:\|?>|\]|\*\*)\s*:?|\s*:|\s*\n)\s*"
#: Prior counts of a role's turns without a marker, and with its own; other markers have half a count.
MARKER_PRIOR = 50.0
FEATURES = {"marker": 4, "size": 14, "asks": 2, "lines": 4, "first": 2}


def marker(text: Column) -> Column:
    """0 for no marker, else the role's number from 1."""
    found = F.lit(0)
    for i, role in enumerate(ROLES, 1):
        found = F.when(text.rlike(_MARKER % MARKERS[role]), i).otherwise(found)
    return found


def without_marker(text: Column) -> Column:
    return F.regexp_replace(text, _MARKER % "|".join(MARKERS.values()), "")


def observed(turns: DataFrame) -> DataFrame:
    """turns (conv_id, pos, text) with the observed features as small integers."""
    t = F.col("text")
    return turns.withColumns({
        "marker": marker(t),
        "size": F.least(F.lit(13), F.floor(F.log2(F.length(t) + F.lit(1.0)))).cast("int"),
        "asks": t.rlike(r"\?\s*$").cast("int"),
        "lines": F.least(F.lit(3), F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit("")))).cast("int"),
        "first": (F.col("pos") == 0).cast("int"),
    })


class RoleModel:
    """Log probabilities of start, transition and each feature."""

    def __init__(self, starts: dict[str, int], steps: dict[tuple[str, str], int], seen: dict[tuple[str, str, int], int]):
        n = len(ROLES)
        start, step = np.ones(n), np.ones((n, n))
        for r, c in starts.items():
            start[ROLES.index(r)] += c
        for (a, b), c in steps.items():
            step[ROLES.index(a), ROLES.index(b)] += c
        self.start, self.step = np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True))
        self.emit = {}
        for f, size in FEATURES.items():
            table = np.ones((size, n))
            if f == "marker":
                table[0] = MARKER_PRIOR
                table[1:] = np.where(np.eye(n) > 0, MARKER_PRIOR, 0.5)
            for (name, role, value), c in seen.items():
                if name == f:
                    table[value, ROLES.index(role)] += c
            self.emit[f] = np.log(table / table.sum(0))

    def scores(self, features: dict[str, np.ndarray]) -> np.ndarray:
        return sum(self.emit[f][features[f]] for f in FEATURES)


def chunk_matrix(model: RoleModel, e: np.ndarray) -> np.ndarray:
    """Best score from each state before the chunk to each state at its end."""
    m = model.step + e[0]
    for row in e[1:]:
        m = (m[:, :, None] + model.step[None]).max(1) + row
    return m


def best_path(model: RoleModel, e: np.ndarray, entry: int | None, leave: int | None) -> np.ndarray:
    """Viterbi over emissions e between a fixed state before (None: the start) and a fixed last state (None: free)."""
    v = (model.start if entry is None else model.step[entry]) + e[0]
    back = np.zeros((len(e), e.shape[1]), np.int64)
    for i, row in enumerate(e[1:], 1):
        w = v[:, None] + model.step
        back[i] = w.argmax(0)
        v = w.max(0) + row
    path = np.zeros(len(e), np.int64)
    path[-1] = v.argmax() if leave is None else leave
    for i in range(len(e) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def chain(model: RoleModel, chunks: list[np.ndarray], opening: np.ndarray) -> list[tuple[int | None, int]]:
    """(state before, last state) of each chunk on the best path; opening: best score of ending chunk 0 in each state."""
    forward = [opening]
    for m in chunks[1:]:
        forward.append((forward[-1][:, None] + m).max(0))
    borders: list[tuple[int | None, int]] = []
    last = int(forward[-1].argmax())
    for i in range(len(chunks) - 1, 0, -1):
        entry = int((forward[i - 1] + chunks[i][:, last]).argmax())
        borders.append((entry, last))
        last = entry
    return [*reversed([*borders, (None, last)])]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, across batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [i for i in range(len(rows)) if i == 0 and rows[0] != key or i and rows[i] != rows[i - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            if lo in cuts and held:
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(batch.slice(lo, hi - lo))
        key = rows[-1]
    if held:
        yield pa.Table.from_batches(held)


def _emissions(model: RoleModel, t: pa.Table) -> np.ndarray:
    return model.scores({f: t.column(f).to_numpy() for f in FEATURES})


def recover_roles(turns: DataFrame, model: RoleModel) -> DataFrame:
    """turns (conv_id, pos, features, ...) with role_pred, by Viterbi over whole conversations."""
    order = ["conv_id", "chunk", "pos"]
    chunked = turns.withColumn("chunk", F.floor(F.col("pos") / CHUNK).cast("long"))
    features = list(FEATURES)
    narrow = chunked.select(*order, *features).repartition("conv_id", "chunk").sortWithinPartitions(*order)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["conv_id", "chunk"]):
            e, chunk = _emissions(model, t), t.column("chunk")[0].as_py()
            m = chunk_matrix(model, e)
            if chunk == 0:
                m = np.tile(chunk_matrix_from_start(model, e), (len(ROLES), 1))
            yield pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks().slice(0, 1), pa.array([chunk]), pa.array([m.ravel().tolist()])], ["conv_id", "chunk", "matrix"])

    long_ones = chunked.where("chunk > 0").select(F.col("conv_id").alias("long_id")).distinct()
    several = narrow.join(long_ones, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi").repartition("conv_id", "chunk").sortWithinPartitions(*order)
    table = several.mapInArrow(matrices, f"conv_id {kind}, chunk long, matrix array<double>")

    def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(ROLES)
        for t in _groups(batches, ["conv_id"]):
            ms = [np.array(x).reshape(n, n) for x in t.column("matrix").to_pylist()]
            states = chain(model, ms, ms[0][0])
            yield pa.RecordBatch.from_arrays([t.column("conv_id").combine_chunks(), t.column("chunk").combine_chunks(), pa.array([a for a, _ in states], pa.int64()), pa.array([b for _, b in states], pa.int64())], ["conv_id", "chunk", "entry", "leave"])

    # A row per chunk of the long conversations.
    fixed = table.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(borders, f"conv_id {kind}, chunk long, entry long, leave long")
    fixed = fixed.select(F.col("conv_id").alias("conv__k"), F.col("chunk").alias("chunk__k"), "entry", "leave")
    ready = chunked.join(fixed, F.col("conv_id").eqNullSafe(F.col("conv__k")) & (F.col("chunk") == F.col("chunk__k")), "left").drop("conv__k", "chunk__k")
    ready = ready.repartition("conv_id", "chunk").sortWithinPartitions(*order)
    keep = [c for c in ready.columns if c not in ("entry", "leave", "chunk", *features)]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["conv_id", "chunk"]):
            path = best_path(model, _emissions(model, t), t.column("entry")[0].as_py(), t.column("leave")[0].as_py())
            yield from t.select(keep).append_column("role_pred", pa.array([ROLES[i] for i in path.tolist()])).to_batches()

    schema = ready.select(*keep).schema
    return ready.mapInArrow(solve, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", role_pred string")


def chunk_matrix_from_start(model: RoleModel, e: np.ndarray) -> np.ndarray:
    v = model.start + e[0]
    for row in e[1:]:
        v = (v[:, None] + model.step).max(0) + row
    return v


def train(turns: DataFrame) -> RoleModel:
    """Counts over the turns (conv_id, pos, role, features) whose role is known; the tables collected have fixed sizes."""
    known = turns.where(F.col("role").isin(*ROLES))
    chunk = F.floor(F.col("pos") / CHUNK)
    within = Window.partitionBy("conv_id", chunk).orderBy("pos")
    inside = turns.select("role", F.lead("role").over(within).alias("next"))
    # Steps from the last turn of a chunk to the first of the next.
    last = turns.where(F.col("pos") % CHUNK == CHUNK - 1).select(F.col("conv_id").alias("c"), (F.col("pos") + 1).alias("p"), "role")
    first = turns.where((F.col("pos") % CHUNK == 0) & (F.col("pos") > 0)).select("conv_id", "pos", F.col("role").alias("next"))
    across = last.join(first, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("pos"))).select("role", "next")
    steps = inside.union(across).where(F.col("role").isin(*ROLES) & F.col("next").isin(*ROLES))
    starts = {r["role"]: r["n"] for r in known.where("pos = 0").groupBy("role").agg(F.count("*").alias("n")).collect()}
    pairs = {(r["role"], r["next"]): r["n"] for r in steps.groupBy("role", "next").agg(F.count("*").alias("n")).collect()}
    flat = known.select("role", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).cast("int").alias("v")) for f in FEATURES])).alias("x"))
    seen = {(r["f"], r["role"], r["v"]): r["n"] for r in flat.groupBy("x.f", "role", "x.v").agg(F.count("*").alias("n")).collect()}
    return RoleModel(starts, pairs, seen)


def ordered_turns(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", text_col: str = "text", role_col: str | None = "role") -> DataFrame:
    """(conv_id, turn, role, text, pos): each turn's place in its conversation."""
    role = F.col(role_col) if role_col else F.lit(None).cast("string")
    base = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ties = base.withColumn("tie", F.xxhash64("text"))
    return prefix_ranks(ties, ["conv_id"], ["turn", "tie", "text"], F.floor(F.col("turn") / CHUNK), "pos").drop("tie")


def transcript_turns(transcripts: DataFrame, conv_col: str = "conv_id", text_col: str = "text") -> DataFrame:
    """Raw transcripts (a text each) -> (conv_id, turn, role, text): cut before every line that begins with a marker."""
    every = "|".join(MARKERS.values())
    cut = F.split(F.coalesce(F.col(text_col), F.lit("")), "(?m)(?=" + (_MARKER % every).replace("(?i)^", "(?i:^").replace(r"\s*(?:#", r"[ \t]*(?:#", 1) + "))")
    parts = F.filter(cut, lambda p: F.trim(p) != "")
    return transcripts.select(F.col(conv_col).alias("conv_id"), F.posexplode(parts).alias("turn", "text")).select("conv_id", F.col("turn").cast("long"), F.lit(None).cast("string").alias("role"), "text")


def held_out(conv_col: str) -> Column:
    """Conversations that are not learned from: those whose identifier's checksum modulo 3 is 1."""
    return F.coalesce(F.crc32(F.col(conv_col).cast("string")) % 3 == 1, F.lit(False))


def render(role: Column, text: Column, tagged: Column) -> Column:
    """The canonical form of a turn. A marker goes only where the transcript is tagged and the marker names the turn's role; any
    other text is the turn's own and stays."""
    own = F.coalesce(tagged & (F.element_at(F.array(*map(F.lit, ROLES)), F.greatest(marker(text), F.lit(1))) == role) & (marker(text) > 0), F.lit(False))
    said = F.when(own, without_marker(text)).otherwise(text)
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), F.regexp_replace(said, r"^\s+|\s+$", ""), F.lit("\n<|end|>\n"))


def tagged_conversations(turns: DataFrame) -> DataFrame:
    """conv_id of the conversations that use markers: two turns or more begin with one, and four of five turns do
    (a cut transcript: all but the first). A word before a colon or a line break in few turns is text."""
    marked = F.count_if(F.col("marker") > 0)
    return turns.groupBy("conv_id").agg(marked.alias("marked"), F.count("*").alias("n")).where("marked >= 2 AND 5 * marked >= 4 * n").select("conv_id")


def with_tagged(turns: DataFrame, tagged: DataFrame) -> DataFrame:
    """turns with a boolean `tagged`. Up to BROADCAST_CONVERSATIONS ids are broadcast; more meet the turns in lots, so that a
    conversation with a large share of all turns is no single task."""
    tagged = materialise(tagged, "tagged").withColumn("tagged", F.lit(True)).withColumnRenamed("conv_id", "conv_k")
    same = F.col("conv_id").eqNullSafe(F.col("conv_k"))
    if tagged.count() <= BROADCAST_CONVERSATIONS:
        met = turns.join(F.broadcast(tagged), same, "left")
    else:
        lots = tagged.withColumn("lot_k", F.explode(F.array(*[F.lit(i).cast("long") for i in range(LOTS)])))
        met = turns.withColumn("lot", F.pmod(F.xxhash64("pos"), F.lit(LOTS))).join(lots, same & (F.col("lot") == F.col("lot_k")), "left").drop("lot", "lot_k")
    return met.withColumn("tagged", F.coalesce("tagged", F.lit(False))).drop("conv_k")


def format_chats(rows: DataFrame, model: RoleModel | None = None) -> DataFrame:
    """conv_id, turn, pos, held_out, role, role_pred, rendered for each turn; if no model is given it is learned from the roles
    of the conversations that are not held out, and roles are never inputs of a prediction."""
    turns = materialise(observed(ordered_turns(rows)), "turns")
    found = recover_roles(turns, model or train(turns.where(~held_out("conv_id"))))
    found = with_tagged(found, tagged_conversations(turns))
    return found.select("conv_id", "turn", "pos", held_out("conv_id").alias("held_out"), "role", "role_pred", render(F.col("role_pred"), F.col("text"), F.col("tagged")).alias("rendered"))
