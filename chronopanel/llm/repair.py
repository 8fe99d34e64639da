"""Repair of conversation structure: cheapest edits by a Viterbi run in parallel chunks that converge in rank.

Roles must follow ``(s?(ua)+)?``.  Four states say what the last kept role was; a cost vector holds, per state, the least cost
of all that follows.  Chunks of a conversation start from a speculative vector at their end; passes run those chunks again
whose neighbour begins with another vector, until all differ by constants only.  The stitched vectors then lead the trace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import stored

#: Rows and bytes that a chunk of a conversation holds at most (a longer single row stands alone).
CHUNK_ROWS, CHUNK_BYTES = 5_000, 256 << 10
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"

# States: nothing kept yet, and the last kept role's initial.
START, S, U, A = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
GOOD, TRUNCATED, GONE = range(3)
NAMES = {U: "user", A: "assistant"}
#: State after the only role that is not a system role and may follow.
NEXT = (U, U, A, U)
RETYPE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Least costs where a conversation ends: whole pairs only.
AT_END = (0, 2 * INSERT, INSERT, 0)
UNKNOWN = (0, 0, 0, 0)


def _kept(state: int, initial: int) -> int | None:
    """State after keeping a row with that role initial, None where it must not stand."""
    if initial == 0:
        return S if state == START else None
    return NEXT[state] if initial == (2 if NEXT[state] == A else 1) else None


def _row_edits(state: int, code: int, after: tuple) -> Iterator[tuple[int, str, int]]:
    """(cost of all that follows, letter, next state) of the edits that use up a row."""
    kind, initial = divmod(code, 4)
    yield DELETE + after[state], "D", state
    if kind != GONE:
        extra = CUT_OFF if kind == TRUNCATED else 0
        to = _kept(state, initial)
        if to is not None:
            yield extra + after[to], "K", to
        yield extra + RETYPE + after[NEXT[state]], "R", NEXT[state]


class Steps:
    """Transitions between cost vectors less their minimum, numbered as they appear: there are few, so each is worked out once."""

    def __init__(self):
        self.vectors: list[tuple] = []
        self.number: dict[tuple, int] = {}
        self.back: dict[tuple[int, int], tuple[int, int]] = {}
        self.ahead: dict[tuple[int, int], tuple] = {}

    def of(self, vector: Iterable[int]) -> tuple[int, int]:
        """Number of a vector less its minimum, and the minimum."""
        vector = tuple(vector)
        low = min(vector)
        shape = tuple(v - low for v in vector)
        if shape not in self.number:
            self.number[shape] = len(self.vectors)
            self.vectors.append(shape)
        return self.number[shape], low

    def _costs(self, after: tuple, code: int) -> list[int]:
        using = [min(cost for cost, _, _ in _row_edits(state, code, after)) for state in range(4)]
        # at most two insertions in a row pay: a third would bring back a state already seen
        return [min(using[s], INSERT + using[NEXT[s]], 2 * INSERT + using[NEXT[NEXT[s]]]) for s in range(4)]

    def before(self, after: int, code: int) -> tuple[int, int]:
        key = (after, code)
        if key not in self.back:
            self.back[key] = self.of(self._costs(self.vectors[after], code))
        return self.back[key]

    def edits(self, after: int, code: int) -> tuple:
        """Per state the ASCII-least cheapest letters for a row, and the state behind it."""
        key = (after, code)
        if key not in self.ahead:
            ends = self.vectors[after]
            least = self._costs(ends, code)
            out = []
            for state in range(4):
                letters, at = "", state
                while True:
                    options = [(letter, to) for cost, letter, to in _row_edits(at, code, ends) if cost == least[at]]
                    if INSERT + least[NEXT[at]] == least[at]:
                        options.append(("I", NEXT[at]))
                    letter, at = min(options)
                    letters += letter
                    if letter != "I":
                        break
                out.append((letters, at))
            self.ahead[key] = tuple(out)
        return self.ahead[key]


def backward(codes: bytes, end: Iterable[int], steps: Steps) -> tuple[list[int], int]:
    """Numbers of the vectors before each row and at the end, and what was taken off them in all."""
    at, total = steps.of(end)
    path = [at]
    for code in reversed(codes):
        at, low = steps.before(at, code)
        total += low
        path.append(at)
    path.reverse()
    return path, total


def forward(codes: bytes, path: list[int], state: int, steps: Steps) -> tuple[list[str], int]:
    """Letters for each row from a state on, and the state behind the last."""
    out = []
    for code, after in zip(codes, path[1:]):
        letters, state = steps.edits(after, code)[state]
        out.append(letters)
    return out, state


def _texts(letters: Iterable[str], rows: Iterable[tuple[str, str]], state: int) -> Iterator[str]:
    """role:text of what the edits leave."""
    for edits, (role, text) in zip(letters, rows):
        for letter in edits:
            if letter == "D":
                continue
            state = S if letter == "K" and role[:1] == "s" else NEXT[state]
            if letter == "I":
                yield f"{NAMES[state]}:"
            else:
                yield f"{role if letter == 'K' else NAMES[state]}:{text}"


def _closing(state: int) -> str:
    return {S: "II", U: "I"}.get(state, "")


class Tally:
    """Counts over rows in order, put together from rows or from chunks."""

    FIELDS = ("n", "blank", "duplicate", "truncated", "illegal", "distinct", "low", "high", "first", "last")

    def __init__(self):
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.low = self.high = self.first = self.last = None

    def row(self, turn, initial: str, fault: int) -> None:
        self.join((1, fault == 1, fault == 2, fault == 3, 0, int(turn is not None), turn, turn, initial, initial))

    def join(self, o: tuple) -> None:
        n, blank, duplicate, truncated, illegal, distinct, low, high, first, last = o
        if n and self.n:
            self.illegal += self.last + first not in ("su", "ua", "au")
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        self.illegal += illegal
        # turns rise, so a turn on both sides of a seam is the highest here and the lowest there
        self.distinct += distinct - int(low is not None and low == self.high)
        self.low = low if self.low is None else self.low
        self.high = self.high if high is None else high
        if n:
            self.first, self.last = first if not self.n else self.first, last
        self.n += n

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def result(self) -> list[int]:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def judged(rows: list[tuple], seen: set) -> tuple[bytes, Tally]:
    """Codes and counts of (turn, role, text, blank, cut off, key) rows; ``seen`` holds keys that came before."""
    tally, codes = Tally(), bytearray()
    for turn, role, _, blank, cut, key in rows:
        fault = 1 if blank else 2 if key in seen else 3 if cut else 0
        seen.add(key)
        tally.row(turn, role[:1], fault)
        codes.append(4 * (GONE if fault in (1, 2) else TRUNCATED if fault else GOOD) + INITIALS.get(role[:1], OTHER))
    return bytes(codes), tally


def whole(rows: list[tuple], steps: Steps) -> list:
    """Result columns of a conversation whose rows are all here."""
    codes, tally = judged(rows, set())
    path, total = backward(codes, AT_END, steps)
    letters, state = forward(codes, path, START, steps)
    left = list(_texts(letters, [(r[1], r[2]) for r in rows], START))
    more = _closing(state)
    left += [f"{NAMES[A if more == 'I' or i else U]}:" for i in range(len(more))]
    audit = "".join(letters) + more
    cost = total + steps.vectors[path[0]][START]
    return [*tally.result(), cost, audit, hashlib.sha256("\n".join(left).encode("utf-8", "surrogatepass")).hexdigest()]


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
NAMES_OUT = [f.split()[0] for f in RESULT.split(", ")]
COUNTS = RESULT.split(", cost")[0]


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: by the checksum of ``conv_id:turn`` rows vanish (``copies`` 0), are emptied, lose their marks, are
    doubled (``copies`` 2) or become a user's.  Null ids and turns stand as one space in the checksum, null roles and texts
    become one space."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    text = F.when(k == 1, "").when(k == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    return rows.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(spaced("role")).alias("role"),
        text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"),
    )


def repaired(rows: DataFrame, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per conversation of (conv_id, turn, role, text, copies): counts of faults, least cost, audit and digest.

    Rows are sorted by range over conversation and turn, so a long conversation lies over several tasks.  Conversations within
    one task are repaired there; those at its edges, and chunks of those beyond ``chunk_rows`` or ``chunk_bytes``, go on as
    chunks.  Rows with one turn follow by role and digest of the text; equal rows lie in any tasks.  A null id is a
    conversation; rows with ``copies`` 0 only keep their conversation in the result; an empty table gives no rows; other columns
    are ignored.  The digest of a conversation is one running hash, so one task streams its text, a chunk at a time.
    """
    spark = rows.sparkSession
    kind = rows.schema["conv_id"].dataType
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES))
    keyed = rows.select(
        "conv_id", "turn", "role", "text", "copies", (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)).alias("key"),
        F.monotonically_increasing_id().alias("salt"),  # spreads equal rows
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "key", "salt"]
    sorted_ = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    chunks = stored(_chunked(sorted_, kind, chunk_rows, chunk_bytes), "conversation-chunks")
    done = chunks.filter("seq IS NULL").select("conv_id", *NAMES_OUT)
    open_ = chunks.filter("seq IS NOT NULL").select("conv_id", "part", "seq", "turns", "roles", "texts", "blanks", "cuts", "keys")
    return done.unionByName(_stitched(spark, open_, kind))


def _chunked(sorted_: DataFrame, kind, chunk_rows: int, chunk_bytes: int) -> DataFrame:
    """Results of conversations that lie inside a task, and chunks (part, seq) of the others."""
    schema = (
        f"conv_id {kind.simpleString()}, {RESULT}, part int, seq int, turns array<long>, roles array<string>, texts array<string>, "
        "blanks array<boolean>, cuts array<boolean>, keys array<binary>"
    )
    arrow = to_arrow_type(kind)
    types = [arrow, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()),
             pa.list_(pa.bool_()), pa.list_(pa.bool_()), pa.list_(pa.binary())]
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        part, steps = TaskContext.get().partitionId(), Steps()
        out: list[tuple] = []
        held: list[tuple] = []
        size = weight = seq = 0
        now, first, cut_up = None, True, False

        def as_chunk():
            nonlocal held, size, seq
            fields = list(zip(*held)) if held else [()] * 6
            out.append((now[0], *[None] * 8, part, seq, *map(list, fields)))
            seq, held, size = seq + 1, [], 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=names)

        for batch in batches:
            for conv, turn, role, text, copies, blank, cut, key in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv,):
                    if now is not None:
                        if first or cut_up:
                            as_chunk()
                        else:
                            out.append((now[0], *whole(held, steps), *[None] * 8))
                            held, size = [], 0
                        first = cut_up = False
                    now = (conv,)
                for _ in range(copies):
                    if held and (len(held) >= chunk_rows or size + len(text) > chunk_bytes):
                        weight += size
                        as_chunk()
                        cut_up = True
                    held.append((turn, role, text, blank, cut, key))
                    size += len(text)
                if len(out) >= 2000 or weight >= 4 * chunk_bytes:
                    if out:
                        yield batch_of()
                    out, weight = [], 0
        if now is not None:
            as_chunk()
        if out:
            yield batch_of()

    return sorted_.mapInArrow(run, schema)


def _stitched(spark, open_: DataFrame, kind) -> DataFrame:
    """Repair of the conversations that lie in chunks."""
    c, here = F.col, ["part", "seq"]
    name = kind.simpleString()
    spot = F.struct("part", "seq", "pos")
    keys = open_.select("conv_id", *here, F.posexplode(F.transform(F.arrays_zip("keys", "blanks"), lambda z: F.when(~z["blanks"], z["keys"]))).alias("pos", "key"))
    # one row per chunk and text, so that a window holds no more rows than a conversation has chunks
    firsts = keys.filter(c("key").isNotNull()).groupBy("conv_id", "key", *here).agg(F.min("pos").alias("pos"))
    earliest = F.min(spot).over(Window.partitionBy("conv_id", "key"))
    seen = firsts.withColumn("low", earliest).filter(c("low") != spot).groupBy(*here).agg(F.collect_list("key").alias("seen"))
    joined = open_.join(seen.hint("merge"), here, "left")
    place = Window.partitionBy("conv_id").orderBy(*here)
    numbered = joined.withColumns({"k": F.row_number().over(place), "last": F.lead("part").over(place).isNull()})
    coded = stored(_coded(numbered, name), "conversation-codes")
    costs = coded.select("conv_id", "k", "last", "codes")
    none = F.lit(None).cast("array<long>")
    level = stored(_costed(costs.withColumns({"end": none, "begin": none, "want": none}), name), "chunk-costs")
    while True:
        after = level.select(c("conv_id").alias("of"), (c("k") - 1).alias("before"), F.transform("begin", lambda v: v - F.array_min("begin")).alias("want"))
        asked = level.join(after.hint("merge"), c("conv_id").eqNullSafe(c("of")) & (c("k") == c("before")), "left").drop("of", "before")
        if asked.filter(c("want") != c("end")).isEmpty():
            break
        level = stored(_costed(asked, name), "chunk-costs")
    ends = level.select(c("conv_id").alias("of"), c("k").alias("at"), "end", "begin")
    traced = coded.join(ends.hint("merge"), c("conv_id").eqNullSafe(c("of")) & (c("k") == c("at"))).drop("of", "at")
    return _streamed(traced.repartition("conv_id").sortWithinPartitions("conv_id", "k"), kind)


STATS = "n long, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first string, last_initial string"


def _coded(numbered: DataFrame, name: str) -> DataFrame:
    """Chunks with a code per row and their counts, now that it is known which of their texts came before."""
    schema = f"conv_id {name}, k int, last boolean, roles array<string>, texts array<string>, codes binary, {STATS}"

    def run(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                row = {n: batch.column(n)[one].as_py() for n in batch.schema.names if n != "conv_id"}
                codes, tally = judged(list(zip(row["turns"], row["roles"], row["texts"], row["blanks"], row["cuts"], row["keys"])), set(row["seen"] or ()))
                values = [row["k"], row["last"], row["roles"], row["texts"], codes, *tally.values()]
                types = [pa.int32(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(), *[pa.int64()] * 8, pa.string(), pa.string()]
                arrays = [batch.column("conv_id").slice(one, 1), *[pa.array([v], t) for v, t in zip(values, types)]]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in schema.split(", ")])

    return numbered.mapInArrow(run, schema)


def _costed(asked: DataFrame, name: str) -> DataFrame:
    """One pass: chunks whose end vector is not the wanted one run again, the others stay.

    ``end`` is the vector that a chunk assumed behind it, less its minimum, ``begin`` the vector before it.  In the first pass
    none is wanted, and all chunks but the last of a conversation take the speculative one.
    """
    schema = f"conv_id {name}, k int, last boolean, codes binary, end array<long>, begin array<long>"

    def run(batches):
        steps = Steps()
        for batch in batches:
            ends, begins = [], []
            for last, codes, end, begin, want in zip(*(batch.column(n).to_pylist() for n in ("last", "codes", "end", "begin", "want"))):
                if begin is None or (want is not None and want != end):
                    end = list(AT_END if last else want or UNKNOWN)
                    path, total = backward(codes, end, steps)
                    begin = [total + v for v in steps.vectors[path[0]]]
                ends.append(end)
                begins.append(begin)
            arrays = [batch.column(n) for n in ("conv_id", "k", "last", "codes")]
            vectors = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ends, vectors), pa.array(begins, vectors)], names=["conv_id", "k", "last", "codes", "end", "begin"])

    return asked.select("conv_id", "k", "last", "codes", "end", "begin", "want").mapInArrow(run, schema)


def _streamed(traced: DataFrame, kind) -> DataFrame:
    """Results of conversations whose chunks come in order: the state, the running hash and the counts pass from chunk to chunk."""
    arrow = to_arrow_type(kind)
    columns = ["conv_id", "roles", "texts", "codes", "end", "begin", *[f.split()[0] for f in STATS.split(", ")]]
    types = [arrow, *[pa.int64()] * 6, pa.string(), pa.string()]

    class Running:
        def __init__(self):
            self.state, self.cost, self.tally, self.audit, self.hash, self.any = START, None, Tally(), [], hashlib.sha256(), False

        def put(self, text: str) -> None:
            self.hash.update((("\n" if self.any else "") + text).encode("utf-8", "surrogatepass"))
            self.any = True

        def chunk(self, roles, texts, codes, end, begin, counts, steps) -> None:
            path, _ = backward(codes, end, steps)
            letters, after = forward(codes, path, self.state, steps)
            for text in _texts(letters, zip(roles, texts), self.state):
                self.put(text)
            self.cost = begin[START] if self.cost is None else self.cost + min(begin)
            self.state = after
            self.audit.append("".join(letters))
            self.tally.join(counts)

        def result(self) -> list:
            for _ in _closing(self.state):
                self.state = NEXT[self.state]
                self.audit.append("I")
                self.put(f"{NAMES[self.state]}:")
            return [*self.tally.result(), self.cost, "".join(self.audit), self.hash.hexdigest()]

    def run(batches):
        steps, now, running, out = Steps(), None, None, []
        for batch in batches:
            for one in range(batch.num_rows):
                conv, roles, texts, codes, end, begin, *counts = (batch.column(n)[one].as_py() for n in columns)
                if now != (conv,):
                    if now is not None:
                        out.append((now[0], *running.result()))
                    now, running = (conv,), Running()
                running.chunk(roles, texts, codes, end, begin, tuple(counts), steps)
        if now is not None:
            out.append((now[0], *running.result()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)], names=["conv_id", *NAMES_OUT])

    return traced.select(*columns).mapInArrow(run, f"conv_id {kind.simpleString()}, {RESULT}")
