"""Repair of conversations: the cheapest edits after which system, user and assistant take turns as they should.

A conversation's roles should read, by initials, `(s?(ua)+)?`. Turns may be kept (K), given another role (R), deleted
(D), and empty turns inserted (I). Before each turn stands a run of insertions: a macro edit is this run with what
happens to the turn, and its code, I*[DKR], is no prefix of another. So audits compare as their sequences of codes do,
and the dynamic programme needs no strings: a layer holds for each state (nothing yet, s, u, a) the least cost, the
rank of its audit among the layer's, and its parent with the code. Ranks of the next layer come from pairs of parent's
rank and code. The audit is read off the parents in the end.

Layers of a stretch of turns are a small matrix from the states before it to those behind it, and matrices of stretches
compose in the same way, by cost and ranks. Rows are dealt by conversation and turn in ranges, so that a conversation of
any share of the table lies over many tasks: each makes its stretch's matrix, the matrices of a conversation (one for a
task) give every stretch its states at both ends, and the stretches are edited on their own. Only the digest of a
conversation's whole text passes through one task, in chunks, and is not held there.

Equal rows are one with a number before they are moved. Of a conversation's equal role and text the first turn is
found by aggregation. Turns are in order of turn, null first; of one turn by two hashes of role and text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import materialise

#: States: nothing yet, behind s, behind u, behind a.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind an inserted turn, or one with a new role.
NEXT = (USER, USER, ASSISTANT, USER)
#: Macro edits in ASCII order; more than two insertions before a turn are never cheapest.
CODES = sorted("I" * k + x for k in range(3) for x in "DKR")
#: Insertions behind the last turn, in the order of a string that ends or goes on.
ENDS = ("", "I", "II")
COST = {"I": 2, "D": 3, "K": 0, "R": 2}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Faults of a turn.
SOUND, TRUNCATED, BLANK = range(3)
#: Characters of turns that an unfinished stretch holds before it puts them out.
CHUNK = 1 << 20


def _after(state: int, code: str, initial: str, must_go: bool, truncated: bool) -> tuple[int, int] | None:
    """The state behind a macro edit and its cost, if it may be made."""
    cost = 0
    for _ in code[:-1]:
        state, cost = NEXT[state], cost + COST["I"]
    do = code[-1]
    cost += COST[do] + (truncated and do != "D")
    if do == "D":
        return state, cost
    if must_go:
        return None
    if do == "R":
        return NEXT[state], cost
    to = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(initial)
    fits = state == START if to == SYSTEM else to == NEXT[state]
    return (to, cost) if fits else None


def _steps(initial: str, must_go: bool, truncated: bool) -> list[tuple[int, int, int, int]]:
    """state before, state behind, cost, code: of the edits between two states only the cheapest, then least, counts."""
    best: dict[tuple[int, int], tuple[int, int]] = {}
    for state in range(4):
        for code, text in enumerate(CODES):
            if to := _after(state, text, initial, must_go, truncated):
                best[state, to[0]] = min(best.get((state, to[0]), (99, 0)), (to[1], code))
    return [(a, b, *x) for (a, b), x in best.items()]


STEPS = {(i, f): _steps(i, f == BLANK, f == TRUNCATED) for i in ("s", "u", "a", "") for f in (SOUND, TRUNCATED, BLANK)}
GONE = STEPS["", BLANK]

Layer = list[tuple[int, int] | None]  # cost and rank, by state


def begin(state: int) -> Layer:
    return [(0, 0) if s == state else None for s in range(4)]


def _ranked(best: list) -> tuple[Layer, list]:
    """The layer of (cost, rank and code, origin) by state, with ranks anew, and the origins."""
    order = sorted({x[1] for x in best if x})
    return [x and (x[0], order.index(x[1])) for x in best], [x and x[2] for x in best]


def step(layer: Layer, steps, more: int = 0) -> tuple[Layer, list]:
    """The next layer, and for each of its states the parent and code; more: what all of its edits cost besides."""
    best: list = [None] * 4
    for a, b, cost, code in steps:
        if (x := layer[a]) and (best[b] is None or (x[0] + cost + more, (x[1], code)) < best[b][:2]):
            best[b] = (x[0] + cost + more, (x[1], code), (a, code))
    return _ranked(best)


def compose(first: list[Layer], second: list[Layer]) -> list[Layer]:
    """The matrix (a layer for each state before) of one stretch behind another."""
    return [chain(layer, second)[0] for layer in first]


def chain(layer: Layer, matrix: list[Layer]) -> tuple[Layer, list]:
    """The layer behind a stretch, and for each state the state before the stretch."""
    best: list = [None] * 4
    for a, x in enumerate(layer):
        for b, y in enumerate(matrix[a]):
            if x and y and (best[b] is None or (x[0] + y[0], (x[1], y[1])) < best[b][:2]):
                best[b] = (x[0] + y[0], (x[1], y[1]), a)
    return _ranked(best)


def finish(layer: Layer) -> tuple[int, int, str]:
    """Cost, last state and the insertions behind the last turn of the cheapest audit."""
    ends = []
    for state, x in enumerate(layer):
        for k, text in enumerate(ENDS):
            last = state
            for _ in text:
                last = NEXT[last]
            if x and last in (START, ASSISTANT):
                ends.append((x[0] + COST["I"] * k, x[1], k, state))
    cost, _, k, state = min(ends)
    return cost, state, ENDS[k]


class Stretch:
    """Turns of one conversation in order: counts of faults, and layers from each of the states entries.

    A turn is (turn, role, text, n, first): n equal ones; first: none of the conversation equals it before."""

    def __init__(self, entries=range(4)):
        self.layers = {s: begin(s) for s in entries}
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = self.rows = 0
        self.least = self.most = self.open = self.close = None

    def add(self, turn, role: str, text: str, n: int, first: bool) -> list[tuple[list, int]]:
        """The steps that the turns take, each with the number of turns it stands for."""
        initial = role[:1]
        kept = text.rstrip("\t\n\v\f\r ")
        if not kept:
            self.blank += n
            made = [(GONE, n)]
        else:
            cut = kept[-1] not in ".!?"
            self.truncated += bool(first and cut)
            self.duplicate += n - first
            kind = initial if initial in ("s", "u", "a") else ""
            made = [(STEPS[kind, TRUNCATED if cut else SOUND], 1)] * first + [(GONE, n - first)] * (n > first)
        self.illegal += n - 1
        if self.rows:
            self.illegal += (self.close + initial) not in ("su", "ua", "au")
        else:
            self.open = initial
        self.close = initial
        self.rows += n
        if turn is not None and self.most != turn:
            self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        for steps, times in made:
            # Of several turns that must go, insertions come before the last: D sorts before I.
            self.layers = {s: step(layer, steps, COST["D"] * (times - 1))[0] for s, layer in self.layers.items()}
        return made

    def state(self) -> dict:
        flat = [x for s in sorted(self.layers) for y in self.layers[s] for x in (y or (-1, -1))]
        return {k: getattr(self, k) for k in COUNTS} | {"matrix": flat}


COUNTS = ("rows", "blank", "duplicate", "truncated", "illegal", "distinct", "least", "most", "open", "close")


def matrix_of(flat: list[int]) -> list[Layer]:
    pairs = [None if flat[i] < 0 else (flat[i], flat[i + 1]) for i in range(0, len(flat), 2)]
    return [pairs[i : i + 4] for i in range(0, len(pairs), 4)]


def edited(turns: list, entry: int, exit: int) -> tuple[str, list[str]]:
    """The audit of a stretch between two states, and its turns afterwards as role:text."""
    layer, parents = begin(entry), []
    each = Stretch(())
    for t in turns:
        for steps, times in each.add(*t):
            layer, origin = step(layer, steps, COST["D"] * (times - 1))
            parents.append((origin, t, times))
    path, state = [], exit
    for origin, t, times in reversed(parents):
        state, code = origin[state]
        path.append((state, CODES[code], t, times))
    audit, out = [], []
    for state, code, (_, role, text, *_), times in reversed(path):
        audit.append("D" * (times - 1) + code)
        for x in code:
            if x in "IR":
                state = NEXT[state]
                out.append(f"{NAMES[state]}:{text if x == 'R' else ''}")
            elif x == "K":
                out.append(f"{role}:{text}")
    return "".join(audit), out


def inserted(state: int, ending: str) -> list[str]:
    out = []
    for _ in ending:
        state = NEXT[state]
        out.append(NAMES[state] + ":")
    return out


def gaps(least, most, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


def repair(turns: list) -> dict:
    """Counts, cost, audit and repaired turns of one conversation whose turns are at hand."""
    s = Stretch((START,))
    for t in turns:
        s.add(*t)
    cost, state, ending = finish(s.layers[START])
    audit, out = edited(turns, START, state)
    return {
        "gaps": gaps(s.least, s.most, s.distinct), "blank": s.blank, "duplicate": s.duplicate, "truncated": s.truncated,
        "illegal": s.illegal, "cost": cost, "audit": audit + ending, "repaired": out + inserted(state, ending),
    }


def _sha(parts: list[str]) -> str:
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURNS = "turns array<struct<turn:bigint,role:string,text:string,n:bigint,first:boolean>>"
_STATE = "rows bigint, distinct bigint, least bigint, most bigint, open string, close string, matrix array<bigint>"


def _tuples(turns: list[dict]) -> list[tuple]:
    return [(t["turn"], t["role"], t["text"], t["n"], t["first"]) for t in turns]


class _Task:
    """Puts the sorted rows of a task together: one finished row for a conversation that the task holds whole and at
    once, and for others chunks of turns (chunk 0, 1, ...) and a row of counts and matrix (chunk -1)."""

    def __init__(self, part: int):
        self.part, self.out, self.held = part, [], 0

    def open(self, conv_id) -> None:
        self.conv_id, self.turns, self.size, self.chunk, self.stretch = conv_id, [], 0, 0, None

    def put(self, **row) -> None:
        self.out.append({"conv_id": self.conv_id, "part": self.part} | row)

    def add(self, turn: dict) -> None:
        self.turns.append(turn)
        self.size += len(turn["text"]) + 50
        self.held += len(turn["text"]) + 50
        if self.size > CHUNK:
            self.put_chunk()

    def put_chunk(self) -> None:
        self.stretch = self.stretch or Stretch()
        for t in _tuples(self.turns):
            self.stretch.add(*t)
        self.put(chunk=self.chunk, turns=self.turns)
        self.turns, self.size, self.chunk = [], 0, self.chunk + 1

    def close(self, whole: bool) -> None:
        """whole: the conversation neither begins before the task's rows nor goes on behind them."""
        if whole and not self.stretch:
            done = repair(_tuples(self.turns))
            self.put(**done, repaired_sha256=_sha(done.pop("repaired")))
        else:
            self.put_chunk()
            self.put(chunk=-1, **self.stretch.state())


def _stretches(schema):
    """A function for mapInArrow: rows sorted by conversation and turn to what _Task puts out."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        task, begun, whole, first = _Task(TaskContext.get().partitionId()), False, False, None

        def emptied():
            rows, task.out, task.held = task.out, [], 0
            return pa.RecordBatch.from_pylist([dict.fromkeys(arrow.names) | {k: v for k, v in x.items() if k in arrow.names} for x in rows], schema=arrow)

        for batch in batches:
            for r in batch.to_pylist():
                if not begun or r["conv_id"] != task.conv_id:
                    if begun:
                        task.close(whole)
                        whole = True  # only the first conversation may have begun in another task
                    task.open(r["conv_id"])
                    begun = True
                if r["kind"] == 0:
                    first = (r["turn"], r["d1"], r["d2"])
                elif r["n"]:
                    task.add({k: r[k] for k in ("turn", "role", "text", "n")} | {"first": first == (r["turn"], r["d1"], r["d2"])})
                if task.held > CHUNK or len(task.out) > 1000:
                    yield emptied()
        if begun:
            task.close(False)
        yield emptied()

    return run


_ENDS = "part int, entry int, leave int, ending string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"


def _joined(schema):
    """A function for applyInArrow: the matrices of a conversation to the states at both ends of each stretch (part and
    states), and a row with its counts (part -1)."""

    def run(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        layer, origins, total, last = begin(START), [], dict.fromkeys(COUNTS, 0), None
        least = most = None
        for r in rows:
            layer, origin = chain(layer, matrix_of(r["matrix"]))
            origins.append(origin)
            if r["rows"]:
                for k in ("blank", "duplicate", "truncated", "illegal", "distinct"):
                    total[k] += r[k]
                total["illegal"] += last is not None and last + r["open"] not in ("su", "ua", "au")
                total["distinct"] -= most is not None and most == r["least"]
                last = r["close"]
                least, most = r["least"] if least is None else least, most if r["most"] is None else r["most"]
        cost, state, ending = finish(layer)
        counts = {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        out = [{"part": -1, "leave": state, "ending": ending, "gaps": gaps(least, most, total["distinct"]), "cost": cost} | counts]
        for r, origin in zip(reversed(rows), reversed(origins)):
            out.append({"part": r["part"], "entry": origin[state], "leave": state})
            state = origin[state]
        arrow = to_arrow_schema(schema)
        return pa.Table.from_pylist([dict.fromkeys(arrow.names) | {"conv_id": rows[0]["conv_id"]} | x for x in out], schema=arrow)

    return run


def _edited(schema):
    """A function for applyInArrow: the chunks of a stretch to their audit and repaired turns, in pieces."""

    def run(table):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        one = rows[0]
        audit, turns = edited([t for r in rows for t in _tuples(r["turns"])], one["entry"], one["leave"])
        pieces, size = [[]], 0
        for t in turns:
            if size > CHUNK:
                pieces.append([])
                size = 0
            pieces[-1].append(t)
            size += len(t)
        out = [{"conv_id": one["conv_id"], "part": one["part"], "chunk": i, "audit": "" if i else audit, "repaired": "\n".join(p) if p else None} for i, p in enumerate(pieces)]
        return pa.Table.from_pylist(out, schema=to_arrow_schema(schema))

    return run


def _put_together(schema):
    """A function for mapInArrow: each conversation's row of counts, then its pieces in order, to its result."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, now, out = to_arrow_schema(schema), None, []

        def close():
            ending = inserted(now["leave"], now["ending"])
            feed("\n".join(ending) if ending else None)
            out.append({k: now[k] for k in arrow.names if k in now} | {"audit": "".join(audit) + now["ending"], "repaired_sha256": sha.hexdigest()})

        def feed(text):
            nonlocal started
            if text is not None:
                sha.update(("\n" if started else "").encode() + text.encode())
                started = True

        for batch in batches:
            for r in batch.to_pylist():
                if r["part"] < 0:
                    if now:
                        close()
                    now, audit, sha, started = r, [], hashlib.sha256(), False
                else:
                    audit.append(r["audit"])
                    feed(r["repaired"])
        if now:
            close()
        yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return run


def damaged(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text and n: rows with faults, by crc32 of id and turn; n rows stand for each, 0 for a lost one.
    Null roles and texts, and null ids and turns where they are hashed, count as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank(conv_id), F.lit(":"), blank(turn))) % 20
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), blank(role).alias("role"), blank(text).alias("text"), kind.alias("kind"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("bigint").alias("n"),
    )


def repairs(rows: DataFrame) -> DataFrame:
    """conv_id and the columns of RESULT for each conv_id of rows, which has conv_id, turn, role, text and n (how many
    equal rows each stands for, 0 too). Roles and texts are not null; a null conv_id is a conversation of its own, and
    one without rows gets zeros, an empty audit and the digest of an empty text. Costs and counts do not depend on how
    rows are dealt. Text is read whole; an empty table gives an empty one."""
    spark = rows.sparkSession
    there = F.col("n") > 0
    # Rows that stand for none only name their conversation.
    some = rows.select("conv_id", *[F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")], "n")
    digests = [F.coalesce(F.xxhash64(*x), F.lit(0)).alias(f"d{i + 1}") for i, x in enumerate((("role", "text"), (F.lit(7), "text", "role")))]
    each = some.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).select("*", *digests, F.lit(1).alias("kind"))
    no_turn = F.max(F.col("turn").isNull())
    firsts = some.filter(there).select("conv_id", "turn", *digests).groupBy("conv_id", "d1", "d2")
    firsts = firsts.agg(no_turn.alias("u"), F.min("turn").alias("least")).select("conv_id", F.when(~F.col("u"), F.col("least")).alias("turn"), "d1", "d2", F.lit(0).alias("kind"))
    both = each.unionByName(firsts, allowMissingColumns=True)
    key = ["conv_id", "turn", "d1", "d2"]
    dealt = both.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key).sortWithinPartitions(*key, "kind")

    of = lambda more: spark.createDataFrame([], more).schema
    kind = rows.select("conv_id").schema
    schema = of(f"part int, chunk int, {RESULT}, {_TURNS}, {_STATE}")
    schema = type(schema)(kind.fields + schema.fields)
    parts = materialise(dealt.mapInArrow(_stretches(schema), schema))
    done = parts.filter("chunk IS NULL").select("conv_id", *of(RESULT).names)

    ends = type(schema)(kind.fields + of(_ENDS).fields)
    light = parts.filter("chunk = -1").select("conv_id", "part", *COUNTS, "matrix")
    ends_of = materialise(light.groupBy("conv_id").applyInArrow(_joined(ends), ends))
    chunks = parts.filter("chunk >= 0").select("conv_id", "part", "chunk", "turns")
    at = ends_of.filter("part >= 0").select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), "entry", "leave")
    chunks = chunks.join(at, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("part") == F.col("__p"))).drop("__c", "__p")
    piece = type(schema)(kind.fields + of("part int, chunk int, audit string, repaired string").fields)
    pieces = chunks.groupBy("conv_id", "part").applyInArrow(_edited(piece), piece)
    result = type(schema)(kind.fields + of(RESULT).fields)
    lined = pieces.unionByName(ends_of.filter("part < 0").drop("entry"), allowMissingColumns=True)
    lined = lined.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk")
    return done.unionByName(lined.mapInArrow(_put_together(result), result))
