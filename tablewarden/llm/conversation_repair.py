"""Repair of conversation structure by the cheapest edits.

A conversation's role initials should read `(s?(ua)+)?`. A node of the edit lattice is a number of rows
consumed and a state of that pattern; an edge keeps, reroles or deletes the next row, or inserts an empty
turn. Bidirectional Dijkstra finds the cheapest way through: a forward heap from the start and a reverse
heap from the accepting ends meet, all crossings of equal cost are finished, and of these the least
concatenated audit (the edits' initials in order) is taken. Labels of a node compare by cost, then by
audit; only keeping is free and it consumes a row, so nodes of equal cost are settled row by row and
each label is final when its node is settled.

Rows are dealt into ranges by conversation and turn, so that a conversation of any length is spread.
Within a range every `PIECE` rows are a piece. A conversation within one piece, as nearly all are, is
repaired there. One that spans several is repaired piece by piece: each piece gives its least cost from
state to state, these add up from behind to the cost that is left after a piece, then each piece is
searched from every state it may be entered in, and the answers are chained from the front. An insertion
stands before the row it precedes, so audits of pieces need only be put side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tablewarden.llm.durable import cut
from tablewarden.llm.rows import column, schema

PIECE_BITS = 10  # rows of a piece: 1,024
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
_BLANK = " \t\n\x0b\x0c\r"
_LEGAL = ("su", "ua", "au")
_ROLES = {"u": "user", "a": "assistant"}
# states: nothing yet, after a system turn, after a user's, after an assistant's
_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
# the only other role that may follow in a state
_FILL = ("u", "u", "a", "u")
_ENDS = {0: 0, 3: 0}
_FAR = 1 << 60


def damaged(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, present) with the faults of a checksum of `conv_id:turn`: a row goes (it stays
    as one that is not present), loses its text, its ends of sentences, is repeated, or becomes a user's.
    A null id or turn counts as one space there, a null role or text becomes one."""
    text = F.coalesce(column(text_col), F.lit(" "))
    part = lambda name: F.coalesce(column(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(part(id_col), F.lit(":"), part(turn_col)).cast("binary")) % 20
    rows = turns.select(column(id_col).alias("conv_id"), column(turn_col).cast("long").alias("turn"), F.coalesce(column(role_col), F.lit(" ")).alias("role"), text.alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") != 0).alias("present"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


# -- the search ---------------------------------------------------------------------------------------


def _steps(row: tuple[str, str], state: int) -> Iterator[tuple[int, int, str]]:
    """(state after, cost, initial) of the edits of a row, given as its role's initial and its fault."""
    initial, fault = row
    yield state, DELETE, "D"
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        kept = _NEXT.get((state, initial))
        if kept is not None:
            yield kept, extra, "K"
        yield _NEXT[state, _FILL[state]], REROLE + extra, "R"


def cheapest(rows: list[tuple[str, str]], entry: int = 0, ends: dict[int, int] | None = None, last: bool = True) -> tuple[int, str]:
    """The least cost from state `entry` through all rows to one of `ends` (state: cost left after it), and the
    least audit of that cost. Behind the rows of a piece that is not the last, nothing is inserted."""
    ends = _ENDS if ends is None else ends
    n = len(rows)
    edges: dict[int, list[tuple[int, int, str]]] = {}
    back: list[list[tuple[int, int, str]]] = [[] for _ in range(4 * (n + 1))]
    for i in range(n + 1):
        for state in range(4):
            node = 4 * i + state
            out = [(node + 4 - state + after, cost, letter) for after, cost, letter in _steps(rows[i], state)] if i < n else []
            if i < n or last:
                out.append((4 * i + _NEXT[state, _FILL[state]], INSERT, "I"))
            edges[node] = out
            for after, cost, letter in out:
                back[after].append((node, cost, letter))

    labels: tuple[dict, dict] = ({entry: (0, "")}, {4 * n + state: (cost, "") for state, cost in ends.items()})
    settled: tuple[set, set] = (set(), set())
    # of nodes of equal cost, forward the one with fewer rows behind it comes first, in reverse the one with more
    heaps: tuple[list, list] = ([(0, entry // 4, entry)], [])
    for node, (cost, _) in labels[1].items():
        heappush(heaps[1], (cost, -(node // 4), node))
    best = _FAR
    while heaps[0] and heaps[1] and heaps[0][0][0] + heaps[1][0][0] <= best:
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        _, _, node = heappop(heaps[side])
        if node in settled[side]:
            continue
        settled[side].add(node)
        cost, audit = labels[side][node]
        other = labels[1 - side].get(node)
        if other:
            best = min(best, cost + other[0])
        for after, more, letter in (back[node] if side else edges[node]):
            label = (cost + more, letter + audit if side else audit + letter)
            known = labels[side].get(after)
            if known is None or label < known:
                labels[side][after] = label
                if known is None or label[0] < known[0]:
                    heappush(heaps[side], (label[0], -(after // 4) if side else after // 4, after))
    # every cheapest way crosses from a node settled forward over an edge to one settled in reverse, or ends before
    found = [labels[0][4 * n + state][1] for state, left in ends.items() if 4 * n + state in settled[0] and labels[0][4 * n + state][0] + left == best]
    for v in settled[0]:
        cost, audit = labels[0][v]
        found += [audit + letter + labels[1][w][1] for w, more, letter in edges[v] if w in settled[1] and cost + more + labels[1][w][0] == best]
    return best, min(found)


def follow(rows: list[tuple], audit: str, state: int = 0) -> tuple[list[tuple[str, str, str]], int]:
    """(edit, role, text) of the turns that an audit leaves of rows (role, text), and the state after them."""
    turns, at = [], 0
    for edit in audit:
        if edit == "I":
            initial, role, text = _FILL[state], _ROLES[_FILL[state]], ""
        else:
            role, text = rows[at][:2]
            at += 1
            if edit == "D":
                continue
            initial = role[:1]
            if edit == "R":
                initial, role = _FILL[state], _ROLES[_FILL[state]]
        turns.append((edit, role, text))
        state = _NEXT[state, initial]
    return turns, state


# -- rows in ranges -----------------------------------------------------------------------------------

_STATS = "n long, turns long, low long, high long, blank long, duplicate long, truncated long, illegal long, first string, last string"
_FOUND = "cost long, audit string, repaired_sha256 string"


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Neighbouring rows whose first `keys` columns are equal."""
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and rows[0][:keys] != row[:keys]:
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _emitting(kinds: T.StructType, each: Callable[[list[tuple]], Iterator[tuple]], keys: int):
    """A task that turns each group of neighbouring rows into rows of the given columns."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            return pa.record_batch([pa.array([r[i] for r in held], f.type) for i, f in enumerate(target)], schema=target)

        for rows in _grouped(batches, keys):
            held += each(rows)
            if len(held) >= 2000:
                yield flush()
                held = []
        yield flush()

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Names each row's first fault; of neighbouring equal rows all but the first are duplicates."""
    before = None
    for batch in batches:
        faults = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "present", "blank", "late", "ended")), strict=True):
            *own, present, blank, late, ended = row
            fault = None if not present else "blank" if blank else "duplicate" if late or own == before else "" if ended else "truncated"
            before = own if present else before
            faults.append(fault)
        kept = [batch.column(c) for c in ("conv_id", "turn", "role", "text")]
        yield pa.record_batch([*kept, pa.array(faults, pa.string())], names=["conv_id", "turn", "role", "text", "fault"])


def laid_out(turns: DataFrame) -> DataFrame:
    """(conv_id, piece, at, turn, role, text, fault), written once in the order of `at`, by conversation, then turn
    (nulls first), role, text. `fault` is blank, duplicate, truncated or empty; null for a row that is not
    present. Takes (conv_id, turn, role, text, present)."""
    rest = F.rtrim(F.col("text"), F.lit(_BLANK))
    rows = turns.select("*", (rest == "").alias("blank"), F.right(rest, F.lit(1)).isin(".", "!", "?").alias("ended"))
    identity = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(" "), F.length("role").cast("string"), F.lit(" "), F.col("role"), F.col("text"))
    rows = rows.withColumn("key", F.when(F.col("present") & ~F.col("blank"), F.unhex(F.sha2(identity, 256))))
    # texts that stand at more than one turn; where they stand first, they are no duplicates
    turn = F.struct("turn")
    repeated = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(turn).alias("early"), F.max(turn).alias("late")).where("NOT early <=> late").select("key", "early")
    rows = rows.join(repeated, "key", "left").withColumn("late", F.col("early").isNotNull() & ~F.col("early").eqNullSafe(turn))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    kept = ["conv_id", "turn", "role", "text", "present", "blank", "late", "ended"]
    rows = rows.select(*kept).repartitionByRange(*order).sortWithinPartitions(*order)
    marked = rows.mapInArrow(_marked, schema(rows, "conv_id", after="turn long, role string, text string, fault string"))
    marked = cut(marked.select("*", F.monotonically_increasing_id().alias("at")))
    return marked.select("conv_id", F.shiftright("at", PIECE_BITS).alias("piece"), "at", "turn", "role", "text", "fault")


def _present(rows: list[tuple]) -> list[tuple]:
    """(role, text, fault, turn) of the rows that are present, from rows as laid out."""
    return [(r[4], r[5], r[6], r[3]) for r in rows if r[6] is not None]


def _kinds(rows: list[tuple]) -> list[tuple[str, str]]:
    return [(r[0][:1], r[2]) for r in rows]


def _stats(rows: list[tuple]) -> tuple:
    turns = [r[3] for r in rows if r[3] is not None]
    initials = [r[0][:1] for r in rows]
    illegal = sum(a + b not in _LEGAL for a, b in zip(initials, initials[1:]))
    faults = [sum(r[2] == f for r in rows) for f in ("blank", "duplicate", "truncated")]
    ends = (initials[0], initials[-1]) if rows else (None, None)
    return len(rows), len(set(turns)), min(turns, default=None), max(turns, default=None), *faults, illegal, *ends


def _added(a: tuple, b: tuple) -> tuple:
    """The figures of two neighbouring runs of rows as one."""
    if not a[0] or not b[0]:
        return a if a[0] else b
    shared = a[3] is not None and a[3] == b[2]
    low, high = a[2] if a[2] is not None else b[2], b[3] if b[3] is not None else a[3]
    return a[0] + b[0], a[1] + b[1] - shared, low, high, a[4] + b[4], a[5] + b[5], a[6] + b[6], a[7] + b[7] + (a[9] + b[8] not in _LEGAL), a[8], b[9]


def _line(turn: tuple[str, str, str]) -> bytes:
    return f"{turn[1]}:{turn[2]}".encode("utf-8", "surrogatepass")


def _whole(rows: list[tuple]) -> Iterator[tuple]:
    """A piece as if it were all of its conversation."""
    own = _present(rows)
    cost, audit = cheapest(_kinds(own))
    digest = hashlib.sha256(b"\n".join(map(_line, follow(own, audit)[0]))).hexdigest()
    yield rows[0][0], rows[0][1], *_stats(own), cost, audit, digest


# -- conversations of several pieces ------------------------------------------------------------------


def _costs(rows: list[tuple]) -> Iterator[tuple]:
    """The least cost of a piece from each state to each."""
    table = []
    for entry in range(4):
        now = [_FAR] * 4
        now[entry] = 0
        for kind in _kinds(_present(rows)):
            for _ in range(3):
                for state in range(4):
                    after = _NEXT[state, _FILL[state]]
                    now[after] = min(now[after], now[state] + INSERT)
            then = [_FAR] * 4
            for state in range(4):
                for after, cost, _ in _steps(kind, state):
                    then[after] = min(then[after], now[state] + cost)
            now = then
        table += now
    yield rows[0][0], rows[0][1], table


def _left(rows: list[tuple]) -> Iterator[tuple]:
    """From the last piece on, the cost that is left behind each piece, by state."""
    left = [cheapest([], state)[0] for state in range(4)]
    for i, (conversation, piece, table) in enumerate(rows):
        yield conversation, piece, left if i else [0, _FAR, _FAR, 0], i == 0
        left = [min(table[4 * entry + state] + left[state] for state in range(4)) for entry in range(4)]


def _choices(rows: list[tuple]) -> Iterator[tuple]:
    """The piece's cheapest edits from every state it may be entered in; the first row has the costs left."""
    ends, last = rows[0][7], rows[0][8]
    own = _present(rows[1:])
    for entry in range(4):
        _, audit = cheapest(_kinds(own), entry, {s: c for s, c in enumerate(ends) if c < _FAR}, last)
        yield rows[0][0], rows[0][1], entry, follow(own, audit, entry)[1], audit


def _chained(rows: list[tuple]) -> Iterator[tuple]:
    """Of each piece's choices, the one for the state that the piece before ends in."""
    state, piece = 0, None
    for conversation, number, entry, after, audit in rows:
        if number != piece and entry == state:
            yield conversation, number, entry, audit
            piece, state = number, after


def _ordered(rows: DataFrame, by: str, *order: str | Column) -> DataFrame:
    return rows.repartition(by).sortWithinPartitions(*order)


def _with(rows: DataFrame, control: DataFrame) -> DataFrame:
    """Each piece's rows behind its control row, whose columns they have as nulls."""
    return rows.unionByName(control, allowMissingColumns=True)


def _audits_of(rows: DataFrame) -> DataFrame:
    """(conv_id, piece, entry, audit) of conversations of several pieces."""
    kinds = lambda after: schema(rows, "conv_id", after=after)
    tables = kinds("piece long, costs array<long>")
    costs = _ordered(rows, "piece", "piece", "conv_id", "at").mapInArrow(_emitting(tables, _costs, 2), tables)
    behind = kinds("piece long, left array<long>, final boolean")
    left = _ordered(costs, "conv_id", "conv_id", F.col("piece").desc()).mapInArrow(_emitting(behind, _left, 1), behind)
    both = _ordered(_with(rows, left), "piece", "piece", "conv_id", F.col("at").asc_nulls_first())
    choice = kinds("piece long, entry long, after long, audit string")
    choices = both.mapInArrow(_emitting(choice, _choices, 2), choice)
    chain = kinds("piece long, entry long, audit string")
    return _ordered(choices, "conv_id", "conv_id", "piece", "entry").mapInArrow(_emitting(chain, _chained, 1), chain)


def _digests(kinds: T.StructType):
    """A record per conversation from its pieces in order, each behind the row of its audit. Holds a piece."""
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        name, state = None, None
        for rows in _grouped(batches, 2):
            conversation, entry, audit = rows[0][0], rows[0][7], rows[0][8]
            own = _present(rows[1:])
            if state is None or conversation != name:
                if state:
                    found.append((name, *state[0], state[1], "".join(state[2]), state[3].hexdigest()))
                name, state = conversation, [(0, 0, None, None, 0, 0, 0, 0, None, None), 0, [], hashlib.sha256(), False]
            state[0] = _added(state[0], _stats(own))
            state[1] += _cost(own, audit)
            state[2].append(audit)
            for turn in follow(own, audit, entry)[0]:
                state[3].update(b"\n" + _line(turn) if state[4] else _line(turn))
                state[4] = True
        if state:
            found.append((name, *state[0], state[1], "".join(state[2]), state[3].hexdigest()))
        yield pa.record_batch([pa.array([r[i] for r in found], f.type) for i, f in enumerate(target)], schema=target)

    return run


def _cost(rows: list[tuple], audit: str) -> int:
    """What an audit costs."""
    faults = iter(r[2] for r in rows)
    total = 0
    for edit in audit:
        fault = None if edit == "I" else next(faults)
        total += {"D": DELETE, "R": REROLE, "I": INSERT, "K": 0}[edit]
        total += TRUNCATED if fault == "truncated" and edit != "D" else 0
    return total


# -- results ------------------------------------------------------------------------------------------


def _records(laid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of conversations of one piece, and the rows of all others."""
    kinds = schema(laid, "conv_id", after=f"piece long, {_STATS}, {_FOUND}")
    pieces = cut(laid.mapInArrow(_emitting(kinds, _whole, 2), kinds))
    found = pieces.groupBy("conv_id").agg(F.count("*").alias("pieces"), F.first(F.struct(*pieces.columns)).alias("one"))
    spanning = found.where("pieces > 1").select(F.col("conv_id").alias("id"))
    return found.where("pieces = 1").select("one.*"), laid.join(spanning, F.col("conv_id").eqNullSafe(F.col("id")), "left_semi")


def report(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation.

    Takes (conv_id, turn, role, text, present); other columns are ignored, so their names cannot clash. A
    conversation without a row that is present has zeros, an empty audit, and the digest of nothing. Rows go by
    turn, nulls first, then by role and text; equal rows are duplicates of each other. Null ids are one
    conversation. An empty table gives no rows.
    """
    laid = laid_out(turns)
    single, rows = _records(laid)
    rows = cut(rows)
    kinds = schema(laid, "conv_id", after=f"{_STATS}, {_FOUND}")
    both = _ordered(_with(rows, _audits_of(rows)), "conv_id", "conv_id", "piece", F.col("at").asc_nulls_first())
    found = single.drop("piece").unionByName(both.mapInArrow(_digests(kinds), kinds))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    return found.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place (rising within a conversation), edit (K, R or I), role, text. Takes and
    defines what `report` does; a conversation of which nothing is left has no rows."""
    laid = laid_out(turns)
    single, rows = _records(laid)
    rows = cut(rows)
    audits = single.select("conv_id", "piece", F.lit(0).cast("long").alias("entry"), "audit").unionByName(_audits_of(rows))
    kinds = schema(laid, "conv_id", after="place long, edit string, role string, text string")

    def applied(rows: list[tuple]) -> Iterator[tuple]:
        for i, turn in enumerate(follow(_present(rows[1:]), rows[0][8], rows[0][7])[0]):
            yield rows[0][0], rows[0][1] << 32 | i, *turn

    both = _ordered(_with(laid, audits), "piece", "piece", "conv_id", F.col("at").asc_nulls_first())
    return both.mapInArrow(_emitting(kinds, applied, 2), kinds)
