"""Repair of the structure of conversations: the cheapest edits after which roles alternate.

A conversation's rows and the roles that may come next span a lattice: its nodes are (rows done,
last role), its arcs edits with whole-number costs. The auction algorithm finds the shortest
path: nodes have prices, the path is extended along the cheapest arc where its end's price
allows, else the price rises and the path contracts. When it is done every arc of
every shortest path is tight (cost = difference of prices), so the least of the cheapest edit strings is
traced along tight arcs, in the order of their letters.

Rows are dealt by ranges of (conversation, turn, content, row), so that a conversation of any
length is spread over tasks. One that lies in a task as a whole, and has SEGMENT rows at most, is repaired there.
Others are cut into segments: a segment's costs between last roles before and after it
(4 x 4) are auctions too, their fold from the end tells each segment what lies ahead,
and one from the start which role it begins with. Only the digest of the repaired text, which is serial by
nature, passes a conversation's segments through one task, one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rows of a segment, and characters of its texts, at most (one text may be longer).
SEGMENT, CHARS = 256, 1 << 20
SPACE = " \t\n\x0b\x0c\r"
#: Last roles: none yet, and those of these initials.
START, SYSTEM, USER, ASSISTANT = range(4)
STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Bits of a row's code beside the state that its role gives: it must go; keeping it costs 1.
GONE, TRUNCATED = 4, 8
DELETE, INSERT, REROLE = 3, 2, 2
NEVER = 1 << 40
#: What an end in each state costs: system needs user and assistant, user needs assistant.
AHEAD = [0, 2 * INSERT, INSERT, 0]
TAIL = ["", "II", "I", ""]
LEGAL = {"su", "ua", "au"}


class Lattice:
    """Rows of a segment by their codes; ``ahead`` is what lies beyond its end, for each last role."""

    def __init__(self, codes: bytes, ahead: list[int]):
        self.codes, self.ahead, self.n = codes, ahead, len(codes)
        # prices that hold for all arcs: what each row costs at least; where no end can be reached, never
        left, price, system = min(ahead), list(ahead), False
        prices = [price]
        for c in reversed(codes):
            left += DELETE if c & GONE else 1 if c & TRUNCATED else 0
            system |= c & 7 == SYSTEM
            turns = min(ahead[USER], ahead[ASSISTANT])
            after = min(ahead[SYSTEM], turns)
            begin = min(ahead[START], turns, ahead[SYSTEM] if system else NEVER)
            prices.append([left if x < NEVER else NEVER for x in (begin, after, turns, turns)])
        self.price = [p for row in reversed(prices) for p in row]

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, cost, node) of each edit, by letter."""
        i, state = divmod(node, 4)
        if i == self.n:
            return []
        code, turn = self.codes[i], ASSISTANT if state == USER else USER
        out = [("D", DELETE, node + 4), ("I", INSERT, 4 * i + turn)]
        if not code & GONE:
            more, role = (1 if code & TRUNCATED else 0), code & 3
            if role == turn or role == SYSTEM and state == START:
                out.append(("K", more, node + 4 - state + role))
            out.append(("R", REROLE + more, node + 4 - state + turn))
        return out

    def auction(self, state: int) -> int:
        """The cost of the cheapest edits from that last role to the end and beyond."""
        price, path = self.price, [state]
        if price[state] >= NEVER:
            return NEVER
        while path[-1] < 4 * self.n:
            at = path[-1]
            cost, to = min((c + price[j], j) for _, c, j in self.arcs(at))
            if price[at] < cost:
                price[at] = cost
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
        return price[state]

    def edits(self, state: int) -> tuple[str, int]:
        """The least of the cheapest edit strings from that last role, and the role at the end."""
        self.auction(state)
        price, dead, path, letters = self.price, set(), [state], []
        while path[-1] < 4 * self.n:
            at = path[-1]
            step = next(((x, j) for x, c, j in self.arcs(at) if price[at] == c + price[j] and j not in dead), None)
            if step:
                letters.append(step[0])
                path.append(step[1])
            else:  # a price that no auction has had to raise: no shortest path goes here
                dead.add(path.pop())
                letters.pop()
        return "".join(letters), path[-1] % 4


def costs_between(codes: bytes) -> list[int]:
    """The cheapest edits of a segment from each last role (4) to each (4), or NEVER."""
    out = [NEVER] * 16
    for end in range(4):
        lattice = Lattice(codes, [0 if x == end else NEVER for x in range(4)])
        for begin in range(4):
            out[4 * begin + end] = lattice.auction(begin) if codes else 0 if begin == end else NEVER
    return out


def replay(codes: bytes, roles: list[str], texts: list[str], letters: str, state: int, last: bool) -> Iterator[tuple[str, int, str | None, str | None]]:
    """(letter, cost, role, text) of each edit, and those after the last segment; role and text are null where a row goes."""
    i = 0
    for x in letters:
        turn = ASSISTANT if state == USER else USER
        name = "assistant" if state == USER else "user"
        if x == "I":
            state = turn
            yield x, INSERT, name, ""
            continue
        more = 1 if codes[i] & TRUNCATED else 0
        if x == "D":
            yield x, DELETE, None, None
        elif x == "K":
            state = codes[i] & 3
            yield x, more, roles[i], texts[i]
        else:
            state = turn
            yield x, REROLE + more, name, texts[i]
        i += 1
    for x in TAIL[state] if last else "":
        name = "assistant" if state == USER else "user"
        state = ASSISTANT if state == USER else USER
        yield x, INSERT, name, ""


def damage(convs: DataFrame) -> DataFrame:
    """convs with planted faults, by the crc32 of conv_id and turn: 0 of 20 rows go (``gone``), are emptied, lose their stops, come twice, or are the user's. Null texts and roles are a space."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    rows = convs.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("__fw_n"))
    return rows.withColumn("__fw_n", F.explode(F.sequence(F.lit(1), "__fw_n"))).drop("__fw_n")


def _marked(convs: DataFrame) -> DataFrame:
    """Rows with a number, a digest of role and text, whether these are blank or end without a stop, and whether an earlier row has them."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    role, text = part("role"), part("text")
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in convs.columns else F.lit(False)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    ends: Column = F.rtrim(text, F.lit(SPACE))
    rows = convs.select("conv_id", key.alias("key"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"), digest.alias("digest"), (ends == "").alias("blank"), (~F.substring(ends, -1, 1).isin(".", "!", "?")).alias("cut"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    again = rows.where(~F.col("gone")).groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    return rows.join(again, ["key", "digest"], "left").withColumn("seen", F.coalesce(place > F.col("first"), F.lit(False))).drop("first")


_SEGMENT = "key string, part int, idx int, whole boolean, codes binary, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, first_turn long, last_turn long"
_NAMES = [f.split()[0] for f in _SEGMENT.split(", ")]


class _Open:
    """A segment that is being filled."""

    def __init__(self, conv, key: str, begins: bool, idx: int = 0):
        self.conv, self.key, self.begins, self.idx = conv, key, begins, idx
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.counts, self.illegal, self.turn, self.first_turn, self.turns = [0, 0, 0], 0, None, None, 0

    def add(self, turn, role: str, text: str, blank: bool, seen: bool, cut: bool) -> None:
        fault = 0 if blank else 1 if seen else 2 if cut else 3
        if fault < 3:
            self.counts[fault] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.codes.append(STATE.get(role[:1], 0) | (GONE if fault < 2 else TRUNCATED if fault == 2 else 0))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if turn is not None and turn != self.turn:
            self.turn, self.turns = turn, self.turns + 1
            self.first_turn = turn if self.first_turn is None else self.first_turn

    def row(self, part: int, ends: bool) -> tuple:
        ends_of = (self.roles[0][:1], self.roles[-1][:1]) if self.roles else (None, None)
        return (self.conv, self.key, part, self.idx, self.begins and ends and self.idx == 0, bytes(self.codes), self.roles, self.texts, *self.counts, self.illegal, *ends_of, self.first_turn, self.turn, self.turns, self.first_turn, self.turn)


def _batch(rows: Iterable[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(conv: pa.DataType, fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([("conv_id", conv), *[(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))]])


def segments(convs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """Conversations cut into segments: codes, roles and texts of their rows, and counts; ``whole`` are those that are a conversation of their own."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, out = TaskContext.get().partitionId(), None, []
        schema = None
        for b in batches:
            schema = schema or _arrow(b.schema.field("conv_id").type, _SEGMENT)
            for conv, key, turn, role, text, gone, blank, cut, seen in zip(*[b.column(c).to_pylist() for c in ("conv_id", "key", "turn", "role", "text", "gone", "blank", "cut", "seen")], strict=True):
                if now is None or now.key != key:
                    if now:
                        out.append(now.row(part, True))
                    now = _Open(conv, key, now is not None)
                if gone:
                    continue
                if len(now.codes) >= size or now.chars >= CHARS:
                    out.append(now.row(part, False))
                    now = _Open(conv, key, now.begins, now.idx + 1)
                now.add(turn, role, text, blank, seen, cut)
            yield _batch(out, schema)
            out = []
        if now:
            yield _batch([now.row(part, False)], schema)

    order = [F.xxhash64("key"), "key", F.asc_nulls_first("turn"), "digest", "row"]
    rows = _marked(convs).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = convs.schema["conv_id"].dataType.simpleString()
    cut = rows.select("conv_id", "key", "turn", "role", "text", "gone", "blank", "cut", "seen").mapInArrow(step, f"conv_id {kind}, {_SEGMENT}")
    return materialize(cut, "segments")


def _with(df: DataFrame, drop: list[str], fields: str, make) -> DataFrame:
    """df without some columns, and what ``make`` gives for each row (as a dict)."""
    kept = [f for f in df.schema.fields if f.name not in drop]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], fields])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = {n: b.column(n).to_pylist() for n in b.schema.names}
            made = [make({n: c[i] for n, c in columns.items()}) for i in range(b.num_rows)]
            own = _arrow(pa.null(), fields)
            new = [pa.array([m[i - 1] for m in made], own.field(i).type) for i in range(1, len(own))]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *new], [*[f.name for f in kept], *own.names[1:]])

    return df.mapInArrow(step, schema)


def _folded(df: DataFrame, schema: str, fold) -> DataFrame:
    """The rows that ``fold`` makes of each conversation's segments in order: a few numbers for each segment."""
    return df.groupBy("key").applyInPandas(lambda rows: fold(rows.sort_values(["part", "idx"])), schema)


def _ahead(rows: pd.DataFrame) -> pd.DataFrame:
    out, ahead = [], AHEAD
    for cost in reversed(rows["cost"].tolist()):
        out.append((ahead, len(out) == 0))
        ahead = [min(NEVER, *(int(cost[4 * b + e]) + ahead[e] for e in range(4))) for b in range(4)]
    return rows[["key", "part", "idx"]].assign(ahead=[x for x, _ in reversed(out)], ends=[x for _, x in reversed(out)])


def _begins(rows: pd.DataFrame) -> pd.DataFrame:
    out, state = [], START
    for after in rows["after"].tolist():
        out.append(state)
        state = int(after[state])
    return rows[["key", "part", "idx"]].assign(begin=out)


def solved(convs: DataFrame, size: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """Segments with ``letters`` (their edits), ``begin`` (the last role before them) and ``ends`` (the last of its conversation): whole conversations, and those of several segments."""
    cut = segments(convs, size)
    whole = _with(cut.where("whole"), [], "letters string, begin int, ends boolean", lambda r: (Lattice(r["codes"], AHEAD).edits(START)[0], START, True))
    parts = cut.where("not whole")
    at = ["key", "part", "idx"]
    cost = _with(parts.select(*at, "codes"), ["codes"], "cost array<long>", lambda r: (costs_between(r["codes"]),))
    ahead = _folded(cost, "key string, part int, idx int, ahead array<long>, ends boolean", _ahead)

    def edits(r: dict) -> tuple:
        lattice = Lattice(r["codes"], r["ahead"])
        return tuple(zip(*[lattice.edits(b) for b in range(4)], strict=True))

    each = materialize(_with(parts.select(*at, "codes").join(ahead, at), ["codes", "ahead"], "each array<string>, after array<int>", edits), "edits")
    begin = _folded(each.select(*at, "after"), "key string, part int, idx int, begin int", _begins)
    found = parts.join(each.drop("after").join(begin, at), at)
    return whole, found.withColumn("letters", F.get("each", F.col("begin"))).select(*whole.columns)


class _Whole:
    """What a conversation comes to, from its segments in order."""

    def __init__(self, first: dict):
        self.conv, self.key = first["conv_id"], first["key"]
        self.sums, self.cost, self.letters = [0, 0, 0, 0], 0, []
        self.last, self.low, self.high, self.turns = None, None, None, 0
        self.digest, self.lines = hashlib.sha256(), 0

    def add(self, r: dict) -> None:
        self.sums = [x + r[n] for x, n in zip(self.sums, ("blank", "duplicate", "truncated", "illegal"), strict=True)]
        if r["codes"]:
            if self.last is not None and self.last + r["first"] not in LEGAL:
                self.sums[3] += 1
            self.last = r["last"]
        if r["turns"]:
            self.turns += r["turns"] - (1 if self.high == r["first_turn"] else 0)
            self.low, self.high = (r["low"] if self.low is None else self.low), r["high"]
        for letter, cost, role, text in replay(r["codes"], r["roles"], r["texts"], r["letters"], r["begin"], r["ends"]):
            self.letters.append(letter)
            self.cost += cost
            if role is not None:
                self.digest.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.sums, self.cost, "".join(self.letters), self.digest.hexdigest())


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(convs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256): a row for each conversation.

    convs has conv_id, turn, role, text, and may have ``gone`` (a row that only tells that there is
    the conversation); no other column is read. Rows go by turn, nulls first; those of one turn by the digest of
    role and text. Null roles and texts are a space, null conv_ids one conversation; repeated rows are
    duplicates. Texts without anything but white space are blank, one of any length is one
    row. A conversation without rows has zeros and the digest of nothing; an empty table has no rows.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, schema, out = None, None, []
        for b in batches:
            schema = schema or _arrow(b.schema.field("conv_id").type, _RESULT)
            for r in b.to_pylist():
                if now is None or now.key != r["key"]:
                    if now:
                        out.append(now.row())
                    now = _Whole(r)
                now.add(r)
            yield _batch(out, schema)
            out = []
        if now:
            yield _batch([now.row()], schema)

    whole, parts = solved(convs, size)
    parts = parts.repartition("key").sortWithinPartitions("key", "part", "idx")
    schema = f"conv_id {convs.schema['conv_id'].dataType.simpleString()}, {_RESULT}"
    return whole.mapInArrow(step, schema).union(parts.mapInArrow(step, schema))


def repaired_turns(convs: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(conv_id, part, idx, seq, edit, role, text): the repaired rows, each with the edit that made it; part, idx and seq order those of a conversation. See repair."""
    kind = convs.schema["conv_id"].dataType.simpleString()
    fields = "part int, idx int, seq int, edit string, role string, text string"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = _arrow(b.schema.field("conv_id").type, fields)
            yield _batch([(r["conv_id"], r["part"], r["idx"], i, x, role, text) for r in b.to_pylist() for i, (x, _, role, text) in enumerate(replay(r["codes"], r["roles"], r["texts"], r["letters"], r["begin"], r["ends"])) if role is not None], schema)

    whole, parts = solved(convs, size)
    return whole.union(parts).mapInArrow(step, f"conv_id {kind}, {fields}")
