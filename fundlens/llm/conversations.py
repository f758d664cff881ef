"""Conversation structure repair: a persistent audit over cheapest edits, cut into segments that Spark joins."""

from __future__ import annotations

import re
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from . import kit

#: Rows and bytes of text of a segment. A conversation of more is decided segment by segment.
SEGMENT_ROWS = 1024
SEGMENT_BYTES = 4 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What a repaired conversation has so far: nothing, a system turn, a last user turn, a last assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
_BEFORE = {USER: (NOTHING, SYSTEM, ASSISTANT), ASSISTANT: (USER,), SYSTEM: (NOTHING,)}
_OF_INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_LEGAL = {"su", "ua", "au"}
_FULL = re.compile(r"[^\x20\x09-\x0D]")
_PRIME = (1 << 61) - 1


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults planted by crc32 of `conv_id:turn` modulo 20; nulls (but ids and turns) become one space.

    0 drops a row, 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats the row, 4 makes its role user.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("_k"))
    hurt = rows.where("_k <> 0").select(
        "conv_id", "turn", F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "_k",
    )
    return hurt.withColumn("_copy", F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_k", "_copy")


# -- the persistent audit -------------------------------------------------------------------------------------


class Audit:
    """Edit prefixes as linked nodes: each holds one run of an initial and points to the prefix before it.

    Prefixes that go on differently share all they have in common. Node 0 is the empty prefix. A node knows its
    ancestors 1, 2, 4, ... steps back and a rolling hash of its whole prefix.
    """

    def __init__(self):
        self.letter, self.run, self.depth, self.hash, self.up = [""], [0], [0], [0], [()]

    def extend(self, node: int, letter: str, run: int = 1) -> int:
        up, k = [node], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        self.letter.append(letter)
        self.run.append(run)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * 1_000_003 + ord(letter) * 31 + run) % _PRIME)
        self.up.append(tuple(up))
        return len(self.letter) - 1

    def lifted(self, node: int, depth: int) -> int:
        """The ancestor at a depth."""
        while self.depth[node] > depth:
            node = self.up[node][min((self.depth[node] - depth).bit_length(), len(self.up[node])) - 1]
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node] * self.run[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def less(self, x: int, y: int) -> bool:
        """Whether the prefix of x is ASCII-less than that of y: the longest common prefix is searched by hashes, then verified."""
        if x == y:
            return False
        depth = min(self.depth[x], self.depth[y])
        a, b = self.lifted(x, depth), self.lifted(y, depth)
        if self.hash[a] == self.hash[b]:  # one goes on where the other ends
            return self.depth[x] < self.depth[y] if self.same(a, b) else self.text(x) < self.text(y)
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        # a and b differ, the prefixes before them have one hash
        if not self.same(self.up[a][0], self.up[b][0]) or self.letter[a] == self.letter[b]:
            return self.text(x) < self.text(y)
        return self.letter[a] < self.letter[b]

    def same(self, a: int, b: int) -> bool:
        """Whether two prefixes of equal hash are equal; they are compared until they are one node."""
        while a != b:
            if self.letter[a] != self.letter[b] or self.run[a] != self.run[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True


class Cells:
    """The cheapest prefix into each state; of equally cheap ones the ASCII-least."""

    def __init__(self, audit: Audit, start: int = NOTHING):
        self.audit, self.best = audit, [None] * 4
        self.best[start] = (0, 0)

    def _offer(self, best: list, state: int, cost: int, node: int, letter: str) -> None:
        held = best[state]
        if held is not None and held[0] < cost:
            return
        new = self.audit.extend(node, letter)
        if held is None or cost < held[0] or self.audit.less(new, held[1]):
            best[state] = (cost, new)

    def inserted(self) -> None:
        """Turns put in here: a user turn, an assistant turn or both; more never pays."""
        old = list(self.best)
        for state in _BEFORE[USER]:
            if old[state]:
                self._offer(self.best, USER, old[state][0] + INSERT, old[state][1], "I")
        if self.best[USER]:
            self._offer(self.best, ASSISTANT, self.best[USER][0] + INSERT, self.best[USER][1], "I")

    def deleted(self, n: int) -> None:
        """n rows that have to go."""
        self.inserted()
        self.best = [c and (c[0] + DELETE * n, self.audit.extend(c[1], "D", n)) for c in self.best]

    def row(self, initial: str, truncated: bool) -> None:
        self.inserted()
        extra = TRUNCATED if truncated else 0
        new: list = [c and (c[0] + DELETE, self.audit.extend(c[1], "D")) for c in self.best]
        own = _OF_INITIAL.get(initial)
        for state in _BEFORE.get(own, ()):
            if self.best[state]:
                self._offer(new, own, self.best[state][0] + KEEP + extra, self.best[state][1], "K")
        for target in (USER, ASSISTANT):
            for state in _BEFORE[target] if target != own else ():
                if self.best[state]:
                    self._offer(new, target, self.best[state][0] + REROLE + extra, self.best[state][1], "R")
        self.best = new

    def accepted(self) -> tuple[int, int]:
        """Cost and prefix of the whole: nothing, or an assistant turn last."""
        self.inserted()
        a, b = self.best[NOTHING], self.best[ASSISTANT]
        if a is None or b is None:
            return a or b
        return b if b[0] < a[0] or (b[0] == a[0] and self.audit.less(b[1], a[1])) else a


def applied(rows: list, audit: str, state: int) -> tuple[list, int]:
    """The turns (role, text) that an audit leaves of rows (role, text, n, own), and the state reached.

    The audit and the state say all: what is put in or gets a new role is a user turn unless one came last.
    """
    out, at = [], 0
    for role, text, n, own in rows:
        while audit[at : at + 1] == "I":
            state = ASSISTANT if state == USER else USER
            out.append((ROLES[state], ""))
            at += 1
        edit = audit[at]
        if own and edit != "D":
            state = _OF_INITIAL[role[:1]] if edit == "K" else ASSISTANT if state == USER else USER
            out.append((role if edit == "K" else ROLES[state], text))
        at += 1
        if n > 1:
            # repeats go; turns put in between stay in front of them
            left = n - 1
            while left:
                while audit[at : at + 1] == "I":
                    state = ASSISTANT if state == USER else USER
                    out.append((ROLES[state], ""))
                    at += 1
                step = len(re.compile("D*").match(audit, at, at + left)[0])
                at, left = at + step, left - step
    for _ in audit[at:]:
        state = ASSISTANT if state == USER else USER
        out.append((ROLES[state], ""))
    return out, state


# -- segments -------------------------------------------------------------------------------------------------

_TURN = "struct<role:string,text:string>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "distinct"]
_SEGMENT = (
    "pid int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, distinct long, first long, last long, first_role string, last_role string, "
    f"costs array<long>, audits array<string>, kept array<{_TURN}>, rows array<struct<role:string,text:string,n:long,own:boolean>>"
)


class Segment:
    """Consecutive rows of one conversation, as far as they are read."""

    def __init__(self, starts: bool):
        self.audit = Audit()
        self.starts = starts
        self.cells = [Cells(self.audit, s) for s in ((NOTHING,) if starts else STATES)]
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.first = self.last = self.first_role = self.last_role = None
        self.rows: list = []
        self.bytes = 0

    def add(self, turn: int | None, role: str, text: str, n: int, fresh: bool) -> None:
        """n equal rows; fresh: none like them came before."""
        initial = role[:1]
        if self.last_role is None:
            self.first_role = initial
        elif self.last_role + initial not in _LEGAL:
            self.counts["illegal"] += 1
        self.counts["illegal"] += n - 1
        self.last_role = initial
        if turn is not None:
            self.counts["distinct"] += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        full = _FULL.search(text)
        own = bool(full and fresh)
        if not full:
            self.counts["blank"] += n
        else:
            self.counts["duplicate"] += n - own
        if own:
            cut = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")[-1] not in ".!?"
            self.counts["truncated"] += cut
            for c in self.cells:
                c.row(initial, cut)
        if n > own:
            for c in self.cells:
                c.deleted(n - own)
        self.rows.append((role, text if own else None, n, own))
        self.bytes += len(text)

    def record(self, ends: bool) -> tuple:
        stats = (*(self.counts[k] for k in _COUNTS), self.first, self.last, self.first_role, self.last_role)
        if self.starts and ends:
            cost, node = self.cells[0].accepted()
            audit = self.audit.text(node)
            return (True, *stats, [cost], [audit], applied(self.rows, audit, NOTHING)[0], None)
        costs, audits = [], []
        for c in self.cells:
            costs += [-1 if b is None else b[0] for b in c.best]
            audits += [None if b is None else self.audit.text(b[1]) for b in c.best]
        return (False, *stats, costs, audits, None, self.rows)


def _lists(record: tuple) -> tuple:
    """Turns and rows as mappings, as Arrow wants structs."""
    *head, kept, rows = record
    return (*head, kept and [dict(zip(("role", "text"), k, strict=True)) for k in kept] if kept is not None else None, None if rows is None else [dict(zip(("role", "text", "n", "own"), r, strict=True)) for r in rows])


def segments(turns: DataFrame, conversations: DataFrame | None = None, most: int = SEGMENT_ROWS) -> DataFrame:
    """All conversations in order of their turns, cut into segments; conversations that one task holds whole are decided."""
    spark = turns.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    clean = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    # equal rows become one with a count, so a row that comes a million times is one
    rows = clean.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).select("conv_id", "turn", "role", F.xxhash64("text").alias("h"), "text", "n")
    known: Column = F.col("turn").isNotNull()
    # where each text of a role comes first: a mark beside its row
    light = clean.select("conv_id", "turn", "role", F.xxhash64("text").alias("h"))
    marks = light.groupBy("conv_id", "role", "h").agg(F.min(F.struct(known.alias("known"), "turn")).alias("f")).select("conv_id", F.col("f.known").alias("known"), F.col("f.turn").alias("turn"), "role", "h", F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"))
    ids = clean.select("conv_id") if conversations is None else clean.select("conv_id").union(conversations.select("conv_id"))
    heads = ids.distinct().select("conv_id", F.lit(None).cast("boolean").alias("known"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("string").alias("text"), F.lit(-1).cast("long").alias("n"))
    all_rows = rows.select("conv_id", known.alias("known"), "turn", "role", "h", "text", "n").unionByName(marks).unionByName(heads)
    order = ["conv_id", "known", "turn", "role", "h"]
    ordered = all_rows.repartitionByRange(width, *order).sortWithinPartitions(*order, "n")
    kind = turns.select("conv_id").schema["conv_id"].dataType.simpleString()

    def run(batches, out):
        pid, seq = TaskContext.get().partitionId(), 0
        segment, conv, mark, found = None, None, None, []

        def written():
            columns = list(zip(*found, strict=True))
            return kit.record(out, [pa.array(c, f.type) for c, f in zip(columns, out, strict=True)])

        def close(ends):
            nonlocal seq
            found.append((conv, pid, seq, *_lists(segment.record(ends))))
            seq += 1

        for batch in batches:
            for conv_id, turn, role, h, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "h", "text", "n")), strict=True):
                if segment is None or conv_id != conv:
                    if segment is not None:
                        close(True)
                    segment, conv = Segment(starts=n == -1), conv_id
                elif len(segment.rows) >= most or segment.bytes >= SEGMENT_BYTES:
                    close(False)
                    segment = Segment(starts=False)
                if n == 0:
                    mark = (turn, role, h)
                elif n > 0:
                    segment.add(turn, role, text, n, mark == (turn, role, h))
            if len(found) >= 256:
                yield written()
                found = []
        if segment is not None:
            close(False)  # the next task may go on with it
        if found:
            yield written()

    return kit.mapped(ordered.select("conv_id", "turn", "role", "h", "text", "n"), run, f"conv_id {kind}, {_SEGMENT}")


# -- segments joined ------------------------------------------------------------------------------------------

_TOTAL = "struct<gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string>"


class Chain:
    """Prefixes of whole segments as linked nodes: each holds one segment's edits."""

    def __init__(self):
        self.piece, self.back, self.entry = [""], [0], [NOTHING]
        self.up: list[tuple] = [()]

    def extend(self, node: int, piece: str, entry: int) -> int:
        up, k = [node], 0
        while len(self.up[up[k]]) > k:
            up.append(self.up[up[k]][k])
            k += 1
        self.piece.append(piece)
        self.entry.append(entry)
        self.up.append(tuple(up))
        return len(self.piece) - 1

    def less(self, x: int, y: int) -> bool:
        """Nodes of one depth: their last common ancestor is found by doubling steps, what follows is compared."""
        a, b = x, y
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                a, b = self.up[a][k], self.up[b][k]
        stop = self.up[a][0] if a != b else a
        return "".join(self.pieces(x, stop)) < "".join(self.pieces(y, stop))

    def pieces(self, node: int, stop: int = 0) -> list[str]:
        return [self.piece[n] for n in self.path(node, stop)]

    def path(self, node: int, stop: int = 0) -> list[int]:
        out = []
        while node != stop:
            out.append(node)
            node = self.up[node][0]
        return out[::-1]


def joined(parts: list[dict]) -> list[tuple[str, int, dict | None]]:
    """For each segment of a conversation, in order: its edits, the state before it and, with the last, the totals."""
    chain, best = Chain(), [(0, 0), None, None, None]
    for part in parts:
        new: list = [None] * 4
        costs, audits = part["costs"], part["audits"]
        for i, (cost, audit) in enumerate(zip(costs, audits, strict=True)):
            entry, state = divmod(i, 4)
            if cost < 0 or best[entry] is None:
                continue
            cost += best[entry][0]
            if new[state] is None or cost <= new[state][0]:
                node = chain.extend(best[entry][1], audit, entry)
                if new[state] is None or cost < new[state][0] or chain.less(node, new[state][1]):
                    new[state] = (cost, node)
        best = new
    ends = [(b[0] + INSERT * k, chain.extend(b[1], "I" * k, s)) for s, k in ((NOTHING, 0), (NOTHING, 2), (SYSTEM, 2), (USER, 1), (ASSISTANT, 0)) if (b := best[s])]
    cost, node = ends[0]
    for c, n in ends[1:]:
        if c < cost or (c == cost and chain.less(n, node)):
            cost, node = c, n
    path = chain.path(node)
    edits = [(chain.piece[n], chain.entry[n]) for n in path]
    tail = edits.pop()[0]
    edits[-1] = (edits[-1][0] + tail, edits[-1][1])
    total = dict.fromkeys(_COUNTS, 0)
    last = role = None
    for part in parts:
        for k in _COUNTS:
            total[k] += part[k]
        if part["first"] is not None:
            total["distinct"] -= part["first"] == last
            last = part["last"]
        if part["first_role"] is not None:
            total["illegal"] += role is not None and role + part["first_role"] not in _LEGAL
            role = part["last_role"]
    first = next((p["first"] for p in parts if p["first"] is not None), None)
    totals = {"gaps": 0 if first is None else last - first + 1 - total["distinct"], **{k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": "".join(a for a, _ in edits)}
    return [(a, s, totals if i == len(edits) - 1 else None) for i, (a, s) in enumerate(edits)]


def _by_conversation(batches, columns):
    """Rows of each conversation, from batches in order; a conversation is given when the next begins."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.select(columns).to_pylist():
            if held and held[0]["conv_id"] != row["conv_id"]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def pieces(turns: DataFrame, conversations: DataFrame | None = None, most: int = SEGMENT_ROWS) -> DataFrame:
    """conv_id, pid, seq, kept (turns of the repaired conversation), total (with the last piece), whole: written once."""
    segs = kit.stored(segments(turns, conversations, most), "segments")
    spark = turns.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = turns.select("conv_id").schema["conv_id"].dataType.simpleString()
    light = ["conv_id", "pid", "seq", *_COUNTS, "first", "last", "first_role", "last_role", "costs", "audits"]

    def join(batches, out):
        for parts in _by_conversation(batches, light):
            made = joined(parts)
            yield kit.record(out, [pa.array([p["pid"] for p in parts], pa.int32()), pa.array([p["seq"] for p in parts], pa.int32()), pa.array([a for a, _, _ in made]), pa.array([s for _, s, _ in made], pa.int32()), pa.array([t for _, _, t in made], out.field("total").type)])

    open_parts = segs.where("not whole").select(*light).repartition(width, "conv_id").sortWithinPartitions("conv_id", "pid", "seq")
    picks = kit.mapped(open_parts, join, f"pid int, seq int, edits string, state int, total {_TOTAL}")
    chosen = segs.where("not whole").select("conv_id", F.col("pid").alias("_p"), F.col("seq").alias("_s"), "rows").join(picks, (F.col("pid") == F.col("_p")) & (F.col("seq") == F.col("_s")))

    def apply(batches, out):
        for batch in batches:
            kept = [
                [{"role": r, "text": t} for r, t in applied([(x["role"], x["text"], x["n"], x["own"]) for x in rows], edits, state)[0]]
                for rows, edits, state in zip(*(batch.column(c).to_pylist() for c in ("rows", "edits", "state")), strict=True)
            ]
            yield kit.record(out, [*(batch.column(c) for c in ("conv_id", "pid", "seq")), pa.array(kept, out.field("kept").type), batch.column("total")])

    long_ones = kit.mapped(chosen.select("conv_id", "pid", "seq", "rows", "edits", "state", "total"), apply, f"conv_id {kind}, pid int, seq int, kept array<{_TURN}>, total {_TOTAL}")
    gaps = F.when(F.col("first").isNull(), F.lit(0).cast("long")).otherwise(F.col("last") - F.col("first") + 1 - F.col("distinct"))
    total = F.struct(gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))
    done = segs.where("whole").select("conv_id", "pid", "seq", "kept", total.alias("total"), F.lit(True).alias("whole"))
    return done.unionByName(kit.stored(long_ones.withColumn("whole", F.lit(False)), "repaired"))


def _joined_text(kept: Column) -> Column:
    return F.array_join(F.transform(kept, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def audited(turns: DataFrame, conversations: DataFrame | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row a conversation.

    turns: conv_id, turn, role, text. Rows go by turn (nulls first), ties by role and a hash of the text, equal rows
    side by side. conversations names ones without rows too: zeros, empty audit, hash of the empty text. A null
    conv_id is a conversation of its own, null roles and texts are one space; a role without s, u or a first (an empty
    one too) fits nowhere unless it gets a new role. Empty texts are blank, repeated rows
    duplicates, long texts go whole; an empty table gives no rows.

    Rows are dealt out by range of (conversation, turn), so a conversation that holds most rows is decided by many
    tasks: each segment gives its cheapest edits from every state before it to every state behind it, and one pass over
    these tables picks the states. Only the audit and the running hash of the longest conversations, one value each by
    definition, pass through one task, segment by segment.
    """
    found = pieces(turns, conversations, segment_rows)
    spark = turns.sparkSession
    width = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = turns.select("conv_id").schema["conv_id"].dataType.simpleString()
    text = _joined_text(F.col("kept"))
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    done = found.where("whole").select("conv_id", *(F.col(f"total.{f}").alias(f) for f in fields), F.sha2(text, 256).alias("repaired_sha256"))
    rest = found.where("not whole").select("conv_id", "pid", "seq", F.size("kept").alias("n"), text.alias("text"), "total").repartition(width, "conv_id").sortWithinPartitions("conv_id", "pid", "seq")

    def run(batches, out):
        digest, begun = sha256(), False
        for batch in batches:
            rows = []
            for conv_id, n, text, total in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "text", "total")), strict=True):
                if n:
                    digest.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
                if total is not None:
                    rows.append((conv_id, *(total[f] for f in fields), digest.hexdigest()))
                    digest, begun = sha256(), False
            if rows:
                yield kit.record(out, [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)])

    return done.unionByName(kit.mapped(rest, run, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"))


def repaired_turns(turns: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """conv_id, position, role, text: the turns of the repaired conversations, positions from 0."""
    from pyspark.sql import Window as W

    found = pieces(turns, None, segment_rows)
    before = W.partitionBy("conv_id").orderBy("pid", "seq").rowsBetween(W.unboundedPreceding, -1)
    placed = found.where("whole").select("conv_id", "kept", F.lit(0).cast("long").alias("base")).unionByName(
        found.where("not whole").select("conv_id", "kept", F.coalesce(F.sum(F.size("kept")).over(before), F.lit(0)).cast("long").alias("base"))
    )
    return placed.select("conv_id", "base", F.posexplode("kept").alias("p", "t")).select("conv_id", (F.col("base") + F.col("p")).alias("position"), "t.role", "t.text")
