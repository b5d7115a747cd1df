"""Repair of conversations by weighted finite-state composition.

Three machines are composed: an acceptor of the rows of a conversation, a transducer of edits (keep, rerole, delete, insert)
and an acceptor of the role sequences that are allowed. The cheapest path over weights (cost, edit labels), costs first and
then labels in ASCII order, is the repair. States of the composition are (row, grammar state) and are made as the
rows come, in topological order.

The weights form a semiring, so paths compose: a long conversation is cut into pieces of rows in order, each
piece becomes the matrix of its best paths between grammar states, and a conversation is the product of its pieces.
Of two edit strings over the same rows and of one cost neither is a prefix of the other (whatever is longer has more
inserts and costs more), so the least prefix always leads to the least whole.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Moves of the role grammar (s?(ua)+)? on role initials, and its final states.
GRAMMAR = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = range(4), (0, 3)
#: Neighbours that may stand together, costs of the edits and of a truncated row that stays.
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
WRITTEN = {"u": "user", "a": "assistant"}
#: Distinct rows of a piece.
PIECE = 1_000

Best = dict[int, tuple[int, str]]

_SPACE = r"\x20\x09-\x0D"


def blank(text: Column) -> Column:
    return ~text.rlike(f"[^{_SPACE}]")


def truncated(text: Column) -> Column:
    return ~text.rlike(rf"[.!?][{_SPACE}]*\z")


def _offer(best: Best, state: int, weight: tuple[int, str]) -> bool:
    if state in best and best[state] <= weight:
        return False
    best[state] = weight
    return True


def inserted(best: Best) -> Best:
    """The best paths, and those that go on by inserts."""
    best, open_states = dict(best), list(best)
    while open_states:
        state = open_states.pop()
        for initial in WRITTEN:
            to = GRAMMAR.get((state, initial))
            if to is not None and _offer(best, to, (best[state][0] + INSERT, best[state][1] + "I")):
                open_states.append(to)
    return best


def stepped(best: Best, initial: str, doomed: bool, cut: bool, copies: int) -> Best:
    """The best paths over one more row; further copies of it can only be deleted."""
    out: Best = {}
    extra, tail, more = TRUNCATED * cut, "D" * (copies - 1), DELETE * (copies - 1)
    for state, (cost, labels) in inserted(best).items():
        _offer(out, state, (cost + DELETE + more, labels + "D" + tail))
        if doomed:
            continue
        if (state, initial) in GRAMMAR:
            _offer(out, GRAMMAR[state, initial], (cost + extra + more, labels + "K" + tail))
        for new in WRITTEN:
            if (state, new) in GRAMMAR:
                _offer(out, GRAMMAR[state, new], (cost + REROLE + extra + more, labels + "R" + tail))
    return out


def replayed(labels: str, entry: int, rows: list[dict]) -> Iterator[tuple[dict | None, str, str]]:
    """What a path leaves: row (None if inserted), edit and role."""
    state, consumed, at = entry, 0, 0
    for label in labels:
        row = None
        if label != "I":
            row, first = rows[at], consumed == 0
            consumed += 1
            if consumed == row["n"]:
                at, consumed = at + 1, 0
            if label == "D" or not first:
                continue
        if label == "K":
            role = row["role"]
            state = GRAMMAR[state, role[:1]]
        else:
            new = next(i for i in WRITTEN if (state, i) in GRAMMAR)
            role, state = WRITTEN[new], GRAMMAR[state, new]
        yield row, label, role


_ROW = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("n", pa.int64()), ("j1", pa.int64()), ("j2", pa.int64())])
_MOVE = pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("labels", pa.string())])
_COUNTS = ("turns", "blank", "duplicate", "truncated", "illegal")
_PIECE = pa.schema(
    [("conv_id", pa.int64()), ("piece", pa.int64()), ("rows", pa.list_(_ROW)), ("moves", pa.list_(_MOVE)), *((c, pa.int64()) for c in _COUNTS)]
    + [("low", pa.int64()), ("high", pa.int64()), ("head", pa.string()), ("tail", pa.string())]
)
_PIECE_SQL = (
    "conv_id long, piece long, rows array<struct<turn:long,role:string,n:long,j1:long,j2:long>>, moves array<struct<entry:int,exit:int,cost:long,labels:string>>, "
    "turns long, blank long, duplicate long, truncated long, illegal long, low long, high long, head string, tail string"
)


def piece_of(rows: list[dict], entries: Iterable[int]) -> dict:
    """Best paths over the rows from each entry state to each exit state, and what is counted in them."""
    moves = []
    for entry in entries:
        best: Best = {entry: (0, "")}
        for r in rows:
            best = stepped(best, r["role"][:1], r["blank"] or not r["first"], r["truncated"], r["n"])
        moves += [{"entry": entry, "exit": q, "cost": c, "labels": s} for q, (c, s) in best.items()]
    turns = sorted({r["turn"] for r in rows if r["turn"] is not None})
    follow = [a["role"][:1] + b["role"][:1] for a, b in zip(rows, rows[1:])]
    return {
        "conv_id": rows[0]["conv_id"], "moves": moves, "rows": [{k: r[k] for k in ("turn", "role", "n", "j1", "j2")} for r in rows],
        "turns": len(turns), "low": turns[0] if turns else None, "high": turns[-1] if turns else None,
        "blank": sum(r["n"] for r in rows if r["blank"]), "duplicate": sum(r["n"] - r["first"] for r in rows if not r["blank"]),
        "truncated": sum(r["first"] and r["truncated"] and not r["blank"] for r in rows),
        "illegal": sum(f not in LEGAL for f in follow) + sum(r["n"] - 1 for r in rows), "head": rows[0]["role"][:1], "tail": rows[-1]["role"][:1],
    }


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the rows of a partition, which come in order; a piece doesn't span conversations."""
    number, done, rows = TaskContext.get().partitionId() << 40, [], []
    started = True  # the partition's first conversation may have begun in the partition before

    def close() -> None:
        nonlocal number, rows
        done.append(piece_of(rows, STATES if started else (0,)) | {"piece": number})
        number, rows = number + 1, []

    for batch in batches:
        for row in batch.to_pylist():
            if rows and (len(rows) == PIECE or row["conv_id"] != rows[0]["conv_id"]):
                other = row["conv_id"] != rows[0]["conv_id"]
                close()
                started = not other
            rows.append(row)
        if done:
            yield pa.RecordBatch.from_pylist(done, _PIECE)
            done.clear()
    if rows:
        close()
        yield pa.RecordBatch.from_pylist(done, _PIECE)


class _Fold:
    """The product of a conversation's pieces, as they come. What all surviving edit strings begin with is settled and put aside."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.best, self.settled = conv_id, {0: (0, "")}, []
        self.back: list[tuple[int, dict[int, tuple[int, int]]]] = []
        self.counts, self.low, self.high, self.last = dict.fromkeys(_COUNTS, 0), None, None, None

    def add(self, p: dict) -> None:
        out: Best = {}
        back: dict[int, tuple[int, int]] = {}
        for m in p["moves"]:
            if m["entry"] in self.best:
                cost, labels = self.best[m["entry"]]
                if _offer(out, m["exit"], (cost + m["cost"], labels + m["labels"])):
                    back[m["exit"]] = (m["entry"], len(m["labels"]))
        common = os.path.commonprefix([s for _, s in out.values()])
        self.settled.append(common)
        self.best = {q: (c, s[len(common) :]) for q, (c, s) in out.items()}
        self.back.append((p["piece"], back))
        for c in _COUNTS:
            self.counts[c] += p[c]
        if self.last is not None:
            self.counts["illegal"] += self.last + p["head"] not in LEGAL
        if p["low"] is not None:
            self.counts["turns"] -= self.high == p["low"]
            self.low, self.high = p["low"] if self.low is None else self.low, p["high"]
        self.last = p["tail"]

    def result(self) -> dict:
        ends = inserted(self.best)
        cost, labels = min(ends[q] for q in FINAL if q in ends)
        # The inserts at the end follow the last piece's exit.
        state = next(q for q in sorted(self.best) if any(f in (t := inserted({q: self.best[q]})) and t[f] == (cost, labels) for f in FINAL))
        trailing = len(labels) - len(self.best[state][1])
        audit, chosen, end = "".join(self.settled) + labels, [], state
        at = len(audit) - trailing
        for piece, back in reversed(self.back):
            entry, length = back[state]
            at -= length
            chosen.append({"piece": piece, "entry": entry, "exit": state, "at": at})
            state = entry
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        return {
            "conv_id": self.conv_id, "gaps": gaps, **{c: self.counts[c] for c in _COUNTS[1:]}, "cost": cost, "audit": audit,
            "chosen": chosen, "end": end, "trailing": trailing,
        }


_REPORT = pa.schema(
    [("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())]
    + [("chosen", pa.list_(pa.struct([("piece", pa.int64()), ("entry", pa.int32()), ("exit", pa.int32()), ("at", pa.int64())]))), ("end", pa.int32()), ("trailing", pa.int32())]
)
_REPORT_SQL = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "chosen array<struct<piece:long,entry:int,exit:int,at:long>>, end int, trailing int"
)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold, done = None, []
    for batch in batches:
        for p in batch.to_pylist():
            if fold is None or p["conv_id"] != fold.conv_id:
                if fold is not None:
                    done.append(fold.result())
                fold = _Fold(p["conv_id"])
            fold.add(p)
        if done:
            yield pa.RecordBatch.from_pylist(done, _REPORT)
            done.clear()
    if fold is not None:
        yield pa.RecordBatch.from_pylist([fold.result()], _REPORT)


_EDIT = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("role", pa.string()), ("edit", pa.string()), ("turn", pa.int64()), ("j1", pa.int64()), ("j2", pa.int64())])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that stay or come, each at its label's place in the audit or after the last one, in order."""
    for batch in batches:
        out = []
        for p in batch.to_pylist():
            kept = replayed(p["labels"], p["entry"], p["rows"])
            for i, (row, edit, role) in enumerate(kept):
                row = row or {"turn": None, "j1": None, "j2": None}
                out.append({"conv_id": p["conv_id"], "at": p["at"] + i, "role": role, "edit": edit, "turn": row["turn"], "j1": row["j1"], "j2": row["j2"]})
        yield pa.RecordBatch.from_pylist(out, _EDIT)


def _identity(seed: int) -> Column:
    """Half of a hash of conv_id, turn, role and text's key."""
    return F.xxhash64(F.lit(seed), F.isnull("conv_id"), "conv_id", F.isnull("turn"), "turn", "role", "k1", "k2")


def repair_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Find the cheapest edits that give every conversation an allowed sequence of roles; returns (reports, repaired).

    Needs ``conv_id``, ``turn`` (integers), ``role`` and ``text``; other columns, whatever their names, are left alone. A null role
    or text reads as one space; null conv_ids are one conversation. Rows stand by turn, nulls first, ties by role and
    then by a hash of the text, so that equal rows stand together.

    ``reports`` has a row for each conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``. A row's
    first fault counts: blank, role and text as an earlier row's, no closing mark at its end. Keep costs 0, Rerole to user or
    assistant 1, Delete 2, Insert 5; blank and repeated rows must go, and a truncated one that stays costs 5. The audit has the initials of
    the cheapest edits, of equal ones the least in ASCII order. A role without initial never fits the grammar.
    ``repaired`` has the rows that remain: ``conv_id, at, role, text, edit, turn``, ordered by ``at`` within a conversation; inserted
    rows have an empty text and no turn. An empty table gives empty results.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "conversations")
    filled = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    known = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"))
    known = known.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(7), "text"))
    known = known.withColumn("j1", _identity(1)).withColumn("j2", _identity(2))

    # Equal rows are one from here on, and the first of a role and text in a conversation is known by its identity.
    facts = [F.count("*").alias("n"), F.max(blank(F.col("text"))).alias("blank"), F.max(truncated(F.col("text"))).alias("truncated")]
    distinct = scratch.write(known.groupBy("conv_id", "turn", "role", "k1", "k2", "j1", "j2").agg(*facts), "distinct")
    firsts = distinct.groupBy("conv_id", "role", "k1", "k2").agg(F.min(F.struct(F.isnotnull("turn"), "turn", "j1", "j2")).alias("one"))
    firsts = firsts.select(F.col("one.j1").alias("j1"), F.col("one.j2").alias("j2"), F.lit(True).alias("was_first"))
    marked = distinct.join(firsts, ["j1", "j2"], "left").withColumn("first", F.isnotnull("was_first"))
    marked = scratch.write(marked.select("conv_id", "turn", "role", "j1", "j2", "n", "blank", "truncated", "first"), "marked")
    scratch.drop("distinct")

    pieces = scratch.write(marked.orderBy("conv_id", "turn", "role", "j1", "j2").mapInArrow(_pieces, _PIECE_SQL), "pieces")
    scratch.drop("marked")
    folded = pieces.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_folded, _REPORT_SQL)
    reports = scratch.write(folded, "reports")

    chosen = reports.select(F.explode("chosen").alias("c")).select("c.piece", "c.entry", "c.exit", "c.at")
    move = F.filter("moves", lambda m: (m["entry"] == F.col("entry")) & (m["exit"] == F.col("exit")))[0]["labels"]
    paths = pieces.join(chosen, "piece").select("conv_id", "rows", "entry", "at", move.alias("labels"))
    edits = paths.mapInArrow(_edits, "conv_id long, at long, role string, edit string, turn long, j1 long, j2 long")
    written = edits.filter("edit <> 'I'")
    texts = known.select("j1", "j2", "text").dropDuplicates(["j1", "j2"])
    kept = written.join(texts, ["j1", "j2"]).select("conv_id", "at", "role", "text", "edit", "turn")
    # At the end user and assistant are inserted in turns, from the exit's state on.
    turn_of = F.when((F.col("end") == 2) == (F.col("i") % 2 == 0), F.lit("assistant")).otherwise(F.lit("user"))
    ends = reports.filter("trailing > 0").select("conv_id", "end", (F.length("audit") - F.col("trailing")).alias("from"), F.explode(F.sequence(F.lit(0), F.col("trailing") - 1)).alias("i"))
    ends = ends.select("conv_id", (F.col("from") + F.col("i")).cast("long").alias("at"), turn_of.alias("role"))
    more = edits.filter("edit = 'I'").select("conv_id", "at", "role").unionByName(ends)
    more = more.select("conv_id", "at", "role", F.lit("").alias("text"), F.lit("I").alias("edit"), F.lit(None).cast("long").alias("turn"))
    return reports.drop("chosen", "end", "trailing"), kept.unionByName(more)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by a checksum of conversation and turn: some are missing, empty, cut, repeated or reroled."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace(shown("text"), "[.!?]", "")).otherwise(shown("text"))
    role = F.when(F.col("fault") == 4, F.lit("user")).otherwise(shown("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    hurt = rows.select("conv_id", "turn", "role", "text", fault.alias("fault")).filter("fault <> 0")
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A running hash of each conversation's lines; only one line is held at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv_id, state = None, None
    for batch in batches:
        ids, digests = [], []
        for r in batch.to_pylist():
            if state is None or r["conv_id"] != conv_id:
                if state is not None:
                    ids.append(conv_id)
                    digests.append(state.hexdigest())
                conv_id, state = r["conv_id"], hashlib.sha256()
            else:
                state.update(b"\n")
            state.update(f"{r['role']}:{r['text']}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pydict({"conv_id": ids, "repaired_sha256": digests}, schema)
    if state is not None:
        yield pa.RecordBatch.from_pydict({"conv_id": [conv_id], "repaired_sha256": [state.hexdigest()]}, schema)


def line_hashes(repaired: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's ``role:text`` lines, in order. A hash must read a conversation from its first line to its last."""
    lines = repaired.select("conv_id", "at", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "at")
    return lines.mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
