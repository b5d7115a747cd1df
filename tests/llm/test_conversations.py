import hashlib
import random
import re
import zlib

import pytest

from trackloom.llm import conversations as cv
from trackloom.llm.conversations import STATES, damaged, line_hashes, piece_of, repair_conversations

FAULTLESS = dict(blank=False, first=True, truncated=False, n=1)


def cheapest(rows):
    """(cost, labels) by trying all edits, up to three inserts in a gap."""
    flat = [(r["role"][:1], r["blank"] or not r["first"] or c > 0, r["truncated"]) for r in rows for c in range(r["n"])]
    best = (2 * len(flat) + 1, "")

    def go(i, roles, labels, cost, inserts):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(flat) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, labels))
        if inserts < 3:
            for r in "ua":
                go(i, roles + r, labels + "I", cost + 5, inserts + 1)
        if i < len(flat):
            initial, doomed, cut = flat[i]
            go(i + 1, roles, labels + "D", cost + 2, 0)
            if not doomed:
                go(i + 1, roles + (initial or "?"), labels + "K", cost + 5 * cut, 0)
                for r in "ua":
                    go(i + 1, roles + r, labels + "R", cost + 1 + 5 * cut, 0)

    go(0, "", "", 0, 0)
    return best


def replay(labels, rows):
    """Lines that the labels leave, by the grammar alone."""
    at, state, out = 0, 0, []
    for label in labels:
        role, text = None, ""
        if label != "I":
            role, text = rows[at]
            at += 1
        if label == "D":
            continue
        if label != "K":
            role = "assistant" if state == 2 else "user"
        state = {"s": 1, "u": 2, "a": 3}[role[0]]
        out.append(f"{role}:{text}")
    return out


def plain(rows):
    """Report and hash of one conversation's (turn, role, text) rows, copies apart."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, facts, counts = set(), [], dict(blank=0, duplicate=0, truncated=0)
    for _, role, text in rows:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        facts.append(dict(role=role, blank=fault == "blank", first=fault != "duplicate", truncated=fault == "truncated", n=1))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    cost, audit = cheapest(facts)
    lines = replay(audit, [r[1:] for r in rows])
    return dict(
        counts, gaps=max(turns) - min(turns) + 1 - len(turns) if turns else 0, illegal=sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        cost=cost, audit=audit, sha=hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines=lines,
    )


def conversations(rng, n):
    out = []
    for conv in range(n):
        for turn in range(rng.randrange(1, 7)):
            t = None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hi.", "What now?", "cut off", "", " \t\n", None, "Ünsinn! ", "a b.\nc", f"t{turn}."])
            if all(o[:2] != (conv, t) or o[2] != role for o in out):  # texts of one turn and role stand in the order of a hash
                out.append((conv if conv else None, t, role, text))
    return out + [r for r in out if rng.random() < 0.1]


def test_composition_by_brute_force():
    """All ways to cut a conversation into pieces give what trying all edits gives."""
    rng = random.Random(1)
    for _ in range(300):
        rows = [
            dict(conv_id=1, turn=i, role=rng.choice(["user", "assistant", "system", "tool", ""]), blank=rng.random() < 0.1, first=rng.random() < 0.85,
                 truncated=rng.random() < 0.2, n=rng.choice([1, 1, 1, 2]), j1=i, j2=i)
            for i in range(rng.randrange(1, 6))
        ]
        cuts = [0, *sorted(rng.sample(range(1, len(rows)), rng.randrange(len(rows)))), len(rows)]
        fold = cv._Fold(1)
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            fold.add(piece_of(rows[a:b], STATES if a else (0,)) | {"piece": k})
        got = fold.result()
        assert (got["cost"], got["audit"]) == cheapest(rows)


@pytest.mark.parametrize("piece,partitions", [(1000, 4), (2, 7)])
def test_reports_and_lines_by_brute_force(spark, monkeypatch, piece, partitions):
    monkeypatch.setattr(cv, "PIECE", piece)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    rows = conversations(random.Random(piece), 60)
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id int, turn long, role string, text string, piece int")
    reports, repaired = repair_conversations(df)
    hashes = {r.conv_id: r.repaired_sha256 for r in line_hashes(repaired).collect()}
    lines = {}
    for r in sorted(repaired.collect(), key=lambda r: r["at"]):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    for r in reports.collect():
        want = plain([x[1:] for x in rows if x[0] == r.conv_id])
        assert {k: r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")} == {k: want[k] for k in want if k not in ("sha", "lines")}
        assert lines.get(r.conv_id, []) == want["lines"]
        assert hashes.get(r.conv_id, hashlib.sha256(b"").hexdigest()) == want["sha"]


def test_a_long_conversation_of_many_copies(spark, monkeypatch):
    """A conversation that holds most rows is cut; copies of one row are one row of the composition."""
    monkeypatch.setattr(cv, "PIECE", 50)
    rows = [(1, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(700)] + [(1, 9, "user", "Again.")] * 300 + [(2, 0, "user", "x")]
    reports, repaired = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in reports.collect()}
    assert got[1].duplicate == 299 and got[1].illegal == 300 and got[1].cost == 2 * 300 and len(got[1].audit) == 1000
    assert repaired.filter("conv_id = 1").count() == 700
    assert (got[2].cost, got[2].audit, got[2].truncated) == (2, "D", 1)
    assert line_hashes(repaired).first().repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows[:700]).encode()).hexdigest()


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! three?") for c in range(40) for t in (0, 1, None)] + [(None, 3, None, None)]
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
        want += [row] * (fault != 0) * (1 + (fault == 3))
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    reports, repaired = repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert reports.count() == 0 and repaired.count() == 0 and line_hashes(repaired).count() == 0
