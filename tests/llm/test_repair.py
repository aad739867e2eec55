"""Conversation repair against all possible scripts, long conversations and odd rows."""

import functools
import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from flowmarrow.llm import catalog, repair

SCHEMA = "conv_id long, turn long, role string, text string, step int, edit string, gone_ int"
BLANK = " \t\n\v\f\r"


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        word = lambda v: " " if v is None else str(v)
        lot = zlib.crc32(f"{word(c)}:{word(t)}".encode()) % 20
        role, text = word(role), word(text)
        if lot == 0:
            continue
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(c, t, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def fault_of(row, earlier):
    role, text = row[2:]
    end = text.strip(BLANK)[-1:]
    return "blank" if not end else "duplicate" if (role, text) in earlier else None if end in ".!?" else "truncated"


def faults_of(rows):
    faults, earlier = [], set()
    for r in rows:
        faults.append(fault_of(r, earlier))
        earlier.add((r[2], r[3]))
    return faults


def cheapest(rows):
    """(cost, audit, repaired rows) from the last row back, with audits as strings."""
    faults = faults_of(rows)

    @functools.cache
    def rest(k, before, inserts):
        """The least script for rows k and later after the initial ``before``."""
        ways = []
        if k == len(rows) and before in ("", "a"):
            ways.append((0, "", ()))
        needed = "a" if before == "u" else "u"
        role = {"u": "user", "a": "assistant"}[needed]
        if inserts < 2:
            cost, audit, out = rest(k, needed, inserts + 1)
            ways.append((cost + 2, "I" + audit, ((role, ""), *out)))
        if k < len(rows):
            cost, audit, out = rest(k + 1, before, 0)
            ways.append((cost + 3, "D" + audit, out))
            if faults[k] not in ("blank", "duplicate"):
                more = faults[k] == "truncated"
                own, text = rows[k][2:]
                if own[:1] == needed or own[:1] == "s" and not before:
                    cost, audit, out = rest(k + 1, own[:1], 0)
                    ways.append((cost + more, "K" + audit, ((own, text), *out)))
                cost, audit, out = rest(k + 1, needed, 0)
                ways.append((cost + 2 + more, "R" + audit, ((role, text), *out)))
        return min(ways, default=(10**9, "", ()))

    return rest(0, "", 0)


def every_script(rows):
    """(cost, audit, repaired rows) by trying every script with up to two inserted rows in a place."""
    faults = faults_of(rows)
    ways = [("D",) if f in ("blank", "duplicate") else ("D", "K", "Ru", "Ra") for f in faults]
    gaps = [(), ("Iu",), ("Ia",), ("Iu", "Ia"), ("Ia", "Iu")]
    best = None
    for picks in product(*ways):
        for inserts in product(gaps, repeat=len(rows) + 1):
            steps = [x for k, g in enumerate(inserts) for x in (*g, *([(picks[k], k)] if k < len(rows) else []))]
            cost, audit, out = 0, "", []
            for x in steps:
                if isinstance(x, str):
                    cost, audit = cost + 2, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[x[1]], ""))
                else:
                    pick, k = x
                    audit += pick[0]
                    cost += {"D": 3, "K": 0, "R": 2}[pick[0]] + (pick != "D" and faults[k] == "truncated")
                    if pick != "D":
                        out.append((rows[k][2] if pick == "K" else {"u": "user", "a": "assistant"}[pick[1]], rows[k][3]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, out
    return best[0], best[1], tuple(best[2])


def test_both_plain_versions_agree():
    draw = random.Random(3)
    for _ in range(25):
        rows = [(1, k, draw.choice(["user", "assistant", "system"]), draw.choice(["A.", "b", "", "A."])) for k in range(draw.randrange(1, 4))]
        assert cheapest(rows) == every_script(rows)


def expected(rows):
    """The result row of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    faults = faults_of(rows)
    turns = {r[1] for r in rows} - {None}
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(rows)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "e", 2) for r in rows], SCHEMA)


def found(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def conversations(n, most, seed):
    draw, rows = random.Random(seed), []
    texts = ["Fine.", "so it goes", "Why?", "", " \t", None, "Fine."]
    for c in range(n):
        for k in range(draw.randrange(1, most + 1)):
            turn = draw.choice([k, k, k, None, 2 * k])
            rows.append((c, turn, draw.choice(["user", "assistant", "system", "user", None, "tool", ""]), draw.choice(texts)))
    return rows


def test_as_with_all_scripts(spark):
    rows = conversations(200, 8, 1)
    want = {}
    for c in {r[0] for r in rows}:
        want[c] = expected([tuple(" " if v is None and k > 1 else v for k, v in enumerate(r)) for r in rows if r[0] == c])
    assert found(repair.summary(frame(spark, rows))) == want


def test_the_query_on_damaged_rows(spark, tmp_path):
    rows = [r for r in conversations(300, 6, 2)] + [(None, 1, "user", "No name."), (None, 2, "assistant", "None."), (None, None, None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    after, want = plain_damage(rows), {}
    for c in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == c]
        want[c] = expected(mine) if mine else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = found(catalog.QUERIES["op11_conversation_repair"](spark, str(tmp_path)))
    assert got == want


def test_the_query_reads_every_conversation(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = found(catalog.QUERIES["op11_conversation_repair"](spark, "/root/testdata/sf0.01"))
    after = plain_damage([tuple(r) for r in rows.collect()])
    assert len(got) == rows.select("conv_id").distinct().count()
    for c in sorted(got):
        mine = [r for r in after if r[0] == c]
        assert not mine or got[c] == expected(mine)


@pytest.mark.parametrize("seed", range(4))
def test_numbers_that_settle_early_decide_alike(seed, monkeypatch):
    draw = random.Random(seed)
    rows = [(draw.choice(["user", "assistant", "system"]), draw.choice(["A.", "b", "C?", "", f"{k}."])) for k in range(400)]

    def script(width, pending):
        monkeypatch.setattr(repair, "PENDING_ROWS", pending)
        out = []
        c = repair.Conversation(1, lambda x, row, role, text: out.append((x, role, text)))
        c.script = repair.Script(width)
        seen = set()
        for k, r in enumerate(rows):
            c.add(k, *r, r in seen)
            seen.add(r)
        return c.end(), out

    whole = script(2000, 10**9)
    assert script(8, 1) == whole and script(8, 10**9) == whole and script(256, 7) == whole


def test_a_very_long_conversation_and_text(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"Turn {k}.") for k in range(20_000)] + [(2, 0, "user", "word " * 400_000), (2, 1, "assistant", "x" * 2_000_000 + ".")]
    got = found(repair.summary(frame(spark, rows)))
    assert got[1][:7] == (0, 0, 0, 0, 0, 0, "K" * 20_000)
    assert got[1][7] == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows[:20_000]).encode()).hexdigest()
    assert got[2][:7] == (0, 0, 0, 1, 0, 1, "KK")


def test_edits_give_the_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 2, "user", "  "), (2, 5, "system", "Rules."), (3, 0, "user", "Hi!"), (3, 1, "assistant", "Hi.")]
    df = frame(spark, rows)
    script = sorted((r.conv_id, r.step, r.edit, r.turn, r.fault) for r in repair.edits(df).collect())
    assert script == [(1, 0, "I", None, None), (1, 1, "K", 0, None), (1, 2, "D", 1, "duplicate"), (1, 3, "D", 2, "blank"), (2, 0, "D", 5, None), (3, 0, "K", 0, None), (3, 1, "K", 1, None)]
    out = sorted((r.conv_id, r.step, r.role, r.text) for r in repair.repaired(df).collect())
    assert out == [(1, 0, "user", ""), (1, 1, "assistant", "Hello."), (3, 0, "user", "Hi!"), (3, 1, "assistant", "Hi.")]


def test_an_empty_table(spark):
    none = frame(spark, [(1, 1, "user", "a")]).limit(0)
    assert repair.summary(none).count() == 0 and repair.edits(none).count() == 0 and repair.summary(repair.damage(none)).count() == 0
