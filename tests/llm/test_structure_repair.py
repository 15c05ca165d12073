"""Structure repair against exhaustive search, a plain replay and edge cases."""

import hashlib
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from scholia.llm import structure_repair as repair


def brute_solve(signature):
    """All audits by plain recursion: the cheapest, then the ASCII-least."""
    legal = re.compile(r"(s?(ua)+)?\Z")

    @cache
    def tails(k, initials, inserted):
        out = []
        if k == len(signature):
            if legal.match(initials):
                out.append((0, ""))
        else:
            initial, fault = repair._ROW[signature[k]]
            out += [(4 + c, "D" + t) for c, t in tails(k + 1, initials, 0)]
            if fault in ("sound", "truncated"):
                m = 3 * (fault == "truncated")
                out += [(m + c, "K" + t) for c, t in tails(k + 1, initials + initial, 0)]
                out += [(3 + m + c, "R" + t) for x in "ua" for c, t in tails(k + 1, initials + x, 0)]
        if inserted < 2:
            out += [(3 + c, "I" + t) for x in "ua" for c, t in tails(k, initials + x, inserted + 1)]
        return sorted(out)[:1]

    return tails(0, "", 0)[0]


def test_audits_equal_exhaustive_search():
    rnd = random.Random(4)
    letters = "".join(repair.LETTERS.values())
    for n in range(5):
        for _ in range(15 if n else 1):
            x = "".join(rnd.choice(letters if rnd.random() < 0.4 else "uasUA") for _ in range(n))
            assert repair.solve(x) == brute_solve(x), x


def test_long_signature_needs_no_recursion():
    cost, audit = repair.solve("ua" * 20_000 + "u")
    assert cost == 3 and audit == "K" * 40_001 + "I"


def brute_conversation(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda x: (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()))
    seen, signature = set(), ""
    for _, _, r, x in rows:
        last = x.rstrip(" \t\n\x0b\f\r")[-1:]
        fault = "blank" if not last else "duplicate" if (r, x) in seen else "sound" if last in ".!?" else "truncated"
        seen.add((r, x))
        signature += repair.LETTERS[fault]["uaso".index(r[:1] if r[:1] in ("u", "a", "s") else "o")]
    cost, audit = repair.solve(signature)
    out, k, state = [], 0, "E"
    for e in audit:
        if e == "I":
            state = repair._NEXT[state]
            out.append(repair._ROLE[state] + ":")
            continue
        _, _, r, x = rows[k]
        k += 1
        if e == "K":
            state = r[0]
            out.append(f"{r}:{x}")
        elif e == "R":
            state = repair._NEXT[state]
            out.append(f"{repair._ROLE[state]}:{x}")
    turns = [t for known, t, *_ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, *repair.counted(signature), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def random_rows(seed, conversations=60):
    rnd = random.Random(seed)
    texts = ["fine.", "cut", "", " \n", None, "really?", "fine!", "é…", "x. ", "ends.\t"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool", "User", "sys"]
    return [(c if c % 7 else None, rnd.choice([None, t, t, t, rnd.randint(-3, 9)]), rnd.choice(roles), rnd.choice(texts)) for c in range(conversations) for t in range(rnd.randint(1, 7))]


def test_repair_matches_brute_force(spark):
    rows = random_rows(1) + [(1000, 5, "user", "same.")] * 40 + [(1001, None, "assistant", "x")] * 3 + [(1002, -(2**63), "user", "a."), (1002, None, "user", "b.")]
    got = {}
    for r in repair.repair(table(spark, rows).repartition(5)).collect():
        assert r["conv_id"] not in got
        got[r["conv_id"]] = tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"))
    by = {}
    for c, *rest in rows:
        by.setdefault(c, []).append(rest)
    assert got == {c: brute_conversation(x) for c, x in by.items()}


def test_long_conversation_lies_in_many_tasks(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"text {k % 900}.") for k in range(6000)] + [(2, 0, "user", "a.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["conv_id"]: r for r in repair.repair(table(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    want = brute_conversation([r[1:] for r in rows if r[0] == 1])
    assert tuple(got[1][c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) == want
    assert got[2]["audit"] == "KI"


def test_damage(spark):
    rows = random_rows(9)
    got = sorted(map(str, repair.damage(table(spark, rows)).collect()))
    want = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        m = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if m == 1 else re.sub("[.!?]", "", x) if m == 2 else x
        want += [(c, t, "user" if m == 4 else r, x)] * (0 if m == 0 else 2 if m == 3 else 1)
    assert got == sorted(str(x) for x in spark.createDataFrame(want, "conv_id long, turn long, role string, text string").collect())


def test_edges(spark):
    empty = table(spark, [])
    assert repair.repair(empty).count() == 0
    lost = repair.repair(empty, table(spark, [(7, 0, "user", "x"), (None, 0, "user", "x"), (7, 1, "user", "y")])).collect()
    assert {(r["conv_id"], r["cost"], r["audit"], r["repaired_sha256"]) for r in lost} == {(k, 0, "", hashlib.sha256(b"").hexdigest()) for k in (7, None)}
    rows = table(spark, random_rows(3, 10))
    clash = rows.withColumns({c: F.lit("x") for c in ("key", "th", "n", "fault", "first", "signature", "audit", "gaps", "kind", "id_", "one_", "null_", "letters")})
    told = lambda d: sorted(map(str, repair.repair(d).collect()))
    assert told(clash) == told(rows)
