"""Conversation repair against a plain search over whole edit scripts."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ticketlens.llm import conversation
from ticketlens.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def script(rows):
    """(cost, audit, lines) of the cheapest script with the least audit over (role, text, must go, truncated)."""
    best = {}

    def least(i, state, inserts=0):
        key = (i, state, inserts)
        if key in best:
            return best[key]
        found = []
        need = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        if inserts < 3:
            c, a, x = least(i, need, inserts + 1)
            found.append((c + 5, "I" + a, ({"u": "user:", "a": "assistant:"}[need], *x)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            c, a, x = least(i + 1, state)
            found.append((c + 2, "D" + a, x))
            if not gone:
                paid = 5 if cut else 0
                if role[:1] == need or (role[:1] == "s" and state == ""):
                    c, a, x = least(i + 1, role[:1])
                    found.append((c + paid, "K" + a, (f"{role}:{text}", *x)))
                c, a, x = least(i + 1, need)
                found.append((c + paid + 1, "R" + a, ({"u": "user", "a": "assistant"}[need] + ":" + text, *x)))
        best[key] = min(found, key=lambda f: f[:2]) if found else (10 ** 9, "", ())
        return best[key]

    for i in range(len(rows), -1, -1):      # from the end, so that the recursion stays flat
        for state in ("", "s", "u", "a"):
            for inserts in (3, 2, 1, 0):
                least(i, state, inserts)
    return least(0, "")


def hash64(text):
    return xxhash.xxh64_intdigest(text.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(text.encode(), 42) >> 63 else 0)


def brute(rows):
    """{conv: numbers} of (conv, turn, role, text) rows that are all there."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv),
                     key=lambda r: (r[0] is not None, r[0] or 0, (r[1] if r[1] is not None else " ").encode(), hash64(r[2] if r[2] is not None else " ")))
        seen, faults, marked = set(), [], []
        own = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in own]
        for _, r, x in own:
            last = re.findall(r"[^\x20\x09-\x0D]", x)
            fault = "blank" if not last else "duplicate" if (r, x) in seen else "truncated" if last[-1] not in ".!?" else ""
            seen.add((r, x))
            faults.append(fault)
            marked.append((r, x, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines = script(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False)), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def some_rows(seed, n_convs, most):
    r = random.Random(seed)
    says = ["Yes.", "No!", "Why?", "and so", "", " \t", "The same.", "Ünd dann…", "a\nb."]
    out = []
    for conv in range(n_convs):
        for turn in range(r.randrange(most + 1)):
            role = ("user", "assistant")[turn % 2] if r.random() < 0.7 else r.choice(["system", "user", "assistant", "tool", "", None, "s", "u1"])
            text = f"{r.choice(says)} {turn}." if r.random() < 0.6 else r.choice([*says, None])
            out.append((conv, None if r.random() < 0.03 else turn * r.choice([1, 1, 2]), role, text))
    return out


def digested(rows, **options):
    found = conversation.digest(conversation.repair(rows, **options))
    return {r["conv"]: tuple(r[c] for c in NUMBERS) for r in found.collect()}


@pytest.mark.parametrize(("seed", "parts", "part_rows"), [(1, 1, 4096), (2, 5, 4096), (3, 3, 4), (4, 7, 1)])
def test_repair_against_all_scripts(spark, seed, parts, part_rows):
    """Whole conversations, conversations at the edges of partitions, and conversations cut into parts of a few rows."""
    rows = some_rows(seed, 40, 9) + some_rows(seed + 100, 2, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts + 1))
    try:
        assert digested(df, part_rows=part_rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_conversation_with_most_rows_is_many_parts(spark):
    r = random.Random(9)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["Right.", f"Turn {t}.", f"cut {t}", ""])) for t in range(700)]
    rows += [(c, 0, "user", "Hello.") for c in range(20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = conversation.repair(df, part_rows=16)
    assert found.where("conv = 7").count() > 40
    got = {x["conv"]: tuple(x[c] for c in NUMBERS) for x in conversation.digest(found).collect()}
    assert got == brute(rows)


def test_one_row_repeated_is_split(spark):
    rows = [(1, 3, "user", "Again.")] * 900 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi there.")]
    found = conversation.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), part_rows=50)
    assert found.where("conv = 1").count() >= 18
    got = {x["conv"]: tuple(x[c] for c in NUMBERS) for x in conversation.digest(found).collect()}
    assert got[1][1:6] == (0, 899, 0, 899, 1800) and set(got[1][6]) == {"D"}
    assert got[2] == brute(rows[-2:])[2]


def test_registered_query_against_brute_force(spark):
    from tests.conftest import SF001

    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r[c] for c in NUMBERS) for r in QUERIES["op11_conversation_repair"](spark, SF001).collect()}
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}}
    assert got == want | brute(damage(rows))
    assert any(v[6] for v in got.values())


def test_damage_nulls_dropped_and_clashing_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (1, None, "system", "B."), (2, 0, "user", "C")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {t}!") for c in range(3, 60) for t in range(3)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA + ", conv string, part int, line int")
    got = conversation.digest(conversation.repair(conversation.damaged(df), present=F.col("present")))
    got = {r["conv"]: tuple(r[c] for c in NUMBERS) for r in got.collect()}
    want = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows}}
    assert got == want | brute(damage(rows))
    assert set(got) == {r[0] for r in rows}


def test_empty_table_long_text_and_far_turns(spark):
    assert digested(spark.createDataFrame([], SCHEMA)) == {}
    long = "word " * 2_000_000
    rows = [(1, 0, "user", long + "end."), (1, 1, "assistant", long), (2, -2 ** 63, "user", "A."), (2, 2 ** 63 - 1, "assistant", "B.")]
    got = digested(spark.createDataFrame(rows, SCHEMA))
    want = brute(rows)
    assert got[1] == want[1]
    assert got[2][0] == (want[2][0] + 2 ** 63) % 2 ** 64 - 2 ** 63 and got[2][1:] == want[2][1:]


def test_halves_meet_as_the_whole_does():
    """Divide and conquer over one lane and over many gives what one full table gives."""
    r = np.random.default_rng(3)
    size = r.integers(0, 40, 60)
    begin = np.cumsum(size) - size
    kinds = r.integers(0, 13, size.sum())
    ends = conversation.best_end(kinds, begin, size)
    piece = conversation.hirschberg(kinds, begin, size, np.zeros(60, int), ends)
    names = ["system", "user", "assistant", "tool"]
    for b, n, e in zip(begin, size, ends, strict=True):
        own = kinds[b: b + n]
        rows = [(names[k // 3], "x", k % 3 == 2, k % 3 == 1) for k in own if k != conversation.ABSENT]
        audit = "".join(conversation.PIECES[p] for p, k in zip(piece[b: b + n], own, strict=True) if k != conversation.ABSENT) + conversation._END[e][0]
        assert audit == script(rows)[1]
