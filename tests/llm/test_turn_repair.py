"""Conversation repair against exhaustive search and a row-by-row search; products over cut conversations."""

import hashlib
import itertools
import random
import re
import zlib
from functools import reduce

import pytest
from pyspark.sql import functions as F

from rampart.llm import turn_repair
from rampart.llm.turn_repair import ONE, cheapest, damaged, product, repair, repaired, times, turn, turns_of

GRAMMAR = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def search(letters, most=5):
    """The cheapest audit by trying all edits and all inserts, without states or matrices."""
    found = []

    def rows(k, cost, audit, roles, inserted):
        if k == len(letters):
            if GRAMMAR.fullmatch(roles):
                found.append((cost, audit))
        else:
            x = letters[k]
            rows_then(k + 1, cost + 3, audit + "D", roles, inserted)
            if x != "x":
                late = int(x.isupper())
                rows_then(k + 1, cost + late, audit + "K", roles + x.lower(), inserted)
                for r in "ua":
                    rows_then(k + 1, cost + 2 + late, audit + "R", roles + r, inserted)

    def rows_then(k, cost, audit, roles, inserted):
        for n in range(most - inserted + 1):
            for more in itertools.product("ua", repeat=n):
                rows(k, cost + 2 * n, audit + "I" * n, roles + "".join(more), inserted + n)

    rows_then(0, 0, "", "", 0)
    return min(found)


def test_cheapest_edits():
    for n in range(4):
        for letters in map("".join, itertools.product("suaUx", repeat=n)):
            assert cheapest(product(letters)) == search(letters, 4), letters
    r = random.Random(1)
    for _ in range(30):
        letters = "".join(r.choices("suaoSUAOx", k=4))
        assert cheapest(product(letters)) == search(letters, 4), letters


def test_products_in_any_tree():
    r = random.Random(2)
    for n in (1, 7, 8, 9, 40, 300):
        letters = "".join(r.choices("suaoSUAOx", k=n))
        left = reduce(times, map(turn, letters), ONE)
        cut = sorted(r.sample(range(n + 1), min(n, 3)))
        parts = [letters[a:b] for a, b in zip([0, *cut], [*cut, n])]
        right = reduce(lambda b, a: times(a, b), reversed([product(p) for p in parts]))
        assert product(letters) == left == right


def by_hand(rows, every):
    """What the operator returns, from (conv_id, turn, role, text) rows after damage, by a search over states row by row."""
    first_null = lambda v: (v is not None, v or 0)
    out = {}
    for conv in every:
        told = sorted((x for x in rows if x[0] == conv), key=lambda x: (first_null(x[1]), x[2], hashlib.md5(x[3].encode()).hexdigest()))
        turns = [x[1] for x in told if x[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds = set(), []
        for _, _, role, text in told:
            body = text.strip(" \t\n\x0b\x0c\r")
            kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
        now = {"": (0, "", ())}

        def least(into, state, way):
            if state not in into or way[:2] < into[state][:2]:
                into[state] = way

        def grow(states):
            for _ in range(4):
                for (s, r), t in step.items():
                    if r != "s" and s in states:
                        c, a, made = states[s]
                        least(states, t, (c + 2, a + "I", (*made, ({"u": "user", "a": "assistant"}[r], ""))))

        grow(now)
        for (_, _, role, text), kind in zip(told, kinds):
            then = {}
            for s, (c, a, made) in now.items():
                least(then, s, (c + 3, a + "D", made))
                if kind not in ("blank", "duplicate"):
                    late = kind == "truncated"
                    for (at, r), t in step.items():
                        if at == s and r == role[:1]:
                            least(then, t, (c + late, a + "K", (*made, (role, text))))
                        if at == s and r != "s":
                            least(then, t, (c + 2 + late, a + "R", (*made, ({"u": "user", "a": "assistant"}[r], text))))
            grow(then)
            now = then
        cost, audit, made = min((now[s] for s in ("", "a") if s in now), key=lambda w: w[:2])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(kinds.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def damage(rows):
    for conv, turn_no, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn_no is None else turn_no}".encode()) % 20
        text = " " if text is None else text
        role = "user" if h == 4 else " " if role is None else role
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        yield from [(conv, turn_no, role, text)] * (0 if h == 0 else 2 if h == 3 else 1)


def told(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


KINDS = "conv_id long, turn long, role string, text string"


def test_query_by_hand(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(turn_repair.op11_turn_repair(spark, data)) == by_hand(list(damage(rows)), {r[0] for r in rows})


def test_odd_rows(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "agent", "tool", "", None, "User"]), r.choice(["Hello.", "hi", "", " \n", None, "What?\t", "é!", "long " * 9000 + "."])) for c in [None, 5, 6, 7, 10**15] for t in [*r.choices([None, -3, 0, 1, 2, 9], k=9), None, 0]]
    rows += [(8, 0, "user", "same."), (8, 0, "user", "same."), (8, 0, "user", "same."), (9, None, None, None)]
    table = spark.createDataFrame(rows, KINDS).withColumn("copies", F.lit(9)).withColumn("audit", F.lit("x")).withColumn("seg", F.lit(1))
    got = told(repair(damaged(table), table))
    assert got == by_hand(list(damage(rows)), {r[0] for r in rows})
    assert told(repair(turns_of(table))) == by_hand([(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows], {r[0] for r in rows})
    none = table.limit(0)
    assert repair(damaged(none), none).count() == 0


def test_all_rows_gone(spark):
    gone = [(c, t) for c in range(400) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    table = spark.createDataFrame([(c, t, "user", "hi.") for c, t in gone], KINDS)
    assert told(repair(damaged(table), table)) == {c: (0, 0, 0, 0, 0, 0, "", EMPTY) for c, _ in gone}


@pytest.mark.parametrize("tasks", [1, 5, 40])
def test_a_conversation_over_many_tasks(spark, tasks):
    """One conversation with most rows is cut into segments, also amid rows of one turn; their products are the whole's."""
    r = random.Random(4)
    rows = [(1, t // 3, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "c?", ""]) + str(r.randrange(50)) * r.randrange(2)) for t in range(300)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{t}.") for c in (0, 2, 3) for t in range(4)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = told(repair(turns_of(spark.createDataFrame(rows, KINDS).repartition(4))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert got == by_hand(rows, {r[0] for r in rows})


def test_repaired_rows(spark):
    """The operator's own output: turns in order with the edit that made them."""
    turns = turns_of(spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes?"), (1, 2, "user", ""), (1, 3, "user", "More."), (2, 0, "tool", "x")], KINDS))
    audits = turn_repair.figures(turns)
    assert {x.conv_id: x.audit for x in audits.collect()} == {1: "IKKDR", 2: "D"}
    made = sorted(tuple(x) for x in repaired(turns, audits).collect())
    assert made == [(1, 0, "I", "user", ""), (1, 1, "K", "assistant", "Hi."), (1, 2, "K", "user", "Yes?"), (1, 3, "R", "assistant", "More.")]
