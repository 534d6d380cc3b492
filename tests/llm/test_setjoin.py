import random
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrain.llm import common, setjoin


def words(line):
    for c in "\t\x0b\x0c\r":
        line = line.replace(c, " ")
    return {w for w in line.split(" ") if w}


def place(i, t, tied):
    return (-(1 << 63) if i is None else i, xxhash.xxh64_intdigest((t or "").encode(), 42) + (1 << 63) & (1 << 64) - 1 if tied else 0)


def slow(rows, a=4, b=5):
    """Of each row: its text without later lines, counts, and all earlier lines that each near one is similar to."""
    tied = len({i for i, _ in rows}) < len(rows) or any(i is None for i, _ in rows)
    lines = sorted({(*place(i, t, tied), at, line) for i, t in rows if t is not None for at, line in enumerate(t.split("\n"))})
    first, copied = {}, set()
    for *p, line in lines:
        if words(line):
            if line in first and first[line] != tuple(p):
                copied.add(tuple(p))
            first.setdefault(line, tuple(p))
    near = {}
    sets = [(p, words(line)) for line, p in first.items()]
    for p, x in sets:
        for q, y in sets:
            if p > q and b * len(x & y) >= a * len(x | y):
                near.setdefault(p, set()).add(q)
    out = {}
    for i, t in rows:
        k = place(i, t, tied)
        ls = [] if t is None else t.split("\n")
        gone = {at for at in range(len(ls)) if (*k, at) in copied or (*k, at) in near}
        here = {at: near[*k, at] for at in gone if (*k, at) in near}
        out[i, t] = (None if t is None else "\n".join(x for at, x in enumerate(ls) if at not in gone), len(ls), len(gone) - len(here), len(here)), here
    return out


def corpus():
    rng = random.Random(7)
    rare = [f"r{i}" for i in range(400)]
    common = ["the", "of", "and", "to", "a"]
    line = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n))
    pool = [line(rng.randrange(1, 30)) for _ in range(60)]
    rows = []
    for i in range(90):
        ls = []
        for _ in range(rng.randrange(1, 9)):
            x = rng.choice(pool).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                x[rng.randrange(len(x))] = rng.choice(rare + common)
            if rng.random() < 0.3:
                rng.shuffle(x)
            ls.append(rng.choice([" ", " ", "\t"]).join(x))
        rows.append((i * 3, "\n".join(ls)))
    rows += [(1, None), (2, ""), (4, "\n \n\t\n"), (None, pool[0] + "\nnew words here"), (None, pool[0] + "\nnew words here"), (7, rows[0][1]), (7, rows[0][1])]
    return rows + [(900, " ".join(f"q{i}" for i in range(3000)) + "\n" + " ".join(f"q{i}" for i in range(100, 3000)))]


@pytest.mark.parametrize("threshold", [(4, 5), (1, 2), (1, 1)])
def test_equals_brute_force(spark, threshold):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_near", F.lit("x")).withColumn("key_", F.lit(4)).withColumn("key", F.lit(5))
    got = setjoin.deduplicated(df, threshold).collect()
    want = slow(rows, *threshold)
    assert len(got) == len(rows) and got[0].key == 5
    held = defaultdict(list)
    for (i, _), v in want.items():
        held[i].append(v)
    for r in got:
        own = [here for v, here in held[r.doc_id] if v == (r.text, r.n_lines, r.n_copies, r.n_near)]
        assert any({m["at"] for m in r.matches} == set(here) and all((m["of"][0], m["of"][-1]) in {(q[0], q[2]) for q in here[m["at"]]} for m in r.matches) for here in own), r
    assert sum(v[3] for v, _ in want.values()) > 30


def test_rows_that_share_an_id_but_not_a_text(spark):
    rows = [(5, "one two three four five six\nonly here"), (5, "one two three four five six\nand more of it"), (5, "quite another line"), (6, "quite another line\none two three four five six seven")]
    got = setjoin.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = slow(rows)
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_copies, r.n_near) for r in got) == sorted((i, *v) for (i, _), (v, _) in want.items())
    assert {"only here", "and more of it"} <= {x for r in got for x in r.text.split("\n")}


def test_text_ids(spark):
    rows = [("b", "a b c d e f"), ("a", "a b c d e g"), (None, "a b c d e f g"), ("", "x"), ("a2", None)]
    got = {r.doc_id: (r.text, r.n_copies, r.n_near) for r in setjoin.deduplicated(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {None: ("a b c d e f g", 0, 0), "": ("x", 0, 0), "a": ("", 0, 1), "b": ("", 0, 1), "a2": (None, 0, 0)}


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(1500):
        line = list(base)
        for j in rng.sample(range(40), rng.randrange(0, 7)):
            line[j] = f"v{rng.randrange(3000)}"
        rows.append((i, " ".join(line) + "\n" + " ".join(f"x{rng.randrange(10**6)}" for _ in range(9))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    want = slow(rows)
    got = {r.doc_id: r for r in setjoin.deduplicated(df).collect()}
    assert {i: (r.text, r.n_lines, r.n_copies, r.n_near) for i, r in got.items()} == {i: v for (i, _), (v, _) in want.items()}


def test_small_tables_change_nothing(spark, monkeypatch):
    rows = corpus()[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    a = sorted(setjoin.deduplicated(df).drop("matches").collect())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(setjoin, "RARITY_SLOTS", 4)
    monkeypatch.setattr(setjoin, "CROWD", 1)
    monkeypatch.setattr(setjoin, "TABLE", 2)
    assert sorted(setjoin.deduplicated(df).drop("matches").collect()) == a


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.deduplicated(df).count() == 0
