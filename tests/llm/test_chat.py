import random

from pyspark.sql import functions as F

from lexigrain.llm import chat


def test_collapse_equals_brute_force(spark):
    rng = random.Random(4)
    said = ["hi", "no", "", None, "hi hi"]
    convs = {}
    for i in range(120):
        convs[i] = [(t, rng.choice(["user", "assistant", None]) if i % 7 == 0 else ["user", "assistant"][t % 2], rng.choice(said[:2] if i % 2 else said)) for t in range(rng.randrange(1, 5))]
    for i in range(120, 160):
        whole = convs[rng.randrange(120)]
        convs[i] = whole[: rng.randrange(1, len(whole) + 1)]
    convs[500] = [(0, "user", "long " * 50000), (1, "assistant", "x")]
    rows = [(i, *t) for i, c in convs.items() for t in c]
    rng.shuffle(rows)
    turns = {i: [(r, t) for _, r, t in sorted(c, key=lambda x: x[0])] for i, c in convs.items()}
    keep = {i for i, c in turns.items() if not any((len(d) > len(c) and d[: len(c)] == c) or (d == c and j < i) for j, d in turns.items())}
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("pos", F.lit(1)).withColumn("chat", F.lit("x"))
    got = {r.conv_id: (r.n_turns, r.chat) for r in chat.formatted(df).collect()}
    assert got == {i: (len(turns[i]), "".join(f"<|im_start|>{r or 'user'}\n{t or ''}<|im_end|>\n" for r, t in turns[i])) for i in keep}


def test_hard_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, None, "user", "q"), (3, 0, "user", "q"), (3, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat.formatted(df).collect()} == {None: 2, 3: 3}
    assert chat.formatted(df.limit(0)).count() == 0
