import random

from pyspark.sql import functions as F

from lexigrain.operators import langid as L
from lexigrain.operators import pages as P
from lexigrain.operators import spans as S
from lexigrain.sources import tables as src


def test_overlaps_equal_brute_force(spark):
    rng = random.Random(1)
    make = lambda n: [(rng.randrange(3), a, a + rng.randrange(1, 700)) for a in (rng.randrange(2000) for _ in range(n))]
    a, b = make(60), make(60)
    want = sorted((k, x, y, u, v) for k, x, y in a for j, u, v in b if j == k and x < v and u < y)
    da, db = (spark.createDataFrame(r, "k int, start int, end int") for r in (a, b))
    assert sorted(tuple(r[c] for c in ("k", "start", "end", "start2", "end2")) for r in S.overlapping(da, db, "k").collect()) == want
    assert sorted(tuple(r[c] for c in ("k", "start", "end", "start2", "end2")) for r in S.starting_in(da, db, "k").collect()) == [w for w in want if w[1] <= w[3] < w[2]]


def test_changes_rebuild_the_new_text():
    rng = random.Random(4)
    words = ["der", "die", "Haus", "Maus", ",", ".", "ist", "groß"]
    for _ in range(80):
        old = " ".join(rng.choices(words, k=rng.randrange(0, 25)))
        ws = old.split(" ")
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(ws))
            ws[i : i + rng.randrange(0, 2)] = rng.choices(words, k=rng.randrange(0, 3))
        new = " ".join(ws)
        edits = S.changes(old, new)
        back = new
        for start, end, src_, dst in reversed(edits):
            assert new[start:end] == dst
            back = back[:start] + src_ + back[end:]
        assert back == old


def test_procedures():
    assert S.split_at_hyphen(("Velo", "weg"), "Fahrradweg") == ("Fahrrad", "weg")
    assert S.split_at_hyphen(("Haus", "tür"), "Haustüre") == ("Haus", "türe")
    assert S.align("Das Haus.", ["das", "ha", "##us", "."]) == [(0, 3), (4, 6), (6, 8), (8, 9)] and S.align("Das", ["die"]) is None
    assert S.agreement(["a", "b", "c"], ["a", "x", "c"]) == [(0, 0), (2, 2)]
    listed = {"station", "weg", "netz", "anfrage"}
    assert [S.decomposes(w, listed) for w in ("station", "wegnetz", "wegsnetz", "enanfrage", "ory", "wegory")] == [True, True, True, True, False, False]
    cost = {"das": 1.5, "velo": 5.0, "steht": 3.0, "vor": 2.0, "dem": 1.8, "spital": 5.0}
    assert S.segment("DasVelostehtvordemSpital", cost) == ["Das", "Velo", "steht", "vor", "dem", "Spital"]
    assert S.segment("abc", cost) == ["abc"] and S.segment("Unbekannt", cost) == ["Unbekannt"]


def slow_segment(letters, cost, common=3.5):
    """The cheapest of all ways to cut, straight from the rules."""
    best = (cost.get(letters.lower(), 8.0 + 1.6 * len(letters)), [letters])
    for cuts in range(1, 2 ** (len(letters) - 1)):
        ends = [i + 1 for i in range(len(letters) - 1) if cuts >> i & 1]
        parts = [letters[a:b] for a, b in zip([0, *ends], [*ends, len(letters)])]
        if any(len(p) < 2 or p.lower() not in cost or (len(p) < 4 and cost[p.lower()] > common) for p in parts):
            continue
        total, fine = cost[parts[0].lower()], True
        for x, y in zip(parts, parts[1:]):
            small = not y[0].isupper()
            fine = fine and not (small and x[0].isupper() and cost[x.lower()] > common and cost[y.lower()] > common)
            total += cost[y.lower()] + 2.0 * small
        if fine and total < best[0]:
            best = (total, parts)
    return best


def test_segmentation_equals_brute_force():
    rng = random.Random(12)
    listed = ["ab", "abc", "cab", "bca", "abca", "cc", "bcab", "ca", "aab", "ccab"]
    for _ in range(120):
        cost = {w: round(rng.uniform(1, 7), 2) for w in rng.sample(listed, 7)}
        letters = "".join(rng.choice(["ab", "Ab", "c", "C", "ca", "Bca", "a"]) for _ in range(rng.randrange(3, 7)))[:12]
        if len(letters) >= 4:
            total, _ = slow_segment(letters, cost)
            got = S.segment(letters, cost)
            price = cost.get(letters.lower(), 8.0 + 1.6 * len(letters)) if got == [letters] else sum(cost[w.lower()] for w in got) + 2.0 * sum(not w[0].isupper() for w in got[1:])
            assert "".join(got) == letters and abs(price - total) < 1e-9


def test_decomposable(spark):
    rng = random.Random(2)
    listed = {"weg", "netz", "anfrage", "eis", "eisen", "bahn", "hof", "ens", "sen", "nee"}
    asked = {"wegnetz", "wegory", "Wegsnetz", "enanfrage", "s", "en", "x", "eisenbahnhofs", "wegx"} | {"".join(rng.choice(["weg", "eis", "en", "s", "bahn", "e", "n", "hof", "q"]) for _ in range(rng.randrange(1, 7))) for _ in range(150)}
    rest = spark.createDataFrame([(w,) for w in asked], "word string")
    words = spark.createDataFrame([(w,) for w in listed], "word string")
    want = {w for w in asked if S.decomposes(w.lower(), listed)}
    assert {r.word for r in S.decomposable(rest, words).collect()} == want and {"wegnetz", "eisenbahnhofs"} <= want
    assert {r.word for r in S.decomposable(rest, words.limit(0)).collect()} == {w for w in asked if S.decomposes(w, set())}


def test_language_detection(spark):
    texts = [("de", "der hund und die katze schlafen im haus und der mann geht"), ("en", "the dog and the cat sleep in the house and the man walks")] * 4
    tables = L.build(spark.createDataFrame(texts, "lang string, text string"), 50, 40)
    asked = spark.createDataFrame([(1, "der hund im haus"), (2, "the cat walks"), (3, ""), (4, "hunde")], "k int, text string")
    found = {r.k: r for r in L.verdict(L.detect(L.text_costs(asked, "k", tables), "k")).collect()}
    assert found[1].lang == "de" and found[2].lang == "en" and 3 not in found and found[4].best == "de"
    known = spark.createDataFrame([("walks",)], "word string")
    assert L.text_costs(asked, "k", tables, known=known, cap=1).filter("k = 2 AND lang = 'de'").first().cost < L.text_costs(asked, "k", tables).filter("k = 2 AND lang = 'de'").first().cost


def test_sources(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# sent_id = 1\n# text = Ein Satz.\n1\tEin\n\n# text = Noch einer.\n")
    assert [r.sentence for r in src.conllu_sentences(spark, str(tmp_path / "a.conllu")).collect()] == ["Ein Satz.", "Noch einer."]
    assert src.lines(spark, str(tmp_path / "a.conllu"), 2).count() == 2
    forms = spark.createDataFrame([("### Word\n\nVelo\n\n### Seen at\n\nhier\nund da\n",), ("### Word\n\n_No response_\n",)], "body string")
    got = src.issue_forms(forms, {"Word": "word", "Seen at": "place"}, needed="word").collect()
    assert [(r.word, r.place) for r in got] == [("Velo", "hier\nund da")]
    tagged = spark.createDataFrame([(1, ["a", "b"], ["O", "P"])], "i int, tokens array<string>, ner_tags array<string>")
    assert [(r.ix, r.token, r.tag) for r in src.tagged_tokens(tagged).collect()] == [(0, "a", "O"), (1, "b", "P")]
    rows = spark.createDataFrame([("train", "x"), ("train", "x"), ("test", "x")], "split string, sentence string")
    src.write_splits(rows, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    src.write_json(rows, str(tmp_path / "json"))
    assert src.json_lines(spark, str(tmp_path / "json"), "split string, sentence string").count() == 3
    assert src.write_once(rows, str(tmp_path / "once"), "k1") == src.write_once(rows.limit(0), str(tmp_path / "once"), "k1")
    assert spark.read.parquet(str(tmp_path / "once/k1")).count() == 3
    assert [r.sentence for r in src.sampled(rows, "sentence", 1).collect()] == ["x"]


def test_column_edges(spark):
    data = [(1, i, "t", True, x, 700.0 - 12 * i, w, 10.0) for i, (x, w) in enumerate([(50.0, 100.0), (51.0, 180.0), (300.0, 90.0), (50.0, 120.0), (302.0, 150.0)])]
    rows = spark.createDataFrame(data, "page int, ix int, str string, eol boolean, x double, y double, w double, h double")
    assert {r.line: r.edge for r in P.column_edges(P.lines(rows)).collect()} == {0: 231.0, 1: 231.0, 2: 452.0, 3: 231.0, 4: 452.0}


def test_best_kind(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 6, 9)], "k int, start int, end int")
    marks = spark.createDataFrame([(1, 0, 2, "LOC", 0.4), (1, 3, 7, "PER", 0.9)], "k int, start int, end int, kind string, p double")
    assert {r.start: (r.kind, r.p) for r in S.best_kind(spans, marks, "k").collect()} == {0: ("PER", 0.9), 6: ("PER", 0.9)}
    assert S.best_kind(spans, marks.limit(0), "k").agg(F.count("*")).first()[0] == 0


def test_foreign_runs(spark):
    w = lambda text, best="de", margin=20, held=False: (text, best, margin, held)
    gap = lambda s=" ": (s, None, 0, False)
    line = [w("eine"), gap(), w("Mass", "de", 2, True), gap(), w("effect", "en"), gap(), w("game", "en", 15), gap(), w("ist"), gap(), w("store", "en", 30), gap("."), w("nice", "en", 12), gap("\n"), w("day", "en", 12)]
    cases = {
        1: (line, [(2, 6, "en")]),
        2: ([w("one", "en", 5), gap(), w("two", "en", 5)], []),
        3: ([w("un", "fr", 15), gap(), w("deux", "fr", 15), gap("-"), w("game", "en", 50), gap(), w("set", "en", 3)], [(0, 2, "fr"), (4, 6, "en")]),
        4: ([w("a", "en", 9, True), gap(), w("b", "en", 9, True), gap(), w("c", "en", 12), gap("-"), w("d", "en", 12), gap(), w("e", "en", 9, True), gap(), w("f", "en", 30)], [(0, 6, "en")]),
        5: ([w("a", "en", 9, True), gap("-"), w("c", "en", 12), gap(), w("d", "en", 12)], [(2, 4, "en")]),
        6: ([w("a", "en", 9, True), gap("."), w("b", "en", 9, True), gap(), w("c", "en", 12), gap(), w("d", "en", 12)], [(2, 6, "en")]),
        7: ([w("a", "en", 12), gap(), w("der"), gap(), w("d", "en", 12)], []),
    }
    rows = [(k, i, *t) for k, (tokens, _) in cases.items() for i, t in enumerate(tokens)]
    got = L.runs(spark.createDataFrame(rows, "k int, ix int, s string, best string, margin int, held boolean"), "k").collect()
    assert {k: sorted((r.first, r.last, r.lang) for r in got if r.k == k) for k in cases} == {k: want for k, (_, want) in cases.items()}
