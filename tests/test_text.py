import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexigrain.functions import text as X
from lexigrain.operators import corpus as C
from lexigrain.operators import lookup as K


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


SAMPLES = ["", "a", "Straße 12, é😀!", "1'000.50 x", "\n\n", "ÄÖ ü", "a  b\tc"]


def test_tokens_are_lossless(spark):
    rows = spark.createDataFrame([(s,) for s in SAMPLES], "t string")
    for r in rows.select("t", X.tokens("t").alias("a"), X.diff_tokens("t").alias("b")).collect():
        assert "".join(r.a) == r.t == "".join(r.b)


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="sßab S", max_size=20))
def test_swissify_offsets(text):
    """The law that the column function states: a place moves by the ß before it."""
    out = text.replace("ß", "ss")
    for i in range(len(text) + 1):
        assert len(text[:i].replace("ß", "ss")) == i + text[:i].count("ß") and out.startswith(text[:i].replace("ß", "ss"))
    assert out.replace("ß", "ss") == out


def test_swissify_offset_column(spark):
    text = "aßbßß c"
    for i in range(len(text) + 1):
        assert one(spark, X.swissify_offset("t", "i"), t=text, i=i) == len(text[:i].replace("ß", "ss"))


def test_ss_pairs(spark):
    for w, want in (("massstab", [2]), ("ssss", [0, 2]), ("sss", [0]), ("gross", [3]), ("a", []), ("Flussschiff", [3])):
        assert one(spark, X.ss_pairs("w"), w=w) == want == [m.start() for m in re.finditer("ss", w)]


def test_sentences(spark):
    assert one(spark, X.sentences("t"), t='Er kam. Sie ging! "So?" Ja. nein\n\nEnde') == ["Er kam.", "Sie ging!", '"So?" Ja. nein', "Ende"]
    assert one(spark, X.sentence_spans("t"), t="Ab 1.5 km. Dann?! Rest") == ["Ab 1.5 km. ", "Dann?! ", "Rest"]


def test_model_chunks(spark):
    text = "Eins zwei. Drei vier! " * 5 + "Lang" * 20 + ". Ende"
    got = one(spark, X.model_chunks("t", 60), t=text)
    assert "".join(got) == text and all(len(c) <= 60 or c.count(".") + c.count("!") <= 1 for c in got)


def test_match_case(spark):
    for w, r, want in (("VELO", "rad", "RAD"), ("Velo", "rad", "Rad"), ("velo", "rad", "rad"), ("V", "rad", "Rad")):
        assert one(spark, X.match_case("w", "r"), w=w, r=r) == want


def test_numbers(spark):
    for t, want in (("1'250'000.50", "1.250.000,50"), ("1’000", "1.000"), ("12'34", "12'34"), ("CHF 12.50", "CHF 12,50"), ("3.– Franken", "3,– Franken"), ("1.2.3", "1.2.3"), ("Fr. 5.-x", "Fr. 5,-x")):
        assert one(spark, X.prices(X.thousands("t")), t=t) == want


def test_bucket(spark):
    import hashlib

    for k in ("", "a", "example.org", "größe"):
        assert one(spark, X.bucket100("k"), k=k) == int(hashlib.md5(k.encode()).hexdigest(), 16) % 100


def test_host(spark):
    for u, want in (("https://A.Example.org:80/x?y", "a.example.org"), ("nonsense", ""), ("http://[bad", "")):
        assert one(spark, X.host("u"), u=u) == want


def test_html(spark):
    page = "<html><head><style>x{}</style><script>var a='</p>';</script></head><body><!-- no --><p>A &amp; B</p><p>C&nbsp;D &lt;x&gt;</p></body></html>"
    assert one(spark, X.html_text("h"), h=page) == "A & B C D <x>"


def test_detokenise(spark):
    assert one(spark, X.detokenise("w"), w=["Er", "kam", "(", "spät", ")", ",", "ja", "!"]) == "Er kam (spät), ja!"


def test_cascade_takes_the_first_reason(spark):
    rows = spark.createDataFrame([(1, True, True), (2, False, True), (3, None, None)], "i int, a boolean, b boolean")
    got = rows.select("i", C.cascade([("a", F.col("a")), ("b", F.col("b"))]).alias("r")).collect()
    assert [r.r for r in sorted(got)] == ["a", "b", "kept"]


def test_settled_and_ambiguous_eszett(spark):
    words = ["Strasse"] * 1 + ["Straße"] * 60 + ["Masse"] * 30 + ["Maße"] * 30 + ["Busse"] * 12 + ["Buße"] * 31
    counts = C.variant_counts(spark.createDataFrame([(w,) for w in words], "word string"), C.ESZETT)
    assert {r.form: r.is_variant for r in C.settled(counts).collect()} == {"Strasse": True}
    assert {r.form for r in C.ambiguous(counts).collect()} == {"Masse", "Busse"}
    assert {r.form: (r.rare_variant, r.factor) for r in C.repeat_factors(counts).collect()} == {"Busse": (False, 3)}
    assert {r.form for r in C.collisions(counts).collect()} == {"Masse", "Busse"}


def test_against_settled_names_the_first_word(spark):
    docs = spark.createDataFrame([(1, "Die Strasse und die Strasse"), (2, "Die Straße"), (3, None)], "doc_id long, text string")
    forms = spark.createDataFrame([("Strasse", True)], "form string, is_variant boolean")
    assert [tuple(r) for r in C.against(docs, C.ESZETT, forms).collect()] == [(1, 1, "Strasse", True)]


def test_top_per_key_with_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("if(id % 50 = 0, 'cold', 'hot') as k", "id")
    got = C.top_per_key(rows, ["k"], [F.desc("id")], 3, ["id"]).collect()
    assert {(r.k, r.id) for r in got} == {("hot", 4999), ("hot", 4998), ("hot", 4997), ("cold", 4950), ("cold", 4900), ("cold", 4850)}


def test_usable_sentence(spark):
    good = "Diese grosse Strasse führt am See entlang."
    for s, want in ((good, True), (good.upper(), False), ("Kurz, gross.", False), (good.replace("ss", "s"), False), (good + " 123456789012345678901234567890123", False), (good.replace("ss", "ẞ", 1), False)):
        assert one(spark, C.usable_sentence("s"), s=s) == want


def test_cues(spark):
    decide = K.decide(F.lit("Estrich"), [F.col("a"), F.col("b")], "Keller", "Beton")
    for a, b, want in (("Keller und Estrich", "", 1), ("Beton im Estrich", "Keller", 0), ("nichts", "Keller", 1), ("nichts", "nichts", None), ("Keller, weit davor der Estrich Beton", "", 0)):
        assert one(spark, decide, a=a, b=b) == want


def test_phrases(spark):
    rules = {"ab sofort": "sofort", "sofort": "gleich", "a.b": "x"}
    assert one(spark, K.phrases(F.col("t"), rules), t="ab sofort, sofort: a.b aab absofort") == "sofort, gleich: x aab absofort"


def test_ordered_rules(spark):
    rules = [("strass", None), ("gross", "grosso")]
    for w, want in (("Grossstrasse", "Großstraße"), ("grosso", "grosso"), ("GROSS", "GROSS"), ("Wasser", "Wasser")):
        assert one(spark, K.ordered_rules(F.col("w"), rules), w=w) == want
