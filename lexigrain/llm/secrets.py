"""Secret scans: fixed patterns, and two character Markov models, in DataFrame operations only.

The models are bigram counts of random strings and of ordinary identifiers. A
long run of key characters that no pattern has found is a secret if the
log-likelihood ratio of the two models over its bigrams passes a threshold.
Both are trained from labelled samples: what the patterns find, what is left
around it, and generated strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name

#: Kind, pattern, the group that must have ``least`` characters, ``least``.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A run that the models judge, and a run that they learn from.
CANDIDATE, LEARNT = r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{4,}"
#: Documents that samples are drawn from, at most; generated strings of each form; nats that a secret needs.
ROWS, GENERATED, NATS = 5000, 2000, 12.0
#: Ordinary identifiers of kinds that prose has few of.
IDENTIFIERS = (
    "get_user_by_identifier", "max_partition_bytes", "XMLHttpRequestFactory", "application/octet-stream", "text/html", "src/main/java/org/example",
    "usr/local/share/applications", "ConcurrentHashMapBuilder", "DEFAULT_TIMEOUT_SECONDS", "shuffle-partition-count", "user_profile_settings_v2",
    "is_valid_configuration", "AbstractSingletonProxyFactory", "content-type-options", "2024-01-31", "2023-12-01-release-notes", "utf-8", "iso-8859-1",
    "========================", "------------------------", "________________________", "+++++++++++++++++++", "index_of_first_element", "onClickListenerImpl",
    "docs/reference/getting-started", "assets/images/background", "feature/improve-error-messages", "test_returns_empty_list_when_missing", "MAX_RETRIES",
    "window_function_frame_specification", "internationalization", "JavaScriptObjectNotation", "well-known-identifier", "org/apache/spark/sql/functions",
)
_LOW, _SYMBOLS = 33, 94


def _found(text: Column, pattern: str, group: int, least: int, kind: str, number: int) -> Column:
    """Array of (start, number, end, kind) of the leftmost non-overlapping matches with enough characters."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    held = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)) if group else hits
    spans = F.array().cast("array<struct<start:int,number:int,end:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(number).alias("number"), (start + x["hit"]).alias("end"), F.lit(kind).alias("kind"))
        return F.struct((start + x["hit"]).alias("at"), F.when(x["held"] >= least, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), held.alias("held"))
    walked = F.aggregate(steps, F.struct(F.lit(0).alias("at"), spans.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(text.rlike(pattern), walked).otherwise(spans)


def _bigrams(text: Column) -> Column:
    """Slots of a string's bigrams."""
    code = lambda i: F.ascii(F.substring(text, i, F.lit(1))) - _LOW
    return F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: code(i) * _SYMBOLS + code(i + 1)))


def samples(docs: DataFrame, rows: int = ROWS, generated: int = GENERATED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text``, ``label``: random strings (1) and ordinary runs (0) from at most ``rows`` documents and from rules.

    The documents are those whose ids hash least. Of what the patterns find,
    values of 12 characters or more with a digit are random; what is left of the
    text is ordinary. Generated strings are digests in hexadecimal, base 64 and
    capitals.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).alias("sample_id")).filter("sample_id IS NOT NULL").distinct().orderBy(F.xxhash64("sample_id"), "sample_id").limit(rows)
    texts = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).join(F.broadcast(cut(ids)), "sample_id").select("text")
    value = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for _, p, g, _ in BASE])
    random = texts.select(F.explode(value).alias("text")).filter((F.length("text") >= 12) & F.col("text").rlike("[0-9]"))
    rest = F.col("text")
    for _, pattern, _, _ in BASE:
        rest = F.regexp_replace(rest, pattern, " ")
    ordinary = texts.select(F.explode(F.regexp_extract_all(rest, F.lit(LEARNT), F.lit(0))).alias("text"))
    made = spark.range(generated).select(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512).alias("d"))
    base64 = F.base64(F.unhex("d"))
    made = made.select(F.explode(F.array(F.substring("d", 1, 40), F.substring(base64, 1, 40), F.regexp_replace(F.upper(F.substring(base64, 1, 60)), "[+/=]", "X"), F.regexp_replace(base64, "[+/=]", ""))).alias("text"))
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, IDENTIFIERS))).alias("text"))
    known = known.withColumn("times", F.explode(F.sequence(F.lit(1), F.lit(20)))).select("text")
    label = lambda df, y: df.select("text", F.lit(y).alias("label"))
    return label(random, 1).unionByName(label(made, 1)).unionByName(label(ordinary, 0)).unionByName(label(known, 0))


def train(labelled: DataFrame) -> DataFrame:
    """One row with ``ratios``: for each bigram the log of its odds under the two models.

    Each model's row of transitions is smoothed with one count per symbol.
    Strings of ``labelled(text, label)`` may hold printable ASCII only; others,
    nulls and those of one character are ignored.
    """
    spark = labelled.sparkSession
    clean = labelled.filter(F.col("text").rlike(r"^[\x21-\x7E]{2,}$") & F.col("label").isin(0, 1))
    pairs = clean.select("label", F.explode(_bigrams(F.col("text"))).alias("slot"))
    counts = pairs.groupBy("slot").agg(F.sum(F.col("label")).alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    dense = spark.range(_SYMBOLS * _SYMBOLS).select(F.col("id").cast("int").alias("slot")).join(counts, "slot", "left")
    dense = dense.select("slot", F.floor(F.col("slot") / _SYMBOLS).alias("first"), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n0", "n1")])
    rows = dense.groupBy("first").agg(F.sum("n0").alias("all0"), F.sum("n1").alias("all1"))
    share = lambda n, total: F.log((F.col(n) + 1) / (F.col(total) + _SYMBOLS))
    ratio = dense.join(rows, "first").select("slot", (share("n1", "all1") - share("n0", "all0")).alias("r"))
    return ratio.agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "r"))), lambda x: x["r"]).alias("ratios"))


def log_ratio(text: Column, ratios: Column) -> Column:
    """Log-likelihood ratio (nats) of a string, random against ordinary."""
    return F.aggregate(_bigrams(text), F.lit(0.0), lambda a, slot: a + F.element_at(ratios, slot + 1))


def scanned(docs: DataFrame, model: DataFrame, nats: float = NATS, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base_spans`` and ``added_spans``: arrays of (start, number, end, kind) in order.

    Places are code points, ends exclusive. ``number`` is the kind's place in
    BASE; added spans are of kind ``markov``, long runs of key characters that
    touch no base span and pass ``nats``. A null text is as an empty one; rows
    are independent, so repeated rows get the same. Columns of those two names in
    ``docs`` are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.sort_array(F.concat(*[_found(text, p, g, least, kind, i) for i, (kind, p, g, least) in enumerate(BASE)]))
    kept = [c for c in docs.columns if c not in ("base_spans", "added_spans")]
    table = free_name(docs, "ratios")
    found = docs.select(*kept, model.scalar().alias(table), base.alias("base_spans"), _found(text, CANDIDATE, 0, 1, "markov", len(BASE)).alias("added_spans"))
    free = lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    run = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    added = F.filter("added_spans", lambda s: free(s) & (log_ratio(run(s), F.col(table)) >= nats))
    return found.select(*kept, "base_spans", added.alias("added_spans"))


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
