"""Corpus statistics: counts of spelling variants, settled forms, filter cascades, splits, samples, rates.

Spelling statistics take a pluggable variant pair: ``fold`` maps a word to its
form, ``variant`` says which of the two spellings it is. The pair ss/ß is one
instance, capital and small initials another.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import saved

ColumnMap = Callable[[Column], Column]


@dataclass(frozen=True)
class Pair:
    fold: ColumnMap
    variant: ColumnMap


ESZETT = Pair(X.swissify, lambda w: w.contains("ß"))
CASE = Pair(lambda w: F.lower(w), lambda w: w == F.lower(w))


# ---- filters


def usable_sentence(s: Column | str) -> Column:
    """25 to 300 characters with ss or ß, no capital ß, not all capitals, four words, 70 % letters."""
    s = X.col(s)
    dense = F.length(F.regexp_replace(s, r"\s", ""))
    return F.length(s).between(25, 300) & (s.contains("ss") | s.contains("ß")) & ~s.contains("ẞ") & (F.upper(s) != s) & (F.size(F.regexp_extract_all(s, F.lit(r"(\S+)"), F.lit(1))) >= 4) & (X.letters(s) * 10 >= dense * 7)


def plain_sentence(s: Column | str) -> Column:
    """25 to 300 characters with a pair of ss or ß in a word, no capital ß, not all capitals."""
    s = X.col(s)
    return F.length(s).between(25, 300) & (s.contains("ss") | s.contains("ß")) & ~s.contains("ẞ") & (F.upper(s) != s) & (F.size(X.ss_words(s)) > 0)


def site_of(url: Column | str, endings: Sequence[str], marks: Sequence[str] = ()) -> Column:
    """Whether a URL's host has one of the endings, or the URL one of the marks."""
    out = F.lit(False)
    for e in endings:
        out = out | X.host(url).endswith(e)
    for m in marks:
        out = out | F.lower(X.col(url)).contains(m)
    return out


def other_spelling(text: Column | str, words: Sequence[str], without: str = "ß", least: int = 2) -> Column:
    """No ``without`` in the text, and at least ``least`` of the listed words."""
    listed = "|".join(words)
    return ~X.col(text).contains(without) & (F.regexp_count(X.col(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{listed})(?![\p{{L}}\p{{N}}_])")) >= least)


def example_sentence(s: Column | str, side: Column) -> Column:
    """30 to 260 characters, five words, no ß, from the wanted side."""
    s = X.col(s)
    return F.length(s).between(30, 260) & (F.size(F.regexp_extract_all(s, F.lit(r"(\S+)"), F.lit(1))) >= 5) & ~s.contains("ß") & side


def changing_sentence(s: Column | str, rewritten: Column) -> Column:
    """30 to 260 characters, five words, no capital ß, and a rewrite that changes it."""
    s = X.col(s)
    return F.length(s).between(30, 260) & (F.size(F.regexp_extract_all(s, F.lit(r"(\S+)"), F.lit(1))) >= 5) & ~s.contains("ẞ") & (rewritten != s)


def topic(s: Column | str, wanted: str, unwanted: str) -> Column:
    return X.col(s).rlike(wanted) & ~X.col(s).rlike(unwanted)


def meta_level(text: Column | str, strong: str, clear: str, weak: str) -> Column:
    """Whether a text is about words, for a sentence, a block and a page: a struct of three booleans.

    Different lower-case matches count, not occurrences.
    """
    s, c, w = (X.distinct_matches(text, p) for p in (strong, clear, weak))
    block = (s >= 1) | (c >= 2) | ((c >= 1) & (w >= 1))
    page = (c >= 3) | ((s >= 1) & (s + c + w >= 2))
    return F.struct((s + c >= 1).alias("sentence"), block.alias("block"), page.alias("page"))


def cascade(rules: Sequence[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first rule that holds, in order, or ``kept``."""
    out = F.lit(kept)
    for name, rule in reversed(rules):
        out = F.when(F.coalesce(rule, F.lit(False)), F.lit(name)).otherwise(out)
    return out


# ---- spelling statistics


def sentences(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``doc_id``, ``ix``, ``sentence``."""
    return docs.select(id_col, F.posexplode(X.sentences("text")).alias("ix", "sentence"))


def distinct_sentences(rows: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The first of each sentence (within ``by``) in the given order; which one stays doesn't depend on scheduling."""
    keys = [*by, "sentence"]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("first")).select(*keys, "first.*")


def words_of(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    return docs.select(*keep, F.explode(X.letter_words(text)).alias("word"))


def variant_counts(words: DataFrame, pair: Pair, *by: str) -> DataFrame:
    """``form``, ``n_plain``, ``n_variant`` (and ``by``) of a table of words."""
    w = F.col("word")
    counted = words.groupBy(*by, pair.fold(w).alias("form"))
    return counted.agg(F.count_if(~pair.variant(w)).alias("n_plain"), F.count_if(pair.variant(w)).alias("n_variant"))


def settled(counts: DataFrame, least: int = 30, share: float = 0.03) -> DataFrame:
    """Forms written one way: ``least`` times or more, the other way in at most ``share`` of all."""
    top, low = F.greatest("n_plain", "n_variant"), F.least("n_plain", "n_variant")
    return counts.filter((top >= least) & (low <= share * (top + low))).withColumn("is_variant", F.col("n_variant") > F.col("n_plain"))


def ambiguous(counts: DataFrame, least: int = 10, share: float = 0.03) -> DataFrame:
    low = F.least("n_plain", "n_variant")
    return counts.filter(low >= F.greatest(F.lit(least), share * (F.col("n_plain") + F.col("n_variant"))))


def collisions(counts: DataFrame, least: int = 3) -> DataFrame:
    return counts.filter((F.col("n_plain") >= least) & (F.col("n_variant") >= least))


def repeat_factors(counts: DataFrame, least: int = 10, most: int = 8) -> DataFrame:
    """How often rows with the rarer spelling are repeated: ``form``, ``rare_variant``, ``factor`` above 1."""
    low, top = F.least("n_plain", "n_variant"), F.greatest("n_plain", "n_variant")
    factor = F.least(F.lit(most), F.bround(top / low).cast("int"))
    return counts.filter((low >= least) & (top > low)).select("form", (F.col("n_variant") < F.col("n_plain")).alias("rare_variant"), factor.alias("factor")).filter("factor > 1")


def row_repeats(rows: DataFrame, key: str, words: DataFrame, pair: Pair, factors: DataFrame) -> DataFrame:
    """``rows`` with ``factor``: the largest of its words' factors, 1 at least."""
    w = F.col("word")
    own = words.select(key, pair.fold(w).alias("form"), pair.variant(w).alias("rare_variant"))
    best = own.join(saved(factors, "factors"), ["form", "rare_variant"]).groupBy(key).agg(F.max("factor").alias("factor"))
    return rows.join(best, key, "left").withColumn("factor", F.coalesce("factor", F.lit(1)))


def repeated(rows: DataFrame) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("factor"))))


def against(docs: DataFrame, pair: Pair, forms: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Documents that write a settled form the other way: ``doc_id``, and the first such word with its place."""
    placed = docs.select(id_col, F.posexplode(X.letter_words(text)).alias("pos", "word"))
    w = F.col("word")
    coded = placed.select(id_col, "pos", "word", pair.fold(w).alias("form"), pair.variant(w).alias("v"))
    hit = coded.join(saved(forms.select("form", "is_variant"), "forms"), "form").filter(F.col("v") != F.col("is_variant"))
    return hit.groupBy(id_col).agg(F.min_by(F.struct("word", "is_variant"), "pos").alias("first"), F.min("pos").alias("pos")).select(id_col, "pos", "first.word", "first.is_variant")


# ---- sides, rates, samples


def occurrences(sentences_: DataFrame, words: DataFrame, side: str = "side") -> DataFrame:
    """``side``, ``word``, ``n``: sentences of each side with the word, each sentence's first listed word only."""
    placed = sentences_.select(side, "key", F.posexplode(X.letter_words("sentence")).alias("pos", "word"))
    hits = placed.join(words.select("word").distinct(), "word").groupBy(side, "key").agg(F.min_by("word", "pos").alias("word"))
    return hits.groupBy(side, "word").agg(F.count("*").alias("n"))


def rates(counts: DataFrame, pages: DataFrame, sides: tuple[str, str], side: str = "side") -> DataFrame:
    """``word`` with counts and rates per page of both sides; a word that a side lacks has 0 there."""
    a, b = sides
    wide = counts.groupBy("word").pivot(side, list(sides)).agg(F.sum("n"))
    total = pages.groupBy().pivot(side, list(sides)).agg(F.sum("n")).select(F.col(a).alias("pages_a"), F.col(b).alias("pages_b"))
    first = total.first() or (None, None)
    n = [F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in sides]
    return wide.select("word", n[0].alias("n_a"), n[1].alias("n_b"), (n[0] / F.lit(float(max(1, first[0] or 0)))).alias("rate_a"), (n[1] / F.lit(float(max(1, first[1] or 0)))).alias("rate_b"))


def also_common(rated: DataFrame, least: int = 20, times: float = 5.0) -> DataFrame:
    """Capitalised words with ``least`` hits on side a that side b has less than ``times`` as often."""
    return rated.filter((F.col("n_a") >= least) & (F.col("rate_b") < times * F.col("rate_a")) & X.starts_upper("word"))


def one_sided(rated: DataFrame, times: float = 5.0) -> DataFrame:
    return rated.filter(F.col("rate_b") >= times * F.greatest(F.col("rate_a"), F.lit(1e-9)))


def top_per_key(rows: DataFrame, key: Sequence[str], order: Sequence[Column], k: int, spread: Sequence[str], parts: int = 64) -> DataFrame:
    """The first ``k`` rows of each key, with ``rank``; a hot key is ranked in ``parts`` pieces first."""
    piece = rows.withColumn("__piece", F.pmod(F.xxhash64(*spread), F.lit(parts)))
    near = piece.withColumn("__rank", F.row_number().over(Window.partitionBy(*key, "__piece").orderBy(*order))).filter(F.col("__rank") <= k)
    last = near.drop("__rank", "__piece").withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return last.filter(F.col("rank") <= k)


def sample_per_key(rows: DataFrame, key: str, row_id: Sequence[str], k: int, seed: str = "s") -> DataFrame:
    """Exactly ``k`` rows of each key (or all it has), those that hash least."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in row_id]))
    return top_per_key(rows, [key], [digest, *[F.col(c) for c in row_id]], k, row_id)


def latest_totals(events: DataFrame, group: str, member: str, time: str, value: str, tie: str) -> DataFrame:
    """Totals over the latest row of each (group, member): ``members``, ``active`` (value above 0), ``total``."""
    last = events.groupBy(group, member).agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(time, tie)).alias("x"))
    return last.groupBy(group).agg(F.count("*").alias("members"), F.count_if(F.col("x.v") > 0).alias("active"), F.sum("x.v").alias("total"))


def top_changes(pairs: DataFrame, most: int = 300) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "dst").limit(most)


def page_counts(edits: DataFrame, doc: str, page: str) -> DataFrame:
    """``doc``, ``page``, ``n``, ``kinds``: edits and different (src, dst) of each page, and of each document (page null)."""
    pairs = edits.groupBy(doc, page, "src", "dst").agg(F.count("*").alias("n"))
    per_page = pairs.groupBy(doc, page).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    whole = pairs.groupBy(doc, "src", "dst").agg(F.sum("n").alias("n")).groupBy(doc).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    return per_page.unionByName(whole.withColumn(page, F.lit(None).cast(dict(edits.dtypes)[page])))


def type_accuracy(truth: Column, guess: Column, found: Column) -> Column:
    """Aggregate: of what is rightly found, the share whose kind is right."""
    return F.round(F.count_if(found & (truth == guess)) / F.greatest(F.count_if(found), F.lit(1)), 9)


def mix_in(rows: DataFrame, others: DataFrame, k: int, key: str = "key", seed: str = "s") -> DataFrame:
    """Each row of ``rows`` with ``k`` rows of ``others``, picked by hash; ``others`` has ``n`` from 0 on."""
    total = others.agg(F.max("n")).first()[0]
    size = 0 if total is None else total + 1
    if not size:
        return rows.withColumn("pick", F.lit(None).cast("int")).join(others, F.lit(False))
    picked = rows.withColumn("pick", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"), F.col("pick").cast("string"))), 1, 12), 16, 10).cast("long")
    return picked.withColumn("n", digest % size).join(others, "n")


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``n`` from 0 in an order, without gathering them in one task: counts of ranges first.

    The ranges are written once: run again, with fewer columns, the plan gathers them in fewer tasks, and their edges come from a sample.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = saved(placed, "numbered").withColumn("__p", F.shiftright("__id", 33))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.select("__p", (F.sum("__c").over(Window.orderBy("__p")) - F.col("__c")).alias("__b"))
    return placed.join(F.broadcast(before), "__p").select(*rows.columns, (F.col("__b") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"))  # a row per partition


# ---- evaluation


def errors_per_1000(rows: DataFrame, wrong: Column, subset: Column) -> list[Column]:
    """Aggregates: errors per 1000 over all rows and over a subset."""
    return [
        F.round(1000 * F.count_if(wrong) / F.greatest(F.count("*"), F.lit(1)), 6).alias("per_1000"),
        F.round(1000 * F.count_if(wrong & subset) / F.greatest(F.count_if(subset), F.lit(1)), 6).alias("per_1000_subset"),
    ]


def precision_recall(truth: Column, guess: Column) -> list[Column]:
    """Aggregates: ``tp``, ``fp``, ``fn`` and guarded ``precision``, ``recall``, ``f1``."""
    tp, fp, fn = (F.count_if(x) for x in (truth & guess, ~truth & guess, truth & ~guess))
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    both = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(both, 9).alias("f1")]


def length_bucket(n: Column) -> Column:
    return F.when(n <= 3, "1-3").when(n <= 8, "4-8").otherwise("9+")


# ---- page nodes


def eligible(tag: Column, lang: Column, text: Column, block_lang: Column, editable: Column, wanted: str = "de") -> Column:
    """Whether a page's text node is converted: not editable, no code, no short mention, and in the wanted language.

    A node's own ``lang`` counts first; without one the language of its block.
    """
    code = tag.isin("script", "style", "noscript", "template", "code", "pre", "kbd", "samp", "textarea", "input")
    mention = tag.isin("em", "i", "q", "cite", "dfn", "abbr", "var") & (F.size(X.letter_words(text)) <= 3)
    tongue = F.lower(F.coalesce(lang, F.lit("")))
    right = F.when(tongue == "", block_lang == wanted).otherwise(tongue.startswith(wanted) | tongue.startswith("gsw"))
    return ~F.coalesce(editable, F.lit(False)) & ~code & ~mention & F.coalesce(right, F.lit(False))


def impersonal(clause: Column, verbs: Sequence[str]) -> Column:
    """Whether a clause after "es" has an impersonal verb or an indefinite article before it ends."""
    rest = F.transform(X.letter_words(F.regexp_extract(clause, r"^([^,.;:!?]*)", 1)), lambda w: F.lower(w))
    return F.exists(rest, lambda w: w.isin(*verbs) | w.rlike(r"^k?ein(?:e|en|em|er|es)?$"))


def heads(rows: DataFrame, key: str, order: str, text: str = "text", most: int = 20_000) -> DataFrame:
    """``key``, ``head``: the first ``most`` characters of a key's texts in order, what a verdict on the whole is made from."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    needed = rows.withColumn("__before", F.coalesce(F.sum(F.length(text) + 1).over(w), F.lit(0))).filter(F.col("__before") <= most)  # at most itself the break before the text is the last character
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return needed.groupBy(key).agg(F.substring(joined, 1, most).alias("head"))
