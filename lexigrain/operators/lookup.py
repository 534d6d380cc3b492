"""Lookups of words in rule tables. Prefix and suffix conditions become equi-joins on exploded parts.

Rule tables are bounded by what people write; they are written once, and Catalyst broadcasts
them by their bytes or joins them by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import saved

#: Endings of a verb.
VERB_ENDINGS = ("e", "en", "end", "ende", "endem", "enden", "ender", "endes", "et", "st", "t", "te", "tem", "ten", "ter", "tes", "test", "tet")


def small(rules: DataFrame) -> DataFrame:
    """A rule table, its plan run once; below the session's threshold of bytes the joins broadcast it."""
    return saved(rules, "rules")


def exact(words: DataFrame, rules: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with ``repl`` of ``rules(surface, repl, ord)``, in the word's case; null where none.

    A word is looked up as it is; in capitals by its folded form; with a first
    capital by its small form.
    """
    w = F.col(word)
    rules = small(rules)
    own = rules.groupBy("surface").agg(F.min_by("repl", "ord").alias("as_is"))
    folded = rules.groupBy(F.lower("surface").alias("folded_form")).agg(F.min_by("repl", "ord").alias("as_folded"))
    lowered = own.select(F.col("surface").alias("small_form"), F.col("as_is").alias("as_small"))
    first_small = F.concat(F.lower(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))
    out = words.join(own, w == F.col("surface"), "left").join(folded, F.lower(w) == F.col("folded_form"), "left").join(lowered, first_small == F.col("small_form"), "left")
    other = F.when(X.all_caps(w), F.col("as_folded")).when(X.starts_upper(w), F.col("as_small"))
    found = F.when(F.col("as_is").isNotNull(), F.col("as_is")).otherwise(other)
    return out.withColumn("repl", X.match_case(w, found)).drop("surface", "as_is", "folded_form", "as_folded", "small_form", "as_small")


def _excepted(lower: Column, pattern: Column) -> Column:
    return F.coalesce(F.regexp_like(lower, pattern), F.lit(False))


def suffix(words: DataFrame, forms: DataFrame, word: str = "word", rest: int = 3) -> DataFrame:
    """Distinct words that end with a form of ``forms(form, entry, rank, unless)`` after ``rest`` letters: the first entry, its longest form.

    Result: ``word``, ``prefix``, ``form``, ``entry``.
    """
    ends = words.select(F.col(word).alias("word")).distinct().filter(F.length("word") > rest)
    ends = ends.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("word") - rest))).withColumn("tail", F.lower(F.expr("right(word, n)")))
    hit = ends.join(small(forms.withColumn("tail", F.lower("form"))), "tail").filter(~_excepted(F.lower("word"), F.col("unless")))
    best = hit.groupBy("word").agg(F.min(F.struct("entry", "rank", "form", "n")).alias("b"))
    return best.select("word", F.expr("left(word, length(word) - b.n)").alias("prefix"), "b.form", "b.entry")


def prefix(words: DataFrame, heads: DataFrame, word: str = "word", rest: int = 3, parts: DataFrame | None = None) -> DataFrame:
    """Distinct words that begin with a head of ``heads(head, repl, unless, ord)``: the first that fits.

    ``rest`` letters must follow, the next not a capital; with ``parts(word)``
    the remainder must be made of those (see ``compounds.decomposes``).
    Result: ``word``, ``head``, ``repl``, ``remainder``.
    """
    starts = words.select(F.col(word).alias("word")).distinct().filter(F.length("word") > rest)
    starts = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.length("word") - rest))).withColumn("head", F.lower(F.expr("left(word, n)")))
    hit = starts.join(small(heads), "head").filter(~_excepted(F.lower("word"), F.col("unless")))
    hit = hit.withColumn("remainder", F.expr("substring(word, n + 1)")).filter(~X.starts_upper("remainder"))
    if parts is not None:
        hit = hit.join(parts.select(F.col("word").alias("remainder")), "remainder", "left_semi")
    best = hit.groupBy("word").agg(F.min(F.struct("ord", "head", "repl", "remainder")).alias("b"))
    return best.select("word", "b.head", "b.repl", "b.remainder")


def verbs(words: DataFrame, stems: DataFrame, word: str = "word", endings: Sequence[str] = VERB_ENDINGS) -> DataFrame:
    """Distinct words that are a stem of ``stems(stem, repl, ge, ord)`` and an ending: ``word``, ``stem``, ``plain``, ``participle``."""
    starts = words.select(F.col(word).alias("word")).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.length("word"))))
    starts = starts.withColumn("stem", F.lower(F.expr("left(word, n)"))).withColumn("end", F.lower(F.expr("substring(word, n + 1)"))).filter(F.col("end").isin(*endings))
    best = starts.join(small(stems), "stem").groupBy("word").agg(F.min(F.struct("ord", "stem", "repl", "ge", "end")).alias("b"))
    plain = F.concat("b.repl", "b.end")
    return best.select("word", "b.stem", X.match_case("word", plain).alias("plain"), X.match_case("word", F.concat("b.ge", plain)).alias("participle"))


def not_kept(words: DataFrame, kept: DataFrame, word: str = "word", least: int = 5) -> DataFrame:
    """Words that are no kept word and neither begin nor end with one of ``least`` letters or more."""
    parts = words.select(F.col(word).alias("w")).distinct().withColumn("lower", F.lower("w"))
    n = F.sequence(F.lit(least), F.greatest(F.length("lower") - 1, F.lit(least)))
    pieces = F.concat(F.array("lower"), F.when(F.length("lower") > least, F.flatten(F.transform(n, lambda i: F.array(F.substring("lower", F.lit(1), i), F.substring("lower", F.length("lower") - i + 1, i))))).otherwise(F.array().cast("array<string>")))
    hits = parts.select("w", F.explode(pieces).alias("piece")).join(small(kept.select(F.lower("word").alias("piece"))), "piece").select("w").distinct()
    return words.join(hits, words[word] == hits["w"], "left_anti")


def ordered_rules(word: Column, rules: Sequence[tuple[str, str | None]]) -> Column:
    """``word`` after ordered stem rules: in each match the first ``ss`` becomes ``ß``; exceptions see the original in small letters."""
    lower, out = F.lower(word), word
    for stem, unless in rules:
        if stem.count("ss") != 1:
            raise ValueError(f"a stem has one ss: {stem}")
        before, after = stem.split("ss")
        changed = F.regexp_replace(out, f"(?i)({before})ss({after})", "$1ß$2")
        out = F.when(lower.rlike(unless), out).otherwise(changed) if unless else changed
    return F.when(~word.contains("ss") | X.all_caps(word), word).otherwise(out)


def nearest(text: Column, word: Column, pattern: str) -> Column:
    """Distance from the word's first place to the nearest match's start; null where there is no match."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    both = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))  # the last gap has no match after it
    first = F.struct((F.call_function("locate", word, text) - 1).alias("at"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("best"))

    def step(seen: Column, x: Column) -> Column:
        start = seen["place"] + x["gap"]
        away = F.when(seen["at"] < 0, start).otherwise(F.abs(start - seen["at"]))
        best = F.when(x["hit"].isNotNull(), F.least(seen["best"], away)).otherwise(seen["best"])
        return F.struct(seen["at"].alias("at"), (start + F.coalesce(x["hit"], F.lit(0))).alias("place"), best.alias("best"))

    return F.aggregate(both, first, step, lambda seen: seen["best"])


def decide(word: Column, scopes: Sequence[Column], pro: str, contra: str) -> Column:
    """1, 0 or null: the first scope (sentence, text, surroundings) with a cue decides; of both the nearer, a tie for."""
    out = F.lit(None).cast("int")
    for text in reversed(scopes):
        a, b = text.rlike(pro), text.rlike(contra)
        both = F.when(nearest(text, word, pro) <= nearest(text, word, contra), 1).otherwise(0)
        out = F.when(a & b, both).when(a, 1).when(b, 0).otherwise(out)
    return out


def contrasted(words: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``words(key, other)`` whose other spelling stands in the text of ``texts`` as a word of its own."""
    runs = texts.select(key, F.explode(F.array_distinct(X.letter_words(F.lower("text")))).alias("other_lower"))
    return words.withColumn("other_lower", F.lower("other")).join(runs, [key, "other_lower"], "left_semi").drop("other_lower")


def german_spelling(text: Column, rules: Sequence[tuple[str, str | None]], least: int = 2) -> Column:
    """At least ``least`` ß, and more than three for each word that the rules would respell."""
    eszett = F.length(text) - F.length(F.replace(text, F.lit("ß"), F.lit("")))
    words = F.regexp_extract_all(text, F.lit(r"(\p{L}*ss\p{L}*)"), F.lit(1))
    swiss = F.size(F.filter(words, lambda w: ordered_rules(w, rules) != w))
    return (eszett >= least) & (eszett > 3 * swiss)


def signs(texts: DataFrame, listed: DataFrame, key: str = "doc_id", currency: str | None = None, wholes: Sequence[str] = (), ss: Sequence[tuple[str, str | None]] = ()) -> DataFrame:
    """``key``, ``sign``: what shows that a text is of the region, each sign once.

    Words of ``listed(sign)``, the pattern ``currency`` (one sign, however often), phrases of
    ``wholes`` as words of their own, and words that the ``ss`` rules would respell.
    """
    words = texts.select(key, F.explode(F.array_distinct(X.letter_words("text"))).alias("word"))
    out = words.withColumn("sign", F.lower("word")).join(small(listed.select(F.lower("sign").alias("sign")).distinct()), "sign").select(key, "sign")
    if currency:
        out = out.unionByName(texts.filter(F.col("text").rlike(currency)).select(key, F.lit("currency").alias("sign")))
    for phrase in wholes:
        quoted = re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", phrase)
        out = out.unionByName(texts.filter(F.col("text").rlike(rf"(?i)(?<!\p{{L}}){quoted}(?!\p{{L}})")).select(key, F.lit(phrase.lower()).alias("sign")))
    if ss:
        out = out.unionByName(words.filter(F.col("word").contains("ss") & (ordered_rules(F.col("word"), ss) != F.col("word"))).select(key, F.lower("word").alias("sign")))
    return out.distinct()


def evidence(texts: DataFrame, found: DataFrame, key: str = "doc_id", many: int = 2, short: int = 40) -> DataFrame:
    """``key``, ``n_signs``, ``n_words``, ``swiss`` of texts with the signs ``found(key, sign)``; two decide, or one in a short text."""
    hits = found.groupBy(key).agg(F.countDistinct("sign").alias("n_signs"))
    counted = texts.select(key, F.size(X.letter_words("text")).alias("n_words")).join(hits, key, "left").withColumn("n_signs", F.coalesce("n_signs", F.lit(0)))
    return counted.withColumn("swiss", (F.col("n_signs") >= many) | ((F.col("n_signs") >= 1) & (F.col("n_words") <= short)))


def held(words: DataFrame, rejects: DataFrame, key: str = "doc_id", width: int = 30, agree: int = 12) -> DataFrame:
    """Spans of ``words(key, start, end, word, before, after)`` that ``rejects(word, before, after)`` hold as they are.

    ``before`` and ``after`` of a word are the ``width`` characters at its sides. The text on both sides must agree as
    far as both go, for ``agree`` characters in all or to the ends of what was noted. How far both go follows from the
    word's own sides and the lengths that were noted, so each of those lengths is an equi-join.
    """
    noted = small(rejects.filter("before IS NOT NULL AND after IS NOT NULL").distinct())
    size = lambda c: F.least(F.length(c), F.lit(width + 1))  # noqa: E731  # beyond the width all lengths are alike
    tail = lambda c, n: F.substring(c, F.length(c) - n + 1, n)
    same = F.concat_ws("\u0001", "la", "lb", "a", "b", tail(F.col("before"), F.col("a")), F.substring("after", F.lit(1), F.col("b")), "word")
    up_to = lambda n: F.explode(F.sequence(F.lit(0), F.least(F.col(n), F.lit(width))))
    cut = noted.select("word", "before", "after", size("before").alias("la"), size("after").alias("lb")).select("*", up_to("la").alias("a")).select("*", up_to("lb").alias("b"))
    cut = cut.filter((F.col("a") + F.col("b") >= agree) | ((F.col("a") == F.col("la")) & (F.col("b") == F.col("lb"))))
    lengths = noted.select(size("before").alias("la"), size("after").alias("lb")).distinct()  # (width + 2)² at most
    asked = words.join(F.broadcast(lengths)).withColumn("a", F.least(F.length("before"), "la")).withColumn("b", F.least(F.length("after"), "lb"))
    asked = asked.filter((F.col("a") + F.col("b") >= agree) | ((F.col("a") == F.col("la")) & (F.col("b") == F.col("lb")))).select(key, "start", "end", same.alias("same"))
    found = asked.join(cut.select(same.alias("same")).distinct(), "same", "left_semi")
    return found.select(key, "start", "end", F.substring_index("same", "\u0001", -1).alias("word")).distinct()


def phrases(text: Column, rules: dict[str, str]) -> Column:
    """Whole-word phrases replaced, longest first, each place once."""
    if not rules:
        return text
    quoted = sorted(rules, key=lambda p: (-len(p), p))
    either = "|".join(re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", p) for p in quoted)
    pattern = rf"(?<!\p{{L}})(?:{either})(?!\p{{L}})"
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    table = F.create_map(*[F.lit(x) for kv in rules.items() for x in kv])
    new = F.concat(F.transform(hits, lambda h: F.element_at(table, h)), F.array(F.lit("")))
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(g, n)), "")).otherwise(text)


def reverse(words: DataFrame, pairs: DataFrame, seed: str = "r", word: str = "word", rest: int = 3) -> DataFrame:
    """Target words mapped back: ``word``, ``source``, ``how`` (exact, suffix or head).

    ``pairs(target, source)`` may name several sources of one target; which one a
    word gets is picked by hash. Longest target first; the remainder of ``rest``
    letters or more stays.
    """
    listed = small(pairs.groupBy("target").agg(F.sort_array(F.collect_set("source")).alias("sources")))
    own = words.select(F.col(word).alias("word")).distinct().withColumn("n", F.explode(F.sequence(F.lit(1), F.length("word"))))
    tail = own.select("word", F.expr("right(word, n)").alias("part"), F.expr("left(word, length(word) - n)").alias("other"), F.when(F.col("n") == F.length("word"), 0).otherwise(1).alias("rank"))
    head = own.filter(F.col("n") < F.length("word")).select("word", F.expr("left(word, n)").alias("part"), F.expr("substring(word, n + 1)").alias("other"), F.lit(2).alias("rank"))
    cut = tail.unionByName(head).filter((F.col("rank") == 0) | (F.length("other") >= rest)).withColumn("key", F.lower("part"))
    hit = cut.join(listed.withColumn("key", F.lower("target")), "key")
    best = hit.groupBy("word").agg(F.min(F.struct("rank", (-F.length("part")).alias("n"), "sources", "other", "part")).alias("b"))
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "word")), 1, 8), 16, 10).cast("long")
    chosen = F.element_at("b.sources", (digest % F.size("b.sources") + 1).cast("int"))
    joined = F.when(F.col("b.rank") == 0, X.match_case("word", chosen)).when(F.col("b.rank") == 1, F.concat("b.other", F.lower(chosen))).otherwise(F.concat(X.match_case("b.part", chosen), "b.other"))
    return best.select("word", joined.alias("source"), F.element_at(F.array(*map(F.lit, ("exact", "suffix", "head"))), F.col("b.rank") + 1).alias("how"))


def cascade(words: DataFrame, listed: DataFrame, forms: DataFrame, heads: DataFrame, word: str = "word", rest: int = 3) -> DataFrame:
    """Distinct words that are of the region: ``word``, ``how`` (exact, suffix or head), ``entry``.

    A word of ``listed(surface, entry)`` in any case comes first, then one that ends with a form of
    ``forms``, then one that begins with a head of ``heads``, both with ``rest`` letters more.
    """
    asked = words.select(F.col(word).alias("word")).distinct()
    own = small(listed.groupBy(F.lower("surface").alias("key")).agg(F.min("entry").alias("entry")))
    found = [asked.withColumn("key", F.lower("word")).join(own, "key").select("word", F.lit(0).alias("step"), F.col("entry").cast("int").alias("entry"))]
    found.append(suffix(asked, forms, rest=rest).select("word", F.lit(1).alias("step"), F.col("entry").cast("int").alias("entry")))
    found.append(prefix(asked, heads, rest=rest).join(small(heads.select("head", "ord")), "head").select("word", F.lit(2).alias("step"), F.col("ord").cast("int").alias("entry")))
    every = found[0].unionByName(found[1]).unionByName(found[2]).groupBy("word").agg(F.min(F.struct("step", "entry")).alias("b"))
    return every.select("word", F.element_at(F.array(*map(F.lit, ("exact", "suffix", "head"))), F.col("b.step") + 1).alias("how"), "b.entry")
