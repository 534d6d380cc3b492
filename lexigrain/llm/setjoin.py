"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its words. Lines equal to an earlier line go first (by a
128-bit hash). For the rest every set is ordered by rarity and two sets can only
reach the threshold if they share a word among their first few (prefix filter),
are of like sizes (length filter) and have enough words left after the first
shared one (positional filter). A parity map of 128 bits, in which each word flips one
bit, bounds the size of the symmetric difference and drops chance meetings.
Survivors are verified on the words themselves; of two similar lines the later
one goes.

A later line needs one earlier match, not all of them, so a group of near copies is
not paired whole. Lines that share two neighbouring prefix words with many others meet
some of these first; that finds a match for nearly every line of a large group. What has
none yet meets every earlier line of all its prefix words, so no line goes unmatched that
has a match.

Words are ordered by 51 bits of a 64-bit hash, whose high bits then hold the
word's rarity class. The classes are a table of fixed size (a word shares its
count with others of the same slot); the order need not be exact for exact
results, it only has to be one order for all sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, free_name, light, release, saved, shared_folder

#: Jaccard threshold as a fraction.
THRESHOLD = (4, 5)
#: Slots of the rarity table, a bound of what goes to the driver and to each task.
RARITY_SLOTS = 1 << 16
#: Pairs of neighbouring prefix words of a line that are looked at for crowds (those of the least hashes); a crowd's least size, and how many of it meet at once.
KEYS, CROWD, TABLE = 4, 8, 16
_WORD = "[^\\x20\\x09-\\x0D]"
#: The rarity class of a word said once (it has no match), and the place of the class in a word's code.
_ONCE, _CLASS = 4, 51


def _parts(line: Column) -> Column:
    """What lies between white space (five ASCII characters and the line's end); some of it is empty."""
    odd = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c"))
    return F.split(F.when(odd, F.translate(line, "\t\x0b\x0c\r", "    ")).otherwise(line), " ")


def _words(line: Column) -> Column:
    return F.array_remove(F.array_distinct(_parts(line)), "")


def _hashes(line: Column) -> Column:
    """Distinct 64-bit hashes of a line's words."""
    return F.array_remove(F.array_distinct(F.transform(_parts(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _shift(bit: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))


def rarity(docs: DataFrame) -> Column:
    """The rarity class (0 to 127, rarest first) of each slot, as an array, from all words of the documents."""
    words = docs.select(F.explode(_parts(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w"))
    slots = words.select(F.xxhash64("w").bitwiseAND(F.lit(RARITY_SLOTS - 1)).cast("int").alias("slot"))
    table = [0] * RARITY_SLOTS
    for r in slots.groupBy("slot").agg(F.least(F.lit(127), F.floor(F.log2(F.count("*") + 1) * 4)).cast("int").alias("c")).collect():  # one row per slot at most
        table[r.slot] = r.c
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")  # folded to a constant


def _need(n: Column, m: Column, threshold: tuple[int, int]) -> Column:
    """Words that sets of ``n`` and ``m`` must share."""
    a, b = threshold
    return F.floor(((n + m) * a + (a + b - 1)) / (a + b))


class _Place:
    """The columns that name a line and order all lines: id, then the text's hash where ids don't tell rows apart, then the number in the text."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        rows = docs.groupBy(id_col).count()
        self.tied = tied = bool(rows.filter((F.col("count") > 1) | F.col(id_col).isNull()).head(1))
        whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
        key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))) if whole else F.coalesce(F.concat(F.lit("="), F.col(id_col).cast("string")), F.lit(""))
        self.row = {"key": key} | ({"tie": F.xxhash64(text_col)} if tied else {})
        self.doc = list(self.row)
        self.line = [*self.doc, "at"]
        self.other = [f"{c}2" for c in self.line]

    def later(self, x: str, y: str) -> Column:
        out, same = F.lit(False), F.lit(True)
        for c in self.line:
            a, b = F.col(f"{x}.{c}"), F.col(f"{y}.{c}")
            out, same = out | (same & (a > b)), same & (a == b)
        return out


def _lines(docs: DataFrame, p: _Place) -> DataFrame:
    """Each line that has a word."""
    return docs.select(*p.doc, F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(F.col("line").rlike(_WORD))


def _hashed() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")]


def heads(docs: DataFrame, p: _Place, threshold: tuple[int, int]) -> DataFrame:
    """Each line's place; ``copy``, whether it equals an earlier one; if not, what candidates are found by: ``n``, ``even``, ``odd`` and ``first`` (size, the halves of the parity map, prefix)."""
    a, b = threshold
    lines = _lines(docs, p)
    groups = lines.select(*p.line, *_hashed()).groupBy("h1", "h2").agg(F.min(F.struct(*p.line)).alias("least"), F.count("*").alias("held"))
    again = saved(groups.filter("held > 1").select("h1", "h2", "least"), shared_folder(docs.sparkSession, "again"))
    classes = rarity(docs)
    rank = lambda h: F.get(classes, h.bitwiseAND(F.lit(RARITY_SLOTS - 1)).cast("int"))
    code = lambda h: F.shiftleft(rank(h), _CLASS).bitwiseOR(F.shiftrightunsigned(h, 64 - _CLASS))
    told = lines.select(*p.line, "line", *_hashed()).join(light(again), ["h1", "h2"], "left")
    copy = F.coalesce(F.struct(*p.line) != F.col("least"), F.lit(False))
    sets = told.select(*p.line, copy.alias("copy"), "line").select(*p.line, "copy", F.when(~F.col("copy"), F.sort_array(F.transform(_hashes(F.col("line")), code))).alias("words")).withColumn("n", F.size("words"))
    prefix = F.slice("words", F.lit(1), F.col("n") - F.floor((F.col("n") * a + (b - 1)) / b).cast("int") + 1)
    return sets.select(*p.line, "copy", "n", _parity(F.col("words"), 0).alias("even"), _parity(F.col("words"), 1).alias("odd"), F.when(~F.col("copy"), prefix).alias("first"))


def _parity(words: Column, lane: int) -> Column:
    """64 bits; a word whose bit 6 is ``lane`` flips the one that its bits 0 to 5 name."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: F.when(F.getbit(w, F.lit(6)) == lane, acc.bitwiseXOR(_shift(w.bitwiseAND(F.lit(63))))).otherwise(acc))


def _flips(x: str = "x", y: str = "y") -> Column:
    return F.bit_count(F.col(f"{x}.even").bitwiseXOR(F.col(f"{y}.even"))) + F.bit_count(F.col(f"{x}.odd").bitwiseXOR(F.col(f"{y}.odd")))


def _alike(n: Column, m: Column, flips: Column, threshold: tuple[int, int]) -> Column:
    """What sizes and parity maps must fulfil."""
    a, b = threshold
    return (n * b >= m * a) & (m * b >= n * a) & (flips <= n + m - 2 * _need(n, m, threshold))


def _pairs(p: _Place) -> list[Column]:
    return [F.col(f"x.{c}") for c in p.line] + [F.col(f"y.{c}").alias(d) for c, d in zip(p.line, p.other, strict=True)]


def crowds(first: DataFrame, p: _Place, threshold: tuple[int, int]) -> DataFrame | None:
    """For a line of a crowd the likeliest match of those that it meets there, if any; None if no word has a crowd.

    Each crowd is dealt by hash to tables of TABLE lines about, and all of a table meet.
    """
    size = F.size("first")
    couples = F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.xxhash64(F.get("first", i), F.get("first", i + 1)))
    keys = F.when(size > 1, F.slice(F.sort_array(couples), F.lit(1), F.lit(KEYS))).otherwise(F.col("first"))
    rows = first.select(*p.line, "n", "even", "odd", F.explode(keys).alias("key_of"))
    counts = cut(rows.groupBy("key_of").agg(F.count("*").alias("held")).filter(F.col("held") >= CROWD))
    most = counts.agg(F.sum("held")).first()[0]
    if not most:
        return None
    dealt = rows.join(light(counts), "key_of").withColumn("table", F.pmod(F.xxhash64(*p.line), F.ceil(F.col("held") / TABLE)))
    dealt = saved(dealt.drop("held"), shared_folder(first.sparkSession, "crowds"))
    x, y = dealt.alias("x"), dealt.alias("y")
    fits = p.later("x", "y") & _alike(F.col("x.n"), F.col("y.n"), _flips(), threshold)
    pairs = x.join(y, (F.col("x.key_of") == F.col("y.key_of")) & (F.col("x.table") == F.col("y.table")) & fits).select(*_pairs(p), _flips().alias("apart"))
    return pairs.groupBy(*p.line).agg(F.min(F.struct("apart", *p.other)).alias("y")).select(*p.line, *[F.col(f"y.{c}") for c in p.other])


def met(first: DataFrame, done: DataFrame | None, p: _Place, threshold: tuple[int, int]) -> DataFrame:
    """Pairs of a line that is not ``done`` and an earlier one that pass the prefix, length and positional filters and the parity map."""
    flagged = first if done is None else first.join(light(done.select(*p.line, F.lit(True).alias("done"))), p.line, "left")
    asks = F.lit(True) if done is None else F.col("done").isNull()
    size = F.when(asks, F.col("n")).otherwise(-F.col("n")).cast("long") * (1 << 32)  # with the place in the prefix, one number
    posted = flagged.select(*p.line, "even", "odd", size.alias("size"), F.posexplode("first").alias("i", "word")).filter(F.col("word") >= (_ONCE + 1) << _CLASS)
    posted = posted.select(*p.line, "even", "odd", "word", (F.col("size") + F.col("i")).alias("n_i"))
    x, y = posted.alias("x"), posted.alias("y")  # one exchange serves both
    n, m = (F.abs(F.shiftright(f"{t}.n_i", 32)) for t in "xy")
    i, j = (F.col(f"{t}.n_i").bitwiseAND(F.lit((1 << 32) - 1)) for t in "xy")
    need = _need(n, m, threshold)
    places = F.least(n - i, m - j) >= need  # i counts from 0: the shared word and what follows it
    open_ = F.least(F.col("x.n_i"), F.abs(F.col("y.n_i"))) > 0  # x is not done; of both sides, lest it is pushed below one's exchange
    fits = open_ & p.later("x", "y") & places & _alike(n, m, _flips(), threshold)
    return x.join(y, (F.col("x.word") == F.col("y.word")) & fits).select(*_pairs(p)).distinct()


def verified(pairs: DataFrame, docs: DataFrame, p: _Place, threshold: tuple[int, int]) -> DataFrame:
    """The least match of each line that has one among ``pairs``, by the words of the lines, which are read again."""
    named = light(cut(pairs.select(*p.line).unionByName(pairs.select(*[F.col(d).alias(c) for c, d in zip(p.line, p.other, strict=True)])).distinct()))
    there = _lines(docs, p).join(named, p.line, "left_semi")
    there = saved(there if not p.tied else there.dropDuplicates(p.line), shared_folder(docs.sparkSession, "there"))
    both = pairs.join(there, p.line).join(there.select(*[F.col(c).alias(d) for c, d in zip(p.line, p.other, strict=True)], F.col("line").alias("line2")), p.other)
    both = both.select(*p.line, *p.other, _words(F.col("line")).alias("words"), _words(F.col("line2")).alias("words2"))
    shared = F.size(F.array_intersect("words", "words2"))
    good = both.filter(shared >= _need(F.size("words"), F.size("words2"), threshold))
    return good.groupBy(*p.line).agg(F.min(F.struct(*p.other)).alias("of"))


def matches(docs: DataFrame, first: DataFrame, p: _Place, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """``p.line`` and ``of``: each line of ``first`` that is similar to an earlier one, and one such line."""
    spark, found = docs.sparkSession, None
    pairs = crowds(first, p, threshold)
    if pairs is not None:
        pairs = cut(pairs)
        found = saved(verified(pairs, docs, p, threshold), shared_folder(spark, "found"))
    pairs = cut(met(first, found, p, threshold))
    release(spark)
    rest = verified(pairs, docs, p, threshold)
    return saved(rest if found is None else rest.unionByName(found), shared_folder(spark, "matches"))


def deduplicated(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with similar later lines taken out of the text, and ``n_lines``, ``n_copies``, ``n_near``, ``matches``.

    Lines come in the order of (id, hash of the text where an id repeats, place).
    A line goes if an earlier line, kept or not, equals it (``n_copies``) or is
    similar to it (``n_near``). ``matches`` has a struct for each of the latter:
    ``at`` and ``of``, the place of one earlier line that it is similar to (``key``
    is the id as the join has it). Lines without a word stay. A null text has no
    line and stays null. Rows that repeat both id and text count as one document,
    and each keeps what one would keep; rows that repeat an id with another text
    are documents of their own. Documents without an id come first, in the order
    of a hash of their texts. Columns of those four names in ``docs`` are
    replaced. An empty table gives an empty one.
    """
    names = ("n_lines", "n_copies", "n_near", "matches")
    kept = [c for c in docs.columns if c not in names]
    p = _Place(docs, id_col, text_col)
    slim = docs.select(*[v.alias(c) for c, v in p.row.items()], F.col(text_col).alias("text"))
    lines_ = saved(heads(slim, p, threshold), shared_folder(docs.sparkSession, "lines"))
    release(docs.sparkSession)
    near = matches(slim, lines_.filter("NOT copy").drop("copy"), p, threshold)
    release(docs.sparkSession)
    gone = lines_.filter("copy").select(*p.line, F.lit(None).alias("of")).distinct().unionByName(near)
    own, gone_, near_, lines = (free_name(docs, x) for x in ("key", "gone_", "near_", "lines_"))
    names_own = [f"{own}_{c}" for c in p.doc]
    per = gone.groupBy(*[F.col(c).alias(o) for c, o in zip(p.doc, names_own, strict=True)]).agg(
        F.collect_set("at").alias(gone_), F.sort_array(F.collect_list(F.when(F.col("of").isNotNull(), F.struct("at", "of")))).alias(near_))
    out = docs.select("*", *[v.alias(o) for v, o in zip(p.row.values(), names_own, strict=True)]).join(per, names_own, "left")
    out = out.withColumn(lines, F.split(text_col, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone_))
    left = F.when(F.col(gone_).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    n_near = F.coalesce(F.size(near_), F.lit(0))
    counted = [F.coalesce(F.size(lines), F.lit(0)), F.coalesce(F.size(gone_), F.lit(0)) - n_near, n_near]
    return out.select(*[left.alias(c) if c == text_col else F.col(c) for c in kept], *[v.cast("long").alias(c) for c, v in zip(names, counted, strict=False)], F.coalesce(near_, F.array()).alias("matches"))
