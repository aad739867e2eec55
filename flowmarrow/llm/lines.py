"""Removal of repeated lines by an exact set-similarity join.

A line is the set of its lower-cased words. A line goes if an earlier line (by document id, text digest and line number)
has a Jaccard similarity of at least the threshold, 80 percent by default; equal sets are similar. Lines without a word
stay. All lines are compared, over all documents.

Words are ordered by rarity: frequencies are counted over the whole table in a fixed number of buckets, which gives
every word the same short order code everywhere. Only the first words of a line in that order can be the first
common word of a similar pair (prefix filter); the longer line of a pair needs the longer prefix, the shorter one a
shorter one. Sets meet on a code and a class of lengths, so sets of very different lengths are never looked at together. Pairs
that meet must fit in length and position, and a bitmap of the words bounds their overlap, so almost only similar pairs are
compared word by word. Equal sets are one entry from the start, and every
step is a join or an aggregation. Codes may collide, which only adds pairs to compare; whole sets and texts are
identified by 64-bit hashes.

One earlier similar line is enough for a line to go. So each set is first compared with the earliest sets that share
neighbouring rare words with it, found by an aggregation, then with those sets that settled others. Sets that are settled by this need no earlier partner any more
and only serve as partners of others in the join. A group of near copies thus costs a few rows a member, not one for each pair.

Null and empty texts have no lines to remove and stay as they are. Rows without an id come last. Rows with equal id and
text have the same lines removed.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowmarrow.llm.text import BLANKS, query, rows_only, table, whole, with_row
from flowmarrow.session import frozen

PERCENT = 80
#: The rarity table has this many one-byte counters, whatever the size of the vocabulary.
BUCKETS = 2**18
#: Tables of at most this size are sent to all executors; larger ones are joined by shuffle.
BROADCAST_BYTES = 2**26
#: Lines of more words have a bitmap of 128 bits, others of 64.
LONG = 64
#: Neighbouring rare words of a set that look for an earlier set in advance.
MARKS = 3
#: Rounds of guesses before the join: the first by marks, the others by sets that settled others.
ROUNDS = 2
#: A class of lengths spans so many times the ratio of lengths that similar sets may have.
CLASS = 3
#: Marks a set that still needs an earlier partner, between the length and the place of a code.
OPEN = 2**31
#: Marks an entry in the class of its own length; a pair is taken where its longer set is.
HOME = 2**30


def _small(df: DataFrame, width: int = 64) -> DataFrame:
    """A table with rows of at most ``width`` bytes, broadcast if it is small."""
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def _words(line: Column) -> Column:
    """The lower-cased words of a line; a plain blank as separator is much cheaper than a pattern, and so is looking for the others."""
    plain = ~functools.reduce(Column.__or__, [F.contains(line, F.lit(blank)) for blank in "\t\n\x0b\x0c\r"])
    return F.array_remove(F.when(plain, F.split(F.lower(line), " ")).otherwise(F.split(F.lower(line), BLANKS)), "")


def words_of(line: Column) -> Column:
    """Hashes of the distinct words of a line."""
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def rarity(docs: DataFrame) -> Column:
    """A level of frequency, 0 to 127, for every bucket of words, as one byte each in a literal."""
    lines = docs.select(F.explode(F.split(whole(F.col("text")), "\n")).alias("line"))
    words = lines.select(F.explode(_words(F.col("line"))).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(127), F.floor(5 * F.log2(F.col("n") + 1))).cast("int")
    levels = bytearray(BUCKETS)
    for bucket, found in counts.select("bucket", level).collect():  # BUCKETS rows at most
        levels[max(bucket - 1, 0)] = found  # substrings count from 1, and from 0 is the same; buckets 0 and 1 share a byte
    return F.lit(levels)


def _texts(docs: DataFrame) -> DataFrame:
    """(doc, key, text): the digest is made here, once a text; beside the explosion it would be made for every line."""
    t = whole(F.col("text"))
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(t).alias("key"), t.alias("text"))


def _numbered(texts: DataFrame) -> DataFrame:
    return texts.select("doc", "key", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def _codes(words: Column, levels: Column) -> Column:
    """The order codes of a set of word hashes, rarest first: frequency, then the upper bits of the hash."""

    def code(h):
        level = F.ascii(F.substring(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"), F.lit(1)).cast("string"))
        return F.shiftleft(level, 24) + F.shiftrightunsigned(h, 40).cast("int")

    return F.sort_array(F.transform(words, code))


def _bits(words: Column) -> list[Column]:
    """A bitmap of the words in two columns: each word flips one of 128 bits, in a short line one of the first 64."""

    def half(k):
        def flip(bits, h):
            mine = F.shiftright(h, 6).bitwiseAND(F.lit(1))
            return bits.bitwiseXOR(F.call_function("shiftleft", mine if k else F.lit(1) - mine, h.bitwiseAND(F.lit(63)).cast("int")))

        return F.aggregate(words, F.lit(0).cast("long"), flip)

    def fold(bits, h):
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int")))

    short = F.size(words) <= LONG
    none = F.lit(0).cast("long")
    return [F.when(short, F.aggregate(words, none, fold)).otherwise(half(0)).alias("bits0"), F.when(short, none).otherwise(half(1)).alias("bits1")]


def _apart(n, bits0, bits1) -> Column:
    """A lower bound of the words that only one of two lines has; the arguments give a column of side x or y."""
    first, second = bits0("x").bitwiseXOR(bits0("y")), bits1("x").bitwiseXOR(bits1("y"))
    folded = F.bit_count(first.bitwiseXOR(second))
    return F.when(F.least(n("x"), n("y")) <= LONG, folded).otherwise(F.bit_count(first) + F.bit_count(second))


#: What bounds of two sets are taken from.
OUTLINE = ("rid", "n", "bits0", "bits1")


def _may_be_alike(percent: int) -> Column:
    """Whether lengths and bitmaps of the structs x and y let them be similar."""
    n = lambda side: F.col(side)["n"]
    apart = _apart(*[lambda side, f=f: F.col(side)[f] for f in OUTLINE[1:]])
    need = F.ceil((n("x") + n("y")) * percent / (100 + percent))
    return (F.least(n("x"), n("y")) >= need) & (n("x") + n("y") - apart >= 2 * need)


def _reach(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / 100).cast("int") + 1


def occurrences(docs: DataFrame, percent: int) -> DataFrame:
    """(doc, key, no, sid, n, codes, bits0, bits1): every line with a word, with the codes of its prefix, or more for marks."""
    levels = rarity(docs)
    d = _numbered(_texts(docs))
    # a test of the words themselves would have them made twice
    d = d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).select("doc", "key", "no", words_of(F.col("line")).alias("words"))
    n = F.size("words")
    codes = F.slice(_codes(F.col("words"), levels), F.lit(1), F.greatest(_reach(n, percent), F.lit(MARKS + 1)))
    return d.select("doc", "key", "no", n.alias("n"), F.xxhash64(F.sort_array("words")).alias("sid"), codes.alias("codes"), *_bits(F.col("words")))


def early_guesses(sets: DataFrame) -> DataFrame:
    """(a, b): for every set and mark, the set of the first document that has the mark too."""
    marks = F.array(*[F.when(F.size("codes") > i + 1, F.xxhash64(F.get("codes", F.lit(i)), F.get("codes", F.lit(i + 1)))) for i in range(MARKS)])
    marked = sets.select("rid", "doc", F.explode(marks).alias("mark")).where(F.col("mark").isNotNull())
    leads = marked.groupBy("mark").agg(F.min(F.struct("doc", "rid")).alias("lead"), F.count(F.lit(1)).alias("times"))
    leads = frozen(leads.where(F.col("times") > 1).select("mark", F.col("lead.rid").alias("b")), "line-leads")
    met = marked.join(_small(leads), "mark").where(F.col("rid") != F.col("b"))
    return met.select(F.col("rid").alias("a"), "b").distinct()


def centre_guesses(sets: DataFrame, settled: DataFrame, percent: int) -> DataFrame:
    """(a, b): for every open set and code of its prefix, the set with that code which most sets have been settled by,
    and the earliest such set; ``settled`` holds pairs (rid, early)."""
    centres = settled.groupBy(F.col("early").alias("rid")).agg(F.count(F.lit(1)).alias("settles"))
    code = F.explode(F.slice("codes", F.lit(1), _reach(F.col("n"), percent))).alias("code")
    held = sets.join(_small(centres), "rid").select("doc", "settles", F.struct(*OUTLINE).alias("set"), code)
    leads = held.groupBy("code").agg(F.max(F.struct("settles", "set")).alias("most"), F.min(F.struct("doc", "set")).alias("first"))
    leads = frozen(leads.select("code", F.explode(F.array_distinct(F.array("most.set", "first.set"))).alias("y")), "line-centres")
    met = sets.where(F.col("open")).select(F.struct(*OUTLINE).alias("x"), code).join(_small(leads, 96), "code")
    met = met.where((F.col("x.rid") != F.col("y.rid")) & _may_be_alike(percent))
    return met.select(F.col("x.rid").alias("a"), F.col("y.rid").alias("b")).distinct()


def _class(n: Column, percent: int) -> Column:
    """A class of lengths; the longest set that may be similar to one of ``n`` words is in the same class or the next."""
    return F.floor(F.log(n) / math.log(max((100 / percent) ** CLASS, 2))).cast("int")


def entries(sets: DataFrame, percent: int) -> DataFrame:
    """(code, rid, doc, place, bits0, bits1): the prefix of every set, each code joined with the class of the set's length,
    and the shorter prefix with the next class too, if longer sets there may be similar."""
    codes = F.slice("codes", F.lit(1), _reach(F.col("n"), percent))
    found = sets.select("rid", "doc", "n", "open", "bits0", "bits1", F.posexplode(codes).alias("at", "code"))
    n, own, longest = F.col("n"), _class(F.col("n"), percent), _class(F.floor(F.col("n") * 100 / percent), percent)
    index_size = n - F.ceil(n * 2 * percent / (100 + percent)) + 1
    # length, mark and place in the prefix share a column, which makes the shuffled rows smaller
    place = F.shiftleft(n.cast("long"), 32) + F.when(F.col("open"), F.lit(OPEN)).otherwise(0) + F.col("at")
    classes = F.when((F.col("at") < index_size) & (longest > own), F.array(own, longest)).otherwise(F.array(own))
    found = found.select("code", "rid", "doc", place.alias("place"), "bits0", "bits1", F.posexplode(classes).alias("further", "class"))
    code = F.shiftleft(F.col("class").cast("long"), 32) + F.col("code")
    return found.select(
        code.alias("code"), "rid", "doc", (F.col("place") + F.when(F.col("further") == 0, F.lit(HOME)).otherwise(0)).alias("place"), "bits0", "bits1"
    )


def similar_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): candidate pairs of distinct sets that pass the length, position and overlap bounds, the later one open."""
    entered = entries(sets, percent)
    x, y = entered.alias("x"), entered.alias("y")
    c = F.col
    size = lambda side: F.shiftright(c(f"{side}.place"), 32)
    at = lambda side: c(f"{side}.place").bitwiseAND(F.lit(HOME - 1))
    is_open = lambda side: c(f"{side}.place").bitwiseAND(F.lit(OPEN)) != 0
    is_home = c("x.place").bitwiseAND(F.lit(HOME)) != 0
    before = lambda a, b: F.coalesce(c(f"{a}.doc") < c(f"{b}.doc"), F.lit(False))
    need = F.ceil((size("x") + size("y")) * percent / (100 + percent))
    index_size = size("y") - F.ceil(size("y") * 2 * percent / (100 + percent)) + 1
    fits = (
        (c("x.code") == c("y.code"))
        & ((size("x") > size("y")) | ((size("x") == size("y")) & (c("x.rid") > c("y.rid"))))
        & (100 * size("y") >= percent * size("x"))
        & ((is_open("x") & ~before("x", "y")) | (is_open("y") & ~before("y", "x")))
        # with the last term, at("y") < index_size; alone it or is_home would be a filter of one side, and both would be shuffled
        & (F.when(is_home, F.least(size("x") - at("x"), size("y") - at("y"), need + index_size - 1 - at("y"))).otherwise(0) >= need)
        & (size("x") + size("y") - _apart(size, lambda s: c(f"{s}.bits0"), lambda s: c(f"{s}.bits1")) >= 2 * need)
    )
    return x.join(y, fits).select(c("x.rid").alias("a"), c("y.rid").alias("b")).distinct()


def _whole_sets(docs: DataFrame, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rid, first, open, n, words, bits0, bits1): the sets of the pairs with all their words, read from their first line."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
    at = sets.select("rid", "open", F.col("none").alias("at_none"), F.col("doc").alias("at_doc"), F.col("key").alias("at_key"), F.col("no").alias("at_no"))
    at = frozen(at.join(wanted, "rid"), "line-wanted")
    same = F.col("doc").eqNullSafe(F.col("at_doc")) & (F.col("key") == F.col("at_key"))
    texts = _texts(docs)
    if (small := _small(at)) is not at:  # texts without such a line need not be split
        texts = texts.join(F.broadcast(at.select("at_doc", "at_key").distinct()), same, "left_semi")
    d = _numbered(texts).join(small, same & (F.col("no") == F.col("at_no")))
    d = d.select("rid", "open", F.struct("at_none", "doc", "key", "no").alias("first"), words_of(F.col("line")).alias("words"))
    d = d.groupBy("rid").agg(*[F.first(c).alias(c) for c in ("open", "first", "words")])  # rows with equal id and text
    return frozen(d.select("*", F.size("words").alias("n"), *_bits(F.col("words"))), "line-sets")


def _later_of(pairs: DataFrame, whole_sets: DataFrame, percent: int) -> DataFrame:
    """(rid, early): the later sets, if open, of pairs that are similar word by word, and the earlier ones."""
    short = whole_sets.select("rid", F.struct("first", "open", *OUTLINE).alias("set"))
    both = pairs.join(short.select(F.col("rid").alias("a"), F.col("set").alias("x")), "a")
    both = both.join(short.select(F.col("rid").alias("b"), F.col("set").alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    swapped = x["first"] < y["first"]
    late = F.when(swapped, y).otherwise(x)
    near = both.where(late["open"] & _may_be_alike(percent))
    near = near.select(late["rid"].alias("late"), F.when(swapped, x["rid"]).otherwise(y["rid"]).alias("early"))
    near = near.join(whole_sets.select(F.col("rid").alias("late"), F.col("words").alias("a")), "late")
    near = near.join(whole_sets.select(F.col("rid").alias("early"), F.col("words").alias("b")), "early")
    alike = (100 + percent) * F.size(F.array_intersect("a", "b")) >= percent * (F.size("a") + F.size("b"))
    return near.where(alike).select(F.col("late").alias("rid"), "early").distinct()


def later_sets(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rid): the sets for which an earlier set is similar, compared word by word."""
    left = sets.withColumn("open", F.lit(True))
    settled = None
    for _ in range(ROUNDS):
        guesses = frozen(early_guesses(left) if settled is None else centre_guesses(left, settled, percent), "line-guesses")
        found = _later_of(guesses, _whole_sets(docs, left, guesses), percent)
        settled = frozen(found if settled is None else settled.union(found), "line-settled")
        done = settled.select("rid").distinct().withColumn("done", F.lit(True))
        left = sets.join(_small(done), "rid", "left").withColumn("open", F.col("done").isNull())
    pairs = frozen(similar_pairs(left, percent), "line-candidates")
    return settled.union(_later_of(pairs, _whole_sets(docs, left, pairs), percent)).select("rid").distinct()


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc, key, removed): the numbers of the lines to remove, from 0, for every document that loses some."""
    found = frozen(occurrences(docs, percent), "lines")
    none = F.col("doc").isNull()
    order = F.struct(none.alias("none"), "doc", "key", "no")
    sets = found.groupBy("sid").agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("times"), F.first(F.struct("n", "codes", "bits0", "bits1")).alias("set")
    )
    # numbers are only names, so any will do once they are written
    sets = frozen(sets.select(F.monotonically_increasing_id().alias("rid"), "sid", "first.*", "times", "set.*"), "line-distinct")
    late = frozen(later_sets(docs, sets, percent), "line-later").withColumn("late", F.lit(True))
    firsts = sets.select("rid", "sid", order.alias("first"), "times").join(_small(late), "rid", "left")
    firsts = frozen(firsts.where(F.col("late") | (F.col("times") > 1)).select("sid", "first", "late"), "line-verdicts")
    gone = found.select("doc", "key", "no", "sid").join(_small(firsts), "sid").where(F.col("late") | (order > F.col("first")))
    return gone.groupBy("doc", "key").agg(F.sort_array(F.collect_set("no")).alias("removed"))


def _with_removed(docs: DataFrame, percent: int) -> DataFrame:
    gone = frozen(removed_lines(docs.select("doc_id", "text"), percent), "line-removals")
    gone = gone.select(F.col("doc").alias("gone_doc"), F.col("key").alias("gone_key"), "removed")
    # a document can lose any number of lines, so bytes are counted, not only rows
    size = gone.agg(F.coalesce(F.sum(F.lit(64) + 4 * F.size("removed").cast("long")), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    rows = with_row(docs, id=F.col("doc_id"), text=whole(F.col("text")), key=F.xxhash64(whole(F.col("text"))))
    return rows.join(gone, rows.id.eqNullSafe(gone.gone_doc) & (rows.key == gone.gone_key), "left")


def n_chars(text: Column) -> Column:
    return F.length(whole(text))


def _kept(text: Column, removed: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(removed, i))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without their repeated lines, with all their columns."""
    rows = _with_removed(docs, percent)
    text = F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(F.array_join(_kept(F.col("text"), F.col("removed")), "\n"))
    return rows_only(rows.select(F.col("row").withField("text", text).alias("row")))


def removals(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed) for every document."""
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return _with_removed(docs, percent).select(
        F.col("id").alias("doc_id"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.size(removed).cast("long").alias("n_removed"), F.array_join(removed.cast("array<string>"), ",").alias("removed"),
    )


REMOVED_SQL = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {docs}),
ln AS (SELECT rid, doc_id, md5(text) AS dig, no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(line), '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS words
  FROM (SELECT *, unnest(range(len(string_split(text, chr(10))))) AS no, unnest(string_split(text, chr(10))) AS line FROM d)),
st AS (SELECT words, len(words) AS n, min((doc_id IS NULL, doc_id, dig, no)) AS first, row_number() OVER () AS sid FROM ln WHERE len(words) > 0 GROUP BY words),
tk AS (SELECT sid, n, unnest(words) AS w FROM st),
fr AS (SELECT w, count(*) AS c FROM tk GROUP BY w),
pf AS (SELECT sid, n, w FROM (SELECT sid, n, w, row_number() OVER (PARTITION BY sid ORDER BY c, w) AS p FROM tk JOIN fr USING (w))
  WHERE p <= n - ceil(n * 80 / 100) + 1),
cd AS (SELECT DISTINCT a.sid AS x, b.sid AS y FROM pf a JOIN pf b ON a.w = b.w AND a.sid <> b.sid AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
lt AS (SELECT DISTINCT x FROM cd JOIN st a ON a.sid = x JOIN st b ON b.sid = y
  WHERE a.first > b.first AND 180 * len(list_intersect(a.words, b.words)) >= 80 * (a.n + b.n)),
gone AS (SELECT rid, no FROM ln JOIN st USING (words)
  WHERE st.sid IN (SELECT x FROM lt) OR (ln.doc_id IS NULL, ln.doc_id, ln.dig, ln.no) > st.first)"""


@query(
    "WITH " + REMOVED_SQL.format(docs="documents") + """
SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, count(no) AS n_removed,
  coalesce(string_agg(CAST(no AS VARCHAR), ',' ORDER BY no), '') AS removed
FROM d LEFT JOIN gone USING (rid) GROUP BY rid, doc_id, text"""
)
def op5_line_dedup(spark, sf_dir):
    return removals(table(spark, sf_dir, "documents").select("doc_id", "text"))
