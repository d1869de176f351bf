"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions alone.

Texts are lower-cased words of letters and digits; shingles are five words (an item with fewer
words is one shingle of all of them), compared by 64-bit hashes. A document is contaminated by an item if a window of
as many words as the item has (or the whole document, if that is shorter) reaches ``threshold`` in
weighted Jaccard similarity, a shingle's weight being the times it occurs.

1. Windows. A window can only reach the threshold if enough of its shingles belong to items of its
   size, and then the window that begins at its first such shingle reaches it too (or the
   document's last window, where it would stick out). So only those windows are
   fingerprinted. This loses nothing, and a text without a benchmark's shingles has no window at all.
2. Windows of equal content are grouped: a passage that a third of the documents share is
   looked up once.
3. Multi-index Hamming blocks. Fingerprints are cut into ``BLOCKS`` blocks; items are entered under every value
   within ``FLIPS`` bits of each block. Two fingerprints within ``RADIUS`` bits have a block
   within ``FLIPS`` bits. Such blocks alone let most pairs of a size meet, so a key is a block's value together with one
   of the first shingles, in the order of their hashes: two bags that reach the threshold share one of these. So
   all items within the radius that can reach the threshold are found, and hardly any other. At similarity 0.8
   fingerprints differ in 10 bits on average; 23 is more than four standard deviations above.
4. The exact weighted similarity decides.

The items' shingles are broadcast up to ``BROADCAST_SHINGLES``. Beyond, a Bloom filter of them (16 MB at most, in every
task) is asked first, and only the places it lets through are shuffled, salted, to the shingles themselves.

A task never holds the words of a whole text: texts of over ``PIECE_CHARS`` characters are cut after every
``PIECE_WORDS`` words, each piece sees the few words after it that its last shingles need, and a window is put
together from the shingles that each piece has of it. Keys are made and joined by about ``KEYS_A_TASK`` a task, however few
files their items and windows lie in.

Defined results: null and empty texts and items match nothing; repeated rows of a document are one, repeated
items are reported each, also those that share an id; very long texts are read whole; other columns of both tables,
of whatever name, don't matter; an empty table on either side gives no matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.frames import joined
from lectern.plans.sizing import staged

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BITS = 64
BLOCKS = 8
FLIPS = 2
RADIUS = BLOCKS * (FLIPS + 1) - 1
BROADCAST_SHINGLES = 1 << 20
BLOOM_BITS = 1 << 27  # at most; 16 a shingle up to there
PROBES = 3
FILTER_WORDS = 4096  # of the Bloom filter, gathered at once
SALTS = 16
KEYS_A_TASK = 1 << 20
PIECE_CHARS = 8192
PIECE_WORDS = 1024
LETTER = r"[\p{L}\p{N}]"
OTHER = r"[^\p{L}\p{N}]"
WORD = LETTER + "+"
FIRST_WORDS = rf"\A(?:{LETTER}++{OTHER}*+){{1,{SHINGLE_WORDS - 1}}}+"


def _lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit("")))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _pieces(docs: DataFrame, keep: list[str], with_windows: bool = False) -> DataFrame:
    """``keep``, n_words, first, own, words: a row for each piece of a text (column text).

    The piece's ``own`` words begin at number ``first`` of the text's ``n_words``; up to SHINGLE_WORDS - 1 that follow are added.
    ``with_windows``: those of the text's windows (column windows) that have shingles there, too, and only pieces that have some.
    The repetitions are possessive: they take no stack, however long the text, and a text is gone through once.
    """
    cut = rf"(?:{LETTER}++{OTHER}*+){{1,{PIECE_WORDS}}}+"
    own = keep + ["windows"] * with_windows
    lowered = docs.select(*own, _lowered("text").alias("text"))
    long = F.regexp_extract_all(F.regexp_replace("text", rf"\A{OTHER}++", ""), F.lit(cut), F.lit(0))
    pieces = lowered.select(*own, F.when(F.length("text") <= PIECE_CHARS, F.array("text")).otherwise(long).alias("piece"))
    n, last = F.size("piece"), F.get("piece", F.size("piece") - 1)
    beside = [F.slice("piece", F.lit(2), n).alias("following")]
    if with_windows:
        there = F.transform("piece", lambda _, i: F.filter(
            "windows", lambda w: (w["at"] < (i + 1) * PIECE_WORDS) & (w["at"] + w["inside"] > i * PIECE_WORDS)))
        beside.append(F.when(n > 1, there).otherwise(F.array("windows")).alias("windows"))
    rows = (
        pieces.withColumn("before", F.when(n > 1, (n - 1) * PIECE_WORDS + F.size(_words(last))))
        .select(*keep, "before", F.posexplode(F.arrays_zip("piece", *beside)).alias("number", "p"))
    )
    if with_windows:
        rows = rows.where(F.size("p.windows") > 0).withColumn("windows", F.col("p.windows"))
    ends = F.col("p.following").isNull()
    whole = F.when(ends, F.col("p.piece")).otherwise(F.concat("p.piece", F.regexp_extract("p.following", FIRST_WORDS, 0)))
    worded = rows.select(*own, "before", "number", ends.alias("ends"), _words(whole).alias("words"))
    return worded.select(
        *own, F.coalesce("before", F.size("words")).alias("n_words"), (F.col("number") * PIECE_WORDS).alias("first"),
        F.when(F.col("ends"), F.size("words")).otherwise(F.lit(PIECE_WORDS)).alias("own"), "words")


def _shingles(words: str, width: Column) -> Column:
    """Hashes of the shingles of ``width`` words; ``words`` has that many at least."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width)))


def simhash(hashes: Column) -> Column:
    """Bits that more than half of ``hashes`` have, as a long."""
    def voted(bit: Column) -> Column:
        ones = F.aggregate(hashes, F.lit(0), lambda n, h: n + F.getbit(h, bit))
        return F.when(ones * 2 > F.size(hashes), F.call_function("shiftleft", F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda code, bit: code.bitwiseOR(voted(bit)))


def _bag(hashes: Column) -> Column:
    """A set that stands for the bag: each hash with the number of its occurrence."""
    ordered = F.sort_array(hashes)
    return F.transform(ordered, lambda h, i: F.xxhash64(h, i - F.array_position(ordered, h).cast("int")))


def _changes(variants: bool) -> list[int]:
    """What a block's value is changed by: nothing, or with ``variants`` all of at most FLIPS bits."""
    return [sum(1 << b for b in bits) for n in range(FLIPS * variants + 1) for bits in combinations(range(BITS // BLOCKS), n)]


def _blocks(code: str, variants: bool) -> Column:
    """(block, value) pairs of a fingerprint; with ``variants``, all values within FLIPS bits."""
    width = BITS // BLOCKS
    changes = F.array(*[F.lit(f) for f in _changes(variants)])  # as loops: 296 structs in a row are too long to compile

    def values(i: Column) -> Column:
        shifted = F.call_function("shiftrightunsigned", F.col(code), i * width)
        value = shifted.bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        return F.transform(changes, lambda f: F.struct(i.alias("block"), value.bitwiseXOR(f).alias("value")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), values))


def _first_of(bag: Column, threshold: float) -> Column:
    """The elements of a bag, by value, of which two bags that reach the threshold share one."""
    return F.slice(F.sort_array(bag), F.lit(1), F.size(bag) - F.ceil(F.size(bag) * threshold - 1e-9).cast("int") + 1)


def _keyed(rows: DataFrame, variants: bool, threshold: float) -> DataFrame:
    """size, width, digest, code and a key for every block value and first shingle of fingerprinted ``rows``."""
    own = ["size", "width", "digest", "code"]
    blocks = rows.select(*own, _first_of(F.col("bag"), threshold).alias("first"), F.inline(_blocks("code", variants)))
    return blocks.select(*own, "block", "value", F.explode("first").alias("shingle")).select(
        *own, F.xxhash64("size", "width", "block", "value", "shingle").alias("key"))


def _n_keys(rows: DataFrame, variants: bool, threshold: float) -> int:
    """How many rows :func:`_keyed` makes."""
    first = rows.agg(F.sum(F.size(_first_of(F.col("bag"), threshold)))).first()[0] or 0
    return first * BLOCKS * len(_changes(variants))


def _met(contents: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """Fingerprinted ``contents`` beside those of ``known`` (item, item_code, ...) of their size that share a key."""
    spark = contents.sparkSession
    n = [_n_keys(contents, False, threshold), _n_keys(known, True, threshold)]

    def spread(rows: DataFrame, keys: int) -> DataFrame:
        tasks = math.ceil(keys / KEYS_A_TASK)
        return rows.repartition(max(tasks, spark.sparkContext.defaultParallelism), "digest") if tasks > 1 else rows

    asked = _keyed(spread(contents, n[0]), False, threshold)
    # some 2000 rows an item, which Spark reckons as one: without the hint it would bring all of them through the driver
    index = _keyed(spread(known, n[1]), True, threshold).select(
        F.col("key").alias("item_key"), F.col("digest").alias("item"), F.col("code").alias("item_code"),
        F.col("size").alias("item_size"), F.col("width").alias("item_width"))
    tasks = math.ceil(sum(n) / KEYS_A_TASK)
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        asked, index = asked.repartition(tasks, "size", "width", "key"), index.repartition(tasks, "item_size", "item_width", "item_key")
    same = (F.col("size") == F.col("item_size")) & (F.col("width") == F.col("item_width")) & (F.col("key") == F.col("item_key"))
    return asked.join(index.hint("merge"), same)


def _digest() -> Column:
    return F.struct(F.xxhash64("shingles").alias("a"), F.xxhash64(F.reverse("shingles")).alias("b"))


def _bloom(hashes: DataFrame, n: int, most_bits: int) -> Callable[[Column], Column]:
    """Whether a hash may be among the ``n`` of ``hashes`` (column h); those that are always may."""
    bits = min(most_bits, 1 << max(10, (16 * n - 1).bit_length()))

    def place(h: Column) -> Column:
        return F.pmod(F.xxhash64(h, F.lit(0)), F.lit(bits // 64)).cast("int")

    def mask(h: Column) -> Column:
        """The bits of a hash, all in one word: so an expression holds the filter once."""
        places = [F.call_function("shiftrightunsigned", F.xxhash64(h, F.lit(1)), F.lit(6 * i)).bitwiseAND(F.lit(63)).cast("int") for i in range(PROBES)]
        return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])

    words = hashes.groupBy(place(F.col("h")).cast("long").alias("at")).agg(F.bit_or(mask(F.col("h"))).alias("word"))
    every = hashes.sparkSession.range(bits // 64).withColumnRenamed("id", "at").join(words, "at", "left")

    def listed(key: str, value: Column) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.struct(key, value.alias("value")))), lambda x: x["value"])

    parts = every.groupBy(F.floor(F.col("at") / FILTER_WORDS).alias("part")).agg(
        listed("at", F.coalesce("word", F.lit(0).cast("long"))).alias("words"))
    # one row of at most ``most_bits``, whatever the number of hashes
    held = staged(parts.agg(F.flatten(listed("part", F.col("words"))).alias("words")), "bloom").scalar()

    def may(h: Column) -> Column:
        return F.get(held, place(h)).bitwiseAND(mask(h)) == mask(h)

    return may


def _items(benchmark: DataFrame, item_id: str, text: str, threshold: float) -> DataFrame:
    """One row per item with words: its size, shingles, and what a window must share with it."""
    width = F.least(F.size("words"), F.lit(SHINGLE_WORDS))
    return staged(
        benchmark.select(F.col(item_id).alias("item_id"), _words(_lowered(text)).alias("words"))
        .where(F.size("words") > 0)
        .withColumns({"size": F.size("words"), "width": width})
        .withColumn("shingles", _shingles("words", F.col("width")))
        .drop("words"), "items")


def _seeds(docs: DataFrame, items: DataFrame, widths: list[int]) -> DataFrame:
    """(doc_id, mark, n_words, size, width, at): where a shingle of an item of that size begins."""
    wanted = staged(items.select("size", "width", F.explode("shingles").alias("h")).distinct(), "wanted")
    n = wanted.count()
    small = n <= BROADCAST_SHINGLES
    if small:
        wanted = F.broadcast(wanted)
    else:
        may = _bloom(wanted, n, BLOOM_BITS)
        wanted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pieces = _pieces(docs, ["doc_id", "mark"])
    out = None
    for width in widths:
        count = F.least(F.col("own"), F.size("words") - (width - 1))
        shifted = [F.slice("words", F.lit(i + 1), count).alias(f"w{i}") for i in range(width)]
        rows = pieces.where(F.size("words") >= width).select(
            "doc_id", "mark", "n_words", "first", F.posexplode(F.arrays_zip(*shifted)).alias("at", "w"))
        hashed = rows.select("doc_id", "mark", "n_words", (F.col("first") + F.col("at")).alias("at"), F.lit(width).alias("width"),
                             F.xxhash64(*[F.col(f"w.w{i}") for i in range(width)]).alias("h"))
        if small:
            found = hashed.join(wanted, ["width", "h"]).drop("h")
        else:
            salted = hashed.where(may(F.col("h"))).withColumn(
                "salt", F.pmod(F.hash("doc_id", "mark", "at"), F.lit(SALTS)))
            found = salted.join(wanted, ["width", "h", "salt"]).drop("h", "salt")
        out = found if out is None else out.unionByName(found)
    return out


def _starts(seeds: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, mark, windows): the windows that hold enough shingles of items of their size."""
    full = F.col("size") - F.col("width") + 1
    inside = F.least(F.col("size"), F.col("n_words")) - F.col("width") + 1
    needed = F.ceil((full + inside) * (threshold / (1 + threshold)) - 1e-9).cast("int")
    grouped = (
        seeds.groupBy("doc_id", "mark", "n_words", "size", "width").agg(F.sort_array(F.collect_set("at")).alias("at"))
        .withColumns({"inside": inside, "needed": needed})
        .where((F.col("needed") <= F.col("inside")) & (F.size("at") >= F.col("needed")))
    )
    last = F.greatest(F.col("n_words") - F.col("size"), F.lit(0))
    enough = F.filter(
        F.transform("at", lambda a, i: F.when(
            F.get("at", i + F.col("needed") - 1) <= a + F.col("inside") - 1, F.least(a, last))),
        lambda a: a.isNotNull())
    return (
        grouped.select("doc_id", "mark", "size", "width", "inside", F.explode(F.array_distinct(enough)).alias("at"))
        .groupBy("doc_id", "mark").agg(F.collect_list(F.struct("size", "width", "inside", "at")).alias("windows"))
    )


def _windows(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, size, width, at, shingles) of all ``windows`` of ``docs`` (doc_id, mark, text, windows)."""
    own = ["doc_id", "mark", "size", "width", "at"]
    until = F.col("first") + F.col("own")

    def part(w: Column) -> Column:
        places = F.sequence(F.greatest(w["at"], F.col("first")) - F.col("first") + 1, F.least(w["at"] + w["inside"], until) - F.col("first"))
        hashes = F.transform(places, lambda i: F.xxhash64(F.slice("words", i, w["width"])))
        return F.struct(w["size"].alias("size"), w["width"].alias("width"), w["at"].alias("at"), hashes.alias("part"))

    # Spark holds all rows that one row is exploded to: they must not carry its words
    parts = _pieces(docs, ["doc_id", "mark"], True).select("doc_id", "mark", "first", F.inline(F.transform("windows", part)))
    whole = F.sort_array(F.collect_set(F.struct("first", "part")))  # a set: repeated rows of a document are one
    return parts.groupBy(*own).agg(whole.alias("parts")).select(*own, F.flatten("parts.part").alias("shingles"))


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, mark, item_id, similarity, start_word, n_words): the best window of every document and item.

    ``mark`` is the hash of the text, so that documents of equal id and other text stay apart.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    items = _items(benchmark, item_id, item_text, threshold)
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # five values at most
    if not widths:
        empty = "doc_id {}, mark bigint, item_id {}, similarity double, start_word bigint, n_words bigint"
        kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], empty.format(*kinds))
    starts = staged(_starts(_seeds(texts, items, widths), threshold), "starts")

    # a row carries all its windows, under 64 bytes each
    held = starts.agg((F.count("*") + F.coalesce(F.sum(F.size("windows")), F.lit(0))).alias("n")).first().n
    windows = staged(
        _windows(joined(texts, starts, ["doc_id", "mark"], "inner", held)).withColumn("digest", _digest()), "windows")

    def printed(rows: DataFrame) -> DataFrame:
        return rows.withColumns({"code": simhash(F.col("shingles")), "bag": _bag(F.col("shingles"))}).drop("shingles")

    contents = staged(printed(windows.groupBy("size", "width", "digest").agg(F.first("shingles").alias("shingles"))), "contents")
    marked = items.withColumn("digest", _digest())
    known = staged(printed(marked.groupBy("size", "width", "digest").agg(F.first("shingles").alias("shingles"))), "prints")
    near = (
        _met(contents, known, threshold)
        .where(F.bit_count(F.col("code").bitwiseXOR(F.col("item_code"))) <= RADIUS)
        .select("size", "width", "digest", "item").distinct()
    )
    shared = F.size(F.array_intersect("bag", "item_bag"))
    verified = (
        near.join(contents.select("size", "width", "digest", "bag"), ["size", "width", "digest"])
        .join(known.select("size", "width", F.col("digest").alias("item"), F.col("bag").alias("item_bag")), ["size", "width", "item"])
        .withColumn("similarity", shared / (F.size("bag") + F.size("item_bag") - shared))
        .where(F.col("similarity") >= threshold)
        .join(marked.select("size", "width", F.col("digest").alias("item"), "item_id"), ["size", "width", "item"])
        .select("size", "width", "digest", "item_id", "similarity")
    )
    best = F.max(F.struct("similarity", (-F.col("at")).alias("at")))
    return (
        windows.drop("shingles").join(verified, ["size", "width", "digest"])
        .groupBy("doc_id", "mark", "item_id", "size").agg(best.alias("best"))
        .select("doc_id", "mark", "item_id", "best.similarity", (-F.col("best.at")).cast("long").alias("start_word"),
                F.col("size").cast("long").alias("n_words"))
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                         threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that an item contaminates."""
    found = staged(contaminated(docs, benchmark, doc_id, text, threshold=threshold).select(
        F.col("doc_id").alias(doc_id), F.col("mark").alias("__mark")).distinct(), "contaminated")
    marked = docs.withColumn("__mark", F.xxhash64(text))
    return joined(marked, found, [doc_id, "__mark"], "left_anti", found.count()).drop("__mark")
