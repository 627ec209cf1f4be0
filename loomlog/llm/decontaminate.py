"""Operator 5: benchmark decontamination by template canonicalisation.

Texts become words in lower case in which numbers, units after numbers and names
(words inside a sentence with a capital first letter alone) are replaced by typed placeholders. Windows of
``WINDOW`` such words of the benchmark are hash-joined with those of all documents;
windows of placeholders mainly are no anchors. A document holds an item if it has at
least ``COVERAGE`` of the item's windows, or ``PASSAGE`` of them (13 words in a row have
as many), and its slots are consistent: where the
windows lie over each other, each value in the item's slots has one counterpart in
the document, so that a question with other numbers or names is caught and a mere
likeness of form isn't. That is asked of each occurrence by itself: the windows of one
diagonal (place in the document less place in the item), those of diagonals at most
``SLACK`` from each other (words put in or left out), and all windows of the document;
one without a clash is enough. Windows of the plain words in lower case, without
placeholders and anchors, are joined as well and count in the same way, so that a copy
in other case, a title or a row of numbers is found. Items of 5 to 7 words are matched
by windows of five words; shorter ones are too common to be matched and give nothing.

All of it is DataFrame and SQL functions. The benchmark's windows are broadcast if
they are few (counted), else joined by a shuffle. The word windows of a document
are exploded as longs within the scan's stage and not shuffled then.

Null and empty texts hold nothing and match nothing; a null doc_id is reported as
such, and so is a null item_id; repeated rows are each reported, and items of one
item_id as one; empty tables give an empty result; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WINDOW, SHORT = 8, 5
#: Plain words that a window needs as an anchor.
ANCHOR = 3
COVERAGE, PASSAGE = 0.5, 6
SLACK = 4
MOST_BROADCAST = 1_000_000
#: Placeholders; capital letters don't occur among the words.
NUMBER, UNIT, NAME = "N", "U", "P"
UNITS = (
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "gram", "grams", "ton", "tons", "pound", "pounds", "lb", "lbs", "ounce", "ounces",
    "ml", "l", "litre", "litres", "liter", "liters", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "mph", "kmh",
)
TOKEN = r"[0-9]+(?:[.,][0-9]+)*+|\p{L}+|[.!?\n]"
_END = (".", "!", "?", "\n")


def _tokens(df: DataFrame) -> DataFrame:
    """df with ``raw`` (words as written) and ``canon`` (words with placeholders)."""
    both = df.withColumn("_t", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))

    def form(token: Column, last: Column) -> Column:
        low = F.lower(token)
        # words that begin with a to z, most of them, are no names and aren't compared
        other = (token < "a") | (token >= "{")
        return (
            F.when(token.isin(*_END), F.lit(""))
            .when(token < ":", F.lit(NUMBER))
            .when((last >= "0") & (last < ":") & low.isin(*UNITS), F.lit(UNIT))
            .when(other & (low != token) & ~last.isin(*_END) & (F.length(token) > 1) & (F.substr(token, F.lit(2)) == F.substr(low, F.lit(2))), F.lit(NAME))
            .otherwise(low)
        )

    lasts = F.concat(F.array(F.lit(".")), F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))))
    return (
        both.withColumn("_c", F.zip_with("_t", lasts, form))
        .withColumn("raw", F.filter("_t", lambda x: ~x.isin(*_END)))
        .withColumn("canon", F.filter("_c", lambda x: x != ""))
        .drop("_t", "_c")
    )


def _windows(df: DataFrame, size: int) -> DataFrame:
    """df with ``hashes`` and ``plain``: one long for each window of so many words of ``canon``, and of ``raw`` in lower case."""
    assert size in (WINDOW, SHORT)

    def paired(a: str, b: str, shift: int, out: str):
        n = F.greatest(F.size(b) - shift, F.lit(0))
        return lambda x: x.withColumn(out, F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(shift + 1), n), lambda p, q: F.xxhash64(p, q)))

    df = df.withColumn("_low", F.transform("raw", F.lower))
    for words, out in (("canon", "hashes"), ("_low", "plain")):
        df = df.transform(paired(words, words, 1, "_2")).transform(paired("_2", "_2", 2, "_4"))
        df = df.transform(paired("_4", "_4", 4, out) if size == WINDOW else paired("_4", words, 4, out))
    return df.drop("_low", "_2", "_4")


def _items(benchmark: DataFrame, size: int) -> DataFrame:
    """bid, q, n and n_plain (windows with an anchor, and all), hash (null without an
    anchor), plain, values and forms of each window; benchmark: bid, text."""
    items = _tokens(benchmark.select("bid", "text"))
    items = items.where(F.size("canon") >= WINDOW) if size == WINDOW else items.where(F.size("canon").between(SHORT, WINDOW - 1))
    anchored = lambda q: F.size(F.filter(F.slice("canon", q + 1, F.lit(size)), lambda x: ~x.isin(NUMBER, UNIT, NAME))) >= ANCHOR
    items = common.materialise(_windows(common.materialise(items.drop("text"), "bench-words"), size), "bench-hashes")
    rows = items.select("bid", "raw", "canon", F.posexplode_outer(F.arrays_zip("hashes", "plain")).alias("q", "x"))
    rows = rows.select("bid", "q", F.when(anchored(F.col("q")), F.col("x.hashes")).alias("hash"), F.col("x.plain").alias("plain"), F.slice("raw", F.col("q") + 1, F.lit(size)).alias("values"), F.slice("canon", F.col("q") + 1, F.lit(size)).alias("forms"))
    return rows.join(rows.groupBy("bid").agg(F.count("hash").alias("n"), F.count("plain").alias("n_plain")), "bid")


def _enough(held: str, n: str) -> Column:
    return (F.col(held) >= COVERAGE * F.col(n)) | (F.col(held) >= PASSAGE)


def _hits(rows: DataFrame, benchmark: DataFrame, size: int) -> DataFrame:
    """rid, bid, coverage, slots of the pairs that hold."""
    items = common.materialise(_items(benchmark, size), "bench-windows")
    typed, same = F.col("hash").isNotNull(), F.coalesce(F.col("hash") == F.col("plain"), F.lit(False))
    keys = items.where(typed).select("hash", "bid", "q", "n", "n_plain", typed.alias("typed"), same.alias("as_is"))
    keys = keys.unionByName(items.where(~same).select(F.col("plain").alias("hash"), "bid", "q", "n", "n_plain", F.lit(False).alias("typed"), F.lit(True).alias("as_is")))
    keys = F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys
    # an outer explode: else the optimizer repeats the arrays' whole expression in a filter below it
    both = F.concat("hashes", F.zip_with("hashes", "plain", lambda a, b: F.when(a != b, b)))
    windows = _windows(_tokens(rows), size).select("rid", F.size("hashes").alias("m"), F.posexplode_outer(both).alias("p", "hash"))
    met = common.materialise(windows.join(keys, "hash").select("rid", (F.col("p") % F.col("m")).alias("p"), "bid", "q", "n", "n_plain", "typed", "as_is"), "bench-hits")
    plain = met.where("as_is").groupBy("rid", "bid", "n_plain").agg(F.countDistinct("q").alias("held")).where(_enough("held", "n_plain"))
    plain = plain.select("rid", "bid", (F.col("held") / F.col("n_plain")).alias("coverage"), F.lit(0).cast("long").alias("slots"))
    met = met.where("typed").select("rid", "bid", "n", "p", "q")
    covered = met.groupBy("rid", "bid", "n").agg(F.countDistinct("q").alias("held")).where(_enough("held", "n"))
    covered = common.materialise(covered.select("rid", "bid"), "bench-covered")
    # The occurrences of these pairs: one diagonal, near diagonals, all of the document.
    order = Window.partitionBy("rid", "bid").orderBy("d")
    hits = met.join(covered, ["rid", "bid"], "left_semi").distinct().withColumn("d", F.col("p") - F.col("q"))
    hits = hits.withColumn("far", (F.col("d") - F.lag("d").over(order) > SLACK).cast("int")).withColumn("near", F.coalesce(F.sum("far").over(order), F.lit(0)).cast("int"))
    places = F.array(*(F.struct(F.lit(k).alias("level"), F.col(c).cast("int").alias("at")) for k, c in enumerate(("d", "near"))), F.struct(F.lit(2).alias("level"), F.lit(0).alias("at")))
    hits = common.materialise(hits.select("rid", "bid", "n", "p", "q", places.alias("places")), "bench-places")
    occurrence = ["rid", "bid", "level", "at"]
    held = hits.select("rid", "bid", "n", "q", F.explode("places").alias("x")).select("rid", "bid", "n", "q", "x.*")
    held = common.materialise(held.groupBy(*occurrence, "n").agg(F.countDistinct("q").alias("held")).where(_enough("held", "n")), "bench-occurrences")
    # Their slots, from their documents alone.
    texts = _tokens(rows.join(covered.select("rid").distinct(), "rid", "left_semi"))
    spots = hits.groupBy("rid").agg(F.collect_list(F.struct("bid", "q", "p", "places")).alias("spots"))
    cut = spots.join(texts.select("rid", "raw"), "rid").select("rid", F.explode_outer(F.transform("spots", lambda x: F.struct(x["bid"].alias("bid"), x["q"].alias("q"), x["places"].alias("places"), F.slice("raw", x["p"] + 1, F.lit(size)).alias("found")))).alias("x")).select("rid", "x.*")
    slots = (
        cut.join(items.select("bid", "q", "values", "forms").where(F.exists("forms", lambda x: x.isin(NUMBER, UNIT, NAME))), ["bid", "q"])
        .select("rid", "bid", "places", F.explode(F.arrays_zip("values", "forms", "found")).alias("s"))
        .where(F.col("s.forms").isin(NUMBER, UNIT, NAME))
        .select("rid", "bid", F.explode("places").alias("x"), F.lower("s.values").alias("value"), "s.forms", F.lower("s.found").alias("found"))
        .select("rid", "bid", "x.*", "value", "forms", "found")
        .groupBy(*occurrence, "value", "forms")
        .agg(F.countDistinct("found").alias("forms_found"))
        .groupBy(*occurrence)
        .agg(F.count("*").alias("slots"), F.sum((F.col("forms_found") > 1).cast("int")).alias("clashes"))
    )
    whole = held.join(slots, occurrence, "left").where("coalesce(clashes, 0) = 0")
    whole = whole.select("rid", "bid", (F.col("held") / F.col("n")).alias("coverage"), F.coalesce("slots", F.lit(0)).cast("long").alias("slots"))
    return whole.unionByName(plain)


def contaminated(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """rid, item_id, coverage, slots of each document (rows: rid, text) and item it holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), common.text_of().alias("text"))
    items = common.materialise(common.with_row_id(items, "bid"), "bench")
    found = _hits(rows, items, WINDOW)
    if _any_short(items):
        found = found.unionByName(_hits(rows, items, SHORT))
    return found.join(items.select("bid", "item_id"), "bid").groupBy("rid", "item_id").agg(F.max("coverage").alias("coverage"), F.max("slots").alias("slots"))


def _any_short(benchmark: DataFrame) -> bool:
    sizes = _tokens(benchmark.select(common.text_of().alias("text"))).select(F.size("canon").alias("n"))
    return bool(sizes.where(F.col("n").between(SHORT, WINDOW - 1)).take(1))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, all columns as they were."""
    numbered = common.with_row_id(docs)
    rows = numbered.select(F.col(common.RID).alias("rid"), common.text_of().alias("text"))
    bad = common.materialise(contaminated(rows, benchmark).select(F.col("rid").alias(common.RID)).distinct(), "contaminated")
    return common.but_for(numbered, bad)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: each document that holds a benchmark item, with the item."""
    rows = common.with_row_id(common.table(spark, sf_dir, "documents"), "rid").select("rid", F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    found = common.materialise(contaminated(rows.select("rid", "text"), common.table(spark, sf_dir, "benchmark")), "contaminated")
    return rows.select("rid", "doc_id").join(found, "rid").select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), "slots")
