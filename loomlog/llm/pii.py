"""Operator 6: personal data by patterns, and by contexts that the patterns' finds teach.

Base spans come from four patterns with checks (value range, Luhn, digit count).
They are the seeds of a bootstrap: the two words before a seed are a lexical
pattern; patterns and the identifiers found after them form a graph, on which
scores are passed back and forth: a pattern's score is the scored share of all
its occurrences in the corpus, ordinary words included, an identifier's score the
chance that at least one of its patterns is right. Identifiers over the threshold
are seeds of the next round; those with at least one strong pattern are trusted, and
all their occurrences become spans of kind ``id``, whatever stands before them.

Where fewer than two words lie between a match and the one of its kind before it (or
the text's start), markers take their places, so that every match has a pattern.

All of it is DataFrame and SQL functions. Offsets are code points: a text is split
at a pattern and the pieces' lengths are summed, so that no row of Python is run.
Patterns use possessive quantifiers and start only where a run of their
characters starts, which finds the same matches in time linear in the text.

Null texts count as empty; a null doc_id is kept as one; repeated rows are each
answered; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Kinds in their order, and patterns in Java's syntax.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*BASE, "id"]
#: What a text must hold for a kind's pattern to be tried.
TRIGGER = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){13}", "phone": r"\+[0-9]"}
#: Identifier-like: a run of five or more letters, digits, _ and - that holds a digit.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9_-]{5,}+"
#: What parts words; markers of the text's start and of the match before, which no word equals.
APART = r"[^\p{L}\p{N}=:#]+"
START, MATCH = "^", "§"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _valid() -> Column:
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    luhn = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when(i % 2 == 1, F.substring(digits, n - i + 1, F.lit(1)).cast("int")).otherwise(_doubled(F.substring(digits, n - i + 1, F.lit(1)).cast("int"))),
    )
    return (
        F.when(F.col("kind") == "ip", F.col("match").rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"))
        .when(F.col("kind") == "card", F.when(n.between(14, 19), luhn % 10 == 0).otherwise(False))
        .when(F.col("kind") == "phone", n.between(10, 15))
        .otherwise(True)
    )


def _doubled(d: Column) -> Column:
    return F.when(d > 4, d * 2 - 9).otherwise(d * 2)


def matches(docs: DataFrame, patterns: dict[str, str], when: dict[str, str]) -> DataFrame:
    """rid, kind, match, start, end, context, after of every match; docs: rid, text.

    context: xxHash64 of the two words before the match, with markers where there are
    fewer since the match before it; after: that of a marker and the first word after it."""
    trigger = "|".join(f"(?:{x})" for x in when.values())
    held = docs.where(F.col("text").rlike(trigger))
    parts = []
    for kind, pattern in patterns.items():
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        gaps = F.split("text", pattern, -1)
        pairs = F.zip_with(gaps, found, lambda gap, match: F.struct(gap.alias("left"), match.alias("match")))
        rows = F.zip_with(pairs, F.slice(gaps, 2, F.size(found)), lambda x, right: F.struct(F.lit(kind).alias("kind"), x["left"].alias("left"), x["match"].alias("match"), right.alias("right")))
        parts.append(F.when(F.col("text").rlike(when[kind]), rows))
    rows = held.select("rid", F.explode_outer(F.array(*parts)).alias("rows")).select("rid", F.posexplode_outer("rows").alias("i", "x")).select("rid", "i", "x.*").where(F.col("match").isNotNull())
    marker = F.when(F.col("i") == 0, START).otherwise(MATCH)
    words = F.concat(F.array(marker, marker), _words("left"))
    follows = F.get(_words("right"), F.lit(0))
    rows = rows.select(
        "rid", "i", "kind", "match", F.length("left").alias("gap"), F.xxhash64(F.element_at(words, -2), F.element_at(words, -1)).alias("context"), F.when(follows.isNotNull(), F.xxhash64(F.lit(MATCH), follows)).alias("after")
    )
    order = Window.partitionBy("rid", "kind").orderBy("i")
    before = F.sum(F.col("gap") + F.length("match")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select("rid", "kind", "match", "context", "after", (before - F.length("match")).cast("long").alias("start"), before.cast("long").alias("end"))


def _words(text: str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), APART, " "), " "), lambda x: x != "")


def _apart(base: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that share no character with a base span of their text."""
    rows = base.withColumn("known", F.lit(True)).unionByName(candidates.withColumn("known", F.lit(False)))
    order = Window.partitionBy("rid").orderBy("start", F.desc("known"))
    ends = F.max(F.when(F.col("known"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = F.min(F.when(F.col("known"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    marked = rows.withColumn("_ends", ends).withColumn("_starts", starts)
    return marked.where("not known and coalesce(_ends <= start, true) and coalesce(_starts >= end, true)").drop("known", "_ends", "_starts")


def _occurrences(docs: DataFrame, found: DataFrame, contexts: DataFrame) -> DataFrame:
    """How often each context stands in the corpus, over all texts: context, total.

    found: all matches, valid or not, as contexts with markers of a match stand after them."""
    words = F.concat(F.array(F.lit(START), F.lit(START)), _words("text"))
    pairs = docs.select(words.alias("w")).select(F.explode(F.expr("zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), (a, b) -> xxhash64(a, b))")).alias("context"))
    after = found.select(F.explode(F.array(F.xxhash64(F.lit(MATCH), F.lit(MATCH)), "after")).alias("context")).where("context is not null")
    known = contexts.select("context").distinct()
    if known.limit(200_001).count() <= 200_000:  # 8 bytes each
        total = pairs.unionByName(after).join(F.broadcast(known), "context").groupBy("context").agg(F.count("*").alias("total"))
    else:
        total = pairs.unionByName(after).groupBy("context").agg(F.count("*").alias("total"))
    # one whose matches always continue its last word may stand nowhere else
    return known.join(total, "context", "left").select("context", F.coalesce("total", F.lit(0)).alias("total"))


def bootstrap(docs: DataFrame, raw: DataFrame, base: DataFrame, rounds: int = 3, support: int = 3, threshold: float = 0.8) -> DataFrame:
    """rid, start, end of identifiers that the base spans' contexts lead to; raw: the
    base patterns' matches, base: the valid ones.

    A pattern needs ``support`` distinct values, whatever the size of the corpus."""
    like = common.materialise(matches(docs, {"id": CANDIDATE}, {"id": r"[A-Za-z0-9_-]{4}[0-9]|[0-9][A-Za-z0-9_-]{4}|[A-Za-z_-][0-9]"}), "pii-candidates")
    candidates = _apart(base, like)
    found = raw.unionByName(like)
    graph = common.materialise(base.withColumn("seed", F.lit(True)).unionByName(candidates.withColumn("seed", F.lit(False))).drop("after"), "pii-graph")
    frequent = graph.groupBy("context").agg(F.countDistinct("match").alias("values"), F.max((~F.col("seed")).cast("int")).alias("leads")).where(f"values >= {support} and leads = 1")
    frequent = common.materialise(frequent.select("context"), "pii-contexts")
    if not frequent.take(1):
        return graph.where("false").select("rid", "start", "end")
    edges = common.materialise(graph.join(frequent, "context").groupBy("context", "match", "seed").agg(F.count("*").alias("n")), "pii-edges")
    scores = edges.where("seed").select("match", F.lit(1.0).alias("score")).distinct()
    totals = None
    for _ in range(rounds):
        scored = edges.join(scores, "match", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        backed = scored.groupBy("context").agg(
            F.sum(F.col("n") * F.col("score")).alias("right"), F.sum("n").alias("own"), F.countDistinct(F.when(F.col("score") >= threshold, F.col("match"))).alias("backed")
        )
        backed = common.materialise(backed.where(f"backed >= {support}"), "pii-backed")
        # only contexts that are patterns by now are counted in the corpus, each of them once
        new = backed.select("context") if totals is None else backed.select("context").join(totals, "context", "left_anti")
        if totals is None or new.take(1):
            counted = common.materialise(_occurrences(docs, found, new), "pii-totals")
            totals = counted if totals is None else totals.unionByName(counted)
        patterns = backed.join(totals, "context").select("context", F.least(F.lit(0.999), F.col("right") / F.greatest("total", "own")).alias("weight"))
        scores = common.materialise(
            edges.join(patterns, "context").groupBy("match").agg((1 - F.exp(F.sum(F.log1p(-F.col("weight"))))).alias("score")), "pii-scores"
        )
    trusted = scores.where(F.col("score") >= threshold).select("match")
    strong = common.materialise(patterns.where(F.col("weight") >= threshold / 2).select("context"), "pii-strong")
    trusted = trusted.join(edges.join(strong, "context", "left_semi").select("match"), "match", "left_semi")
    return graph.where("not seed").join(trusted, "match", "left_semi").select("rid", "start", "end")


def find(docs: DataFrame) -> DataFrame:
    """rid, kind, start, end of all spans; docs: rid, text (no nulls)."""
    raw = common.materialise(matches(docs, BASE, TRIGGER), "pii-matches")
    base = common.materialise(raw.where(_valid()), "pii-base")
    found = bootstrap(docs, raw, base)
    return base.select("rid", "kind", "start", "end").unionByName(found.withColumn("kind", F.lit("id")).select("rid", "kind", "start", "end"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["rank"] == rank)).cast("long")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of each row of docs."""
    rows = common.with_row_id(docs, "rid").select("rid", F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    spans = find(rows.select("rid", "text")).select("rid", F.struct("start", rank.alias("rank"), "end").alias("x"))
    every = F.coalesce(F.col("all"), F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"))
    per = spans.groupBy("rid").agg(F.collect_list("x").alias("all"))
    base = F.filter(every, lambda x: x["rank"] < len(BASE))
    counts = [_count(every, k).alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    return rows.select("rid", "doc_id").join(per, "rid", "left").select("doc_id", *counts, F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(every).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: personal data in every document."""
    return report(common.table(spark, sf_dir, "documents"))
