"""Benchmark passages in training documents, by a positional inverted index. DataFrame functions only.

Each window of a test item is looked up by its terms' posting lists, rarest term first: the
lists of the two rarest are joined over the whole corpus, the other terms' lists are built
around what these have in common alone, and lists moved by their offsets are intersected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WINDOW = 10
#: Words that a proximity match may have between those of its window.
SLACK = 5
#: Test-side tables are broadcast up to this size in bytes and joined by shuffles beyond.
BROADCAST_BYTES = 48 << 20
#: Places where a term's postings are looked up if the test side is too large to broadcast.
SALTS = 32

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case and all else as it is: lower() where it changes nothing else."""
    return F.when(text.rlike(r"[[\p{IsUppercase}\p{Lt}]&&[^A-Z]]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def terms(text: Column) -> Column:
    """The words of a text; the first and the last of the array may be empty and count as none."""
    return F.split(lowered(F.coalesce(text, F.lit(""))), _BETWEEN)


def _small(df: DataFrame, *texts: str) -> bool:
    """Whether a test-side table, by its rows and the bytes of these columns, is safe to broadcast."""
    size = F.lit(64)
    for t in texts:
        size = size + F.octet_length(F.col(t))
    return (df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first().n) <= BROADCAST_BYTES


def _looked_up(rows: DataFrame, side: DataFrame, by: list[str], small: bool) -> DataFrame:
    """rows joined with a test-side table: broadcast if small, else dealt by key and salt, as a frequent term's postings don't fit a task."""
    if small:
        return rows.join(F.broadcast(side), by)
    salts = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "position"), F.lit(SALTS)).cast("int")).join(salts, [*by, "salt"]).drop("salt")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, words and place of each window; an item of fewer words, but not none, is one."""
    items = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.filter(terms(F.col("text")), lambda w: w != "").alias("words")).where(F.size("words") > 0).distinct()
    return items.select("item_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1))), lambda i: F.slice("words", i, size))).alias("place", "words"))


def postings(documents: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """term, doc_id and position of each occurrence of the vocabulary's terms: their inverted lists."""
    words = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.posexplode(terms(F.col("text"))).alias("position", "term"))
    return _looked_up(words, vocabulary, ["term"], _small(vocabulary, "term"))


def by_rarity(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wid, terms) of the windows (wid, words) whose terms all occur: structs of term, offset and count in the corpus, rarest first."""
    each = wanted.select("wid", F.posexplode("words").alias("offset", "term"))
    vocabulary = stored(each.select("term").distinct(), "vocabulary")
    corpus = documents.select(F.lit(0).cast("long").alias("doc_id"), F.posexplode(terms(F.col("text"))).alias("position", "term"))
    counts = _looked_up(corpus, vocabulary, ["term"], _small(vocabulary, "term")).groupBy("term").agg(F.count("*").alias("n"))
    known = each.join(counts, "term").groupBy("wid").agg(F.array_sort(F.collect_list(F.struct("n", "term", "offset"))).alias("terms"))
    # a window with a term that no document has occurs nowhere
    return known.join(wanted, "wid").where(F.size("terms") == F.size("words")).select("wid", "terms")


@dataclass
class Found:
    """Where windows' rarest lists meet, and what the other lists say there."""

    wanted: DataFrame  # wid, item_id, words
    exact: DataFrame  # wid, doc_id, start
    near: DataFrame  # wid, doc_id, position; in documents without the exact window


def _second(terms: Column) -> Column:
    """The rarest entry of another term than the first; the first where a window has one term alone."""
    return F.coalesce(F.get(F.filter(terms, lambda t: t.term != terms[0].term), F.lit(0)), terms[0])


def _blocks(position: Column, reach: int) -> Column:
    """The blocks of `reach` words whose words may lie within `reach` of a position."""
    own = F.floor(position / reach).cast("int")
    return F.array(own - 1, own, own + 1)


def search(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = SLACK) -> Found:
    """Intersects the windows' posting lists, rarest terms first.

    The lists of each window's two rarest terms are stored and joined where they come within
    reach of each other; of the other terms' lists only the parts around these places are
    built, and intersected by offset (exact) or by distance (near). Every join has a document
    and a position or block in its key, but for the first, which is with the test side.
    """
    each = stored(windows(benchmark, size).drop("place").distinct(), "windows")
    words = stored(each.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()), "wanted")
    wanted = each.join(words, "words")
    reach = size + slack
    ranked = stored(by_rarity(documents, words), "ranked").withColumn("one", F.col("terms")[0]).withColumn("two", _second(F.col("terms")))
    pairs = stored(ranked.select(F.col("one.term").alias("term"), F.col("two.term").alias("other")).distinct(), "pairs")
    index = stored(postings(documents, pairs.select(F.explode(F.array("term", "other")).alias("term")).distinct()), "postings")
    starts = _looked_up(index, pairs, ["term"], _small(pairs, "term", "other")).select("doc_id", "term", "position", "other", F.floor(F.col("position") / reach).cast("int").alias("block"))
    others = index.select("doc_id", F.col("term").alias("other"), F.col("position").alias("place"), F.explode(_blocks(F.col("position"), reach)).alias("block"))
    met = starts.join(others, ["doc_id", "other", "block"]).where(F.abs(F.col("position") - F.col("place")) < reach).select("doc_id", "term", "position", "other", "place")
    met = stored(_looked_up(met, ranked.select("wid", "terms", F.col("one.term").alias("term"), F.col("two.term").alias("other"), F.col("one.offset").alias("first"), F.col("two.offset").alias("second")), ["term", "other"], _small(ranked.select(F.to_json("terms").alias("terms")), "terms")), "met")
    # the other lists, around these places alone
    around = met.select("doc_id", F.explode(_blocks(F.col("position"), reach)).alias("block")).distinct()
    vocabulary = met.select(F.explode("terms.term").alias("term")).distinct()
    some = documents.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    lists = postings(some, stored(vocabulary, "met-terms")).withColumn("block", F.floor(F.col("position") / reach).cast("int")).join(around, ["doc_id", "block"], "left_semi")
    lists = stored(lists.select("doc_id", "term", "position", "block").distinct(), "lists")
    aligned = met.where(F.col("place") - F.col("second") == F.col("position") - F.col("first")).select("wid", "doc_id", (F.col("position") - F.col("first")).alias("start"), "terms").distinct()
    each_term = aligned.select("wid", "doc_id", "start", F.size("terms").alias("n"), F.explode("terms").alias("t")).select("wid", "doc_id", "start", "n", (F.col("start") + F.col("t.offset")).alias("position"), F.col("t.term").alias("term"))
    exact = each_term.join(lists.drop("block"), ["doc_id", "position", "term"]).groupBy("wid", "doc_id", "start", "n").agg(F.count("*").alias("had")).where("had = n").select("wid", "doc_id", "start")
    exact = stored(exact, "exact")
    left = met.select("wid", "doc_id", "position", "terms").distinct().join(exact, ["wid", "doc_id"], "left_anti")
    left = left.withColumn("need", F.explode(F.array_distinct("terms.term")))
    spots = lists.select("doc_id", F.col("term").alias("need"), F.col("position").alias("place"), F.explode(_blocks(F.col("position"), reach)).alias("block"))
    close = left.withColumn("block", F.floor(F.col("position") / reach).cast("int")).join(spots, ["doc_id", "need", "block"]).where(F.abs(F.col("position") - F.col("place")) < reach)
    close = close.groupBy("wid", "doc_id", "position").agg(F.collect_set(F.struct("place", "need")).alias("spots"), F.first("terms.term").alias("words"))
    span = F.size("words") + slack
    within = lambda s, w: F.size(F.filter("spots", lambda x: (x.need == w) & (x.place >= s) & (x.place < s + span)))
    many = lambda w: F.size(F.filter("words", lambda y: y == w))
    fits = F.exists(F.sequence(F.col("position") - span + 1, F.col("position")), lambda s: F.forall("words", lambda w: within(s, w) >= many(w)))
    return Found(wanted, exact, close.where(fits).select("wid", "doc_id", "position"))


def matches(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """item_id, doc_id, start and length (in words) of each occurrence of each window."""
    return _matches(search(documents, benchmark, size, slack=0))


def _matches(found: Found) -> DataFrame:
    wanted = found.wanted.select("wid", "item_id", F.size("words").alias("length"))
    return found.exact.join(wanted, "wid").select("item_id", "doc_id", "start", "length").distinct()


def proximity_matches(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """(item_id, doc_id) where all terms of a window, in any order, lie within `slack` words more than its own.

    Counted by terms: a term that a window has twice must occur twice. Exact matches are such too.
    """
    return _near(search(documents, benchmark, size, slack))


def _near(found: Found) -> DataFrame:
    both = found.exact.select("wid", "doc_id").union(found.near.select("wid", "doc_id"))
    return both.join(found.wanted.select("wid", "item_id"), "wid").select("item_id", "doc_id").distinct()


def near_items(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """doc_id and n_near_items for each document: the items that proximity_matches finds in it."""
    documents, benchmark = documents.select("doc_id", "text"), benchmark.select("item_id", "text")
    near = _counted(search(documents, benchmark, size, slack))
    return documents.select("doc_id").join(near, "doc_id", "left").select("doc_id", F.coalesce("n_near_items", F.lit(0)).alias("n_near_items"))


def _counted(found: Found) -> DataFrame:
    return _near(found).groupBy("doc_id").agg(F.count("*").alias("n_near_items"))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW, slack: int = SLACK, near: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and, if `near`, n_near_items for each document.

    n_hit counts the words inside any occurrence of any window, each once; n_near_items the
    items with a window whose words lie close together in any order. Null and empty texts have
    no words; a null doc_id is never hit; documents with the same doc_id share their hits;
    repeated items and items without an id add nothing; other columns are left out, whatever
    their names. An empty benchmark hits nothing.
    """
    documents, benchmark = documents.select("doc_id", "text"), benchmark.select("item_id", "text")
    seen = search(documents, benchmark, size, slack if near else 0)
    found = stored(_matches(seen), "matches")
    spans = found.select("doc_id", "start", (F.col("start") + F.col("length")).alias("end")).distinct()
    before = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    new = spans.withColumn("from", F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0)))).where(F.col("end") > F.col("from"))
    hit = new.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("from")).alias("n_hit"))
    items = found.select("doc_id", "item_id").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    items = items.select("doc_id", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    parts = F.split(F.coalesce("text", F.lit("")), _BETWEEN_ANY_CASE)
    rows = documents.select("doc_id", parts.alias("parts"))
    empty = (F.col("parts")[0] == "").cast("int") + ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")
    rows = rows.select("doc_id", (F.size("parts") - empty).cast("long").alias("n_words"))
    said = hit.join(items, "doc_id")
    both = rows.join(_counted(seen).join(said, "doc_id", "left") if near else said, "doc_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    more = [F.coalesce("n_near_items", F.lit(0)).alias("n_near_items")] if near else []
    return both.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), *more)
