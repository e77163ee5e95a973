"""I-Match document fingerprints with randomised lexicon subsets, in DataFrame operations alone.

The lexicon holds the terms whose document frequency, as a share of all documents, lies in ``band``: an
inverse-document-frequency band that leaves out both very frequent and very rare terms. Its size is at most the mean
number of distinct terms in a document over the band's lower end, however large the corpus, so it is broadcast
when its counted size allows and shuffled otherwise.

Every random partition of the lexicon into ``2**bits`` cells contributes its first cells as lexicon subsets; small subsets answer for long
documents and large ones for short documents. Subset 0 is the whole lexicon. A document's component of a subset is the hash of the sorted
list of its distinct terms in that subset, each term standing as its 64-bit hash. A document without any lexicon term has the
hash of all its sorted distinct terms as component 0. The fingerprint is the sorted list of (component, subset) words, in hex; the likeness of two fingerprints
is the share of the subsets that hold a term of either one in which both have the same component.

For pairs of neighbours by falling doc_id, documents are dealt into ranges of doc_id; each range also gets the
document that follows it, so one window in each range sees every successor and no task sees all rows.

Defined results: a null text is an empty one; texts without terms (letters or digits) share one fingerprint; equal texts have
equal fingerprints; rows with one doc_id follow each other by the hash of their text; null doc_ids come last; a table of one
document has that document as its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlake.llm.common import written


@dataclass(frozen=True)
class IMatchConfig:
    """``band``: shares of all documents; ``subsets``: (bits of the partition's cell number, cells taken)."""

    band: tuple[float, float] = (0.005, 0.3)
    subsets: tuple[tuple[int, int], ...] = ((3, 6), (5, 10), (7, 16), (8, 16))
    broadcast_terms: int = 2_000_000
    ranges_per_partition: int = 4
    knots: int = 256


_SPAN = 64  # a component word keeps its subset's number in the low 6 bits


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits; the empty string may be among them."""
    return F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, config: IMatchConfig) -> DataFrame:
    """``h``: hashes of the terms in the band, over all documents."""
    n = docs.count()
    low, high = max(2, math.ceil(config.band[0] * n)), config.band[1] * n
    found = docs.select(F.explode(terms(F.col("text"))).alias("term")).where("term <> ''").select(F.xxhash64("term").alias("h"))
    return written(found.groupBy("h").agg(F.count("*").alias("n")).where((F.col("n") >= low) & (F.col("n") <= max(high, low))).select("h"), "lexicon")


def components(rows: DataFrame, keys: list[str], text: str, words: DataFrame, config: IMatchConfig, carried: list[str]) -> DataFrame:
    """``keys, carried, fp``: the sorted component words of each row; rows must be clustered by the first key to need no shuffle."""
    # The array is made below the explode, so that it and its hash are made once for each row.
    listed = rows.select(*keys, *carried, F.array_distinct(F.concat(F.array(F.lit("")), terms(F.col(text)))).alias("__terms"))
    listed = listed.withColumn("__all", F.xxhash64(F.sort_array("__terms")))
    exploded = listed.select(*keys, *carried, "__all", F.explode("__terms").alias("__term")).withColumn("h", F.xxhash64("__term"))
    if words.count() <= config.broadcast_terms:
        words = F.broadcast(words)
    held = exploded.join(words.withColumn("__in", F.lit(True)), "h", "left").where("__in or __term = ''")
    whole = F.col("__term") == ""  # once in every row's list; wide columns travel with it alone
    slim = held.select(*keys, *[F.when(whole, F.col(c)).alias(c) for c in (*carried, "__all")], F.when(~whole, F.col("h")).alias("h"))
    one = slim.groupBy(*keys).agg(*[F.max(c).alias(c) for c in (*carried, "__all")], F.collect_list("h").alias("__held"))
    return one.select(*keys, *carried, subset_words(F.col("__held"), F.col("__all"), config).alias("fp"))


def subset_words(held: Column, whole: Column, config: IMatchConfig) -> Column:
    """The sorted component words of the lexicon terms ``held`` (hashes); of ``whole`` alone if there is none."""

    def places(h: Column) -> Column:
        """(subset, term) for every subset that holds the term."""
        cells, base = [F.struct(F.lit(0).cast("long").alias("j"), h.alias("h"))], 1
        for bits, n in config.subsets:
            cell = F.shiftrightunsigned(F.xxhash64(h, F.lit(bits)), 64 - bits)
            cells.append(F.when(cell < n, F.struct((cell + base).alias("j"), h.alias("h"))))
            base += n
        if base > _SPAN:
            raise ValueError(f"at most {_SPAN} subsets")
        return F.filter(F.array(*cells), lambda x: x.isNotNull())

    def word(x: Column, j: Column) -> Column:
        return F.shiftleft(F.shiftrightunsigned(x, 6), 6).bitwiseOR(j)

    def step(s: Column, t: Column) -> Column:
        """Goes on with the hash of the subset's list, or begins the next subset's."""
        same = s["j"] == t["j"]
        done = F.when(same | (s["j"] < 0), s["done"]).otherwise(F.concat(s["done"], F.array(word(s["x"], s["j"]))))
        return F.struct(t["j"].alias("j"), F.xxhash64(F.when(same, s["x"]).otherwise(t["j"]), t["h"]).alias("x"), done.alias("done"))

    none = F.lit(-1).cast("long")
    start = F.struct(none.alias("j"), none.alias("x"), F.array().cast("array<long>").alias("done"))
    listed = F.sort_array(F.flatten(F.transform(held, places)))  # by subset, then term
    made = F.aggregate(listed, start, step, lambda s: F.concat(s["done"], F.array(word(s["x"], s["j"]))))
    return F.when(F.size(held) == 0, F.array(word(whole, F.lit(0).cast("long")))).otherwise(F.sort_array(made))


def likeness(a: Column, b: Column) -> Column:
    subset = lambda fp: F.transform(fp, lambda w: w.bitwiseAND(F.lit(_SPAN - 1)))
    either = F.size(F.array_union(subset(a), subset(b)))
    return F.size(F.array_intersect(a, b)) / either


def as_hex(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda w: F.lower(F.lpad(F.hex(w), 16, "0"))), "")


def _ranges(docs: DataFrame, config: IMatchConfig) -> tuple[Column, DataFrame]:
    """The number of the range that an ``__id`` falls in, rising with it, and ``__id, target``: whose rows are also sent to range ``target``."""
    want = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * config.ranges_per_partition
    n = min(want, config.knots)
    cuts = docs.stat.approxQuantile("__id", [i / n for i in range(n + 1)], 0.2 / n) or [0.0]
    cuts = sorted({int(c) for c in cuts})
    knots = F.array(*[F.lit(c).cast("long") for c in cuts])
    at = F.greatest(F.lit(0), F.size(F.filter(knots, lambda c: c <= F.col("__id"))) - 1)
    parts = -(-want // n)
    low, high = F.get(knots, at).cast("double"), F.coalesce(F.get(knots, at + 1), F.lit(cuts[-1]) + 1).cast("double")
    share = F.least(F.lit(parts - 1), F.greatest(F.lit(0), F.floor((F.col("__id") - low) / F.greatest(high - low, F.lit(1.0)) * parts).cast("int")))
    rid = (at * parts + share).cast("int") if parts > 1 else at.cast("int")
    tops = docs.select("__id", rid.alias("rid")).groupBy("rid").agg(F.max("__id").alias("__id"))
    # At most ``want + parts`` rows in one group; a row's target is the next range above it, the highest's the lowest.
    w = Window.partitionBy(F.lit(1)).orderBy("rid")
    target = F.coalesce(F.lead("rid").over(w), F.first("rid").over(w))
    return rid, written(tops.select("__id", target.alias("target")), "tops")


def fingerprints_with_edits(docs: DataFrame, config: IMatchConfig = IMatchConfig()) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses to the edited text and the next document.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first as many of the next document by falling doc_id.
    """
    lowest = -(1 << 63)
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("__id"))
    words = lexicon(own, config)
    rid, tops = _ranges(own, config)
    sent = own.join(F.broadcast(tops), "__id", "left").select(
        "doc_id", "text", "__id", rid.alias("own"), F.when(F.col("target").isNull(), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))).alias("c"), "target"
    )
    sent = sent.select("doc_id", "text", "__id", "own", "target", F.explode("c").alias("copy"))
    sent = sent.select("doc_id", "text", "__id", "copy", F.when(F.col("copy") == 1, F.col("target")).otherwise(F.col("own")).alias("rid"))
    order = Window.partitionBy("rid").orderBy("copy", F.desc("__id"), F.desc(F.xxhash64("text")), F.desc("text"))
    near = sent.select("rid", "doc_id", "text", "copy", F.lead("text").over(order).alias("after"), F.row_number().over(order).alias("seq"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("after", F.lit("")), F.lit(1), half))
    both = near.select(
        "rid", "seq", F.col("doc_id"), n.cast("long").alias("n_chars"),
        F.explode(
            F.when(F.col("copy") == 1, F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t"))))
            .otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), edited.alias("t"))))
        ).alias("v"),
    ).select("rid", "seq", "doc_id", "n_chars", "v.side", "v.t")
    both = both.withColumn("edited_sha256", F.when(F.col("side") == 1, F.sha2("t", 256)))
    fps = components(both, ["rid", "seq", "side"], "t", words, config, ["doc_id", "n_chars", "edited_sha256"])
    w = Window.partitionBy("rid").orderBy("seq", "side")
    fps = fps.select("*", F.lag("fp").over(w).alias("own_fp"), F.lead("fp").over(w).alias("next_fp")).where("side = 1")
    return fps.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("own_fp")).alias("fingerprint"), as_hex(F.col("fp")).alias("edited_fingerprint"),
        likeness(F.col("own_fp"), F.col("fp")).alias("near_edited"), likeness(F.col("own_fp"), F.col("next_fp")).alias("near_next"),
    )


def fingerprints(docs: DataFrame, config: IMatchConfig = IMatchConfig()) -> DataFrame:
    """``doc_id, fingerprint`` of every document."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    return components(own, ["row"], "text", lexicon(own, config), config, ["doc_id"]).select("doc_id", as_hex(F.col("fp")).alias("fingerprint"))
