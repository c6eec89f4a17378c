"""Benchmark decontamination by spaced seeds.

Fixed masks pick some positions of a run of words and ignore the others, so a
hash of the picked words is equal in two texts even if ignored words were
replaced. Hashes of all benchmark runs are joined with hashes of all document
runs. A hit fixes a diagonal: where the item would lie in the document. Along
it all words are compared, and an overlap counts when some stretch of
``STRETCH`` words has at most ``REPLACED`` substitutions.

The masks together see every such stretch: whichever positions are replaced,
a mask fits between them (``tests/llm/test_decontam.py`` tries all). So the
join loses nothing that the comparison would accept.

Documents are hashed inside their rows and leave a row per hit only. The
hashes of the benchmark are broadcast while their number, which is counted, is
below a bound; beyond it the join shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.frames import col_of, stored

#: Positions that each mask looks at.
MASKS = ((0, 1, 3, 5, 6, 9), (0, 1, 2, 3, 8, 9), (0, 3, 4, 7, 9, 10))
STRETCH, REPLACED = 13, 2
#: Benchmark hashes that are broadcast at most (about 64 MB).
BROADCAST_HASHES = 1_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the words, letters and digits only, in lower case; empty for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _starts(n: Column, mask: tuple[int, ...]) -> Column:
    return F.greatest(n - mask[-1], F.lit(0))


def seeds(h: str) -> Column:
    """Seed hashes of a column of word hashes in one array: mask by mask, start by start."""
    def of(no: int, mask: tuple[int, ...]) -> Column:
        starts = F.when(F.size(h) > mask[-1], F.sequence(F.lit(0), F.size(h) - (mask[-1] + 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.lit(no), *[F.get(F.col(h), i + p) for p in mask]))
    return F.concat(*[of(no, mask) for no, mask in enumerate(MASKS)])


def start_of(position: Column, n: Column) -> Column:
    """The start that a position of ``seeds`` stands for, in a text of ``n`` words."""
    result, before = F.lit(None).cast("int"), F.lit(0)
    for mask in MASKS:
        result = F.when(position >= before, position - before).otherwise(result)
        before = before + _starts(n, mask)
    return result


def overlaps(docs: DataFrame, tests: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
             bound: int = BROADCAST_HASHES) -> DataFrame:
    """One row per document and benchmark item that overlap: ``doc_id``, ``item_id``, ``matched_words`` and ``compared_words``.

    The two counts are those of the best diagonal (most equal words) over the
    part of the item that lies within the document. Texts shorter than
    ``STRETCH`` words, null and empty ones overlap with nothing. Rows with
    equal ids are one document (or item) each of whose texts is compared;
    null ids are kept. Empty tables give an empty result. Other columns are
    not read, so their names don't matter.
    """
    d = docs.select(col_of(docs, id).alias("doc_id"), F.coalesce(col_of(docs, text), F.lit("")).alias("text"))
    t = tests.select(col_of(tests, item).alias("item_id"), word_hashes(col_of(tests, item_text)).alias("ih")).distinct()
    t = stored(t.withColumn("item_key", F.xxhash64("item_id", "ih")), "benchmark_items")
    probes = t.select("item_key", F.size("ih").alias("n"), F.posexplode(seeds("ih")).alias("p", "seed"))
    probes = probes.select("item_key", "seed", start_of(F.col("p"), F.col("n")).alias("item_at"))
    probes = stored(probes, "benchmark_seeds")
    sides = F.broadcast(probes) if probes.count() <= bound else probes
    hashed = d.select("doc_id", F.xxhash64("text").alias("text_key"), word_hashes(F.col("text")).alias("dh"))
    runs = hashed.select("doc_id", "text_key", F.size("dh").alias("n"), F.posexplode(seeds("dh")).alias("p", "seed"))
    shift = start_of(F.col("p"), F.col("n")) - F.col("item_at")
    hits = runs.join(sides, "seed").select("doc_id", "text_key", "item_key", shift.alias("shift")).distinct()
    hits = stored(hits, "seed_hits")
    # Only texts with a hit go on; they are few, and Spark broadcasts their keys while the stored table is small.
    near = d.withColumn("text_key", F.xxhash64("text")).join(
        hits.select(F.col("doc_id").alias("hit_doc"), F.col("text_key").alias("hit_text")).distinct(),
        F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_text")), "left_semi")
    # Rows of equal id and text are one. Stored, so that the words are cut once per text and not once per diagonal.
    near = stored(near.dropDuplicates(["doc_id", "text_key"]).select("doc_id", "text_key", word_hashes(F.col("text")).alias("dh")), "near_texts")
    lined = hits.withColumnsRenamed({"doc_id": "hit_doc", "text_key": "hit_text"}).join(t, "item_key")
    same_doc = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("text_key") == F.col("hit_text"))
    start = F.greatest(F.lit(0), -F.col("shift"))
    stop = F.least(F.size("ih"), F.size("dh") - F.col("shift"))
    # Of the text only what lies beside the item goes along with a diagonal.
    found = near.join(lined, same_doc).select("doc_id", "item_id", "ih", start.alias("start"), stop.alias("stop"),
                                              F.slice("dh", start + F.col("shift") + 1, F.greatest(stop - start, F.lit(0))).alias("dh"))
    found = stored(found.filter(F.col("stop") - F.col("start") >= STRETCH), "seed_diagonals")
    equal = F.zip_with(F.slice("ih", F.col("start") + 1, F.col("stop") - F.col("start")), "dh", lambda x, y: (x == y).cast("int"))
    # A stretch with so many replaced words lies between two other places: the ends, or words that differ as well.
    differ = lambda e: F.concat(F.array(F.lit(-1)), F.filter(F.transform(e, lambda x, i: F.when(x == 0, i)), lambda i: i.isNotNull()), F.array(F.size(e)))
    seen = lambda e, d, i: F.coalesce(F.get(d, i + REPLACED + 1), F.size(e)) - F.get(d, i) > STRETCH
    local = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    # One-element arrays stand in for local variables: named in a filter, the comparison would be done again for every word.
    judged = local(equal, lambda e: local(differ(e), lambda d: F.struct(
        F.exists(F.sequence(F.lit(0), F.size(d) - 2), lambda i: seen(e, d, i)).alias("met"), (F.size(e) - F.size(d) + 2).alias("m"), F.size(e).alias("n"))))
    found = stored(found.select("doc_id", "item_id", judged.alias("j")), "compared").filter("j.met")
    top = F.max(F.struct("j.m", "j.n")).alias("top")
    return found.groupBy("doc_id", "item_id").agg(top).select(
        "doc_id", "item_id", F.col("top.m").cast("long").alias("matched_words"), F.col("top.n").cast("long").alias("compared_words"))


def clean_rows(docs: DataFrame, tests: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap with no item, with the columns they came with."""
    found = "_found"
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*[col_of(docs, c).alias(n) for c, n in names.items()])
    bad = overlaps(renamed, tests, names[id], names[text]).select(F.col("doc_id").alias(found)).distinct()
    kept = renamed.join(stored(bad, "unclean"), F.col(names[id]).eqNullSafe(F.col(found)), "left_anti")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])
