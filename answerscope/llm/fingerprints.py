"""Document fingerprints by one-permutation MinHash, in SQL functions only.

Each shingle of words is hashed once; the top bits of the hash name its bin,
and a bin keeps its least hash. All of it happens inside the row: a value that
marks each bin's upper end joins the hashes, these are sorted, and the first
of each bin is its least hash, or the mark if the bin is empty. Empty bins are
filled by optimal densification: each probes the other bins in an order that
only its own number determines (a rule makes these orders) and takes the value
of the first bin that isn't empty. Stored are the ``BITS`` low bits of every
bin, as hexadecimal digits. Two random bins agree in these by chance once in
2^BITS, which the likeness corrects.

Defined results: a null or empty text has no shingles, and its fingerprint is
all zeros with likeness 1 to another such, 0 to any other; texts of fewer
words than a shingle are one shingle; equal texts have equal fingerprints;
repeated rows and ids are rows of their own, in the order of their texts'
hashes, and null ids come first; an empty table gives no rows; a very long text
is worked on in memory of some times its size; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.llm.common import SPACE, whole_text

#: Bins, a power of two; bits stored of each, as one hexadecimal digit.
BINS, BITS, SHINGLE = 128, 4, 5
SHIFT = 63 - (BINS.bit_length() - 1)
#: Probes that are tried one by one; a fuller walk follows where they all hit empty bins.
PROBES = 8
#: Documents of a range block, about, in which each one's neighbour is found, and the fewest blocks.
BLOCK_DOCS, FEWEST = 20_000, 256
#: Quantiles that are asked for; each of their ranges is cut evenly into more blocks as documents grow.
QUANTILES = 1024
#: Blocks up to which their first ids (24 bytes each) are broadcast.
BROADCAST = 1_000_000


def shingle_hashes(text: Column, size: int) -> Column:
    """63-bit hashes of a text's shingles."""
    words = F.filter(F.split(F.lower(text), SPACE), lambda w: w != "")

    def of(hashes: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(hashes) - size), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
        whole = F.when(F.size(hashes) > 0, F.array(F.xxhash64(F.array_join(hashes, ",")))).otherwise(F.array().cast("array<long>"))
        return F.when(F.size(hashes) >= size, runs).otherwise(whole)

    # one-element arrays bind a value, so that it is made once
    every = F.get(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), of), 0)
    return F.transform(every, lambda h: h.bitwiseAND(F.lit((1 << 63) - 1)))


def fingerprint(text: Column, bins: int = BINS, size: int = SHINGLE) -> Column:
    """``bins`` hexadecimal digits."""
    marks = F.array(*[F.lit((b << SHIFT) + (1 << SHIFT) - 1).cast("long") for b in range(bins)])

    def probe(known: Column, i: Column, a: Column | int) -> Column:
        # start and step of the walk come from the bin's number; an odd step visits all bins before it repeats one
        return F.get(known, (i * 40503 + 12829 + ((i * 24593 + 7919) % (bins // 2) * 2 + 1) * a) % bins)

    def fill(known: Column, i: Column) -> Column:
        later = F.filter(F.transform(F.sequence(F.lit(PROBES), F.lit(bins - 1)), lambda a: probe(known, i, a)), lambda v: v.isNotNull())
        return F.coalesce(F.get(known, i), *[probe(known, i, a) for a in range(PROBES)], F.get(later, 0))

    def dense(known: Column) -> Column:
        digits = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.hex(fill(known, i).bitwiseAND(F.lit((1 << BITS) - 1))))
        return F.when(F.exists(known, lambda v: v.isNotNull()), F.lower(F.array_join(digits, ""))).otherwise(F.lit("0" * bins))

    def first(sorted_: Column) -> Column:
        own = lambda v: F.shiftright(v, SHIFT)
        return F.filter(sorted_, lambda v, i: (i == 0) | (own(v) != own(F.get(sorted_, F.greatest(i - 1, F.lit(0))))))

    hashes = F.sort_array(F.concat(shingle_hashes(text, size), marks))
    least = F.get(F.transform(F.array(hashes), first), 0)
    mark = F.lit((1 << SHIFT) - 1)
    known = F.transform(least, lambda v: F.when(v.bitwiseAND(mark) != mark, v))
    return F.get(F.transform(F.array(known), dense), 0)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard likeness of the texts of two fingerprints, corrected for chance agreement."""
    same = F.lit(0)
    for at in range(1, bins + 1, 8):  # eight digits are 32 bits; those of equal digits are all zero
        x = F.conv(F.substring(a, at, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, at, 8), 16, 10).cast("long"))
        some = x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseOR(F.shiftright(x, 3)).bitwiseAND(F.lit(0x11111111))
        same = same + 8 - F.bit_count(some)
    same = same / bins
    chance = 1.0 / (1 << BITS)
    none = F.lit("0" * bins)
    return F.when(a == b, 1.0).when((a == none) | (b == none), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def with_next(docs: DataFrame, blocks: int | None = None) -> DataFrame:
    """(doc_id, text, fingerprint, next_text, next_fingerprint); next is by ascending doc_id, after the last comes the first.

    Documents are dealt to range blocks by quantiles of their ids, so that no
    task holds more than a block; a block's last document takes its neighbour
    from the first of the next block that has any.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    if blocks is None:
        blocks = max(FEWEST, docs.count() // BLOCK_DOCS)
    wide, parts = min(blocks, QUANTILES), -(-blocks // min(blocks, QUANTILES))
    edges = rows.agg(F.percentile_approx("doc_id", [i / wide for i in range(wide + 1)], 40 * wide).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    if len(edges) > 1:
        table, at = F.array(*[F.lit(e).cast("long") for e in edges]), F.col("doc_id")
        place = F.least(F.lit(len(edges) - 1), F.greatest(F.lit(1), F.size(F.filter(F.array(*[F.lit(e).cast("long") for e in edges]), lambda e: e <= at))))
        low, high = F.element_at(table, place).cast("double"), F.element_at(table, place + 1).cast("double")
        within = F.floor((at.cast("double") - low) / (high - low) * parts) if parts > 1 else F.lit(0)
        block = (place - 1).cast("long") * parts + F.least(F.lit(parts - 1), F.greatest(F.lit(0), within))
    else:
        block = F.lit(0).cast("long")
    block = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(block)  # null ids come first
    dealt = rows.withColumn("block", block).withColumn("fingerprint", fingerprint(F.col("text")))
    order = ["doc_id", F.xxhash64("text")]
    lead = W.partitionBy("block").orderBy(*order)
    both = F.struct("text", "fingerprint")
    linked = dealt.withColumn("_next", F.lead(both).over(lead))
    ids = rows.withColumn("block", block)
    starts = ids.groupBy("block").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("h"))).alias("first"))  # a row a block
    firsts = rows.withColumn("block", block).withColumn("h", F.xxhash64("text")).join((F.broadcast(starts) if blocks <= BROADCAST else starts).select("block", "first"), "block").where("doc_id <=> first.doc_id and h = first.h")
    firsts = firsts.dropDuplicates(["block"]).select("block", "text", fingerprint(F.col("text")).alias("fingerprint"))
    all_blocks = W.orderBy("block")
    ahead = starts.select("block", F.coalesce(F.lead("block").over(all_blocks), F.first("block").over(all_blocks)).alias("after"))  # a row a block, a few bytes each
    bridge = firsts.withColumnRenamed("block", "after").join(ahead, "after").select("block", F.struct("text", "fingerprint").alias("_bridge"))
    # dealt by block already, so that this join moves no more than the bridge
    whole = linked.join(bridge.withColumnRenamed("block", "_block"), (F.col("block") == F.col("_block")) & F.col("_next").isNull(), "left")
    return whole.withColumn("_next", F.coalesce("_next", "_bridge")).select("doc_id", "text", "fingerprint", F.col("_next.text").alias("next_text"), F.col("_next.fingerprint").alias("next_fingerprint"))


def edited(text: Column, other: Column) -> Column:
    """The last quarter of a text replaced by as much of the start of another."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - quarter), F.substr(other, F.lit(1), quarter))
