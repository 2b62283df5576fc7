"""Near-duplicate documents by a signature-coordinate inverted join.

Each document's set of word shingles gets a MinHash signature of ``coordinates``
values. Documents with equal sets form one class. Classes are posted under
each (coordinate, value) pair; two classes whose sets are as similar as asked
for agree in at least ``matches`` coordinates, all but once in a million.

Prefix: values that nobody else has can't collide; of a class's other values
only the rarest ``others - matches + 1`` need posting, since two classes with
``matches`` values in common must then meet under one of them. Skip: the
common values beyond that are never merged; they are only looked up, when the
collisions of two signatures are counted.

Pairs that reach the match count are confirmed on the full shingle sets. They
are built in two steps, so that a large group of near copies costs its size
and not its square: first each posting list is linked to its central member
(the one whose values are the most common), and the links give components;
then members of one list that are still in different components, and share
enough shingles with any others at all, are posted once more under pairs of
neighbouring coordinates, and paired there; a long list is dealt to many
tasks. No link between components is lost by that, and links inside of one don't
matter. Defined results: null and empty texts, and texts without words,
have no shingles and are linked with nothing; a text of fewer words than a
shingle is one shingle; equal texts meet in one class; repeated ids are
treated row by row; a null id forms a component like any other row, and loses
against other ids; an empty table gives no rows; a very long text is hashed a
block at a time; other columns are ignored by ``link`` and kept by
``drop_duplicates``.
"""

from __future__ import annotations

from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from answerscope.llm import words
from answerscope.llm.common import whole_text, written
from answerscope.llm.graph import components

#: Posts of one value that meet its centre in one task, about.
STAR = 20_000
COORDINATES = 32
MISSED = 1e-6
#: Members of a list, about, that each member meets in one task; longer lists are dealt to more tasks.
SALTED = 1000
U = np.uint64


def least_matches(similarity: float, coordinates: int = COORDINATES) -> int:
    """The most matches that a pair of just this similarity reaches with probability 1 - MISSED."""
    below = 0.0
    for m in range(coordinates + 1):
        below += comb(coordinates, m) * similarity**m * (1 - similarity) ** (coordinates - m)
        if below > MISSED:
            return m
    return coordinates


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Of each text, the sorted distinct hashes of its shingles, letters A-Z in lower case."""
    w = words.split(texts, lower=True)
    every = words.rolling(w.hash, size)
    out = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif b > a:
            out.append(words.mix(words.whole(w.hash[a:b]) + U(b - a)))
        else:
            out.append(np.empty(0, dtype=U))
    return out


@lru_cache(maxsize=4)
def families(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = words.mix(np.arange(1, 2 * coordinates + 1, dtype=U) * U(words.BASE))
    return seeds[:coordinates, None] | U(1), seeds[coordinates:, None]


def signature(hashes: np.ndarray, coordinates: int) -> np.ndarray:
    """(coordinate, least value) pairs, each in one number: 8 bits and 55 bits."""
    times, plus = families(coordinates)
    least = np.full(coordinates, np.iinfo(U).max, dtype=U)
    for at in range(0, len(hashes), 512):
        np.minimum(least, (hashes[None, at : at + 512] * times + plus).min(axis=1), out=least)
    return ((words.mix(least) >> U(9)) | (np.arange(coordinates, dtype=U) << U(55))).astype(np.int64)


def blocks(batch: pa.RecordBatch, place: int, most: int = 2 << 20):
    """Row ranges of a batch with about ``most`` bytes of text each."""
    sizes = pc.binary_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def classes(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """Per row: doc_id, text_hash, n_shingles, class (a hash of the set; null if empty) and signature."""

    def run(batches):
        for batch in batches:
            for a, b in blocks(batch, 2):
                part = batch.slice(a, b - a)
                sets = shingle_sets(part.column(2).to_pylist(), size)
                own = [int(words.mix(words.whole(s))[0].astype(np.int64)) if len(s) else None for s in sets]
                signs = [signature(s, coordinates) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.int64()), pa.array(signs, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "n_shingles", "class", "signature"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_hash"), whole_text().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, class long, signature array<long>")


def texts_of(classes_: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(class, text): one text of each class in ``classes_``. Equal texts are combined before they are dealt out."""
    needed = reps.select("class", "text_hash").join(classes_, "class", "left_semi")
    texts = docs.select(F.xxhash64(whole_text()).alias("text_hash"), whole_text().cast("binary").alias("text"))
    texts = texts.groupBy("text_hash").agg(F.first("text").alias("text"))
    return written(needed.join(texts, "text_hash").select("class", "text"), "near-texts")


def lonely(texts: DataFrame, size: int) -> DataFrame:
    """(class, n_lonely): how many of its shingles a class shares with no other class of ``texts``."""

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch, 1):
                part = batch.slice(lo, hi - lo)
                sets = shingle_sets(part.column(1).to_pylist(), size)
                own = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(np.concatenate(sets).astype(np.int64))], names=["class", "shingle"])

    each = texts.select("class", "text").mapInArrow(run, "class long, shingle long")
    once = each.groupBy("shingle").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")
    return once.groupBy("class").agg(F.count("*").alias("n_lonely"))


def items(texts: DataFrame, size: int) -> DataFrame:
    """(class, items): the shingles of each class, shortened to 32 bits."""

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch, 1):
                part = batch.slice(lo, hi - lo)
                sets = [(x >> U(32)).astype(np.uint32).view(np.int32) for x in shingle_sets(part.column(1).to_pylist(), size)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["class", "items"])

    return texts.select("class", "text").mapInArrow(run, "class long, items array<int>")


def pair_keys(signature: Column, coordinates: int) -> Column:
    """Hashes of two neighbouring coordinates' values each."""
    return F.array(*[F.xxhash64(F.get(signature, F.lit(i)), F.get(signature, F.lit(i + 1))) for i in range(0, coordinates - 1, 2)])


def crossed(rows: DataFrame, coordinates: int, need: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``rows`` (class, label, n_shingles, u, signature, items) in different components that are similar enough, each once."""
    kept = ["class", "label", "n_shingles", "u", "signature", "items"]
    posted = rows.withColumn("keys", pair_keys(F.col("signature"), coordinates))
    # members of a key's commonest component need not meet each other, so only the others are dealt out: each of
    # them meets a part of all members in each task
    sizes = posted.select("label", F.explode("keys").alias("key")).groupBy("key", "label").agg(F.count("*").alias("n"))
    met = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("labels"), F.max_by("label", F.struct("n", "label")).alias("major"))
    met = met.where("labels > 1").select("key", "major", F.ceil(F.col("n") / SALTED).cast("int").alias("salts"))
    posted = posted.withColumn("key", F.explode("keys")).join(met, "key")
    a = posted.select("key", "major", F.pmod(F.xxhash64("class", "key"), F.col("salts")).cast("int").alias("salt"), "keys", *[F.col(c).alias(f"{c}_a") for c in kept])
    b = posted.where("label <> major").select("key", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"{c}_b") for c in kept], F.col("keys").alias("keys_b"))
    once = (F.col("label_a") == F.col("major")) | (F.col("label_a") < F.col("label_b"))
    pairs = a.join(b, ["key", "salt"]).where((F.col("label_a") != F.col("label_b")) & once)
    n_a, n_b = F.col("n_shingles_a"), F.col("n_shingles_b")
    # shared shingles are what is left of both sizes; each class can't share more than u
    pairs = pairs.where((F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (F.least("u_a", "u_b") * (100 + percent) >= (n_a + n_b) * percent))
    # once a pair, under its first common key
    common = F.coalesce(*[F.when(F.get("keys", F.lit(i)) == F.get("keys_b", F.lit(i)), F.get("keys", F.lit(i))) for i in range(coordinates // 2)])
    collided = F.size(F.filter(F.zip_with("signature_a", "signature_b", lambda x, y: x == y), lambda x: x)) >= need
    # shortened items of one set collide now and then, which can hide a few shared ones; pairs are confirmed like any others
    slack = 1 + F.floor(n_a * n_b / (1 << 30))
    shared = F.size(F.array_intersect("items_a", "items_b"))
    pairs = pairs.where((common == F.col("key")) & collided).where((100 + percent) * (shared + slack) >= percent * (n_a + n_b))
    return pairs.select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b"))


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""

    def run(batches):
        for batch in batches:
            for lo, hi in blocks(batch, 3, 4 << 20):
                part = batch.slice(lo, hi - lo)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                one = list(dict.fromkeys(a))
                first = dict(zip(a, part.column(2).to_pylist(), strict=True))
                left = dict(zip(one, shingle_sets([first[k] for k in one], size), strict=True))
                right = shingle_sets(part.column(3).to_pylist(), size)
                same = []
                for k, other in zip(a, right, strict=True):
                    own = left[k]
                    both = len(np.intersect1d(own, other, assume_unique=True))
                    same.append(100 * both >= percent * (len(own) + len(other) - both))
                keep = np.flatnonzero(same)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a)[keep], pa.int64()), pa.array(np.array(b)[keep], pa.int64())], names=["a", "b"])

    with_b = pairs.join(texts.select(F.col("class").alias("b"), F.col("text").alias("text_b")), "b")
    joined = with_b.join(texts.select(F.col("class").alias("a"), F.col("text").alias("text_a")), "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def link(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = COORDINATES) -> DataFrame:
    """Per row of ``docs``: doc_id, text_hash, n_shingles, component_id and kept."""
    need = least_matches(percent / 100, coordinates)
    rows = written(classes(docs, size, coordinates), "near-rows")
    reps = written(
        rows.where("class is not null").groupBy("class").agg(F.min("text_hash").alias("text_hash"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature")), "near-classes"
    )
    posted = reps.select("class", F.explode("signature").alias("value"))
    common = posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    found = posted.join(common, "value").groupBy("class").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("shared"))  # at most ``coordinates`` each
    prefix = found.where(F.size("shared") >= need).select(
        "class", F.aggregate("shared", F.lit(0.0), lambda acc, x: acc + F.log(x["n"].cast("double"))).alias("weight"), F.explode(F.slice("shared", F.lit(1), F.size("shared") - need + 1)).alias("post")
    )
    prefix = prefix.select(F.col("post.value").alias("value"), F.ceil(F.col("post.n") / STAR).alias("salts"), "class", "weight").join(reps.select("class", "n_shingles", "signature"), "class")
    posts = written(prefix, "near-posts")

    a = ["class", "n_shingles", "signature"]
    centre = posts.groupBy("value", "salts").agg(F.max(F.struct("weight", *a)).alias("centre"), F.count("*").alias("n")).where("n > 1")
    # a value that many classes share meets its centre in as many tasks as it needs
    centre = centre.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
    star = posts.withColumn("salt", F.pmod(F.xxhash64("class"), F.col("salts"))).join(centre.select("value", "salt", "centre"), ["value", "salt"]).select(
        F.col("centre.class").alias("a"), F.col("centre.n_shingles").alias("n_a"), F.col("centre.signature").alias("sign_a"), F.col("class").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("sign_b")
    )
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    collided = F.size(F.filter(F.zip_with("sign_a", "sign_b", lambda x, y: x == y), lambda x: x)) >= need
    stars = star.where((F.col("a") != F.col("b")) & sized & collided).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = written(stars, "near-stars")
    # one reading of the documents for both confirmations: the classes that are posted anywhere with another
    met = posts.join(centre.where("salt = 0").select("value"), "value", "left_semi").select("class").distinct()
    texts = texts_of(met, docs, reps)
    links = written(confirmed(stars, texts, size, percent), "near-links")
    labels = components(links).withColumnRenamed("node", "class")

    labelled = written(posts.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class")), "near-labelled")
    mixed = labelled.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    open_ = written(labelled.join(mixed.select("value"), "value", "left_semi"), "near-open")
    texts = texts.join(open_.select("class").distinct(), "class", "left_semi")
    # two sets can't share more than what either shares with any other
    once = open_.select("class", "label", "n_shingles", "signature").dropDuplicates(["class"])
    once = once.join(lonely(texts, size), "class", "left").withColumn("u", F.col("n_shingles") - F.coalesce("n_lonely", F.lit(0))).where(F.col("u") * 100 >= F.col("n_shingles") * percent)
    once = written(once, "near-shared")
    # members of lists that several components share meet once more under pairs of coordinates, one of which a similar
    # pair shares but for one in a million; they carry their sets along, so that only similar pairs come out of the join
    carried = written(once.join(items(texts.join(once, "class", "left_semi"), size), "class"), "near-carried")
    across = crossed(carried, coordinates, need, percent)
    more = written(confirmed(written(across, "near-across"), texts, size, percent), "near-more")
    # the later links join components, so that only labels are left to be connected
    name = lambda side: labels.select(F.col("class").alias(side), F.col("label").alias(f"l_{side}"))
    between = more.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b"))
    merged = components(between).withColumnsRenamed({"node": "_label", "label": "_to"})

    grouped = rows.select("doc_id", "text_hash", "n_shingles", "class").join(labels, "class", "left").withColumn("_label", F.coalesce("label", "class"))
    grouped = grouped.join(merged, "_label", "left").withColumn("label", F.coalesce("_to", "_label"))
    least = grouped.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = grouped.join(least, "label", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.expr("doc_id <=> component_id").alias("kept"))


def drop_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component; of rows repeated in id and text, one. All columns stay, whatever their names."""
    id_text = lambda doc_id, text_hash: F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), text_hash)
    kept = link(docs, size, percent).where("kept").select(id_text(F.col("doc_id"), F.col("text_hash")).alias("key")).distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), id_text(F.col("doc_id"), F.xxhash64(whole_text())).alias("key"), F.xxhash64(*docs.columns).alias("row"))
    # by the same key as the join, so that rows move once
    first = keyed.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("row"))).where("n = 1")
    return first.join(kept, "key", "left_semi").select("doc.*")
