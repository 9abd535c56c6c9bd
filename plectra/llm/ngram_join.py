"""N-gram Jaccard join by MinHash banding.

Texts with equal shingle sets form one class.  Band and row counts are chosen for the target recall at
the threshold.  Two classes that share a band hash are candidates, and linked if their full sets reach the threshold; how many
other classes are near does not matter.  Candidates are joined to components.  One of at most ``block`` classes is verified as a
whole, a larger one by its band buckets where these hold fewer pairs than the whole (chance hits join components), each pair in the
first band it shares; either goes in blocks, so no pair is lost to a bucket's size and no pair becomes a row.  Each block
returns a class's links and the least class it is linked to, which joins linked classes to near-duplicate groups.

Defined results: a null or empty text and one without words has no shingles and no links, not even to its
like; a text of fewer than five words has one shingle; equal rows are two documents; ids may be null
or repeat, as a row is named by its id and its text's hash; a null id is below every other; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytetext import SHINGLE, U64, mix, shingle_sets, stream
from .components import connected_components
from .shared import order_id, real_id, table, text_hash, write_table

THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 256
BLOCK = 256


def band_plan(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which enough bands fit to find a pair at the threshold."""
    plans = [(math.ceil(math.log(1 - recall) / math.log(1 - threshold**r)), r) for r in range(1, 33)]
    return max((p for p in plans if p[0] * p[1] <= most), key=lambda p: p[1])


def minhash(values: np.ndarray, multipliers: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The least of each hash over the values."""
    least = np.full(len(multipliers), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(values), 2048):
        part = (values[at : at + 2048] >> U64(32)).astype(np.uint32)[:, None] * multipliers + offsets
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def signatures(docs: DataFrame, bands: int, rows: int, n: int = SHINGLE) -> DataFrame:
    """(id, th, c1, c2, n_shingles, keys): the class hash of a shingle set, and its band hashes (none for no shingles)."""
    multipliers = (stream(bands * rows, 11) >> U64(32)).astype(np.uint32) | np.uint32(1)
    offsets = (stream(bands * rows, 12) >> U64(32)).astype(np.uint32)
    places = stream(rows, 13) | U64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second, sizes, keys = [], [], [], []
            for values in shingle_sets(batch.column(2), n):
                first.append(int(values.sum(dtype=U64).view(np.int64)))
                second.append(int(mix(values).sum(dtype=U64).view(np.int64)))
                sizes.append(len(values))
                if len(values):
                    least = minhash(values, multipliers, offsets).reshape(bands, rows).astype(U64)
                    keys.append(mix((least * places).sum(axis=1, dtype=U64)).view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=["id", "th", "c1", "c2", "n_shingles", "keys"],
            )

    narrow = docs.select(order_id().cast("long").alias("id"), text_hash(F.col("text")).alias("th"), F.col("text").cast("string"))
    return narrow.mapInArrow(run, "id long, th long, c1 long, c2 long, n_shingles long, keys array<long>")


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Exact sizes of all intersections, by products of membership columns; a value held once is in none."""
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    keep = held[column] > 1
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    rank = np.cumsum(np.r_[0, np.diff(column) != 0]) if len(column) else column
    shared = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(rank[-1]) + 1 if len(rank) else 0, width):
        a, b = np.searchsorted(rank, [low, low + width])
        member = np.zeros((len(left) + len(right), width), np.float32)
        member[owner[a:b], rank[a:b] - low] = 1
        shared += member[: len(left)] @ member[len(left) :].T
    return shared


def verify_group(
    reps: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float, keys: np.ndarray, band: int
):
    """(links, root) of each class, of the pairs between ``left`` and ``right`` places (or within one of them).

    ``keys`` are the classes' band hashes.  In a bucket, a pair that agrees in a band before ``band`` is counted there; in
    a whole component (band -1) a pair that agrees in no band is no candidate.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    a, b = [sets[i] for i in left], [sets[i] for i in right]
    shared = intersections(a, b).astype(np.float64)
    # shared / (a + b - shared) >= threshold; a hair is given for rounding
    hit = shared * (1 + threshold) >= threshold * (sizes[left][:, None] + sizes[right][None, :]) - 1e-9
    one, other = np.nonzero(hit)
    agrees = keys[left][one] == keys[right][other]
    hit[one, other] = agrees.any(axis=1) if band < 0 else ~agrees[:, :band].any(axis=1)
    same = left is right
    if same:
        np.fill_diagonal(hit, False)
    links = np.zeros(len(reps), np.int64)
    links[left] += hit @ copies[right]
    if not same:
        links[right] += hit.T @ copies[left]
    root = reps.copy()
    while True:
        before = root.copy()
        big = np.iinfo(np.int64).max
        up = np.where(hit, root[right][None, :], big).min(axis=1, initial=big)
        root[left] = np.minimum(root[left], up)
        down = np.where(hit, root[left][:, None], big).min(axis=0, initial=big)
        root[right] = np.minimum(root[right], down)
        if np.array_equal(before, root):
            return links, root


def verify_bin(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of one block pair of a large unit, or of several small units: (rep, links, root)."""
    rows = rows.sort_values(["unit", "band", "rep"], kind="stable")
    units, bands, reps, copies, keys = (rows[c].to_numpy() for c in ("unit", "band", "rep", "copies", "keys"))
    blk, bi, bj = (rows[c].to_numpy() for c in ("blk", "bi", "bj"))
    packed = rows["shingles"].to_numpy()
    edges = np.r_[np.flatnonzero(np.r_[True, (units[1:] != units[:-1]) | (bands[1:] != bands[:-1])]), len(units)]
    out = []
    for a, b in zip(edges[:-1], edges[1:]):
        sets = [np.frombuffer(x, dtype=U64) for x in packed[a:b]]
        everyone = np.arange(b - a)
        left, right = everyone, everyone
        if bi[a] != bj[a]:
            left, right = np.flatnonzero(blk[a:b] == bi[a]), np.flatnonzero(blk[a:b] == bj[a])
        links, root = verify_group(reps[a:b], copies[a:b], sets, left, right, threshold, np.stack(keys[a:b]), int(bands[a]))
        out.append((reps[a:b][links > 0], links[links > 0], root[links > 0]))
    return pd.DataFrame({name: np.concatenate([x[i] for x in out]) for i, name in enumerate(("rep", "links", "root"))})


def verification_units(banded: DataFrame, buckets: DataFrame, groups: DataFrame, keys: DataFrame, block: int) -> DataFrame:
    """(id, unit, n, band, keys): the sets of classes whose pairs are verified, and their sizes.

    A unit is a component (band -1), or one of the band buckets of a component of more than ``block`` classes whose
    buckets hold fewer pairs.  Of buckets with the same members only that of the first band is a unit.
    """
    sizes = write_table(groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "sizes")
    whole = groups.join(sizes, "root").join(keys, "id").select("root", "id", F.col("root").alias("unit"), "n", F.lit(-1).alias("band"), "keys")
    large = sizes.where(F.col("n") > block).withColumnRenamed("n", "n_all")
    if large.isEmpty():
        return whole.drop("root")
    inside = buckets.join(groups.withColumnRenamed("id", "low"), "low").join(large, "root")
    unlike = write_table(inside.groupBy("root", "n_all", "n", "f1", "f2").agg(F.min(F.struct("band", "key")).alias("first")), "unlike")
    pairs = F.sum(F.pow("n", F.lit(2))).alias("pairs")
    parted = write_table(unlike.groupBy("root", "n_all").agg(pairs).where("pairs < pow(n_all, 2)").select("root"), "parted")
    first = unlike.join(parted, "root", "left_semi").select("n", "first.band", "first.key")
    parts = (
        banded.join(first, ["band", "key"])
        .join(keys, "id")
        .select("id", F.xxhash64("band", "key").alias("unit"), "n", F.col("band").cast("int").alias("band"), "keys")
    )
    return whole.join(parted, "root", "left_anti").drop("root").unionByName(parts)


def linked_rows(
    docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, n: int = SHINGLE, block: int = BLOCK
) -> DataFrame:
    """``jaccard_classes`` with each row's ``th`` and its group ``grp``, null for a text without shingles.

    A class is named by a hash of its shingle set, not by its representative's id, which other rows may share.
    """
    spark = docs.sparkSession
    bands, rows = band_plan(threshold, recall)
    signed = write_table(signatures(docs, bands, rows, n), "signatures")
    classes = write_table(
        signed.where("n_shingles > 0")
        .groupBy("c1", "c2")
        .agg(F.min("id").alias("least"), F.min_by("th", "id").alias("th"), F.count(F.lit(1)).alias("copies"), F.first("keys").alias("keys"))
        .withColumn("rep", F.xxhash64("c1", "c2")),
        "classes",
    )
    banded = classes.select(F.col("rep").alias("id"), F.posexplode("keys").alias("band", "key"))
    buckets = write_table(
        banded.groupBy("band", "key")
        .agg(
            F.min("id").alias("low"),
            F.max("id").alias("high"),
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("id")).alias("f1"),
            F.bit_xor(F.xxhash64(F.lit(7919), "id")).alias("f2"),
        )
        .where("low < high"),
        "buckets",
    )
    star = banded.join(buckets.select("band", "key", "low"), ["band", "key"]).where("id <> low")
    groups = write_table(connected_components(star.select(F.col("id").alias("u"), F.col("low").alias("v")).distinct()), "groups")
    keys = classes.select(F.col("rep").alias("id"), "keys")
    units = verification_units(banded, buckets, groups, keys, block).withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))

    # Sets are made again from the texts of candidates only; each goes to the block pairs of its units.
    wanted = groups.select("id").join(classes.withColumnRenamed("rep", "id"), "id")
    texts = docs.select(order_id().cast("long").alias("least"), text_hash(F.col("text")).alias("th"), F.col("text").cast("string").alias("text"))
    found = texts.join(wanted, ["least", "th"]).select("id", "text", "copies", "c1", "c2")

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            sets = list(shingle_sets(text, n))
            c1 = np.array([int(s.sum(dtype=U64).view(np.int64)) for s in sets], np.int64)
            same = c1 == batch.column("c1").to_numpy()  # two texts may share a hash
            packed = pa.array([s.tobytes() for s in sets], pa.binary())
            kept = batch.select(["id", "copies"]).add_column(2, "shingles", packed)
            yield kept.filter(pa.array(same))

    sets = found.mapInArrow(with_sets, "id long, copies long, shingles binary").dropDuplicates(["id"]).join(units, "id")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = sets.withColumnRenamed("id", "rep").withColumn("blk", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", others).withColumn("bi", F.least("blk", "other")).withColumn("bj", F.greatest("blk", "other"))
    # Small units share tasks' groups; a large unit has one for each pair of its blocks.
    few = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")) * 8)
    bin_of = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("unit"), F.lit(few))).otherwise(F.xxhash64("unit", "band", "bi", "bj"))
    verified = write_table(
        spread.select("rep", "unit", "band", "keys", "copies", "shingles", "blk", "bi", "bj", bin_of.alias("bin"))
        .groupBy("bin", "bi", "bj")
        .applyInPandas(lambda rows: verify_bin(rows, threshold), "rep long, links long, root long"),
        "links",
    )
    links = verified.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = write_table(
        connected_components(verified.where("rep <> root"), "rep", "root")
        .withColumnRenamed("id", "rep")
        .join(classes.select("rep", "least"), "rep"),
        "roots",
    )
    first = roots.groupBy("root").agg(F.min("least").alias("class_id"))
    summary = (
        classes.join(links, "rep", "left")
        .join(roots.join(first, "root").select("rep", "root", "class_id"), "rep", "left")
        .select(
            "c1",
            "c2",
            F.col("least").alias("text_class"),
            F.coalesce("root", "rep").alias("grp"),
            F.coalesce("class_id", "least").alias("class_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    return signed.select("id", "th", "c1", "c2", "n_shingles").join(summary, ["c1", "c2"], "left").select(
        "id",
        "th",
        "grp",
        F.coalesce("text_class", "id").alias("text_class"),
        F.coalesce("class_id", "id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
    )


def jaccard_classes(docs: DataFrame, **options) -> DataFrame:
    """(id, text_class, class_id, n_links, n_shingles), one row a document.

    ``text_class`` is the least id with the same shingle set, ``class_id`` the least id of the group that
    links join, ``n_links`` the number of other documents at ``threshold`` or above.
    """
    return linked_rows(docs, **options).drop("th", "grp")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one of the least id, once."""
    least = linked_rows(docs, **options).where("id = class_id").withColumn("own", F.when(F.col("grp").isNull(), F.struct("id", "th")))
    # A group's least id may be that of several rows; a text without shingles is a group of its own.
    heads = least.groupBy("grp", "own").agg(F.min("id").alias("id"), F.min("th").alias("th")).select("id", "th")
    rows = docs.select(F.struct("*").alias("doc"), order_id().cast("long").alias("id"), text_hash(F.col("text")).alias("th"))
    return rows.join(heads, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]).select("doc.*")


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select(
        real_id("id").alias("doc_id"), "class_id", "text_class", "n_links", "n_shingles"
    )
