"""Fragments, base ancestry and identities of molecular states."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dna import reverse_complement


PER_TASK = 250_000  # contacts that a task sorts, about


def fragments(sources: DataFrame, cuts: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, strand, start, end, sequence): each strand between neighbouring cuts; the bottom reads backwards.

    ``cuts`` has (key, strand, boundary); cuts at the ends make no fragment.
    """
    strands = sources.select(key, F.col(seq), F.explode(F.array(F.lit("top"), F.lit("bottom"))).alias("strand"))
    ends = strands.select(key, "strand", F.explode(F.array(F.lit(0), F.length(seq))).alias("boundary"))
    inner = cuts.select(key, "strand", F.col("boundary").cast("int").alias("boundary"))
    order = Window.partitionBy(key, "strand").orderBy("boundary")
    spans = ends.unionByName(inner).distinct().withColumn("end", F.lead("boundary").over(order)).where("end is not null")
    read = F.substring(F.col(seq), F.col("boundary") + 1, F.col("end") - F.col("boundary"))
    text = F.when(F.col("strand") == "top", read).otherwise(reverse_complement(read))
    return spans.join(strands, [key, "strand"]).select(key, "strand", F.col("boundary").alias("start"), "end", text.alias("sequence"))


def bases(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """(keys, index, base), one row a base."""
    return df.where(F.length(seq) > 0).select(*keys, F.posexplode(F.split(seq, "")).alias("index", "base"))


def one_hop(products: DataFrame, origins: DataFrame) -> DataFrame:
    """Each product base's upstream origin; the strand flips where the copy lies on the other strand.

    products: (product_id, index, origin_id, origin_index, strand); origins: (origin_id, origin_index,
    up_id, up_index, up_strand).  Unknown origins pass through.
    """
    flip = F.when(F.col("strand") == "top", F.col("up_strand")).otherwise(F.when(F.col("up_strand") == "top", "bottom").otherwise("top"))
    joined = products.join(origins, ["origin_id", "origin_index"], "left")
    return joined.select(
        "product_id",
        "index",
        F.coalesce("up_id", "origin_id").alias("root_id"),
        F.coalesce("up_index", "origin_index").alias("root_index"),
        F.when(F.col("up_id").isNull(), F.col("strand")).otherwise(flip).alias("root_strand"),
    )


def span_runs(rows: DataFrame, keys: list[str], index: str, origin: str) -> DataFrame:
    """Uninterrupted runs in which index and origin advance together."""
    order = Window.partitionBy(*keys).orderBy(index)
    step = (F.col(index) - F.lag(index).over(order) == 1) & (F.col(origin) - F.lag(origin).over(order) == 1)
    marked = rows.withColumn("_new", F.when(step, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(order))
    return marked.groupBy(*keys, "_run").agg(F.min(index).alias("start"), F.count(F.lit(1)).alias("length"), F.min(origin).alias("origin")).drop("_run")


def edge_signature(edges: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """A digest of a group's undirected contacts, whatever their order and direction."""
    contact: Column = F.concat_ws("-", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))
    return edges.groupBy(*group).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(contact)), ";"), 256).alias("signature"))


def number_of(*parts: Column | str) -> Column:
    """48 bits of a digest, as a number: sums of such numbers tell multisets apart without lists."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, 12), 16, 10).cast("decimal(38,0)")


def ordered_digest(rows: DataFrame, key: str, order: str, text: str, digest: str, count: str) -> DataFrame:
    """(key, digest, count): SHA-256 of a key's texts in order, joined by commas; nulls are counted and left out, and nothing else gives null.

    Rows are sorted within their partition and go through the digest one after another, so a long log is never one list or string.
    """
    kind = rows.schema[key].dataType.simpleString()

    def digests(batches):
        now, state, n, held = None, None, 0, 0
        said_of = lambda: (now, state.hexdigest() if held else None, n)
        for batch in batches:
            out = []
            for k, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or k != now:
                    if state is not None:
                        out.append(said_of())
                    now, state, n, held = k, hashlib.sha256(), 0, 0
                n += 1
                if said is not None:
                    state.update((b"," if held else b"") + said.encode())
                    held += 1
            if out:
                yield told(out, batch.schema.field(0).type)
            last = batch.schema.field(0).type
        if state is not None:
            yield told([said_of()], last)

    def told(out, own):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], own), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], [key, digest, count])

    return rows.repartition(key).sortWithinPartitions(key, order).select(key, text).mapInArrow(digests, f"`{key}` {kind}, `{digest}` string, `{count}` long")


def two_sided_signature(contacts: DataFrame, graph: str, a_label: str, b_label: str, rounds: int = 3) -> DataFrame:
    """The rows of ``refined_signature`` for graphs whose every contact (graph, a, b, kind) leads from one label to another.

    ``a`` and ``b`` share no vertex, so a contact carries the colours of both its ends, and what is around an end is a sum over the
    contacts that hold it.  Contacts are dealt by graph once; all else is sorting within the partitions.
    """
    rows = contacts.select(graph, "a", "b", "kind")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // PER_TASK))
    rows = rows.repartition(tasks, graph).distinct()
    rows = rows.withColumns({"_a": number_of(F.lit(a_label)), "_b": number_of(F.lit(b_label))})
    ends = ["a", "b"]
    for _ in range(rounds):
        # Both messages are of the colours before the round; a round begins with the end that the last one sorted by.
        rows = rows.withColumns({"_to_a": number_of("kind", "_b"), "_to_b": number_of("kind", "_a")})
        for end in ends:
            around = F.sum(f"_to_{end}").over(Window.partitionBy(graph, end))
            rows = rows.withColumn(f"_sum_{end}", around)
        rows = rows.select(graph, "a", "b", "kind", *[number_of(f"_{end}", f"_sum_{end}").alias(f"_{end}") for end in "ab"])
        ends = ends[::-1]
    for end in ends:
        first = F.row_number().over(Window.partitionBy(graph, end).orderBy(end)) == 1
        rows = rows.withColumn(f"_first_{end}", first)
    own = lambda end: F.when(F.col(f"_first_{end}"), number_of(f"_{end}"))
    none = F.lit(0).cast("decimal(38,0)")
    sums = rows.groupBy(graph).agg(
        (F.count_if("_first_a") + F.count_if("_first_b")).alias("vertices"),
        (F.coalesce(F.sum(own("a")), none) + F.coalesce(F.sum(own("b")), none)).cast("decimal(38,0)").alias("_colours"),
        F.count(F.lit(1)).alias("contacts"),
        F.sum(number_of(F.least("_a", "_b"), F.greatest("_a", "_b"), "kind")).alias("_edges"),
    )
    said = F.concat_ws("|", *[F.col(c).cast("string") for c in ("vertices", "_colours", "contacts", "_edges")])
    return sums.select(graph, "vertices", "contacts", F.sha2(said, 256).alias("signature"))


def refined_signature(edges: DataFrame, labels: DataFrame, graph: str, rounds: int = 3) -> DataFrame:
    """(graph, vertices, contacts, signature): equal for graphs that differ in the names of their vertices alone.

    ``edges`` (graph, a, b, kind) are undirected typed contacts, ``labels`` (graph, v, label) what a vertex is.  A
    vertex's colour starts as its label; in each round it takes in the kinds and colours around it, a join and a grouping.  Colours
    around a vertex, and those of a graph, are summed and never listed, so a hub or a large graph needs no list in one task.
    Graphs that this many rounds cannot tell apart share a signature.
    """
    contacts = edges.select(graph, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").distinct()
    both = contacts.select(graph, F.col("a").alias("v"), F.col("b").alias("w"), "kind").unionByName(contacts.select(graph, F.col("b").alias("v"), F.col("a").alias("w"), "kind"))
    colours = labels.select(graph, "v", "label").distinct().select(graph, "v", number_of("label").alias("colour"))
    for _ in range(rounds):
        around = both.join(colours.select(graph, F.col("v").alias("w"), F.col("colour").alias("_w")), [graph, "w"])
        sums = around.groupBy(graph, "v").agg(F.sum(number_of("kind", "_w")).alias("_sum"))
        colours = colours.join(sums, [graph, "v"], "left").select(graph, "v", number_of("colour", F.coalesce("_sum", F.lit(0).cast("decimal(38,0)"))).alias("colour"))
    side = lambda name: colours.select(graph, F.col("v").alias(name), F.col("colour").alias(f"_{name}"))
    ends = contacts.join(side("a"), [graph, "a"]).join(side("b"), [graph, "b"])
    edge_sums = ends.groupBy(graph).agg(F.count(F.lit(1)).alias("contacts"), F.sum(number_of(F.least("_a", "_b"), F.greatest("_a", "_b"), "kind")).alias("_edges"))
    sums = colours.groupBy(graph).agg(F.count(F.lit(1)).alias("vertices"), F.sum(number_of("colour")).alias("_colours"))
    joined = sums.join(edge_sums, graph, "left").fillna({"contacts": 0})
    said = F.concat_ws("|", *[F.col(c).cast("string") for c in ("vertices", "_colours", "contacts")], F.coalesce("_edges", F.lit(0).cast("decimal(38,0)")).cast("string"))
    return joined.select(graph, "vertices", "contacts", F.sha2(said, 256).alias("signature"))


def ancestry_runs(rows: DataFrame, keys: list[str], index: str, origin: str) -> DataFrame:
    """Adds ``run``, numbered from 1 within ``keys``: neighbouring places whose origins go on by one, forward or backward.

    A place begins a run if its origin is not beside the one before, or if the direction turns there.
    """
    order = Window.partitionBy(*keys).orderBy(index)
    step = F.when(F.col(index) - F.lag(index).over(order) == 1, F.col(origin) - F.lag(origin).over(order))
    stepped = rows.withColumn("_step", F.when(F.abs(step) == 1, step))
    turn = F.lag("_step").over(order)
    new = F.col("_step").isNull() | (turn.isNotNull() & (turn != F.col("_step")))
    return stepped.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(order)).drop("_step", "_new")


def islands(rows: DataFrame, keys: list[str], index: str, origin: str) -> DataFrame:
    """(keys, start, length, first_origin, direction) of each run; a run of one place has direction 0."""
    runs = ancestry_runs(rows, keys, index, origin)
    ends = runs.groupBy(*keys, "run").agg(F.min(index).alias("start"), F.count(F.lit(1)).alias("length"), F.min_by(origin, index).alias("first_origin"), F.max_by(origin, index).alias("_last"))
    return ends.select(*keys, "start", "length", "first_origin", F.signum(F.col("_last") - F.col("first_origin")).cast("int").alias("direction"))


def span_locations(anchors: DataFrame, target: DataFrame, keys: list[str], index: str, origin: str) -> DataFrame:
    """(keys, first, last, start, stop, direction): where a whole span of origins (first to last) stands in the target without a gap.

    Both ends of a span are looked up by origin, and stand in one run as far apart as the span is long.
    """
    runs = ancestry_runs(target, keys, index, origin).select(*keys, index, origin, "run")
    end = lambda name: runs.select(*keys, F.col(origin).alias(name), F.col("run").alias(f"{name}_run"), F.col(index).alias(f"{name}_at"))
    both = anchors.select(*keys, "first", "last").distinct().join(end("first"), [*keys, "first"]).join(end("last"), [*keys, "last"])
    whole = (F.col("first_run") == F.col("last_run")) & (F.abs(F.col("last_at") - F.col("first_at")) == F.col("last") - F.col("first"))
    return both.where(whole).select(
        *keys, "first", "last", F.least("first_at", "last_at").alias("start"), (F.greatest("first_at", "last_at") + 1).alias("stop"),
        F.signum(F.col("last_at") - F.col("first_at")).cast("int").alias("direction"),
    )


def correspondence(before: DataFrame, after: DataFrame, keys: list[str], index: str, origin: str) -> DataFrame:
    """(keys, origin, reference, target, relation) of every origin of either state: ``retained`` where it stands once in both,
    ``repeated`` where it stands more often in one, else ``unmapped_reference`` or ``unmapped_target``."""
    side = lambda df, name: df.groupBy(*keys, origin).agg(F.min(index).alias(name), F.count(F.lit(1)).alias(f"n_{name}"))
    both = side(before, "reference").join(side(after, "target"), [*keys, origin], "full").fillna(0, ["n_reference", "n_target"])
    relation = (
        F.when(F.col("n_target") == 0, "unmapped_reference").when(F.col("n_reference") == 0, "unmapped_target")
        .when((F.col("n_reference") == 1) & (F.col("n_target") == 1), "retained").otherwise("repeated")
    )
    kept = lambda c: F.when(F.col("relation") == "retained", F.col(c))
    return both.withColumn("relation", relation).select(*keys, origin, kept("reference").alias("reference"), kept("target").alias("target"), "relation")
