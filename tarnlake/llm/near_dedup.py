"""Near duplicates: weighted minwise signatures from hashed darts, banded joins, exact verification, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import attach, documents, row_count, slices, stored
from tarnlake.llm.vec import Bits, mix, range_hashes, rolling, text_bytes, word_hashes, words

COORDINATES, ROWS = 125, 5  # 25 bands of 5: a pair of similarity 0.8 shares one with probability 0.99995
BASE = -4  # darts of ranks below 2^BASE are thrown for every element; each further strip of ranks doubles


def weighted_shingles(column: pa.Array, size: int = 5):
    """The weighted set of each text in a batch: text number, 64-bit shingle hash and weight (its count), sorted; and
    of each text the number of words and two hashes of all words. Texts under `size` words have one shingle."""
    data, offsets = text_bytes(column)
    first, last, doc = words(data, offsets)
    h1, h2 = (word_hashes(data, first, last, s) for s in (1, 2))
    bounds = np.searchsorted(doc, np.arange(len(column) + 1))
    count = np.diff(bounds)
    whole1, whole2 = (range_hashes(h, bounds[:-1], bounds[1:], s) for h, s in ((h1, 11), (h2, 12)))
    grams = rolling(h1, size, 4)
    inside = doc[: len(grams)] == doc[size - 1 :][: len(grams)] if len(grams) else np.empty(0, bool)
    short = np.flatnonzero((count > 0) & (count < size))
    owner = np.concatenate([doc[: len(grams)][inside], short])
    value = np.concatenate([grams[inside], whole1[short]])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return owner[at], value[at], np.diff(np.append(at, len(owner))).astype(float), count, whole1, whole2


def _poisson_table(mean: float) -> np.ndarray:
    """P(count <= i) for i = 0, 1, ... until it is 1."""
    n = np.arange(int(mean + 12 * mean**0.5 + 30))
    logs = n * np.log(mean) - mean - np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, len(n))))])
    return np.cumsum(np.exp(logs))


def dart_signatures(owner: np.ndarray, value: np.ndarray, weight: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash: n rows of k values; two rows agree at a place with the probability of their weighted Jaccard
    similarity. All of a row without elements is 2^64 - 1.

    Each element's weight is a region of cells of weight 1. Into the cells, darts are thrown with rates that only the
    element, the cell and a strip of ranks decide, a Poisson number of them, each with a rank, a coordinate and a place
    in the cell by hash. A set owns the darts that fall below its weights. About k (ln k + 2) of them, those of the
    lowest ranks, are enough to hit every coordinate; strips are added for the sets where some are still open. Of each
    coordinate the dart with the lowest rank is kept: 40 bits of rank and 24 bits of the dart's name.
    """
    total = np.bincount(owner, weight, n)
    cells = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(owner)), cells)
    within = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells)
    cell_owner, room = owner[at], weight[at] - within
    cell = mix(value[at] + within.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(divide="ignore"):
        top = np.where(total > 0, np.ceil(np.log2(k * (np.log(k) + 2) / np.maximum(total, 1e-300))), -np.inf)
    top = np.maximum(top, BASE)
    strip = BASE - 1  # the base strip; then [2^BASE, 2^(BASE+1)), ...
    open_ = total > 0
    while open_.any() and strip < 60:
        low, width = (0.0, 2.0**BASE) if strip < BASE else (2.0**strip, 2.0**strip)
        on = np.flatnonzero(open_[cell_owner])
        key = mix(cell[on] ^ mix(np.full(1, strip + 1000, np.uint64)))
        table = _poisson_table(width)
        number = np.searchsorted(table, (key >> np.uint64(11)) * 2.0**-53, side="right")
        dart = np.repeat(np.arange(len(on)), number)
        nth = np.arange(len(dart)) - np.repeat(np.cumsum(number) - number, number)
        name = mix(key[dart] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        place = (mix(name ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)) * 2.0**-53
        rank = low + width * (mix(name ^ np.uint64(0x14057B7EF767814F)) >> np.uint64(11)) * 2.0**-53
        own = place < room[on][dart]
        slot = cell_owner[on][dart][own] * k + (name[own] % np.uint64(k)).astype(np.int64)
        # floats above zero sort as their bits do
        packed = (rank[own].view(np.uint64) << np.uint64(1) >> np.uint64(24) << np.uint64(24)) | (name[own] >> np.uint64(40))
        np.minimum.at(best, slot, packed)
        strip += 1
        done = (best.reshape(n, k) != np.iinfo(np.uint64).max).all(1)
        open_ &= ~(done & (strip >= top))
    return best.reshape(n, k)


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash for each `rows` values of a signature."""
    n, k = signatures.shape
    parts = signatures[:, : k // rows * rows].reshape(n, k // rows, rows)
    out = np.tile(np.arange(k // rows, dtype=np.uint64), (n, 1))
    for j in range(rows):
        out = mix(out ^ parts[:, :, j])
    return out


def expanded(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes, one per element and unit of weight: their plain Jaccard is the weighted one."""
    times = weight.astype(np.int64)
    at = np.repeat(np.arange(len(value)), times)
    within = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    return np.unique(mix(value[at] ^ mix(within.astype(np.uint64))))


def _signed(d: DataFrame) -> DataFrame:
    """doc_id, node (a 128-bit hash of all words), size (sum of weights) and bands of each text."""

    def run(batches):
        for batch in slices(batches, 1, 1 << 20):
            owner, value, weight, count, whole1, whole2 = weighted_shingles(batch.column(1))
            n = batch.num_rows
            keys = bands(dart_signatures(owner, value, weight, n)).view(np.int64)
            size = np.bincount(owner, weight, n).astype(np.int64)
            node = np.stack([whole1.byteswap(), whole2.byteswap()], 1).tobytes()  # big-endian, as hex() shows them
            nodes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(node)]).cast(pa.binary())
            ends = pa.array(np.concatenate([[0], np.cumsum((size > 0) * keys.shape[1])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), nodes, pa.array(size), pa.ListArray.from_arrays(ends, pa.array(keys[size > 0].ravel()))], ["doc_id", "node", "size", "bands"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, node binary, size bigint, bands array<bigint>")


def _elements(d: DataFrame, wanted: Bits) -> DataFrame:
    """node and elements (sorted 64-bit hashes as bytes) of the texts whose node may be wanted, once per node and task."""
    shared = d.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in slices(batches, 0, 1 << 20):
            owner, value, weight, count, whole1, whole2 = weighted_shingles(batch.column(0))
            on = np.flatnonzero(shared.value.has(whole1) & (count > 0))
            cuts = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            found = {}
            for i in on.tolist():
                key = whole1[i].byteswap().tobytes() + whole2[i].byteswap().tobytes()
                if key not in found:
                    part = slice(cuts[i], cuts[i + 1])
                    found[key] = expanded(value[part], weight[part]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([*found], pa.binary()), pa.array([*found.values()], pa.binary())], ["node", "elements"])

    return d.select("text").mapInArrow(run, "node binary, elements binary")


def verified(pairs: DataFrame, elements: DataFrame, threshold: float, per_task: int = 500) -> DataFrame:
    """The pairs (a, b) whose elements' Jaccard similarity reaches the threshold. A node in many pairs is copied for
    every per_task of them, so that no task gets all pairs of one node."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    salted = attach(pairs, counts, ["a"], "n", row_count(pairs)).withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / per_task)))
    left = elements.join(counts, F.col("node") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / per_task) - 1)).alias("salt"), F.col("elements").alias("ea"))
    right = salted.join(elements.select(F.col("node").alias("_b"), F.col("elements").alias("eb")), F.col("b") == F.col("_b")).select("a", "b", "salt", "eb")
    both = right.join(left, ["a", "salt"]).select("a", "b", "ea", "eb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= threshold * (len(x) + len(y) - common) - 1e-9)
            on = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(on), batch.column(1).take(on)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def block_links(elements: list[np.ndarray], labels: list, side: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Links that join what is alike in a block: pairs (i, j) of Jaccard similarity >= threshold, as many as merge sets.

    With two sides (0 and 1), only pairs across them count. Common elements of all pairs are counted by a matrix
    product over the elements that occur more than once, a slice of them at a time. Nodes of a label are one set.
    """
    n = len(elements)
    if n < 2:
        return []
    sizes = np.array([len(e) for e in elements])
    owner = np.repeat(np.arange(n), sizes)
    _, place, seen = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    often = seen[place] > 1
    renumber = np.cumsum(seen > 1) - 1
    owner, place = owner[often], renumber[place[often]]
    common = np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
        part = slice(*np.searchsorted(place, [low, low + 4096]))
        m = np.zeros((n, 4096), np.float32)
        m[owner[part], place[part] - low] = 1
        common += m @ m.T
    alike = common >= threshold * (sizes[:, None] + sizes[None, :] - common) - 1e-4
    i, j = np.nonzero(np.triu(alike, 1) & ((side[:, None] != side[None, :]) if side.any() else True))
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        # counts below 2^24 are exact in float32; the comparison itself is repeated in double
        c = float(common[x, y])
        a, b = find(labels[x]), find(labels[y])
        if a != b and c >= threshold * (sizes[x] + sizes[y] - c) - 1e-9:
            root[a] = b
            out.append((x, y))
    return out


def _labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """df with each node's label, which is the node itself where it has none."""
    own = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    return df.join(own, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_label", node)).drop("_node", "_label")


def components(links: DataFrame, name: str) -> DataFrame:
    """node and label (its component's smallest node) for each node in links (a, b).

    Every node takes the smallest label among its own and its neighbours', and then that label's label, so that paths
    get shorter by half in a round, until no label moves. Labels are minimised before the shuffle, never gathered, and
    stored in each round. A node with very many neighbours, and a label that very many nodes have, meet them by
    `attach`, so that no task gets them all.
    """
    one = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = stored(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), f"{name}-edges")
    total = row_count(edges)
    first = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label"), F.count("*").alias("n"), F.lit(True).alias("moved"))
    labels = stored(first.withColumnRenamed("u", "node"), f"{name}-0")
    nodes, number = row_count(labels), 0
    while labels.filter("moved").head(1):
        number += 1
        own = labels.select("node", "label", "n")
        near = attach(edges, own.withColumnRenamed("node", "v"), ["v"], "n", total).groupBy("u").agg(F.min("label").alias("low"))
        new = own.join(near, F.col("node") == F.col("u")).select("node", "label", "n", F.least("label", "low").alias("low"))
        new = stored(new, f"{name}-{number}-low")
        held = new.groupBy("low").agg(F.count("*").alias("holders"))
        onward = held.join(own.select(F.col("node").alias("_n"), F.col("label").alias("to")), F.col("low") == F.col("_n")).drop("_n")
        new = attach(new, onward, ["low"], "holders", nodes).withColumn("low", F.least("low", F.coalesce("to", "low")))
        labels = stored(new.select("node", F.col("low").alias("label"), "n", (F.col("low") != F.col("label")).alias("moved")), f"{name}-{number}")
    return labels.select("node", "label")


def _blocks(some: Column, nodes: int, elements: int) -> Column:
    """Into how many blocks a bucket's nodes are dealt: aggregate over the rows for which `some` holds."""
    return F.greatest(F.ceil(F.count_if(some) / nodes), F.ceil(F.coalesce(F.sum(F.when(some, F.col("size"))), F.lit(0)) / elements))


def links_of(members: DataFrame, elements: DataFrame, threshold: float, block: int = 128, block_elements: int = 1 << 18) -> DataFrame | None:
    """Labels (node, label) of the components of all nodes that are alike in a bucket, from members (bucket, node, size);
    None if no two nodes share one.

    1. Every node of a bucket is compared with its lead, the smallest by (size, node).
    2. What the lead has left open: buckets whose other nodes are in more than one component. Their nodes are dealt
       into blocks of about `block` nodes, or fewer if they have more than block_elements elements (a single text may
       have more), those of the lead's component into others than the rest, and each block of the rest is compared with every block, by one matrix product in a task of its own that gives at most a link per node.
       Blocks of the lead's component aren't compared with each other, so a bucket of n copies takes n comparisons.
       Buckets with equal nodes, as bands often have, are done once.
    """
    groups = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("size", "node")).alias("lead")).filter("n > 1")
    led = stored(attach(members, groups, ["bucket"], "n", row_count(members)).filter(F.col("lead").isNotNull() & (F.col("node") != F.col("lead.node"))), "near-led")
    like = F.least("size", "lead.size") >= F.greatest("size", "lead.size") * threshold - 1e-9
    pairs = stored(led.filter(like).select(F.col("lead.node").alias("a"), F.col("node").alias("b")).distinct(), "near-pairs")
    if not led.head(1):
        return None
    labels = components(verified(pairs, elements, threshold), "near-components")
    named = _labelled(led.withColumn("top", F.col("lead.node")), labels, "node", "label")
    facts = named.groupBy("bucket").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"), F.first("top").alias("top"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("size", "node")).alias("y"))
    mixed = facts.filter("low != high").groupBy("n", "x", "y").agg(F.min(F.struct("bucket", "top")).alias("s")).select("s.bucket", "s.top", "n")
    mixed = _labelled(mixed, labels, "top", "top_label")
    open_ = attach(named.select("bucket", "node", "size", "label"), mixed.select("bucket", "top_label", "n"), ["bucket"], "n", row_count(led)).filter("top_label is not null")
    open_ = stored(open_.withColumn("rest", F.col("label") != F.col("top_label")), "near-open")
    if not open_.head(1):
        return labels
    parts = open_.groupBy("bucket").agg(F.count("*").alias("n2"), _blocks(F.col("rest"), block, block_elements).alias("r"), _blocks(~F.col("rest"), block, block_elements).alias("c"), (_blocks(F.lit(True), block, block_elements) > 1).alias("many"))
    dealt = attach(open_.drop("n"), parts, ["bucket"], "n2", row_count(open_))
    hashed, zero = F.xxhash64("node"), F.lit(0).cast("bigint")
    mine = F.when(~F.col("many"), zero).when(F.col("rest"), F.pmod(hashed, "r")).otherwise(F.col("r") + F.pmod(hashed, F.greatest("c", F.lit(1))))
    dealt = dealt.withColumn("mine", mine)
    # pairs of blocks (i, j), i <= j, of which i is one of the rest
    to = lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j"))
    count = F.when(~F.col("many"), F.lit(1)).when(F.col("rest"), F.col("r") + F.col("c")).otherwise(F.col("r")).cast("bigint")
    tasks = dealt.select("bucket", "node", "label", "mine", F.explode(F.transform(F.sequence(zero, count - 1), to)).alias("t"))
    rows = tasks.select("bucket", "t.i", "t.j", "node", "label", F.when(F.col("t.i") != F.col("t.j"), F.col("mine") != F.col("t.i")).otherwise(F.lit(False)).alias("side"))
    rows = rows.join(elements.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n")).drop("_n")

    def run(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_pylist()
        sets = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
        side = table.column("side").to_numpy().astype(bool)
        found = block_links(sets, table.column("label").to_pylist(), side, threshold)
        return pa.table({"a": pa.array([nodes[x] for x, _ in found], pa.binary()), "b": pa.array([nodes[y] for _, y in found], pa.binary())})

    new = stored(rows.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary"), "near-block-links")
    if not new.head(1):
        return labels
    # the components so far are single nodes to the new links
    return components(new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))), "near-components-2")


def near_classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """One row per row of docs: doc_id, class_id (the smallest id in its class, null last), class_size and kept.

    Texts are linked if their weighted sets of five-word shingles (weights are counts; texts of under five words have
    one shingle) have a Jaccard similarity of `threshold` or more, and classes are the components of links.
    1. Texts with equal words are one node. Each node has a DartMinHash signature of 125 in 25 bands.
    2. Nodes that share a band are compared, exactly, as far as links_of needs it to join all that are alike.
    3. Components of all links.
    kept marks the row with the class's smallest id. Texts without words (null, empty) are one class. Rows that repeat
    an id are one class if their words are equal, and are all kept if it is the smallest. An empty table gives an
    empty result. Further columns are ignored, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = stored(_signed(d), "near-signed")
    total = row_count(signed)
    nodes = signed.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"))).alias("first"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    buckets = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    many = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"), "near-bands")
    shared = d.sparkSession.sparkContext.broadcast(Bits.collected(many, "bucket", row_count(many)))
    once = signed.select("node", "size", "bands").dropDuplicates(["node"])

    def together(batches):
        """Bands that another node may have too."""
        for batch in batches:
            flat = batch.column(2).flatten()
            on = np.flatnonzero(shared.value.has(flat.to_numpy(zero_copy_only=False).view(np.uint64)))
            owner = np.repeat(np.arange(batch.num_rows), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))[on]
            yield pa.RecordBatch.from_arrays([flat.take(pa.array(on)), *(batch.column(i).take(pa.array(owner)) for i in (0, 1))], ["bucket", "node", "size"])

    members = once.mapInArrow(together, "bucket bigint, node binary, size bigint").join(many, "bucket", "left_semi")
    members = stored(members, "near-members")
    involved = stored(members.select("node").distinct().withColumn("hash", F.expr("cast(conv(hex(substring(node, 1, 8)), 16, -10) as bigint)")), "near-involved")
    found = _elements(d, Bits.collected(involved, "hash", row_count(involved))).dropDuplicates(["node"])
    elements = stored(found.join(involved.select("node"), "node", "left_semi"), "near-elements")
    labels = links_of(members, elements, threshold)
    named = nodes.select("node", "n", "first")
    named = named.withColumn("label", F.col("node")) if labels is None else named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named, "near-named")
    classes = named.groupBy("label").agg(F.sum("n").alias("class_size"), F.min("first").alias("first"), F.count("*").alias("texts"))
    by_node = attach(named.select("node", "n", "label"), classes, ["label"], "texts", row_count(named))
    out = attach(signed.select("doc_id", "node"), by_node.drop("label", "texts"), ["node"], "n", total)
    return out.select("doc_id", F.col("first.id").alias("class_id"), "class_size", F.col("first.id").eqNullSafe(F.col("doc_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, that are kept by near_classes. Rows that share an id, null included, stay
    if one of them does; null and empty texts are one class, of which the smallest id stays."""
    kept = near_classes(docs, text_col, id_col, threshold).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(F.col("_kept_id")), "left_semi")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir))
