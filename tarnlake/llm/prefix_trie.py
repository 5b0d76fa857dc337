"""A trie of conversations: shared beginnings are nodes, found by binary search in the minima of prefix digests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from tarnlake.llm.common import arrow_schema, as_batch, attach, stored
from tarnlake.llm.vec import mix

#: Turns a block holds at most as it is read; its digests are 16 bytes a turn, its sizes 8.
BLOCK = 256
#: The most turns that a conversation takes from another.
HEAD = 8
#: Rows of one key that a window takes at once; sums of as many are then a row for the window above.
SPAN = 4096
#: Ids joined to one string at once.
JOINED = 1 << 16
BLOCKS = StructType([StructField("conv_id", LongType()), StructField("pos", LongType()), StructField("n", IntegerType()), StructField("digests", BinaryType()), StructField("sizes", BinaryType())])


def _part(binary: Column, width: int, first: Column, count: Column) -> Column:
    """`count` items of `width` bytes each, from item `first` on."""
    return F.substring(binary, (first * width + 1).cast("int"), (count * width).cast("int"))


def blocks_of(turns: DataFrame) -> DataFrame:
    """Blocks of up to BLOCK turns in order: conv_id, pos (number of the first turn in its conversation), n, and the
    turns' digests and sizes one after the other, from rows (conv_id, turn, digest, size).

    Rows are sorted over ranges of (conversation, turn, digest), so that a conversation takes as many tasks as its rows
    need. A task can't know how many turns of its first conversation came before: two counts a task go to the driver.
    """
    spark = turns.sparkSession
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size")
    schema = StructType([*BLOCKS.fields, StructField("task", IntegerType()), StructField("first", BooleanType()), StructField("edge", BooleanType())])
    target = arrow_schema(schema)

    def run(batches):
        task, first, last, pos = TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            first = int(conv[0]) if first is None else first
            digests, sizes = b"".join(batch.column(1).to_pylist()), batch.column(2).to_numpy().astype("<i8").tobytes()
            rows: dict[str, list] = {n: [] for n in target.names}
            edges = np.append(np.flatnonzero(np.diff(conv, prepend=conv[0] - 1)), len(conv)).tolist()
            for begin, end in zip(edges, edges[1:], strict=False):
                c = int(conv[begin])
                pos = pos if c == last else 0
                last = c
                for at in range(begin, end, BLOCK):
                    to = min(end, at + BLOCK)
                    for name, value in zip(target.names, (c, pos, to - at, digests[16 * at : 16 * to], sizes[8 * at : 8 * to], task, c == first, False), strict=True):
                        rows[name].append(value)
                    pos += to - at
            yield as_batch(rows, target)
        if first is not None:
            yield as_batch({"conv_id": [last], "pos": [pos], "n": [0], "digests": [None], "sizes": [None], "task": [task], "first": [last == first], "edge": [True]}, target)

    found = stored(dealt.mapInArrow(run, schema), "trie-blocks")
    ends = {r.task: r for r in found.filter("edge").select("task", "conv_id", "pos", "first").collect()}  # a row a task
    carried, conv, count = [], None, 0
    firsts = {r.task: r.conv_id for r in found.filter("first and not edge").groupBy("task").agg(F.min("conv_id").alias("conv_id")).collect()}
    for task in sorted(ends):
        before = count if firsts[task] == conv else 0
        if before:
            carried.append((task, before))
        conv, count = ends[task].conv_id, ends[task].pos + (before if ends[task].first else 0)
    known = found.filter("not edge")
    if not carried:
        return known.select(BLOCKS.names)
    more = spark.createDataFrame(carried, "_task int, _more bigint")
    joined = known.join(F.broadcast(more), (F.col("task") == F.col("_task")) & F.col("first"), "left")
    return joined.withColumn("pos", F.col("pos") + F.coalesce("_more", F.lit(0))).select(BLOCKS.names)


def rebuilt(blocks: DataFrame) -> DataFrame:
    """The blocks of rebuilt conversations: of each, the first h turns of the conversation conv_id - conv_id % 5 and what
    comes after its own first h, h being crc32(conv_id) % 9. The block with pos 0 is there even if it has no turn."""
    start = F.col("conv_id") - F.col("conv_id") % 5
    heads = blocks.filter((F.col("conv_id") == start) & (F.col("pos") < HEAD)).select("conv_id", F.struct("pos", "digests", "sizes").alias("b"))
    heads = heads.groupBy(F.col("conv_id").alias("_base")).agg(F.array_sort(F.collect_list("b")).alias("b"))  # HEAD blocks at most
    whole = lambda c: F.aggregate("b", F.expr("cast('' as binary)"), lambda s, x: F.concat(s, x[c]))
    heads = heads.select("_base", _part(whole("digests"), 16, F.lit(0), F.lit(HEAD)).alias("_digests"), _part(whole("sizes"), 8, F.lit(0), F.lit(HEAD)).alias("_sizes"))
    own = blocks.withColumns({"h": F.when(F.col("conv_id") == start, F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long"), "base": start})
    own = own.withColumn("skip", F.least(F.greatest(F.col("h") - F.col("pos"), F.lit(0)), F.col("n").cast("long")))
    own = own.join(heads, (own["base"] == heads["_base"]) & (own["h"] > 0), "left")
    given = F.least(F.col("h"), F.coalesce(F.length("_digests") / 16, F.lit(0)).cast("long"))
    own = own.withColumns({"given": given, "top": F.col("pos") == 0, "left": F.col("n") - F.col("skip")}).filter("top or left > 0")

    def joined(name: str, width: int) -> Column:
        mine = _part(F.col(name), width, F.col("skip"), F.col("left"))
        return F.when(F.col("top") & (F.col("given") > 0), F.concat(_part(F.col(f"_{name}"), width, F.lit(0), F.col("given")), mine)).otherwise(mine)

    return own.select(
        "conv_id", F.when(F.col("top"), F.lit(0)).otherwise(F.col("given") + F.col("pos") + F.col("skip") - F.col("h")).cast("long").alias("pos"),
        (F.col("left") + F.when(F.col("top"), F.col("given")).otherwise(0)).cast("int").alias("n"), joined("digests", 16).alias("digests"), joined("sizes", 8).alias("sizes"),
    )


def running(rows: DataFrame, key: str, place: str, columns: list[str], fold, span: int = SPAN, down: bool = False) -> DataFrame:
    """rows with a column _c for each c of columns: its fold (sum or bit_xor) over rows of the same key with a smaller
    place (down: larger), null if there are none. A window takes the rows of one span of places; a window above it takes
    a row per span, so that a key's rows needn't meet in one task."""
    way = F.desc if down else F.asc
    both = (lambda a, b: a.bitwiseXOR(b)) if fold is F.bit_xor else (lambda a, b: a + b)
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_span", F.floor(F.col(place) / span).cast("long"))
    inside, above = before(Window.partitionBy(key, "_span").orderBy(way(place))), before(Window.partitionBy("_key").orderBy(way("_s")))
    spans = rows.groupBy(F.col(key).alias("_key"), F.col("_span").alias("_s")).agg(*[fold(c).alias(c) for c in columns])
    spans = spans.select("_key", "_s", *[fold(c).over(above).alias(f"_more_{c}") for c in columns]).filter(F.col(f"_more_{columns[0]}").isNotNull())
    rows = rows.withColumns({f"_{c}": fold(c).over(inside) for c in columns})
    rows = rows.join(spans, (F.col(key) == F.col("_key")) & (F.col("_span") == F.col("_s")), "left")
    value = {f"_{c}": F.when(F.col(f"_{c}").isNull(), F.col(f"_more_{c}")).when(F.col(f"_more_{c}").isNull(), F.col(f"_{c}")).otherwise(both(F.col(f"_{c}"), F.col(f"_more_{c}"))) for c in columns}
    return rows.withColumns(value).drop("_span", "_key", "_s", *[f"_more_{c}" for c in columns])


def prefix_digests(blocks: DataFrame) -> DataFrame:
    """blocks with `prefix` (of each turn the digest of all turns up to it) in place of the turns' own digests, and `before`,
    the digest of the turns before the block. A turn's digest is mixed with its number, and all are joined by exclusive
    or, so that each block is worked on by itself: 128 bits, from MD5 sums."""
    schema = StructType([*BLOCKS.fields[:3], StructField("prefix", BinaryType()), BLOCKS["sizes"], StructField("x1", LongType()), StructField("x2", LongType())])
    target = arrow_schema(schema)

    def alone(batches):
        for batch in batches:
            prefix, x1, x2 = [], [], []
            for pos, data in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = np.frombuffer(data, "<u8").reshape(-1, 2)
                at = mix(np.arange(pos, pos + len(own), dtype=np.uint64))
                own = np.bitwise_xor.accumulate(np.stack([mix(own[:, 0] ^ at), mix(own[:, 1] + at)], axis=1), axis=0)
                prefix.append(own.tobytes())
                last = own[-1].view(np.int64).tolist() if len(own) else (0, 0)
                x1.append(last[0])
                x2.append(last[1])
            yield as_batch({"conv_id": batch.column(0), "pos": batch.column(1), "n": batch.column(2), "prefix": prefix, "sizes": batch.column(4), "x1": x1, "x2": x2}, target)

    local = stored(blocks.mapInArrow(alone, schema), "trie-local")
    carry = running(local.select("conv_id", "pos", "x1", "x2"), "conv_id", "pos", ["x1", "x2"], F.bit_xor, SPAN * BLOCK)
    carry = carry.filter("pos > 0").select(F.col("conv_id").alias("_c"), F.col("pos").alias("_p"), "_x1", "_x2")
    rows = local.join(carry, (F.col("conv_id") == F.col("_c")) & (F.col("pos") == F.col("_p")), "left")
    rows = rows.select("conv_id", "pos", "n", "prefix", "sizes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("_x1", "_x2")])
    final = StructType([*schema.fields[:5], StructField("before", BinaryType())])
    final_target = arrow_schema(final)

    def settled(batches):
        for batch in batches:
            prefix, before = [], []
            for data, x1, x2 in zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                carried = np.array([x1, x2], np.int64).view(np.uint64)
                before.append(carried.tobytes())
                prefix.append((np.frombuffer(data, "<u8").reshape(-1, 2) ^ carried).tobytes() if x1 or x2 else data)
            yield as_batch({"conv_id": batch.column(0), "pos": batch.column(1), "n": batch.column(2), "prefix": prefix, "sizes": batch.column(4), "before": before}, final_target)

    return stored(rows.mapInArrow(settled, final), "trie-prefixes")


def shared_prefixes(blocks: DataFrame) -> DataFrame:
    """digest, conv_id (smallest), depth, n (conversations) and size (bytes of the last text) of each prefix that more than one conversation has."""
    schema = StructType([StructField("conv_id", LongType()), StructField("depth", LongType()), StructField("digest", BinaryType()), StructField("size", LongType())])

    def each(batches):
        for batch in batches:
            counts = batch.column(2).to_numpy()
            total = int(counts.sum())
            if not total:
                continue
            digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), total, [None, pa.py_buffer(b"".join(batch.column(3).to_pylist()))]).cast(pa.binary())
            sizes = np.frombuffer(b"".join(batch.column(4).to_pylist()), "<i8")
            first = np.cumsum(counts) - counts
            depth = np.arange(total) - np.repeat(first, counts) + np.repeat(batch.column(1).to_numpy(), counts) + 1
            yield as_batch({"conv_id": pa.array(np.repeat(batch.column(0).to_numpy(), counts)), "depth": pa.array(depth), "digest": digests, "size": pa.array(sizes)}, arrow_schema(schema))

    rows = blocks.select("conv_id", "pos", "n", "prefix", "sizes").mapInArrow(each, schema)
    return rows.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count("*").alias("n"), F.min("size").alias("size")).filter("n > 1")


def first_owned(blocks: DataFrame, minima: DataFrame, most: int, total: int) -> DataFrame:
    """conv_id, first (depth of its first own prefix) and parent (digest of the one before) of each conversation that has one.

    A prefix is owned by the smallest conversation that has it; who owns one owns all longer ones. Each block halves
    its open prefixes in each round, by one join of the digest in the middle with the minima (digest, conv_id, n), and
    keeps only the digests still open. A prefix that isn't in the minima is its only conversation's own.
    """
    state = blocks.filter("n > 0").select("conv_id", "pos", "n", F.lit(0).alias("low"), F.col("n").alias("size"), F.col("prefix").alias("open"), F.col("before").alias("parent"))
    groups = minima.select(F.col("digest").alias("probe"), F.col("conv_id").alias("owner"), F.col("n").alias("members"))
    done = []
    for _ in range(most.bit_length()):
        mid = F.floor(F.col("size") / 2).cast("int")
        rows = state.withColumn("probe", _part(F.col("open"), 16, mid, F.lit(1)))
        rows = attach(rows, groups, ["probe"], "members", total)
        own = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        state = stored(rows.select(
            "conv_id", "pos", "n", F.when(own, F.col("low")).otherwise(F.col("low") + mid + 1).alias("low"), F.when(own, mid).otherwise(F.col("size") - mid - 1).alias("size"),
            F.when(own, _part(F.col("open"), 16, F.lit(0), mid)).otherwise(_part(F.col("open"), 16, mid + 1, F.col("size") - mid - 1)).alias("open"),
            F.when(own, F.col("parent")).otherwise(F.col("probe")).alias("parent"),
        ), "trie-search")
        done.append(state.filter("size = 0 and low < n").select("conv_id", (F.col("pos") + F.col("low") + 1).alias("first"), "parent"))
        state = state.filter("size > 0")
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    best = F.min(F.struct("first", "parent"))
    return found.groupBy("conv_id").agg(best.alias("b")).select("conv_id", "b.first", "b.parent")


def chain_totals(chains: DataFrame, root: int, count: int) -> DataFrame:
    """conv_id, leaves and saved of each chain's subtree, from the chain's own (conv_id, parent, leaves, saved).

    Bottom-up, twice as far in each round: every chain adds its sums to those of the chain it points at, and takes over
    that one's pointer; rounds are stored tables, as many as the height of the tree has binary digits.
    """
    state = chains.select("conv_id", F.col("parent").alias("up"), "leaves", "saved")
    while True:
        added = state.filter("up is not null").groupBy(F.col("up").alias("_to")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"), F.count("*").alias("_n"))
        summed = state.join(added, F.col("conv_id") == F.col("_to"), "left")
        summed = stored(summed.select("conv_id", "up", (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved"), "_n"), "trie-sums")
        if not summed.filter(F.col("up") != root).take(1):
            return summed.select("conv_id", "leaves", "saved")
        goal = summed.filter(F.col("_n").isNotNull() & (F.col("conv_id") != root)).select(F.col("conv_id").alias("up"), F.col("up").alias("next"), "_n")
        moving = attach(summed.drop("_n").filter(F.col("up") != root), goal, ["up"], "_n", count).drop("_n", "up").withColumnRenamed("next", "up")
        state = moving.unionByName(summed.drop("_n", "up").filter(F.coalesce(F.col("up") == root, F.lit(True))), allowMissingColumns=True)


def joined_ids(ends: DataFrame) -> DataFrame:
    """digest and sha (SHA-256 of the ids, ascending, joined by commas) from rows (digest, conv_id).

    Ids are sorted over ranges of (digest, id) and joined to strings of up to JOINED ids; those of one digest are then
    hashed one after the other, which this hash doesn't let more than one task do, in memory for one string."""
    piece = StructType([StructField("digest", BinaryType()), StructField("first", LongType()), StructField("ids", StringType())])

    def pieces(batches):
        held, first, ids = None, 0, []
        for batch in batches:
            rows: dict[str, list] = {"digest": [], "first": [], "ids": []}
            for digest, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest != held or len(ids) == JOINED:
                    if ids:
                        for name, value in (("digest", held), ("first", first), ("ids", ",".join(map(str, ids)))):
                            rows[name].append(value)
                    held, first, ids = digest, c, []
                ids.append(c)
            yield as_batch(rows, arrow_schema(piece))
        if ids:
            yield as_batch({"digest": [held], "first": [first], "ids": [",".join(map(str, ids))]}, arrow_schema(piece))

    out = StructType([StructField("digest", BinaryType()), StructField("sha", StringType())])

    def hashed(batches):
        held, state = None, None
        for batch in batches:
            rows: dict[str, list] = {"digest": [], "sha": []}
            for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest != held:
                    if held is not None:
                        rows["digest"].append(held)
                        rows["sha"].append(state.hexdigest())
                    held, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
            yield as_batch(rows, arrow_schema(out))
        if held is not None:
            yield as_batch({"digest": [held], "sha": [state.hexdigest()]}, arrow_schema(out))

    dealt = ends.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    return dealt.mapInArrow(pieces, piece).repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(hashed, out)


NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations: NODES.

    Texts are read once and never shuffled: an MD5 sum and a size stand for a turn. Blocks of turns are rebuilt, and get
    prefix digests; prefixes of more than one conversation have their smallest conversation in a table of minima, in
    which first_owned searches; what a conversation owns is a chain, which hangs on the chain that owns the prefix before; chain_totals
    sums subtrees over chains, and running sums over a chain give its nodes their parts.

    A null id belongs to no conversation: such rows are left out. Turns are ordered with null first; of the same turn, by
    the MD5 sum of role and text, repeated rows being turns of their own. Null roles and texts are empty. A conversation
    left without turns ends at the root. An empty table has no root. Further columns are ignored.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    turns = conversations.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"), F.octet_length(text).cast("long").alias("size"),
    )
    spark = conversations.sparkSession
    blocks = prefix_digests(rebuilt(blocks_of(turns)))
    # of each conversation: its length, its number of blocks, and the digest of all of it
    last = F.max(F.struct((F.col("pos") + F.col("n")).alias("length"), F.when(F.col("n") > 0, _part(F.col("prefix"), 16, F.col("n") - 1, F.lit(1))).otherwise(F.col("before")).alias("digest")))
    whole = stored(blocks.groupBy("conv_id").agg(last.alias("e"), F.count("*").alias("blocks"), F.max("n").alias("most")).select("conv_id", "e.length", "e.digest", "blocks", "most"), "trie-whole")
    seen = whole.agg(F.min("conv_id").alias("root"), F.count("*").alias("convs"), F.sum("length").alias("turns"), F.max("most").alias("most"), F.sum("blocks").alias("blocks")).first()
    if not seen.convs:
        return spark.createDataFrame([], NODES)
    top = spark.createDataFrame([(bytearray(16), seen.root, 0, seen.convs, 0)], "digest binary, conv_id long, depth long, n long, size long")
    nodes = stored(shared_prefixes(blocks).select(top.columns).union(top), "trie-minima")
    total = seen.turns + seen.convs

    found = first_owned(blocks, nodes, seen.most, total).filter(F.col("conv_id") != seen.root) if seen.most else spark.createDataFrame([], "conv_id long, first long, parent binary")
    owners = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("owner"), F.col("n").alias("members"))
    hung = attach(found, owners, ["parent"], "members", total).select("conv_id", "first", F.col("owner").alias("parent"))
    hung = hung.union(spark.createDataFrame([(seen.root, 0, None)], "conv_id long, first long, parent long"))
    own = nodes.groupBy("conv_id").agg(F.sum((F.col("n") - 1) * F.col("size")).alias("saved"), F.max("depth").alias("shared"), F.count("*").alias("nodes"))
    chains = hung.join(whole.select("conv_id", "length", "blocks"), "conv_id").join(own, "conv_id", "left")
    chains = stored(chains.select("conv_id", "first", "parent", "length", "blocks", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce("shared", F.lit(-1)).alias("shared"), F.coalesce("nodes", F.lit(0)).alias("nodes")), "trie-chains")
    at = chains.filter("parent is not null").select(F.col("parent").alias("_c"), (F.col("first") - 1).alias("_d")).distinct()
    grown = chains.join(at, (F.col("conv_id") == F.col("_c")) & (F.col("length") == F.col("_d")), "left").withColumn("leaf", F.col("_c").isNull().cast("long"))
    grown = stored(grown.drop("_c", "_d"), "trie-leaves")
    totals = chain_totals(grown.select("conv_id", "parent", F.col("leaf").alias("leaves"), "saved"), seen.root, seen.convs)

    kids = grown.select("conv_id", "parent", "first").join(totals, "conv_id").filter("parent is not null")
    kids = kids.groupBy(F.col("parent").alias("_c"), (F.col("first") - 1).alias("_d")).agg(F.count("*").alias("k"), F.sum("leaves").alias("kl"), F.sum("saved").alias("ks"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = nodes.join(kids, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("_d")), "left")
    both = both.select("digest", "conv_id", "depth", "n", zero("k").alias("k"), zero("kl").alias("kl"), ((F.col("n") - 1) * F.col("size") + zero("ks")).alias("w"))
    both = running(both, "conv_id", "depth", ["kl", "w"], F.sum, down=True)
    both = attach(both, grown.select("conv_id", "first", "parent", "length", "leaf", "nodes"), ["conv_id"], "nodes", max(1, seen.turns))
    ends = joined_ids(whole)
    both = both.join(ends.select(F.col("digest").alias("_e"), "sha"), F.col("digest") == F.col("_e"), "left")
    parent = F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("conv_id"))
    more = (F.col("depth") < F.col("length")).cast("long")
    shared = both.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), (more + F.col("k")).alias("n_children"), (F.col("leaf") + F.col("kl") + zero("_kl")).alias("n_leaves"),
        (F.col("w") + zero("_w")).alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
    # a prefix of one conversation alone is its own: one child or none, one leaf, nothing saved
    alone = attach(blocks.select("conv_id", "pos", "n").filter("n > 0"), grown.select("conv_id", "first", "parent", "length", "shared", "blocks"), ["conv_id"], "blocks", seen.blocks)
    begin, end = F.greatest(F.col("pos") + 1, "first", F.col("shared") + 1), F.col("pos") + F.col("n")
    alone = alone.filter(F.col("first").isNotNull() & (begin <= end)).withColumn("depth", F.explode(F.sequence(begin, end)))
    alone = alone.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), more.alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(F.when(more == 1, F.lit("")).otherwise(F.col("conv_id").cast("string")).cast("binary"), 256).alias("ends_sha256"),
    )
    return shared.unionByName(alone)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


_CRC = "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))"
ORACLE = f"""
WITH k AS (SELECT {_CRC} AS t),
turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS p,
  md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS m, strlen(coalesce(text, '')) AS size FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, CASE WHEN c % 5 = 0 THEN 0 ELSE xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295::BIGINT) % 9 END AS h
  FROM (SELECT DISTINCT c FROM turns), k),
mixed AS (SELECT v.c, 0 AS own, t.p, t.m, t.size FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.p < v.h UNION ALL SELECT v.c, 1, t.p, t.m, t.size FROM convs v JOIN turns t ON t.c = v.c AND t.p >= v.h),
made AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, m, size, own, p FROM mixed),
pre AS (SELECT c, d, string_agg(m, '') OVER (PARTITION BY c ORDER BY d) AS key, size FROM made UNION ALL SELECT c, 0, '', 0 FROM convs),
lens AS (SELECT c, max(d) AS last FROM pre GROUP BY c),
node AS (SELECT d, key, min(c) AS c, count(*) AS n, min(size) AS size, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = last), '') AS ids FROM pre JOIN lens USING (c) GROUP BY d, key),
kids AS (SELECT left(key, len(key) - 32) AS key, count(*) AS k FROM node WHERE d > 0 GROUP BY 1),
each AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (key)),
sub AS (SELECT left(key, 32 * i) AS key, sum((k = 0)::INT) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT key, k, n, size, unnest(range(d + 1)) AS i FROM each) GROUP BY 1)
SELECT e.c AS conv_id, e.d AS depth, p.c AS parent_conv_id, e.n AS n_convs, e.k AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(e.ids) AS ends_sha256
FROM each e JOIN sub s USING (key) LEFT JOIN node p ON p.d = e.d - 1 AND p.key = left(e.key, 32 * (e.d - 1))
"""
