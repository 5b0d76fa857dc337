"""Removal of repeated spans of words: a de Bruijn graph of token windows, compacted by joins, and their coordinates."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType

from tarnlake.llm.common import arrow_schema, as_batch, attach, documents, row_count, slices, stored
from tarnlake.llm.vec import Bits, mix, range_hashes, rolling, sliding_argmin, text_bytes, word_hashes, words

def edges_of(column: pa.Array, window: int, k: int) -> dict[str, np.ndarray]:
    """The graph's edges in a batch of texts.

    The graph's k-mers are windows of `window` words; each is an edge from its first words to its last. Neighbouring
    windows that share their minimiser (of the runs of k words in a window the one with the smallest hash, the first if
    equal) are one edge here, as they come in one row: `node` is the minimiser, `doc` the row of the text, `start` the
    word in the text where the first window starts, `windows` their number; h1 and h2 are hashes of all words spanned
    with the minimiser's place among them; `after` is the next edge's minimiser (0: none), and `around` a hash of the
    edge with the minimisers before and after it. Equal windows have equal minimisers, wherever they stand. `first` is
    the start counted in the batch, whose words have the hashes w1 and w2.
    """
    data, offsets = text_bytes(column)
    first, last, doc = words(data, offsets)
    base = np.searchsorted(doc, np.arange(len(column)))  # number of a text's first word in the batch
    h1, h2 = (word_hashes(data, first, last, s) for s in (1, 2))
    mers = rolling(h1, k, 3)
    at = sliding_argmin(mers, window - k + 1)
    whole = np.flatnonzero(doc[: len(at)] == doc[window - 1 :][: len(at)]) if len(at) else np.empty(0, np.int64)
    new = np.ones(len(whole), bool)
    new[1:] = (at[whole[1:]] != at[whole[:-1]]) | (whole[1:] != whole[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(whole)))
    start = whole[begin]
    place = at[start] if len(start) else start
    node = mers[place] if len(start) else np.empty(0, np.uint64)
    end = start + count + window - 1
    shift = (place - start).astype(np.uint64)
    doc = doc[start] if len(start) else start
    same = doc[1:] == doc[:-1]
    before, after = np.zeros_like(node), np.zeros_like(node)
    before[1:][same], after[:-1][same] = node[:-1][same], node[1:][same]
    e1, e2 = range_hashes(h1, start, end, 5) + shift, range_hashes(h2, start, end, 6) ^ shift
    return {
        "node": node, "doc": doc, "start": start - base[doc] if len(start) else start, "windows": count, "h1": e1, "h2": e2,
        "after": after, "around": mix(e1 ^ mix(before ^ mix(after))), "first": start, "w1": h1, "w2": h2,
    }


def window_hashes(e: dict[str, np.ndarray], on: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of the edges `on`, one after the other, and len + 1 offsets."""
    width = e["windows"][on]
    ends = np.concatenate([[0], np.cumsum(width)])
    at = np.repeat(e["first"][on] - ends[:-1], width) + np.arange(ends[-1])
    return range_hashes(e["w2"], at, at + window, 8), ends


def _int64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def mark_repeats(rows: DataFrame, name: str) -> DataFrame:
    """rows with `repeat`: whether a row with the same (k1, k2) has an earlier place (doc_id, null last; start).

    The key's own columns are left out. Rows are sorted by key and place over ranges of both, so a key with any share of the rows is spread over as many
    tasks as its rows need; each task reads its rows once, in order. Only of the rows with a task's first key and place
    it can't tell; the last key of the task before settles that: two keys a task go to the driver. `hashes`, if there,
    becomes null in repeats.
    """
    spark = rows.sparkSession
    order = ["k1", "k2", "none", "doc_id", "start"]
    dealt = rows.withColumn("none", F.col("doc_id").isNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.select("k1", "k2", *[c for c in rows.columns if c not in ("k1", "k2")])
    schema = StructType([*(StructField(f.name, f.dataType) for f in dealt.schema.fields[2:]), StructField("repeat", BooleanType()), StructField("task", LongType()), StructField("edge", ArrayType(LongType()))])
    target, at = arrow_schema(schema), {c: i for i, c in enumerate(dealt.columns)}

    def run(batches):
        task = TaskContext.get().partitionId()
        before, first_run, moved = None, True, False  # the row before, whether its key is the task's first, whether the place has changed since the key began
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            place = [batch.column(at[c]) for c in ("k1", "k2", "doc_id", "start")]
            if before is not None:
                place = [pa.concat_arrays([x, y]) for x, y in zip(before, place, strict=True)]
            else:
                place = [pa.concat_arrays([x.slice(0, 1), x]) for x in place]
            k1, k2, start = (place[i].to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            ids = pc.equal(place[2].slice(1), place[2].slice(0, n)).fill_null(False).to_numpy(zero_copy_only=False)
            ids |= pc.and_(place[2].slice(1).is_null(), place[2].slice(0, n).is_null()).to_numpy(zero_copy_only=False)
            new_key = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            changes = np.cumsum(~new_key & ~(ids & (start[1:] == start[:-1]))) + int(moved)
            at_key = np.flatnonzero(new_key)
            base = np.zeros(n, np.int64)
            if len(at_key):
                base = np.where(np.cumsum(new_key) > 0, changes[at_key[np.maximum(np.cumsum(new_key) - 1, 0)]], 0)
            repeat = changes > base
            open_ = ~repeat & (np.cumsum(new_key) == 0) & first_run
            edge: list = [None] * n
            if before is None:
                edge[0] = [int(k1[1]), int(k2[1])]
            first_run &= not len(at_key)
            moved = bool(repeat[-1])
            before = [x.slice(n, 1) for x in place]
            own = batch.columns[2:]
            if "hashes" in at:
                own[at["hashes"] - 2] = pc.if_else(pa.array(repeat), pa.scalar(None, own[at["hashes"] - 2].type), own[at["hashes"] - 2])
            yield pa.RecordBatch.from_arrays([*own, pa.array(repeat, mask=open_), pa.array(np.full(n, task)), pa.array(edge, pa.list_(pa.int64()))], schema=target)
        if before is not None:
            last = {f.name: None for f in target} | {"task": task, "edge": [before[0][0].as_py(), before[1][0].as_py(), 1]}
            yield pa.RecordBatch.from_pylist([last], schema=target)

    marked = stored(dealt.mapInArrow(run, schema), name)
    edges = {(r.task, len(r.edge)): r.edge[:2] for r in marked.filter("edge is not null").select("task", "edge").collect()}
    tasks = sorted({t for t, _ in edges})
    continued = [t for last, t in zip(tasks, tasks[1:], strict=False) if edges[last, 3] == edges[t, 2]]
    known = marked.filter("edge is null or size(edge) = 2").drop("edge")
    return known.withColumn("repeat", F.coalesce("repeat", F.col("task").isin(continued))).drop("task")


def path_lengths(nodes: DataFrame, name: str = "debruijn-paths", most_rounds: int = 64) -> DataFrame:
    """node, n and windows of each nonbranching path's first node, from all nonbranching nodes (node, n, after, windows).

    A node is joined with the one after it, if that doesn't branch either; what none comes before begins a path. Then
    every node takes its successor's successor and adds up the windows between, so that steps double in each round, until
    all have come to their path's end. Rounds are stored tables; a path of 2^r edges takes r of them.
    """
    next_ = nodes.select(F.col("node").alias("_next"))
    linked = stored(nodes.join(next_, F.col("after") == F.col("_next"), "left").select("node", "n", "windows", F.col("_next").alias("to")), f"{name}-0")
    heads = stored(linked.join(linked.select(F.col("to").alias("_to")), F.col("node") == F.col("_to"), "left_anti").select("node", "n"), f"{name}-heads")
    steps = linked.select("node", "windows", "to")
    for number in range(1, most_rounds):
        active = steps.filter("to is not null")
        if not active.head(1):
            break
        on = steps.select(F.col("node").alias("_node"), F.col("windows").alias("_w"), F.col("to").alias("_to"))
        moved = active.join(on, F.col("to") == F.col("_node")).select("node", (F.col("windows") + F.col("_w")).alias("windows"), F.col("_to").alias("to"))
        steps = stored(steps.filter("to is null").unionByName(moved), f"{name}-{number}")
    return heads.join(steps.select("node", "windows"), "node")


def verified_paths(docs: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """Of the places of paths (node, doc_id, uid, start, windows) all but each path's first, by source coordinates, whose
    words are those at that first place: doc_id, uid, start and end.

    Both places' words are read again at their coordinates, in the texts that have any, and compared by SHA-256; digests
    meet by `attach`, so a path may be in any share of the texts. (The hashes that found them are quick, not secure.)
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    sources = paths.groupBy("node").agg(F.count("*").alias("n"), F.min(place).alias("s"), F.min_by("uid", place).alias("s_uid")).filter("n > 1")
    met = attach(paths, sources, ["node"], "n", row_count(paths)).filter("n is not null")
    end = (F.col("start") + F.col("windows") + window - 1).alias("end")
    wanted = met.withColumn("source", F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("start") == F.col("s.start")) & (F.col("uid") == F.col("s_uid")))
    wanted = wanted.filter(F.col("source") | (place > F.col("s"))).select("doc_id", "uid", "start", end, "node", "source")
    asked = wanted.distinct().groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start", "end", "node", "source")).alias("spans"))
    asked = stored(asked.withColumnsRenamed({"doc_id": "_id", "uid": "_uid"}), "debruijn-asked")
    some = docs.sparkSession.sparkContext.broadcast(Bits.collected(asked, "_uid", row_count(asked)))

    def involved(batches):
        for batch in batches:
            yield batch.filter(pa.array(some.value.has(batch.column(1).to_numpy().view(np.uint64))))

    met = docs.mapInArrow(involved, docs.schema).join(asked, (F.col("uid") == F.col("_uid")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "uid", "text", "spans")
    fields = [docs.schema["doc_id"], *(StructField(n, LongType()) for n in ("uid", "start", "end", "node")), StructField("source", BooleanType()), StructField("digest", BinaryType())]
    target = arrow_schema(StructType(fields))

    def read(batches):
        for batch in slices(batches, 2):
            rows = {f.name: [] for f in target}
            for doc_id, uid, text, spans in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                parts = text.encode().split()
                for x in spans:
                    digest = hashlib.sha256(b" ".join(parts[x["start"] : x["end"]])).digest()
                    for name, value in zip(target.names, (doc_id, uid, *x.values(), digest), strict=True):
                        rows[name].append(value)
            yield as_batch(rows, target)

    found = stored(met.mapInArrow(read, StructType(fields)), "debruijn-verified")
    again = found.filter("not source")
    counts = again.groupBy("node").agg(F.count("*").alias("n"))
    first = found.filter("source").select("node", F.col("digest").alias("first")).dropDuplicates(["node"]).join(counts, "node")
    both = attach(again, first, ["node"], "n", row_count(again))
    return both.filter(F.col("digest") == F.col("first")).select("doc_id", "uid", "start", "end")


def repeated_spans(docs: DataFrame, window: int = 20, k: int = 8) -> DataFrame:
    """Spans of words, all of whose windows also start earlier: doc_id, uid, start, end.

    docs has doc_id, uid (a hash of id and text) and text without nulls. The steps:
    1. All texts' edges are grouped by minimiser (counted before the shuffle). Minimisers that occur once can't repeat.
       Those that always have the same edge between the same neighbours don't branch; the others do.
    2. path_lengths compacts nonbranching edges into paths by joins. A path is the same words wherever its first edge is.
    3. Texts are read again for the places of paths' first edges, joined to the paths' lengths, and of branching edges.
       Which minimisers are wanted is told by Bits, whose false answers the join removes (first edges), or which are
       edges that don't repeat (others): a row each. Paths, the long ones, are read again at their coordinates and
       compared with their first place (verified_paths). mark_repeats finds the earliest place of each edge, by 128-bit
       hashes of all words; all others are repeats as a whole.
    4. Edges at one branching minimiser may share windows though they differ. The first places of such edges, joined to
       the branching minimisers, give a row per window, and mark_repeats finds the windows that also start earlier.
    """
    spark = docs.sparkSession
    d = docs.select("doc_id", "uid", "text")

    def nodes(batches):
        for batch in slices(batches, 0, 2 << 20):
            e = edges_of(batch.column(0), window, k)
            yield pa.RecordBatch.from_arrays([_int64(e[c]) for c in ("node", "around", "after", "windows")], ["node", "around", "after", "windows"])

    seen = d.select("text").mapInArrow(nodes, "node bigint, around bigint, after bigint, windows bigint").groupBy("node")
    seen = seen.agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high"), F.max("after").alias("after"), F.max("windows").alias("windows")).filter("n > 1")
    seen = stored(seen.select("node", "n", (F.col("low") != F.col("high")).alias("branches"), "after", "windows"), "debruijn-nodes")
    branching = seen.filter("branches").select("node", "n")
    paths = stored(path_lengths(seen.filter("not branches").select("node", "n", "after", "windows")), "debruijn-paths")
    wanted = [Bits.collected(x, "node", row_count(x)) for x in (paths, branching)]
    shared = spark.sparkContext.broadcast(wanted)
    fields = [StructField("k1", LongType()), StructField("k2", LongType()), d.schema["doc_id"], *(StructField(n, LongType()) for n in ("uid", "start", "windows", "node")), StructField("hashes", ArrayType(LongType()))]
    schema = StructType(fields)
    target = arrow_schema(schema)

    def places(batches):
        """First edges of paths, without hashes, and branching edges with those of their windows."""
        begins, branches = shared.value
        for batch in slices(batches, 2, 2 << 20):
            e = edges_of(batch.column(2), window, k)
            of_path, of_edge = np.flatnonzero(begins.has(e["node"])), np.flatnonzero(branches.has(e["node"]))
            on = np.concatenate([of_path, of_edge])
            flat, ends = window_hashes(e, of_edge, window)
            offsets = pa.array(np.concatenate([np.zeros(len(of_path), np.int32), ends.astype(np.int32)]), mask=np.arange(len(on) + 1) < len(of_path))
            take = pa.array(e["doc"][on])
            arrays = [_int64(e["h1"][on]), _int64(e["h2"][on]), batch.column(0).take(take), batch.column(1).take(take), *(_int64(e[c][on]) for c in ("start", "windows", "node"))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(offsets, _int64(flat))], schema=target)

    found = stored(d.mapInArrow(places, schema), "debruijn-places")
    begins = found.filter("hashes is null").drop("windows")
    lengths = paths.select("node", "n", "windows")
    begins = attach(begins, lengths, ["node"], "n", row_count(begins)).filter("windows is not null").drop("n")
    long = verified_paths(d, begins.select("node", "doc_id", "uid", "start", "windows"), window)
    marked = mark_repeats(found.filter("hashes is not null"), "debruijn-marked")
    first = marked.filter("not repeat").select("doc_id", "uid", "start", "node", "hashes")
    first = attach(first, branching, ["node"], "n", row_count(first)).filter("n is not null")
    each = first.select(F.col("node").alias("k1"), "doc_id", "uid", "start", F.posexplode("hashes").alias("pos", "k2"))
    each = each.select("k1", "k2", "doc_id", "uid", (F.col("start") + F.col("pos")).alias("start"), F.lit(1).cast("bigint").alias("windows"))
    single = mark_repeats(each, "debruijn-windows")
    short = marked.drop("hashes", "node").unionByName(single).filter("repeat")
    return long.unionByName(short.select("doc_id", "uid", "start", (F.col("start") + F.col("windows") + window - 1).alias("end")))


def kept_words(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, list[bytes]]:
    """The number of words, and those that no range covers."""
    parts = text.split()
    keep = np.ones(len(parts), bool)
    for start, end in ranges:
        keep[start:end] = False
    return len(parts), [parts[i] for i in np.flatnonzero(keep).tolist()] if not keep.all() else parts


def substring_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", window: int = 20, k: int = 8, digests: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, and text (kept words joined by a space) or kept_sha256.

    Words are longest runs of other characters than ASCII white space. A word goes if it lies in a window of `window`
    words whose sequence also starts earlier, in a text with a smaller id (null last) or earlier in the same text;
    windows are judged on the input. Null texts have no words; texts shorter than a window stay whole. Rows that repeat
    an id with an equal text have equal places, of which none is earlier, and lose the same words.
    An empty table gives an empty result. Further columns are ignored, whatever their names.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("uid", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(d, window, k)
    gone = spans.distinct().groupBy("doc_id", "uid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    gone = stored(gone, "substring-ranges")
    some = d.sparkSession.sparkContext.broadcast(Bits.collected(gone, "uid", row_count(gone)))
    result = "kept_sha256" if digests else "kept"
    schema = StructType([d.schema["doc_id"], StructField("uid", LongType()), StructField("raw", BinaryType()), StructField("words", LongType()), StructField(result, StringType())])
    target = arrow_schema(schema)

    def finish(kept: list[bytes]) -> str:
        text = b" ".join(kept)
        return hashlib.sha256(text).hexdigest() if digests else text.decode()

    def whole(batches):
        """Texts that lose nothing end here; of all others the text goes on, to meet its ranges."""
        for batch in slices(batches, 1):
            out = {"doc_id": batch.column(0), "uid": batch.column(2), "raw": [], "words": [], result: []}
            hit = some.value.has(batch.column(2).to_numpy().view(np.uint64))
            for text, waits in zip(batch.column(1).cast(pa.binary()).to_pylist(), hit.tolist(), strict=True):
                count, kept = (None, None) if waits else kept_words(text, [])
                out["raw"].append(text if waits else None)
                out["words"].append(count)
                out[result].append(None if waits else finish(kept))
            yield as_batch(out, target)

    met = d.select("doc_id", "text", "uid").mapInArrow(whole, schema).join(gone.withColumnsRenamed({"uid": "_uid", "doc_id": "_id"}), (F.col("uid") == F.col("_uid")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left").drop("_id", "_uid", "uid")
    final = StructType([d.schema["doc_id"], StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256" if digests else "text", StringType())])
    final_target = arrow_schema(final)

    def cut(batches):
        for batch in slices(batches, 1):
            counts, removed, texts = batch.column(2).to_pylist(), [], batch.column(3).to_pylist()
            for i, (text, ranges) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                left = counts[i]
                if text is not None:
                    counts[i], kept = kept_words(text, [(r["start"], r["end"]) for r in ranges or []])
                    left, texts[i] = len(kept), finish(kept)
                removed.append(counts[i] - left)
            yield as_batch(dict(zip(final_target.names, (batch.column(0), counts, removed, texts), strict=True)), final_target)

    return met.select("doc_id", "raw", "words", result, "ranges").mapInArrow(cut, final)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir), digests=True)


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
l AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM d),
k AS (SELECT doc_id, w, p, CASE WHEN count(*) OVER o = 20 THEN string_agg(w, ' ') OVER o END AS key
      FROM l WINDOW o AS (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
f AS (SELECT doc_id, w, p, key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY doc_id, p) > 1 AS later FROM k),
c AS (SELECT doc_id, w, p, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""
