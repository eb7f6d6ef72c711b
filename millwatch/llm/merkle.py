"""Merkle manifest of a dataset: leaves placed by the rank of their id in bitmaps, runs of 16 reduced level by level.

1. A row's leaf is a hash of its fields. Leaves are written once, as 32 bytes beside group and id; texts aren't read again.
2. Each task packs the ids it meets into containers of 4,096 (group, id >> 12): the low bits as 16-bit numbers, or 512
   bytes of bits where these are shorter. Containers of a key are merged by OR; a merged one is an array of at most 255
   low bits, or 64 words with a directory of the ones before each word. Running sums over a group's containers say how
   many leaves come before each.
3. Rank: a leaf meets its container and knows its place, from the directory, the ones below its bit and the container's
   begin. No leaf is compared with another. Only containers with fewer ones than rows (repeated or null ids) order their
   leaves, by id and leaf, equal rows counted as one; that happens in ranges, so no repeated id gathers.
4. Levels: key (group, place / 16) collects 16 slots, whose digests make the parent. A group that is down to one node
   passes. Groups' subroots are leaves of the last tree, in order of group.
5. Proofs go down: a run takes its parent's siblings and those of all above it; leaves are in their runs, so only runs
   (one row for 16 leaves) meet their parents.

Every step is a shuffle or a written table; no group's rows meet in one task.

Defined results: null fields are `-`; a null group is one of its own and comes first; null ids come first in their group;
rows with the same id in a group stand in order of their leaves, equal rows next to each other, and each gives its row.
Empty texts are values. A single leaf is its group's subroot, a single subroot the root; without siblings the proof is
the hash of nothing. Very long texts are hashed where they are read. An empty table gives an empty result. Output
columns are fixed, so other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import written
from millwatch.operators.ordering import global_index, running

WIDTH = 16
#: Ids of a container, as a power of two; ids that a task packs at once; copies of a row that one task unfolds.
BITS, PACK, COPIES = 12, 1 << 18, 1 << 12
SIZE = 1 << BITS
#: Group key and container of null ids: before all others.
NULL_HI = -(1 << 62)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, colon, value (a whole number in decimal)."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def lower_case(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def leaf_table(docs: DataFrame, key: str, group: str, fields: tuple[str, ...], tampered: Column, tamper: dict[str, Column]) -> DataFrame:
    """(g string, id long, leaf binary, seen binary): seen is the leaf after tampering, null where nothing is tampered
    with. tamper: new values of fields."""
    now = [encoded(F.col(f"`{c}`")) for c in fields]
    then = [encoded(tamper.get(c, F.col(f"`{c}`"))) for c in fields]
    g = F.coalesce(F.concat(F.lit("s"), F.col(f"`{group}`").cast("string")), F.lit("n"))
    seen = F.when(F.coalesce(tampered, F.lit(False)), F.unhex(digest(*then)))
    return docs.select(g.alias("g"), F.col(f"`{key}`").cast("long").alias("id"), F.unhex(digest(*now)).alias("leaf"), seen.alias("seen"))


# ---- bitmaps ------------------------------------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Containers (g, hi, bits, rows) of the ids that come."""
    held: list[pa.RecordBatch] = []

    def take():
        t = pa.Table.from_batches(held)
        code, names = pd.factorize(t.column("g").to_numpy())
        hi, low = t.column("hi").to_numpy(), t.column("low").to_numpy()
        order = np.lexsort((low, hi, code))
        code, hi, low = code[order], hi[order], low[order]
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (hi[1:] != hi[:-1])])
        first = np.flatnonzero(new)
        bits = _encode(np.cumsum(new) - 1, low, len(first))
        return pa.RecordBatch.from_arrays([pa.array(names[code[first]], pa.string()), pa.array(hi[first]), bits, pa.array(np.diff(np.append(first, len(low))))], names=["g", "hi", "bits", "rows"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= PACK:
            yield take()
            held = []
    if sum(b.num_rows for b in held):
        yield take()


def _encode(owner: np.ndarray, low: np.ndarray, many: int) -> pa.Array:
    """A binary for each of `many` containers of low bits, sorted by owner and low bits; repeated ones count once."""
    keep = np.ones(len(low), dtype=bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (low[1:] != low[:-1])
    owner, low = owner[keep], low[keep]
    count = np.bincount(owner, minlength=many)
    raw, ends = low.astype("<u2").tobytes(), np.cumsum(count) * 2
    out = [raw[b - 2 * n : b] for n, b in zip(count.tolist(), ends.tolist(), strict=True)]
    for k in np.flatnonzero(2 * count >= SIZE // 8):
        one = np.zeros(SIZE, dtype=np.uint8)
        one[low[ends[k] // 2 - count[k] : ends[k] // 2]] = 1
        out[k] = np.packbits(one, bitorder="little").tobytes()
    return pa.array(out, pa.binary())


def _decode(bits: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(container's number, low bits) of all ids in the containers."""
    length = pc.binary_length(bits).to_numpy(zero_copy_only=False)
    wide = np.flatnonzero(length == SIZE // 8)
    owners, lows = [], []
    flat = b"".join(b for b, n in zip(bits.to_pylist(), length.tolist(), strict=True) if n != SIZE // 8)
    lows.append(np.frombuffer(flat, dtype="<u2").astype(np.int64))
    owners.append(np.repeat(np.arange(len(length)), np.where(length == SIZE // 8, 0, length // 2)))
    for k in wide.tolist():
        one = np.flatnonzero(np.unpackbits(np.frombuffer(bits[k].as_py(), dtype=np.uint8), bitorder="little"))
        lows.append(one)
        owners.append(np.full(len(one), k))
    return np.concatenate(owners), np.concatenate(lows)


INDEX = "g string, hi long, n long, n_rows long, lows array<smallint>, words array<bigint>, ahead array<smallint>"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ORs the containers of each key; they come sorted by key, and a key has one a task that packed at most."""
    held: list[pa.RecordBatch] = []

    def take(t: pa.Table) -> pa.RecordBatch:
        code, hi = pd.factorize(t.column("g").to_numpy())[0], t.column("hi").to_numpy()
        new = np.concatenate([[True], (code[1:] != code[:-1]) | (hi[1:] != hi[:-1])])
        first = np.flatnonzero(new)
        owner, low = _decode(t.column("bits").combine_chunks())
        both = np.unique((np.cumsum(new) - 1)[owner] * SIZE + low)
        owner, low = both // SIZE, both % SIZE
        n = np.bincount(owner, minlength=len(first))
        lows, words, ahead, at = [], [], [], 0
        for k in n.tolist():
            part = low[at : at + k]
            at += k
            if 2 * k < SIZE // 8:
                lows.append(part.astype(np.int16))
                words.append(None)
                ahead.append(None)
                continue
            one = np.zeros(SIZE, dtype=np.uint8)
            one[part] = 1
            word = np.packbits(one, bitorder="little").view("<u8")
            ones = np.bitwise_count(word).astype(np.int16)
            lows.append(None)
            words.append(word.view(np.int64))
            ahead.append((np.cumsum(ones) - ones).astype(np.int16))
        cols = [t.column("g").take(pa.array(first)), pa.array(hi[first]), pa.array(n), pa.array(np.add.reduceat(t.column("rows").to_numpy(), first)), pa.array(lows, pa.list_(pa.int16())), pa.array(words, pa.list_(pa.int64())), pa.array(ahead, pa.list_(pa.int16()))]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], names=[c.split()[0] for c in INDEX.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        g, hi = t.column("g"), t.column("hi")
        last = pc.and_(pc.equal(g, g[-1]), pc.equal(hi, hi[-1])).to_numpy()
        whole = int(np.argmax(last))  # sorted: the last key's rows stand at the end
        if whole:
            yield take(t.slice(0, whole))
        held = t.slice(whole).combine_chunks().to_batches()
    if held:
        yield take(pa.Table.from_batches(held))


def id_index(ids: DataFrame) -> DataFrame:
    """(g, hi, n, n_rows, lows | words and ahead, start, m): the merged containers of (g, hi, low), the leaves before each in
    its group, and the group's leaves."""
    packed = ids.mapInArrow(_pack, "g string, hi long, bits binary, rows long")
    merged = packed.repartition("g", "hi").sortWithinPartitions("g", "hi").mapInArrow(_merge, INDEX)
    out = running(written(merged, "containers"), [F.col("hi").asc()], {"start": F.col("n_rows")}, ["g"], inclusive=False, totals=True)
    return written(out.withColumnRenamed("start_total", "m"), "index")


def placed(leaves: DataFrame, index: DataFrame, repeated: bool) -> DataFrame:
    """(g, p, m, id, leaf, seen): each leaf's place in its group. repeated: some containers have fewer ones than rows."""
    word = F.expr("get(words, cast(shiftright(low, 6) as int))")
    below = F.bit_count(word.bitwiseAND(F.expr("~shiftleft(-1L, cast(low & 63 as int))")))
    rank = F.when(F.col("words").isNotNull(), F.expr("get(ahead, cast(shiftright(low, 6) as int))") + below).otherwise(F.array_position("lows", F.col("low").cast("smallint")) - 1)
    met = leaves.join(index, ["g", "hi"])
    kept = ["g", "m", "id", "leaf", "seen"]
    if not repeated:
        return met.select(*kept, (F.col("start") + rank).alias("p"))
    single = met.where("n = n_rows").select(*kept, (F.col("start") + rank).alias("p"))
    # equal rows are one with their number, then places in order of id and leaf
    more = met.where("n < n_rows").groupBy(*kept, "hi", "start").agg(F.count("*").alias("copies"))
    more = running(written(more, "repeated"), [F.col("id").asc_nulls_first(), F.col("leaf").asc()], {"r": F.col("copies")}, ["g", "hi"], inclusive=False)
    blocks = more.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}")))).hint("rebalance")
    each = blocks.withColumn("_k", F.explode(F.sequence(F.col("_b") * COPIES, F.least(F.col("copies"), (F.col("_b") + 1) * COPIES) - 1)))
    return single.unionByName(each.select(*kept, (F.col("start") + F.col("r") + F.col("_k")).alias("p")))


# ---- levels -------------------------------------------------------------------------------------------------------


def parent(kids: Column, m: Column) -> Column:
    """Digest of a run of hex digests; a group's only node passes."""
    return F.when(m > 1, F.sha2(F.array_join(kids, ""), 256)).otherwise(kids[0])


def reduce_levels(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels of runs (g, q, kids, m, digest) above nodes (g, p, m, digest) of groups with `most` nodes at most, and the
    last nodes, one a group."""
    out = []
    while most > 1:
        slots = F.sort_array(F.collect_list(F.struct("p", "digest")))
        runs = nodes.groupBy("g", F.expr(f"p div {WIDTH}").alias("q")).agg(slots["digest"].alias("kids"), F.first("m").alias("m"))
        out.append(written(runs.withColumn("digest", parent(F.col("kids"), F.col("m"))), "level"))
        nodes = out[-1].select("g", F.col("q").alias("p"), F.expr(f"(m + {WIDTH - 1}) div {WIDTH}").alias("m"), "digest")
        most = -(-most // WIDTH)
    return out, nodes


def siblings(kids: Column, slot: Column) -> Column:
    """What stands left and right of a slot, each as one text."""
    return F.struct(F.array_join(F.slice(kids, 1, slot), "").alias("l"), F.array_join(F.slice(kids, slot + 2, WIDTH), "").alias("r"))


def with_paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """(g, q, path, subroot): siblings from level to level above each node of the lowest of these levels' children; top
    is (g, q, path, subroot) of the groups' last nodes. Each child meets its parent."""
    path = top
    for k in range(len(levels) - 1, -1, -1):
        above = levels[k].join(path, ["g", "q"]).select("g", F.col("q").alias("u"), "kids", "m", "path", "subroot")
        if k == 0:
            return above
        below = levels[k - 1].select("g", "q", F.expr(f"q div {WIDTH}").alias("u"))
        path = below.join(above, ["g", "u"]).select("g", "q", _longer(F.col("q")).alias("path"), "subroot")
    return path


def _longer(node: Column) -> Column:
    """The path of a node from its parent's kids and path; without an entry where the parent is itself."""
    slot = F.pmod(node, F.lit(WIDTH)).cast("int")
    return F.when(F.col("m") > 1, F.concat(F.array(siblings(F.col("kids"), slot)), F.col("path"))).otherwise(F.col("path"))


def manifest(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, tampered: Column | None = None, tamper: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id long, leaf, subroot, root, proof_sha256, folded_root string, verified boolean, position long): the
    manifest of docs, a row for each of its rows, and what verification finds where rows are tampered with."""
    names = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, position long"
    tampered = F.lit(False) if tampered is None else tampered
    leaves = written(leaf_table(docs, key, group, fields, tampered, tamper or {}), "leaves")
    split = {"hi": F.coalesce(F.shiftright("id", BITS), F.lit(NULL_HI)), "low": F.coalesce(F.col("id").bitwiseAND(F.lit(SIZE - 1)), F.lit(0).cast("long"))}
    leaves = leaves.withColumns(split)
    index = id_index(leaves.select("g", "hi", "low"))
    most, repeated = index.agg(F.max("m"), F.max(F.col("n_rows") > F.col("n"))).first()
    if most is None:
        return docs.sparkSession.createDataFrame([], names)
    slots = F.sort_array(F.collect_list(F.struct("p", F.lower(F.hex("leaf")).alias("leaf"), "id", F.lower(F.hex("seen")).alias("seen"))))
    first = placed(leaves, index, repeated).groupBy("g", F.expr(f"p div {WIDTH}").alias("q")).agg(slots.alias("slots"), F.first("m").alias("m"))
    first = written(first.withColumn("digest", parent(F.col("slots")["leaf"], F.col("m"))), "runs")
    nodes = first.select("g", F.col("q").alias("p"), F.expr(f"(m + {WIDTH - 1}) div {WIDTH}").alias("m"), "digest")
    levels, last = reduce_levels(nodes, -(-most // WIDTH))
    subroots = global_index(last.select("g", "digest"), "g", "g", "p")
    groups = written(subroots, "groups")
    many = groups.count()
    tops, root = reduce_levels(groups.select(F.lit("").alias("g"), "p", F.lit(many).cast("long").alias("m"), "digest"), many)
    root = root.first()["digest"]  # one row
    no_path = F.array().cast("array<struct<l:string,r:string>>")
    start = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.lit(0).cast("long").alias("q"), no_path.alias("path"), F.lit("").alias("subroot"))
    if tops:
        # subroots are the children of the lowest of the last tree's levels
        above = with_paths(tops, start).drop("g", "subroot")
        source = groups.withColumn("u", F.expr(f"p div {WIDTH}")).join(above, "u").select("g", F.lit(0).cast("long").alias("q"), _longer(F.col("p")).alias("path"), F.col("digest").alias("subroot"))
    else:
        source = groups.select("g", F.lit(0).cast("long").alias("q"), no_path.alias("path"), F.col("digest").alias("subroot"))
    if levels:
        above = with_paths(levels, source)
        runs = first.drop("digest").withColumn("u", F.expr(f"q div {WIDTH}")).withColumnRenamed("m", "m0").join(above, ["g", "u"]).withColumn("path", _longer(F.col("q")))
    else:
        runs = first.drop("digest").withColumnRenamed("m", "m0").join(source, ["g", "q"])
    runs = runs.select("slots", F.col("m0").alias("m"), "path", "subroot", F.array_join(F.transform("path", lambda e: F.concat(e["l"], e["r"])), "").alias("rest"))
    each = runs.select("*", F.posexplode("slots").alias("i", "s"))
    own = siblings(F.col("slots")["leaf"], F.col("i"))
    each = each.select("m", "path", "subroot", "rest", "s", F.when(F.col("m") > 1, own).otherwise(F.struct(F.lit("").alias("l"), F.lit("").alias("r"))).alias("own"))
    node = F.coalesce(F.col("s.seen"), F.col("s.leaf"))
    begin = F.when(F.col("m") > 1, digest(F.col("own.l"), node, F.col("own.r"))).otherwise(node)
    out = each.select(
        F.col("s.id").alias("doc_id"),
        F.col("s.leaf").alias("leaf"),
        "subroot",
        F.lit(root).alias("root"),
        digest(F.col("own.l"), F.col("own.r"), F.col("rest")).alias("proof_sha256"),
        F.aggregate("path", begin, lambda acc, e: digest(e["l"], acc, e["r"])).alias("folded_root"),
        F.col("s.p").alias("position"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).select(*[c.split()[0] for c in names.split(", ")])


def every_fifth(key: Column) -> Column:
    """True where 5 divides the unsigned crc32 of the id in decimal."""
    return F.crc32(key.cast("string")) % 5 == 0
