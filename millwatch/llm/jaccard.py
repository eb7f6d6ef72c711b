"""N-gram Jaccard join by T-occurrence search.

A document's set holds its distinct k-word shingles; documents link when their Jaccard similarity reaches the
threshold. The join finds, for each document, those that share enough of its shingles:

1. Screening. In one global order of shingles (by hash), documents that link share several of the first few. Each
   document sends these, sums by shingle find the shared ones, which come back as bits, and documents with too few are
   done. A shingle that one task meets in several documents is sent once, and no shingle's documents gather.
2. Order by frequency. The remaining sets (equal ones once) are counted by shingle. A document's rarest
   |set| - T + 1 shingles, T being the least overlap of a link, must hold a shared one; documents whose rarest are
   their own are done. Star edges over the shared ones give cells: every link lies in one cell.
3. T-occurrence search in each cell with DivideSkip: a document's inverted lists are split into long and short ones,
   the short ones are merged and counted, and what reaches T minus the number of long lists is probed in the long ones
   by binary search. A document already connected to a candidate isn't probed against it again, as only components
   are returned. A cell with many shingles is cut into blocks. First all of its documents are compared with some
   `PIVOTS` of them, block by block, which joins most of a class of near copies in one pass; then the components so far
   are cut into blocks, and pairs of blocks that aren't of one component go to separate tasks, each of which returns a
   spanning forest of its links.
4. Components of the forests.

Nothing is capped: all documents that can link reach step 3, and step 3 is exact (to collisions of 64-bit hashes).

Defined results: null or empty texts have no shingles and link with nothing; very long texts are read whole; rows that repeat an id are one document,
returned once, with the size of its largest set and the links of its text with most words; a row without an id is returned with its size and null component;
an empty table gives an empty result. Output columns are fixed, so other columns never clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millwatch.llm.common import U64, bitmap, components, flagged, maybe_in, meet_groups, mix, pieces, shingles, sifted, word_count, written

#: Shingles of a block of a cell: about 500 KB of hashes.
BLOCK = 1 << 16
#: Documents of a large cell that all of its documents are compared with first, about.
PIVOTS = 16
#: Large cells, or their blocks, that are broadcast; more meet their documents by size.
FEW = 1 << 16
#: Shingles in more documents than this may gather: their documents are dealt over SALT tasks.
COMMON, SALT = 1 << 14, 64
#: Share of a set that screening asks for beyond one shared shingle.
EXTRA = 0.1
MU = 0.0085


def least(n, percent: int):
    """Least overlap of a set of n with any set it links with."""
    return (percent * n + 99) // 100


def _extra(n):
    return np.maximum(1, np.ceil(EXTRA * n)).astype(np.int64)


def _signature(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, whatever the order."""
    one, two, some = np.zeros(len(n), dtype=U64), np.zeros(len(n), dtype=U64), np.flatnonzero(n)
    if len(some):
        at = (np.cumsum(n) - n)[some]
        one[some] = np.add.reduceat(mix(h), at)
        two[some] = np.add.reduceat(mix(h ^ U64(0x5851F42D4C957F2D)), at)
    return one, two


def _screen(k: int, percent: int):
    """Rows (token, doc, c, kind, v). Kind 0: a shingle that one document of a piece has; 1: one that several have; 2:
    a document's shared shingles within its piece, and its set's size; 3, 4: its set's signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches, "text"):
            ids = batch.column(0).to_numpy()
            row, h = shingles(data, offs, k)
            n = np.bincount(row, minlength=len(ids)).astype(np.int64)
            one, two = _signature(h, n)
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            keep = np.arange(len(row)) - first[row] < (n - least(n, percent) + _extra(n))[row]
            row, h = row[keep], h[keep]
            order = np.argsort(h, kind="stable")
            row, h = row[order], h[order]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, dtype=np.int64)
            size = np.diff(np.append(start, len(h)))
            lo, hi = (f.reduceat(ids[row], start) if len(start) else ids[:0] for f in (np.minimum, np.maximum))
            met = np.repeat(lo < hi, size)  # shared within this piece: known here, and told once for other pieces
            known = np.bincount(row[met], minlength=len(ids))
            solo, many = start[lo == hi], start[lo < hi]
            own = mix(ids.astype(np.int64).view(U64))
            token = np.concatenate([h[solo], h[many], own, own, own]).view(np.int64)
            doc = np.concatenate([ids[row[solo]], ids[row[many]], ids, ids, ids])
            sent, each = len(solo) + len(many), len(ids)
            count = np.concatenate([np.zeros(sent, dtype=np.int32), known.astype(np.int32), np.zeros(2 * each, dtype=np.int32)])
            kind = np.repeat(np.arange(5, dtype=np.int8), [len(solo), len(many), each, each, each])
            value = np.concatenate([np.zeros(sent, dtype=np.int64), n, one.view(np.int64), two.view(np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, doc, count, kind, value)], names=["token", "doc", "c", "kind", "v"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in pieces(batches, "text"):
            row, h = shingles(data, offs, k)
            n = np.bincount(row, minlength=batch.num_rows)
            at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), lists], names=["doc", "n", "tokens"])

    return run


class _Groups:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def t_occurrence(sets: list[np.ndarray], ask: list[int], among: list[int], percent: int) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of positions in `sets`, of the links of `ask` with `among` (sorted hash arrays)."""
    docs = np.repeat(np.array(among), [len(sets[i]) for i in among])
    tokens = np.concatenate([sets[i] for i in among]) if among else np.zeros(0, dtype=np.int64)
    order = np.lexsort((docs, tokens))
    tokens, docs = tokens[order], docs[order]
    keys, start = np.unique(tokens, return_index=True)
    size = np.diff(np.append(start, len(tokens)))
    longest = int(size.max()) if len(size) else 0
    groups, forest, same = _Groups(len(sets)), [], set(ask) == set(among)
    for q in ask:
        mine = sets[q]
        need = least(len(mine), percent)
        at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
        at = at[keys[at] == mine] if len(keys) else at[:0]
        if len(at) < need:
            continue
        at = at[np.argsort(size[at], kind="stable")]
        skip = min(need - 1, int(need / (MU * math.log2(max(longest, 2)) + 1)))  # long lists
        short, long = at[: len(at) - skip], at[len(at) - skip :]
        runs = np.concatenate([docs[start[i] : start[i] + size[i]] for i in short])
        found, count = np.unique(runs, return_counts=True)
        ok = count >= need - skip
        for d, c in zip(found[ok].tolist(), count[ok].tolist(), strict=True):
            if d == q or same and d > q or groups.find(d) == groups.find(q):
                continue
            if min(len(mine), len(sets[d])) * 100 < percent * max(len(mine), len(sets[d])):
                continue
            other, want = sets[d], keys[long]
            where = np.minimum(np.searchsorted(other, want), len(other) - 1)
            overlap = c + int((other[where] == want).sum())
            if 100 * overlap >= percent * (len(mine) + len(other) - overlap) and groups.join(q, d):
                forest.append((q, d))
    return forest


def _linked(g: pd.DataFrame, pivots: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links of a block's documents with the cell's pivots."""
    got = []
    if len(g) and len(pivots):
        sets = [np.sort(t) for t in pivots["tokens"]] + [np.sort(t) for t in g["tokens"]]
        ids = np.concatenate([pivots["rep"].to_numpy(), g["rep"].to_numpy()])
        k = len(pivots)
        got = [(ids[a], ids[b]) for a, b in t_occurrence(sets, list(range(k, len(sets))), list(range(k)), percent) if ids[a] != ids[b]]
    return pd.DataFrame(got, columns=["a", "b"]).astype("int64")


def _forest(g: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links found in one task: within its small cells, or between the two blocks of a large one."""
    got = []
    for _, cell in g.groupby("cell"):
        cell = cell.sort_values("rep")
        sets, ids = [np.sort(t) for t in cell["tokens"]], cell["rep"].to_numpy()
        x, y, block = cell["x"].iloc[0], cell["y"].iloc[0], cell["block"].to_numpy()
        if x == y:
            ask = among = list(range(len(ids)))
        else:
            ask, among = np.flatnonzero(block == x).tolist(), np.flatnonzero(block != x).tolist()
        got += [(ids[a], ids[b]) for a, b in t_occurrence(sets, ask, among, percent)]
    return pd.DataFrame(got, columns=["a", "b"]).astype("int64")


def search_cells(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what links connect in each cell. members: (cell, rep, tokens, n)."""
    sizes = written(members.groupBy("cell").agg(F.sum("n").alias("w"), F.count("*").alias("many")), "sizes")
    total = sizes.where(F.col("w") <= BLOCK).agg(F.sum("w")).first()[0] or 0
    tasks = max(64, 2 * int(total) // BLOCK)
    big = written(sizes.where(F.col("w") > BLOCK).select("cell", "w", F.col("many").alias("_many"), "many"), "big")
    many = big.count()
    if many <= FEW:
        sized = members.join(F.broadcast(big.drop("many")), "cell", "left")
    else:
        sized = meet_groups(members.withColumn("_k", F.col("cell").cast("string")), big.select(F.col("cell").cast("string").alias("_k"), "w", "_many", "many"), "_k", "many")
    whole = sized.where("w is null").select(F.pmod(F.xxhash64("cell"), F.lit(tasks)).alias("task"), "cell", "rep", "tokens", F.lit(0).alias("block"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    found = whole.groupBy("task").applyInPandas(lambda g: _forest(g, percent), "a long, b long")
    if not many:
        return found
    # large cells: pivots first
    large = written(sized.where("w is not null").withColumn("block", F.pmod(F.xxhash64("rep"), F.ceil(F.col("w") / BLOCK)).cast("int")), "large")
    chosen = F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(1 << 30)) < F.lit(float(PIVOTS << 30)) / F.col("_many")
    pivots = large.where(chosen).withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("w") / BLOCK).cast("int") - 1))).select("cell", "block", "rep", "tokens")
    blocks = large.select("cell", "block", "rep", "tokens").groupBy("cell", "block")
    first = written(blocks.cogroup(pivots.groupBy("cell", "block")).applyInPandas(lambda g, p: _linked(g, p, percent), "a long, b long"), "pivoted")
    roots = components(first)
    large = large.drop("block").join(roots, F.col("rep") == F.col("node"), "left").select("cell", "rep", "tokens", "n", "w", F.coalesce("root", "rep").alias("part"))
    # large components have blocks of their own, the others share the cell's
    parts = large.groupBy("cell", "part").agg(F.sum("n").alias("v"), F.max("w").alias("w")).where(F.col("v") > BLOCK / 2)
    parts = parts.select("cell", "part", F.ceil(F.col("v") / BLOCK).cast("int").alias("_blocks"))
    large = large.join(F.broadcast(parts) if parts.limit(FEW + 1).count() <= FEW else parts, ["cell", "part"], "left")
    own = F.col("_blocks").isNotNull()
    number = F.when(own, F.pmod(F.xxhash64("rep"), F.col("_blocks"))).otherwise(F.pmod(F.xxhash64("part"), F.ceil(F.col("w") / BLOCK))).cast("int")
    large = written(large.select("cell", "rep", "tokens", F.struct(F.when(own, F.col("part")).alias("part"), number.alias("number")).alias("name")), "blocks")
    blocks = written(large.groupBy("cell", "name").agg(F.count("*").alias("many")), "names")
    names = blocks.groupBy("cell").agg(F.sort_array(F.collect_list("name")).alias("names"), F.sum("many").alias("many"))
    if blocks.count() <= FEW:
        placed = large.join(F.broadcast(names.drop("many")), "cell")
    else:
        placed = meet_groups(large.withColumn("_k", F.col("cell").cast("string")), names.select(F.col("cell").cast("string").alias("_k"), "names", "many"), "_k", "many")
    placed = placed.withColumn("block", F.array_position("names", F.col("name")).cast("int") - 1)
    others = F.filter(F.transform("names", lambda name, i: F.struct(i.alias("i"), (name["part"].isNull() | ~name["part"].eqNullSafe(F.col("name.part"))).alias("other"))), lambda z: z["other"])
    pairs = placed.select("cell", "rep", "tokens", "block", F.explode(others).alias("o")).select("cell", "rep", "tokens", "block", F.least("block", "o.i").alias("x"), F.greatest("block", "o.i").alias("y"))
    rest = pairs.groupBy("cell", "x", "y").applyInPandas(lambda g: _forest(g, percent), "a long, b long")
    return found.unionByName(first).unionByName(rest)


def link_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long), one row a document; component_id is the smallest doc_id
    that links reach."""
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    named = slim.where("doc is not null")
    # 1: how many of each document's first shingles others have, less how many it needs
    sent = written(named.mapInArrow(_screen(words, percent), "token long, doc long, c int, kind byte, v long"), "sent")
    # two figures a shingle, summed where rows are read; the shared ones come back as bits
    shared = sent.where("kind < 2").groupBy("token").agg(F.min("doc").alias("a"), F.max("doc").alias("b"), F.max("kind").alias("k")).where("a < b or k = 1")
    told = sifted(sent.where("kind <> 1"), "token", written(shared.select("token"), "shared"), always="kind >= 2")
    of = lambda k: F.max(F.when(F.col("kind") == k, F.col("v")))
    seen = told.groupBy("doc").agg(F.sum(F.when(F.col("kind") == 0, 1).otherwise(F.col("c"))).alias("c"), of(2).alias("n"), of(3).alias("s1"), of(4).alias("s2"))
    seen = written(seen, "screened")
    ask = F.greatest(F.lit(1), F.ceil(EXTRA * F.floor((F.lit(percent) * F.col("n") + 99) / 100)))
    left = seen.where((F.col("c") >= ask) & (F.col("n") > 0)).select("doc", F.concat_ws(":", "n", "s1", "s2").alias("sign"))
    # 2: one of each group of equal sets
    sign = written(left.groupBy("sign").agg(F.min("doc").alias("rep"), F.count("*").alias("many")), "signs")
    reps = sign.select(F.col("rep").alias("doc")).distinct()
    texts = maybe_in(named, "doc", reps, "doc").join(reps, "doc").groupBy("doc").agg(F.max_by("text", F.struct(word_count(F.col("text")), F.col("text"))).alias("text"))
    texts = written(texts, "texts")
    sets = texts.mapInArrow(_sets(words), "doc long, n long, tokens array<long>").where("n > 0")
    posts = sets.select(F.col("doc").alias("rep"), "n", F.explode("tokens").alias("token"))
    counts = written(posts.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "counts")
    # documents of a common shingle are dealt over several tasks, to each of which its count goes
    common = bitmap(counts.where(F.col("df") > COMMON), "token")
    salted = lambda d, salt: flagged(d, "token", common, "_common").withColumn("_salt", F.when(F.col("_common"), salt).otherwise(F.lit(0)).cast("int")).drop("_common")
    told = flagged(counts, "token", common, "_common").select("token", "df", F.explode(F.sequence(F.lit(0), F.when(F.col("_common"), SALT - 1).otherwise(0))).alias("_salt"))
    posts = salted(posts, F.pmod(F.xxhash64("rep"), F.lit(SALT))).join(told, ["token", "_salt"]).select("rep", "n", "token", "df")
    need = F.floor((F.lit(percent) * F.col("n") + 99) / 100)
    rank = W.partitionBy("rep").orderBy("df", "token")
    posts = posts.withColumns({"_k": F.row_number().over(rank), "_m": F.count("*").over(W.partitionBy("rep"))})
    # the document's own shingles, n - _m of them, come first
    early = posts.where((F.col("n") - F.col("_m")) + F.col("_k") <= F.col("n") - need + 1).select("rep", "token")
    early = written(early, "prefixes")
    hubs = written(early.groupBy("token").agg(F.min("rep").alias("hub"), F.count("*").alias("many")).where("many > 1").withColumn("key", F.col("token").cast("string")), "hubs")
    near = meet_groups(early.select("rep", F.col("token").cast("string").alias("key")), hubs.select("key", "hub", "many"), "key", "many")
    cells = written(components(near.select(F.col("rep").alias("a"), F.col("hub").alias("b")).where("a <> b")), "cells")
    # 3: the sets of each cell
    some = texts.join(cells, F.col("doc") == F.col("node")).select("root", "doc", "text")
    some = some.select(F.struct("root", "doc").alias("_key"), "text").mapInArrow(_sets(words), "doc struct<root:bigint,doc:bigint>, n long, tokens array<long>")
    members = written(some.select(F.col("doc.root").alias("cell"), F.col("doc.doc").alias("rep"), "tokens", "n"), "members")
    # 4
    roots = components(search_cells(members, percent))
    classes = written(sign.join(roots, F.col("rep") == F.col("node"), "left").select("sign", F.coalesce("root", "rep").alias("root"), "many"), "classes")
    member = meet_groups(left, classes, "sign", "many").select("doc", "root")
    out = seen.join(member, "doc", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
    nameless = slim.where("doc is null").select(F.lit(0).cast("long").alias("doc"), "text").mapInArrow(_sets(words), "doc long, n long, tokens array<long>")
    return out.unionByName(nameless.select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
