"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

A byte goes when a string of `depth` bytes that covers it also starts earlier (in a document with a smaller id, or
earlier in the same). The suffixes are sorted only as far as that depth, most significant digits first, and groups
that become single leave at once; what is equal at full depth are the repeated windows.

1. Equal texts are one: the first keeps its bytes, the others are repeats from end to end.
2. First digit. Of each window one gram of `GRAM` bytes is its digit: the one with the smallest hash, the first of
   these, grams that are frequent in a sample of the documents coming last. Equal windows have it at the same place, and
   neighbouring windows share it, so a document sends one row for some 40 bytes. A window that reaches beyond a frequent
   line has a rarer gram, so a frequent gram has only the windows inside such a line, which are few different ones. The
   sample decides how evenly windows are dealt, never what is found. Sums by gram (how often, and whether a piece of text
   holds it more than once) find those that occur again; they come back to the places as bits, so no gram's places
   gather.
3. The documents of the remaining grams meet their texts again and send, for each such gram, the bytes of the windows
   whose digit it is; of a frequent gram each piece sends equal windows once. These meet by gram, and windows are
   refined digit after digit of 8 bytes; the windows equal at full depth, but the first of each, are repeats. A gram
   with many windows is taken window place by window place, and in parts: what is different so far stays, the rest goes.
4. A document's repeats become maximal runs.

Texts are UTF-8 bytes. Comparison of windows is by bytes; only the first digit is a hash, of equal grams.

Defined results: null and empty texts have no bytes; very long texts are read whole, in pieces; rows that repeat an id
are ordered by a hash of their text, and by nothing if equal (all but one of them are repeats); a null id sorts first;
an empty table gives an empty result. Output columns are fixed, so other columns never clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import BASE, INVERSE, U64, let_go, maybe_in, meet_groups, mix, pieces, powers, prefix_hash, sifted, written

GRAM = 32
#: Bytes of text that are hashed at once, and windows that are sorted at once.
PIECE, WINDOWS = 1 << 20, 1 << 18
_POSITION = U64((1 << 24) - 1)
#: One document of so many is looked at for frequent grams; one with `OFTEN` places there is frequent. The most frequent
#: million at most: they are bits of a table of 2 MB.
SAMPLE, OFTEN, MOST_HOT, HOT_BITS = 100, 20, 1 << 20, 24


def gram_hashes(data: np.ndarray) -> np.ndarray:
    prefix = prefix_hash(data)
    return mix((prefix[GRAM:] - prefix[:-GRAM]) * powers(len(prefix), INVERSE)[: len(data) - GRAM + 1])


def is_hot(gram: np.ndarray, hot: np.ndarray) -> np.ndarray:
    place = gram >> U64(64 - HOT_BITS)
    return (hot[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & np.uint8(1) > 0


def anchors(data: np.ndarray, offs: np.ndarray, depth: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor (a gram that is the digit of some windows), by place: row, place of the gram, its hash, first
    and last start of its windows; places count from the row's begin. data: less than 16 MB."""
    span = depth - GRAM + 1  # grams of a window
    z = np.zeros(0, dtype=np.int64)
    if len(data) < depth:
        return z, z, z.view(U64), z, z
    n = len(data) - GRAM + 1
    hashes = gram_hashes(data)
    key = ((hashes >> U64(1)) & ~_POSITION) | np.arange(n, dtype=U64)
    if hot is not None:
        key |= is_hot(hashes, hot).astype(U64) << U64(63)
    # smallest key of each span by minima from both ends of blocks
    full = -(-n // span) * span
    padded = np.full(full, ~U64(0))
    padded[:n] = key
    blocks = padded.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - depth + 1
    best = np.minimum(right[:count], left[span - 1 : span - 1 + count]) & _POSITION
    row = np.searchsorted(offs, np.arange(count), side="right") - 1
    ok = np.arange(count) + depth <= offs[row + 1]
    start = np.flatnonzero(ok)
    best, row = best[start].astype(np.int64), row[start]
    if not len(start):
        return z, z, z.view(U64), z, z
    new = np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    r, a = row[first], best[first]
    return r, a - offs[r], hashes[a], start[first] - offs[r], start[last] - offs[r]


def long_pieces(batches: Iterator[pa.RecordBatch], text: str, depth: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Like pieces(), but rows longer than a piece come in several that overlap by depth - 1 bytes, so that each window
    is in one. The last array is what each row's places must be raised by."""
    for batch, data, offs in pieces(batches, text, PIECE):
        if len(data) <= 2 * PIECE:
            yield batch, data, offs, np.zeros(len(offs) - 1, dtype=np.int64)
        else:  # one row
            for a in range(0, len(data) - depth + 1, PIECE):
                part = data[a : a + PIECE + depth - 1]
                yield batch, part, np.array([0, len(part)]), np.array([a])


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy()


def _sample_grams(depth: int):
    """(gram, n) of all places, a row for each gram of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs, _ in long_pieces(batches, "text", depth):
            if len(data) < GRAM:
                continue
            place = np.arange(len(data) - GRAM + 1)
            inside = place + GRAM <= offs[np.searchsorted(offs, place, side="right")]
            gram, n = np.unique(gram_hashes(data)[inside], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


def frequent_grams(long: DataFrame, depth: int) -> np.ndarray | None:
    """Bits of the grams that are frequent in the sample; None if there are none."""
    some = long.where(F.pmod(F.xxhash64("doc", "m"), F.lit(SAMPLE)) == 0).select("text")
    return hot_bits(some.mapInArrow(_sample_grams(depth), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))


def hot_bits(counts: DataFrame) -> np.ndarray | None:
    """Bits of the grams (gram, n) that a sample holds often enough; None if there are none."""
    counts = written(counts.where(F.col("n") >= OFTEN), "frequent")
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).count().orderBy(F.desc("level")).collect()  # a row a power of two
    least, held = None, 0
    for r in levels:
        held += r["count"]
        if held > MOST_HOT:
            break
        least = 1 << r["level"]
    if least is None:
        return None
    place = F.shiftrightunsigned("gram", 64 - HOT_BITS) + 1
    rows = counts.where(F.col("n") >= least).select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).collect()
    hot = np.zeros(1 << (HOT_BITS - 3), dtype=np.uint8)
    for r in rows:  # 512 rows of 4 KB at most
        bits = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        hot[(r["b"] - 1) * 4096 : r["b"] * 4096] = bits
    return hot


def _send_grams(depth: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs, up in long_pieces(batches, "text", depth):
            row, place, gram, _, _ = anchors(data, offs, depth, hot.value)
            if not len(row):
                continue
            place, doc = place + up[row], _numbers(batch, "doc")[row]
            order = np.argsort(gram, kind="stable")
            place, doc, gram = place[order], doc[order], gram[order]
            new = np.concatenate([[True], gram[1:] != gram[:-1]])
            size = np.diff(np.append(np.flatnonzero(new), len(gram)))
            again = np.repeat(size > 1, size)
            # a gram met again in this piece is repeated for certain: its places are dealt by themselves, not by the
            # gram, and the gram is told once
            own = np.where(again, mix(doc.view(U64) * U64(BASE) + place.view(U64)), gram)
            mark = new & again
            token = np.concatenate([own, gram[mark]]).view(np.int64)
            kind = np.concatenate([again.astype(np.int8), np.full(int(mark.sum()), 2, dtype=np.int8)])
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.concatenate([doc, doc[mark]])), pa.array(np.concatenate([place, place[mark]])), pa.array(kind)], names=["gram", "doc", "place", "kind"])

    return run


COLUMNS = ["gram", "doc", "m", "start", "skip", "bytes"]


def _rows(gram, doc, m, start, skip, blob) -> pa.RecordBatch:
    cols = [pa.array(gram), pa.array(doc), pa.array(m), pa.array(start), pa.array(skip.astype(np.int32)), pa.array(blob, pa.binary())]
    return pa.RecordBatch.from_arrays(cols, names=COLUMNS)


def _send_windows(depth: int, hot):
    """Rows of windows; and, with null bytes, runs from start to start + skip that are repeats for certain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs, up in long_pieces(batches, "text", depth):
            row, place, gram, lo, hi = anchors(data, offs, depth, hot.value)
            if not len(row):
                continue
            lists = batch.column(batch.schema.get_field_index("places"))
            flat, edge = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            wanted = np.zeros(len(data) + 1, dtype=bool)
            for i in range(batch.num_rows):
                w = flat[edge[i] : edge[i + 1]] - up[i] + offs[i]
                wanted[w[(w >= offs[i]) & (w < offs[i + 1])]] = True
            keep = wanted[place + offs[row]]
            row, place, gram, lo, hi = (x[keep] for x in (row, place, gram, lo, hi))
            raw = data.tobytes()
            begin, end = lo + offs[row], hi + offs[row] + depth
            doc, m = _numbers(batch, "doc")[row], _numbers(batch, "m")[row]
            blob = np.array([raw[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)] + [None], dtype=object)[:-1]
            cold = np.ones(len(row), dtype=bool) if hot.value is None else ~is_hot(gram, hot.value)
            columns = (gram.view(np.int64), doc, m, lo + up[row], place - lo, blob)
            if cold.any():
                yield _rows(*(x[cold] for x in columns))
            if not cold.all():
                order = np.flatnonzero(~cold)
                order = order[np.lexsort((columns[3][order], m[order], doc[order], columns[0][order]))]
                runs, rest = _resolve(pa.Table.from_batches([_rows(*(x[order] for x in columns))]), depth, keep=True)
                yield from rest
                d, n, a, b = (c.to_numpy() for c in runs.columns)
                if len(d):
                    spread = mix(d.view(U64) * U64(BASE) + a.view(U64)).view(np.int64)
                    yield _rows(spread, d, n, a, b - a, [None] * len(d))

    return run


def radix_repeats(digits, group: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Marks the windows that equal one earlier in `order` within their group. digits(d, which): the 8 bytes (as a
    number) from byte 8 d of the windows `which`. Each pass splits groups by one digit; singles leave."""
    mark = np.zeros(len(group), dtype=bool)
    which = np.arange(len(group))
    for d in range(-(-depth // 8)):
        value = digits(d, which)
        by = np.lexsort((value, group))
        which, group, value = which[by], group[by], value[by]
        new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
        group = np.cumsum(new)
        size = np.bincount(group)
        many = size[group] > 1
        which, group = which[many], group[many]
        if not len(which):
            return mark
    by = np.lexsort((order[which], group))
    which, group = which[by], group[by]
    mark[which[1:][group[1:] == group[:-1]]] = True
    return mark


def _resolve(table: pa.Table, depth: int, keep: bool = False) -> tuple[pa.RecordBatch, list[pa.RecordBatch]]:
    """Runs (doc, m, a, b) of repeated bytes from whole grams' rows, sorted by gram, doc, m and start; and with keep the
    rows of the windows that are no repeats, in the same order."""
    gram, doc, m, start, skip = (table.column(c).to_numpy() for c in COLUMNS[:-1])
    column = table.column("bytes").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    edge = np.frombuffer(column.buffers()[1], dtype=np.int32, count=len(column) + 1 + column.offset)[column.offset :].astype(np.int64)
    blob = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    begin, length = edge[:-1], np.diff(edge)
    # rows with the same bytes and place are equal window by window: all but the first are repeats from end to end
    code = column.dictionary_encode().indices.to_numpy().astype(np.int64) * (4 * depth) + skip
    _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
    twin = first[inverse] != np.arange(len(code))
    out = [(doc[twin], m[twin], start[twin], start[twin] + length[twin])]
    mine = np.flatnonzero(~twin)
    begin, length = begin[mine], length[mine]
    count = length - depth + 1
    total = int(count.sum())
    own = np.repeat(np.arange(len(mine)), count)
    inner = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    g = gram[mine]
    number = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]])) if len(g) else np.zeros(0, dtype=np.int64)
    shared = np.bincount(number)[number] > 1 if len(g) else np.zeros(0, dtype=bool)
    rel = inner - skip[mine][own]  # the window's begin, seen from the gram: equal windows agree
    gid = number[own] * np.int64(4 * depth) + (rel + depth)
    mark, tail = np.zeros(total, dtype=bool), depth % 8
    padded = np.concatenate([blob, np.zeros(8, dtype=np.uint8)])
    word = np.ndarray((len(blob),), dtype=">u8", buffer=padded, strides=(1,))  # at each byte the 8 from there
    asked = np.flatnonzero(shared[own]) if total else np.zeros(0, dtype=np.int64)
    # a gram with very many windows is taken place by place: windows at different places are never equal
    parts = [asked] if len(asked) <= 4 * WINDOWS else [asked[rel[asked] == r] for r in np.unique(rel[asked])]
    for part in parts:
        place = begin[own[part]] + inner[part]

        def digits(d, which, place=place):
            v = word[place[which] + 8 * d].astype(U64)
            return v >> U64(8 * (8 - tail)) if tail and d == depth // 8 else v

        if len(part):
            mark[part] = radix_repeats(digits, gid[part], part, depth)
    # a row's windows follow each other, so marked neighbours are one run
    a, b = _stretches(mark, own)
    at = mine[own[a]]
    out.append((doc[at], m[at], start[at] + inner[a], start[at] + inner[b] + depth))
    runs = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["doc", "m", "a", "b"])
    if not keep:
        return runs, []
    a, b = _stretches(~mark, own)
    at, raw = mine[own[a]], blob.tobytes()
    lo, hi = begin[own[a]] + inner[a], begin[own[a]] + inner[b] + depth
    return runs, [_rows(gram[at], doc[at], m[at], start[at] + inner[a], skip[at] - inner[a], [raw[x:y] for x, y in zip(lo.tolist(), hi.tolist(), strict=True)])]


def _stretches(mark: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each stretch of marks within one owner."""
    if not len(mark):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    other = own[1:] != own[:-1]
    edge = np.concatenate([[True], other | ~mark[:-1]]) & mark
    stop = np.concatenate([other | ~mark[1:], [True]]) & mark
    return np.flatnonzero(edge), np.flatnonzero(stop)


def _compare(depth: int):
    most = WINDOWS // 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        limit = most
        for batch in batches:
            known = batch.filter(batch.column(5).is_null())
            if known.num_rows:
                a = known.column(3).to_numpy()
                yield pa.RecordBatch.from_arrays([known.column(1), known.column(2), pa.array(a), pa.array(a + known.column(4).to_numpy())], names=["doc", "m", "a", "b"])
                batch = batch.filter(batch.column(5).is_valid())
            held.append(batch)
            if sum(b.num_rows for b in held) < limit:
                continue
            table = pa.Table.from_batches(held)
            gram = table.column("gram").to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            a, cut = 0, int(edges[-1])
            while a < cut:  # chunks of whole grams; the last gram may go on in the next batch
                z = int(edges[min(int(np.searchsorted(edges, a + most)), len(edges) - 1)])
                yield _resolve(table.slice(a, z - a), depth)[0]
                a = z
            held, limit = table.slice(cut).to_batches(), most
            if table.num_rows - cut >= most:  # one gram: what equals an earlier window goes now
                runs, held = _resolve(table.slice(cut), depth, keep=True)
                yield runs
                limit = max(most, 2 * sum(b.num_rows for b in held))
        if sum(b.num_rows for b in held):
            yield _resolve(pa.Table.from_batches(held), depth)[0]

    return run


def merged(a, b) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the intervals [a, b); intervals that touch are one run."""
    a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    return a[new], b[np.append(np.flatnonzero(new)[1:], len(a)) - 1]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of texts without their runs."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("n_removed", "n_spans", "spans", "kept")}
        for text, runs in zip(batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist(), batch.column(batch.schema.get_field_index("runs")).to_pylist(), strict=True):
            a, b = merged([r["a"] for r in runs], [r["b"] for r in runs])
            ends = np.concatenate([[0], b]).tolist(), np.concatenate([a, [len(text)]]).tolist()
            out["kept"].append(b"".join(text[x:y] for x, y in zip(*ends, strict=True)))
            out["n_removed"].append(int((b - a).sum()))
            out["n_spans"].append(len(a))
            out["spans"].append([{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)])
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("doc", "m")] + [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=["doc", "m", *out])


NO_ID = -(1 << 63)
SPANS = "array<struct<a:bigint,b:bigint>>"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, m, text): the id (null: the smallest), a hash of the text, the text (null: empty)."""
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.select("doc", F.xxhash64("text").alias("m"), "text")


def find_repeats(rows: DataFrame, signed: DataFrame, depth: int) -> DataFrame:
    """(doc, m, runs array<struct<a,b>>) of the texts of keyed() that are not repeats from end to end and hold
    repeats. signed: (doc, m, n, first boolean), a row a text."""
    long = rows.where(F.octet_length("text") >= depth)
    hot = rows.sparkSession.sparkContext.broadcast(frequent_grams(long, depth))
    # told twice, as writing it would take more room than the second reading takes time
    sent = long.select("doc", "text").mapInArrow(_send_grams(depth, hot), "gram long, doc long, place long, kind byte")
    # a mark (kind 2) counts as two
    shared = sent.where("kind <> 1").groupBy("gram").agg(F.sum(F.when(F.col("kind") == 2, 2).otherwise(1)).alias("c")).where("c > 1").select("gram")
    shared = written(shared, "shared")
    let_go(rows.sparkSession)
    told = sifted(sent.where("kind < 2"), "gram", shared, always="kind = 1")
    places = told.groupBy("doc").agg(F.collect_set("place").alias("places"))
    places = written(places.join(signed.where("first").select("doc").distinct(), "doc", "left_semi"), "places")
    let_go(rows.sparkSession)
    texts = maybe_in(long, "doc", places.select("doc"), "doc").join(places, "doc").join(signed.where("first").select("doc", "m"), ["doc", "m"])
    windows = texts.select("doc", "m", "text", "places").mapInArrow(_send_windows(depth, hot), "gram long, doc long, m long, start long, skip int, bytes binary")
    dealt = windows.repartition("gram").sortWithinPartitions("gram", "doc", "m", "start")
    return dealt.mapInArrow(_compare(depth), "doc long, m long, a long, b long").groupBy("doc", "m").agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def sign_texts(rows: DataFrame, depth: int) -> DataFrame:
    """(doc, m, n, copies, sha256, first): a row for each id and text. first: no equal text comes earlier, or it is
    shorter than depth."""
    signed = rows.groupBy("doc", "m").agg(F.count("*").alias("copies"), F.min(F.octet_length("text")).cast("long").alias("n"), F.min(F.sha2("text", 256)).alias("sha256"))
    signed = written(signed, "texts")
    first = written(signed.groupBy("sha256").agg(F.min("doc").alias("_f"), F.count("*").alias("_c")), "firsts")
    return written(meet_groups(signed, first, "sha256", "_c").withColumn("first", (F.col("n") < depth) | (F.col("doc") == F.col("_f"))).drop("_f"), "signed")


def cut_texts(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc, m, n_removed, n_spans, spans, kept) of the texts that hold runs. Only these texts are shuffled."""
    some = maybe_in(rows, "doc", runs.select("doc"), "doc").join(runs, ["doc", "m"]).dropDuplicates(["doc", "m"])
    return some.select("doc", "m", "text", "runs").mapInArrow(_cut, f"doc long, m long, n_removed long, n_spans long, spans {SPANS}, kept binary")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", depth: int = 100, digest: bool = False) -> DataFrame:
    """(doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<a,b>>, kept binary), a row for each
    row of docs; with digest kept_sha256 (lowercase hex of kept) instead of kept, which leaves unchanged texts unread."""
    if depth < 2 * GRAM:
        raise ValueError(f"depth is {2 * GRAM} at least")
    rows = keyed(docs, doc_id, text)
    signed = sign_texts(rows, depth)
    cut = cut_texts(rows, written(find_repeats(rows, signed, depth), "runs"))
    if digest:
        cut = written(cut.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept"), "cut")
        kept, same, none = "kept_sha256", F.col("sha256"), F.lit(hashlib.sha256(b"").hexdigest())
    else:
        signed = signed.join(rows.dropDuplicates(["doc", "m"]).withColumn("_bytes", F.col("text").cast("binary")).drop("text"), ["doc", "m"])
        kept, same, none = "kept", F.col("_bytes"), F.lit(b"")
    out = signed.join(cut, ["doc", "m"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    whole = (F.col("n") >= depth) & (~F.col("first") | (F.col("_copy") > 1))
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    return out.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, all_of).otherwise(F.coalesce("spans", F.array().cast(SPANS))).alias("spans"),
        F.when(whole, none).otherwise(F.coalesce(kept, same)).alias(kept),
    )
