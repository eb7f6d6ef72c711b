"""Removal of passages that other documents hold, found by automata of their phrases.

A word goes when a window of `window` consecutive words that covers it also starts in a document with a smaller id.

1. Equal word sequences are one: the smallest id keeps its words, others of `window` words or more go whole.
2. Anchors. Each window has one gram of `GRAM` words: the one with the smallest hash, grams that are frequent in a sample
   coming last. Equal windows have it at the same place and neighbouring windows share it, so a text sends one row for
   some 15 words: the gram, a hash of the words that its windows cover, and where they are. Sums by gram (smallest and
   largest id) say which grams several documents hold; sums by gram and hash leave each different stretch once.
3. Confirmation. The first holders of these stretches send a hash of each window; sums by it (smallest id, and whether a
   larger one has it) leave the windows that recur, each with the first document that holds it.
4. Phrases. A first document's recurring windows make a passage for each `BUCKET` places; its grams there are phrases.
5. Automata. Documents are dealt to shards of some 4 MB of text by a hash of their id, and each passage goes to the shards
   where a document with a larger id has one of its grams. A shard compiles an Aho-Corasick automaton of the phrases, as
   sequences of word numbers, and streams its documents through it: every occurrence of a phrase is extended word by
   word along the passage, and `window` equal words or more are removed. Words are compared as text here, so a
   collision of hashes costs work and changes nothing.
6. A document's removed words become maximal runs.

All tables between are keyed by hashes or ids, and aggregations keep two figures a key, so neither a gram, a window nor a
passage that many documents share gathers anywhere: a frequent phrase is one row a shard. Automata are bounded by their
shard's text. Lost tasks are run again from shuffles or written tables.

Defined results: null text has no words; documents with fewer words than a window lose none; a null id is smaller than
all others; rows with the same id don't remove each other's words, and repeats within one document stay; equal rows give
equal rows; texts longer than a piece are cut at words, with overlap, wherever they are hashed; an empty table gives an
empty result. Output columns are fixed, so other columns never clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import U64, bitmap, flagged, maybe_in, pieces, prefix_hash, powers, span_hash, words, written
from millwatch.llm.repeats import NO_ID, SAMPLE, SPANS, hot_bits, is_hot, merged

GRAM = 20
#: Bytes of text that are hashed at once; words of a part of a longer text; places whose windows make one passage.
PIECE, PART, BUCKET = 1 << 20, 1 << 17, 256
#: Bytes of text of a shard, and shards at least.
SHARD_BYTES, SHARDS = 1 << 22, 256
_POSITION = U64((1 << 24) - 1)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_pieces(batches: Iterator[pa.RecordBatch], text: str, window: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, bytes, starts, ends and row of each word, first word of each row, what a row's places must be raised by); a
    text longer than two pieces comes in parts that overlap by window - 1 words."""
    for batch, data, offs in pieces(batches, text, PIECE):
        starts, ends, row = words(data, offs)
        if len(data) <= 2 * PIECE:
            yield batch, data, starts, ends, row, np.searchsorted(row, np.arange(batch.num_rows)), np.zeros(batch.num_rows, dtype=np.int64)
            continue
        for a in range(0, max(1, len(starts) - window + 1), PART):  # one row
            z = min(len(starts), a + PART + window - 1)
            if z > a:
                yield batch, data[starts[a] : ends[z - 1]], starts[a:z] - starts[a], ends[a:z] - starts[a], row[a:z], np.zeros(1, dtype=np.int64), np.array([a])


def sequence_prefix(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """P with span_hash(P, i, j) the hash of words i to j - 1."""
    out = np.zeros(len(starts) + 1, dtype=U64)
    np.cumsum(span_hash(prefix_hash(data), starts, ends) * powers(len(starts)), out=out[1:])
    return out


def anchors(prefix: np.ndarray, row: np.ndarray, window: int, hot: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the gram, its hash, first and last start of its windows) of each anchor, by place."""
    z = np.zeros(0, dtype=np.int64)
    many = len(row) - window + 1
    if many <= 0:
        return z, z.view(U64), z, z
    span, n = window - GRAM + 1, len(row) - GRAM + 1
    at = np.arange(n)
    hashes = span_hash(prefix, at, at + GRAM)
    key = ((hashes >> U64(1)) & ~_POSITION) | at.astype(U64)
    if hot is not None:
        key |= is_hot(hashes, hot).astype(U64) << U64(63)
    # the smallest key of each span of grams, by minima from both ends of blocks
    padded = np.full(-(-n // span) * span, ~U64(0))
    padded[:n] = key
    blocks = padded.reshape(-1, span)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = (np.minimum(right[:many], left[span - 1 : span - 1 + many]) & _POSITION).astype(np.int64)
    start = np.flatnonzero(row[:many] == row[window - 1 :])
    if not len(start):
        return z, z.view(U64), z, z
    best = best[start]
    first = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[start[1:]] != row[start[:-1]])]))
    last = np.append(first[1:], len(start)) - 1
    return best[first], hashes[best[first]], start[first], start[last]


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _column(batch, name).to_numpy()


def _sample(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, starts, ends, row, _, _ in word_pieces(batches, "text", window):
            place = np.flatnonzero(row[: len(row) - GRAM + 1] == row[GRAM - 1 :]) if len(row) >= GRAM else []
            if len(place):
                gram, n = np.unique(span_hash(sequence_prefix(data, starts, ends), place, place + GRAM), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return run


ANCHORS = "gram long, h long, doc long, m long, lo long, hi long, at long"


def _send_anchors(window: int, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts, ends, row, first, up in word_pieces(batches, "text", window):
            prefix = sequence_prefix(data, starts, ends)
            at, gram, lo, hi = anchors(prefix, row, window, hot.value)
            if not len(at):
                continue
            h = span_hash(prefix, lo, hi + window) + (at - lo).astype(U64)
            r = row[at]
            less = first[r] - up[r]
            cols = [gram.view(np.int64), h.view(np.int64), _longs(batch, "doc")[r], _longs(batch, "m")[r], lo - less, hi - less, at - less]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[c.split()[0] for c in ANCHORS.split(", ")])

    return run


def _runs_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict]:
    """(row, fields) of the structs in a list column; fields are numpy arrays, lists stay Arrow's."""
    lists = _column(batch, name)
    flat = lists.flatten()
    fields = zip((f.name for f in flat.type), flat.flatten(), strict=True)
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), {n: v if pa.types.is_list(v.type) else v.to_numpy() for n, v in fields}


def _send_windows(window: int):
    """(w, doc, m, place, at, gram, more) of the windows of each text's `runs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, starts, ends, row, first, up in word_pieces(batches, "text", window):
            prefix = sequence_prefix(data, starts, ends)
            r, f = _runs_of(batch, "runs")
            count = f["hi"] - f["lo"] + 1
            own = np.repeat(np.arange(len(r)), count)
            place = f["lo"][own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
            here = place - up[r[own]]
            size = np.diff(np.append(first, len(row)))
            ok = (here >= 0) & (here + window <= size[r[own]])
            own, place, begin = own[ok], place[ok], here[ok] + first[r[own[ok]]]
            if not len(own):
                continue
            cols = [span_hash(prefix, begin, begin + window).view(np.int64), _longs(batch, "doc")[r[own]], _longs(batch, "m")[r[own]], place, f["at"][own], f["gram"][own], f["more"][own]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["w", "doc", "m", "place", "at", "gram", "more"])

    return run


def _cut_passages(window: int):
    """A row for each passage: its words joined by a space, and the places of its phrases in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, f = _runs_of(batch, "passages")
            texts, last, found = _column(batch, "text"), -1, []
            out: list[list] = [[], [], [], [], []]
            for k, i in enumerate(owner.tolist()):
                if i != last:
                    found, last = _WORD.findall(texts[i].as_py()), i
                lo, hi = int(f["lo"][k]), int(f["hi"][k]) + window
                for c, v in zip(out, (_column(batch, "doc")[i].as_py(), _column(batch, "m")[i].as_py(), int(f["bucket"][k]), " ".join(found[lo:hi]), [a - lo for a in f["ats"][k].as_py()]), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc", "m", "bucket", "text", "ats"])

    return run


class Shard:
    """Passages of smaller documents and the automaton of their phrases."""

    def __init__(self, window: int):
        self.window, self.ids, self.passages = window, {}, []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.ready = False

    def add(self, doc: int, text: str, ats: list[int]) -> None:
        ids = [self.ids.setdefault(w, len(self.ids) + 1) for w in text.split(" ")]
        for at in ats:
            phrase = tuple(ids[at : at + GRAM])
            held = self.automaton.get(phrase, None)
            if held is None:
                self.automaton.add_word(phrase, held := [])
            held.append((len(self.passages), at))
        self.passages.append((doc, np.array(ids)))

    def spans(self, doc: int, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of words of a document that go."""
        if not self.ready:
            self.automaton.make_automaton()
            self.ready = True
        line = tuple(map(self.ids.get, found, repeat(0)))
        mine, upto, begin, end = np.array(line), {}, [], []
        for last, held in self.automaton.iter(line):
            place = last - GRAM + 1
            for k, at in held:
                owner, theirs = self.passages[k]
                shift = place - at
                if owner >= doc or upto.get((k, shift), -1) > place:
                    continue
                low, high = max(0, shift), min(len(mine), shift + len(theirs))
                other = np.flatnonzero(mine[low:high] != theirs[low - shift : high - shift])
                i = int(np.searchsorted(other, place - low))
                a, b = low + (int(other[i - 1]) + 1 if i else 0), low + int(other[i]) if i < len(other) else high
                upto[k, shift] = b
                if b - a >= self.window:
                    begin.append(a)
                    end.append(b)
        return merged(begin, end) if begin else (np.zeros(0, dtype=np.int64),) * 2


CUT = f"doc long, m long, n_removed long, spans {SPANS}, kept string, kept_sha256 string"


def _scan(window: int, digest: bool):
    """Rows sorted by shard, passages (kind 0) before documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            names = batch.schema.names
            kinds, shards, docs, ms = (_longs(batch, c) for c in ("kind", "shard", "doc", "m"))
            text, ats = _column(batch, "text"), batch.column(names.index("ats"))
            out: list[list] = [[], [], [], [], [], []]
            for i in range(batch.num_rows):
                if shards[i] != number:
                    number, shard = shards[i], Shard(window)
                if kinds[i] == 0:
                    shard.add(int(docs[i]), text[i].as_py(), ats[i].as_py())
                    continue
                if not shard.passages:
                    continue
                found = _WORD.findall(text[i].as_py())
                a, b = shard.spans(int(docs[i]), found)
                if not len(a):
                    continue
                edges = zip([0, *b.tolist()], [*a.tolist(), len(found)], strict=True)
                kept = " ".join(w for x, y in edges for w in found[x:y])
                values = (int(docs[i]), int(ms[i]), int((b - a).sum()), [{"a": x, "b": y} for x, y in zip(a.tolist(), b.tolist(), strict=True)], None if digest else kept, hashlib.sha256(kept.encode()).hexdigest())
                for c, v in zip(out, values, strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc", "m", "n_removed", "spans", "kept", "kept_sha256"])

    return run


def one_line(text: Column) -> Column:
    """The words joined by a space."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def sign(rows: DataFrame) -> DataFrame:
    """(doc, m, copies, n_words, n_bytes, sha256, first): a row for each id and text; first: no document with a smaller
    id has the same words."""
    line = one_line(F.col("text"))
    n = F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "))) + 1)
    signed = written(rows.groupBy("doc", "m").agg(F.count("*").alias("copies"), F.min(n).cast("long").alias("n_words"), F.min(F.octet_length("text")).cast("long").alias("n_bytes"), F.min(F.sha2(line, 256)).alias("sha256")), "texts")
    # the smallest id of each sequence by a sum, then back; a sequence that many share meets it in a join that Spark splits
    least = written(signed.groupBy("sha256").agg(F.min("doc").alias("_least")), "least")
    return written(signed.join(least, "sha256").withColumn("first", F.col("doc") == F.col("_least")).drop("_least"), "signed")


def find_phrases(rows: DataFrame, signed: DataFrame, window: int, digest: bool) -> DataFrame:
    """(doc, m, n_removed, spans, kept, kept_sha256) of the documents that come first with their words and lose some."""
    spark = rows.sparkSession
    asked = signed.where(F.col("first") & (F.col("n_words") >= window)).select("doc", "m", "n_bytes", "copies")
    size, copies = asked.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.max("copies")).first()
    shards = max(SHARDS, size // SHARD_BYTES)
    # repeated rows are one, before they meet anything
    once = lambda df: df.dropDuplicates(["doc", "m"]) if (copies or 1) > 1 else df
    # those that come first, and what shares a bit with them, which costs work only
    key = F.xxhash64("doc", "m")
    long = flagged(rows.withColumn("_key", key), "_key", bitmap(asked.select(key.alias("_key")), "_key"), "_in").where("_in").select("doc", "m", "text")
    some = long.where(F.pmod(F.xxhash64("doc", "m"), F.lit(SAMPLE)) == 0).select("text")
    hot = spark.sparkContext.broadcast(hot_bits(some.mapInArrow(_sample(window), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))))
    sent = written(long.mapInArrow(_send_anchors(window, hot), ANCHORS), "anchors")
    shared = written(sent.groupBy("gram").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).where("a < b").select("gram"), "shared")
    own = maybe_in(sent, "gram", shared, "gram").groupBy("gram", "h").agg(F.min(F.struct("doc", "m", "lo", "hi", "at")).alias("f"), F.max("doc").alias("b"))
    stretch = F.struct("f.lo", "f.hi", "f.at", "gram", F.greatest("b", F.col("f.doc")).alias("more"))
    holders = written(own.select("f.doc", "f.m", stretch.alias("s")).groupBy("doc", "m").agg(F.collect_list("s").alias("runs")), "stretches")
    texts = once(maybe_in(long, "doc", holders.select("doc"), "doc")).join(holders, ["doc", "m"])
    windows = texts.select("doc", "m", "text", "runs").mapInArrow(_send_windows(window), "w long, doc long, m long, place long, at long, gram long, more long")
    recurring = windows.groupBy("w").agg(F.min(F.struct("doc", "m", "place", "at", "gram")).alias("f"), F.max("more").alias("b"), F.max("doc").alias("c")).where(F.col("f.doc") < F.greatest("b", "c"))
    passages = recurring.select("f.*").groupBy("doc", "m", F.expr(f"place div {BUCKET}").alias("bucket")).agg(F.min("place").alias("lo"), F.max("place").alias("hi"), F.collect_set("at").alias("ats"), F.collect_set("gram").alias("grams"))
    passages = written(passages, "passages")
    mine = passages.groupBy("doc", "m").agg(F.collect_list(F.struct("bucket", "lo", "hi", "ats")).alias("passages"))
    texts = once(maybe_in(long, "doc", passages.select("doc"), "doc")).join(mine, ["doc", "m"])
    cut = texts.select("doc", "m", "text", "passages").mapInArrow(_cut_passages(window), "doc long, m long, bucket long, text string, ats array<bigint>")
    # a passage goes to the shards where a larger document has one of its grams
    phrases = written(passages.select("doc", "m", "bucket", F.explode("grams").alias("gram")), "phrases")
    shard = F.pmod(F.xxhash64("doc"), F.lit(shards)).cast("int")
    asking = maybe_in(sent, "gram", phrases.select("gram").distinct(), "gram")
    routes = asking.groupBy("gram", shard.alias("shard")).agg(F.max("doc").alias("b")).join(phrases, "gram").where(F.col("b") > F.col("doc")).select("shard", "doc", "m", "bucket").distinct()
    left = cut.join(routes, ["doc", "m", "bucket"]).select("shard", F.lit(0).alias("kind"), "doc", "m", "text", "ats")
    scanned = asking.select("doc", "m").distinct()
    right = once(maybe_in(long, "doc", scanned.select("doc"), "doc")).join(scanned, ["doc", "m"])
    right = right.select(shard.alias("shard"), F.lit(1).alias("kind"), "doc", "m", "text", F.lit(None).cast("array<bigint>").alias("ats"))
    dealt = left.unionByName(right).repartition("shard").sortWithinPartitions("shard", "kind")
    return written(dealt.mapInArrow(_scan(window, digest), CUT), "cut")


def remove_phrases(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, digest: bool = False) -> DataFrame:
    """(doc_id long, n_words long, n_removed long, spans array<struct<a,b>> of words, kept string, kept_sha256 string), a
    row for each row of docs. kept: the words left, joined by a space; with digest it is left out, and unchanged texts
    aren't read again."""
    if window < 2 * GRAM:
        raise ValueError(f"window is {2 * GRAM} at least")
    rows = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.select("doc", F.xxhash64("text").alias("m"), "text")
    signed = sign(rows)
    cut = find_phrases(rows, signed, window, digest)
    whole = ~F.col("first") & (F.col("n_words") >= window)
    out = signed.join(cut.select("doc", "m", "n_removed", "spans", F.col("kept").alias("_kept"), "kept_sha256"), ["doc", "m"], "left")
    columns = ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"]
    if not digest:
        out = out.join(rows.dropDuplicates(["doc", "m"]), ["doc", "m"])
        out = out.withColumn("kept", F.when(whole, "").otherwise(F.coalesce("_kept", one_line(F.col("text")))))
        columns.insert(4, "kept")
    all_of = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n_words").alias("b")))
    out = out.withColumns({
        "doc_id": F.when(F.col("doc") != NO_ID, F.col("doc")),
        "n_removed": F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))),
        "spans": F.when(whole, all_of).otherwise(F.coalesce("spans", F.array().cast(SPANS))),
        "kept_sha256": F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha256")),
    })
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*columns)
