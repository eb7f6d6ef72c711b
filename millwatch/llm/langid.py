"""Language identification: one interpolated Kneser-Ney character model (order 4) a language.

Text is lower-cased; everything but letters and the marks that combine with them becomes one space. A model is a set of arrays sorted by the 64-bit hash of an
n-gram beside interpolated probabilities, and by that of a context beside back-off weights, found by binary search. A
document gets the language whose model has the lowest cross-entropy per character. Rejection is calibrated: on
labelled documents that the models didn't see, each language learns its median cross-entropy and, for four classes of
length, the room within which 99 % of these stay; a document outside the room of its best language is rejected, as is
one without a letter. A language without such documents uses the widest room of the others.

Fitting reads a bounded sample of every labelled language: about `most_fit` documents and `most_text` characters,
chosen by a hash of key and text (one document at least), and a quarter as many others for calibration. A language's
n-grams are counted by a shuffle and fitted in one task. Predicting reads whole texts, in pieces of half a MB; the models are
broadcast in blocks of `MODEL_BYTES` (one, but for hundreds of languages), and documents pass the blocks one after the
other, keeping the best language so far.

Defined results: null text, empty text and text without a letter are `und`, score 0, rejected; without any labelled
row all documents are `und`; ties between languages go to the first by name; repeated rows are judged alike, one row
out for each row in; an empty table gives an empty result; a column of the input named like one of the new ones gives
way to it.
"""

from __future__ import annotations

import io
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import U64, at, bare, given, mix, pieces, written

ORDER = 4
EDGE, SPACE = 1, 32
UNKNOWN = "und"
#: Models that tasks hold at once.
MODEL_BYTES = 1 << 29
#: Texts of fewer letters and spaces than these are of a class of length.
CLASSES = (64, 512, 4096)
QUANTILE = 0.99
_TABLE: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """For each code point its lower-case letter, itself if it is a mark, or a space; and whether it is a letter. No
    letters or marks lie between U+40000 and U+E0000."""
    if not _TABLE:
        t, letter = np.full(0x110000, SPACE, dtype=np.uint32), np.zeros(0x110000, dtype=bool)
        for c in [*range(0x40000), *range(0xE0000, 0x110000)]:
            ch = chr(c)
            kind = unicodedata.category(ch)[0]
            if kind in "LM":
                t[c] = ord(ch.lower()[0])
            letter[c] = kind == "L"
        letter[t[letter]] = True
        _TABLE.extend([t, letter])
    return _TABLE


def is_letter(chars: np.ndarray) -> np.ndarray:
    """Marks alone (accents, variation selectors, keycaps) are no letters."""
    return _tables()[1][chars.astype(np.int64)]


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each character of the rows' normalised texts, and its 4-gram, oldest character first; a text begins
    with three edges."""
    rows = len(offs) - 1
    point = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    before = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    row = np.repeat(np.arange(rows), np.diff(before[offs]))
    out = np.full(len(point) + 3 * rows, EDGE, dtype=np.uint32)
    own = np.full(len(out), -1, dtype=np.int64)
    place = np.arange(len(point)) + 3 * (row + 1)
    out[place], own[place] = _tables()[0][point], row
    keep = np.ones(len(out), dtype=bool)
    keep[1:] = (out[1:] != SPACE) | (out[:-1] != SPACE)
    out, own = out[keep], own[keep]
    real = np.flatnonzero(own >= 0)
    return own[real], [out[real - k].astype(U64) for k in range(ORDER - 1, -1, -1)]


def hash_of(chars: list[np.ndarray], n: int) -> np.ndarray:
    h = np.full(n, 0x9E3779B97F4A7C15, dtype=U64)
    for c in chars:
        h = mix(h * U64(0xA24BAED4963EE407) + c)
    return h


# ---- fitting ------------------------------------------------------------------------------------------------------


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return place, keys[place] == want


def fit_model(chars: list[np.ndarray], counts: np.ndarray) -> dict:
    """A model from distinct 4-grams and their counts. Orders below the highest count distinct predecessors."""
    levels = [(chars, counts.astype(np.int64))]
    for _ in range(ORDER - 1):
        above = levels[-1][0]
        shorter = above[1:]
        _, index, many = np.unique(hash_of(shorter, len(above[0])), return_index=True, return_counts=True)
        levels.append(([c[index] for c in shorter], many))
    model: dict = {"size": np.array(len(levels[-1][1]) + 1)}
    for n, (c, count) in enumerate(reversed(levels), 1):
        many = len(count)
        if n == 1:
            lower = np.full(many, 1.0 / float(model["size"]))
        else:
            lower = model[f"p{n - 1}"][_find(model[f"k{n - 1}"], hash_of(c[1:], many))[0]]
        n1, n2 = max(1, int((count == 1).sum())), int((count == 2).sum())
        d = min(0.95, max(0.05, n1 / (n1 + 2 * n2)))
        context, of = np.unique(hash_of(c[:-1], many), return_inverse=True)
        total, kinds = np.bincount(of, weights=count), np.bincount(of)
        weight = d * kinds / total
        key = hash_of(c, many)
        order = np.argsort(key)
        model |= {f"k{n}": key[order], f"p{n}": ((count - d) / total[of] + weight[of] * lower)[order], f"ctx{n}": context, f"w{n}": weight}
    return model


def surprise(model: dict, chars: list[np.ndarray]) -> np.ndarray:
    """Bits of each 4-gram's last character after its first three."""
    many = len(chars[0])
    p = np.full(many, 1.0 / float(model["size"]))
    for n in range(1, ORDER + 1):
        part = chars[ORDER - n :]
        place, known = _find(model[f"ctx{n}"], hash_of(part[:-1], many))
        p = np.where(known, model[f"w{n}"][place] * p, p)
        place, seen = _find(model[f"k{n}"], hash_of(part, many))
        p = np.where(seen, model[f"p{n}"][place], p)
    return -np.log2(p)


def _pack(chars: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (chars[0] << U64(21)) | chars[1], (chars[2] << U64(21)) | chars[3]


def _unpack(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    low = U64((1 << 21) - 1)
    return [a >> U64(21), a & low, b >> U64(21), b & low]


def _distinct(chars: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of its distinct gram for each gram, the distinct grams)."""
    a, b = _pack(chars)
    ids, kinds = pd.factorize(mix(a * U64(0x9E3779B97F4A7C15)) + mix(b))
    first = np.zeros(len(kinds), dtype=np.int64)
    first[ids[::-1]] = np.arange(len(ids))[::-1]
    return ids, [c[first] for c in chars]


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offs in pieces(batches, "text"):
        names, kinds = pd.factorize(pd.Series(batch.column(batch.schema.get_field_index("lang")).to_pylist()))
        row, chars = grams(data, offs)
        for k, name in enumerate(kinds):
            mine = names[row] == k
            ids, some = _distinct([c[mine] for c in chars])
            a, b = _pack(some)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(a), pa.string()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.bincount(ids, minlength=len(a)).astype(np.int64))], names=["lang", "a", "b", "n"])


def _fit_group(g: pd.DataFrame) -> pd.DataFrame:
    model = fit_model(_unpack(g["a"].to_numpy().astype(np.int64).view(U64), g["b"].to_numpy().astype(np.int64).view(U64)), g["n"].to_numpy())
    out = io.BytesIO()
    np.savez(out, **model)
    return pd.DataFrame({"lang": [g["lang"].iloc[0]], "model": [out.getvalue()]})


def _load(blob: bytes) -> dict:
    with np.load(io.BytesIO(blob)) as z:
        return {k: z[k] for k in z.files}


@dataclass
class Models:
    """table: (lang, model binary, mean double, rooms array<double>, one for each class of length)."""

    table: DataFrame

    def blocks(self) -> list[list[str]]:
        """The languages, in order of name, in blocks that tasks hold at once."""
        out, held = [], MODEL_BYTES + 1
        for r in self.table.select("lang", F.octet_length("model").alias("n")).orderBy("lang").collect():  # a row a language
            if held + r["n"] > MODEL_BYTES:
                out.append([])
                held = 0
            out[-1].append(r["lang"])
            held += r["n"]
        return out

    def load(self, names: list[str]) -> list[tuple[str, dict, float, np.ndarray]]:
        rows = self.table.where(F.col("lang").isin(names)).orderBy("lang").collect()
        return [(r["lang"], _load(bytes(r["model"])), r["mean"], np.array(r["rooms"], dtype=float)) for r in rows]


FOUND = "`_best` string, `_low` double, `_z` double, `_n` bigint, `_mean` double, `_room` double"


def _search(df: DataFrame, models: Models, text: str) -> DataFrame:
    """df with the best language (null: none), its bits per character, the sum over languages of 2 to the power of
    minus the bits above it (of 40 characters at most), the characters, and the best language's median and room."""
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema], FOUND])
    blocks = models.blocks() or [[]]
    out = df
    for number, names in enumerate(blocks):
        held = df.sparkSession.sparkContext.broadcast(models.load(names) if names else [])

        def scan(batches: Iterator[pa.RecordBatch], held=held, first=number == 0) -> Iterator[pa.RecordBatch]:
            for batch, data, offs in pieces(batches, text, 1 << 19):
                rows = batch.num_rows
                row, chars = grams(data, offs)
                n = np.bincount(row, minlength=rows)
                ids, some = _distinct(chars)
                letter = np.bincount(row, weights=is_letter(chars[-1]), minlength=rows) > 0
                bits = np.array([np.bincount(row, weights=surprise(m, some)[ids], minlength=rows) / np.maximum(n, 1) for _, m, _, _ in held.value]).reshape(len(held.value), rows)
                if first:
                    best, low, z, mean, room = np.full(rows, None, dtype=object), np.full(rows, np.inf), np.zeros(rows), np.zeros(rows), np.zeros(rows)
                    kept = batch.columns
                else:
                    best, low, z, _, mean, room = (c.to_numpy(zero_copy_only=False).copy() for c in batch.columns[-6:])
                    kept = batch.columns[:-6]
                if len(bits):
                    k = bits.argmin(axis=0)
                    new = bits[k, np.arange(rows)]
                    m = np.minimum(n, 40)
                    least = np.minimum(low, new)
                    z = np.where(np.isinf(low), 0.0, z * np.exp2(-(np.where(np.isinf(low), 0.0, low) - least) * m)) + np.exp2(-(bits - least) * m).sum(axis=0)
                    better = (new < low) & letter
                    kind = np.searchsorted(CLASSES, n, side="right")
                    best = np.where(better, np.array([x[0] for x in held.value], dtype=object)[k], best)
                    mean = np.where(better, np.array([x[2] for x in held.value])[k], mean)
                    room = np.where(better, np.array([x[3] for x in held.value])[k, kind], room)
                    low = np.where(letter, least, low)
                cols = [*kept, pa.array(best.tolist(), pa.string()), pa.array(low), pa.array(z), pa.array(n.astype(np.int64)), pa.array(mean), pa.array(room)]
                yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[: len(kept)], *(x.split("`")[1] for x in FOUND.split(", "))])

        out = out.mapInArrow(scan, schema)
        if number + 1 < len(blocks):
            out = written(out, "scores")
    return out


def fit(train: DataFrame, most_fit: int = 2000, most_text: int = 1 << 25) -> Models:
    """Models and their calibration from (key string, text, lang). See the module's text for what is read."""
    spark = train.sparkSession
    u = F.pmod(F.xxhash64(F.coalesce("key", F.lit("")), F.xxhash64("text")), F.lit(1 << 30))
    rows = train.where("lang is not null and text is not null").where(F.col("text").rlike(r"\p{L}")).select("text", "lang", u.alias("_u"))
    per = rows.groupBy("lang").agg(F.count("*").alias("_n"), F.sum(F.length("text")).alias("_c"), F.min("_u").alias("_first"))
    share = F.least(F.lit(0.8), F.lit(float(most_fit)) / F.col("_n"), F.lit(float(most_text)) / F.greatest("_c", F.lit(1)))
    per = written(per.select("lang", "_first", F.floor(share * (1 << 30)).alias("_limit")), "languages")
    few = F.broadcast if per.count() <= 1 << 16 else (lambda x: x)
    dealt = rows.join(few(per), "lang")
    mine = (F.col("_u") < F.col("_limit")) | (F.col("_u") == F.col("_first"))
    counts = dealt.where(mine).select("text", "lang").mapInArrow(_count_grams, "lang string, a long, b long, n long").groupBy("lang", "a", "b").agg(F.sum("n").alias("n"))
    fitted = written(counts.groupBy("lang").applyInPandas(_fit_group, "lang string, model binary"), "models")
    # calibration; what another language fits better is no example of its own
    raw = Models(fitted.select("lang", "model", F.lit(0.0).alias("mean"), F.array(*[F.lit(0.0)] * (len(CLASSES) + 1)).alias("rooms")))
    unseen = dealt.where(~mine & (F.col("_u") < F.col("_limit") * 1.25)).select("text", "lang")
    seen = written(_search(unseen, raw, "text").where("_best = lang").select("lang", "_low", "_n"), "calibration")
    mean = seen.groupBy("lang").agg(F.percentile("_low", F.lit(0.5)).alias("mean"))
    kind = sum(((F.col("_n") >= c).cast("int") for c in CLASSES), F.lit(0))
    over = seen.join(F.broadcast(mean), "lang").select("lang", kind.alias("kind"), ((F.col("_low") - F.col("mean") - 1.0) * F.sqrt(F.greatest("_n", F.lit(1)))).alias("over"))
    room = lambda c: 1.25 * F.greatest(F.lit(0.0), F.percentile(c, F.lit(QUANTILE))) + 8.0
    own = lambda k: F.when(F.col("kind") == k, F.col("over"))
    rooms = over.groupBy("lang").agg(F.array(*[F.when(F.count(own(k)) >= 20, room(own(k))).otherwise(room("over")) for k in range(len(CLASSES) + 1)]).alias("rooms"))
    known = written(mean.join(rooms, "lang"), "rooms")
    wide = known.agg(F.coalesce(F.max("mean"), F.lit(4.0)).alias("_m"), F.array(*[F.coalesce(F.max(F.col("rooms")[k]), F.lit(8.0)) for k in range(len(CLASSES) + 1)]).alias("_r"))
    table = fitted.join(known, "lang", "left").crossJoin(F.broadcast(wide)).select("lang", "model", F.coalesce("mean", "_m").alias("mean"), F.coalesce("rooms", "_r").alias("rooms"))
    return Models(written(table, "calibrated"))


def identify(df: DataFrame, models: Models, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """df with lang_pred string, score double (the best language's posterior, tempered to 40 characters) and
    rejected boolean. Carries df's other columns through unread."""
    found = _search(bare(df), models, at(df, text))
    known = F.col("_best").isNotNull()
    lost = F.col("_low") > F.col("_mean") + 1.0 + F.col("_room") / F.sqrt(F.greatest("_n", F.lit(1)))
    return found.select(*given(df, out), F.coalesce("_best", F.lit(UNKNOWN)).alias(out[0]), F.when(known, 1.0 / F.col("_z")).otherwise(0.0).alias(out[1]), F.when(known, lost).otherwise(True).alias(out[2]))


def held_out(key: Column) -> Column:
    """True for the documents that fitting never sees: crc32 of the id's text modulo 4 is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))
