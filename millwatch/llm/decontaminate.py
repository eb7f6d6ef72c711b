"""Benchmark decontamination by template canonicalisation.

A text becomes a row of tokens: words without outer punctuation, in one case; in scripts without spaces each character is
a token. Numbers and number words become one placeholder, quantities with a unit (5km, 10%) another, a unit a third, and
names a fourth; the word itself is kept as the slot's value. Names are capitalised words, in one view only those inside a
sentence, in another those that begin one too. Windows of `window` tokens (an item's whole text, if it is shorter; 4 at
least) are joined by hash with the benchmark's, as templates in both views and by their words in one case, so that a copy
in another case is found too. Matches of a document and an item on one diagonal must fill the item's slots consistently:
an equal value by equal ones (where they differ, the one that most slots have counts), different names and units by
different ones; numbers may coincide. A slot that breaks this removes the template windows that hold it and no others;
windows equal word by word always count.

Windows that more than `MANY` items share (an instruction before each question) say nothing about one of them: they are
not joined and count for none, but for items that have no others of their kind. So a document that holds a shared preamble
and no more is no finding, and the work doesn't grow with the items that share it.

A document is contaminated by an item when matches cover `cover` of the item's own windows of either kind, `run` of its
own tokens in a row, or, with the equal words beside them on their diagonals, `share` of them. So a question is found
again after its numbers, names or units were changed, in part, or with scattered words changed.

Slots that no list knows (number words of other languages, changed words) show by alignment: two short windows (`SEED`
equal words, apart from each other) on one diagonal align the whole item; what differs there between equal words, up to
`GAP` tokens at once, is a slot, filled consistently, and the item is found when `EQUAL` of its tokens are equal and
`share` are equal or slots. An item of fewer than 4 tokens is found in documents that have its words and no others.

The benchmark goes to the tasks in blocks of items with at most `block` windows each (one block, if it has fewer), one
after the other, documents being read once a block; the driver holds one block.

Defined results: null or empty documents and items match nothing; very long texts are read whole; template
windows with fewer than half literal words are too general and don't count, nor do equal ones of which more than half
are numbers and units; repeated rows give repeated findings, and equal items are found each; an empty
benchmark or an empty table gives an empty result. Output columns are fixed, so other columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwatch.llm.common import _LOWER, U64, mix, pieces, prefix_hash, span_hash, words, written

LEAST = 4
#: Items that may share a window that still counts for each of them.
MANY = 2
#: Words of the short windows that align an item, tokens of a slot, and the share of an item's tokens that must be equal.
SEED, GAP, EQUAL = 4, 2, 0.7
#: Scripts that are written without spaces (Thai and Lao, Myanmar, Khmer, kana and Han).
UNSPACED = re.compile("([\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")
#: Units wherever they stand.
UNITS = "km cm mm kg mg ml kmh mph kw khz mhz ghz kb mb gb tb mile miles kilometer kilometers meter meters metre metres feet foot inch inches gram grams kilogram kilograms liter liters litre litres hr hrs hour hours minute minutes second seconds day days week weeks month months year years eur usd gbp dollar dollars euro euros cents % $"
#: Units only after a number, as they are words too.
SHORT_UNITS = "m mi ft in g lb oz l s ms min h a v w hz c f k"
#: Words for numbers, by language ("one" and its like are mostly articles and pronouns); hints, as slots
#: also show by alignment.
NUMBER_WORDS_BY_LANGUAGE = {
    "en": "two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million",
    "de": "zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig hundert tausend",
    "fr": "deux trois quatre cinq six sept huit neuf dix onze douze treize quinze vingt trente quarante cinquante soixante cent mille",
    "es": "dos tres cuatro cinco seis siete ocho nueve diez once doce trece quince veinte treinta cuarenta cincuenta sesenta cien mil",
    "zh": "二 三 四 五 六 七 八 九 十 百 千 万 两",
}
NUMBER_WORDS = " ".join(dict.fromkeys(" ".join(NUMBER_WORDS_BY_LANGUAGE.values()).casefold().split()))
#: Punctuation beyond ASCII, as its nearest ASCII sign.
PUNCTUATION = {ord(a): b for a, b in zip("‘’‚‛“”„‟«»‹›…–—。，？！：；、（）", chr(39) * 4 + chr(34) * 6 + chr(39) * 2 + ".--.,?!:;,()", strict=True)}
NUM, QTY, UNIT, NAME = (np.uint64(x) for x in (1, 2, 3, 4))

#: First bytes, in UTF-8, of the characters of UNSPACED (and of some others).
_UNSPACED_LEAD = np.zeros(256, dtype=bool)
_UNSPACED_LEAD[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0]] = True
#: The same of PUNCTUATION.
_MARK_LEAD = np.zeros(256, dtype=bool)
_MARK_LEAD[[chr(c).encode()[0] for c in PUNCTUATION]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_NUMERIC = _DIGIT.copy()
_NUMERIC[[ord(c) for c in ".,:/+-"]] = True
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_PUNCT[[ord("%"), ord("$")]] = False


def _word_hash(word: str) -> np.uint64:
    b = np.frombuffer(word.encode(), dtype=np.uint8)
    return span_hash(prefix_hash(b), np.array([0]), np.array([len(b)]))[0]


_UNITS, _SHORT_UNITS, _NUMBER_WORDS = (np.sort(np.array([_word_hash(u) for u in x.split()], dtype=U64)) for x in (UNITS, SHORT_UNITS, NUMBER_WORDS))


def one_case(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes and offsets of the rows with ASCII punctuation, and those in one case."""
    if not len(data) or data.max() < 128:
        return data, offs, _LOWER[data], offs
    held = lambda lead: np.diff(np.concatenate([[0], np.cumsum(lead[data])])[offs]).tolist()
    plain = []
    for a, b, marks, unspaced in zip(offs[:-1].tolist(), offs[1:].tolist(), held(_MARK_LEAD), held(_UNSPACED_LEAD), strict=True):
        t = data[a:b].tobytes().decode("utf-8", "replace")
        t = t.translate(PUNCTUATION) if marks else t
        plain.append(UNSPACED.sub(r" \1 ", t) if unspaced else t)
    out = []
    for texts in (plain, [t.casefold() for t in plain]):
        raw = [t.encode() for t in texts]
        out += [np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)]
    return tuple(out)


def template(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(row, canonical in both views, literal) of each token: placeholders are the numbers 1 to 4."""
    data, offs, low, low_offs = one_case(data, offs)
    starts, ends, row = words(data, offs)
    z = np.zeros(0, dtype=U64)
    solid = np.flatnonzero(~_PUNCT[data])
    if not len(starts) or not len(solid):
        return np.zeros(0, dtype=np.int64), (z, z), z
    stop = np.isin(data[ends - 1], np.frombuffer(b".!?:", dtype=np.uint8))
    lines = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(data == 10, out=lines[1:])
    opens = np.ones(len(starts), dtype=bool)
    opens[1:] = (row[1:] != row[:-1]) | stop[:-1] | (lines[starts[1:]] != lines[ends[:-1]])
    # without outer punctuation
    first = np.searchsorted(solid, starts)
    begin = np.minimum(np.where(first < len(solid), solid[np.minimum(first, len(solid) - 1)], ends), ends)
    last = np.searchsorted(solid, ends) - 1
    end = np.maximum(np.where(last >= 0, solid[np.maximum(last, 0)] + 1, begin), begin)
    low_starts, low_ends, _ = words(low, low_offs)
    low_starts, low_ends = low_starts + (begin - starts), low_ends - (ends - end)
    some = begin < end
    starts, ends, row, opens, low_starts, low_ends = (x[some] for x in (begin, end, row, opens, low_starts, low_ends))
    if not len(starts):
        return row, (z, z), z
    literal = span_hash(prefix_hash(low), low_starts, low_ends)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    digits, numeric = sums(_DIGIT[data]), sums(_NUMERIC[data])
    has = digits[ends] > digits[starts]
    number = has & (numeric[ends] - numeric[starts] == ends - starts) | np.isin(literal, _NUMBER_WORDS)
    quantity = has & ~number & (_DIGIT[data[starts]] | (data[starts] == ord("$")))
    after = np.concatenate([[False], number[:-1] & (row[1:] == row[:-1])])
    unit = np.isin(literal, _UNITS) | after & np.isin(literal, _SHORT_UNITS)
    upper = data[starts] != low[low_starts]
    second = (data[starts] >= 0xC0) & (starts + 1 < len(data)) & (low_starts + 1 < len(low))
    upper |= second & (data[np.minimum(starts + 1, len(data) - 1)] != low[np.minimum(low_starts + 1, len(low) - 1)])
    code = np.where(number, NUM, np.where(quantity, QTY, np.where(unit, UNIT, literal | U64(8))))
    name = upper & (code > NAME)
    return row, (np.where(name & ~opens, NAME, code), np.where(name, NAME, code)), literal


def windows(row: np.ndarray, code: np.ndarray, size: int, value: np.ndarray | None = None, least: np.uint64 = NAME) -> tuple[np.ndarray, np.ndarray]:
    """(position of its first token, hash) of each window of `size` tokens inside a row of which half at least have a
    code above `least`. The hash is of `value`, of the codes if that is left out."""
    value = code if value is None else value
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U64)
    mixed, h = mix(value), np.zeros(n, dtype=U64)
    for j in range(size):
        h = h * U64(0x9E3779B97F4A7C15) + mixed[j : j + n]
    plain = np.concatenate([[0], np.cumsum(code > least)])
    ok = (row[:n] == row[size - 1 :]) & (2 * (plain[size:] - plain[:n]) >= size)
    at = np.flatnonzero(ok)
    return at, mix(h[at])


def all_kinds(row: np.ndarray, codes: tuple[np.ndarray, np.ndarray], literal: np.ndarray, size: int) -> list:
    """Windows by template in both views, and word by word."""
    return [*(windows(row, code, size) for code in codes), windows(row, codes[0], size, literal, UNIT)]


def _shared_by(h: np.ndarray, item: np.ndarray) -> np.ndarray:
    """How many items have the hash, for each."""
    order = np.lexsort((item, h))
    a, b = h[order], item[order]
    head = np.concatenate([[True], a[1:] != a[:-1]]) if len(a) else np.zeros(0, dtype=bool)
    fresh = head | np.concatenate([[True], b[1:] != b[:-1]]) if len(a) else head
    group = np.cumsum(head) - 1
    out = np.zeros(len(h), dtype=np.int64)
    out[order] = np.bincount(group, weights=fresh)[group] if len(a) else 0
    return out


class Items:
    """A block of the benchmark: its tokens, and its windows of all kinds that count, sorted by hash, by window size."""

    def __init__(self, ids: list, texts: list, size: int):
        raw = [(t or "").encode() for t in texts]
        data, offs = np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.ids = ids
        self.row, self.codes, self.literal = template(data, offs)
        count = np.bincount(self.row, minlength=len(ids)).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(count)])
        self.by_size: dict[int, list[Hashes]] = {}
        equal, fits = np.zeros(len(self.row), dtype=bool), np.zeros(len(self.row), dtype=bool)
        own, said = np.zeros(len(self.row) + 1, dtype=np.int64), np.zeros(len(self.row) + 1, dtype=np.int64)
        for s in sorted({min(size, int(c)) for c in count if c >= LEAST}):
            kinds = []
            for kind, (at, h) in enumerate(all_kinds(self.row, self.codes, self.literal, s)):
                mine = np.minimum(count[self.row[at]], size) == s
                at, h = at[mine], h[mine]
                rare = _shared_by(h, self.row[at]) <= MANY
                has = np.zeros(len(ids), dtype=bool)
                has[self.row[at[rare]]] = True
                counts = rare | ~has[self.row[at]]
                if kind == 2:
                    np.add.at(said, at[~counts], 1)
                    np.add.at(said, at[~counts] + s, -1)
                at, h = at[counts], h[counts]
                (equal if kind == 2 else fits)[at] = True
                np.add.at(own, at, 1)
                np.add.at(own, at + s, -1)
                kinds.append(Hashes(h, at))
            self.by_size[s] = kinds
        self.general = ~fits
        self.windows = np.array([np.bincount(self.row[m], minlength=len(ids)) for m in (fits, equal)])
        # an item's own tokens: under windows that count, and under none that others have word by word; where these are
        # few, all under windows that count; where none does, all
        counted = np.cumsum(own)[:-1] > 0
        self.own = counted & (np.cumsum(said)[:-1] == 0)
        for least, instead in ((2 * SEED, counted), (1, np.ones(len(self.row), dtype=bool))):
            few = np.bincount(self.row[self.own], minlength=len(ids)) < least
            self.own = np.where(few[self.row], instead, self.own)
        self.own_tokens = np.bincount(self.row[self.own], minlength=len(ids))
        self.short: dict[tuple, list[int]] = {}
        for i in np.flatnonzero((count > 0) & (count < LEAST)):
            self.short.setdefault(tuple(self.literal[self.start[i] : self.start[i + 1]].tolist()), []).append(int(i))
        at, h = windows(self.row, self.codes[0], SEED, self.literal, UNIT)
        rare = (_shared_by(h, self.row[at]) <= MANY) & (count[self.row[at]] >= 2 * SEED)
        at, h = at[rare], h[rare]
        self.seeds = Hashes(h, at)


class Hashes:
    """Hashes with their places, sorted, behind a table of bits of their first digits that most others miss."""

    def __init__(self, h: np.ndarray, at: np.ndarray):
        order = np.argsort(h, kind="stable")
        self.keys, self.places = h[order], at[order]
        bits = min(24, max(12, (16 * len(h)).bit_length()))
        self.shift, self.table = U64(64 - bits), np.zeros(1 << bits, dtype=bool)
        self.table[(h >> self.shift).astype(np.int64)] = True

    def pairs(self, at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the document, place in the benchmark) of equal hashes."""
        some = self.table[(h >> self.shift).astype(np.int64)]
        at, h = at[some], h[some]
        left, right = np.searchsorted(self.keys, h), np.searchsorted(self.keys, h, side="right")
        many = right - left
        own = np.repeat(np.arange(len(h)), many)
        inner = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
        return at[own], self.places[left[own] + inner]


def _aligned(items: Items, row: np.ndarray, codes: tuple[np.ndarray, np.ndarray], literal: np.ndarray, share: float) -> list[tuple]:
    """Findings of items whose short windows align them with a document, as search() gives them."""
    here, there = items.seeds.pairs(*windows(row, codes[0], SEED, literal, UNIT))
    if not len(here):
        return []
    r, item, shift = row[here], items.row[there], here - there
    order = np.lexsort((there, shift, item, r))
    r, item, shift, there = r[order], item[order], shift[order], there[order]
    first = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1])]))
    last = np.append(first[1:], len(r)) - 1
    out = {}
    for k in np.flatnonzero(there[last] - there[first] >= SEED):
        i, s, doc = int(item[first[k]]), int(shift[first[k]]), int(r[first[k]])
        begin, end = int(items.start[i]), int(items.start[i + 1])
        place = np.arange(max(begin, -s), min(end, len(row) - s))
        place = place[row[place + s] == doc]
        same = items.literal[place] == literal[place + s]
        if same.sum() < EQUAL * (end - begin):
            continue
        # runs of different tokens between equal ones
        differ = np.flatnonzero(~same)
        runs = np.split(differ, np.flatnonzero(np.diff(differ) > 1) + 1) if len(differ) else []
        slots = np.array([x for g in runs if len(g) <= GAP and g[0] > 0 and g[-1] + 1 < len(same) for x in g], dtype=np.int64)
        kind = np.full(len(slots), NAME)
        kind[items.codes[0][place[slots]] == NUM] = NUM
        slots = slots[~_broken(kind, items.literal[place[slots]], literal[place[slots] + s])] if len(slots) else slots
        good = place[np.concatenate([np.flatnonzero(same), slots])]
        mine = items.own[good].sum()
        if mine >= share * items.own_tokens[i] and items.own[place[same]].sum() >= EQUAL * items.own_tokens[i]:
            out[doc, i] = max(out.get((doc, i), (0,)), (int(same.sum()), end - begin, len(slots), len(slots)))
    return [(doc, i, *v) for (doc, i), v in out.items()]


def _broken(kind: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which slots break consistency: a value of a beside another value of b than most of its slots have, and a name or
    unit of b beside another value of a than most. Without a majority all slots of the value do."""
    bad = np.zeros(len(a), dtype=bool)
    for key, value, some in ((a, b, np.ones(len(a), dtype=bool)), (b, a, (kind == NAME) | (kind == UNIT))):
        groups: dict[int, list[int]] = {}
        for i in np.flatnonzero(some & ~bad):
            groups.setdefault(int(key[i]), []).append(int(i))
        for mine in groups.values():
            values, counts = np.unique(value[mine], return_counts=True)
            if len(values) > 1:
                most = int(np.argmax(counts))
                wrong = [i for i in mine if 2 * counts[most] <= len(mine) or value[i] != values[most]]
                bad[wrong] = True
    return bad


def search(items: Items, data: np.ndarray, offs: np.ndarray, cover: float, share: float, run: int) -> list[tuple]:
    """(row, item, matched windows, item's windows, slots, changed slots) of the contaminated rows."""
    row, codes, literal = template(data, offs)
    found: dict[tuple, dict[int, tuple[set, set, set, int]]] = {}
    for size, kinds in items.by_size.items():
        for kind, (known, asked) in enumerate(zip(kinds, all_kinds(row, codes, literal, size), strict=True)):
            for here, place in zip(*(x.tolist() for x in known.pairs(*asked)), strict=True):
                shifts = found.setdefault((int(row[here]), int(items.row[place])), {})
                shifts.setdefault(here - place, (set(), set(), set(), size))[kind].add(place)
    out = []
    if items.short:
        count = np.bincount(row, minlength=len(offs) - 1)
        start = np.concatenate([[0], np.cumsum(count)])
        for r in np.flatnonzero((count > 0) & (count < LEAST)):
            out += [(int(r), i, 1, 1, 0, 0) for i in items.short.get(tuple(literal[start[r] : start[r + 1]].tolist()), [])]
    for (r, item), shifts in found.items():
        kept: set[int] = set()
        equal: set[int] = set()
        tokens: set[int] = set()
        slots: set[int] = set()
        changed: set[int] = set()
        longest = 0
        for shift, (*views, by_word, size) in shifts.items():
            span = lambda places, size=size: np.unique(np.concatenate([np.arange(p, p + size) for p in places])) if places else np.zeros(0, dtype=np.int64)
            good = set(by_word)
            for code, places in zip(items.codes, views, strict=True):
                own = span(places)
                own = own[code[own] <= NAME]
                bad = set(own[_broken(code[own], items.literal[own], literal[own + shift])].tolist())
                good |= {p for p in places if bad.isdisjoint(range(p, p + size))}
            if not good:
                continue
            kept |= good
            equal |= by_word
            held = span(good)
            tokens |= set(held.tolist())
            beside = np.arange(max(items.start[item], -shift), min(items.start[item + 1], len(row) - shift))
            beside = beside[row[beside + shift] == r]
            tokens |= set(beside[items.literal[beside] == literal[beside + shift]].tolist())
            longest = max(longest, *np.diff(np.concatenate([[0], np.flatnonzero(np.diff(held) > 1) + 1, [len(held)]])).tolist())
            held = held[items.codes[1][held] <= NAME]
            slots |= set(held.tolist())
            changed |= set(held[items.literal[held] != literal[held + shift]].tolist())
        if not kept:
            continue
        kept = {p for p in kept if not items.general[p]}
        n, total = max(((len(m), int(t)) for m, t in zip((kept, equal), items.windows[:, item], strict=True) if t), key=lambda x: x[0] / x[1])
        own = sum(items.own[p] for p in tokens)
        if n >= cover * total or own >= share * items.own_tokens[item] or longest >= run:
            out.append((r, item, n, total, len(slots), len(changed)))
    known = {(r, item) for r, item, *_ in out}
    return out + [x for x in _aligned(items, row, codes, literal, share) if x[:2] not in known]


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 8, cover: float = 0.5, share: float = 0.9, run: int = 30, block: int = 1 << 20) -> DataFrame:
    """(doc_id, item_id, matched_windows, item_windows, coverage, slots, changed_slots), a row for each contaminated
    document and item. changed_slots above 0: the question was re-parameterised."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text is not null")
    tokens = items.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] or 0
    blocks = -(-int(tokens) // block)
    kind, item_kind = docs.schema[doc_id].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, matched_windows int, item_windows int, coverage double, slots int, changed_slots int"
    slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    out = None
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(Items([r[0] for r in part], [r[1] for r in part], window))

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch, data, offs in pieces(batches, "text"):
                if found := search(held.value, data, offs, cover, share, run):
                    r, item, n, total, slots, changed = zip(*found, strict=True)
                    ids = held.value.ids
                    cols = [batch.column(0).take(pa.array(r)), pa.array([ids[i] for i in item]), pa.array(n, pa.int32()), pa.array(total, pa.int32()), pa.array([x / y for x, y in zip(n, total, strict=True)]), pa.array(slots, pa.int32()), pa.array(changed, pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "matched_windows", "item_windows", "coverage", "slots", "changed_slots"])

        one = slim.mapInArrow(scan, schema)
        if blocks > 1:  # done before the next block is read
            one = written(one, "found")
            held.destroy()
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], schema)
