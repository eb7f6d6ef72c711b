"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def shingle_set(text: str | None, k: int) -> frozenset:
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard(docs: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {d: shingle_set(t, k) for d, t in docs}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where: dict = {}
    for d in ids:
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    for d in ids:
        count: dict = {}
        for s in sets[d]:
            for o in where[s]:
                if o < d:
                    count[o] = count.get(o, 0) + 1
        for o, c in count.items():
            if 100 * c >= percent * (len(sets[d]) + len(sets[o]) - c):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in ids}


def repeats(docs: list[tuple[int, str | None]], depth: int) -> list[tuple]:
    seen: set = set()
    out = []
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            s = b[i : i + depth]
            if s in seen:
                gone[i : i + depth] = b"\x01" * depth
            else:
                seen.add(s)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def targets(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Words of each source: the rest is shared by weight until no source is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(out.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return out | share
        out |= {s: most * sizes[s] for s in over}
        free -= over


def mix(docs: list[tuple], key, seed: int = 11) -> dict:
    """{doc_id: copies} above 0 of (doc_id, source, text) by Pareto order sampling, longer documents likelier."""
    rows = [(d, s, len(WORD.findall((t or "").encode())), str(key(d, t))) for d, s, t in docs]
    sizes: dict = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    want, out = targets(sizes), {}
    for s, target in want.items():
        mine = [(d, n, k, math.isqrt(n) + 1) for d, x, n, k in rows if x == s]
        whole = int(target // sizes[s]) if sizes[s] else 0
        rest = target - whole * sizes[s]
        appeal = sum(n * a for _, n, _, a in mine)
        ranked = []
        for d, n, k, a in mine:
            u = (int(hashlib.md5(f"{seed}:{k}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
            p = min(max(a * rest / appeal, 1e-12), 1 - 1e-12) if appeal else 0.5
            ranked.append((u / (1 - u) * (1 - p) / p, k, n, d))
        run = 0
        for _, _, n, d in sorted(ranked):
            extra = n > 0 and rest > 0 and whole < 3 and 2 * run + n <= 2 * rest
            out[d] = out.get(d, 0) + whole + extra
            run += n
    return {d: c for d, c in out.items() if c}


def _tokens(text: str) -> list[tuple[str, str, str]]:
    """(canonical inside sentences, canonical anywhere, word in one case) of each word."""
    from millwatch.llm import decontaminate as D

    punctuation = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c not in "%$")
    out, opens = [], True
    for line in text.translate(D.PUNCTUATION).split("\n"):
        opens = True
        for raw in line.split():
            word, begins = raw.strip(punctuation), opens
            opens = raw[-1] in ".!?:"
            if not word:
                continue
            low = word.casefold()
            if re.fullmatch(r"[0-9.,:/+-]*[0-9][0-9.,:/+-]*", word) or low in D.NUMBER_WORDS.split():
                kind = "NUM"
            elif re.search("[0-9]", word) and (word[0].isdigit() or word[0] == "$"):
                kind = "QTY"
            elif low in D.UNITS.split() or out and out[-1][0] == "NUM" and low in D.SHORT_UNITS.split():
                kind = "UNIT"
            else:
                kind = "=" + low
            name = kind[0] == "=" and word[0] != low[0]
            out.append(("NAME" if name and not begins else kind, "NAME" if name else kind, low))
    return out


def _bad_slots(slots, pairs) -> set:
    """Slots that break consistency. pairs: (of item, of document, kinds) as functions of a slot and the kinds asked."""
    bad: set = set()
    for one, other, asked in pairs:
        groups: dict = {}
        for p in slots:
            if p not in bad and asked(p):
                groups.setdefault(one(p), []).append(p)
        for mine in groups.values():
            values = [other(p) for p in mine]
            top = max(values.count(v) for v in values)
            if len(set(values)) > 1:
                assert 2 * top <= len(mine) or sum(values.count(v) == top for v in set(values)) == 1
                bad |= {p for p, v in zip(mine, values, strict=True) if 2 * top <= len(mine) or values.count(v) != top}
    return bad


def contaminated(text: str, item: str, items: list[str], size: int = 8, cover: float = 0.5, share: float = 0.9, run: int = 30, many: int = 2) -> bool:
    """Whether a document of one line holds an item of `size` tokens at least, whole or re-parameterised. items: the
    benchmark's texts, the item among them; windows that more than `many` share don't count."""
    d, b, all_items = _tokens(text), _tokens(item), [_tokens(x) for x in items]
    fit = lambda row, at, k, n=size: 2 * sum(t[k][0] == "=" if k < 2 else t[0][0] == "=" or t[0] == "NAME" for t in row[at : at + n]) >= n
    key = lambda row, at, k, n=size: tuple(t[k] for t in row[at : at + n])
    eligible = []
    for k in range(3):
        has = [{key(x, j, k) for j in range(len(x) - size + 1) if fit(x, j, k)} for x in all_items]
        mine = {j for j in range(len(b) - size + 1) if fit(b, j, k)}
        eligible.append({j for j in mine if sum(key(b, j, k) in h for h in has) <= many} or mine)
    spans = lambda js: {p for j in js for p in range(j, j + size)}
    counted = spans(j for e in eligible for j in e)
    own = counted - spans(mine - eligible[2])
    own = own if len(own) >= 8 else counted or set(range(len(b)))
    kept, equal, tokens, longest = set(), set(), set(), 0
    for shift in range(-len(b), len(d)):
        hit = [{j for j in e if 0 <= j + shift <= len(d) - size and key(b, j, k) == key(d, j + shift, k)} for k, e in enumerate(eligible)]
        good = set(hit[2])
        for k in (0, 1):
            slots = sorted({p for j in hit[k] for p in range(j, j + size) if b[p][k][0] != "="})
            ours, theirs = (lambda p: b[p][2]), (lambda p, s=shift: d[p + s][2])
            bad = _bad_slots(slots, [(ours, theirs, lambda p: True), (theirs, ours, lambda p, k=k: b[p][k] in ("NAME", "UNIT"))])
            good |= {j for j in hit[k] if bad.isdisjoint(range(j, j + size))}
        if good:
            held = sorted({p for j in good for p in range(j, j + size)})
            kept |= good
            equal |= hit[2]
            tokens |= set(held) | {p for p in range(len(b)) if 0 <= p + shift < len(d) and b[p][2] == d[p + shift][2]}
            stretch = 1
            for x, y in zip(held, held[1:], strict=False):
                longest = max(longest, stretch)
                stretch = stretch + 1 if y == x + 1 else 1
            longest = max(longest, stretch)
    shares = [len(m & e) / len(e) for m, e in ((kept, eligible[0] | eligible[1]), (equal, eligible[2])) if e]
    if kept and (max(shares) >= cover or len(tokens & own) >= share * len(own) or longest >= run):
        return True
    return _aligned(d, b, all_items, own, share, many)


def _aligned(d, b, all_items, own, share, many, seed: int = 4, gap: int = 2, least: float = 0.7) -> bool:
    fit = lambda row, at: 2 * sum(t[0][0] == "=" or t[0] == "NAME" for t in row[at : at + seed]) >= seed
    key = lambda row, at: tuple(t[2] for t in row[at : at + seed])
    has = [{key(x, j) for j in range(len(x) - seed + 1) if fit(x, j)} for x in all_items]
    rare = {j for j in range(len(b) - seed + 1) if fit(b, j) and sum(key(b, j) in h for h in has) <= many}
    for shift in range(-len(b), len(d)):
        seeds = [j for j in rare if 0 <= j + shift <= len(d) - seed and key(b, j) == key(d, j + shift)]
        if not seeds or max(seeds) - min(seeds) < seed:
            continue
        place = [p for p in range(len(b)) if 0 <= p + shift < len(d)]
        same = {p for p in place if b[p][2] == d[p + shift][2]}
        slots, run = [], []
        for p in [*place, None]:
            if p is not None and p not in same:
                run.append(p)
                continue
            if run and len(run) <= gap and run[0] > place[0] and p is not None:
                slots += run
            run = []
        ours, theirs = (lambda p: b[p][2]), (lambda p, s=shift: d[p + s][2])
        bad = _bad_slots(slots, [(ours, theirs, lambda p: True), (theirs, ours, lambda p: b[p][0] != "NUM")])
        good = same | (set(slots) - bad)
        if len(same) >= least * len(b) and len(same & own) >= least * len(own) and len(good & own) >= share * len(own):
            return True
    return False
