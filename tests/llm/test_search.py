"""Nearest neighbours, decontamination, language identification and the pipeline."""

import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millwatch.llm import ann, decontaminate, langid
from millwatch.llm import queries as Q
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def exact(vectors, k=10):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids])
    out = {}
    for i in ids:
        if i % 100 == 0:
            d = np.sqrt(((x - vectors[i]) ** 2).sum(1))
            out[i] = [(j, s) for s, j in sorted((s, j) for s, j in zip(d.tolist(), ids, strict=True) if j != i)[:k]]
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def ranked(df):
    out: dict = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    e = Q.table(spark, "/root/testdata/sf0.1", "embeddings")
    want = exact({r[0]: np.array(r[1], dtype=float) for r in e.select("vec_id", "embedding").collect()})
    got = ranked(Q.op2_nearest(spark, "/root/testdata/sf0.1"))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    print("recall", recall(got, want))
    assert recall(got, want) >= 0.95
    con = duckdb.connect()
    con.execute("create view embeddings as select * from read_parquet('/root/testdata/sf0.1/embeddings.parquet')")
    plain: dict = {}
    for q, _, v, d in con.sql(Q.op2_sql() + " ORDER BY query_id, rank").fetchall():
        plain.setdefault(q, []).append((v, d))
    assert {q: [v for v, _ in x] for q, x in plain.items()} == {q: [v for v, _ in x] for q, x in want.items()}
    exact_score = {(q, v): d for q, x in plain.items() for v, d in x}
    assert all(abs(d - exact_score[q, v]) < 1e-9 for q, x in got.items() for v, d in x if (q, v) in exact_score)


def test_vectors_odd(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 64)
    monkeypatch.setattr(ann, "QUERIES", 2)
    r = np.random.default_rng(0)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(300, 700)]
    rows += [(700, None), (701, [0.0] * 8), (702, [1.0, None, *[1.0] * 6]), (703, [float("nan")] * 8), (704, [float("inf")] * 8), (800, [1.0] * 4), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"entry": F.lit(1), "list": F.lit(2)})
    ask = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"))
    got, want = ranked(ann.nearest(df, ask, visit=1.0)), exact({i: np.array(v) for i, v in rows[:700]})
    assert {q: [j for j, _ in v] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q], strict=True))
    few = ranked(ann.nearest(df.where("vec_id < 4"), ask))
    assert [len(v) for v in few.values()] == [3]
    assert ann.nearest(df.limit(0), ask).count() == 0


def test_decontamination(spark, monkeypatch):
    item = "A train leaves Berlin at 9 and covers 120 km in 2 hours. What speed in km did the train of Berlin keep at 9 on its way to the sea?"
    twin = "A train leaves Madrid at 7 and covers 360 miles in 4 hours. What speed in miles did the train of Madrid keep at 7 on its way to the sea?"
    off = "A train leaves Madrid at 7 and covers 360 miles in 4 hours. What speed in km did the train of Oslo keep at 8 on its way to the sea?"
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)) + ". "
    docs = [(1, filler + item + " " + filler), (2, filler + twin), (3, off), (4, filler), (5, None), (6, ""), (7, item[:40]), (8, item), (8, item), (None, item), (9, (filler * 300) + item), (10, "“HELLO” there (world)!"), (11, "hello there world again"), (12, filler + " ".join(f"\"'((**{w}**))'\"," for w in item.split()))]
    bench = spark.createDataFrame([(1, item), (2, "Too short."), (3, None), (4, "only five words are here"), (5, "Hello there, world")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1))
    got = sorted((str(r["doc_id"]), r["item_id"], r["changed_slots"] > 0) for r in decontaminate.find_contamination(df, bench).collect())
    assert got == sorted([("1", 1, False), ("2", 1, True), ("8", 1, False), ("8", 1, False), ("None", 1, False), ("9", 1, False), ("10", 5, False), ("12", 1, False)])
    assert sorted(str(r["doc_id"]) for r in decontaminate.find_contamination(df, bench, block=8).collect()) == sorted(x for x, *_ in got)
    assert decontaminate.find_contamination(df, bench.limit(0)).count() == 0
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0


def test_partial_contamination(spark):
    """One slot, half an item, scattered words and another case; a shared phrase alone is none."""
    two = "At the old harbour 12 boats were painted by the guild while another 12 boats waited on the quiet northern shore."
    pair = "A shop sells 3 large baskets of ripe fruit each morning and 5 small baskets of dried herbs each evening."
    long = " ".join(f"term{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    named = "Every summer Anna Berg and Carl Dahl walk from Lund to Malmo with Eva Falk and then return from Malmo to Lund by train."
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100)) + ". "
    words = long.split()
    docs = [
        (1, filler + two.replace("another 12", "another 13")),
        (2, filler + pair.replace("3 large", "4 large").replace("5 small", "4 small")),
        (3, filler + " ".join(words[10:40])),
        (4, filler + " ".join("other" if i % 12 == 5 else w for i, w in enumerate(words))),
        (5, filler + named.lower()),
        (6, filler + named.upper()),
        (7, filler + " ".join(words[10:22]) + " " + filler),
        (8, filler),
    ]
    bench = spark.createDataFrame([(1, two), (2, pair), (3, long), (4, named)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 3), (5, 4), (6, 4)}


def twins(seed, n):
    """(item, re-parameterised copy) pairs: other numbers, names (also at a sentence's begin, also beyond ASCII), units."""
    r = random.Random(seed)
    names, units = "Anna Boris Émile Österby Carla Dmitri Özlem Erik Fatima Gustav".split(), "km miles kg gram liters hours".split()
    nouns = "boxes apples tickets letters stones bottles".split()
    out = []
    for i in range(n):
        a, b = r.sample(names, 2), r.sample(names, 2)
        u, v = r.choice(units), r.choice(units)
        noun, k = r.choice(nouns), i % 3
        make = lambda x, unit, n1, n2: [
            f"{x[0]} has {n1} {noun} in the green cellar and gives half of them to {x[1]} before the rain begins. {x[1]} then carries {n2} {unit} of flour up the hill for case {i}.",
            f"Every morning {x[0]} rides {n1} {unit} along the river while {x[1]} counts {n2} {noun} on the wooden table. How many {noun} does {x[1]} have after {n1} days of case {i}?",
            f"{x[0]} and {x[1]} share {n1} {noun} so that each keeps an equal part, and {x[0]} loses {n2} on the road home. Who of them holds more {noun} in case {i}?",
        ][k]
        out.append((make(a, u, r.randint(3, 50), r.randint(51, 99)), make(b, v, "seven" if i % 4 == 0 else r.randint(3, 50), r.randint(51, 99))))
    return out


def test_twins(spark):
    """Re-parameterised questions are found, and found by a plain version; prose isn't."""
    pairs = twins(1, 24)
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)) + ". "
    docs = [(i, filler + twin + " " + filler) for i, (_, twin) in enumerate(pairs)] + [(1000 + i, filler) for i in range(5)]
    bench = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(pairs)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    found = sum((i, i) in got for i in range(len(pairs))) / len(pairs)
    print("recall of re-parameterised items", found)
    assert found >= 0.9 and all(d < 1000 for d, _ in got)
    want = {(d, i) for d, t in docs for i, (item, _) in enumerate(pairs) if brute.contaminated(t, item, [x for x, _ in pairs])}
    assert got == want


#: An item and a twin with other number words, in the languages of the documents, one whose number words no list holds,
#: and two scripts without spaces.
LANGUAGES = {
    "en": ("Only one of the ships left the old harbour before the storm and one sailor watched it from the tower until night.", "Only four of the ships left the old harbour before the storm and four sailor watched it from the tower until night."),
    "de": ("Der Zug fährt um neun Uhr im Hafen ab und erreicht nach zwei Stunden die alte Stadt am Fluss. Wie weit ist der Weg?", "Der Zug fährt um sieben Uhr im Hafen ab und erreicht nach vier Stunden die alte Stadt am Fluss. Wie weit ist der Weg?"),
    "fr": ("Le marchand vend trois paniers de pommes chaque matin et garde cinq paniers de noix pour le soir au village voisin.", "Le marchand vend huit paniers de pommes chaque matin et garde quatre paniers de noix pour le soir au village voisin."),
    "es": ("La abuela compra siete cartas de papel en la tienda azul y manda dos cartas largas a su hermana del norte.", "La abuela compra nueve cartas de papel en la tienda azul y manda seis cartas largas a su hermana del norte."),
    "sv": ("Bonden säljer tre korgar med äpplen varje morgon och sparar fem korgar med nötter till kvällen i den lilla byn.", "Bonden säljer åtta korgar med äpplen varje morgon och sparar fyra korgar med nötter till kvällen i den lilla byn."),
    "zh": ("一辆火车九点离开北方的城市，两小时以后到达海边的小镇。请问这辆火车每小时走多少公里的路？", "一辆火车七点离开北方的城市，四小时以后到达海边的小镇。请问这辆火车每小时走多少公里的路？"),
    "ja": ("この列車は朝の九時に北の町を出て二時間で海の近くの村に着きます。列車の速さはどれだけですか。", "この列車は朝の七時に北の町を出て四時間で海の近くの村に着きます。列車の速さはどれだけですか。"),
}


def test_languages_and_scripts(spark):
    """Verbatim copies and twins, with and without a space before them, beside text that holds neither."""
    bench = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(LANGUAGES.values())], "item_id long, text string")
    filler = "其他的文字写在这里没有什么意思只是为了填满这一页的空白。 " + " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + ". "
    docs, want = [(0, filler)], set()
    for i, (item, twin) in enumerate(LANGUAGES.values()):
        for k, text in enumerate((filler + item, filler.strip() + item + filler, filler + twin + " " + filler)):
            docs.append((10 * (i + 1) + k, text))
            want.add((10 * (i + 1) + k, i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want


def test_shared_preamble(spark):
    """Items that begin alike: a document with the preamble alone is no finding, one with a question is one, and the time
    doesn't grow with the items."""
    preamble = "Read the following question with care and answer it with one word only as shown in the lines above."
    filler = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) + ". "
    took = {}
    for n in (10, 200, 1600):
        r = random.Random(n)
        items = [f"{preamble} " + " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(9)) for _ in range(n)]
        held = decontaminate.Items(list(range(n)), items, 8)
        texts = [(filler + (preamble + " ") * 20 + filler).encode(), (filler + items[3]).encode(), (filler + items[3].removeprefix(preamble) + " " + filler).encode()]
        data, offs = np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        began = time.time()
        for _ in range(5):
            found = decontaminate.search(held, data, offs, 0.5, 0.9, 30)
        took[n] = time.time() - began
        assert {x[:2] for x in found} == {(1, 3), (2, 3)}
    assert took[1600] < 3 * took[10] + 0.2


def test_planted_passages(spark):
    docs = [tuple(r) for r in Q.table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in Q.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    norm = lambda t: " ".join(w.strip(".,!?;:").lower() for w in (t or "").split())
    want = {d for d, t in docs for _, b in items if f" {' '.join(norm(b).split()[1:-1])} " in f" {norm(t)} "}
    got = {r[0] for r in Q.op6_decontaminate(spark, SF).select("doc_id").collect()}
    assert want <= got and len(got - want) <= 1


def test_language_held_out(spark):
    docs = Q.table(spark, SF, "documents")
    got = Q.op9_langid(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 150 and right > 0.97
    assert got.where("rejected").count() <= 0.01 * got.count()


def test_language_odd(spark, monkeypatch):
    docs = Q.table(spark, SF, "documents")
    model = Q.language_model(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !!"), (4, "the and of the with that this " * 30000), (5, "ъжщы ююя " * 80), (5, "ъжщы ююя " * 80), (6, "\U00030000\U00030001 " * 30)], "doc_id long, text string").withColumns({"lang": F.lit("xx"), "Score": F.lit("s"), "_n": F.lit(1)})
    out = langid.identify(odd, model)
    assert out.columns == ["doc_id", "text", "lang", "_n", "lang_pred", "score", "rejected"]
    got = {r["doc_id"]: (r["lang_pred"], r["rejected"]) for r in out.collect()}
    assert all(got[k] == ("und", True) for k in (1, 2, 3)) and got[4] == ("en", False) and got[5][1] and got[6][1]
    assert langid.identify(odd.limit(0), model).count() == 0
    # marks alone are no letters: emoji with selectors, keycaps, lone accents; with a letter they are part of the text
    bare = ["\u2764\ufe0f 12 \u2600\ufe0f 1\ufe0f\u20e3", "1\u20e3 2\u20e3", "\u0301 \u0308\u0300", "\u0903 \u20dd", "42", "\u00b2 \u00bd \u2167", "-\n\t_"]
    marks = spark.createDataFrame([*enumerate(bare), (100, "e\u0301"), (101, "\u2764\ufe0f a")], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"], r["rejected"]) for r in langid.identify(marks, model).collect()}
    assert all(got[k] == ("und", 0.0, True) for k in range(len(bare))) and got[100][0] != "und" and got[101][0] != "und"
    none = langid.fit(docs.limit(0).select(F.lit("k").alias("key"), "text", "lang"))
    assert {r["lang_pred"] for r in langid.identify(odd, none).collect()} == {"und"}
    # a language a block gives what one block gives
    some = docs.limit(200)
    one = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in langid.identify(some, model).collect()}
    monkeypatch.setattr(langid, "MODEL_BYTES", 1)
    assert len(model.blocks()) == 4
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in langid.identify(some, model).collect()} == one


def test_language_noise(spark):
    """A mislabelled text doesn't widen the room; a language with one row is learned; more than 200 languages are."""
    docs = Q.table(spark, SF, "documents").select(F.col("doc_id").cast("string").alias("key"), "text", "lang")
    r = random.Random(4)
    babble = lambda: " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(120))
    noise = spark.createDataFrame([(f"n{i}", babble(), "en") for i in range(4)] + [("one", "ъжщы ююя " * 50, "zz")], "key string, text string, lang string")
    model = langid.fit(docs.unionByName(noise))
    ask = spark.createDataFrame([(1, babble()), (2, "ъжщы ююя " * 30)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.identify(ask, model).collect()}
    assert got[1]["rejected"] and got[2]["lang_pred"] == "zz" and not got[2]["rejected"]
    many = spark.createDataFrame([(f"k{i}", "".join(chr(0x4E00 + 40 * i + j % 40) for j in range(60)), f"l{i:03d}") for i in range(230)], "key string, text string, lang string")
    assert langid.fit(many).table.count() == 230


def plain_kneser_ney(text):
    """Bits of each character of a text by interpolated Kneser-Ney of order 4, from the definition."""
    line = "\1\1\1" + text
    count = [{} for _ in range(5)]
    for i in range(3, len(line)):
        g = line[i - 3 : i + 1]
        count[4][g] = count[4].get(g, 0) + 1
    for n in (3, 2, 1):
        for g in count[n + 1]:
            count[n][g[1:]] = count[n].get(g[1:], 0) + 1
    size = len(count[1]) + 1
    discount = [0.0] * 5
    for n in range(1, 5):
        ones, twos = max(1, sum(v == 1 for v in count[n].values())), sum(v == 2 for v in count[n].values())
        discount[n] = min(0.95, max(0.05, ones / (ones + 2 * twos)))

    def p(g):
        if not g:
            return 1 / size
        n = len(g)
        mine = {k: v for k, v in count[n].items() if k[:-1] == g[:-1]}
        if not mine:
            return p(g[1:])
        total = sum(mine.values())
        return max(mine.get(g, 0) - discount[n], 0) / total + discount[n] * len(mine) / total * p(g[1:])

    return p


def test_kneser_ney():
    r = random.Random(1)
    text = "".join(r.choice("abcde ") for _ in range(400)).replace("  ", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    _, chars = langid.grams(data, np.array([0, len(data)]))
    ids, some = langid._distinct(chars)
    model = langid.fit_model(some, np.bincount(ids))
    p = plain_kneser_ney(text)
    asked = ["abcd", "\1\1\1a", "zzzz", "ab z", *{"".join(map(chr, g)) for g in zip(*(c[:40].tolist() for c in chars), strict=True)}]
    got = langid.surprise(model, [np.array([ord(g[k]) for g in asked], dtype=np.uint64) for k in range(4)])
    assert all(abs(x + np.log2(p(g))) < 1e-9 for x, g in zip(got, asked, strict=True))
    for context in ("abc", "e a", "zzz"):
        bits = langid.surprise(model, [np.array([ord(c)] * 7, dtype=np.uint64) for c in context] + [np.array([ord(c) for c in "abcde z"], dtype=np.uint64)])
        assert abs(np.exp2(-bits).sum() - 1) < 1e-3
