"""Sharding, mixing, URL filter and chat formatting on small and odd inputs."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from millwatch.llm import chat, mixing, sharding, urls
from millwatch.llm import queries as Q
from tests.llm.brute import targets

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    got = Q.queries()[name](spark, SF).toPandas()
    want = con.sql(Q.oracle_sql()[name]).df()[list(got.columns)]
    by, none = [got.columns[0]], lambda v: None if v is None or v != v else v
    a, b = ([[none(v) for v in r] for r in x.sort_values(by).astype(object).values.tolist()] for x in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(u == v or isinstance(u, float) and abs(u - v) < 1e-6 * max(1, abs(v)) for u, v in zip(x, y, strict=True)), (x, y)


def test_slots_are_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    a = sharding.claim_slots(names, 1009)
    counts = [a.count(k) for k in range(10)]
    assert max(counts) - min(counts) <= 1
    b = sharding.claim_slots(names[:-1], 1009)
    kept = sum(x == y for x, y in zip(a, b, strict=True) if x != 9)
    assert kept > 0.8 * (1009 - counts[9])
    for bad in ([], ["x", "x"]):
        with pytest.raises(ValueError):
            sharding.claim_slots(bad, 101)
    with pytest.raises(ValueError):
        sharding.claim_slots(["x"], 100)


def test_sharding_odd_rows(spark):
    df = spark.createDataFrame([(None, f"t{i}") for i in range(200)] + [(1, "a"), (1, "a")], "doc_id long, text string").withColumn("owner", F.lit(1))
    got = sharding.assign_shards(df, ["doc_id"], ["a", "b", "c"], 101).collect()
    assert len(got) == 202 and len({r["shard"] for r in got if r["doc_id"] is None}) == 3
    assert len({r["shard"] for r in got if r["doc_id"] == 1}) == 1
    assert sharding.assign_shards(df.withColumns({"Slot": F.lit("x"), "_s": F.lit(1)}), ["doc_id"], ["a"], 101).columns == ["doc_id", "text", "owner", "_s", "slot", "shard"]
    assert sharding.assign_shards(df.limit(0), ["doc_id"], ["a"], 101).count() == 0


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "c", "d", "é", None, "hot", "hot", "hot"]), r.randint(0, 50)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("w", F.lit(1))
    got = mixing.mix(df, bins=16).collect()
    again = mixing.mix(df.repartition(11), bins=256).collect()
    key = lambda x: (x["doc_id"], x["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    sizes: dict = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    taken: dict = {}
    for x in got:
        assert abs(x["target"] - want[x["source"]]) < 1e-6 * max(1, want[x["source"]]) and x["source_size"] == sizes[x["source"]]
        assert x["taken"] == x["copies"] * x["size"] <= 3 * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - want[s]) <= 50 for s in sizes)


def test_mixing_unequal_and_odd(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", 10, float(i % 5)) for i in range(400)], "doc_id long, source string, size long, quality double")
    got = mixing.mix(df, weights=(1.0, 9.0), most=1.0, appeal="quality").collect()
    mean = lambda want: sum(x["quality"] for x in got if x["source"] == "b" and (x["taken"] > 0) == want) / max(1, sum(x["source"] == "b" and (x["taken"] > 0) == want for x in got))
    assert abs(sum(x["taken"] for x in got) - sum({x["source"]: x["target"] for x in got}.values())) <= 20 and mean(True) >= mean(False)
    odd = spark.createDataFrame([(1, None, None), (1, None, 0), (None, "x", 5), (None, "x", 5), (2, "x", 0)], "doc_id long, source string, size long")
    got = mixing.mix(odd).collect()
    assert len(got) == 5 and all(x["copies"] == 1 for x in got if x["size"])
    assert mixing.mix(odd.limit(0)).count() == 0
    clash = mixing.mix(odd.withColumns({"Taken": F.lit("a"), "_size": F.lit(7), "in0": F.lit(3)}))
    assert clash.columns == ["doc_id", "source", "size", "_size", "in0", "source_size", "target", "copies", "taken"] and {r["_size"] for r in clash.collect()} == {7}
    with pytest.raises(ValueError):
        mixing.mix(odd, bins=100)


@pytest.mark.parametrize("sizes", [{"a": 501, "b": 200, "c": 100}, {"a": 500, "b": 200, "c": 100}, {"a": 100, "b": 100, "c": 100}, {"a": 7}, {"a": 0, "b": 90, None: 30}, {"a": 0}, {"a": 5, "b": 1000, "c": 2, "d": 2, "e": 900}])
@pytest.mark.parametrize("weights", [(5.0, 2.0, 1.0), (1.0,), (1.0, 2.0)])
def test_targets_tied(spark, sizes, weights):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df, weights).collect()}
    want = targets(sizes, weights)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) and 0 <= got[s] <= 3 * sizes[s] for s in sizes)
    assert abs(sum(got.values()) - sum(sizes.values())) < 1e-6 * max(1, sum(sizes.values()))


def test_bins_cut_again(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_ORDERED", 20)
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0], 1 + i % 7) for i in range(3000)], "doc_id long, source string, size long")
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(df, bins=2).collect()}
    assert got == {r["doc_id"]: r["taken"] for r in mixing.mix(df, bins=4096).collect()}


def test_urls(spark):
    rules = Q.RULES
    given = {
        "http://Example.ORG/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
        "x://a.example.org/en/12?q": ("a.example.org", "/en/12", "example.org/en/1", "block"),
        "x://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "x://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "x://b.com": ("b.com", "", None, None),
        "x://b.org?x://c.com/de/": ("b.org", "", None, None),
        "no scheme/de/": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*given, *given])], "page_id long, url string").withColumns({"n": F.lit(1), "label": F.lit(2)})
    labelled = spark.createDataFrame([(f"http://casino-{i}.com/a?x={i}&y=2&z=3", 1.0) for i in range(60)] + [(f"https://news.net/{i}", 0.0) for i in range(60)], "url string, label double")
    got = urls.filter_urls(df, "url", rules, labelled).collect()
    assert len(got) == 2 * len(given)
    for r in got:
        host, path, rule, verdict = given[r["url"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    test = spark.createDataFrame([("http://casino-99.net/b?x=1&y=5&z=3",), ("https://news.net/777",)], "url string")
    assert [r["verdict"] for r in urls.filter_urls(test, "url", [], labelled).collect()] == ["block", "allow"]
    assert {r["verdict"] for r in urls.filter_urls(test, "url", [], labelled.limit(0)).collect()} == {"allow"}
    clash = urls.filter_urls(df.withColumns({"Host": F.lit(1), "_part": F.lit(9), "f_len": F.lit(2)}), "url", rules, labelled)
    assert clash.columns == ["page_id", "url", "n", "label", "_part", "f_len", "host", "path", "rule", "verdict", "score"] and clash.where("_part = 9 and f_len = 2").count() == 16
    assert urls.filter_urls(df.limit(0), "url", rules, labelled).count() == 0
    long = spark.createDataFrame([("x://a.org/" + "p" * 300000 + "?q",)], "url string")
    assert urls.filter_urls(long, "url", rules, labelled).first()["rule"] == "org/"


def test_many_rules_and_suffixes(spark, monkeypatch):
    """Rules by join and suffixes by salted join give what lists and broadcasts give."""
    pages = Q.table(spark, SF, "pages").select("page_id", "url")
    run = lambda: sorted(map(tuple, urls.filter_urls(pages, "url", Q.RULES, Q.labelled_urls(pages)).collect()))
    one = run()
    monkeypatch.setattr(urls, "MOST_RULES", 0)
    monkeypatch.setattr(urls, "MOST_BROADCAST", 0)
    assert [r[:-1] for r in run()] == [r[:-1] for r in one]


def test_url_rules_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('/root/testdata/sf0.01/pages.parquet')")
    rules = ", ".join(f"('{v}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}')" for v, r in Q.RULES)
    want = con.sql(f"""
        WITH r AS (SELECT * FROM (VALUES {rules}) t(v, h, p, rule)), s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        a AS (SELECT page_id, lower(regexp_extract(rest, '^[^/?#]*')) AS host, rest FROM s), b AS (SELECT page_id, host, regexp_extract(rest[length(host) + 1:], '^[^?#]*') AS path FROM a),
        m AS (SELECT b.*, rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k FROM b LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT page_id, host, path, rule, v FROM m WHERE k = 1 ORDER BY page_id""").fetchall()
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in Q.op8_urls(spark, "/root/testdata/sf0.01").orderBy("page_id").collect()]
    assert got == want


def test_url_accuracy(spark):
    """No URL is scored by trees or statistics that saw its label, so this is accuracy on unseen labels."""
    pages = Q.table(spark, "/root/testdata/sf0.1", "pages")
    got = urls.filter_urls(pages.select("page_id", "url"), "url", [], Q.labelled_urls(pages)).join(Q.labelled_urls(pages).distinct(), "url")
    ok = ((F.col("verdict") == "block") == (F.col("label") == 1)).cast("double")
    right, blocked, n = got.agg(F.avg(ok), F.avg(F.when(F.col("label") == 1, ok)), F.count("*")).first()
    print("held-out URL accuracy", right, "of blocked", blocked, "rows", n)
    assert n > 2000 and right > 0.9


def test_chat_contract(spark):
    rows = [tuple(r) for r in Q.table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    want = {}
    for c in {r[0] for r in rows}:
        turns = sorted(r[1:] for r in rows if r[0] == c)
        loss = "".join(t or "" for _, role, t in turns if role == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{role}\n{t or ''}\n" for _, role, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in Q.op7_chat(spark, SF).collect()}
    assert got == want


def test_chat_parts_and_odd_turns(spark):
    part = lambda kind, text=None, uri=None, tokens=None: (kind, text, uri, tokens)
    nasty = "<turn> a\n\\ </turn>\n # 😀 \\\\"
    rows = [
        (1, 0, "user", [part("text", "see "), part("image", uri="u1"), part("audio", uri="u2", tokens=9), part("text", nasty)]),
        (1, 1, "assistant", [part("text", nasty), part("pdf", uri="u3")]),
        (2, None, None, None),
        (2, 5, "r\n\\<", [part("text", None)]),
        (None, 1, "assistant", [part("text", "x" * 200000)]),
        (None, 1, "assistant", [part("text", "x")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>").withColumn("_turns", F.lit(1))
    out = {r["conv_id"]: r for r in chat.format_chats(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    one = out[1]
    assert [(a["type"], a["uri"], a["tokens"]) for a in one["attachments"]] == [("image", "u1", 576), ("audio", "u2", 9), ("document", "u3", 1024)] and one["attachment_tokens"] == 1609
    assert [(t["role"], t["text"]) for t in one["turns"]] == [("user", "see <image 1><audio 2>" + nasty), ("assistant", nasty + "<document 3>")]
    assert re.findall(r"(?<!\\)(?:\\\\)*(<(?:image|audio|document) \d+>)", one["formatted"]) == ["<image 1>", "<audio 2>", "<document 3>"]
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", ""), ("r\n\\<", "")] and out[2]["said"] == ""
    assert len(out[None]["said"]) == 200001
    assert chat.format_chats(df.limit(0)).count() == 0
