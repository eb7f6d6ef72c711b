"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwatch.llm import ann, chat, decontaminate, jaccard, langid, licenses, merkle, mixing, phrases, repeats, sharding, urls, whitening
from millwatch.llm.common import WORD, word_count

#: The shards of the query and the pipeline.
SHARDS = [f"shard-{i:03d}" for i in range(64)]
SLOTS = 65537
#: The rules of the URL query, as (verdict, host/path).
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
#: Host words that label a URL for training as blocked.
SPAM_WORDS = ["adult", "ads", "bets", "casino", "cheap", "farm", "free", "pills", "spam", "track", "win", "xxx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.assign_shards(docs, ["doc_id"], SHARDS, SLOTS)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return ann.nearest(e, e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document stands at source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.col("doc_id").cast("string"))
    return licenses.scan_licenses(docs.select("doc_id", path.alias("path"), "text"), key="doc_id")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), depth=100, digest=True)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = rows.unionByName(planted).withColumn("content", chat.text_part(F.col("text")))
    out = chat.format_chats(rows)
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss"))
    out = out.withColumns({"_turns": turns, "_loss": loss})
    digest = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "attachment_tokens",
    )


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, label) of the hosts whose names tell: block for hosts with a word of SPAM_WORDS, allow for the rest."""
    host = urls.host_of(F.col("url"))
    return pages.where("url is not null").select("url", F.when(host.rlike("(^|[.-])(" + "|".join(SPAM_WORDS) + ")([.-]|$)"), 1.0).otherwise(0.0).alias("label"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, "url", RULES, labelled_urls(pages)).select("page_id", "host", "path", "rule", "verdict", "score")


def language_model(docs: DataFrame) -> langid.Models:
    """Learned from text and lang of the documents that are not held out."""
    return langid.fit(docs.where(~langid.held_out(F.col("doc_id"))).select(F.col("doc_id").cast("string").alias("key"), "text", "lang"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.identify(asked, language_model(docs)).drop("text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    docs = docs.withColumn("appeal", mixing.length_appeal(F.col("size")))
    return mixing.mix(docs, appeal="appeal").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases A-Z of the texts that every_fifth() names."""
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered=merkle.every_fifth(F.col("doc_id")), tamper={"text": merkle.lower_case(F.col("text"))}).drop("position")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_phrases(table(spark, sf_dir, "documents"), window=50, digest=True)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sharding, op2_nearest, op3_licenses, op4_jaccard, op5_repeats, op6_decontaminate, op7_chat, op8_urls, op9_langid, op10_mixing, op11_merkle, op12_phrases, op13_whitening)}


def _q(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def op1_sql() -> str:
    owners = ",".join(map(str, sharding.claim_slots(SHARDS, SLOTS)))
    return f"""
    WITH owner AS (SELECT string_split('{owners}', ',') AS o, [{_q(SHARDS)}] AS names),
    placed AS (SELECT doc_id, source, n_chars, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) % {SLOTS} AS INTEGER) AS slot FROM documents)
    SELECT doc_id, source, n_chars, slot, names[CAST(o[slot + 1] AS INTEGER) + 1] AS shard FROM placed, owner"""


def op10_sql() -> str:
    """The level to which sources are filled is found from the words that each possible level would give."""
    weights = ", ".join(map(str, mixing.WEIGHTS))
    return f"""
    WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
    a AS (SELECT *, floor(sqrt(size::DOUBLE)) + 1 AS a FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size * a) AS appeal, [{weights}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w FROM a GROUP BY source),
    c AS (SELECT *, 3.0::DOUBLE * source_size AS cap FROM s), total AS (SELECT sum(source_size)::DOUBLE AS total FROM s),
    f AS (SELECT x.cap / x.w AS full_at, sum(least(y.cap, x.cap / x.w * y.w)) AS words FROM c x, c y GROUP BY x.source, x.cap, x.w),
    upto AS (SELECT min(full_at) AS full_at FROM f, total WHERE words >= total * (1 - 1e-12)),
    level AS (SELECT (total - coalesce(sum(cap) FILTER (cap / w < full_at), 0)) / sum(w) FILTER (cap / w >= full_at) AS level FROM c, upto, total GROUP BY total),
    t AS (SELECT source, source_size, appeal, least(cap, w * level) AS target FROM c, level),
    r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS INTEGER) ELSE 0 END AS whole FROM t),
    u AS (SELECT a.*, r.source_size, appeal, target, whole, target - whole * r.source_size AS rest, (CAST('0x' || substr(md5('11:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS v FROM a JOIN r ON a.source IS NOT DISTINCT FROM r.source),
    p AS (SELECT *, CASE WHEN appeal > 0 THEN least(greatest(a * rest / appeal, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE) ELSE 0.5::DOUBLE END AS p FROM u),
    k AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY v / (1 - v) * (1 - p) / p, CAST(doc_id AS VARCHAR), size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
    e AS (SELECT *, CASE WHEN size > 0 AND rest > 0 AND whole < 3 AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END AS extra FROM k)
    SELECT doc_id, source, size, source_size, target, CAST(whole + extra AS INTEGER) AS copies, CAST(size * (whole + extra) AS BIGINT) AS taken FROM e"""


def op2_sql() -> str:
    return """
    WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    p AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


def op7_sql() -> str:
    order = "ORDER BY turn NULLS FIRST, role, text"
    more = lambda c, marks: f"length({c}) - length(translate({c}, {marks}, ''))"
    marks = "'\\<#'"
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
      CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum({len(chat.OPEN) + 1 + len(chat.CLOSE)} + length(role) + {more("role", f"{marks} || chr(10)")} + length(text) + {more("text", marks)}) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attachment_tokens
    FROM c GROUP BY conv_id"""


def op3_sql() -> str:
    """Documents stand at source/lang/doc_id, so only a document's own directory can hold licence files."""
    rows = ", ".join(f"('{k}', '{v}')" for k, v in licenses.TEMPLATES.items())
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return f"""
    WITH tpl AS (SELECT * FROM (VALUES {rows}) v(name, line)), tc AS (SELECT name, t, count(*) AS c FROM (SELECT name, unnest({words.format("line")}) AS t FROM tpl) GROUP BY 1, 2),
    n AS (SELECT count(*) AS n FROM documents), df AS (SELECT t, count(*) AS n FROM (SELECT unnest(list_distinct({words.format("text")})) AS t FROM documents) WHERE t IN (SELECT t FROM tc) GROUP BY 1),
    idf AS (SELECT v.t, 1 + ln((1 + n.n) / (1 + coalesce(df.n, 0))::DOUBLE) AS idf FROM (SELECT DISTINCT t FROM tc) v LEFT JOIN df ON v.t = df.t, n),
    tw AS (SELECT name, tc.t, c * idf / sqrt(sum(c * idf * c * idf) OVER (PARTITION BY name)) AS w FROM tc JOIN idf ON tc.t = idf.t),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
    lc AS (SELECT doc_id, k, t, count(*) AS c FROM (SELECT doc_id, k, unnest({words.format("line")}) AS t FROM lines) GROUP BY 1, 2, 3),
    lw AS (SELECT doc_id, k, lc.t, c, c * coalesce(idf, 1 + ln(1 + n.n::DOUBLE)) AS v FROM lc LEFT JOIN idf ON lc.t = idf.t, n),
    ln AS (SELECT doc_id, k, sqrt(sum(v * v)) AS norm, sum(c) AS size FROM lw GROUP BY 1, 2), dt AS (SELECT doc_id, k, name, sum(v * w) AS dot FROM lw JOIN tw ON lw.t = tw.t GROUP BY 1, 2, 3),
    hit AS (SELECT dt.doc_id, dt.k, name, size, round(dot / norm, 9) AS score FROM dt JOIN ln ON dt.doc_id = ln.doc_id AND dt.k = ln.k WHERE dot / norm >= 0.7),
    one AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY score DESC, name) AS r FROM hit), said AS (SELECT doc_id, sum(size) AS said FROM one WHERE r = 1 GROUP BY 1),
    own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS q FROM one WHERE r = 1) WHERE q = 1),
    f AS (SELECT d.doc_id, coalesce(source, '-') || '/' || coalesce(lang, '-') AS dir, own.name AS own_license, own.score AS own_score,
      coalesce(said.said >= 0.5 * greatest(len({words.format("text")}), 1), false) AS is_license_file FROM documents d LEFT JOIN own ON d.doc_id = own.doc_id LEFT JOIN said ON d.doc_id = said.doc_id),
    sp AS (SELECT dir, own_license AS name FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY own_score DESC, own_license) AS q FROM f WHERE is_license_file) WHERE q = 1)
    SELECT doc_id, f.dir || '/' || CAST(doc_id AS VARCHAR) AS path, own_license, own_score, coalesce(own_license, sp.name) AS license, CASE WHEN own_license IS NULL AND sp.name IS NOT NULL THEN sp.dir END AS license_dir, is_license_file FROM f LEFT JOIN sp ON f.dir = sp.dir"""


def op11_sql(levels: int = 5, tops: int = 2) -> str:
    """For 16 ** levels rows a source and 16 ** tops sources at most. A group that is down to one node passes."""
    enc = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    crc = "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, CAST(i AS INTEGER), 1)) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
    run = lambda n, of, value: f"r{n} AS (SELECT g, p // 16 AS q, list({value} ORDER BY p) AS kids, any_value(m) AS m FROM {of} GROUP BY 1, 2), n{n} AS (SELECT g, q AS p, (m + 15) // 16 AS m, CASE WHEN m > 1 THEN sha256(array_to_string(kids, '')) ELSE kids[1] END AS d FROM r{n})"
    ctes = [run(1, "n0", "leaf"), *[run(k, f"n{k - 1}", "d") for k in range(2, levels + 1)]]
    ctes.append(f"t0 AS (SELECT '' AS g, g AS source, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS m, d FROM n{levels})")
    ctes += [run(f"t{k}", "t0" if k == 1 else f"nt{k - 1}", "d") for k in range(1, tops + 1)]
    folds, joins, sides = "e.seen", [], []
    steps = [(f"r{k}", "e.g", f"(e.p // {16 ** (k - 1)})") for k in range(1, levels + 1)] + [(f"rt{k}", "''", f"(t0.p // {16 ** (k - 1)})") for k in range(1, tops + 1)]
    for i, (t, g, p) in enumerate(steps):
        joins.append(f"JOIN {t} ON {t}.g = {g} AND {t}.q = {p} // 16")
        left, right = f"array_to_string({t}.kids[1:CAST({p} % 16 AS INTEGER)], '')", f"array_to_string({t}.kids[CAST({p} % 16 AS INTEGER) + 2:], '')"
        sides += [f"coalesce({left}, '') AS l{i}", f"coalesce({right}, '') AS x{i}", f"{t}.m AS m{i}"]
    path = [f"f0 AS (SELECT e.doc_id, e.leaf, e.seen AS f, t0.d AS subroot, {', '.join(sides)} FROM n0 e JOIN t0 ON t0.source = e.g {' '.join(joins)})"]
    for i in range(len(steps)):
        path.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN m{i} > 1 THEN sha256(l{i} || f || x{i}) ELSE f END AS f) FROM f{i})")
    proof = " || ".join(f"l{i} || x{i}" for i in range(len(steps)))
    return f"""
    WITH d AS (SELECT doc_id, coalesce('s' || source, 'n') AS g, {row("text")} AS leaf, CAST(doc_id AS VARCHAR) AS k, {row(f"translate(text, '{upper}', '{upper.lower()}')")} AS other FROM documents),
    n0 AS (SELECT doc_id, g, leaf, CASE WHEN k IS NOT NULL AND {crc} % 5 = 0 THEN other ELSE leaf END AS seen, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY g) AS m FROM d),
    {", ".join(ctes)}, top AS (SELECT d AS root FROM nt{tops}), {", ".join(path)}
    SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}, top"""


def op12_sql() -> str:
    """All windows by their words; a null id would be smaller than all others."""
    return """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
    win AS (SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    f AS (SELECT h, min(doc_id) AS doc FROM win GROUP BY 1), hit AS (SELECT r, i FROM win JOIN f ON win.h = f.h WHERE doc_id > f.doc),
    gone AS (SELECT DISTINCT r, i + k AS p FROM hit, range(0, 50) t(k)), words AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
    kept AS (SELECT words.r, string_agg(word, ' ' ORDER BY words.p) AS line, count(*) AS n FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY 1)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.r = kept.r"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": op1_sql(), "op3_licenses": op3_sql(), "op7_chat": op7_sql(), "op10_mixing": op10_sql(), "op11_merkle": op11_sql(), "op12_phrases": op12_sql()}
