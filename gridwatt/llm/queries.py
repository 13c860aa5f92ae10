"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import chat, decontaminate, embeddings, html_text, language, mixing, near_duplicates, repeats, secrets, spelling, token_counts, vector_codes, warc
from .common import stored

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _ORACLES[fn.__name__] = sql
        return fn
    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _span_list(kind: str, pattern: str, group: int, least: int, options: str = "") -> str:
    """DuckDB: spans of one pattern, by splitting the text at its matches."""
    return f"""SELECT doc_id, rn, '{kind}' AS kind, {['assign', 'access', 'hex', 'pem', 'github'].index(kind)} AS ord, s AS start_at, s + length(m[i]) AS end_at FROM (
        SELECT doc_id, rn, m, i, g[i] AS judged, CAST(COALESCE(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
            + COALESCE(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
          FROM (SELECT doc_id, rn, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {group}) AS g, regexp_split_to_array(t, {pattern}) AS gaps
            FROM docs), UNNEST(range(1, len(m) + 1)) AS u(i)) WHERE length(judged) >= {least}"""


_ASSIGN = "'((?i:password|passwd|secret|token|api_?key))[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)'"


@query(f"""WITH docs AS (SELECT doc_id, row_number() OVER () AS rn, COALESCE(text, '') AS t FROM documents),
    spans AS ({_span_list('assign', _ASSIGN, 2, 6)} UNION ALL {_span_list('access', "'AKIA[A-Z0-9]+'", 0, 20)}
      UNION ALL {_span_list('hex', "'[0-9a-f]{24,}'", 0, 24)}
      UNION ALL {_span_list('pem', "'-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----'", 0, 0)}
      UNION ALL {_span_list('github', "'gh[pousr]_[A-Za-z0-9]+'", 0, 40)})
    SELECT d.doc_id, COUNT(*) FILTER (kind = 'assign') AS n_assign, COUNT(*) FILTER (kind = 'access') AS n_access, COUNT(*) FILTER (kind = 'hex') AS n_hex,
      sha256(COALESCE(string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, ord) FILTER (ord < 3), '')) AS base_sha256,
      COALESCE(string_agg(kind || ':' || start_at || ':' || end_at, ',' ORDER BY start_at, ord), '') AS spans
    FROM docs d LEFT JOIN spans s ON d.rn = s.rn GROUP BY d.rn, d.doc_id""")
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    s = secrets.scan(_table(spark, folder, "documents"))
    kind = lambda *names: F.filter("found", lambda x: x["kind"].isin(*names))
    count = lambda name: F.size(kind(name)).cast("bigint").alias(f"n_{name}")
    return s.select("doc_id", count("assign"), count("access"), count("hex"),
                    F.sha2(secrets.joined(kind("assign", "access", "hex")), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


@query("""WITH sized AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size FROM documents),
    sums AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source),
    w AS (SELECT *, CAST(CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * SUM(source_size) OVER () AS total FROM sums),
    o AS (SELECT *, COALESCE(SUM(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
        SUM(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_from FROM w),
    c AS (SELECT *, cap / weight < (total - cap_before) / weight_from AS stops FROM o),
    l AS (SELECT *, (total - SUM(CASE WHEN stops THEN cap ELSE 0 END) OVER ()) / NULLIF(SUM(CASE WHEN stops THEN 0 ELSE weight END) OVER (), 0) AS level FROM c),
    t AS (SELECT source, source_size, CASE WHEN stops THEN cap ELSE LEAST(cap, weight * level) END AS target FROM l),
    b AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS BIGINT) AS base FROM t),
    p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.base, CAST(round(b.target) AS BIGINT) - b.base * b.source_size AS missing,
        COALESCE(SUM(d.size) OVER (PARTITION BY d.source ORDER BY md5(COALESCE(CAST(d.doc_id AS VARCHAR), '')), d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM sized d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target, CAST(base * size + GREATEST(0, LEAST(size, missing - before)) AS BIGINT) AS taken FROM p""")
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Words taken from every document so that sources meet their targets."""
    m = mixing.mix(_table(spark, folder, "documents"))
    return m.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


_LETTERS = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"COALESCE(regexp_extract_all({_LETTERS}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


@query(f"""WITH d AS (SELECT doc_id, row_number() OVER () AS rn, {_WORDS} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
    g AS (SELECT DISTINCT item, LEAST(len(w), 10) AS n, array_to_string(w[i:i + LEAST(len(w), 10) - 1], ' ') AS gram
      FROM b, UNNEST(range(1, len(w) - LEAST(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0),
    hit AS (SELECT d.rn, i, g.n, g.item FROM d, (SELECT DISTINCT n AS width FROM g), UNNEST(range(1, len(w) - width + 2)) AS u(i)
      JOIN g ON g.n = width AND array_to_string(w[i:i + width - 1], ' ') = g.gram),
    per AS (SELECT rn, COUNT(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rn),
    cover AS (SELECT rn, COUNT(DISTINCT p) AS n_hit FROM hit, UNNEST(range(i, i + n)) AS v(p) GROUP BY rn)
    SELECT doc_id, len(w) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN per USING (rn) LEFT JOIN cover USING (rn)""")
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of every document that benchmark windows cover."""
    c = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return c.select("doc_id", "n_words", F.size("hits").cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query()
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from those whose crc32 leaves another remainder than 1."""
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.fit(docs.filter(~held_out))
    out = language.predict(docs.drop("lang"), model)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query()
def op1_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Shingles and near-duplicate component of every document."""
    listed, label = near_duplicates.near_duplicates(_table(spark, folder, "documents"))
    out = listed.join(stored(label, "components"), listed["doc_id"] == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


@query()
def op5_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that lie in a repeated string of 400 bytes."""
    r = repeats.repeated_spans(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"])
    return r.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.col("sha").alias("kept_sha256"),
                    (F.size("spans") > 0).alias("has_repeats"))


@query()
def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    t = html_text.main_text(_table(spark, folder, "pages"))
    return t.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


_CHAT = """WITH t AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
    e AS (SELECT *, length(role) + len(regexp_extract_all(role, '[\\\\<>]')) AS r, length(text) + len(regexp_extract_all(text, '[\\\\<>]')) AS x FROM t)
    SELECT conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(COALESCE(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(SUM(r + x + 17) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""


@query(_CHAT)
def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation formatted, and what reads back from the output."""
    c = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit("\\### Assistant: </turn> ok").alias("text"))
    f = chat.format_chats(chat.linear_tree(c.unionByName(own)))
    f = f.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learnt", chat.loss_text(F.col("formatted"), F.col("loss")))
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return f.select("conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
                    F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
                    F.length("formatted").cast("bigint").alias("formatted_chars"))


@query()
def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return embeddings.near_embeddings(_table(spark, folder, "embeddings"))


@query("SELECT doc_id, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS n_tokens FROM documents")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document, found again in the flat streams that the documents were written to."""
    docs, folder = _table(spark, folder, "documents"), scratch_path(spark, "tokens")
    if token_counts.mounted(spark, folder):
        told = stored(token_counts.write_files(docs, folder), "told")
        flat = token_counts.read_flat(spark, folder, 2)
        counts = token_counts.scan(flat.withColumn("file", F.regexp_extract("file", r"(\d+)\.bin$", 1).cast("long")))
    else:  # a store that only Spark writes to holds the blocks as rows
        flat = stored(token_counts.write_flat(docs), "flat")
        told, counts = flat.filter("doc_no is not null"), token_counts.scan(flat.filter("tokens is not null"))
    return told.select("file", "doc_no", "doc_id").join(counts, ["file", "doc_no"]).select("doc_id", "n_tokens")


_CRC_ROW = "list_reduce(list_concat([CAST(b AS BIGINT)], range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
_VARIANTS = f"""WITH RECURSIVE crc AS (SELECT list({_CRC_ROW} ORDER BY b) AS t FROM range(256) AS r(b)),
    runs AS (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    counted AS (SELECT id, run, COUNT(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
    hashed AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(1, length(hex(id || ':' || run)), 2),
        lambda i: CAST('0x' || substr(hex(id || ':' || run), i, 2) AS BIGINT))), lambda c, b: xor(t[1 + xor(c % 256, b)], c // 256))) AS h FROM counted, crc),
    vocab AS (SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
        FROM hashed) WHERE length(word) >= 7 GROUP BY 1 HAVING SUM(n) >= 2),
    cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM vocab, UNNEST(range(1, length(word) + 1)) AS u(i)),
    pairs AS (SELECT a.word AS word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT c.word, v.word, v.n FROM cut c JOIN vocab v ON c.rest = v.word UNION SELECT v.word, c.word, c.n FROM cut c JOIN vocab v ON c.rest = v.word),
    best AS (SELECT word, COUNT(*) AS n_near, MAX(other_n) AS top FROM pairs GROUP BY 1),
    form AS (SELECT p.word, MIN(p.other) AS form FROM pairs p JOIN best b ON b.word = p.word AND p.other_n = b.top GROUP BY 1),
    told AS (SELECT v.word, v.n, COALESCE(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN f.form END AS form, CASE WHEN top >= 10 * v.n THEN top END AS form_n
      FROM vocab v LEFT JOIN best b ON b.word = v.word LEFT JOIN form f ON f.word = v.word),
    walk AS (SELECT word, word AS at FROM told UNION ALL SELECT w.word, t.form FROM walk w JOIN told t ON t.word = w.at WHERE t.form IS NOT NULL),
    last AS (SELECT w.word, w.at AS root FROM walk w JOIN told t ON t.word = w.at WHERE t.form IS NULL)
    SELECT word, n, n_near, form, form_n, root FROM told JOIN last USING (word)"""


@query(_VARIANTS)
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of all documents, the frequent word each varies and the root of that chain. Where the hash says so, a run loses a letter first."""
    runs = spelling.letter_runs(_table(spark, folder, "documents"), least=7)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


_BASE32 = " || ".join(f"translate(to_base(CAST('0x' || substr(h, {i}, 10) AS BIGINT), 32, 8), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')" for i in (1, 11, 21, 31))


@query(f"""WITH p AS (SELECT page_id, octet_length(encode(COALESCE(html, ''))) AS n, sha1(COALESCE(html, '')) AS h FROM pages),
    t AS (SELECT *, MAX(page_id) OVER (PARTITION BY h, n) AS top FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to FROM t""")
def op12_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives, each looked up in the capture index and read back from its range."""
    pages, at = _table(spark, folder, "pages").select("page_id", "url", "html"), scratch_path(spark, "warc")
    index = warc.build_index(warc.write_archives(pages, at), at)
    found = warc.fetch(spark, pages.select(warc.capture_key().alias("capture")), index, at, at)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _codes_sql() -> str:
    """DuckDB: the rounds written out; a part is a list of whole numbers, exact in doubles."""
    far = "list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    assign = f"""SELECT vec_id, rn, label, pos, x, entry, far FROM (SELECT p.*, b.entry, {far} AS far, row_number() OVER (PARTITION BY p.rn, p.pos ORDER BY {far}, b.entry) AS k
      FROM part p JOIN {{book}} b ON b.pos = p.pos) WHERE k = 1"""
    sql = """WITH kept AS (SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn FROM embeddings
      WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
    whole AS (SELECT vec_id, label, rn, list_transform(embedding, lambda v: floor(1024 * CAST(v AS DOUBLE))) AS v FROM kept WHERE len(embedding) = (SELECT len(embedding) FROM kept WHERE rn = 1)),
    part AS MATERIALIZED (SELECT vec_id, label, rn, pos, v[pos * len(v) // 4 + 1:(pos + 1) * len(v) // 4] AS x FROM whole, UNNEST(range(4)) AS u(pos)),
    b0 AS (SELECT pos, dense_rank() OVER (ORDER BY rn) - 1 AS entry, x FROM part WHERE rn IN (SELECT rn FROM whole ORDER BY rn LIMIT 256))"""
    for i in range(4):
        sql += f""",
    a{i} AS MATERIALIZED ({assign.format(book=f"b{i}")}),
    m{i} AS (SELECT pos, entry, list(m ORDER BY j) AS x FROM (SELECT pos, entry, j, floor(SUM(x[j]) / COUNT(*)) AS m FROM a{i}, UNNEST(range(1, len(x) + 1)) AS u(j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    b{i + 1} AS MATERIALIZED (SELECT b.pos, b.entry, COALESCE(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.pos = b.pos AND m.entry = b.entry)"""
    return sql + f""",
    coded AS ({assign.format(book="b4")}),
    told AS (SELECT rn, vec_id, label, string_agg(lower(to_base(entry, 16, 2)), '' ORDER BY pos) AS code, CAST(SUM(far) AS BIGINT) AS error FROM coded GROUP BY 1, 2, 3)
    SELECT vec_id, code, error, CAST(SUM(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
      (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY pos, entry)) FROM b4) AS codebooks_sha256 FROM told"""


@query(_codes_sql())
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product codes of all embeddings after four rounds, with their errors."""
    return vector_codes.compress(_table(spark, folder, "embeddings"))
