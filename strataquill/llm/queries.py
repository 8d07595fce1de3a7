"""The queries ``opN_<name>``: thin projections of the operators onto the columns of their contracts."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataquill.llm import bpe, chat, codes, embeddings, exact_dedup, langid, licenses, ngram_join, packing, repeats, runs, secrets, warc
from strataquill.session import ship, spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; every node has it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ship(spark)
    return bpe.round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.join(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir), words=secrets.vocabulary_words(vocabulary("word_bpe_49k.json")))
    return found.select("doc_id", "place", "start", "length", F.sha2("value", 256).alias("value_sha256"), "score", "secret")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(packing.pieces(documents(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return licenses.scan(documents(spark, sf_dir)).drop("spans")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    out = chat.format_chats(told.unionByName(extra))
    turns, loss = chat.read_turns(F.col("formatted")), chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    read = out.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss"))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = documents(spark, sf_dir)
    found = langid.predict(docs, langid.sample(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found, _ = codes.compress(spread(table(spark, sf_dir, "embeddings")))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """The words of a document, made periodic from some word on for one in ten ids."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    found = runs.find_runs(documents(spark, sf_dir), change=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    told = found.withColumns({"best": best, "lines": F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))})
    length, period = F.col("best.length"), -F.col("best.col3")
    return told.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.col2")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.expr("(1000 * best.length) div -best.col3").alias("exponent_milli"),
        F.sha2("lines", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return repeats.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_license_scan": op6_license_scan,
    "op7_chat_format": op7_chat_format,
    "op8_warc": op8_warc,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_substring_dedup": op13_substring_dedup,
}

_OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g
  FROM w
), n AS (
  SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 80 * (nx.c + ny.c - i)
), r(id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.y, r.c FROM r JOIN l ON l.x = r.id
)
SELECT d.doc_id, coalesce(any_value(n.c), 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.id = d.doc_id
GROUP BY d.doc_id
"""

_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM d
)
"""

_OP7_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<(/?turn|says|then)>', '<\\\1>', 'g')) AS n_text,
         length(regexp_replace(replace(role, '\', '\\'), '<(/?turn|says|then)>', '<\\\1>', 'g')) AS n_role,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS DISTINCT FROM role AS starts
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n_text + CASE WHEN starts THEN n_role + 20 ELSE 6 END) - 1 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP8_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_OP9_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(id, c) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.y, r.c FROM r JOIN l ON l.x = r.id
), c AS (
  SELECT id, min(c) AS component_id FROM r GROUP BY id
), k AS (
  SELECT x, count(*) AS n_links FROM l GROUP BY x
)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN k ON k.x = vec_id
"""

def _op11_sql(dims: int = 64, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Rounds of assignment and integer means, written out one after the other."""
    w = dims // parts
    steps = [
        "v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"w AS MATERIALIZED (SELECT vec_id, label, p, e[{w} * p + 1 : {w} * p + {w}] AS e FROM v, range({parts}) r(p))",
        f"c0 AS MATERIALIZED (SELECT p, k, e FROM (SELECT p, e, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k FROM w) WHERE k < {entries})",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, label, p, arg_min(k, (d, k)) AS k, min(d) AS d, any_value(e) AS e FROM (
    SELECT w.vec_id, w.label, w.p, c.k, w.e, list_sum(list_transform(list_zip(w.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM w JOIN c{r} c ON c.p = w.p)
  GROUP BY vec_id, label, p)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c.p, c.k, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY x) AS e FROM (
      SELECT p, k, x, sum(e[x + 1])::BIGINT AS s, count(*) AS n FROM a{r}, range({w}) q(x) GROUP BY p, k, x)
    GROUP BY p, k) m ON m.p = c.p AND m.k = c.k)""")
    return f"""
WITH {", ".join(steps)}, o AS (
  SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id, label
), s AS (
  SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM c{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM o, s
"""


_OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
      lambda c: list_concat([CAST(ascii(c) AS BIGINT)], list_transform(range(8), lambda i: CAST(-1 AS BIGINT)))))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
  FROM documents
), g AS (
  SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS hit, h // 10 AS g FROM d
), p AS (
  SELECT *, CASE WHEN hit THEN g % n END AS a FROM g
), q AS (
  SELECT *, CASE WHEN hit THEN 1 + (n - a) // (3 + g % 8) END AS p FROM p
), w AS MATERIALIZED (
  SELECT doc_id, i, ws[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % p ELSE i END] AS word
  FROM q, LATERAL (SELECT unnest(range(n)) AS i)
), e AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i
), r AS MATERIALIZED (
  SELECT doc_id, s AS start, n + q AS length, min(q) AS period
  FROM (SELECT doc_id, q, min(i) AS s, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island)
  WHERE n + q >= greatest(12, 2 * q)
  GROUP BY doc_id, s, n + q
), m AS (
  SELECT doc_id, min(start) AS start, length, min(period) AS period FROM r GROUP BY doc_id, length
), b AS (
  SELECT doc_id, count(*) AS n_runs, arg_max((start, length, period), (length, -start, -period)) AS best,
         string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS lines
  FROM r GROUP BY doc_id
), c AS (
  SELECT doc_id, unnest(range(start + period, start + length)) AS i FROM r
), k AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS kept FROM w ANTI JOIN c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY w.doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best[1] AS start, best[2] AS length, best[3] AS period,
       1000 * best[2] // best[3] AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM documents d LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), w AS MATERIALIZED (
  SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS word, len(ws) AS n,
         unnest(list_transform(range(len(ws)), lambda j: CASE WHEN j + 13 <= len(ws) THEN array_to_string(ws[j + 1 : j + 13], ' ') END)) AS s
  FROM d
), f AS (
  SELECT doc_id, i, word, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS later FROM w
), k AS (
  SELECT doc_id, i, word, coalesce(bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), false) AS gone FROM f
), o AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM k GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN o USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _op11_sql(),
    "op12_periodic_runs": _OP12_SQL,
    "op13_substring_dedup": _OP13_SQL,
    "op2_ngram_jaccard_join": _OP2_SQL,
    "op9_embedding_near_dedup": _OP9_SQL,
    "op4_exact_dedup": _OP4_SQL,
    "op7_chat_format": _OP7_SQL,
    "op8_warc": _OP8_SQL,
}
