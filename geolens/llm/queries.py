"""One query for each operator of this folder, with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolens.llm import archives, byte_bpe, chat, codes, decontaminate, html_text, jaccard, packing, periodic, pii, rules, secrets, token_counts


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file, the same on all machines."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.segments(rows))


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, key="a key from the owner's store")
    return found.select("doc_id", F.size("pii_kinds").cast("long").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds"), "text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.learn(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_hits(docs, _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.round_trip(_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), passing=["doc_id"])


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.quality(_table(spark, sf_dir, "documents"), passing=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codes.compress(_table(spark, sf_dir, "embeddings"), passing=["vec_id", "label"])
    out = codes.with_totals(found.frame, "label")
    return out.select("vec_id", "code", "error", "label_error", F.lit(found.sha256()).alias("codebooks_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = periodic.find_runs(docs.select("doc_id", _made_periodic("doc_id", "text").alias("text")), passing=["doc_id"])
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.withColumn("best", periodic.longest())
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _made_periodic(doc: str, text: str) -> Column:
    """Texts of a tenth of the documents repeat from some word on; the others are as they were."""
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col(doc).cast("string"))
    g = F.floor(h / 10)

    def made(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    # The words are bound as a variable: as an expression they would be split again for each of them.
    bound = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, made(w)).otherwise("")), 0)
    return F.when(h % 10 == 0, bound).otherwise(F.col(text))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, passing=["doc_id"])
    decoded = byte_bpe.decode(encoded, ranks, passing=["doc_id", "ids"])
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return decoded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_chat_format": op2_chat_format,
    "op3_pii_pseudonyms": op3_pii_pseudonyms,
    "op4_secret_scan": op4_secret_scan,
    "op5_decontaminate": op5_decontaminate,
    "op6_warc_archives": op6_warc_archives,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_html_text": op9_html_text,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

_OP2 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
marked AS (
  SELECT *, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9
      ELSE 1 + length(regexp_replace(role, '(\\|###|</turn>|:)', '\\\1', 'g')) END
    + 6 + 8 + length(regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g')) AS chars,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and((CASE WHEN k = 1 THEN role IN ('system', 'user') ELSE (before = 'system' AND role = 'user')
    OR (before = 'user' AND role = 'assistant') OR (before = 'assistant' AND role = 'user') END) AND (k < n OR role = 'assistant')) AS valid
FROM marked GROUP BY conv_id
"""

_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = r"'[^\x{00}-\x{2F}\x{3A}-\x{60}\x{7B}-\x{7F}]+'"

_OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), {_ALNUM}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), {_ALNUM}) AS w FROM benchmark),
bw AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(w), 10) AS size,
    array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS said
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS p FROM b WHERE len(w) > 0) x
),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, p, size, array_to_string(w[p:p + size - 1], ' ') AS said
  FROM (SELECT r, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size) x
),
hit AS (SELECT r, p, dw.size, item FROM dw JOIN bw ON dw.said = bw.said AND dw.size = bw.size),
spots AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + size - 1)) AS q FROM hit) x GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) x GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN named USING (r)
"""

_OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""



def _op11(rounds: int = 4) -> str:
    """Lloyd rounds one after the other; parts are lists of whole numbers, which doubles hold exactly."""
    kept = """
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"""
    steps = [
        f"kept AS MATERIALIZED ({kept})",
        "parts AS MATERIALIZED (SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM kept, (SELECT unnest([0, 1, 2, 3]) AS p) q)",
        "first AS (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept)",
        "c0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN first USING (r) WHERE e < 256)",
    ]
    for k in range(rounds + 1):
        far = "list_inner_product(x.v, x.v) - 2 * list_inner_product(x.v, c.v) + list_inner_product(c.v, c.v)"
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, x.p, min({{'d': {far}, 'e': e}}) AS best, any_value(x.v) AS v FROM parts x JOIN c{k} c ON x.p = c.p GROUP BY r, x.p)")
        if k < rounds:
            means = f"SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM (SELECT p, best.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k}) y GROUP BY p, e, i"
            steps.append(f"m{k} AS (SELECT p, e, list(x ORDER BY i) AS v FROM ({means}) z GROUP BY p, e)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.v, c{k}.v) AS v FROM c{k} LEFT JOIN m{k} USING (p, e))")
    steps += [
        f"coded AS (SELECT r, string_agg(printf('%02x', CAST(best.e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)",
        f"books AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})",
    ]
    return f"""WITH {", ".join(steps)}
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), books"""


ORACLES: dict[str, str] = {
    "op2_chat_format": _OP2,
    "op5_decontaminate": _OP5,
    "op6_warc_archives": _OP6,
    "op11_vector_codes": _op11(),
}
