"""Queries of the text operators over the driver tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import (
    bpe,
    chat,
    decontaminate,
    fill_middle,
    fingerprint,
    html_text,
    lm,
    near_dedup,
    quality,
    suffix_dedup,
    token_counts,
    vector_codes,
    warc,
)
from tidewater.llm.common import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = "byte_bpe_50k.tiktoken"
VOCABULARY = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_byte_bpe")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    coded = bpe.round_trip(spark, ranks, public_tokenizers.PATTERN, "text").alias("coded")
    return table(spark, sf_dir, "documents").select("doc_id", coded).select(
        "doc_id",
        "coded.n_tokens",
        F.sha2("coded.ids", 256).alias("ids_sha256"),
        F.sha2("coded.decoded", 256).alias("decoded_sha256"),
    )


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return token_counts.counted(
        documents, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, TOKEN_LIMIT
    )


OP9_EXTRA = "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)"


def _escaped_sql(column: str) -> str:
    e, out = chat.INSTRUCT.escape, column
    for old, new in [(e, e + e), *((m, m[0] + e + m[1:]) for m in chat.INSTRUCT.marks())]:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def _marks_length_sql() -> str:
    t = chat.INSTRUCT
    known = " ".join(f"WHEN '{r}' THEN {len(x.open) + len(x.close)}" for r, x in t.turns.items())
    other = len(t.other.open) + len(t.other.close) + len(t.role_end)
    return f"CASE role {known} ELSE {other} + length({_escaped_sql('role')}) END"


OP9_SQL = f"""
WITH every AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
), folded AS (
    SELECT conv_id, count(*) AS n_turns,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
           sum(length({_escaped_sql('text')}) + {_marks_length_sql()})::BIGINT AS formatted_chars
    FROM every GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       formatted_chars FROM folded
"""


@query("op9_chat_format", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.formatted(rows.unionByName(spark.sql(OP9_EXTRA)))
    turns = F.transform(
        chat.read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    out = out.withColumn("turns", turns).withColumn("learned", chat.loss_text(F.col("segments")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


WARC_DATE = "2024-01-01T00:00:00Z"

# A digest's 160 bits as text, five at a time.
_BITS = "".join(f"WHEN '{c:x}' THEN '{c:04b}' " for c in range(16))
_BASE32 = "".join(f"WHEN '{i:05b}' THEN '{c}' " for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
OP3_SQL = f"""
WITH every AS (
    SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
    SELECT page_id, strlen(html) AS payload_bytes, hex,
           list_aggregate(list_transform(string_split(hex, ''), lambda c: CASE c {_BITS}END), 'string_agg', '') AS b
    FROM every
), typed AS (
    SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex) AS top,
           list_aggregate(list_transform(range(32), lambda i: CASE substr(b, i * 5 + 1, 5) {_BASE32}END), 'string_agg', '')
               AS payload_digest
    FROM bits
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to FROM typed
"""


@query("op3_warc", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"), WARC_DATE)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality.decided(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *counts, "base_failed", "kept")


_BENCH_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH docs AS (
    SELECT doc_id, {_BENCH_WORDS} AS w FROM documents
), items AS (
    SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark
), windows AS (
    SELECT item_id, 13 AS size, array_to_string(w[i : i + 12], ' ') AS body
    FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM items WHERE len(w) >= 13)
    UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 12
), sizes AS (
    SELECT DISTINCT size FROM windows
), grams AS (
    SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS body
    FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size)
), hits AS (
    SELECT doc_id, item_id, i, grams.size FROM grams JOIN windows USING (size, body)
), places AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM docs LEFT JOIN places USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op7_decontaminate", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.matched(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix_dedup.deduplicated(documents)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op5_lm_score")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.scored(documents, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


@query("op2_near_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.grouped(table(spark, sf_dir, "documents"))


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_text.extracted(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


OP11_ROUND = """
nearest{n} AS (
    SELECT vec_id, part, arg_min(entry, (apart, entry)) AS entry, min(apart) AS apart
    FROM (SELECT v.row AS row, v.vec_id, v.part, c.entry,
                 list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS apart
          FROM pieces v JOIN book{n} c USING (part))
    GROUP BY row, vec_id, part
)"""
OP11_UPDATE = """, means{n} AS (
    SELECT part, entry, list(mean ORDER BY place) AS x
    FROM (SELECT part, entry, place, floor(sum(value)::DOUBLE / count(*))::BIGINT AS mean
          FROM (SELECT part, entry, unnest(x) AS value, unnest(range(4)) AS place
                FROM nearest{n} JOIN pieces USING (vec_id, part))
          GROUP BY part, entry, place)
    GROUP BY part, entry
), book{m} AS (
    SELECT part, entry, coalesce(means{n}.x, book{n}.x) AS x FROM book{n} LEFT JOIN means{n} USING (part, entry)
), """
OP11_SQL = f"""
WITH kept AS (
    SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS row,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS (
    SELECT vec_id, label, row, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM kept, (SELECT unnest(range(16)) AS part)
), book0 AS (
    SELECT part, row - 1 AS entry, x FROM pieces WHERE row <= 64
), {OP11_ROUND.format(n=0)}{OP11_UPDATE.format(n=0, m=1)}{OP11_ROUND.format(n=1)}{OP11_UPDATE.format(n=1, m=2)}{OP11_ROUND.format(n=2)}
, coded AS (
    SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(apart)::BIGINT AS error
    FROM nearest2 GROUP BY vec_id
), digest AS (
    SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book2
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


@query("op11_vector_codes", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = vector_codes.coded(table(spark, sf_dir, "embeddings"))
    return out.withColumn("code", F.lower(F.hex("code")))


_FIM = fill_middle.MARKS
_FIM_P, _FIM_M = "substr(text, 1, low)", "substr(text, low + 1, high - low)"
_FIM_S = "substr(text, high + 1)"
OP12_SQL = f"""
WITH every AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
    SELECT doc_id, text, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS a, ('0x' || h[9:16])::BIGINT % (n + 1) AS b,
           CASE WHEN text = '' OR contains(text, '{_FIM.prefix}') OR contains(text, '{_FIM.suffix}')
                     OR contains(text, '{_FIM.middle}') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM every
), cut AS (
    SELECT *, least(a, b) AS low, greatest(a, b) AS high FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '{_FIM.prefix}' || {_FIM_P} || '{_FIM.suffix}' || {_FIM_S} || '{_FIM.middle}' || {_FIM_M}
              ELSE '{_FIM.suffix}' || {_FIM_S} || '{_FIM.prefix}' || {_FIM_P} || '{_FIM.middle}' || {_FIM_M} END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""


@query("op12_fill_middle", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.rearranged(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"),
    )


@query("op13_fingerprint")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.beside_next(table(spark, sf_dir, "documents"))
