"""The corpus operators as registered queries, and the SQL that states the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import CLASSES, TEMPLATES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .gam import classify_quality

    return classify_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan, templates

    return license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), templates(spark))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs, keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import DIGESTS, bpe_round_trip, digests

    return bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary_path(), digests, DIGESTS, keep=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import kept_digest, remove_repeats

    return kept_digest(remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_text, with_length

    return with_length(extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"]))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten, by its id, repeat a stretch of them to the end."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    unit = words[a : a + 1 + (n - a) // (3 + g % 8)]
    return words[:a] + (unit * ((n - a) // len(unit) + 1))[: n - a]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import periodic_runs, run_digests

    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_period))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .overlap import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_license_scan": op2_license_scan,
    "op3_toxicity": op3_toxicity,
    "op4_warc": op4_warc,
    "op5_decontaminate": op5_decontaminate,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_html_text": op10_html_text,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_lexical_search": op12_lexical_search,
    "op13_ngram_join": op13_ngram_join,
}


def words_sql(text: str) -> str:
    return f"[x FOR x IN regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+') IF x <> '']"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def shingles_sql(words: str) -> str:
    return f"[array_to_string({words}[i + 1:i + 5], ' ') FOR i IN range(len({words}) - 4)]"


def terms_sql(text: str) -> str:
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{capitals}', '{capitals.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


ORACLE_SQL: dict[str, str] = {
    "op2_license_scan": f"""
        WITH known AS (SELECT license, t, list_distinct({shingles_sql("w")}) AS s FROM (SELECT license, t, {words_sql("t")} AS w FROM (VALUES {", ".join(f"('{name}', '{quoted(text)}')" for name, text in TEMPLATES)}) AS v(license, t))),
        sized AS (SELECT license, t, len(s) AS m, CASE {" ".join(f"WHEN len(s) <= {c} THEN {c}" for c in CLASSES)} END AS c, unnest(s) AS g FROM known),
        texts AS (SELECT doc_id, {shingles_sql("w")} AS s FROM (SELECT doc_id, {words_sql("coalesce(text, '')")} AS w FROM documents)),
        places AS (SELECT doc_id, len(s) AS n, unnest(s) AS g, unnest(range(len(s))) AS p FROM texts),
        hits AS (SELECT doc_id, license, t, m, c, g, greatest(1, ceil(n / c) - 1) AS windows, floor(p / c) AS at_ FROM places JOIN sized USING (g)),
        held AS (SELECT *, at_ - back AS k FROM hits, (VALUES (0), (1)) AS v(back) WHERE at_ - back BETWEEN 0 AND windows - 1),
        shares AS (SELECT doc_id, license, CAST(k * c AS INT) AS first, count(DISTINCT g) / m AS share FROM held GROUP BY doc_id, license, t, m, c, k)
        SELECT doc_id, license, max(share) AS containment, min(first) AS first_shingle FROM shares WHERE share >= 0.8 GROUP BY doc_id, license""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
        d AS (SELECT page_id, octet_length(encode(t)) AS n, sha256(t) AS h FROM p),
        m AS (SELECT h, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY h)
        SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
               CASE WHEN first_id <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id <> d.page_id THEN first_id END AS refers_to, 'ok' AS status
        FROM d LEFT JOIN m USING (h)""",
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op12_lexical_search": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms_sql("text")} AS w FROM documents),
        q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest({terms_sql("text")}) AS t FROM benchmark) GROUP BY item_id, t),
        total AS (SELECT count(*) FILTER (len(w) > 0) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM d),
        held AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d) GROUP BY r, doc_id, n, t),
        weights AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM held, total GROUP BY t),
        impacts AS (SELECT r, doc_id, t, (1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)) AS impact FROM held, total),
        scores AS (SELECT item_id, doc_id, r, CAST(sum(times * w * impact) AS BIGINT) AS score FROM q JOIN weights USING (t) JOIN impacts USING (t) WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, r)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores
        WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10""",
}
