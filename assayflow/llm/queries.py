"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from assayflow.llm.alignment import Alignment
from assayflow.llm.common import Scratch, table
from assayflow.llm.exact_dedup import exact_dedup
from assayflow.llm.hmm_lm import contract_held_out, hmm_scores
from assayflow.llm.latent import decontaminate
from assayflow.llm.line_dedup import LineDedup
from assayflow.llm.packing import pack
from assayflow.llm.pii import find_pii, pii_digest
from assayflow.llm.quality import quality_classifier
from assayflow.llm.simhash import simhash_components
from assayflow.llm.spelling import spelling_groups
from assayflow.llm.substring_dedup import substring_dedup
from assayflow.llm.suffix_dedup import repeated_passages
from assayflow.llm.warc import META, audit, read_warc, record_text, write_warc


#: Where the public tokenizers' files are, on the driver and on every executor.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")


def op1_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_scores(table(spark, sf_dir, "documents"), contract_held_out())


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC files, read back and audited against other files, in which some records have a changed byte and some are zeros."""
    scratch, pages = Scratch(spark, "warc"), table(spark, sf_dir, "pages")
    record = record_text(F.col("url").cast("string"), F.col("html").cast("string"))
    damaged = F.replace("_r", F.lit("HTTP/1.1 200 OK"), F.lit("HTTP/1.1 200 0K"))
    zeros = F.concat(F.repeat(F.lit("\0"), F.octet_length("_r") - 1), F.lit("\n"))  # as many bytes, so that all else stays where it is
    other = F.when(F.col("page_id") % 193 == 5, zeros).when(F.col("page_id") % 97 == 13, damaged).otherwise(F.col("_r"))
    write_warc(pages, f"{scratch.root}/one")
    write_warc(pages.withColumn("_r", record), f"{scratch.root}/other", other)
    one, two = (read_warc(spark, f"{scratch.root}/{name}").filter("record is not null") for name in ("one", "other"))
    found = audit(one, two, scratch).select("file", "offset", "status")
    text = F.col("record").cast("string")
    page = F.when(text.startswith(META), F.regexp_extract(text, "\r\npage-id: (-?[0-9]*)\r\n", 1))
    listed = scratch.save(one.select("file", "offset", F.octet_length("record").cast("long").alias("n_bytes"), F.sha2("record", 256).alias("record_sha256"), page.alias("page")), "listed")
    names = listed.filter("page is not null").select("file", F.col("offset").alias("behind"), F.col("page").try_cast("long").alias("page_id"))
    out = listed.filter("page is null").withColumn("behind", F.col("offset") + F.col("n_bytes")).join(names, ["file", "behind"])
    return out.join(found, ["file", "offset"], "left").select("page_id", "n_bytes", "record_sha256", F.coalesce("status", F.lit("intact")).alias("status"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("item_ids", F.array_join(F.transform("item_ids", lambda i: i.cast("string")), ","))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_repeated", text.alias("spans"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Alignment(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model").documents()


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return LineDedup(table(spark, sf_dir, "documents")).digest()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_lm": op1_hmm_lm,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_warc_fixity": op4_warc_fixity,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_latent_decontamination": op7_latent_decontamination,
    "op8_pii": op8_pii,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_line_dedup": op13_line_dedup,
    "pipeline": pipeline,
}

#: Every word of every row (r), where repeated windows of {window} words are, and the words they cover.
_WINDOWS = r"""
        WITH t AS (
            SELECT row_number() OVER () AS r, doc_id,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
            FROM documents),
        place AS (SELECT r, w, unnest(range(1, greatest(len(w) - {window} + 1, 0) + 1)) AS i FROM t),
        hashed AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + {window} - 1), ' ')) AS h FROM place),
        counted AS (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM hashed),
        gone AS (SELECT DISTINCT r, i + k AS p FROM counted, range({window}) AS o(k) WHERE n > 1),
"""

#: The same results in DuckDB's SQL, where SQL can express them.
ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        r AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
            FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id NULLS LAST))
        SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
    """,
    "op4_warc_fixity": r"""
        WITH block AS (
            SELECT page_id, url, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8'
                || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS b, chr(13) || chr(10) AS nl
            FROM pages),
        named AS (SELECT *, md5(coalesce(url, '') || chr(10) || b) AS m FROM block),
        record AS (
            SELECT page_id, 'WARC/1.1' || nl || 'WARC-Type: response' || nl || 'WARC-Record-ID: <urn:uuid:'
                || concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]) || '>' || nl
                || 'WARC-Date: 2024-01-01T00:00:00Z' || nl || coalesce('WARC-Target-URI: ' || url || nl, '')
                || 'Content-Type: application/http;msgtype=response' || nl || 'Content-Length: ' || octet_length(encode(b))
                || nl || nl || b || nl || nl AS r
            FROM named)
        SELECT page_id, octet_length(encode(r)) AS n_bytes, sha256(r) AS record_sha256,
               CASE WHEN page_id % 193 = 5 THEN 'missing' WHEN page_id % 97 = 13 THEN 'changed' ELSE 'intact' END AS status
        FROM record
    """,
    "op6_substring_dedup": _WINDOWS.format(window=35)
    + r"""
        word AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS text, count(*) AS n FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (r)
    """,
    "op9_suffix_dedup": _WINDOWS.format(window=50)
    + r"""
        island AS (SELECT r, p, p - row_number() OVER (PARTITION BY r ORDER BY p) AS k FROM gone),
        span AS (SELECT r, min(p) - 1 AS a, max(p) AS b FROM island GROUP BY r, k),
        joined AS (SELECT r, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, sum(b - a)::BIGINT AS n FROM span GROUP BY r)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_repeated, coalesce(spans, '') AS spans
        FROM t LEFT JOIN joined USING (r)
    """,
    "op12_spelling_variants": r"""
        WITH RECURSIVE crc_table AS (
            SELECT list(c ORDER BY i) AS t FROM (
                SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
                FROM range(256) AS x(i))),
        run AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x
            FROM documents),
        own AS (SELECT doc_id, x, count(*) AS n FROM run WHERE length(x) >= 6 GROUP BY ALL),
        coded AS (
            SELECT x, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || x, ''), lambda c:
                CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes
            FROM own),
        hashed AS (
            SELECT x, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
            FROM coded, crc_table),
        cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(x, h % length(x)) || substr(x, h % length(x) + 2) ELSE x END AS word, n FROM hashed),
        word AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        less AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p, left(word, p - 1) || substr(word, p + 1) AS rest FROM word),
        near AS (
            SELECT a.word, b.word AS other, b.n FROM less AS a JOIN less AS b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT less.word, word.word, word.n FROM less JOIN word ON less.rest = word.word
            UNION SELECT word.word, less.word, less.n FROM less JOIN word ON less.rest = word.word),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near GROUP BY word),
        formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
            FROM word LEFT JOIN best USING (word)),
        walk AS (
            SELECT word, word AS root, form AS next FROM formed
            UNION ALL SELECT walk.word, formed.word, formed.form FROM walk JOIN formed ON formed.word = walk.next)
        SELECT formed.word, formed.form, root, n, n_near, form_n FROM formed JOIN walk ON formed.word = walk.word AND walk.next IS NULL
    """,
    "op13_line_dedup": r"""
        WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        line AS (SELECT r, doc_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM t),
        keyed AS (
            SELECT *, translate(regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM line),
        common AS (SELECT k, max(doc_id) AS top FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT r) >= 5),
        kept AS (
            SELECT r, string_agg(x, chr(10) ORDER BY p) AS text, count(*) AS n
            FROM keyed LEFT JOIN common USING (k) WHERE common.k IS NULL OR top IS NOT DISTINCT FROM doc_id GROUP BY r)
        SELECT doc_id, len(l) AS n_lines, len(l) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept.text, '')) AS kept_sha256
        FROM t LEFT JOIN kept USING (r)
    """,
}
