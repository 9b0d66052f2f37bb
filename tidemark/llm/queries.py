"""The queries of the corpus operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, exact_dedup, language_model, licenses, line_dedup, merkle, minhash, mixing, quality, secrets, tokens, warc
from .shared import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "rate", "copies")


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1).otherwise(F.col("n_chars"))
    out = merkle.audit(table(spark, sf_dir, "documents"), changed={"n_chars": tampered.cast("decimal(38,0)")})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mixing, op2_token_output, op3_minhash, op4_language_model, op5_line_dedup, op6_decontamination, op7_licenses, op8_quality, op9_exact_dedup, op10_warc, op11_merkle,
        op12_secrets, op13_alignment,
    )
}

ORACLE_SQL = {
    "op11_merkle": r"""
        WITH RECURSIVE crc(doc_id, s, c) AS (
          SELECT doc_id, doc_id::VARCHAR, 4294967295 FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
          UNION ALL SELECT doc_id, substr(s, 2), list_reduce([xor(c, ascii(s)), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM crc WHERE s <> ''),
        l AS (SELECT d.doc_id, coalesce('=' || lang, '') AS g, (xor(c, 4294967295)) % 7 = 0 AS t, list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR, text], lambda x: coalesce(strlen(x) || ':' || x, '-')) AS v, coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') AS n1
              FROM documents d LEFT JOIN (SELECT * FROM crc WHERE s = '') USING (doc_id)),
        h AS (SELECT doc_id, g, sha256(array_to_string(v, '')) AS leaf, CASE WHEN t THEN sha256(v[1] || v[2] || v[3] || n1 || v[5]) ELSE sha256(array_to_string(v, '')) END AS again FROM l),
        p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM h),
        tree(g, k, i, n, x) AS (SELECT g, 0, i, n, leaf FROM p UNION ALL SELECT g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, k, i // 2, n),
        sub AS (SELECT g, x AS subroot, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
        top(k, i, n, x) AS (SELECT 0, i, n, subroot FROM sub UNION ALL SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(x, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY k, i // 2, n),
        steps AS (
          SELECT p.g, p.i AS leaf_i, t.k, s.x, (p.i >> t.k) & 1 = 1 AS on_left FROM p JOIN (SELECT DISTINCT g, k, n FROM tree WHERE n > 1) t ON p.g = t.g LEFT JOIN tree s ON s.g = p.g AND s.k = t.k AND s.i = xor(p.i >> t.k, 1)
          UNION ALL SELECT p.g, p.i, 1000 + t.k, s.x, (b.i >> t.k) & 1 = 1 FROM p JOIN sub b ON p.g = b.g CROSS JOIN (SELECT DISTINCT k, n FROM top WHERE n > 1) t LEFT JOIN top s ON s.k = t.k AND s.i = xor(b.i >> t.k, 1)),
        path AS (SELECT *, row_number() OVER (PARTITION BY g, leaf_i ORDER BY k) AS o FROM steps),
        fold(g, i, o, x) AS (SELECT g, i, 0, again FROM p UNION ALL SELECT f.g, f.i, f.o + 1, sha256(CASE WHEN s.x IS NULL THEN f.x WHEN s.on_left THEN s.x || f.x ELSE f.x || s.x END) FROM fold f JOIN path s ON s.g = f.g AND s.leaf_i = f.i AND s.o = f.o + 1),
        proof AS (SELECT g, leaf_i AS i, sha256(coalesce(string_agg(x, '' ORDER BY o), '')) AS proof_sha256, max(o) AS o FROM path GROUP BY ALL)
        SELECT p.doc_id, p.leaf, b.subroot, (SELECT x FROM top WHERE n = 1) AS root, coalesce(r.proof_sha256, sha256('')) AS proof_sha256, f.x AS folded_root, f.x = (SELECT x FROM top WHERE n = 1) AS verified
        FROM p JOIN sub b USING (g) LEFT JOIN proof r ON r.g = p.g AND r.i = p.i JOIN fold f ON f.g = p.g AND f.i = p.i AND f.o = coalesce(r.o, 0)""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
        g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)""",
    "op10_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        b AS (SELECT page_id, h, list_aggregate(list_transform(range(0, 32), lambda i:
            substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(d, (5 * (i // 4) + 1)::BIGINT, 5))::BIGINT) >> ((3 - i % 4) * 5)::INT) & 31) + 1, 1)), 'string_agg', '') AS digest FROM p),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, strlen(h)::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM b JOIN f USING (h)""",
    "op3_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
        l AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
        SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
               w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
        FROM w LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)""",
}
