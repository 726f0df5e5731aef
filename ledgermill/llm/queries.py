"""The registered query of each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exact_dedup, importance, jaccard_join, language_id, language_model, mixing, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, token_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """A public tokenizer file of the machine; imported here, so that the other operators don't need the files."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), width=3, percent=90)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.read(token_file.write(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = mixing.mix(_table(spark, sf_dir, "documents"), budget_share=1.0, entropy=0.95, repeats=2.0, seed="mix")
    return used.select("doc_id", "source", "epoch", "block", "stream_offset", "n_tokens", F.round("weight", 9).alias("weight"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), least=1, most=1, buckets=10_000, percent=10, least_words=20, seed="2024")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), width=50)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"), most=3, support=10, percent=50, first=2000)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_language_model": op3_language_model,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_file": op7_token_file,
    "op8_packing": op8_packing,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op9_mixing": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, coalesce('=' || source, '-') AS s, md5('mix|' || coalesce(doc_id::VARCHAR, '-' || (row_number() OVER () - 1)::VARCHAR)) AS h,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens
            FROM documents
        ), totals AS (
            SELECT s, sum(n_tokens)::BIGINT AS tokens, count(*) AS n_docs FROM d GROUP BY s
        ), shares AS (
            SELECT s, tokens::DOUBLE / sum(tokens) OVER () AS p, sum(tokens) OVER ()::DOUBLE AS total FROM totals
        ), halving AS (
            SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS rlo, 1.0::DOUBLE AS rhi
            UNION ALL
            SELECT i + 1,
                   CASE WHEN entropy >= 0.95 * ln(n) THEN (lo + hi) / 2 ELSE lo END, CASE WHEN entropy >= 0.95 * ln(n) THEN hi ELSE (lo + hi) / 2 END,
                   CASE WHEN most > 2 THEN (rlo + rhi) / 2 ELSE rlo END, CASE WHEN most > 2 THEN rhi ELSE (rlo + rhi) / 2 END
            FROM (
                SELECT i, lo, hi, rlo, rhi, count(*) AS n,
                       ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) AS entropy,
                       max(pow(p, (rlo + rhi) / 2 - 1)) / sum(pow(p, (rlo + rhi) / 2)) AS most
                FROM halving, shares WHERE i < 40 AND p > 0 GROUP BY i, lo, hi, rlo, rhi
            )
        ), ends AS (
            SELECT max(lo) AS lo, max(rhi) AS hi FROM halving WHERE i = 40
        ), exponent AS (
            SELECT greatest(CASE WHEN -sum(p * ln(p)) >= 0.95 * ln(count(*)) THEN 1.0 ELSE max(lo) END,
                            CASE WHEN max(1 / p) / count(*) <= 2 THEN 0.0 ELSE max(hi) END) AS a
            FROM shares, ends WHERE p > 0
        ), weighted AS (
            SELECT s, tokens, n_docs, CASE WHEN p > 0 THEN pow(p, a) / sum(CASE WHEN p > 0 THEN pow(p, a) ELSE 0 END) OVER () ELSE 0 END AS weight, total
            FROM totals JOIN shares USING (s), exponent
        ), quotas AS (
            SELECT *, round(weight * total) AS quota FROM weighted
        ), placed AS (
            SELECT d.*, weight, quota, tokens, ('0x' || substr(h, 1, 8))::BIGINT % ceil(n_docs / 1000)::BIGINT AS block FROM d JOIN quotas USING (s)
        ), epochs AS (
            SELECT s, block, size, tokens, quota, unnest(range(0, coalesce(floor(quota / nullif(tokens, 0)), 0)::BIGINT + 1)) AS epoch
            FROM (SELECT s, block, sum(n_tokens)::BIGINT AS size, any_value(tokens) AS tokens, any_value(quota) AS quota FROM placed GROUP BY s, block)
        ), streams AS (
            SELECT s, block, epoch, (epoch * tokens + coalesce(sum(size) OVER (PARTITION BY s, epoch ORDER BY md5('mix|' || s || '|' || block || '|' || epoch), block
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS block_offset
            FROM epochs
        ), within AS (
            SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY s, block ORDER BY h, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM placed
        )
        SELECT doc_id, source, epoch::INTEGER AS epoch, block, block_offset + before AS stream_offset, n_tokens, round(weight, 9) AS weight
        FROM within JOIN streams USING (s, block) WHERE block_offset + before + n_tokens <= quota""",
    "op11_importance_resampling": r"""
        WITH crc AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS entries
            FROM range(256) r(i)
        ), d AS (
            SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), own AS (
            SELECT row, feature, count(*) AS n FROM (SELECT row, unnest(words) AS feature FROM d) GROUP BY row, feature
        ), wanted AS (
            SELECT feature, count(*) AS t FROM (
                SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS feature
                FROM benchmark) GROUP BY feature
        ), dictionary AS (
            SELECT feature, hex(encode(feature)) AS h, coalesce(s, 0) AS s, coalesce(t, 0) AS t
            FROM (SELECT feature, sum(n) AS s FROM own GROUP BY feature) FULL JOIN wanted USING (feature)
        ), hashed AS (
            SELECT feature, s, t, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, len(h), 2), lambda i: ('0x' || substr(h, i + 1, 2))::BIGINT)),
                   lambda c, b: xor(entries[(xor(c, b) & 255) + 1], c >> 8))) % 10000 AS bucket
            FROM dictionary, crc
        ), buckets AS (
            SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM hashed GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM buckets
        ), sums AS (
            SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS total FROM own JOIN hashed USING (feature) JOIN gains USING (bucket) GROUP BY row
        ), scored AS (
            SELECT row, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features,
                   coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
                   ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
            FROM d LEFT JOIN sums USING (row)
        ), final AS (
            SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
        ), placed AS (
            SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () * 10 // 100 AS drawn FROM final WHERE n_words >= 20
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= drawn THEN rank END AS rank FROM final LEFT JOIN placed USING (row)""",
    "op12_suffix_dedup": r"""
        WITH d AS (
            SELECT row_number() OVER () AS row, doc_id, coalesce(doc_id, 9223372036854775807) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), strings AS (
            SELECT row, o, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT row, o, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)
        ), hits AS (
            SELECT row, p FROM strings JOIN (SELECT s, min(o) AS least, max(o) AS most FROM strings GROUP BY s HAVING least < most) USING (s) WHERE least < o
        ), marked AS (
            SELECT row, p, p > 50 + lag(p, 1, -51) OVER (PARTITION BY row ORDER BY p) AS opens FROM hits
        ), numbered AS (
            SELECT row, p, sum(opens::INT) OVER (PARTITION BY row ORDER BY p) AS span FROM marked
        ), spans AS (
            SELECT row, span, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY row, span
        ), kept AS (
            SELECT row, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k
            FROM (SELECT row, a, b, lag(b, 1, 0) OVER (PARTITION BY row ORDER BY a) AS before FROM spans) JOIN d USING (row) GROUP BY row
        )
        SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE k || substr(h, 2 * last + 1) END)) AS kept_sha256
        FROM d LEFT JOIN kept USING (row)""",
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), tokens AS (
            SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces
        ), runs AS (
            SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM tokens, range(1, 4) r(k) WHERE len(w) >= k
        ), f AS (
            SELECT lang, phrase, k, count(*) AS n FROM (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM runs) GROUP BY lang, phrase, k
        ), frequent AS (
            SELECT *, string_split(phrase, ' ') AS w FROM f WHERE n >= 10
        ), cuts AS (
            SELECT lang, phrase, w, k, n AS a, unnest(range(1, k)) AS c FROM frequent WHERE k > 1
        ), scored AS (
            SELECT x.lang, x.phrase, x.k, x.a, x.c, l.n AS l, r.n AS r, (1000000::HUGEINT * x.a * x.a) // (l.n::HUGEINT * r.n) AS score
            FROM cuts x JOIN frequent l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.c], ' ')
            JOIN frequent r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.c + 1:], ' ')
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
        ), inside AS (
            SELECT lang, phrase, max(n) AS longer FROM (
                SELECT lang, array_to_string(w[1:2], ' ') AS phrase, n FROM frequent WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), n FROM frequent WHERE k = 3
            ) GROUP BY lang, phrase
        ), kept AS (
            SELECT s.* FROM lowest s LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 50 * a
        ), totals AS (
            SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
