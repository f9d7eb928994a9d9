"""The queries op1 to op13 for the driver, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact, idfiles, media, mixing, phrases, ppm, shards, simhash, spelling, substrings, toxicity, urls
from tidemark.llm.common import ROW_KEY, stage_folder

#: Fixed by the contract.
URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents", "doc_id", "text")).drop(ROW_KEY)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.decisions(_table(spark, sf_dir, "documents", "doc_id", "text")).drop(ROW_KEY)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substrings.remove_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return made.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents", "doc_id", "text"), _table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.score(docs, toxicity.learn(docs, labels)).drop(ROW_KEY)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents", "doc_id", "text", "source")).drop(ROW_KEY, "copies")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(_table(spark, sf_dir, "documents", "doc_id", "text"), 8)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = stage_folder(spark)
    idfiles.write(idfiles.encoded(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), end=1), folder)
    return idfiles.digests(spark, folder)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents", "text", "lang"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(spelling.words_of(_table(spark, sf_dir, "documents", "doc_id", "text"), lose=199))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_simhash, op3_exact_dedup, op4_substring_dedup, op5_bpe, op6_toxicity, op7_mixing, op8_media, op9_lm_scoring, op10_sharding, op11_token_files, op12_phrases, op13_spelling)}

_URL_CASES = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{h}/{p}'"
    for h, _, p in sorted((r.partition("/") for r, _ in URL_RULES), key=lambda x: -len("".join(x)))
)
ORACLES: dict[str, str] = {
    "op1_url_filters": rf"""
        WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        ruled AS (SELECT *, CASE {_URL_CASES} END AS rule FROM parts)
        SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
               CASE WHEN rule IN ({", ".join(f"'{r}'" for r, v in URL_RULES if v == "block")}) THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
    "op3_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
        r AS (SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY sha) AS group_size, row_number() OVER w AS n
              FROM d WINDOW w AS (PARTITION BY sha ORDER BY chars DESC, doc_id))
        SELECT doc_id, keep_id, group_size, n = 1 AS kept, sha AS text_sha256 FROM r""",
    "op4_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 34)) AS p FROM d)),
        rep AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(p, p + 34)) AS i FROM rep),
        word AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(t, ' ' ORDER BY i) AS k FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op12_phrases": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
        n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
        places AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM p),
        runs AS (SELECT lang, w[i:i + k - 1] AS w FROM places, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE i + k - 1 <= len(w)),
        f AS (SELECT lang, w, count(*) AS a FROM runs GROUP BY lang, w HAVING count(*) >= 100),
        gone AS (SELECT DISTINCT s.lang, s.w FROM f AS s JOIN (SELECT lang, a, unnest([w[:len(w) - 1], w[2:]]) AS w FROM f WHERE len(w) > 2) AS b USING (lang, w) WHERE b.a >= s.a),
        cut AS (SELECT lang, w, a, unnest(generate_series(1, len(w) - 1)) AS k FROM f ANTI JOIN gone USING (lang, w) WHERE len(w) > 1),
        s AS (SELECT cut.*, x.a AS l, y.a AS r, n.n, (1000::HUGEINT * cut.a * n.n) // (x.a::HUGEINT * y.a) AS score
              FROM cut JOIN n USING (lang) JOIN f AS x ON x.lang = cut.lang AND x.w = cut.w[:k] JOIN f AS y ON y.lang = cut.lang AND y.w = cut.w[k + 1:]),
        best AS (SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, n, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM best)
        SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
