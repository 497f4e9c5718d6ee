"""The operators bound to the driver's tables: op1_ to op13_."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accordant.llm import (
    decontaminate, filter_audit, packing, page_text, quality_model, quality_rules, ranked_search, recurrent_lm, secret_scan, simhash, substrings,
    token_files, url_filter, url_filter_sql,
)
from accordant.session import scratch_path, tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_files")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded into token files, read back from them."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "tokens")
    token_files.write_tokens(docs, folder, tokenizer("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    return token_files.read_tokens(spark, folder, with_ids=False)


@query("op2_quality_model")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    return quality_model.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in runs of 35 that occur elsewhere too, removed from every document."""
    return substrings.removal_report(table(spark, sf_dir, "documents"))


@query("op4_secret_scan")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan.secret_report(table(spark, sf_dir, "documents"))


@query("op5_simhash_groups")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document and whether the fixed and the learned rules keep it."""
    return quality_rules.rule_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_report(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=2)


@query("op8_recurrent_lm")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent log probability of every document."""
    return recurrent_lm.score_report(table(spark, sf_dir, "documents"))


@query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test n-grams found in every document."""
    return decontaminate.hit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_page_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article text of every page."""
    return page_text.extract_text(table(spark, sf_dir, "pages"))


@query(
    "op11_ranked_search",
    r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS terms FROM documents),
       sized AS (SELECT k, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
       totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
       tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(terms) AS term FROM d) GROUP BY k, term),
       df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
       i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark),
       w AS (SELECT i.item_id, i.term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM i JOIN df ON df.term = i.term, totals),
       s AS (SELECT w.item_id, sized.doc_id, sized.k, CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + ((50 * sized.n * big_n) // big_l))))) AS BIGINT) AS score
         FROM w JOIN tf ON tf.term = w.term JOIN sized ON sized.k = tf.k, totals GROUP BY w.item_id, sized.doc_id, sized.k),
       r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
       SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


URL_RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


@query("op12_url_filter", url_filter_sql.text(URL_RULES))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), [url_filter.rule(r) for r in URL_RULES])


@query(
    "op13_filter_audit",
    r"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
       l AS (SELECT doc_id, coalesce(bool_or(quality = 1), FALSE) AS good, coalesce(bool_or(toxic = 1), FALSE) AS toxic FROM labels GROUP BY doc_id),
       m AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
           CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
           + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
           + CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
         FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
       cells AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
       letters AS (SELECT chr(65 + CAST(k AS INTEGER)) AS letter, 1 << CAST(k AS INTEGER) AS bit FROM range(5) r(k)),
       prefixes AS (SELECT '' AS prefix, 0 AS step, 0 AS applied, 0 AS bit, '' AS letter
         UNION ALL SELECT p.prefix || l.letter, p.step + 1, p.applied | p.bit, l.bit, l.letter FROM prefixes p JOIN letters l ON (p.applied | p.bit) & l.bit = 0),
       steps AS (SELECT part, prefix, step, letter,
           CAST(coalesce(sum(n) FILTER (mask & (applied | bit) = 0), 0) AS BIGINT) AS kept,
           CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied = 0), 0) AS BIGINT) AS removed,
           CAST(coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & applied <> 0), 0) AS BIGINT) AS redundant,
           CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
           CAST(coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & applied = 0), 0) AS BIGINT) AS good_lost,
           CAST(coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & applied = 0), 0) AS BIGINT) AS toxic_lost
         FROM prefixes, cells WHERE step > 0 GROUP BY part, prefix, step, letter),
       every AS (SELECT s.*, o.prefix AS filter_order FROM prefixes o JOIN steps s ON starts_with(o.prefix, s.prefix) WHERE o.step = 5),
       shares AS (SELECT part, letter, CAST(sum(removed) AS BIGINT) AS shapley FROM every GROUP BY part, letter)
       SELECT every.part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
       FROM every JOIN shares ON shares.part = every.part AND shares.letter = every.letter""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each source, in every order of them."""
    return filter_audit.audit_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
