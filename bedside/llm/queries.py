"""One query per text operator, with production parameters over its whole table, and SQL for those that SQL can say."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import load_table
from .chat import repair_turns
from .decontaminate import contaminated, mark_contamination
from .filter_audit import audit_filters
from .lexical import rank_documents
from .line_dedup import drop_boilerplate
from .near_dedup import near_duplicates
from .pieces import encode_texts, load_vocabulary
from .pii import KINDS, find_personal_data, span_list
from .quality import fit_quality, score_quality
from .substring import remove_repeats
from .toxicity import fit_toxicity, score_toxicity
from .digest import compare_with_next
from .language import fit_language_model, held_out, identify_languages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Where the tokenizer files of the session are.
PIECE_MODEL = os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "piece_bpe_32k.model")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


@query(
    "op9_decontaminate",
    rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, 13 AS n, array_to_string(w[i:i + 12], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM item WHERE len(w) >= 13)
  UNION
  SELECT item_id, len(w), array_to_string(w, ' ') FROM item WHERE len(w) BETWEEN 1 AND 12
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), place AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM windows)
), hit AS (
  SELECT p.doc_id, p.i, p.n, v.item_id
  FROM place p JOIN windows v ON v.n = p.n AND v.words = array_to_string(p.w[p.i:p.i + p.n - 1], ' ')
), counted AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN counted USING (doc_id) LEFT JOIN named USING (doc_id)
""",
)
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark_contamination(docs, load_table(spark, sf_dir, "benchmark"))
    n_hit = F.size("hit_words").cast("long")
    return marked.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        sha256(F.array_join("hit_items", ",")).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(~held_out()).select("doc_id", "text", "lang"))
    found = identify_languages(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_set")


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in KINDS if k.always]
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in base],
        sha256(span_list(base)).alias("base_sha256"),
        span_list([k.name for k in KINDS]).alias("spans"),
        F.concat(*[F.transform(f"pii_{k.name}", lambda s: s["score"]) for k in KINDS]).alias("scores"),
    )


@query("op8_fingerprint")
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = compare_with_next(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return compared.select(
        "doc_id",
        "n_chars",
        sha256(F.col("edited_text")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
    )


@query(
    "op4_line_dedup",
    """
WITH line AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM documents
), host AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), common AS (
  SELECT l.source, trim(l.body) AS body
  FROM line l JOIN host h ON l.source IS NOT DISTINCT FROM h.source
  WHERE trim(l.body) <> ''
  GROUP BY l.source, h.pages, trim(l.body)
  HAVING count(DISTINCT l.doc_id) >= 5 AND count(DISTINCT l.doc_id) > 0.05 * h.pages
), marked AS (
  SELECT l.*, c.body IS NOT NULL AS bad
  FROM line l LEFT JOIN common c ON l.source IS NOT DISTINCT FROM c.source AND trim(l.body) = c.body
)
SELECT d.doc_id, coalesce(m.n_dropped, 0) AS n_dropped, sha256(coalesce(m.kept, CASE WHEN d.text IS NOT NULL THEN '' END)) AS kept_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) FILTER (WHERE bad) AS n_dropped, string_agg(body, chr(10) ORDER BY place) FILTER (WHERE NOT bad) AS kept
  FROM marked GROUP BY doc_id
) m USING (doc_id)
""",
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    kept = drop_boilerplate(docs, dropped="n_dropped")
    return kept.select("doc_id", "n_dropped", sha256(F.col("text")).alias("kept_sha256"))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out())
    model = fit_toxicity(docs.where(~held_out()), labels)
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = encode_texts(docs, load_vocabulary(PIECE_MODEL), check="round_trip")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two words a shingle, by the query's contract
    return near_duplicates(load_table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


@query("op10_substring_dedup")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeats(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return removed.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_chat_format")
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair_turns(turns).drop("text")


TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query(
    "op11_lexical_search",
    f"""
WITH item AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark)
), doc AS (
  SELECT doc_id, {TERMS} AS terms FROM documents
), total AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS holding, CAST(sum(len(terms)) AS BIGINT) AS everything FROM doc
), counted AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM doc) GROUP BY doc_id, n, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2 * holding + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, total GROUP BY term, holding
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * holding) // everything)))) AS BIGINT) AS score
  FROM item JOIN counted USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
""",
)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return rank_documents(docs, load_table(spark, sf_dir, "benchmark").select("item_id", "text"))


@query(
    "op13_filter_audit",
    r"""
WITH doc AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), least AS (
  SELECT body, min(doc_id) AS first_id FROM doc GROUP BY body
), masked AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask
  FROM doc JOIN least USING (body)
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masked LEFT JOIN known USING (doc_id) GROUP BY part, mask
), letter AS (
  SELECT unnest(range(5)) AS k
), orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS o FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5
), steps AS (
  SELECT list_aggregate(list_transform(o, lambda x: chr(CAST(65 + x AS INTEGER))), 'string_agg', '') AS filter_order, step,
    CAST(1 << o[step] AS INTEGER) AS own, CAST(coalesce(list_sum(list_transform(o[:step - 1], lambda x: 1 << x)), 0) AS INTEGER) AS before
  FROM (SELECT o, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM orders)
), summed AS (
  SELECT part, filter_order, step, own,
    CAST(sum(CASE WHEN mask & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN mask = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN mask & own <> 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
""",
)
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit_filters(docs, load_table(spark, sf_dir, "labels"))


@query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out())
    scored = score_quality(docs, fit_quality(docs.where(~held_out()), labels))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
