"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from exposura.llm.ann import nearest
from exposura.llm.bpe import bpe_encode, ids_digest
from exposura.llm.dataset_queries import ORACLES as DATASET_ORACLES, QUERIES as DATASET_QUERIES
from exposura.llm.decontaminate import contained_items
from exposura.llm.html_text import extract_text
from exposura.llm.lm_scoring import score_texts
from exposura.llm.ngram_join import ngram_join
from exposura.llm.secrets import scan_secrets, span_text
from exposura.llm.substrings import remove_repeats
from exposura.llm.toxicity import toxicity
from exposura.llm.url_filter import filter_urls

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(_table(spark, folder, "documents"))


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings")
    return nearest(rows, rows.where("vec_id % 20 = 0"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_secrets(_table(spark, folder, "documents").select("doc_id", "text"))
    def count(kind: str):
        return F.size(F.filter("base_secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(span_text("base_secrets"), 256).alias("base_sha256"), span_text("secrets").alias("spans"), "n_layers",
    )


def op5_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(_table(spark, folder, "pages"))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(_table(spark, folder, "pages"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(_table(spark, folder, "documents")).drop("kept")


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(_table(spark, folder, "documents"))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary_path()
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return bpe_encode(docs, path, decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_decontamination": op2_decontamination,
    "op3_nearest": op3_nearest,
    "op4_secret_scan": op4_secret_scan,
    "op5_html_text": op5_html_text,
    "op6_url_filter": op6_url_filter,
    "op7_toxicity": op7_toxicity,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_bpe": op10_bpe,
    **DATASET_QUERIES,
}

# Words of a text, A-Z lower-cased, in DuckDB.
_WORDS = """[x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+') if x <> '']"""

_CONTAINMENT_SQL = f"""
with item_words as (select distinct item_id, {_WORDS} as w from benchmark),
items as (
  select item_id, len(w) as size, case when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as names
  from item_words where len(w) > 0 and item_id is not null
),
doc_words as (select doc_id, {_WORDS} as w from documents where doc_id is not null),
sizes as (select distinct least(size, 5) as size from items),
doc_names as (
  select distinct doc_id, unnest([array_to_string(w[i:i + size - 1], ' ') for i in range(1, len(w) - size + 2)]) as name
  from doc_words, sizes
),
item_names as (select item_id, len(names) as n_item, unnest(names) as name from items)
select doc_id, item_id, n_item::bigint as n_item, count(*)::bigint as n_shared, count(*) / n_item as containment
from doc_names join item_names using (name) group by doc_id, item_id, n_item having count(*) * 100 >= n_item * 80
"""

_JACCARD_SQL = f"""
with recursive doc_words as (select doc_id, {_WORDS} as w from documents),
names as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)]) end as names
  from doc_words
),
singles as (select doc_id, len(names) as n, unnest(names) as name from names),
links as (
  select a.doc_id as a, b.doc_id as b from singles a join singles b on a.name = b.name and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
both_ways as (select a, b from links union all select b, a from links),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, e.b from reach r join both_ways e on e.a = r.other)
select n.doc_id, len(n.names)::bigint as n_shingles, min(r.other)::bigint as component_id
from names n join reach r using (doc_id) group by n.doc_id, len(n.names)
"""

ORACLES: dict[str, str] = {"op1_ngram_join": _JACCARD_SQL, "op2_decontamination": _CONTAINMENT_SQL, **DATASET_ORACLES}
