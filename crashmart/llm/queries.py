"""The operators applied to the whole test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .alignment import alignment
from .exact_dedup import EXACT_SQL, exact_dedup
from .importance import importance, importance_sql
from .line_dedup import LEAST, RATIO, drop_lines
from .licenses import scan, scan_sql
from .near_duplicates import near_duplicates
from .packing import pack, pieces
from .piece_offsets import digests
from .private_data import BASE, fit, private_data, written
from .segment_search import top_k, whole_numbers
from .separator_scan import token_counts, token_files
from .toxicity import toxicity
from .tree_search import nearest_by_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary(name: str) -> str:
    """Place of a public tokenizer file; the driver and every executor have the same package installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


ORACLES["op1_license_scan"] = scan_sql()


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages")


@query
def op3_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_by_tree(table(spark, sf_dir, "embeddings"), every=20, k=20)


@query
def op4_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_numbers(table(spark, sf_dir, "embeddings"), 1024)
    found = top_k(rows.where(F.col("id") % 100 == 0), rows, k=10)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


ORACLES["op4_segment_search"] = """
with whole as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
               where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, r.vec_id, list_dot_product(q.v, r.v)::bigint as score
           from whole q join whole r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id and len(q.v) = len(r.v))
select query_id, rank::integer as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10
"""


@query
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 4096), 4096)


@query
def op7_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


ORACLES["op8_line_dedup"] = f"""
with pages as (select distinct source, coalesce(text, '') as text from documents),
lines as (select distinct source, text, line from (select source, text, unnest(string_split(text, chr(10))) as line from pages) where trim(line, ' ') <> ''),
totals as (select source, count(*) as pages from pages group by source),
boilerplate as (select l.source, l.line from lines l join totals t on l.source is not distinct from t.source
                group by l.source, l.line, t.pages having count(*) >= {LEAST} and count(*) > {RATIO} * t.pages),
sets as (select source, list(line) as cut from boilerplate group by source)
select d.doc_id, d.source,
       case when s.cut is null or d.text is null then d.text
            else array_to_string(list_filter(string_split(d.text, chr(10)), lambda x: not list_contains(s.cut, x)), chr(10)) end as text
from documents d left join sets s on d.source is not distinct from s.source
"""


@query
def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return token_counts(files).select("doc_id", F.col("file").alias("file_no"), "doc_no", "start", "n_tokens", "ended")


@query
def op10_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = private_data(docs, fit(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


@query
def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_importance"] = importance_sql()


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("batch")


ORACLES["op12_exact_dedup"] = EXACT_SQL


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
