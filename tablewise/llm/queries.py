"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER_FILE = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op2_sharding")
def sharding(spark, folder):
    from tablewise.llm.sharding import shard_documents

    eight = {shard: 1.0 for shard in range(8)}
    return shard_documents(_table(spark, folder, "documents"), eight, eight | {8: 1.0})


@_query("op3_token_files")
def token_files(spark, folder):
    from tablewise.llm.token_files import read_token_index, scratch_token_files

    files = scratch_token_files(_table(spark, folder, "documents"), tokenizer_path(), end=0)
    return read_token_index(spark, files)


@_query("op8_packing")
def packing(spark, folder):
    from tablewise.llm.packing import pack_documents

    return pack_documents(_table(spark, folder, "documents"), tokenizer_path(), end=1, keep_ids=False)


@_query("op9_simhash")
def simhash(spark, folder):
    from pyspark.sql import functions as F

    from tablewise.llm.simhash import near_duplicates

    found = near_duplicates(_table(spark, folder, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op10_decontamination")
def decontamination(spark, folder):
    from tablewise.llm.decontaminate import contaminated

    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query("op5_toxicity")
def toxicity(spark, folder):
    from tablewise.llm.toxicity import fit_toxicity, fold, score_toxicity

    docs = _table(spark, folder, "documents")
    model = fit_toxicity(docs, _table(spark, folder, "labels"), learn=fold(3) != 1)
    return score_toxicity(docs, model).select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


@_query("op6_language")
def language(spark, folder):
    from tablewise.llm.language import fit_language, predict_language
    from tablewise.llm.toxicity import fold

    docs = _table(spark, folder, "documents")
    model = fit_language(docs, learn=fold(4) != 2)
    return predict_language(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@_query("op7_suffix_tree")
def suffix_tree(spark, folder):
    from tablewise.llm.suffix_tree import score_texts
    from tablewise.llm.toxicity import fold

    return score_texts(_table(spark, folder, "documents"), learn=fold(7) != 2)


@_query("op1_suffix_dedup")
def suffix_dedup(spark, folder):
    from tablewise.llm.suffix_dedup import remove_repeats

    found = remove_repeats(_table(spark, folder, "documents"), length=50, with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query("op4_media")
def media(spark, folder):
    from pyspark.sql import functions as F

    from tablewise.llm.media import image_classes, page_pictures

    found = image_classes(page_pictures(_table(spark, folder, "pages")))
    return found.select(
        "image_id", F.floor(F.col("image_id") / 3).alias("page_id"), (F.col("image_id") % 3).cast("int").alias("variant"),
        "class_id", "n_links",
    )


@_query("op13_resampling")
def resampling(spark, folder):
    from tablewise.llm.resample import importance_resample

    found = importance_resample(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@_query("op11_conversation_repair")
def conversation_repair(spark, folder):
    from pyspark.sql import functions as F

    from tablewise.llm.turns import damaged, repair_conversations, repair_digests

    turns, plans = repair_conversations(damaged(_table(spark, folder, "conversations")), F.col("copies"))
    return repair_digests(turns, plans)


@_query("op12_html_extraction")
def html_extraction(spark, folder):
    from tablewise.llm.extract import extract_text, fit_labeller

    pages = _table(spark, folder, "pages")
    return extract_text(pages, fit_labeller(pages))
