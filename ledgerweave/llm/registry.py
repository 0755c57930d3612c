"""Queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, minhash, mpeg, packing, periodic, phrases, planes, quality, repeats, sentences, toxicity, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_suffix_array_dedup": repeats.op2_suffix_array_dedup,
    "op3_toxicity_mil": toxicity.op3_toxicity_mil,
    "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
    "op5_bit_planes": planes.op5_bit_planes,
    "op6_mpeg_audio": mpeg.op6_mpeg_audio,
    "op7_url_filter": urls.op7_url_filter,
    "op8_quality_neighbours": quality.op8_quality_neighbours,
    "op9_best_fit_packing": packing.op9_best_fit_packing,
    "op10_chat_snapshots": chat.op10_chat_snapshots,
    "op11_phrase_collocations": phrases.op11_phrase_collocations,
    "op12_sentencepiece": sentences.op12_sentencepiece,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLES: dict[str, str] = {"op10_chat_snapshots": chat.OP10_SQL}
