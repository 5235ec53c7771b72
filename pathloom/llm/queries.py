"""The corpus operators as queries over a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, htmltext, importance, infill, matroska, pieces, pii, quality, secretscan, sharding, simhash, substrings, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        simhash.op1_simhash,
        sharding.op2_hilbert_shards,
        urlfilter.op3_url_model,
        substrings.op4_substrings,
        pii.op5_personal_data,
        matroska.op6_matroska,
        pieces.op7_pieces,
        decontaminate.op8_decontamination,
        htmltext.op9_main_text,
        quality.op10_quality,
        infill.op11_fill_in_middle,
        secretscan.op12_secret_scan,
        importance.op13_importance,
    )
}

SQL: dict[str, str] = {"op4_substrings": substrings.OP4_SQL, "op8_decontamination": decontaminate.OP8_SQL, "op11_fill_in_middle": infill.OP11_SQL, "op13_importance": importance.OP13_SQL}
