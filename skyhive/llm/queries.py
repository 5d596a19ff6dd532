"""The queries of this subpackage: one per operator, and the pipeline."""

from __future__ import annotations

import importlib

#: Query name -> module that holds the function of that name.
MODULES = {
    "op1_sentencepiece": "sentencepiece",
    "op2_substrings": "substrings",
    "op3_fingerprints": "fingerprint",
    "op4_hmm": "hmm",
    "op5_warc": "warc",
    "op6_packing": "packing",
    "op7_simhash": "simhash",
    "op8_token_ids": "token_ids",
    "op9_quality": "quality",
    "op10_max_score": "topk",
    "op11_whitening": "whitening",
    "op12_phrases": "phrases",
    "op13_byte_bpe": "byte_merges",
}


def all_queries():
    return {name: getattr(importlib.import_module(f"skyhive.llm.{module}"), name) for name, module in MODULES.items()}


def all_oracles() -> dict[str, str]:
    from skyhive.llm.phrases import OP12_SQL
    from skyhive.llm.topk import OP10_SQL

    return {"op10_max_score": OP10_SQL, "op12_phrases": OP12_SQL}
