"""The queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from . import (
    bpe,
    decontaminate,
    exact_dedup,
    hard_negatives,
    hosts,
    huffman,
    line_templates,
    mixing,
    reshard,
    simhash,
    spelling,
    toxicity,
    warc,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_reshard": reshard.op2_reshard,
    "op3_line_templates": line_templates.op3_line_templates,
    "op4_simhash": simhash.op4_simhash,
    "op5_bpe": bpe.op5_bpe,
    "op6_hosts": hosts.op6_hosts,
    "op7_mixing": mixing.op7_mixing,
    "op8_huffman": huffman.op8_huffman,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_warc": warc.op12_warc,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE = {
    "op3_line_templates": line_templates.OP3_SQL,
    "op6_hosts": hosts.OP6_SQL,
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_warc": warc.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
