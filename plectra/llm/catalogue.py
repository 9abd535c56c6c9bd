"""Queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_centroids
from .decontaminate import op10_decontamination
from .language import op7_language
from .licenses import op5_license_scan
from .line_dedup import OP8_SQL, op8_line_dedup
from .ngram_join import op6_ngram_join
from .packing import op9_packing
from .pieces import op12_pieces
from .quality import op4_quality
from .resample import OP13_SQL, op13_resample
from .simhash import op3_fingerprints
from .suffix_dedup import op1_suffix_dedup
from .toxicity import op2_toxicity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprints": op3_fingerprints,
    "op4_quality": op4_quality,
    "op5_license_scan": op5_license_scan,
    "op6_ngram_join": op6_ngram_join,
    "op7_language": op7_language,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_pieces": op12_pieces,
    "op13_resample": op13_resample,
}

ORACLE_SQL = {
    "op8_line_dedup": OP8_SQL,
    "op11_centroids": OP11_SQL,
    "op13_resample": OP13_SQL,
}
