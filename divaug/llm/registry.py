"""All registered queries of this subpackage."""

from __future__ import annotations

from divaug.llm import common
from divaug.llm import (op01_url_aliases, op02_spaced_seed, op03_surrogates, op04_transducer_bpe, op05_site_bayes, op06_centroid_lang,  # noqa: F401
                        op07_bounded_ring, op08_bottom_k, op09_probminhash, op10_mil_toxicity, op11_periodic_runs, op12_prefix_trie, op13_golomb_dedup)

QUERIES = common.QUERIES
ORACLE = common.ORACLE
