"""Queries of the training-data operators, and their SQL where SQL can express them."""

from litlens.llm import licenses, token_rollup
from litlens.llm.bpe import op8_bpe
from litlens.llm.conversations import op12_conversation_repair
from litlens.llm.decontaminate import op3_decontaminate
from litlens.llm.fuzzy_lines import op6_fuzzy_lines
from litlens.llm.hnsw import op10_hnsw
from litlens.llm.importance import op13_importance
from litlens.llm.jaccard import op7_ngram_join
from litlens.llm.licenses import op11_license_scan
from litlens.llm.pii_crf import op1_pii_crf
from litlens.llm.rule_quality import op4_rule_quality
from litlens.llm.suffix_dedup import op5_suffix_dedup
from litlens.llm.token_rollup import op2_token_rollup
from litlens.llm.url_templates import op9_url_templates

QUERIES = {"op1_pii_crf": op1_pii_crf, "op2_token_rollup": op2_token_rollup, "op3_decontaminate": op3_decontaminate, "op4_rule_quality": op4_rule_quality, "op5_suffix_dedup": op5_suffix_dedup, "op6_fuzzy_lines": op6_fuzzy_lines, "op7_ngram_join": op7_ngram_join, "op8_bpe": op8_bpe, "op9_url_templates": op9_url_templates, "op10_hnsw": op10_hnsw, "op11_license_scan": op11_license_scan, "op12_conversation_repair": op12_conversation_repair, "op13_importance": op13_importance}
ORACLES: dict[str, str] = {"op2_token_rollup": token_rollup.ORACLE, "op11_license_scan": licenses.ORACLE}
