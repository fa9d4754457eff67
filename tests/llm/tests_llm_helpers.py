"""Brute-force versions shared by the tests."""

from test_llm_bpe_pack import check_pieces  # noqa: F401
from test_llm_pairs import brute_jaccard  # noqa: F401
from test_llm_rules import plain_dedup  # noqa: F401
