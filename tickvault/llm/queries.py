"""Importing this module registers every training-data query."""

from tickvault.llm import (  # noqa: F401
    alignment, ball_tree, bpe_tree, chat, exact_dedup, fingerprints, html_text, near_dedup, packing, quality,
    substring_dedup, token_files, weak_rules)
from tickvault.llm.common import ORACLES, QUERIES  # noqa: F401
