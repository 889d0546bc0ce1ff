"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import ann_partition, chat_format, embed_dedup, license_scan, lm_scoring, mixing, packing, quality, secret_scan, simhash

_MODULES = [secret_scan, ann_partition, license_scan, packing, embed_dedup, lm_scoring, simhash, quality, chat_format, mixing]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
