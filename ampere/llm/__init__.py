"""Operators of a training-data pipeline (deduplication, personal data,
packing, licences, fingerprints, extraction, sharding, decontamination,
toxicity) and their registered queries."""

from ampere.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
