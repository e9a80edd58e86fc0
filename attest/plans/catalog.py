"""The engine's named queries over the standard tables, and their SQL."""

from __future__ import annotations

from . import biometrics, cards, documents, evidence, identity_cards, journeys, payloads, pixel_tables, portraits, projections, rules, zones

QUERIES = {**biometrics.QUERIES, **identity_cards.QUERIES, **journeys.QUERIES, **portraits.QUERIES, **pixel_tables.QUERIES, **rules.QUERIES, **projections.QUERIES, **cards.QUERIES, **evidence.QUERIES, **documents.QUERIES, **payloads.QUERIES, **zones.QUERIES}
ORACLES = {**biometrics.ORACLES, **identity_cards.ORACLES, **journeys.ORACLES, **portraits.ORACLES, **pixel_tables.ORACLES, **rules.ORACLES, **projections.ORACLES, **cards.ORACLES, **evidence.ORACLES, **documents.ORACLES, **payloads.ORACLES, **zones.ORACLES}
