"""Token-usage ledger on Spark."""

from turnledger.operators.deltas import turn_usage
from turnledger.plans.read_logs import read_logs
from turnledger.plans.sync import sync
from turnledger.session import configure
from turnledger.sources.files import Source
from turnledger.sources.ledger import Ledger
from turnledger.sources.pricing import bundled_pricing, load_pricing

__all__ = [
    "Ledger",
    "Source",
    "bundled_pricing",
    "configure",
    "load_pricing",
    "read_logs",
    "sync",
    "turn_usage",
]
