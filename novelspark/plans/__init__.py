"""Registered queries and their SQL twins."""

from novelspark.plans import archives, encoders, novelty, walks

PLANS = (walks, archives, novelty, encoders)
