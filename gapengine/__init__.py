"""A PySpark engine that turns user signals and a planning backlog into a ranked, evidence-checked list of unmet needs."""
