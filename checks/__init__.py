"""Registered queries, their SQL oracles, and the clinical-shaped inputs both are run on."""
