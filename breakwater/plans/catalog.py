"""The registered queries of the series engine and their DuckDB counterparts."""

from __future__ import annotations

from breakwater.functions import user
from breakwater.operators import change, contrasts, distances, dynamics, filters, learning, matrix, preprocessing, probabilities, spectra, tails
from breakwater.plans import engine, multiscale

FAMILIES = [f for m in (preprocessing, contrasts, distances, tails, dynamics, filters, spectra, change, probabilities, matrix) for f in m.FAMILIES]

QUERIES: dict = {f.name: f.query for f in FAMILIES}
ORACLES: dict[str, str] = {f.name: f.oracle() for f in FAMILIES}

QUERIES |= {f.name: f.query for f in spectra.PLAIN}
QUERIES |= user.QUERIES
ORACLES |= user.ORACLES | engine.ORACLES
QUERIES |= learning.QUERIES | engine.QUERIES | multiscale.QUERIES
