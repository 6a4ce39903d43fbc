"""Name of each query, its function and its SQL."""

from __future__ import annotations

from .plans import agents, boxes, converting, corpus, denoising, dialects, judging, pages, resample, samples, screens, steps

QUERIES = {}
ORACLES = {}
for _module in (agents, boxes, converting, corpus, denoising, dialects, judging, pages, resample, samples, screens, steps):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
