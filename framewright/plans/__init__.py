"""Queries, one module for each group of operators; importing this registers them."""

from . import aggregates, bitstreams, bytestreams, containers, extras, headers, kernels, lookups, mapping, media, motion, ordering, prediction, registry, samples, sets, signals, streams, timing  # noqa: F401
