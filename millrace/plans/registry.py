"""The modules that hold queries and their SQL."""

from millrace.plans import curation, discovery, hotkeys, metrics, packing, routing, scheduling, selection

MODULES = [hotkeys, curation, routing, packing, scheduling, metrics, selection, discovery]
