"""Helpers that shape plans: durable cuts, sorted slices, checked broadcasts."""

from millrace.plans.durable import durable, shared_dir
from millrace.plans.names import fresh, merge_columns
from millrace.plans.ship import packed, unpacked
from millrace.plans.sizes import broadcast_if_small

__all__ = ["broadcast_if_small", "durable", "fresh", "merge_columns", "packed", "shared_dir", "unpacked"]
