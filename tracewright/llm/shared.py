"""The shared folder of :mod:`tracewright.shared`, which the other operators use too."""

from __future__ import annotations

from tracewright.shared import release, shared_folder, written

__all__ = ["release", "shared_folder", "written"]
