"""Checks and connectors that other packages declare as entry points.

``assayline.checks`` points at kinds of checks, ``assayline.connectors`` at functions from
(spark, source) to a DataFrame. Neither can take the place of what is built in.
"""

from __future__ import annotations

import warnings
from importlib.metadata import entry_points

from .operators.checks import register_plugin
from .sources.resolve import register_connector


def load() -> list[str]:
    """Registers all plugins that can be loaded; a broken one is a warning. Returns names."""
    loaded = []
    for group, register in (("assayline.checks", lambda name, kind: register_plugin(kind)), ("assayline.connectors", register_connector)):
        for point in entry_points(group=group):
            try:
                register(point.name, point.load())
                loaded.append(point.name)
            except Exception as e:
                warnings.warn(f"plugin {point.name} of {group}: {e}", stacklevel=2)
    return loaded
