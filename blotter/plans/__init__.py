"""The analyses of the incident table, from raw text to result tables."""

from blotter.plans.reports import *  # noqa: F403
from blotter.plans.reports import __all__
