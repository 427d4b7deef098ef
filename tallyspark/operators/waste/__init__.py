"""Waste detectors. Each takes a Corpus and returns zero or one finding per tenant."""

from . import detectors  # noqa: F401
from .detectors import DETECTORS  # noqa: F401
