"""Manoeuvre detection over orbital-element series, as Spark plans."""

from .registry import available_models, detect, get_detector, register_detector

__all__ = ["available_models", "detect", "get_detector", "register_detector"]
