"""Detectors by name: each takes a series DataFrame and returns a DataFrame of manoeuvres."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Detector = Callable[[DataFrame], DataFrame]
_DETECTORS: dict[str, Detector] = {}
_WAITING = ("bilstm-base", "transformer-base", "chronos-residual")  # names without a scorer of their own


def register_detector(name: str, detector: Detector) -> None:
    if name in _DETECTORS:
        raise ValueError(f"detector {name!r} is registered already")
    _DETECTORS[name] = detector


def register_bundle(name: str, folder: str) -> None:
    """A trained recurrent detector, read from a bundle; it may take the place of a name that waits for its scorer."""
    from .operators.sequence import Bundle

    detector = Bundle.load(folder).detect
    if name in _WAITING and _DETECTORS[name].__name__ == "missing":
        del _DETECTORS[name]
    register_detector(name, detector)


def available_models() -> list[str]:
    return sorted(_DETECTORS)


def get_detector(name: str) -> Detector:
    if name not in _DETECTORS:
        raise ValueError(f"unknown model {name!r}; available: {', '.join(available_models())}")
    return _DETECTORS[name]


def detect(series: DataFrame, model: str = "classical") -> DataFrame:
    return get_detector(model)(series)


def _classical(series: DataFrame) -> DataFrame:
    from .operators.detect import detect_rule

    return detect_rule(series)


def _drift(series: DataFrame) -> DataFrame:
    from .operators.learned import detect_residual

    return detect_residual(series)


def _needs_scorer(name: str) -> Detector:
    def missing(series: DataFrame) -> DataFrame:
        raise RuntimeError(f"{name} needs a trained scorer: register one with register_detector")

    return missing


register_detector("classical", _classical)
register_detector("drift-residual", _drift)
for _name in _WAITING:
    register_detector(_name, _needs_scorer(_name))
