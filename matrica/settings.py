"""How much is said: one setting for a session, and a scope for one call."""

from __future__ import annotations

import functools
import inspect
import logging
from dataclasses import dataclass

log = logging.getLogger("matrica")
LEVELS = {0: logging.ERROR, 1: logging.WARNING, 2: logging.INFO, 3: logging.DEBUG}


@dataclass
class Settings:
    """``verbosity`` 0 (errors) to 3 (debug); ``dense_warning_gb`` announces larger dense grids."""

    verbosity: int = 1
    dense_warning_gb: float = 4.0

    def set_verbosity(self, level: int) -> None:
        if level not in LEVELS:
            raise ValueError(f"verbosity is 0 to 3, not {level!r}")
        self.verbosity = level
        log.setLevel(LEVELS[level])


settings = Settings()


def resolve_verbose(verbose: bool | None = None, config=None) -> bool:
    """The argument, else the config's ``verbose``, else whether the logger tells of progress."""
    if verbose is not None:
        return verbose
    of = getattr(config, "verbose", None)
    return bool(of) if of is not None else log.isEnabledFor(logging.INFO)


def verbosity_aware(fn):
    """The logger's level follows ``verbose`` (or the config's) during the call and is put back after it."""

    @functools.wraps(fn)
    def call(*args, **kw):
        given = inspect.signature(fn).bind_partial(*args, **kw).arguments
        before = log.level
        log.setLevel(logging.INFO if resolve_verbose(given.get("verbose"), given.get("config")) else logging.WARNING)
        try:
            return fn(*args, **kw)
        finally:
            log.setLevel(before)

    return call
