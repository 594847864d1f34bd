"""Logging on the driver: a coloured console and a rotating file."""

from __future__ import annotations

import logging
import logging.handlers
import os
import sys

# Size and number of log files.
FILE_BYTES, BACKUPS = 5_242_880, 3
_COLOURS = {logging.DEBUG: 36, logging.INFO: 32, logging.WARNING: 33, logging.ERROR: 31, logging.CRITICAL: 35}
_FORM = "%(asctime)s | %(levelname)s | %(name)s | %(message)s"


class Coloured(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"\x1b[{_COLOURS.get(record.levelno, 0)}m{super().format(record)}\x1b[0m"


def get_logger(name: str = "corvane", folder: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """The logger of a name, set up once; with a folder it also writes <name>.log there."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not any(isinstance(h, logging.StreamHandler) and not isinstance(h, logging.FileHandler) for h in logger.handlers):
        console = logging.StreamHandler(sys.stderr)
        console.setFormatter((Coloured if sys.stderr.isatty() else logging.Formatter)(_FORM))
        logger.addHandler(console)
        logger.propagate = False
    if folder and not any(isinstance(h, logging.handlers.RotatingFileHandler) for h in logger.handlers):
        os.makedirs(folder, exist_ok=True)
        stored = logging.handlers.RotatingFileHandler(os.path.join(folder, f"{name}.log"), maxBytes=FILE_BYTES, backupCount=BACKUPS, encoding="utf-8")
        stored.setFormatter(logging.Formatter(_FORM))
        logger.addHandler(stored)
    return logger
