"""Settings from YAML, and logging set up from them."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field
from pathlib import Path

import yaml

from .errors import InvalidSettingsError
from .plans.fields import Fields


@dataclass(frozen=True)
class PathsConfig:
    projects_root: Path
    plugins_root: Path | None = None


@dataclass(frozen=True)
class LoggingConfig:
    level: str = "INFO"
    log_file: Path | None = None


@dataclass(frozen=True)
class AppConfig:
    paths: PathsConfig
    logging: LoggingConfig = field(default_factory=LoggingConfig)


def load_config(path: str | Path) -> AppConfig:
    path = Path(path)
    try:
        data = yaml.safe_load(path.read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError) as e:
        raise InvalidSettingsError(f"can't read settings {path}: {e}") from e
    except yaml.YAMLError as e:
        raise InvalidSettingsError(f"settings {path} are not valid YAML: {e}") from e
    of = lambda value, where: Fields(value, where, InvalidSettingsError, null_is_absent=True)
    top = of(data, f"settings {path}")
    paths, log = of(top.data.get("paths"), f"settings {path}, paths"), of(top.data.get("logging") or {}, f"settings {path}, logging")
    as_path = lambda text: Path(text) if text is not None else None
    return AppConfig(PathsConfig(Path(paths.text("projects_root")), as_path(paths.text_or("plugins_root"))), LoggingConfig(log.text_or("level", "INFO"), as_path(log.text_or("log_file"))))


def configure_logging(config: LoggingConfig) -> logging.Logger:
    """The package's logger with a handler for the console and, if set, one for a file. Repeated calls replace them."""
    logger = logging.getLogger("canvass")
    level = logging.getLevelName(config.level.upper())
    if not isinstance(level, int):
        raise InvalidSettingsError(f"unknown log level {config.level!r}")
    logger.setLevel(level)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if config.log_file is not None:
        config.log_file.parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(config.log_file, encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        logger.addHandler(h)
    return logger
