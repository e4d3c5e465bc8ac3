"""Settings merged from a file, the environment and overrides, in that order of growing precedence."""

from __future__ import annotations

from collections.abc import Mapping
from pathlib import Path
from types import MappingProxyType


class ConfigError(ValueError):
    """A required setting is missing or blank."""


def parse_env_file(path: str | Path) -> dict[str, str]:
    """KEY=value lines; blank lines, comments and lines without ``=`` do not count, and matching quotes are stripped."""
    out = {}
    p = Path(path)
    if not p.exists():
        return out
    for line in p.read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().partition("=")
        if not eq or not key.strip() or key.startswith("#"):
            continue
        value = value.strip()
        if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"":
            value = value[1:-1]
        out[key.strip()] = value
    return out


def load_config(defaults: Mapping[str, str], *, required: tuple[str, ...] = (), env_file: str | Path | None = None, env: Mapping[str, str] | None = None, overrides: Mapping[str, str | None] | None = None) -> Mapping[str, str]:
    """A read-only mapping of the keys in ``defaults`` and ``required``; values are trimmed and must not be blank."""
    merged = dict(defaults)
    keys = {*defaults, *required}
    for layer in (parse_env_file(env_file) if env_file else {}, env or {}, {k: v for k, v in (overrides or {}).items() if v is not None}):
        merged |= {k: v for k, v in layer.items() if k in keys}
    merged = {k: v.strip() if isinstance(v, str) else v for k, v in merged.items()}
    bad = sorted(k for k in keys if merged.get(k) in (None, ""))
    if bad:
        raise ConfigError(f"missing or blank settings: {', '.join(bad)}")
    return MappingProxyType(merged)
