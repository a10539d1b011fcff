"""Configuration files: YAML, JSON or TOML, which must hold a mapping with the required keys."""

from __future__ import annotations

import json
import re
import tomllib
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:  # then the plain subset below is read
    yaml = None

#: The settings that come with the package.
DEFAULT = Path(__file__).resolve().parent / "default.yaml"


class ConfigError(ValueError):
    pass


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in ("'", '"') and text[-1:] == text[:1]:
        return text[1:-1]
    text = re.sub(r"(^|\s)#.*", "", text).strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text.lower() in ("", "null", "~"):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def read_plain_yaml(text: str) -> Any:
    """Mappings and lists nested by indentation, and scalars: what configuration files need of YAML."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.lstrip().startswith("#") and x.strip() != "---"]

    def block(at: int, indent: int) -> tuple[Any, int]:
        out: Any = [] if lines[at][1].startswith("- ") else {}
        while at < len(lines) and lines[at][0] == indent:
            line = lines[at][1]
            if isinstance(out, list) != line.startswith("- "):
                raise ConfigError(f"mapping and list mixed: {line}")
            if isinstance(out, list):
                out.append(_scalar(line[2:]))
                at += 1
                continue
            key, colon, rest = line.partition(":")
            if not colon:
                raise ConfigError(f"no key: {line}")
            at += 1
            value = _scalar(rest)
            if value is None and at < len(lines) and (lines[at][0] > indent or (lines[at][0] == indent and lines[at][1].startswith("- "))):
                value, at = block(at, lines[at][0])
            out[_scalar(key)] = value
        if at < len(lines) and lines[at][0] > indent:
            raise ConfigError(f"unexpected indentation: {lines[at][1]}")
        return out, at

    return block(0, lines[0][0])[0] if lines else None


def _read(path: Path) -> Any:
    text = path.read_text(encoding="utf-8")
    if path.suffix == ".toml":
        return tomllib.loads(text)
    if path.suffix in (".yaml", ".yml"):
        return read_plain_yaml(text) if yaml is None else yaml.safe_load(text)
    return json.loads(text)


def load(path: str | Path, required: tuple[str, ...] = ()) -> dict[str, Any]:
    """The mapping in the file; dotted names in ``required`` must lead to a value."""
    path = Path(path)
    try:
        found = _read(path)
    except (ValueError, *(() if yaml is None else (yaml.YAMLError,))) as e:
        raise ConfigError(f"{path}: {e}") from e
    if not isinstance(found, dict):
        raise ConfigError(f"{path}: not a mapping")
    check(found, required)
    return found


def check(config: dict[str, Any], required: tuple[str, ...]) -> None:
    missing = []
    for name in required:
        at: Any = config
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is None:
            missing.append(name)
    if missing:
        raise ConfigError("missing: " + ", ".join(missing))
