"""Configuration files (TOML, or YAML where its library is there): references, includes, secrets and constant expressions."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from riverbend.expr.syntax import UNITS, duration, has_interpolation, looks_like_expression, parse, parse_template
from riverbend.expr.tree import Call, Literal, Node, Text
from riverbend.operators.mapping import Rule, rules
from riverbend.sinks import Conflict, Sink
from riverbend.sources import Source

#: Rows of one batch where a flow does not say; fixed value.
BATCH_LIMIT = 1024
#: Most bound values of one batch, rows times columns; fixed value.
BIND_LIMIT = 60_000


class ConfigError(ValueError):
    """A configuration that can't be read or does not hold together."""


@dataclass(frozen=True)
class Flow:
    name: str
    source: Source
    sink: Sink
    storage: str
    table: str
    target: str
    rules: tuple[Rule, ...]
    cursor: tuple[str, ...] = ()
    ascending: bool = True
    interval: float = 1.0
    batch_limit: int | None = BATCH_LIMIT
    conflict: Conflict | None = None
    validation: Mapping[str, Any] = field(default_factory=dict)
    query_timeout: float | None = None
    jitter: float = 0.0


@dataclass(frozen=True)
class Config:
    flows: dict[str, Flow]
    storages: dict[str, str]
    stores: dict[str, tuple[str, Mapping[str, Any]]] = field(default_factory=dict)


_REFERENCE = re.compile(r"\$\{([A-Za-z_][A-Za-z0-9_]*)(?::-([^}]*))?\}")


def expand(text: str, secrets: Mapping[str, str], env: Mapping[str, str] | None = None) -> str:
    """${NAME} and ${NAME:-default} from the environment, then secrets; $$ is a dollar."""
    known = os.environ if env is None else env

    def one(m: re.Match) -> str:
        value = known.get(m[1], secrets.get(m[1], m[2] or None))
        if value is None:
            raise ConfigError(f"unresolved reference {m[1]}")
        return value

    return "$".join(_REFERENCE.sub(one, piece) for piece in text.split("$$"))


def _read(path: Path) -> dict:
    raw = path.read_text()
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ModuleNotFoundError:
            raise ConfigError(f"{path}: YAML can't be read here") from None
        return yaml.safe_load(raw) or {}
    return tomllib.loads(raw)


def _walk(value: Any, f) -> Any:
    if isinstance(value, dict):
        return {k: _walk(v, f) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v, f) for v in value]
    return f(value) if isinstance(value, str) else value


def _merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        if isinstance(v, dict) and isinstance(out.get(k), dict):
            out[k] = _merge(out[k], v)
        elif isinstance(v, list) and isinstance(out.get(k), list):
            out[k] = out[k] + v
        elif k in out:
            raise ConfigError(f"{k} is configured twice")
        else:
            out[k] = v
    return out


def constant(text: str, env: Mapping[str, str], folder: str) -> str:
    """A component's text: a call of env or file, or a template with such calls, is worked out; anything else stays as it is."""
    if not (looks_like_expression(text) or has_interpolation(text)):
        return text

    def value(node: Node) -> Any:
        if isinstance(node, Literal):
            return node.value
        if isinstance(node, Text):
            return "".join(p if isinstance(p, str) else str(value(p) if value(p) is not None else "") for p in node.parts)
        if isinstance(node, Call) and node.name == "env":
            args = [value(a) for a in node.args]
            return env.get(args[0], args[1] if len(args) > 1 else None)
        if isinstance(node, Call) and node.name == "file":
            root, full = os.path.realpath(folder), os.path.realpath(os.path.join(folder, value(node.args[0])))
            if os.path.commonpath([root, full]) != root:
                raise ConfigError("file: the path leaves the folder")
            return Path(full).read_text().rstrip("\n")
        if isinstance(node, Call) and node.name in ("concat", "add"):
            return "".join(str(value(a)) for a in node.args)
        raise ConfigError(f"{text!r} is not constant")

    return str(value(parse(text) if looks_like_expression(text) else parse_template(text)))


def seconds(value: Any) -> float:
    if isinstance(value, (int, float)):
        return float(value)
    found = duration(str(value))
    if found is None:
        raise ConfigError(f"{value!r} is no duration")
    return found.micros / UNITS["s"]


def load(path: str, env: Mapping[str, str] | None = None) -> Config:
    """Reads a file and what it includes (files and folders, relative to it)."""
    known = dict(os.environ if env is None else env)
    main = Path(path)
    raw = _read(main)
    for name in (raw.get("config") or {}).get("include", []):
        place = main.parent / name
        for part in sorted(p for p in place.iterdir() if p.suffix in (".toml", ".yaml", ".yml")) if place.is_dir() else [place]:
            raw = _merge(raw, _read(part))
    secrets = {k: str(v) for k, v in (raw.pop("secrets", None) or {}).items()}
    raw = _walk(raw, lambda s: expand(s, secrets, known))
    return build(raw, known, str(main.parent))


def build(raw: dict, env: Mapping[str, str] | None = None, folder: str = ".") -> Config:
    known = env or {}

    def parts(section: str) -> dict[str, dict]:
        out = {}
        for x in raw.get(section, []):
            if x["name"] in out:
                raise ConfigError(f"{section}: {x['name']} is configured twice")
            out[x["name"]] = x | {"config": _walk(x.get("config", {}), lambda s: constant(s, known, folder))}
        return out

    sources, sinks, storages = parts("sources"), parts("sinks"), parts("storages")
    flows = {name: _flow(name, x, sources, sinks, storages) for name, x in (raw.get("flow") or {}).items()}
    return Config(flows, {n: s["config"].get("path", s["config"].get("url", "")) for n, s in storages.items()}, {n: (s["type"], s["config"]) for n, s in storages.items()})


def _reference(name: str, value: Any, known: dict[str, dict], what: str) -> tuple[dict, dict]:
    options = dict(value) if isinstance(value, dict) else {"name": value}
    target = options.pop("name")
    if target not in known:
        raise ConfigError(f"flow {name}: unknown {what} {target!r}")
    return known[target], options


def _flow(name: str, x: dict, sources: dict, sinks: dict, storages: dict) -> Flow:
    for key in ("source", "sink", "storage", "from", "to"):
        if key not in x:
            raise ConfigError(f"flow {name}: {key} is missing")
    source, source_options = _reference(name, x["source"], sources, "source")
    sink, sink_options = _reference(name, x["sink"], sinks, "sink")
    if x["storage"] not in storages:
        raise ConfigError(f"flow {name}: unknown storage {x['storage']!r}")
    made = Source(source["name"], source["type"], source["config"], source_options)
    cursor = x.get("cursor") or {}
    fields = tuple(cursor.get("fields", ()))
    if made.is_stream == bool(fields):
        raise ConfigError(f"flow {name}: a change stream has no cursor fields, any other source needs them")
    limit = x.get("batch-limit", BATCH_LIMIT)
    given = tuple(rules(x.get("mapping") or {}, x.get("compute-mapping")))
    conflict = x.get("conflict")
    if limit and limit * len(given) > BIND_LIMIT and sink["type"] not in ("parquet", "redis"):
        raise ConfigError(f"flow {name}: batch-limit times columns is over {BIND_LIMIT}")
    return Flow(
        name, made, Sink(sink["name"], sink["type"], sink["config"], sink_options), x["storage"], x["from"], x["to"], given, fields,
        cursor.get("order", "asc") == "asc", seconds(cursor.get("interval", "1s")), limit or None, Conflict(tuple(conflict["key"]), conflict["strategy"]) if conflict else None,
        x.get("validation") or {}, seconds(x["query-timeout"]) if "query-timeout" in x else None,
        seconds(cursor.get("jitter", 0)),
    )
