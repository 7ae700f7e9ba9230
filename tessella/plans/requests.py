"""Tool calls by name: arguments are renamed, unknown ones dropped with a note, missing ones filled in, then a query runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

# Other names of arguments.
ALIASES = {"model_family": "model", "models": "model", "bike": "model", "motorcycle": "model", "brands": "brand", "categories": "category"}


class RequestError(ValueError):
    """A call that cannot be run: an unknown tool, or an argument of the wrong kind."""


@dataclass(frozen=True)
class Tool:
    run: Callable[..., DataFrame]
    arguments: tuple[str, ...]
    required: tuple[str, ...] = ()
    defaults: dict[str, Callable[[dict[str, Any]], Any]] = field(default_factory=dict)


def renamed(tool: Tool, given: Iterable[str]) -> dict[str, str]:
    """What each given name becomes that is another name of an argument: the first such name of an argument that is not given itself."""
    wanted = [n for n in tool.arguments if n not in given]
    found = {ALIASES[n]: n for n in reversed(list(given)) if n not in tool.arguments and ALIASES.get(n) in wanted}
    return {other: name for name, other in found.items()}


def normalise(tool: Tool, arguments: dict[str, Any]) -> tuple[dict[str, Any], list[str]]:
    """The arguments that the tool takes, and notes on what was renamed, dropped or filled in."""
    names = renamed(tool, arguments)
    stray = [n for n in arguments if n not in names and n not in tool.arguments]
    out = {names.get(n, n): v for n, v in arguments.items() if n not in stray}
    lacking = [n for n in tool.required if not out.get(n)]
    if unfilled := [n for n in lacking if n not in tool.defaults]:
        raise RequestError(f"{', '.join(unfilled)} must be given")
    filled = {n: tool.defaults[n](out) for n in lacking}
    notes = [f"{old} is called {new} here" for old, new in names.items()] + [f"there is no {n}; it does nothing" for n in stray] + [f"{n} was left open; it is '{v}'" for n, v in filled.items()]
    return out | filled, notes


def run_tool(tools: dict[str, Tool], name: str, arguments: dict[str, Any]) -> tuple[DataFrame, list[str]]:
    if name not in tools:
        raise RequestError(f"unknown tool '{name}'")
    taken, notes = normalise(tools[name], arguments)
    try:
        return tools[name].run(**taken), notes
    except TypeError as e:
        raise RequestError(str(e)) from e
