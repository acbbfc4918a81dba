"""Named function surface: registered operators with typed arguments and resources addressed by a template."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

JSON_TYPES = {int: "integer", float: "number", str: "string", bool: "boolean", list: "array", dict: "object"}


@dataclass
class Registry:
    """Tools are functions ``(spark, **typed arguments) -> DataFrame``; resources have a ``scheme://x/{name}`` template."""

    tools: dict[str, Callable] = field(default_factory=dict)
    resources: dict[str, Callable] = field(default_factory=dict)

    def tool(self, f: Callable) -> Callable:
        self.tools[f.__name__] = f
        return f

    def resource(self, template: str) -> Callable:
        return lambda f: self.resources.setdefault(template, f)

    def schema(self, name: str) -> dict:
        """JSON schema of a tool's arguments; nothing beyond them is allowed."""
        params = list(inspect.signature(self.tools[name], eval_str=True).parameters.values())[1:]
        return {
            "type": "object",
            "properties": {p.name: {"type": JSON_TYPES.get(p.annotation, "string")} for p in params},
            "required": [p.name for p in params if p.default is p.empty],
            "additionalProperties": False,
        }

    def call(self, spark: SparkSession, name: str, /, **args) -> DataFrame:
        if name not in self.tools:
            raise KeyError(f"no tool {name}")
        schema = self.schema(name)
        extra, lost = set(args) - set(schema["properties"]), set(schema["required"]) - set(args)
        if extra or lost:
            raise TypeError(f"{name}: unknown {sorted(extra)}, missing {sorted(lost)}")
        kinds = {v: k for k, v in JSON_TYPES.items()}
        for k, v in args.items():
            kind = kinds[schema["properties"][k]["type"]]
            if not isinstance(v, (int, float) if kind is float else kind) or (isinstance(v, bool) and kind is not bool):
                raise TypeError(f"{name}: {k} must be {kind.__name__}")
        return self.tools[name](spark, **args)

    def read(self, spark: SparkSession, uri: str) -> DataFrame:
        for template, f in self.resources.items():
            pattern = re.sub(r"\\\{(\w+)\\\}", r"(?P<\1>[^/]+)", re.escape(template))
            if m := re.fullmatch(pattern, uri):
                return f(spark, **m.groupdict())
        raise KeyError(f"no resource {uri}")
