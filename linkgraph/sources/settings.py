"""YAML read node by node, so that every fault can name its line.

Merge keys are followed, own keys before merged ones; a key given twice, a wrong kind of value and a mapping that merges
itself are errors.
"""

from __future__ import annotations

import yaml
from yaml import MappingNode, Node, ScalarNode, SequenceNode

MERGE, NULL = "tag:yaml.org,2002:merge", "tag:yaml.org,2002:null"


class ConfigError(ValueError):
    """A configuration that cannot be used."""


class Settings:
    """The nodes of one file."""

    def __init__(self, path: str, text: str):
        self.path = path
        try:
            self.root: Node | None = yaml.compose(text, Loader=yaml.SafeLoader)
        except yaml.YAMLError as e:
            mark = getattr(e, "problem_mark", None)
            raise ConfigError(f"{path}{f':{mark.line + 1}' if mark else ''}: {getattr(e, 'problem', None) or e}") from e

    def fault(self, node: Node, what: str) -> ConfigError:
        return ConfigError(f"{self.path}:{node.start_mark.line + 1}: {what}")

    def members(self, node: Node | None, what: str, trail: tuple[int, ...] = ()) -> dict[str, tuple[Node, Node]]:
        """Key and value nodes by name; nothing for a value that is left out."""
        if self.blank(node):
            return {}
        if not isinstance(node, MappingNode):
            raise self.fault(node, f"{what} must be a mapping")
        if id(node) in trail:
            raise self.fault(node, f"{what} merges itself")
        own: dict[str, tuple[Node, Node]] = {}
        merged: list[Node] = []
        for key, value in node.value:
            if key.tag == MERGE:
                merged += value.value if isinstance(value, SequenceNode) else [value]
            elif not isinstance(key, ScalarNode):
                raise self.fault(key, f"a key of {what} must be plain")
            elif key.value in own:
                raise self.fault(key, f"{what} has {key.value} twice")
            else:
                own[key.value] = (key, value)
        for other in merged:
            for name, pair in self.members(other, what, (*trail, id(node))).items():
                own.setdefault(name, pair)
        return own

    def items(self, node: Node | None, what: str) -> list[Node]:
        if self.blank(node):
            return []
        if not isinstance(node, SequenceNode):
            raise self.fault(node, f"{what} must be a list")
        return list(node.value)

    def value(self, node: Node | None, what: str, kind: type):
        """A string, a whole number or a truth value; None for one that is left out. Any plain value is a string."""
        if self.blank(node):
            return None
        if not isinstance(node, ScalarNode):
            raise self.fault(node, f"{what} must be a single value")
        if kind is str:
            return node.value
        found = yaml.constructor.SafeConstructor().construct_object(node)
        if type(found) is not kind:
            raise self.fault(node, f"{what} must be {'true or false' if kind is bool else 'a whole number'}")
        return found

    def strings(self, node: Node | None, what: str) -> list[str]:
        return [self.value(x, f"an item of {what}", str) or "" for x in self.items(node, what)]

    @staticmethod
    def blank(node: Node | None) -> bool:
        return node is None or isinstance(node, ScalarNode) and node.tag == NULL
