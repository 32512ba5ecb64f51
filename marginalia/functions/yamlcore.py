"""Frontmatter YAML by the core schema: dates and yes/no are strings, repeated keys are errors."""

from __future__ import annotations

import json
import math
import re
from functools import lru_cache

import yaml


class Loader(yaml.SafeLoader):
    pass


class Quick(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """The same schema by libyaml, if it is there; nothing depends on the path to a node."""

    def descend_resolver(self, *_) -> None:
        pass

    def ascend_resolver(self) -> None:
        pass

    def resolve(self, kind: type, value: str | None, implicit: object) -> str:
        return _tag(value) if kind is yaml.ScalarNode and implicit[0] else _STR if kind is yaml.ScalarNode else ""


class Dumper(yaml.SafeDumper):
    def increase_indent(self, flow: bool = False, indentless: bool = False):
        return super().increase_indent(flow, indentless)


#: Plain and quoted scalars without escapes, of mappings and lists in block style: what both parsers read alike.
PLAIN = re.compile(r"""(?:[\w .:/+()\n-]|"[^"\\\x00-\x1f\x7f-\x9f\u2028\u2029\ufeff]*"|'[^'\x00-\x1f\x7f-\x9f\u2028\u2029\ufeff]*')*+\Z""")

Loader.yaml_implicit_resolvers = {}
_RULES = (
    ("null", r"~|null|Null|NULL|", "~nN\0"),
    ("bool", r"true|True|TRUE|false|False|FALSE", "tTfF"),
    ("int", r"[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+", "-+0123456789"),
    ("float", r"[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?(\.inf|\.Inf|\.INF)|\.nan|\.NaN|\.NAN", "-+.0123456789"),
)
for _tag, _rule, _first in _RULES:
    Loader.add_implicit_resolver(f"tag:yaml.org,2002:{_tag}", re.compile(f"^(?:{_rule})$"), list(_first) if _tag != "null" else ["~", "n", "N", ""])
Quick.yaml_implicit_resolvers = Dumper.yaml_implicit_resolvers = Loader.yaml_implicit_resolvers


def _mapping(loader: Loader, node: yaml.MappingNode) -> dict:
    out: dict = {}
    for key_node, value_node in node.value:
        key = loader.construct_object(key_node, deep=True)
        if isinstance(key, (dict, list)):
            key = json.dumps(key)
        if key in out:
            raise yaml.constructor.ConstructorError(None, None, f"duplicate entry with key {key!r}", key_node.start_mark)
        out[key] = loader.construct_object(value_node, deep=True)
    return out


def _int(loader: Loader, node: yaml.ScalarNode) -> int:
    text = loader.construct_scalar(node)
    return int(text, 0) if text[:2] in ("0o", "0x") else int(text)


def _float(loader: Loader, node: yaml.ScalarNode) -> float:
    text = loader.construct_scalar(node).lower().replace(".inf", "inf").replace(".nan", "nan")
    return float(text)


Loader.add_constructor("tag:yaml.org,2002:map", _mapping)
Loader.add_constructor("tag:yaml.org,2002:int", _int)
Loader.add_constructor("tag:yaml.org,2002:float", _float)


_STR = "str"


@lru_cache(maxsize=4096)
def _tag(text: str) -> str:
    """The kind of a plain scalar."""
    for tag, rule in Loader.yaml_implicit_resolvers.get(text[:1], ()):
        if rule.match(text):
            return tag.rpartition(":")[2]
    return _STR


def _built(node: yaml.Node) -> object:
    """What Loader constructs of a node without tags and anchors; raises ValueError for a repeated key."""
    kind = type(node)
    if kind is yaml.ScalarNode:
        tag, text = node.tag, node.value
        if tag == _STR:
            return text
        if tag == "int":
            return int(text, 0) if text[:2] in ("0o", "0x") else int(text)
        if tag == "float":
            return float(text.lower().replace(".inf", "inf").replace(".nan", "nan"))
        return None if tag == "null" else text.lower() == "true"
    if kind is yaml.SequenceNode:
        return [_built(item) for item in node.value]
    out: dict = {}
    for key_node, value_node in node.value:
        key = _built(key_node)
        if isinstance(key, (dict, list)):
            key = json.dumps(key)
        if key in out:
            raise ValueError("duplicate entry")
        out[key] = _built(value_node)
    return out


def load(text: str) -> object:
    """The value of a YAML text; raises ValueError with the parser's message, which is PyYAML's own for any text."""
    if PLAIN.match(text):
        try:
            node = yaml.compose(text, Loader=Quick)
            return None if node is None else _built(node)
        except (yaml.YAMLError, ValueError, RecursionError):
            pass
    try:
        return yaml.load(text, Loader=Loader)  # noqa: S506 - a subclass of SafeLoader
    except (yaml.YAMLError, ValueError, RecursionError) as error:
        raise ValueError(" ".join(str(error).split())) from None


def dump(value: object) -> str:
    return yaml.dump(value, Dumper=Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=10**9)


def number(value: float) -> str:
    """A number as search compares it: no exponent, no trailing zero."""
    if isinstance(value, int):
        return str(value)
    if math.isnan(value):
        return "NaN"
    if math.isinf(value):
        return "inf" if value > 0 else "-inf"
    return str(int(value)) if value == int(value) and abs(value) < 1e16 else format(value, "f").rstrip("0") if "e" in repr(value) else repr(value)


def as_text(value: object) -> str:
    """A frontmatter value as search compares it: scalars plainly, others as YAML."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return number(value)
    return value if isinstance(value, str) else dump(value).strip()


def strings(value: object, key: str = "", out: list | None = None) -> list[tuple[str, int | None, str]]:
    """Every string of a mapping with its key path and, within a list, its place: (key, index, text)."""
    out = [] if out is None else out
    if isinstance(value, str):
        out.append((key, None, value))
    elif isinstance(value, list):
        for i, item in enumerate(value):
            if isinstance(item, str):
                out.append((key, i, item))
            else:
                strings(item, f"{key}[{i}]", out)
    elif isinstance(value, dict):
        for k, v in value.items():
            if isinstance(k, str):
                strings(v, f"{key}.{k}" if key else k, out)
    return out


def as_json(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)
