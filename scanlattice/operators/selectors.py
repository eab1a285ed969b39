"""CSS-like selectors and composite rules over node tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame

from . import trees

# Combinators and the relation of the right node to the left one.
COMBINATORS = {"": "inside", ">": "parent", "+": "next_to", "~": "follows"}
_PART = re.compile(r"\s*([>+~]?)\s*([a-zA-Z][\w-]*|\*)((?::[\w-]+\((?:[^()]|\([^()]*\))*\))*)")
_PSEUDO = re.compile(r":([\w-]+)\(((?:[^()]|\([^()]*\))*)\)")
NODE = ["doc", "pre"]


def any_of(*found: DataFrame) -> DataFrame:
    """Nodes of any operand, each once."""
    return reduce(DataFrame.unionByName, found).dropDuplicates(NODE)


def all_of(first: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(*NODE), NODE, "left_semi"), others, first)


def none_of(nodes: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(*NODE), NODE, "left_anti"), others, nodes)


def _position(text: str) -> tuple[int, int]:
    text = {"odd": "2n+1", "even": "2n"}.get(text.strip(), text.replace(" ", ""))
    found = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not text or not found:
        raise ValueError(f"not a position: {text!r}")
    step, offset = found.groups()
    return (0 if step is None else int(step + "1" if step in ("", "+", "-") else step)), int(offset or 0)


def _compound(nodes: DataFrame, name: str, pseudos: str) -> DataFrame:
    out = nodes.where("kind not like '#%'") if name == "*" else trees.kind(nodes, name)
    for pseudo, inner in _PSEUDO.findall(pseudos):
        if pseudo in ("nth-child", "nth-last-child"):
            out = all_of(out, trees.nth_child(nodes, *_position(inner), reverse=pseudo == "nth-last-child"))
        elif pseudo == "has":
            out = trees.related(out, "has", select(nodes, inner))
        elif pseudo in ("is", "not"):
            out = (all_of if pseudo == "is" else none_of)(out, select(nodes, inner))
        else:
            raise ValueError(f"unknown pseudo-class {pseudo}")
    return out


def _alternatives(text: str) -> list[str]:
    depth, out = 0, [""]
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """Nodes that a selector finds: `a b`, `a > b`, `a + b`, `a ~ b`, lists, :has :not :is
    :nth-child :nth-last-child. Raises ValueError for what it can't read."""
    found = []
    for text in _alternatives(selector):
        at, now = 0, None
        while text[at:].strip():
            part = _PART.match(text, at)
            if not part or (now is None and part[1]):
                raise ValueError(f"not a selector: {selector!r}")
            here = _compound(nodes, part[2], part[3])
            now = here if now is None else trees.related(here, COMBINATORS[part[1]], now)
            at = part.end()
        if now is None:
            raise ValueError(f"empty selector: {selector!r}")
        found.append(now)
    return found[0] if len(found) == 1 else any_of(*found)
