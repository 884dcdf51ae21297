"""A graph of values that are computed once and dropped when what they depend on changes.

Values may be DataFrames (lazy themselves) or numbers. `None` counts as not computed.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from typing import Any


class Node:
    """A derived value. Arguments that are nodes are replaced by their values when it is called for."""

    def __init__(self, function: Callable, *args: Any, **kwargs: Any):
        self.function, self.args, self.kwargs = function, args, kwargs
        self.value: Any = None
        self.downstream: weakref.WeakSet[Node] = weakref.WeakSet()
        for n in self.upstream():
            n.downstream.add(self)

    def upstream(self) -> list[Node]:
        return [x for x in (*self.args, *self.kwargs.values()) if isinstance(x, Node)]

    def __bool__(self) -> bool:
        return self.value is not None

    def __call__(self) -> Any:
        stack = [self]
        while stack:
            node = stack[-1]
            if node:
                stack.pop()
            elif missing := [n for n in node.upstream() if not n]:
                stack += missing
            else:
                get = lambda x: x.value if isinstance(x, Node) else x
                node.value = node.function(*map(get, node.args), **{k: get(v) for k, v in node.kwargs.items()})
                stack.pop()
                if node.value is None:
                    return None
        return self.value

    def reset(self, value: Any = None) -> None:
        """Sets or drops the value and drops everything that follows from it; an equal value changes nothing."""
        if value is not None and self.value is value:
            return
        try:
            same = value is not None and self.value is not None and bool(self.value == value)
        except Exception:  # values such as DataFrames and arrays have no single truth
            same = False
        if same:
            return
        self.value = value
        stack = list(self.downstream)
        while stack:
            node = stack.pop()
            if node:
                if hasattr(node.value, "unpersist"):
                    node.value.unpersist()
                node.value = None
                stack += node.downstream


class Root(Node):
    """A value given from outside."""

    def __init__(self, value: Any = None):
        super().__init__(lambda: self.value)
        self.value = value

    def upstream(self) -> list[Node]:
        return []


class Copy:
    """Copies nodes one by one; a node whose upstreams weren't copied shares them, and values are kept."""

    def __init__(self) -> None:
        self.made: dict[int, tuple[Node, Node]] = {}

    def __call__(self, node: Node) -> Node:
        if id(node) in self.made:
            return self.made[id(node)][1]
        if isinstance(node, Root):
            out: Node = Root(node.value)
        else:
            get = lambda x: self.made[id(x)][1] if isinstance(x, Node) and id(x) in self.made else x
            out = Node(node.function, *map(get, node.args), **{k: get(v) for k, v in node.kwargs.items()})
            out.value = node.value
        self.made[id(node)] = (node, out)
        return out
