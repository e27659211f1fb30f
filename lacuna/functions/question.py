"""The why-not question: a tree pattern over a schema, its conditions, and its embeddings in a schema."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from itertools import product

from pyspark.sql.types import ArrayType, StructType

# Fixed values of the question language: eight-character prefixes of conditions, and the numbers of their operators.
PREFIXES = {"contains": 2, "ltltltlt": 3, "gtgtgtgt": 4, "nconncon": 5, "lengthgt": 6, "lengthlt": 7}
EXISTS, EQUALS, CONTAINS, LESS, GREATER, LACKS, LONGER, SHORTER = range(8)


@dataclass(frozen=True)
class Condition:
    op: int = EXISTS
    value: str = ""


def parse_condition(text: str) -> Condition:
    """A condition from its text: empty asks for existence, a known prefix for its operator, all else for equality."""
    if not text:
        return Condition()
    if text[:8] in PREFIXES and len(text) > 8:
        op = PREFIXES[text[:8]]
        if op in (LONGER, SHORTER):
            int(text[8:])
        return Condition(op, text[8:])
    return Condition(EQUALS, text)


@dataclass(frozen=True)
class Node:
    """A node of a question in terms of a schema."""

    name: str
    min: int = 1
    max: int = -1
    conditions: tuple[Condition, ...] = ()
    children: tuple[Node, ...] = ()

    def renamed(self, name: str) -> Node:
        return replace(self, name=name)

    def merged(self, other: Node) -> Node:
        """Both questions about the same attribute."""
        children = {c.name: c for c in self.children}
        for c in other.children:
            children[c.name] = children[c.name].merged(c) if c.name in children else c
        conditions = tuple(dict.fromkeys((*self.conditions, *other.conditions)))
        bounded = self if (self.min, self.max) != (1, -1) else other
        return Node(self.name, bounded.min, bounded.max, conditions, tuple(children.values()))


@dataclass(eq=False)
class TwigNode:
    name: str
    min: int = 1
    max: int = -1
    condition: str = ""
    edges: list[tuple[TwigNode, bool]] = field(default_factory=list)


class Twig:
    """A tree pattern; an edge goes to a child or, with `descendant`, to any depth."""

    def __init__(self):
        self.nodes: list[TwigNode] = []
        self.parents: dict[int, TwigNode] = {}
        self._root: TwigNode | None = None

    def node(self, name: str, min: int = 1, max: int = -1, condition: str = "") -> TwigNode:  # noqa: A002
        parse_condition(condition)
        self._root = None
        self.nodes.append(TwigNode(name, min, max, condition))
        return self.nodes[-1]

    def edge(self, parent: TwigNode, child: TwigNode, descendant: bool = False) -> Twig:
        if id(child) in self.parents:
            raise ValueError(f"{child.name} has a parent already")
        self._root = None
        self.parents[id(child)] = parent
        parent.edges.append((child, descendant))
        return self

    def validate(self) -> Twig:
        roots = [n for n in self.nodes if id(n) not in self.parents]
        if len(roots) != 1:
            raise ValueError(f"a twig has one root, not {len(roots)}")
        seen: set[int] = set()
        todo = [roots[0]]
        while todo:
            n = todo.pop()
            seen.add(id(n))
            if n.min != -1 and n.max != -1 and n.min > n.max:
                raise ValueError(f"{n.name}: min {n.min} is above max {n.max}")
            todo += [c for c, _ in n.edges]
        if len(seen) != len(self.nodes):
            raise ValueError("some nodes can't be reached from the root")
        self._root = roots[0]
        return self

    @property
    def root(self) -> TwigNode:
        if self._root is None:
            raise ValueError("validate the twig first")
        return self._root

    def to_json(self) -> str:
        def of(n: TwigNode) -> dict:
            return {"name": n.name, "min": n.min, "max": n.max, "condition": n.condition, "children": [of(c) | {"descendant": d} for c, d in n.edges]}

        return json.dumps(of(self.root))


def twig(tree: dict | list) -> Twig:
    """A twig from nested data: {"city": "NY", "tags[1,5]": {"element": "containsx"}, "//deep": None} below a root.

    A name may end in [min,max] and start with // for any depth; a value is a condition, nested data, or None.
    """
    import re

    t = Twig()
    root = t.node("root")

    def add(parent: TwigNode, items: dict) -> None:
        for key, value in items.items():
            m = re.fullmatch(r"(//)?(.*?)(?:\[(-?\d+),(-?\d+)\])?", key)
            own = value if isinstance(value, str) else ""
            n = t.node(m[2], int(m[3] or 1), int(m[4] or -1), own)
            t.edge(parent, n, bool(m[1]))
            if isinstance(value, dict):
                add(n, value)

    add(root, dict(tree))
    return t.validate()


class SchemaTree:
    """Labels of a schema: the root is (0,), its fields (0, i); arrays have one child, `element`."""

    def __init__(self, schema: StructType, root: str = "root"):
        self.names: dict[tuple[int, ...], str] = {}
        self.children: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        self._walk((0,), root, schema)

    def _walk(self, label: tuple[int, ...], name: str, kind) -> None:
        self.names[label] = name
        fields = [(f.name, f.dataType) for f in kind.fields] if isinstance(kind, StructType) else [("element", kind.elementType)] if isinstance(kind, ArrayType) else []
        self.children[label] = [(*label, i) for i in range(len(fields))]
        for child, (n, k) in zip(self.children[label], fields, strict=True):
            self._walk(child, n, k)

    def named(self, name: str) -> list[tuple[int, ...]]:
        return [label for label, n in self.names.items() if n == name]

    def below(self, label: tuple[int, ...], name: str, any_depth: bool) -> list[tuple[int, ...]]:
        if not any_depth:
            return [c for c in self.children[label] if self.names[c] == name]
        return [x for x in self.named(name) if len(x) > len(label) and x[: len(label)] == label]


def match_all(t: Twig, schema: StructType) -> list[dict[int, tuple[int, ...]]]:
    """Every embedding, as labels by the identity of twig nodes; two leaves never share a label."""
    tree = SchemaTree(schema)

    def embed(n: TwigNode, label: tuple[int, ...]) -> list[dict[int, tuple[int, ...]]]:
        options = [[e for place in tree.below(label, c.name, deep) for e in embed(c, place)] for c, deep in n.edges]
        out = []
        for parts in product(*options):
            found = {id(n): label}
            for p in parts:
                found |= p
            out.append(found)
        return out

    leaves = [id(n) for n in t.nodes if not n.edges]
    found = [e for label in tree.named(t.root.name) for e in embed(t.root, label)]
    return [e for e in found if len({e[x] for x in leaves}) == len(leaves)]


def match_unique(t: Twig, schema: StructType) -> Node:
    """The question as a tree over the schema; there must be exactly one embedding, at the schema's root."""
    found = [e for e in match_all(t, schema) if e[id(t.root)] == (0,)]
    if len(found) != 1:
        raise ValueError(f"the question fits the schema in {len(found)} ways, not in one")
    tree, at = SchemaTree(schema), found[0]

    def build(n: TwigNode) -> Node:
        children: dict[str, Node] = {}
        for c, _ in n.edges:
            node = build(c)
            for k in range(len(at[id(c)]) - 1, len(at[id(n)]), -1):
                node = Node(tree.names[at[id(c)][:k]], children=(node,))
            children[node.name] = children[node.name].merged(node) if node.name in children else node
        condition = parse_condition(n.condition)
        return Node(n.name, n.min, n.max, (condition,) if condition.op else (), tuple(children.values()))

    return build(t.root)


def serialize(node: Node) -> list[tuple]:
    """Rows (id, parent, operator, min, max, name, value) in pre-order; the root is its own parent."""
    rows: list[tuple] = []

    def walk(n: Node, parent: int) -> None:
        own = len(rows)
        c = n.conditions[0] if n.conditions else Condition()
        rows.append((own, parent, c.op, n.min, n.max, n.name, c.value))
        for x in n.children:
            walk(x, own)

    walk(node, 0)
    return rows
