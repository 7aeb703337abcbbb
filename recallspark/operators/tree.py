"""The routing tree: grows by insertion, each episode going down to the best-scoring child.

Where an episode goes depends on all before it, so a conversation is inserted in
order. To keep that within one task's means it is cut into blocks of consecutive
episodes (``block``, 10,000): each block is a tree of its own, grown exactly as a
conversation of that size would be, and a conversation's blocks stand side by side
under its root (level above, ``root``). The tree serves overviews, never retrieval.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallspark.functions.text import STOP_CAPITALS, SUFFIXES

WORD, LONG_WORD, CAPITAL = re.compile(r"\w+"), re.compile(r"\b[a-zA-Z]{5,}\b"), re.compile(r"\b([A-Z][a-z]{2,})\b")
#: A leaf's most episodes, a region's most children and anchor terms, weights of anchors and first sentence.
LEAF, FAN_OUT, ANCHORS, BY_ANCHORS, BY_SENTENCE = 6, 4, 8, 0.4, 0.25


@lru_cache(100_000)
def stem(word: str) -> str:
    return next((word[: -len(s)] for s in SUFFIXES if word.endswith(s) and len(word) - len(s) >= 3), word)


def within_one(a: str, b: str) -> bool:
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def shorter(word: str) -> set[str]:
    """The word and what one deletion leaves: words within one edit share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


class Stems:
    """A text's stems, with those of six letters or fewer under all they share with a word within one edit."""

    def __init__(self, words) -> None:
        self.all = {stem(w) for w in words}
        self.near: dict[str, list[str]] = {}
        for s in self.all:
            if len(s) <= 6:
                for v in shorter(s):
                    self.near.setdefault(v, []).append(s)

    def share(self, wanted: list[str]) -> float:
        """Share of the wanted stems that are there, or within one edit of one if both are short."""
        if not wanted or not self.all:
            return 0.0
        like = lambda s: len(s) <= 6 and any(within_one(s, x) for v in shorter(s) for x in self.near.get(v, ()))
        return sum(s in self.all or like(s) for s in wanted) / len(wanted)


@dataclass
class Node:
    """A leaf (with episodes) or a region (with children), and what routing reads of it."""

    parent: Node | None = None
    children: list[Node] = field(default_factory=list)
    episodes: list[dict] | None = None
    text: str = ""
    anchors: list[str] = field(default_factory=list)
    entities: list[str] = field(default_factory=list)
    words: Stems | None = None
    anchored: Stems | None = None
    first_seq: int = -1
    last_seq: int = -1
    first_at: str | None = None
    last_at: str | None = None
    images: int = 0

    def refresh(self) -> None:
        """What follows from episodes or children."""
        if self.episodes is not None:
            parts, self.text = self.episodes, "\n".join(e["text"] for e in self.episodes)
            self.words = Stems(WORD.findall(self.text.lower()))
            seqs, stamps = [e["seq"] for e in parts], [e["stamp"] for e in parts if e["stamp"]]
            self.first_seq, self.last_seq = min(seqs), max(seqs)
            self.first_at, self.last_at = min(stamps, default=None), max(stamps, default=None)
            self.images = sum(e["image"] for e in parts)
            return
        whole = "\n".join(c.text for c in self.children if c.text)
        head = next((c.text for c in self.children if c.text), "").strip()
        self.anchors = [w for w, _ in Counter(w.lower() for w in LONG_WORD.findall(whole)).most_common(ANCHORS)]
        self.text = (re.split(r"(?<=[.!?])\s+", head)[0] or head)[:200]
        self.words, self.anchored = Stems(WORD.findall(self.text.lower())), Stems(self.anchors)
        self.entities = [w for w in dict.fromkeys(CAPITAL.findall(whole)) if w not in STOP_CAPITALS][:5]
        held = [c for c in self.children if c.first_seq >= 0]
        self.first_seq, self.last_seq = (min(c.first_seq for c in held), max(c.last_seq for c in held)) if held else (-1, -1)
        self.first_at = min((c.first_at for c in held if c.first_at), default=None)
        self.last_at = max((c.last_at for c in held if c.last_at), default=None)
        self.images = sum(c.images for c in self.children)

    def score(self, wanted: list[str]) -> float:
        if self.episodes is not None:
            return self.words.share(wanted)
        return BY_ANCHORS * self.anchored.share(wanted) + BY_SENTENCE * self.words.share(wanted)


class Tree:
    """A root region that episodes are inserted under."""

    def __init__(self) -> None:
        self.root = Node()

    def insert(self, episode: dict) -> None:
        words, at = [stem(w) for w in set(WORD.findall(episode["text"].lower()))], self.root
        while at.episodes is None and at.children:
            at = max(at.children, key=lambda c: c.score(words))  # the first of equals
        if at.episodes is None:
            at.children.append(Node(at, episodes=[]))
            at = at.children[0]
        at.episodes.append(episode)
        at.refresh()
        self.ancestors(at)
        if len(at.episodes) > LEAF:
            self.halve(at)

    def ancestors(self, node: Node) -> None:
        while node := node.parent:
            node.refresh()

    def halve(self, node: Node) -> None:
        """A full node gives its later half to a new sibling; the parent may be full then."""
        if node.parent is None:
            self.root = Node(children=[node])
            node.parent = self.root
        parent, sibling = node.parent, Node(node.parent)
        if node.episodes is not None:
            node.episodes.sort(key=lambda e: e["seq"])
            middle = len(node.episodes) // 2
            node.episodes, sibling.episodes = node.episodes[:middle], node.episodes[middle:]
        else:
            middle = len(node.children) // 2
            node.children, sibling.children = node.children[:middle], node.children[middle:]
            for c in sibling.children:
                c.parent = sibling
        parent.children.append(sibling)
        for n in (node, sibling, parent):
            n.refresh()
        if len(parent.children) > FAN_OUT:
            self.halve(parent)
        else:
            self.ancestors(parent)


COLUMNS = (
    "conv_id string, block bigint, node string, parent string, level int, kind string, anchors array<string>, entities array<string>, summary string, "
    "first_seq bigint, last_seq bigint, first_at string, last_at string, images bigint, episode_ids array<string>"
)


def routing_tree(docs: DataFrame, block: int = 10_000) -> DataFrame:
    """Nodes of every conversation's trees, named by the way down from the root (0, 0.1, 0.1.3).

    ``docs``: conv_id, episode_id, seq, text, and where there are: stamp, image.
    """
    have = set(docs.columns)
    rows = docs.select(
        "conv_id", "episode_id", "seq", F.coalesce("text", F.lit("")).alias("text"), (F.col("stamp") if "stamp" in have else F.lit(None).cast("string")).alias("stamp"),
        (F.col("image") if "image" in have else F.lit(False)).alias("image"), F.floor(F.col("seq") / block).alias("block"),
    )

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        tree, conv, number, out = Tree(), frame["conv_id"].iloc[0], frame["block"].iloc[0], []
        for r in frame.sort_values("seq").itertuples(index=False):
            tree.insert({"id": r.episode_id, "seq": int(r.seq), "text": r.text, "stamp": r.stamp, "image": bool(r.image)})

        def walk(node: Node, name: str, parent: str | None, level: int) -> None:
            leaf = node.episodes is not None
            out.append((
                conv, number, name, parent, level, "leaf" if leaf else "region", node.anchors, node.entities, node.text[:200], node.first_seq, node.last_seq, node.first_at, node.last_at,
                node.images, [e["id"] for e in node.episodes] if leaf else None,
            ))
            for i, child in enumerate(node.children):
                walk(child, f"{name}.{i}", name, level + 1)

        walk(tree.root, "0", None, 0)
        return pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])

    return rows.groupBy("conv_id", "block").applyInPandas(grow, COLUMNS)


def descend(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """episode_id, node: the leaf that holds each episode."""
    return nodes.where(F.col("kind") == "leaf").select("conv_id", "block", "node", F.explode("episode_ids").alias("episode_id")).join(docs.select("episode_id"), "episode_id", "left_semi")


def depth(nodes: DataFrame) -> DataFrame:
    """conv_id, block, depth: levels of a tree, from the longest of its nodes' names."""
    return nodes.groupBy("conv_id", "block").agg((F.max("level") + 1).alias("depth"))


def printed(nodes: DataFrame) -> DataFrame:
    """conv_id, block, line_no, line: the tree as indented lines, in the order of a walk."""
    order = F.transform(F.split("node", r"\."), lambda x: x.cast("int"))
    what = F.when(F.col("kind") == "leaf", F.concat(F.lit("leaf, "), F.size("episode_ids").cast("string"), F.lit(" episodes"))).otherwise(F.concat(F.lit("region: "), F.array_join("anchors", ", ")))
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), what, F.format_string(" [%d-%d]", "first_seq", "last_seq"))
    from pyspark.sql import Window

    return nodes.select("conv_id", "block", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(order)).alias("line_no"), line.alias("line"))


def layer_stats(nodes: DataFrame, docs: DataFrame, entities: DataFrame, notes: DataFrame) -> DataFrame:
    """One row: nodes, leaves, episodes, entities, depth and notes of the whole layer."""
    n = nodes.agg(F.count("*").alias("nodes"), F.sum((F.col("kind") == "leaf").cast("bigint")).alias("leaves"), F.max(F.col("level") + 1).alias("depth"))
    parts = [docs.agg(F.count("*").alias("episodes")), entities.agg(F.count("*").alias("entities")), notes.agg(F.count("*").alias("notes"))]
    for part in parts:
        n = n.join(F.broadcast(part))  # one row each
    return n
