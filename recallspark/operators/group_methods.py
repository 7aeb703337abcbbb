"""The grouping methods by name, what they share, and reports on their groups.

A method takes rows (conv_id is not looked at: group one collection at a time) and
returns memberships: key, group_id; soft methods give a row several groups.

Trees and density are quadratic in the points they look at, so rows are first drawn
into at most ``MICRO`` centres, however many there are: every row belongs to its
nearest centre, centres carry their rows' number as weight, and groups of centres
are groups of rows. With no more rows than that every row is its own centre.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.functions.jsonx import items_of, salvaged_json
from recallspark.functions.text import strip_attribution
from recallspark.functions.vectors import unit
from recallspark.models import Encoder, call_column
from recallspark.operators import grouping as G
from recallspark.operators.segmentation import fixed_windows, tile_segments
from recallspark.plans.reader import fill
from recallspark.session import stash

MICRO = 2000


def hard_groups(labels: DataFrame, key: str) -> DataFrame:
    """Memberships from labels; -1 is noise and joins nothing."""
    return labels.where(F.col("label") >= 0).select(key, F.col("label").cast("int").alias("group_id"))


def micro_centres(rows: DataFrame, key: str, most: int = MICRO, rounds: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Centres of column ``x``, their weights, and each row's centre (key, centre).

    Lloyd's rounds are distributed passes; sums per centre come to the driver, ``most`` of them.
    """
    spark, n = rows.sparkSession, rows.count()
    if n <= most:
        held = rows.select(key, "x").orderBy(key).toPandas()
        index = spark.createDataFrame([(k, i) for i, k in enumerate(held[key].tolist())], f"{key} {dict(rows.dtypes)[key]}, centre int")
        return np.array(held["x"].tolist(), float).reshape(len(held), -1), np.ones(len(held)), index
    start = rows.select("x").where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, 1.2 * most / n)) + 1).limit(most)
    centres = np.array([r.x for r in start.collect()], float)

    def place(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        c = shared.value
        for frame in frames:
            x = np.array(frame["x"].tolist(), float)
            yield frame[[key]].assign(centre=np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1).astype(np.int32))

    def sums(frames: Iterator[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
        c = shared.value
        s, w = np.zeros_like(c), np.zeros(len(c))
        for frame in frames:
            x = np.array(frame["x"].tolist(), float)
            near = np.argmax(x @ c.T - 0.5 * (c * c).sum(1), axis=1)
            np.add.at(s, near, x)
            w += np.bincount(near, minlength=len(c))
        full = np.flatnonzero(w)
        yield pd.DataFrame({"centre": full.astype(np.int32), "w": w[full], "s": s[full].tolist()})

    d = centres.shape[1]
    weights = np.ones(len(centres))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)
        parts = rows.select("x").mapInPandas(lambda f, shared=shared: sums(f, shared), "centre int, w double, s array<double>")
        found = parts.groupBy("centre").agg(F.sum("w").alias("w"), F.array(*[F.sum(F.col("s")[i]) for i in range(d)]).alias("s")).orderBy("centre").toPandas()
        weights = found["w"].to_numpy()
        centres = np.array(found["s"].tolist()) / weights[:, None]
    shared = spark.sparkContext.broadcast(centres)
    placed = stash(rows.select(key, "x").mapInPandas(lambda f: place(f, shared), f"{key} {dict(rows.dtypes)[key]}, centre int"), "centres")
    counts = {r.centre: r["count"] for r in placed.groupBy("centre").count().collect()}
    return centres, np.array([counts.get(i, 0) for i in range(len(centres))], float), placed


def by_centre(placed: DataFrame, labels: np.ndarray, key: str) -> DataFrame:
    """Labels of centres as labels of rows."""
    table = placed.sparkSession.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "centre int, label int")
    return placed.join(F.broadcast(table), "centre").select(key, "label")  # at most MICRO rows


def ward_labels(x: np.ndarray, weight: np.ndarray, top: int = 40) -> np.ndarray:
    """Ward's merges by nearest-neighbour chains, cut at the widest gap between the heights of the last ``top``."""
    n = len(x)
    if n < 4:
        return np.zeros(n, int)
    centre, mass, alive = x.copy(), np.maximum(weight, 1e-9).astype(float), np.ones(n, bool)
    merges, chain = [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        d = ((centre - centre[a]) ** 2).sum(1) * (mass * mass[a] / (mass + mass[a]))
        d[~alive], d[a] = np.inf, np.inf
        b = int(np.argmin(d))
        if len(chain) > 1 and d[chain[-2]] <= d[b]:
            b = chain[-2]
            del chain[-2:]
            merges.append((float(np.sqrt(2 * d[b])), a, b))
            centre[a] = (mass[a] * centre[a] + mass[b] * centre[b]) / (mass[a] + mass[b])
            mass[a] += mass[b]
            alive[b] = False
        else:
            chain.append(b)
    heights = np.sort([h for h, _, _ in merges])[-min(top, len(merges)) :]
    if len(heights) < 2:
        return np.zeros(n, int)
    at = int(np.argmax(np.diff(heights)))
    limit = (heights[at] + heights[at + 1]) / 2
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for h, a, b in merges:
        if h <= limit:
            root[find(b)] = find(a)
    return np.unique([find(i) for i in range(n)], return_inverse=True)[1]


def density_labels(x: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """Density clusters: the tree over mutual reachability, condensed at mass ``least``, the most stable branches kept; -1 is noise."""
    n = len(x)
    if n < 3 or weight.sum() < 2 * least:
        return np.full(n, -1)
    d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T, 0))
    order = np.argsort(d, axis=1)
    mass = np.cumsum(weight[order], axis=1)
    core = d[np.arange(n), order[np.arange(n), np.argmax(mass >= least, axis=1)]]
    reach = np.maximum(np.maximum(d, core[:, None]), core)
    inside, near, link, edges = np.zeros(n, bool), np.full(n, np.inf), np.zeros(n, int), []
    at = 0
    for _ in range(n - 1):  # Prim's tree
        inside[at] = True
        closer = ~inside & (reach[at] < near)
        near[closer], link[closer] = reach[at][closer], at
        at = int(np.argmin(np.where(inside, np.inf, near)))
        edges.append((float(near[at]), int(link[at]), at))
    edges.sort()
    parent: dict[int, int] = {}
    children: dict[int, tuple[int, int, float]] = {}
    total = dict(enumerate(weight.astype(float)))

    def find(i: int) -> int:
        while parent.get(i, i) != i:
            i = parent[i]
        return i

    fresh = n
    for h, a, b in edges:
        a, b = find(a), find(b)
        parent[a] = parent[b] = fresh
        children[fresh], total[fresh] = (a, b, h), total[a] + total[b]
        fresh += 1
    # condense: walk down; a branch lives while it keeps its mass, and splits where both sides have enough
    stability: dict[int, float] = {}
    born, kids, points = {fresh - 1: 0.0}, {}, {}
    todo = [(fresh - 1, fresh - 1)]
    while todo:
        node, cluster = todo.pop()
        stability.setdefault(cluster, 0.0)
        points.setdefault(cluster, [])
        if node not in children:
            points[cluster].append(node)
            continue
        a, b, h = children[node]
        level = 1 / max(h, 1e-12)
        if total[a] >= least and total[b] >= least:
            stability[cluster] += (level - born[cluster]) * total[node]
            kids[cluster] = [a, b]
            for c in (a, b):
                born[c] = level
                todo.append((c, c))
            continue
        for c in (a, b):
            if total[c] >= least:
                todo.append((c, cluster))
            else:
                stability[cluster] += (level - born[cluster]) * total[c]
                stack = [c]
                while stack:
                    i = stack.pop()
                    if i in children:
                        stack += children[i][:2]
                    else:
                        points[cluster].append(i)
    best, chosen = {}, set()
    for c in sorted(stability):  # children have smaller numbers
        below = sum(best[k] for k in kids.get(c, []))
        best[c] = max(stability[c], below)
        if c != fresh - 1 and stability[c] >= below:
            chosen.add(c)
    label, out, number = {}, np.full(n, -1), 0
    todo = [(fresh - 1, -1)]
    while todo:
        c, inherited = todo.pop()
        if inherited < 0 and c in chosen:
            inherited, number = number, number + 1
        label[c] = inherited
        out[points.get(c, [])] = inherited
        todo += [(k, inherited) for k in kids.get(c, [])]
    return out


def ward_groups(rows: DataFrame, key: str) -> DataFrame:
    centres, weight, placed = micro_centres(rows, key)
    return hard_groups(by_centre(placed, ward_labels(centres, weight), key), key)


def density_groups(rows: DataFrame, key: str) -> DataFrame:
    """Least cluster size max(5, n // 50)."""
    centres, weight, placed = micro_centres(rows, key)
    return hard_groups(by_centre(placed, density_labels(centres, weight, max(5, int(weight.sum()) // 50)), key), key)


def modularity_communities(edges: DataFrame, levels: int = 4, rounds: int = 6) -> DataFrame:
    """id, group_id: communities by moving nodes to where modularity gains most, then moving communities.

    ``edges``: src, dst, weight, each pair once. A round moves half of the nodes (by
    hash and round), so that neighbours do not swap places; every round is joins and
    aggregates over the edges. ``group_id`` is the smallest id of the community.
    """
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    graph = stash(both, "graph")
    members = graph.select(F.col("src").alias("id")).distinct().withColumn("node", F.col("id"))
    total = graph.agg(F.sum("weight")).first()[0]
    if not total:
        return members.select("id", F.col("node").alias("group_id"))
    for level in range(levels):
        degree = stash(graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k")), "degree")
        labels = degree.select("node", F.col("node").alias("label"))
        for r in range(rounds):
            mass = degree.join(labels, "node").groupBy("label").agg(F.sum("k").alias("mass"))
            near = graph.where("src != dst").join(labels, graph.dst == labels.node).groupBy(F.col("src").alias("node"), "label").agg(F.sum("weight").alias("w"))
            own = labels.withColumnRenamed("label", "mine").join(degree, "node")
            rows = near.join(own, "node").join(mass, "label")
            held = F.when(F.col("label") == F.col("mine"), F.col("mass") - F.col("k")).otherwise(F.col("mass"))
            gain = F.round(F.col("w") - F.col("k") * held / total, 9)
            stay = own.join(mass, own.mine == mass.label).select("node", F.col("mine").alias("label"), F.round(-F.col("k") * (F.col("mass") - F.col("k")) / total, 9).alias("gain"))
            every = rows.select("node", "label", gain.alias("gain")).unionByName(stay)
            best = every.groupBy("node").agg(F.max_by("label", F.struct("gain", -F.col("label"))).alias("best"))
            moves = F.pmod(F.xxhash64("node", F.lit(level * 100 + r // 2)), F.lit(2)) == r % 2
            changed = labels.join(best, "node").select("node", F.when(moves, F.col("best")).otherwise(F.col("label")).alias("label"))
            labels = stash(changed, "labels")
        names = labels.groupBy("label").agg(F.min("node").alias("name"))
        labels = stash(labels.join(names, "label").select("node", F.col("name").alias("label")), "labels")
        members = stash(members.join(labels, "node").select("id", F.col("label").alias("node")), "members")
        one, two = labels.select(F.col("node").alias("src"), F.col("label").alias("s")), labels.select(F.col("node").alias("dst"), F.col("label").alias("d"))
        before = degree.count()
        graph = stash(graph.join(one, "src").join(two, "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight")), "graph")
        if labels.select("label").distinct().count() == before:
            break
    return members.select("id", F.col("node").alias("group_id"))


def modularity(edges: DataFrame, groups: DataFrame) -> float:
    """How much more weight lies inside the groups than by chance."""
    a, b = groups.select(F.col("id").alias("src"), F.col("group_id").alias("a")), groups.select(F.col("id").alias("dst"), F.col("group_id").alias("b"))
    rows = edges.join(a, "src").join(b, "dst")
    total = rows.agg(F.sum("weight")).first()[0] or 0.0
    inside = rows.where("a = b").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    ends = rows.select(F.col("a").alias("g"), "weight").unionByName(rows.select(F.col("b").alias("g"), "weight")).groupBy("g").agg(F.sum("weight").alias("k"))
    chance = ends.agg(F.sum(F.col("k") * F.col("k"))).first()[0]
    return inside / total - chance / (4 * total * total) if total else 0.0


# Groups that a model names -------------------------------------------------------

TOPICS = "Read these excerpts and name the topics they are about, each in a few words, no two alike.\n\n{excerpts}\n\nReply with JSON alone: {\"topics\": [\"...\"]}"
OUTLINE = (
    "These numbered excerpts follow each other. Where does the subject change? Give one entry for each stretch about one subject, far fewer than excerpts.\n\n{excerpts}\n\n"
    'Reply with JSON alone, in order: {"spans": [[1, "subject"], [9, "subject"]]}'
)


def _plain(text, chars: int):
    return F.substring(F.array_join(F.filter(F.split(strip_attribution(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""), " "), 1, chars)


def propose_topics(docs: DataFrame, model, sample: int = 40, seed: int = 0, by: str = "conv_id") -> DataFrame:
    """conv_id, label: topics that a model names from ``sample`` excerpts of each collection (docs: conv_id, episode_id, seq, text)."""
    w = Window.partitionBy(by).orderBy(F.xxhash64("episode_id", F.lit(seed)), "episode_id")
    rows = docs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= sample)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", _plain(F.col("text"), 200).alias("t")))), lambda x: F.concat(F.lit("- "), x["t"]))
    prompts = rows.groupBy(by).agg(F.array_join(lines, "\n").alias("excerpts")).select(by, fill(TOPICS, excerpts=F.col("excerpts")).alias("prompt"))
    said = call_column(prompts, "prompt", model, max_tokens=512, temperature=0.0)
    topics = F.from_json(salvaged_json("call.text"), "topics array<string>")["topics"]
    return said.select(by, F.explode(topics).alias("label")).select(by, F.trim("label").alias("label")).where(F.length("label").between(1, 120)).distinct()


def distinct_topics(labels: list[str], encoder: Encoder, most: float = 0.85) -> list[str]:
    """Labels that are not near-copies of one kept before."""
    kept, vectors = [], []
    for label, v in zip(labels, encoder.encode(labels)):
        length = np.linalg.norm(v)
        if np.isfinite(v).all() and length and all(float(v / length @ k) <= most for k in vectors):
            kept.append(label)
            vectors.append(v / length)
    return kept


def topic_groups(rows: DataFrame, key: str, labels: list[str], encoder: Encoder, vector: str = "embedding") -> DataFrame:
    """Memberships from a mixture that starts at the labels' vectors: key, group_id, label."""
    vectors = np.array([v / np.linalg.norm(v) for v in encoder.encode(labels)])
    x = stash(rows.select(key, unit(F.col(vector)).alias("x")), "x")
    model = G.fit_from(x, vectors)
    names = rows.sparkSession.createDataFrame(list(enumerate(labels)), "group_id int, label string")
    return G.soft_groups(x, model, key).join(F.broadcast(names), "group_id")  # one row a label


def outline_groups(docs: DataFrame, model, shown: int = 40, by: str = "conv_id") -> DataFrame:
    """conv_id, episode_id, group_id, label: stretches a model sees in at most ``shown`` evenly spaced excerpts (docs: conv_id, episode_id, seq, text).

    A turn belongs to the last stretch that starts at or before it; the first stretch
    reaches back to the beginning. Collections without a readable reply have no rows.
    """
    from recallspark.operators.segmentation import strided_sample

    rows = strided_sample(docs, shown, by)
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy("seq")))  # at most `shown` a collection
    rows = stash(rows.select(by, "seq", "n", F.concat(F.col("n").cast("string"), F.lit(". "), _plain(F.col("text"), 160)).alias("line")), "shown")
    prompts = rows.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("e"))
    said = call_column(prompts.select(by, fill(OUTLINE, excerpts=F.col("e")).alias("prompt")), "prompt", model, max_tokens=1200, temperature=0.0)
    spans = said.select(by, F.explode(F.from_json(salvaged_json("call.text"), "spans array<string>")["spans"]).alias("s"))
    pair, named = F.from_json("s", "array<string>"), F.from_json("s", "start string, label string")
    start = F.when(F.trim("s").startswith("["), F.try_element_at(pair, F.lit(1))).otherwise(named["start"]).try_cast("int")
    label = F.trim(F.when(F.trim("s").startswith("["), F.try_element_at(pair, F.lit(2))).otherwise(named["label"]))
    cuts = spans.select(by, start.alias("n"), F.coalesce(label, F.lit("")).alias("label")).join(rows, [by, "n"]).select(by, "seq", "label")
    w = Window.partitionBy(by).orderBy("seq", "label")  # at most `shown` a collection
    cuts = cuts.withColumn("group_id", F.row_number().over(w) - 1).withColumn("from_seq", F.when(F.col("group_id") == 0, F.lit(0)).otherwise(F.col("seq")))
    cuts = cuts.withColumn("upto", F.lead("seq").over(w))
    # a stretch's episodes: the stretches of a collection are few, so they go to every row of it
    held = docs.select(by, "episode_id", "seq").join(F.broadcast(cuts.select(by, "group_id", "label", "from_seq", "upto")), by)
    return held.where((F.col("seq") >= F.col("from_seq")) & (F.col("upto").isNull() | (F.col("seq") < F.col("upto")))).select(by, "episode_id", "group_id", "label")


def second_level(groups: DataFrame, summaries: DataFrame, key: str, encoder: Encoder) -> DataFrame:
    """Memberships with groups of groups: summaries (group_id, statement; a dozen at most) are clustered, and a cluster has all members of its groups."""
    held = summaries.orderBy("group_id").limit(12).toPandas()
    if len(held) < 3:
        return groups.select(key, F.col("group_id").cast("string").alias("group_id"))
    v = np.array([x / (np.linalg.norm(x) or 1) for x in encoder.encode(held["statement"].tolist())])
    labels = ward_labels(v, np.ones(len(v)))
    parents = groups.sparkSession.createDataFrame([(int(g), f"L2-{p}") for g, p in zip(held["group_id"], labels)], "group_id int, parent string")
    upper = groups.join(F.broadcast(parents), "group_id").select(key, F.col("parent").alias("group_id")).distinct()
    return groups.select(key, F.col("group_id").cast("string").alias("group_id")).unionByName(upper)


# The index, the registry, reports ---------------------------------------------------


def group_index(topics: DataFrame, entities: DataFrame) -> DataFrame:
    """The bridge of groups and episodes: conv_id, group_id, kind, label, episode_id. Either way of reading it is a filter."""
    t = topics.select("conv_id", F.concat(F.lit("topic-"), F.col("group_id").cast("string")).alias("group_id"), F.lit("topic").alias("kind"), F.coalesce("label", F.lit("")).alias("label"), "episode_id")
    e = entities.select("conv_id", F.concat(F.lit("entity-"), F.lower("name")).alias("group_id"), F.lit("entity").alias("kind"), F.col("name").alias("label"), "episode_id")
    return t.unionByName(e)


def mark_dirty(index: DataFrame, fresh: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """conv_id, group_id, new_since: how many fresh episodes (episode_id) each group has gained since its summary."""
    found = index.join(fresh.select("episode_id").distinct(), "episode_id", "left_semi").groupBy("conv_id", "group_id").agg(F.count("*").alias("new_since"))
    both = found if counts is None else found.unionByName(counts.select("conv_id", "group_id", "new_since"))
    return both.groupBy("conv_id", "group_id").agg(F.sum("new_since").alias("new_since"))


def entity_members(mentions: DataFrame, canonical: DataFrame, least: int = 2) -> DataFrame:
    """conv_id, name, episode_id: mentions under the name that aliases stand for, groups of at least ``least``.

    ``mentions``: conv_id, name, episode_id; ``canonical``: conv_id, name, canonical.
    """
    named = mentions.join(canonical.select("conv_id", "name", "canonical"), ["conv_id", "name"], "left")
    rows = named.select("conv_id", F.coalesce("canonical", "name").alias("name"), "episode_id").distinct()
    large = rows.groupBy("conv_id", "name").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return rows.join(large.select("conv_id", "name"), ["conv_id", "name"], "left_semi")


ALIASES = 'Which of these pairs of names mean the same person or thing?\n\n{pairs}\n\nReply with JSON alone: {"pairs": [{"n": 1, "same": true or false, "canonical": "the name to keep"}]}'


def judged_aliases(pairs: DataFrame, model) -> DataFrame:
    """conv_id, short, long, canonical of the candidate pairs a model takes for the same; the canonical name must be one of the pair.

    One call a conversation: its candidates come from a bounded list of names.
    """
    w = Window.partitionBy("conv_id").orderBy("short", "long")
    rows = stash(pairs.withColumn("n", F.row_number().over(w)), "pairs")
    line = F.concat(F.col("n").cast("string"), F.lit(". "), "short", F.lit(" / "), "long")
    prompts = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x["line"]), "\n").alias("p"))
    said = call_column(prompts.select("conv_id", fill(ALIASES, pairs=F.col("p")).alias("prompt")), "prompt", model, max_tokens=1024, temperature=0.0)
    v = said.select("conv_id", F.explode(items_of(salvaged_json("call.text"), "pairs", "n string, same string, canonical string")).alias("v"))
    v = v.select("conv_id", F.col("v.n").try_cast("int").alias("n"), F.lower("v.same").alias("same"), F.trim("v.canonical").alias("canonical"))
    one = v.where((F.col("same") == "true") & F.col("n").isNotNull()).groupBy("conv_id", "n").agg(F.max("canonical").alias("canonical"))
    return rows.join(one, ["conv_id", "n"]).where(F.col("canonical").isin(F.col("short"), F.col("long"))).select("conv_id", "short", "long", "canonical")


def collapse_aliases(judged: DataFrame, rounds: int = 3) -> DataFrame:
    """conv_id, name, canonical: each name that gave way, chains followed ``rounds`` times."""
    lost = F.when(F.col("canonical") == F.col("short"), F.col("long")).otherwise(F.col("short"))
    first = judged.select("conv_id", lost.alias("name"), "canonical").groupBy("conv_id", "name").agg(F.max(F.struct(F.length("canonical"), "canonical")).alias("c")).select("conv_id", "name", "c.canonical")
    out = first
    for _ in range(rounds):
        step = first.select("conv_id", F.col("name").alias("canonical"), F.col("canonical").alias("further"))
        out = out.join(step, ["conv_id", "canonical"], "left").select("conv_id", "name", F.coalesce("further", "canonical").alias("canonical"))
    return out.where(F.col("name") != F.col("canonical"))


def diagnostics(groups: DataFrame, key: str) -> DataFrame:
    """One row: groups, mean, median and largest size, memberships per row, share of rows in several."""
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("n"))
    held = groups.groupBy(key).agg(F.count("*").alias("m"))
    a = sizes.agg(F.count("*").alias("groups"), F.round(F.avg("n"), 4).alias("mean_size"), F.round(F.percentile("n", 0.5), 4).alias("median_size"), F.max("n").alias("largest"))
    b = held.agg(F.round(F.avg("m"), 4).alias("memberships"), F.round(F.avg((F.col("m") > 1).cast("int")), 4).alias("shared"))
    return a.join(F.broadcast(b))  # one row each


def cohesion(groups: DataFrame, rows: DataFrame, key: str, vector: str = "embedding", seed: int = 0) -> DataFrame:
    """One row: mean similarity inside the groups, inside random groups of the same sizes, their gap, groups scored.

    From the sums of unit vectors, so all pairs count and none is made. The control deals
    rows to the groups' sizes in the order of their hash.
    """
    u = stash(rows.where(F.col(vector).isNotNull()).select(key, unit(F.col(vector)).alias("u")), "unit")

    def inside(members: DataFrame, name: str) -> DataFrame:
        long = members.join(u, key).select("group_id", F.posexplode("u").alias("dim", "x"))
        sums = long.groupBy("group_id", "dim").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
        each = sums.groupBy("group_id").agg(F.sum(F.col("x") * F.col("x")).alias("q"), F.max("n").alias("n")).where("n > 1")
        return each.agg(F.avg((F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias(name), F.count("*").alias(f"n_{name}"))

    members = groups.select(key, "group_id").distinct()
    sizes = members.groupBy("group_id").agg(F.count("*").alias("n")).orderBy("group_id").toPandas()  # one number a group
    upto = np.cumsum(sizes["n"].to_numpy(float)) / max(sizes["n"].sum(), 1)

    @F.pandas_udf("int")
    def deal(h: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(upto, h.to_numpy() / 1_000_003.0, "right").clip(0, max(len(upto) - 1, 0)).astype(np.int32))

    control = u.select(key, deal(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_003))).alias("group_id"))
    both = inside(members, "cohesion").join(F.broadcast(inside(control, "random")))  # one row each
    return both.select(F.round("cohesion", 4).alias("cohesion"), F.round("random", 4).alias("random"), F.round(F.col("cohesion") - F.col("random"), 4).alias("gap"), F.col("n_cohesion").alias("n_scored"))


def _edges(rows: DataFrame, key: str) -> DataFrame:
    return stash(G.mutual_neighbours(rows, key).select(F.col(key).alias("src"), F.col("other").alias("dst"), F.col("sim").alias("weight")), "edges")


def _projected(rows: DataFrame, key: str) -> DataFrame:
    return stash(G.project(rows).select(key, "x"), "projected")


#: Method by name: (function of rows with key and embedding, the key's name; whether a model is needed). ``segment`` and
#: ``window`` read the column ``pos`` or ``seq`` as well; methods that need a model are called through their own functions.
METHODS: dict[str, tuple[Callable[[DataFrame, str], DataFrame] | None, bool]] = {
    "random": (lambda rows, key: G.random_groups(rows, key, 8), False),
    "window": (lambda rows, key: fixed_windows(rows, 8).select(key, F.col("block").alias("group_id")), False),
    "mixture": (lambda rows, key: (lambda x: G.soft_groups(x, G.select_mixture(x), key))(_projected(rows, key)), False),
    "agglom": (lambda rows, key: ward_groups(_projected(rows, key), key), False),
    "hdbscan": (lambda rows, key: density_groups(_projected(rows, key), key), False),
    "spectral": (lambda rows, key: G.spectral_groups(_edges(rows, key), 8).withColumnRenamed("id", key), False),
    "louvain": (lambda rows, key: modularity_communities(_edges(rows, key)).withColumnRenamed("id", key), False),
    "segment": (lambda rows, key: tile_segments(rows.select("conv_id", key, "pos", unit(F.col("embedding")).alias("vector"))).select(key, F.col("segment").alias("group_id")), False),
    "llm_topics": (None, True), "llm_topics_x3": (None, True), "llm_outline": (None, True), "entity": (None, True), "hierarchical": (None, True),
}
