"""Most similar vectors for every vector: inverted file with product quantisation.

Method. K-means on a bounded sample gives coarse centroids (the inverted file's
cells) and, on the residuals, one small codebook per subspace. Every vector is
indexed in its nearest cell with the codes of its residual. A query probes the
cells near it; in each cell asymmetric distance tables (exact query against
codebook entries) score all codes, and the best ``shortlist`` are reranked by the
exact cosine in double precision of the stored vectors.

Scale. Cells near each other form shards of about ``shard_rows`` rows, so a query
travels once per shard it probes (about 1.05 times on clustered data), not once
per cell. A shard that one dense cell makes larger is cut into blocks by hash, with
its queries sent to each block, so no task holds an unbounded group. One fit makes at
most ``max_cells`` cells from at most ``max_cells * train_per_cell`` rows (131,072,
50 MB). A collection of more than ``max_cells * rows_per_cell`` rows is divided into
regions of that size by coarser centroids, each fitted on its own sample in a task of
its own; the cells of all regions are then one model. A vector looks into every region
near it, but its probes are the best cells over all of them, so it travels no more
often than with one region and is written once for each shard. The number of cells
grows with the rows, and the model with it: 1.6 MB a region, sent to every executor,
at most ``max_regions`` (100 MB); past that cells hold more rows. Everything but
fitting covers all rows.

Hot copies. A vector stored more than ``max_copies`` times would make one cell
hold all its copies. Of such a class ``k + 1`` members take part in the search
(no top k needs more) and every other member gets its k nearest from them: all
are copies at cosine 1, so that is exact.

Defined results: NULL, short, long, non-finite and all-zero vectors, and rows
without an id, take no part; a repeated id counts once (with differing vectors,
each is searched and the id keeps its best matches); ties fall to the smaller id;
a table with fewer than k + 1 vectors gives shorter lists, an empty one none;
further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallspark.session import stash


@dataclass(frozen=True)
class Config:
    dim: int = 96
    k: int = 10
    rows_per_cell: int = 256
    max_cells: int = 4096
    max_regions: int = 64
    train_per_cell: int = 32
    min_probes: int = 2
    max_probes: int = 16
    #: Further cells are probed while their score (x.c - |c|^2 / 2) is this near the best.
    probe_margin: float = 0.1
    subspaces: int = 16
    codewords: int = 256
    shortlist: int = 160
    shard_rows: int = 4096
    max_copies: int = 64
    seed: int = 7


@dataclass
class Model:
    regions: np.ndarray  # coarse centroids
    starts: np.ndarray  # first cell of each region, and the number of cells
    centroids: np.ndarray
    books: np.ndarray  # regions x subspaces x codewords x dims
    shard: np.ndarray  # of each cell
    blocks: np.ndarray  # of each shard

    def region_of(self, cells: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, cells, "right") - 1


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds; empty centres restart at random rows."""
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        order = np.argsort(near, kind="stable")
        full = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[full]
        c[full] = np.add.reduceat(x[order], starts, axis=0) / count[full, None]
        lost = np.flatnonzero(count == 0)
        if len(lost):
            c[lost] = x[rng.choice(len(x), len(lost))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, block: int = 8192) -> np.ndarray:
    bias = 0.5 * (c * c).sum(1)
    return np.concatenate([np.argmax(x[i : i + block] @ c.T - bias, axis=1) for i in range(0, len(x), block)] or [np.zeros(0, int)])


def group_cells(centroids: np.ndarray, mass: np.ndarray, most: float) -> np.ndarray:
    """Shard of each cell: halve along the main direction until a shard has at most ``most``."""
    shard, done, todo = np.zeros(len(centroids), np.int32), 0, [np.arange(len(centroids))]
    while todo:
        cells = todo.pop()
        if len(cells) == 1 or mass[cells].sum() <= most:
            shard[cells], done = done, done + 1
            continue
        x = centroids[cells] - centroids[cells].mean(0)
        axis = np.linalg.svd(x, full_matrices=False)[2][0]
        order = np.argsort(x @ axis, kind="stable")
        share = np.cumsum(mass[cells][order])
        cut = int(np.clip(np.searchsorted(share, share[-1] / 2) + 1, 1, len(cells) - 1))
        todo += [cells[order[:cut]], cells[order[cut:]]]
    return shard


def fit_cells(sample: np.ndarray, rows: float, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids, residual codebooks and the rows of each cell, from unit vectors."""
    rng = np.random.default_rng(cfg.seed)
    if not len(sample):
        sample = np.zeros((1, cfg.dim), np.float32)
    cells = int(np.clip(rows // cfg.rows_per_cell, 1, cfg.max_cells))
    centroids = kmeans(sample, cells, 8, rng)
    near = nearest(sample, centroids)
    residual = (sample - centroids[near])[rng.choice(len(sample), min(len(sample), 8192), replace=False)]
    width = cfg.dim // cfg.subspaces
    books = [kmeans(np.ascontiguousarray(residual[:, m * width : (m + 1) * width]), cfg.codewords, 6, rng) for m in range(cfg.subspaces)]
    short = max(0, cfg.codewords - len(books[0]))  # a small sample has fewer codewords; none points at the padding
    books = np.pad(np.stack(books), ((0, 0), (0, short), (0, 0)), constant_values=np.float32(1e9))
    return centroids.astype(np.float32), books.astype(np.float32), np.bincount(near, minlength=len(centroids)) / len(near) * rows


def joined(regions: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cfg: Config) -> Model:
    """One model of the cells of all regions."""
    centroids, held = np.concatenate([p[0] for p in parts]), np.concatenate([p[2] for p in parts])
    shard = group_cells(centroids, held, cfg.shard_rows)
    blocks = np.maximum(1, np.ceil(np.bincount(shard, weights=held) / (4 * cfg.shard_rows))).astype(np.int32)
    return Model(regions, np.cumsum([0] + [len(p[0]) for p in parts]), centroids, np.stack([p[1] for p in parts]), shard, blocks)


def fit(sample: np.ndarray, rows: int, cfg: Config) -> Model:
    """Coarse centroids, residual codebooks and shards from unit vectors."""
    return joined(np.zeros((1, cfg.dim), np.float32), [fit_cells(sample, rows, cfg)], cfg)


def usable_arrays(batch: pa.RecordBatch | pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and float32 vectors of the usable rows of columns id, embedding."""
    column = batch.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    good = np.flatnonzero(
        np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
        & np.asarray(pc.is_valid(batch.column("id")))
    )
    flat = column.take(pa.array(good)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dim)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return good[fine], x[fine]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(1, keepdims=True)  # squares of tiny parts would vanish
    x /= scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


ROUTED = "kind int, shard int, block int, id string, vec binary, home int, code binary, cells binary"
ROUTED_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int32()), ("id", pa.string()), ("vec", pa.binary()), ("home", pa.int32()), ("code", pa.binary()), ("cells", pa.binary())]
)
FOUND = "kind int, id string, near array<struct<far:double,id:string>>"


def probed(u: np.ndarray, centroids: np.ndarray, cfg: Config, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The best centroids of each unit vector, best first, and which of them are near enough to probe."""
    probes = min(cfg.max_probes, len(centroids))
    score = u @ centroids.T - 0.5 * (centroids**2).sum(1)
    top = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
    best = np.take_along_axis(score, top, 1)
    use = best >= best[:, :1] - cfg.probe_margin
    use[:, :least] = True
    return top, use


def probed_cells(u: np.ndarray, model: Model, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """As ``probed``, over the cells of every region near a vector."""
    if len(model.regions) == 1:
        return probed(u, model.centroids, cfg, cfg.min_probes)
    visited, near = probed(u, model.regions, cfg, 1)
    best, top = np.full((len(u), cfg.max_probes), -np.inf, np.float32), np.zeros((len(u), cfg.max_probes), np.int64)
    for r, (lo, hi) in enumerate(zip(model.starts, model.starts[1:])):
        who = np.flatnonzero((near & (visited == r)).any(1))
        if not len(who):
            continue
        cells, _ = probed(u[who], model.centroids[lo:hi], cfg, 1)
        c = model.centroids[lo:hi][cells]
        score = np.einsum("nd,npd->np", u[who], c) - 0.5 * (c**2).sum(2)
        score, cells = np.concatenate([best[who], score], 1), np.concatenate([top[who], cells + lo], 1)
        order = np.argsort(-score, axis=1, kind="stable")[:, : cfg.max_probes]
        best[who], top[who] = np.take_along_axis(score, order, 1), np.take_along_axis(cells, order, 1)
    use = best >= best[:, :1] - cfg.probe_margin
    use[:, : cfg.min_probes] = True
    return top, use & np.isfinite(best)


def routed_rows(kind: int, model: Model, ids: list[str], x: np.ndarray, cfg: Config) -> pa.RecordBatch:
    """A row for each shard and block that a vector must visit."""
    u = unit(x).astype(np.float32)
    top, use = probed_cells(u, model, cfg)
    home, width = top[:, 0], cfg.dim // cfg.subspaces
    residual = u - model.centroids[home]
    code = np.empty((len(u), cfg.subspaces), np.uint8)
    region = model.region_of(home)
    for r in np.unique(region):
        of = np.flatnonzero(region == r)
        for m, book in enumerate(model.books[r]):
            code[of, m] = nearest(residual[of, m * width : (m + 1) * width], book)
    shards = model.shard[top]
    out: dict[str, list] = {c: [] for c in ROUTED_SCHEMA.names[1:]}
    for i, name in enumerate(ids):
        mine = top[i][use[i]]
        where = shards[i][use[i]]
        data, own = x[i].tobytes(), int(shards[i, 0])
        block = hash_of(name) % int(model.blocks[own])
        for s in dict.fromkeys(where.tolist()):
            cells = mine[where == s].astype(np.int32).tobytes()
            for b in range(int(model.blocks[s])):
                held = s == own and b == block
                out["shard"].append(s)
                out["block"].append(b)
                out["id"].append(name)
                out["vec"].append(data)
                out["home"].append(int(home[i]) if held else -1)
                out["code"].append(code[i].tobytes() if held else b"")
                out["cells"].append(cells)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(out["id"]), pa.int32())] + [pa.array(out[c], ROUTED_SCHEMA.field(c).type) for c in out], schema=ROUTED_SCHEMA)


def router(kind: int, shared, cfg: Config):
    """Arrow batches of (id, embedding) to ``ROUTED`` rows."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                rows, x = usable_arrays(batch, cfg.dim)
                if len(rows):
                    ids = batch.column("id").take(pa.array(rows)).to_pylist()
                    yield routed_rows(kind, shared.value[kind], ids, x, cfg)

    return route


PLACED = "region int, id string, embedding array<float>"


def fit_regions(df: DataFrame, rows: int, cfg: Config) -> Model:
    """The model of a collection too large for one fit: a fit for each region, in a task of its own."""
    many = min(-(-rows // (cfg.max_cells * cfg.rows_per_cell)), cfg.max_regions)
    most = cfg.max_cells * cfg.train_per_cell
    sample = sample_vectors(df, rows, many * max(cfg.train_per_cell, 256), cfg)
    if not len(sample):
        return fit(sample, rows, cfg)
    regions = kmeans(sample, many, 8, np.random.default_rng(cfg.seed))
    share = min(1.0, 1.05 * many * most / rows)
    drawn = df.where(F.pmod(F.xxhash64("id", F.lit(cfg.seed + 1)), F.lit(1_000_003)) < int(share * 1_000_003))

    def placer(kept: np.ndarray):
        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, x = usable_arrays(batch, cfg.dim)
                if not len(rows):
                    continue
                region = nearest(unit(x).astype(np.float32), regions)
                ids = batch.column("id").take(pa.array(rows))
                stay = np.array([hash_of(i) % 65_536 for i in ids.to_pylist()]) < kept[region] * 65_536
                yield pa.RecordBatch.from_arrays(
                    [pa.array(region[stay].astype(np.int32)), ids.filter(pa.array(stay)), batch.column("embedding").take(pa.array(rows[stay]))], names=["region", "id", "embedding"]
                )

        return place

    counts = dict(drawn.mapInArrow(placer(np.ones(many)), PLACED).groupBy("region").count().collect())
    # A region that more rows fall into than one fit takes is thinned before any task holds it.
    kept = np.array([min(1.0, most / counts.get(r, 1)) for r in range(many)])

    def fit_region(table: pa.Table) -> pa.Table:
        region = table.column("region")[0].as_py()
        x = unit(usable_arrays(table.sort_by("id"), cfg.dim)[1]).astype(np.float32)
        part = fit_cells(x, counts[region] / share, cfg)
        return pa.table({"region": pa.array([region], pa.int32()), "part": pa.array([pickle.dumps(part)], pa.binary())})

    fitted = drawn.mapInArrow(placer(kept), PLACED).groupBy("region").applyInArrow(fit_region, "region int, part binary").collect()
    parts = {r.region: pickle.loads(r.part) for r in fitted}
    if not parts:
        return fit(np.zeros((0, cfg.dim), np.float32), rows, cfg)
    return joined(regions[sorted(parts)], [parts[r] for r in sorted(parts)], cfg)


def hash_of(name: str) -> int:
    from zlib import crc32

    return crc32(name.encode())


def searcher(shared, cfg: Config):
    """One shard's block with the kind's model."""

    def search(table: pa.Table) -> pa.Table:
        return search_block(table, shared.value[table.column("kind")[0].as_py()], cfg)

    return search


def search_block(table: pa.Table, model: Model, cfg: Config) -> pa.Table:
    """ADC over the probed cells, exact rerank, k best per query."""
    kind = table.column("kind")[0].as_py()
    ids = np.array(table.column("id").to_pylist(), dtype=object)
    vec = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(-1, cfg.dim)
    home = table.column("home").to_numpy()
    cells_of = table.column("cells").to_pylist()
    code_of = table.column("code").to_pylist()
    order = np.lexsort((-home, ids))  # a stored row before the query-only rows of its id
    ids, vec, home = ids[order], vec[order], home[order]
    first = np.r_[True, ids[1:] != ids[:-1]]
    order, ids, vec, home = order[first], ids[first], vec[first], home[first]
    u = unit(vec)
    db = np.flatnonzero(home >= 0)
    codes = np.frombuffer(b"".join(code_of[order[j]] for j in db), np.uint8).reshape(-1, cfg.subspaces)
    by_cell = np.argsort(home[db], kind="stable")
    cell_ids, starts = np.unique(home[db][by_cell], return_index=True)
    ends = np.r_[starts[1:], len(db)]
    probes = [np.frombuffer(cells_of[j], np.int32) for j in order]
    asked = np.concatenate(probes) if probes else np.zeros(0, np.int32)
    asker = np.repeat(np.arange(len(ids)), [len(p) for p in probes])
    by_ask = np.argsort(asked, kind="stable")
    asked, asker = asked[by_ask], asker[by_ask]
    best = np.full((len(ids), cfg.k), -np.inf)
    who = np.full((len(ids), cfg.k), -1, np.int64)
    width = cfg.dim // cfg.subspaces
    u32 = u.astype(np.float32)
    for cell, lo, hi in zip(cell_ids, starts, ends):
        members = db[by_cell[lo:hi]]
        code = codes[by_cell[lo:hi]]
        queries = asker[np.searchsorted(asked, cell) : np.searchsorted(asked, cell, "right")]
        keep = min(cfg.shortlist, len(members))
        books = model.books[model.region_of(cell)]
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256]
            parts = u32[q].reshape(len(q), cfg.subspaces, width)
            tables = np.einsum("mkd,qmd->mkq", books, parts, optimize=True)
            score = np.repeat((u32[q] @ model.centroids[cell])[None, :], len(members), 0)
            one = np.empty_like(score)
            for m in range(cfg.subspaces):
                np.take(tables[m], code[:, m], axis=0, out=one, mode="clip")
                score += one
            if keep < len(members):
                short = np.sort(np.argpartition(-score, keep - 1, axis=0)[:keep].T, axis=1)
            else:
                short = np.broadcast_to(np.arange(len(members)), (len(q), len(members)))
            found = members[short]
            exact = np.matmul(u[found], u[q][:, :, None])[:, :, 0]
            exact[found == q[:, None]] = -np.inf
            all_sim = np.concatenate([best[q], exact], 1)
            all_who = np.concatenate([who[q], found], 1)
            pick = np.sort(np.argpartition(-all_sim, cfg.k - 1, axis=1)[:, : cfg.k], axis=1)
            best[q] = np.take_along_axis(all_sim, pick, 1)
            who[q] = np.take_along_axis(all_who, pick, 1)
    some = np.isfinite(best)
    asks = np.flatnonzero(some.any(1))
    lengths = some[asks].sum(1)
    offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32))
    flat = some[asks]
    near = pa.StructArray.from_arrays(
        [pa.array(-best[asks][flat]), pa.array(ids[who[asks][flat]].tolist(), pa.string())], names=["far", "id"]
    )
    return pa.table(
        {"kind": pa.array([kind] * len(asks), pa.int32()), "id": pa.array(ids[asks].tolist(), pa.string()), "near": pa.ListArray.from_arrays(offsets, near)}
    )


def sample_vectors(df: DataFrame, rows: int, want: int, cfg: Config) -> np.ndarray:
    """At most ``want`` unit vectors, chosen by the hash of their id."""
    share = min(1.0, 1.05 * want / max(rows, 1))
    part = df.where((F.size("embedding") == cfg.dim) & (F.pmod(F.xxhash64("id", F.lit(cfg.seed)), F.lit(1_000_003)) < int(share * 1_000_003)))
    found = part.toArrow()
    if not found.num_rows:
        return np.zeros((0, cfg.dim), np.float32)
    return unit(usable_arrays(found, cfg.dim)[1]).astype(np.float32)[:want]


def nearest_neighbours(collections: list[DataFrame], cfg: Config = Config()) -> DataFrame:
    """The k most similar of each collection's own vectors, for every vector.

    ``collections``: frames with columns ``id`` (string) and ``embedding``. Result:
    kind (number of the collection), id, near (array of (far = -cosine, id), best first).
    """
    spark = collections[0].sparkSession
    frames = [df.select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<float>").alias("embedding")) for df in collections]
    print_of = F.xxhash64("embedding")
    low, high = F.array_min("embedding"), F.array_max("embedding")
    fine = (F.size("embedding") == cfg.dim) & (low > float("-inf")) & (high < float("inf")) & ((low != 0) | (high != 0)) & F.col("id").isNotNull()
    counted = [
        df.where(fine).select(F.lit(k).alias("kind"), print_of.alias("print"))
        for k, df in enumerate(frames)
    ]
    prints = counted[0]
    for other in counted[1:]:
        prints = prints.unionByName(other)
    hot = stash(prints.groupBy("kind", "print").count().where(F.col("count") > cfg.max_copies), "hot")
    tails = None
    if not hot.isEmpty():
        frames, tails = set_copies_apart(frames, hot, cfg)
    models = {}
    for k, raw in enumerate(collections):
        rows = raw.count()
        cells = int(np.clip(rows // cfg.rows_per_cell, 1, cfg.max_cells))
        one = rows <= cfg.max_cells * cfg.rows_per_cell
        models[k] = fit(sample_vectors(frames[k], rows, cells * cfg.train_per_cell, cfg), rows, cfg) if one else fit_regions(frames[k], rows, cfg)
    shared = spark.sparkContext.broadcast(models)
    routed = reduce(DataFrame.unionByName, [df.mapInArrow(router(k, shared, cfg), ROUTED) for k, df in enumerate(frames)])
    found = routed.groupBy("kind", "shard", "block").applyInArrow(searcher(shared, cfg), FOUND)
    merged = found.groupBy("kind", "id").agg(F.flatten(F.collect_list("near")).alias("near"))
    near = F.slice(F.array_sort(F.array_distinct("near")), 1, cfg.k)
    result = merged.select("kind", "id", near.alias("near"))
    return result if tails is None else result.unionByName(tails)


def set_copies_apart(frames: list[DataFrame], hot: DataFrame, cfg: Config) -> tuple[list[DataFrame], DataFrame]:
    """Frames with only k + 1 members of each hot class, and the lists of the others."""
    kept_frames, tails = [], None
    for k, df in enumerate(frames):
        # A class has more than max_copies rows, so these are few beside the rows, which stay where they are.
        mine = F.broadcast(hot.where(F.col("kind") == k).select("print"))
        keyed = df.withColumn("print", F.xxhash64("embedding"))
        members = keyed.where(F.col("id").isNotNull()).join(mine, "print", "left_semi").select("print", "id").distinct()
        w = Window.partitionBy("print").orderBy("id")
        first = stash(members.withColumn("n", F.row_number().over(w)).where(F.col("n") <= cfg.k + 1), "copies").select("print", "id")
        last = F.broadcast(first.groupBy("print").agg(F.max("id").alias("last")))
        marked = keyed.join(last, "print", "left")
        plain = marked.where(F.col("last").isNull()).select("id", "embedding")
        kept_frames.append(plain.unionByName(marked.where(F.col("id") <= F.col("last")).select("id", "embedding").dropDuplicates(["id"])))
        heads = first.groupBy("print").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.lit(-1.0).alias("far"), "id"))), 1, cfg.k).alias("near"))
        rest = members.join(last, "print").where(F.col("id") > F.col("last")).join(heads, "print")
        part = rest.select(F.lit(k).alias("kind"), "id", "near")
        tails = part if tails is None else tails.unionByName(part)
    return kept_frames, tails


def neighbour_pairs(lists: DataFrame) -> DataFrame:
    """Distinct pairs, smaller id first, where either is in the other's list."""
    one = lists.select("kind", "id", F.explode("near.id").alias("other"))
    return one.select("kind", F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def exact_search(queries: DataFrame, base: DataFrame, k: int, dim: int, block: int = 8192) -> DataFrame:
    """Brute force for a stated query set, in blocks of at most ``block`` queries.

    Each block (3 MB at 96 dimensions) is sent to the executors for one pass over
    ``base``; every partition returns its k best, which are merged per query.
    """
    spark = base.sparkSession
    names = [r.id for r in queries.select("id").orderBy("id").toLocalIterator()]
    result = None
    for at in range(0, len(names), block):
        bounds = names[at], names[min(at + block, len(names)) - 1]
        held = queries.where(F.col("id").between(*bounds)).toArrow()
        rows, x = usable_arrays(held, dim)
        ids = np.array(held.column("id").take(pa.array(rows)).to_pylist(), dtype=object)
        ids, one = np.unique(ids, return_index=True)
        shared = spark.sparkContext.broadcast((ids, unit(x[one])))

        def scan(batches, shared=shared):
            ids, q = shared.value
            best: dict[int, list] = {}
            for batch in batches:
                rows, x = usable_arrays(batch, dim)
                if not len(rows):
                    continue
                names = np.array(batch.column("id").take(pa.array(rows)).to_pylist(), dtype=object)
                names, one = np.unique(names, return_index=True)
                sims = q @ unit(x[one]).T
                sims[ids[:, None] == names[None, :]] = -np.inf
                top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                for i in range(len(ids)):
                    more = {names[j]: -sims[i, j] for j in top[i] if np.isfinite(sims[i, j])}
                    best[i] = sorted((dict(best.get(i, [])) | more).items(), key=lambda p: (p[1], p[0]))[:k]
            for i, near in best.items():
                yield pa.RecordBatch.from_pylist(
                    [{"id": ids[i], "near": [{"far": f, "id": n} for n, f in near]}],
                    pa.schema([("id", pa.string()), ("near", pa.list_(pa.struct([("far", pa.float64()), ("id", pa.string())])))]),
                )

        part = base.select("id", "embedding").mapInArrow(scan, "id string, near array<struct<far:double,id:string>>")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return spark.createDataFrame([], "id string, near array<struct<far:double,id:string>>")
    merged = result.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("id", F.slice(F.array_sort(F.array_distinct("near")), 1, k).alias("near"))
