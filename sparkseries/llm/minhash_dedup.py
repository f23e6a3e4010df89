"""Near-duplicate documents: a multi-index Hamming join over b-bit MinHash signatures.

A document's set is its distinct k-word shingles (A-Z lower-cased). Its signature is ``chunks * width``
MinHash coordinates of 16 bits; the signature distance of two documents is the number of coordinates
that differ. Coordinates are split into chunks; if two signatures differ in at most
``chunks * (errors + 1) - 1`` coordinates, some chunk has at most ``errors`` of them (pigeonhole). Each
chunk is therefore indexed under every way of leaving out ``errors`` of its coordinates, so all pairs
within that distance meet in a bucket, and of those beyond it most. At the default settings a pair at the similarity
threshold is missed with a probability of about 1e-6.

Equal sets are merged first. In a bucket every member is held against the bucket's smallest member: pairs whose signatures
differ in more coordinates than a pair at the threshold would (``reach_for``) are dropped, the others are confirmed exactly on
full shingle sets. Links give components. Pairs that met in a bucket, are not in one component yet and lie within that
distance are then confirmed as well, in bounded blocks, so that a family of copies costs about one comparison a member,
no pair that could link components is left out and no list of pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._state import connected_components, counted, free_name, written
from ._words import U, Words, mix, signed, slices

WIDTH, ERRORS, BITS = 5, 1, 16
BLOCK, BLOCK_BYTES, LOT_ROWS, LOT_BYTES = 256, 8 << 20, 1024, 8 << 20  # rows and bytes of a side of a block; of a lot
BROADCAST_NODES = 200_000  # ids and hashes of texts that are broadcast, else joined by shuffle


def chunks_for(similarity: float, width: int = WIDTH, errors: int = ERRORS, miss: float = 2e-7) -> int:
    """Chunks needed so that a pair at ``similarity`` has no chunk within ``errors`` with probability < miss."""
    hit = sum(comb(width, e) * (1 - similarity) ** e * similarity ** (width - e) for e in range(errors + 1))
    return 1 if hit >= 1 else max(1, ceil(log(miss) / log(1 - hit)))


def reach_for(similarity: float, n: int, miss: float = 1e-6) -> int:
    """The signature distance that a pair at ``similarity`` exceeds with probability < miss."""
    p, tail, d = 1 - similarity, 1.0, -1
    while tail >= miss and d < n:
        d += 1
        tail -= comb(n, d) * p**d * similarity ** (n - d)
    return d


def shingle_sets(w: Words, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts of a slice, sorted inside each text, and the texts' bounds.

    A text of fewer than k words has its whole sequence as its only shingle; one without words has none.
    """
    total = w.sums()
    grams, at = w.grams(k, total)
    doc = w.text_of[at]
    n_words = np.diff(w.offsets)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    grams = np.concatenate([grams, w.ranges(total, w.offsets[short], n_words[short])])
    doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(rows + 1))


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def _signatures(grams: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """n MinHash coordinates (16 bits each) of every set; rows of empty sets are not meaningful."""
    a, b = _coefficients(n)
    low = (grams >> U(32)).astype(np.uint32)
    full = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, n), np.uint16)
    if len(full):
        for j in range(n):
            least = np.minimum.reduceat(low * a[j] + b[j], bounds[full])
            out[full, j] = (least >> np.uint32(8)).astype(np.uint16)
    return out


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle: int, coordinates: int) -> DataFrame:
    """Per row: rid, th (hash of the text), n_shingles, node (hash of the set, null if empty), sig."""
    rid = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("rid"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("rid", rid), T.StructField("th", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("node", T.LongType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column(2), lower=True):
                grams, bounds = shingle_sets(w, b - a, shingle)
                n = np.diff(bounds)
                total = np.zeros(len(grams) + 1, U)
                np.cumsum(mix(grams ^ U(0x5851F42D4C957F2D)), out=total[1:])
                node = mix(total[bounds[1:]] - total[bounds[:-1]] + n.astype(U))
                sig = _signatures(grams, bounds, coordinates)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n, pa.int64()), pa.array(signed(node), pa.int64(), mask=n == 0),
                    pa.array([x.tobytes() if c else None for x, c in zip(sig, n)], pa.binary())], names=["rid", "th", "n_shingles", "node", "sig"])

    return rows.mapInArrow(run, schema)


def bucket_keys(nodes: DataFrame, chunks: int, width: int, errors: int) -> DataFrame:
    """(key, node): each chunk under every choice of coordinates left out."""
    kept = list(combinations(range(width), width - errors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, chunks, width).astype(U)
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for c in range(chunks):
                for v, columns in enumerate(kept):
                    key = np.full(len(node), c * len(kept) + v + 1, U)
                    for x in columns:
                        key = mix(key * U(0x2545F4914F6CDD1D) + sig[:, c, x])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key bigint, node bigint")


def distance(a: pa.Array, b: pa.Array, n: int) -> np.ndarray:
    """Signature distance of the rows of two columns: coordinates that differ."""
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, n) for c in (a, b))
    return (x != y).sum(axis=1)


def within(pairs: DataFrame, nodes: DataFrame, coordinates: int, reach: int) -> DataFrame:
    """The pairs(u, v) whose signatures differ in at most ``reach`` coordinates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["u", "v"]).filter(pa.array(distance(batch.column(2), batch.column(3), coordinates) <= reach))

    sig = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(sig("u"), "u").join(sig("v"), "v").select("u", "v", "sig_u", "sig_v").mapInArrow(run, "u bigint, v bigint")


def confirmed(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs(u, v) with 100 * intersection >= percent * union of their full sets.

    Pairs meet the text of their v in lots of bounded rows and bytes, so one v with very many u is dealt to many tasks
    and its text travels once a lot. A task holds one set of a v and a slice of texts at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.zeros(0, U)
        for batch in batches:
            v, lead, u = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            for a, b, w in slices(batch.column(4), lower=True):
                grams, bounds = shingle_sets(w, b - a, shingle)
                heads = np.flatnonzero(lead[a:b] == 0)
                linked = np.zeros(b - a, bool)
                for x, y in zip(np.append(-1, heads), np.append(heads, b - a)):  # a head and the rows up to the next
                    if x >= 0:
                        hub, own = v[a + x], grams[bounds[x] : bounds[x + 1]]
                    if y - x > 1 and len(own):
                        if hub != v[a + x + 1]:
                            raise RuntimeError("a row came without the text that it is compared with")
                        g, at = grams[bounds[x + 1] : bounds[y]], bounds[x + 1 : y + 1] - bounds[x + 1]
                        hit = own[np.minimum(np.searchsorted(own, g), len(own) - 1)] == g
                        both = np.diff(np.append(0, np.cumsum(hit))[at])
                        linked[x + 1 : y] = 100 * both >= percent * (len(own) + np.diff(at) - both)
                at = a + np.flatnonzero(linked)
                yield pa.RecordBatch.from_arrays([pa.array(u[at]), pa.array(v[at])], names=["u", "v"])

    size = texts.select(F.col("node").alias("u"), F.octet_length("text").cast("bigint").alias("bytes"))
    lots = pairs.join(size, "u").groupBy("v").agg(F.greatest(F.ceil(F.count("*") / LOT_ROWS), F.ceil(F.sum("bytes") / LOT_BYTES)).cast("int").alias("lots"))
    lots = written(lots, "lots")
    own = lambda c: texts.select(F.col("node").alias(c), "text")
    rows = pairs.join(lots, "v").select("v", F.expr("cast(pmod(xxhash64(u), lots) as int)").alias("lot"), F.lit(1).alias("lead"), "u").join(own("u"), "u").select("v", "lot", "lead", "u", "text")
    heads = lots.select("v", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), F.lit(0).alias("lead"), F.col("v").alias("u")).join(own("v"), "v").select("v", "lot", "lead", "u", "text")
    return rows.unionByName(heads).repartition("v", "lot").sortWithinPartitions("v", "lot", "lead").mapInArrow(run, "u bigint, v bigint")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two bounded lists, by matrix products over their shared elements."""
    owner = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    values = [np.concatenate(x) if x else np.zeros(0, U) for x in (left, right)]
    shared = np.intersect1d(*values)
    out = np.zeros((len(left), len(right)), np.float32)  # counts stay exact: below 2**24
    if len(shared):
        at = [np.searchsorted(shared, v) for v in values]
        inside = [shared[np.minimum(x, len(shared) - 1)] == v for x, v in zip(at, values)]
        for low in range(0, len(shared), 4096):
            part = []
            for x, ok, o, n in zip(at, inside, owner, out.shape):
                pick = ok & (x >= low) & (x < low + 4096)
                part.append(np.zeros((n, min(4096, len(shared) - low)), np.float32))
                part[-1][o[pick], x[pick] - low] = 1
            out += part[0] @ part[1].T
    return out


def _links(t: pa.Table, coordinates: int, reach: int, percent: int) -> pa.Table:
    """Of one block: a spanning forest of the links between rows of the two sides that are in different components."""
    left, right = (t.filter(pa.array(t["side"].to_numpy() == s)) for s in (0, 1))
    read = lambda x: np.frombuffer(b"".join(x["sig"].to_pylist()), np.uint16).reshape(-1, coordinates)
    (na, ca), (nb, cb) = ([x[c].to_numpy() for c in ("node", "comp")] for x in (left, right))
    a, b = read(left), read(right)
    near = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(b), 64):
        near[:, at : at + 64] = ((a[:, None, :] != b[None, at : at + 64, :]).sum(axis=2) <= reach) & (ca[:, None] != cb[None, at : at + 64])
    i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    out: list[tuple[int, int]] = []
    if len(i):
        sets = [[np.frombuffer(x["grams"][int(k)].as_py(), U) for k in rows] for x, rows in ((left, i), (right, j))]
        size = [np.array([len(s) for s in x]) for x in sets]
        both = _common(*sets).astype(np.int64)
        linked = near[np.ix_(i, j)] & (100 * both >= percent * (size[0][:, None] + size[1][None, :] - both))
        top: dict[int, int] = {}

        def root(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = top[top[x]]
                x = top[x]
            return x

        for x, y in zip(*np.nonzero(linked)):
            p, q = root(int(ca[i[x]])), root(int(cb[j[y]]))
            if p != q:
                top[p] = q
                out.append((int(na[i[x]]), int(nb[j[y]])))
    return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})


def remaining_links(members: DataFrame, coordinates: int, reach: int, percent: int) -> DataFrame:
    """Links (u, v) between different components inside each group of ``members(group, node, comp, sig, grams)``.

    A group's rows outside its largest component (the right side) meet all of its rows (the left side), block against
    block; blocks are bounded in rows and bytes. Signatures are compared first and sets only of rows that have a pair within
    ``reach``; at most one link for each pair of components leaves a block.
    """
    each = members.groupBy("group", "comp").agg(F.count("*").alias("n"), F.sum(F.octet_length("grams")).alias("bytes"))
    of_group = each.groupBy("group").agg(F.sum("n").alias("m"), F.sum("bytes").alias("all_bytes"), F.max(F.struct("n", "bytes", "comp")).alias("top")).where("m > top.n")
    blocks = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    of_group = of_group.select("group", F.col("top.comp").alias("main"), blocks(F.col("m"), F.col("all_bytes")).alias("bi"), blocks(F.col("m") - F.col("top.n"), F.col("all_bytes") - F.col("top.bytes")).alias("bj"))
    rows = members.join(written(of_group, "groups"), "group")
    block = lambda salt, n: F.expr(f"cast(pmod(xxhash64(node, {salt}), {n}) as int)")
    every = lambda n: F.explode(F.expr(f"sequence(0, {n} - 1)"))
    names = ["group", "i", "j", "side", "node", "comp", "sig", "grams"]
    left = rows.withColumn("side", F.lit(0)).withColumn("i", block(1, "bi")).withColumn("j", every("bj")).select(*names)
    right = rows.where("comp <> main").withColumn("side", F.lit(1)).withColumn("j", block(2, "bj")).withColumn("i", every("bi")).select(*names)
    return left.unionByName(right).groupBy("group", "i", "j").applyInArrow(lambda t: _links(t, coordinates, reach, percent), "u bigint, v bigint")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, grams): the sorted shingle hashes of ``texts(node, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, w in slices(batch.column(1), lower=True):
                grams, bounds = shingle_sets(w, b - a, shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([grams[x:y].tobytes() for x, y in zip(bounds, bounds[1:])], pa.binary())], names=["node", "grams"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, grams binary")


def linked_components(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int, chunks: int, width: int, errors: int) -> DataFrame:
    """(node, component) of all nodes that a confirmed link reaches.

    First every member of a bucket is held against the bucket's smallest member; this joins nearly all of a family of
    copies. What is left are pairs of other members in different components: buckets that still hold several components are
    joined to groups, and inside each group all pairs of different components within ``reach`` are confirmed.
    """
    n = chunks * width
    reach = reach_for(percent / 100, n)
    keyed = bucket_keys(nodes, chunks, width, errors)
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    members = written(keyed.join(hubs, "key"), "members")
    inside, seen = counted(members.select("node").distinct().join(nodes.select("node", "rep"), "node"), "inside")
    wanted = inside.select("node", F.col("rep.rid").alias("r"), F.col("rep.th").alias("h"))
    wanted = F.broadcast(wanted) if seen["rows"] <= BROADCAST_NODES else wanted
    own = docs.select(F.col(id_col).alias("rid"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))
    own = own.join(wanted, F.col("h").eqNullSafe(F.col("th")) & F.col("r").eqNullSafe(F.col("rid"))).select("node", "text").dropDuplicates(["node"])
    texts = written(own, "texts")
    pairs = written(within(members.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), nodes, n, reach), "pairs")
    links = connected_components(confirmed(pairs, texts, shingle, percent))
    named = members.where("node <> hub").join(links, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    open_keys = written(named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("first")).where("lo <> hi").select("key", "first"), "keys")
    left, seen = counted(named.join(open_keys, "key"), "open")
    if not seen["rows"]:
        return links
    groups = connected_components(left.select(F.col("node").alias("u"), F.col("first").alias("v")))
    rows = left.select("node", "comp").distinct().join(groups.withColumnRenamed("component", "group"), "node").join(nodes.select("node", "sig"), "node")
    rows = written(rows.join(_sets(texts.join(left.select("node").distinct(), "node", "left_semi"), shingle), "node"), "sets")
    more, seen = counted(remaining_links(rows, n, reach, percent), "more")
    stars = links.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    return connected_components(stars.unionByName(more)) if seen["rows"] else links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, width: int = WIDTH, errors: int = ERRORS, chunks: int | None = None) -> DataFrame:
    """One row per row of ``docs``: (rid, th, n_shingles, component_id, kept, cluster).

    ``component_id`` is the smallest id reachable over links with 100 * intersection >= percent * union
    of the shingle sets; ``kept`` marks the row that carries it; ``cluster`` is
    a hash that names the component (null without shingles). Null or empty texts and texts without
    words have no shingles, link with nothing and are kept. Repeated rows share id and component and are
    all kept or all dropped (callers that need one of them use ``deduplicate``). Null ids link like
    others but never name a component unless it has no other id. Other columns are not read. Empty
    tables give empty results. Shingles and sets are compared by 64-bit hashes.
    """
    chunks = chunks or chunks_for(percent / 100, width, errors)
    drawn = written(sketch(docs, id_col, text_col, shingle, chunks * width), "sketch")
    nodes = drawn.where("node is not null").groupBy("node").agg(F.min(F.struct("rid", "th")).alias("rep"), F.min("rid").alias("low"), F.first("sig").alias("sig"))
    nodes = written(nodes, "nodes")
    linked = linked_components(nodes, docs, id_col, text_col, shingle, percent, chunks, width, errors)
    joined = linked.join(nodes.select("node", "low"), "node")
    lows = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    named = linked.join(lows, "component").select("node", "component_id", "component")
    own = nodes.join(named, "node", "left").select("node", F.coalesce("component_id", "low").alias("component_id"), F.coalesce("component", "node").alias("cluster"))
    own = written(own, "components")
    out = drawn.select("rid", "th", "n_shingles", "node").join(own, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("rid")).otherwise(F.col("component_id"))
    return out.select("rid", "th", "n_shingles", component.alias("component_id"), F.col("rid").eqNullSafe(component).alias("kept"), "cluster")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, **how) -> DataFrame:
    """Rows of ``docs`` without those that a smaller id in their component covers.

    Only ids and text hashes travel with the decision, so texts are joined once. Of repeated rows (same
    id and text) one stays; rows with one id and different texts of the same component keep the one
    with the smallest text hash.
    """
    found = near_duplicates(docs, id_col, text_col, shingle, percent, **how)
    first = found.where("cluster is not null").groupBy("cluster").agg(F.min(F.struct(F.col("rid").isNull().alias("n"), "rid", "th")).alias("x"))
    r, h, th = (free_name(docs, x) for x in ("kept_rid", "kept_th", "own_th"))
    keep = first.select(F.col("x.rid").alias(r), F.col("x.th").alias(h)).union(found.where("cluster is null").select("rid", "th").distinct())
    hashed = docs.withColumn(th, F.xxhash64(text_col))
    kept = hashed.join(keep, F.col(th).eqNullSafe(F.col(h)) & F.col(id_col).eqNullSafe(F.col(r)), "left_semi")
    return kept.dropDuplicates([id_col, th]).select(*[F.col(c) for c in docs.columns])
