"""MinHash near-dedup from one hash function.

A document's set of word shingles is hashed once; its smallest hashes are its
bottom-k sketch. The steps:

1. Documents with one set are one node (a digest of all its hashes).
2. Inverted lists: a node stands in the lists of the rarest of its retained
   values. A pair above the threshold shares so many retained values that the
   most frequent ones can be left out, by the same count argument as prefix
   filtering; the chance that a pair of exactly threshold similarity has too
   few in common is below 1e-7 for two large sets, and none for small sets.
3. In a list, the sketch of the union estimates the similarity. First round:
   nodes are compared with a leader of their list and the survivors are star
   edges, so a group of n copies gives about n edges. Exact Jaccard on the full
   sets confirms them, and connected components follow.
4. Second round: in lists that still hold several components, a row is marked if
   the estimate lets it through with a row of another component, in the first
   list that both stand in. The full sets of marked rows meet by list, every
   pair of different components is counted exactly there, and links leave as a
   forest: fewer than rows. After it, each pair that could link is in one
   component or was checked.

Lists longer than ``LIST`` are cut into blocks. In the first round some rows of a
list stand in all its blocks and join their leaders. In the second the rows of a
list's largest component stand in one block each and the others meet all of
them, so a list of one large group and some others costs in proportion to it.

Defined results: a text that is null or without words has the empty set, size
0, and is linked with nothing; with fewer words than a shingle the whole
sequence is the one shingle; rows repeated with one doc_id are in one component;
a null doc_id never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_bytes, documents, scratch, table

#: Values retained for the lists, for the estimate (first and last), and the number of the lists' values a pair shares at least.
INDEX, SKETCH, SHARED = 32, 64, 12
#: Rows of a list, and shingles for each of them, that meet in one task.
LIST, MEAN = 1024, 512
#: First round: about so many rows of a long list stand in all its blocks.
COMMON = 48
#: The estimate may fall short of the threshold by so many standard deviations.
SIGMAS = 6.0
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.LargeStringArray, size: int) -> list[np.ndarray]:
    """Sorted distinct 63-bit hashes of each text's shingles of ``size`` words."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.flatten()
    ends = np.asarray(lists.offsets, dtype=np.int64)
    ends = ends - ends[0]
    fine = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not fine.all():
        flat = flat.filter(pa.array(fine))
        ends = np.concatenate([[0], np.cumsum(fine)])[ends]
    coded = flat.dictionary_encode()
    words = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = words[np.asarray(coded.indices, dtype=np.int64)] if len(flat) else np.zeros(0, np.uint64)

    def hashed(n: int) -> np.ndarray:
        h = np.full(max(0, len(w) - n + 1), n, np.uint64)
        for j in range(n):
            h = _mix(h * _M1 + w[j : j + len(h)])
        return h >> np.uint64(1)

    full = hashed(size)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for j in range(a, b):
                h = _mix(h * _M1 + w[j : j + 1])
            out.append(h >> np.uint64(1))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, loc (finds the text again), _row, n, set_key (null if empty), idx (bottom INDEX), sk (bottom SKETCH, 32 bits each)."""

    def run(batches):
        for batch in batches:
            for rows, texts in by_bytes(batch, "text"):
                sets = shingle_sets(texts, size)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        rows.column(1),
                        rows.column(2),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([s[:INDEX].astype(np.int64) for s in sets], pa.list_(pa.int64())),
                        pa.array([(s[:SKETCH] >> np.uint64(31)).astype("<u4").tobytes() for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "loc", "_row", "n", "set_key", "idx", "sk"],
                )

    return located(docs).mapInArrow(run, "doc_id long, loc long, _row long, n long, set_key binary, idx array<long>, sk binary")


def located(docs: DataFrame) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    row = F.col("_row") if "_row" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", t).alias("loc"), row.alias("_row"), t.alias("text"))


def union_estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of sketches (padded with the largest value): shared values among the union's
    bottom k (k: columns of a sketch), and how many values that union sketch has."""
    pad, k = np.uint32(0xFFFFFFFF), a.shape[1]
    c = np.sort(np.concatenate([a, b], 1), 1)
    real = c != pad
    twice = (c[:, 1:] == c[:, :-1]) & real[:, 1:]
    rank = np.arange(2, c.shape[1] + 1)[None, :] - np.cumsum(twice, 1)
    size = np.minimum(k, real.sum(1) - twice.sum(1))
    return (twice & (rank <= k)).sum(1), size


def similarity(sk: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Estimates for pairs of rows; -1 where a pair can't reach the threshold."""
    out = np.full(len(a), -1.0)
    near = np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b]) - 1e-9
    for at in range(0, len(a), 20_000):
        k = np.flatnonzero(near[at : at + 20_000]) + at
        if len(k):
            shared, size = union_estimate(sk[a[k]], sk[b[k]])
            whole = n[a[k]] + n[b[k]] - shared <= size + 1  # the union's sketch is the union
            slack = np.where(whole, 2.0, SIGMAS * np.sqrt(size * least * (1 - least)))
            out[k] = np.where(shared >= least * size - slack, shared / size, -1.0)
    return out


def _centred(group: np.ndarray, sizes: np.ndarray, which: np.ndarray, sk: np.ndarray) -> np.ndarray:
    """How much of its list's common values a row has; 0 in lists of up to three."""
    score = np.zeros(len(group))
    rows = np.flatnonzero(sizes[which] > 3)
    if len(rows):
        key = (which[rows].astype(np.uint64)[:, None] << np.uint64(32)) | sk[rows].astype(np.uint64)
        key[sk[rows] == 0xFFFFFFFF] = 0
        _, back, count = np.unique(key.ravel(), return_inverse=True, return_counts=True)
        score[rows] = np.where(key > 0, count[back].reshape(key.shape), 0).sum(1)
    return score


def _by_list(of_list):
    """Arrow batches sorted by ``g`` to what ``of_list`` makes of tables of whole lists."""

    def run(batches):
        held: list = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 30_000:  # whole lists only: the last one waits for its rest
                t = pa.Table.from_batches(held).combine_chunks()
                g = t.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1], side="left"))
                if cut:
                    yield from of_list(t.slice(0, cut))
                held, size = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if size:
            yield from of_list(pa.Table.from_batches(held).combine_chunks())

    return run


def _padded(cells: list[bytes], width: int, dtype: str, pad: int) -> np.ndarray:
    out = np.full((len(cells), width), pad, dtype)
    for i, c in enumerate(cells):
        out[i, : len(c) // out.itemsize] = np.frombuffer(c, dtype)
    return out


def _bounds(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return starts, np.diff(np.r_[starts, len(group)])


def _stars(least: float):
    """Lists to star edges (a: leader, b) that the estimate lets through."""

    def stars(t):
        group, node, n = (t.column(c).to_numpy() for c in ("g", "node", "n"))
        sk = _padded(t.column("sk").to_pylist(), SKETCH, "<u4", 0xFFFFFFFF)
        starts, sizes = _bounds(group)
        which = np.repeat(np.arange(len(starts)), sizes)
        # a leader in the middle of its group links most of it
        order = np.lexsort((node, -_centred(group, sizes, which, sk), which))
        free = np.ones(len(group), bool)
        while free.any():
            rows = order[free[order]]
            first = np.r_[True, which[rows][1:] != which[rows][:-1]]
            leader = rows[first]
            free[leader] = False
            members = rows[~first]
            if not len(members):
                break
            lead_of = np.zeros(len(starts), np.int64)
            lead_of[which[leader]] = leader
            a = lead_of[which[members]]
            ok = similarity(sk, n, a, members, least) >= 0
            free[members[ok]] = False
            if ok.any():
                pairs = np.unique(np.stack([node[a[ok]], node[members[ok]]], 1), axis=0)
                yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return stars


def _marked(least: float):
    """Rows (v, node) that the estimate lets through with a row of another component, where v is the first list of both."""

    def marked(t):
        group, v, node, n, comp = (t.column(c).to_numpy() for c in ("g", "v", "node", "n", "comp"))
        sk = _padded(t.column("sk").to_pylist(), SKETCH, "<u4", 0xFFFFFFFF)
        at = _padded([np.array(x, "<i8").tobytes() for x in t.column("at").to_pylist()], INDEX, "<i8", np.iinfo(np.int64).max)
        hit = np.zeros(len(group), bool)
        for s, z in zip(*(x.tolist() for x in _bounds(group)), strict=True):
            own = comp[s : s + z]
            if (own == own[0]).all():
                continue
            for i in range(z):
                j = np.flatnonzero(own[i + 1 :] != own[i]) + i + 1 + s
                j = j[similarity(sk, n, np.full(len(j), s + i), j, least) >= 0]
                if len(j):
                    both = np.isin(at[j], at[s + i]) & (at[j] != np.iinfo(np.int64).max)
                    j = j[at[j, both.argmax(1)] == v[s]]
                    hit[j] = True
                    hit[s + i] |= len(j) > 0
        rows = np.flatnonzero(hit)
        if len(rows):
            yield pa.RecordBatch.from_pydict({"v": pa.array(v[rows]), "node": pa.array(node[rows])})

    return marked


def _counted(num: int, den: int):
    """Lists with full sets to links (a, b) with den * intersection >= num * union: a forest over the components."""

    def counted(t):
        group, node, n, comp = (t.column(c).to_numpy() for c in ("g", "node", "n", "comp"))
        sets = t.column("set")
        ea, eb = [], []
        for s, z in zip(*(x.tolist() for x in _bounds(group)), strict=True):
            own = comp[s : s + z].copy()
            if (own == own[0]).all():
                continue
            flat = np.frombuffer(b"".join(sets.slice(s, z).to_pylist()), np.uint64)
            values, ids = np.unique(flat, return_inverse=True)
            ends = np.cumsum(n[s : s + z])
            begins = ends - n[s : s + z]
            here = np.zeros(len(values), bool)
            for i in range(z - 1):
                if (own[i + 1 :] == own[i]).all():
                    continue
                here[ids[begins[i] : ends[i]]] = True
                both = np.add.reduceat(here[ids[begins[i + 1] :]], begins[i + 1 :] - begins[i + 1], dtype=np.int64)
                here[ids[begins[i] : ends[i]]] = False
                link = den * both >= num * (n[s + i] + n[s + i + 1 : s + z] - both)
                for j in (np.flatnonzero(link & (own[i + 1 :] != own[i])) + i + 1).tolist():
                    if own[j] != own[i]:
                        ea.append(node[s + i])
                        eb.append(node[s + j])
                        own[own == own[j]] = own[i]
        if ea:
            yield pa.RecordBatch.from_pydict({"a": pa.array(ea, pa.int64()), "b": pa.array(eb, pa.int64())})

    return counted


def _in_blocks(lists: DataFrame, columns: list[str]) -> DataFrame:
    """First round: rows of lists (v, node, long) by block ``g``; of a long list about COMMON rows stand in all blocks."""
    blocks = f"cast(ceil(long / {LIST}) AS int)"
    common = f"pmod(xxhash64(node, v), long) < {COMMON}"
    many = F.expr(f"CASE WHEN {blocks} = 1 THEN array(0) WHEN {common} THEN sequence(0, {blocks} - 1) ELSE array(cast(pmod(xxhash64(node), {blocks}) AS int)) END")
    cut = lists.withColumn("_block", F.explode(many)).withColumn("g", F.expr(f"CASE WHEN {blocks} = 1 THEN v ELSE xxhash64(v, _block) END"))
    return cut.select("g", *columns).repartition("g").sortWithinPartitions("g")


def _in_meetings(lists: DataFrame, columns: list[str]) -> DataFrame:
    """Second round: rows (v, node, n, comp) by meeting ``g``, so that every two rows of a list that are of different components meet."""
    weight = F.greatest(F.lit(1), F.ceil(F.col("n") / MEAN))
    long = lists.groupBy("v").agg(F.sum(weight).alias("_long")).filter(F.col("_long") > LIST)
    parts = lists.join(long, "v", "left_semi").groupBy("v", "comp").agg(F.sum(weight).alias("_w"))
    parts = parts.groupBy("v").agg(F.max(F.struct("_w", "comp")).alias("_top"), F.sum("_w").alias("_all"))
    parts = parts.select("v", F.col("_top.comp").alias("_top"), F.ceil(F.col("_top._w") / LIST).cast("int").alias("_tops"), F.ceil((F.col("_all") - F.col("_top._w")) / LIST).cast("int").alias("_others"))
    own = lambda k: f"cast(pmod(xxhash64(node), {k}) AS int)"
    among = f"transform(sequence(0, _others - 1), x -> struct(-1 - least(x, {own('_others')}) AS i, greatest(x, {own('_others')}) AS j))"
    meetings = F.expr(f"""CASE WHEN _top IS NULL THEN array(struct(0 AS i, 0 AS j))
        WHEN comp = _top THEN transform(sequence(0, _others - 1), x -> struct({own("_tops")} AS i, x AS j))
        ELSE concat(transform(sequence(0, _tops - 1), x -> struct(x AS i, {own("_others")} AS j)), CASE WHEN _others = 1 THEN cast(array() AS array<struct<i: int, j: int>>) ELSE {among} END) END""")
    cut = lists.join(parts, "v", "left").withColumn("_m", F.explode(meetings)).withColumn("g", F.expr("CASE WHEN _top IS NULL THEN v ELSE xxhash64(v, _m.i, _m.j) END"))
    return cut.select("g", *columns).repartition("g").sortWithinPartitions("g")


def full_sets(nodes: DataFrame, reps: DataFrame, docs: DataFrame, size: int, repeats: bool) -> DataFrame:
    """node, n, set: the sorted hashes of all its shingles, from its text. repeats: rows stand in ``docs`` more than once."""

    def run(batches):
        for batch in batches:
            for rows, texts in by_bytes(batch, "text"):
                sets = shingle_sets(texts, size)
                # of texts with one loc the one with this set's size counts
                fine = [i for i, (x, n) in enumerate(zip(sets, rows.column(1).to_pylist(), strict=True)) if len(x) == n]
                for s in range(0, len(fine), 1000):
                    part = fine[s : s + 1000]
                    yield pa.RecordBatch.from_pydict({"node": rows.column(0).take(pa.array(part, pa.int64())), "n": rows.column(1).take(pa.array(part, pa.int64())), "set": pa.array([sets[i].tobytes() for i in part], pa.binary())})

    where = reps.join(nodes, "node", "left_semi").select("node", "loc", "n")
    found = where.join(located(docs).select("loc", "text"), "loc").select("node", "n", "text")
    sets = found.mapInArrow(run, "node long, n long, set binary")
    return table(sets.dropDuplicates(["node"]) if repeats else sets, "sets")


def confirmed(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) whose full sets have den * intersection >= num * union, by leader ``a``, LIST edges at a time."""
    stars = edges.groupBy("a").agg(F.count(F.lit(1)).alias("k")).withColumn("blocks", F.expr(f"cast(ceil(k / {LIST}) AS int)"))
    ends = edges.join(stars, "a").select("a", F.expr("cast(pmod(xxhash64(b), blocks) AS int)").alias("block"), F.col("b").alias("node"))
    leads = stars.select("a", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.col("a").alias("node"))
    rows = leads.unionByName(ends).join(sets, "node").select(F.xxhash64("a", "block").alias("g"), "a", "node", "n", "set")

    def stars_of(t):
        group, lead, node, n = (t.column(c).to_numpy() for c in ("g", "a", "node", "n"))
        ea, eb = [], []
        for s, z in zip(*(x.tolist() for x in _bounds(group)), strict=True):
            own = t.column("set").slice(s, z).to_pylist()
            for i in range(z):
                if node[s + i] != lead[s + i]:
                    continue
                hub = np.frombuffer(own[i], np.uint64)
                mine = [j for j in range(z) if lead[s + j] == lead[s + i] and j != i]
                if not mine or not len(hub):
                    continue
                flat = np.frombuffer(b"".join(own[j] for j in mine), np.uint64)
                at = np.minimum(np.searchsorted(hub, flat), len(hub) - 1)
                size = n[[s + j for j in mine]]
                both = np.add.reduceat(hub[at] == flat, np.cumsum(size) - size, dtype=np.int64)
                ok = den * both >= num * (len(hub) + size - both)
                ea += [lead[s + i]] * int(ok.sum())
                eb += node[[s + j for j in mine]][ok].tolist()
        if ea:
            yield pa.RecordBatch.from_pydict({"a": pa.array(ea, pa.int64()), "b": pa.array(eb, pa.int64())})

    return rows.repartition("g").sortWithinPartitions("g").mapInArrow(_by_list(stars_of), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, comp: the smallest node that links reach, for nodes with links."""
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    both = table(both, "both")
    labels = table(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("comp")), "labels")
    while True:
        named = labels.select(F.col("node").alias("y"), "comp")
        around = both.join(named, "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(around, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("old"))
        up = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        step = table(step.join(up, "comp", "left").select("node", F.least("comp", F.coalesce("above", "comp")).alias("comp"), "old"), "labels")
        labels = step.select("node", "comp")
        if step.filter("comp <> old").isEmpty():
            return labels


def _grouped(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """A row per document: doc_id, _row, n, comp (null if empty), component_id."""
    sk = table(sketches(docs, size), "sketches")
    repeats = not sk.groupBy("loc").count().filter("count > 1").isEmpty()
    least = num / den
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "loc", "n", "idx", "sk")).alias("r")
    reps = sk.filter("n > 0").groupBy("set_key").agg(pick).select(F.monotonically_increasing_id().alias("node"), "set_key", "r.doc_id", "r.loc", "r.n", "r.idx", "r.sk")
    reps = table(reps, "reps")

    # the rarest retained values: those that stand in one set only come first and need no list
    values = reps.select("node", F.least(F.col("n"), F.lit(INDEX)).alias("s"), F.explode("idx").alias("v"))
    often = values.groupBy("v").agg(F.count(F.lit(1)).alias("long")).filter("long > 1")
    held = values.join(often, "v").groupBy("node", "s").agg(F.array_sort(F.collect_list(F.struct("long", "v"))).alias("vs"))
    room = F.expr(f"cast((CASE WHEN s < {INDEX} THEN s - floor(0.7 * s) + 1 ELSE {INDEX - SHARED + 1} END) - (s - size(vs)) AS int)")
    held = table(held.withColumn("room", room).filter("room > 0").select("node", F.expr("slice(vs, 1, room)").alias("vs")), "held")
    lists = held.select("node", F.explode("vs").alias("x")).select("node", "x.v", "x.long").join(reps.select("node", "n", "sk"), "node")

    tried = table(_in_blocks(lists, ["node", "n", "sk"]).mapInArrow(_by_list(_stars(least)), "a long, b long").distinct(), "edges")
    nodes = tried.select(F.col("a").alias("node")).unionByName(tried.select(F.col("b").alias("node"))).distinct()
    links = table(confirmed(tried, full_sets(nodes, reps, docs, size, repeats), num, den), "links")
    comps = components(links)

    places = held.select("node", F.expr("array_sort(transform(vs, x -> x.v))").alias("at"), "vs")
    seen = places.select("node", "at", F.explode("vs").alias("x")).select("node", "at", "x.v").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = seen.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("v")
    seen = table(seen.join(mixed, "v", "left_semi").join(reps.select("node", "n", "sk"), "node"), "seen")
    marks = _in_meetings(seen, ["v", "node", "n", "comp", "sk", "at"]).mapInArrow(_by_list(_marked(least)), "v long, node long").distinct()
    marks = table(marks.join(seen.select("v", "node", "comp"), ["v", "node"]), "marks")
    if not marks.isEmpty():
        sets = full_sets(marks.select("node").distinct(), reps, docs, size, repeats)
        met = _in_meetings(marks.join(sets, "node"), ["node", "n", "comp", "set"])
        more = table(met.mapInArrow(_by_list(_counted(num, den)), "a long, b long").distinct(), "links")
        comps = components(links.unionByName(more))

    named = reps.select("node", "set_key", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least_id = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    # one row per set: joins with all documents spread a large group of copies by Spark's skew handling
    sets = named.join(least_id, "comp").select("set_key", "comp", "component_id")
    return sk.select("doc_id", "_row", "n", "set_key").join(sets, "set_key", "left").drop("set_key")


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    with scratch(docs.sparkSession) as keep:
        out = _grouped(docs, size, num, den).select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
        out = keep(table(out, "groups"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` of which one stays of each group: that with the smallest doc_id, nulls last.

    Rows are told apart by a key of their own, so a doc_id that stands in several
    rows drops none of another text and keeps none of a group's other rows.
    """
    with scratch(docs.sparkSession) as keep:
        rows = keep(table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"))
        groups = table(_grouped(rows, size, num, den).filter("comp IS NOT NULL").select("comp", "doc_id", "_row"), "groups")
        stay = groups.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "_row")).alias("r")).select("r._row")
        out = keep(table(groups.select("_row").join(stay, "_row", "left_anti"), "dropped"))
    return rows.join(out, "_row", "left_anti").select(*docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), size=3, num=85, den=100)
