"""Near-duplicate groups: a chosen-path set similarity join, and the components of its links.

Every document is a set of word shingles. Documents of equal sets form a class, and one document of each
class, the smallest key, takes part. ``trees`` independent trees branch the classes: a node picks
``BRANCH`` minwise tokens (minimum hashes of fixed permutations), and a class follows each token's value to
a child. Two sets of similarity s meet in a given child with probability s, so a tree whose nodes are small
after one level loses a pair of similarity 0.85 with probability 0.0225 (0.031 at any depth), and three
trees with 1e-5.

A node whose classes all belong to one component is finished. Any other compares all its classes with its
smallest class first, which settles a group of copies in linear time. If it still has several components
and at most ``OUTSIDE`` classes outside the largest, these are compared with all its classes exhaustively, in
blocks; else it branches. Once ``REST`` rows are left, and after ``DEPTH`` levels whatever is, all are compared
exhaustively, by pairs of blocks. Links are confirmed on the full sets; a pair reaches that step unless its minimum hashes
differ 4.5 standard deviations more than the threshold allows.

What is left after the first grouping is usually little. Nodes, classes, sketches, texts and components are counted once
written; few are broadcast to the rows they belong to, more are joined by shuffle, with the same rows either way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.components import components
from pulsegrid.llm.scratch import Scratch, releasing
from pulsegrid.llm.textnum import column_bytes, minhash, shingle_sets, slices

#: Minimum hashes to branch by, and ranges of the sketch to compare (a byte each).
TOKENS = 16
BINS = 512
BRANCH = 2
OUTSIDE = 2048
DEPTH = 3
#: Rows of unfinished nodes, of all together, that are compared exhaustively at once.
REST = 4096
#: Keys broadcast at most (8 bytes each) when classes, sketches or texts are picked; beyond it both sides are shuffled.
BROADCAST_KEYS = 1_000_000
#: Nodes, classes with their minimum hashes, or components broadcast at most (up to 200 bytes each).
BROADCAST_ROWS = 100_000
#: Sketches (``BINS`` bytes each), and bytes of texts to confirm, broadcast at most.
BROADCAST_SKETCHES = 50_000
BROADCAST_TEXTS = 16_000_000


def _few(side: DataFrame, most: int) -> DataFrame:
    """A written table, marked for broadcast if it has at most so many rows."""
    return F.broadcast(side) if side.count() <= most else side


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """A byte (1 to 255) of the least hash in each range, 0 where there is none."""
    out = np.zeros(BINS, np.uint8)
    if len(hashes):
        at = (hashes >> np.uint64(55)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        out[at[first]] = (hashes[first] >> np.uint64(8)) % np.uint64(255) + np.uint64(1)
    return out


def _may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes na and nb with sketches a and b (rows) may be similar enough."""
    s = percent / 100
    same = ((a == b) & (b != 0)).sum(-1)
    full = np.maximum(((a != 0) | (b != 0)).sum(-1), 1)
    union = np.maximum((na + nb) / (1 + s), full)
    spread = np.sqrt(s * (1 - s) / full * (1 - full / union))
    return (same / full >= s - 4.5 * spread - 1.5 / full) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)


def _signatures(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """key, n (set size), h1 and h2 (128-bit digest of the set), tokens (minimum hashes), sig (sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for i, j in slices(offsets):
                sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                tokens = minhash(sets, TOKENS).view(np.int32)
                digest = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
                halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(tokens.ravel()), TOKENS).cast(pa.list_(pa.int32()))
                packed = pa.array([_sketch(x).tobytes() for x in sets], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), flat, packed],
                    names=["key", "n", "h1", "h2", "tokens", "sig"],
                )

    return docs.select(F.col(key).cast("long").alias("key"), text).mapInArrow(releasing(run), "key long, n long, h1 long, h2 long, tokens array<int>, sig binary")


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = np.array(batch.column(0)), np.array(batch.column(1))
            keep = np.zeros(len(a), bool)
            lefts: dict[int, np.ndarray] = {}
            data, offsets = column_bytes(batch.column(3))
            left, left_at = column_bytes(batch.column(2))
            for i, j in slices(offsets):
                rights = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                for r in range(i, j):
                    where = (int(a[r]), int(left_at[r + 1] - left_at[r]))
                    if where not in lefts:
                        if len(lefts) > 64:
                            lefts.clear()
                        raw = left[left_at[r] : left_at[r + 1]]
                        lefts[where] = shingle_sets(raw, np.array([0, len(raw)]), width)[0]
                    x, y = lefts[where], rights[r - i]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[r] = both > 0 and 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    size = texts.agg(F.sum(F.octet_length("text") + 100)).first()[0] or 0
    side = (lambda x: F.broadcast(x)) if size <= BROADCAST_TEXTS else (lambda x: x)
    rows = pairs.join(side(texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))), "b")
    rows = rows.join(side(texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))), "a")
    return rows.select("a", "b", "ta", "tb").sortWithinPartitions("a").mapInArrow(releasing(run), "a long, b long")


def _least_tokens(percent: int) -> int:
    """Equal minimum hashes, of ``TOKENS``, below which a pair is not looked at."""
    s = percent / 100
    return max(1, int(TOKENS * (s - 6 * np.sqrt(s * (1 - s) / TOKENS))))


def _sketches_of(keys: DataFrame, sigs: DataFrame) -> DataFrame:
    """(key, n, sig) of these keys, which may repeat. Counted first: up to ``BROADCAST_KEYS`` they are broadcast."""
    rows = sigs.where("n > 0 and key is not null").select("key", "n", "sig")
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys.distinct(), "key", "left_semi")


def _near_pivots(stars: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a class and its node's pivot whose minimum hashes and sizes allow a link."""
    left = reps.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = reps.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    near = stars.join(right, "b").join(left, "a")
    same = F.size(F.filter(F.zip_with("ta", "tb", lambda x, y: x == y), lambda z: z))
    return near.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (same >= _least_tokens(percent))).select("a", "b")


def _near_by_sketch(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _may_link(_bytes(batch.column(2)), _bytes(batch.column(3)), np.array(batch.column(4)), np.array(batch.column(5)), percent)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(keep))

    near = pairs.join(sketches.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb")), "b")
    near = near.join(sketches.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa")), "a")
    return near.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(releasing(run), "a long, b long")


def _bytes(col: pa.Array) -> np.ndarray:
    """A column of ``BINS`` bytes a row as a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, BINS)


def _grouped(batches: Iterator[pa.RecordBatch], matrix):
    """Columns of whole (node, grp) groups of sorted batches, the last column by ``matrix``; groups never straddle."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [*(np.array(c) for c in batch.columns[:-1]), matrix(batch.columns[-1])]
        if held is not None:
            now = [np.concatenate([x, y]) for x, y in zip(held, now, strict=True)]
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(last[-1]) + 1 if len(last) else 0
        if cut:
            yield [x[:cut] for x in now]
        held = [x[cut:] for x in now]
    if held is not None:
        yield held


def _partners(part: list[np.ndarray], fits):
    """Index pairs (i, rows) across components inside each group: a class outside its node's largest component
    against all others, or, where blocks meet in pairs, the classes of one against those of the other.
    ``fits(i, rows)`` says which rows may link with row i."""
    node, grp, key, comp, out, own, nb, few = part[:8]
    edges = np.flatnonzero((node[1:] != node[:-1]) | (grp[1:] != grp[:-1])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(node)], strict=True):
        if b - a < 2:
            continue
        crossed = not few[a] and grp[a] // nb[a] != grp[a] % nb[a]
        loose = out[a:b] if few[a] else np.ones(b - a, bool)
        place = np.arange(a, b)
        for i in (np.flatnonzero(loose) + a).tolist():
            ok = (comp[a:b] != comp[i]) & (key[a:b] != key[i]) & (~loose | (place > i))
            if crossed:
                ok &= own[a:b] != own[i]
            rows = place[ok]
            if len(rows):
                rows = rows[fits(i, rows)]
                if len(rows):
                    yield i, rows


_GROUP = ["node", "grp", "key", "comp", "out", "own", "nb", "few"]
_GROUP_DDL = "node long, grp int, key long, comp long, out boolean, own int, nb int, few boolean"


def _in_groups(small: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Rows (``_GROUP``) of small nodes' classes that have a partner as far as minimum hashes and sizes tell.

    A node's largest component is cut into blocks of about ``OUTSIDE`` classes and each block meets the
    classes outside it; where those are too many, all classes are cut and blocks meet in pairs. So a group
    has at most a few times ``OUTSIDE`` classes, and each gives at most its own rows.
    """
    blocks = lambda n: F.ceil(n / OUTSIDE).cast("int")
    few = F.col("outside") <= OUTSIDE
    nb = F.greatest(F.when(few, blocks(F.col("total") - F.col("outside"))).otherwise(blocks(F.col("total"))), F.lit(1))
    own = F.pmod(F.xxhash64("key", F.lit(3)), F.col("nb")).cast("int")
    everywhere = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: i)
    with_all = F.transform(everywhere, lambda j: F.least(F.col("own"), j) * F.col("nb") + F.greatest(F.col("own"), j))
    groups = F.when(~few, with_all).when(F.col("comp") != F.col("top"), everywhere).otherwise(F.array("own"))
    dealt = small.withColumn("nb", nb).withColumn("own", own).withColumn("few", few)
    dealt = dealt.select("node", "key", "comp", (F.col("comp") != F.col("top")).alias("out"), "own", "nb", "few", F.explode(groups).alias("grp"))
    dealt = dealt.join(reps.select("key", "n", "tokens"), "key").select(*_GROUP, "n", "tokens")
    least = _least_tokens(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches, lambda c: np.array(c.flatten()).reshape(-1, TOKENS)):
            n, tokens, live = part[8], part[9], np.zeros(len(part[0]), bool)

            def fits(i: int, rows: np.ndarray, n=n, tokens=tokens) -> np.ndarray:
                return (np.minimum(n[rows], n[i]) * 100 >= np.maximum(n[rows], n[i]) * percent) & ((tokens[rows] == tokens[i]).sum(1) >= least)

            for i, rows in _partners(part, fits):
                live[i] = True
                live[rows] = True
            yield pa.RecordBatch.from_arrays([pa.array(x[live]) for x in part[:8]], names=_GROUP)

    return dealt.repartition("node", "grp").sortWithinPartitions("node", "grp").mapInArrow(releasing(run), _GROUP_DDL)


def _near_inside(groups: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) inside groups whose sketches allow a link."""
    dealt = groups.join(sketches, "key").select(*_GROUP, "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _grouped(batches, _bytes):
            key, n, sig, found = part[2], part[8], part[9], [np.zeros((0, 2), np.int64)]
            for i, rows in _partners(part, lambda i, rows, n=n, sig=sig: _may_link(sig[rows], sig[i], n[rows], n[i], percent)):
                found.append(np.stack([np.minimum(key[rows], key[i]), np.maximum(key[rows], key[i])], 1))
            both = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return dealt.repartition("node", "grp").sortWithinPartitions("node", "grp").mapInArrow(releasing(run), "a long, b long")


def _near(stars: DataFrame | None, small: DataFrame, reps: DataFrame, sigs: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Candidate pairs (a, b) of this level, which may repeat."""
    groups = scratch.put(_in_groups(small, reps, percent), "groups")
    keys = groups.select("key")
    if stars is not None:
        pairs = scratch.put(_near_pivots(stars, reps, percent), "star_pairs")
        keys = keys.union(pairs.select("a")).union(pairs.select("b"))
    sketches = _few(scratch.put(_sketches_of(keys, sigs), "sketches"), BROADCAST_SKETCHES)
    inside = _near_inside(groups, sketches, percent)
    return inside if stars is None else _near_by_sketch(pairs, sketches, percent).union(inside)


def _links(docs: DataFrame, key: str, text: str, near: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame | None:
    """Confirmed links among candidate pairs, or None."""
    near = scratch.put(near.distinct(), "near")
    n = 2 * near.count()
    if not n:
        return None
    keys = near.select(F.col("a").alias("key")).union(near.select(F.col("b").alias("key")))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    picked = rows.join(F.broadcast(keys) if n <= BROADCAST_KEYS else keys.distinct(), "key", "left_semi")
    texts = scratch.put(picked, "texts")
    links = scratch.put(_confirmed(near, texts, width, percent), "links")
    return None if links.isEmpty() else links


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, trees: int = 3) -> DataFrame:
    """Component of each document under links of at least ``percent`` % Jaccard similarity of shingle sets.

    A null or empty text has no shingles and is linked with nothing; texts of fewer than ``width`` words
    have one shingle. Rows of equal text are one class. Rows that repeat a key share its component. A null
    key is linked with nothing, has a null component and is kept. Extra columns are not read. An empty
    table gives an empty result. Returns key (long), n_shingles, component_id, kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    sigs = scratch.put(_signatures(docs, key, text, width), "sigs")
    live = sigs.where("n > 0 and key is not null")
    classes = live.groupBy("h1", "h2").agg(F.min(F.struct("key", "n", "tokens")).alias("rep"))
    classes = scratch.put(classes.select("h1", "h2", "rep.*"), "classes")
    reps = classes.select("key", "n", "tokens")

    roots = F.array(*[F.xxhash64(F.lit(t), F.lit(j), F.get("tokens", F.lit(t * BRANCH + j))) for t in range(trees) for j in range(BRANCH)])
    frontier = scratch.put(reps.select("key", F.explode(roots).alias("node")).select("node", "key", F.col("key").alias("comp"), F.lit(False).alias("starred")).distinct(), "frontier")
    edges: DataFrame | None = None
    comps: DataFrame | None = None
    stale = False
    for level in range(2 * DEPTH + 2):
        if level:
            inner = frontier.groupBy("node", "comp").agg(F.count("*").alias("c"), F.min("key").alias("least"), F.max("starred").alias("starred"))
            stats = inner.groupBy("node").agg(F.sum("c").alias("total"), F.max(F.struct("c", "comp")).alias("major"), F.min(F.struct("least", "comp")).alias("pivot"), F.max("starred").alias("was"))
            stats = stats.select("node", "was", "total", (F.col("total") - F.col("major.c")).alias("outside"), F.col("major.comp").alias("top"), F.col("pivot.least").alias("pivot"), F.col("pivot.comp").alias("pivot_comp"))
        else:  # each class is a component
            stats = frontier.groupBy("node").agg(F.lit(False).alias("was"), F.count("*").alias("total"), F.max("key").alias("top"), F.min("key").alias("pivot"))
            stats = stats.select("node", "was", "total", (F.col("total") - 1).alias("outside"), "top", "pivot", F.col("pivot").alias("pivot_comp"))
        small = (F.col("total") <= 3) | (F.col("was") & (F.col("outside") <= OUTSIDE))
        stats = scratch.put(stats.where("outside > 0").withColumn("small", small), "stats")
        nodes, left = stats.agg(F.count("*"), F.sum("total")).first()
        if not left:
            break
        last = left <= REST or level == 2 * DEPTH + 1
        if last:
            stats = stats.withColumn("small", F.lit(True))
        open_ = scratch.put(frontier.drop("starred").join(F.broadcast(stats) if nodes <= BROADCAST_ROWS else stats, "node"), "open")
        mine = reps
        if left <= BROADCAST_KEYS:
            mine = _few(scratch.put(reps.join(F.broadcast(open_.select("key")), "key", "left_semi"), "mine"), BROADCAST_ROWS)
        star = F.expr("not small and not was and comp != pivot_comp and key != pivot")
        n_large, n_stars = open_.agg(F.count_if(~F.col("small")), F.count_if(star)).first()
        stars = open_.where(star).select(F.least("key", "pivot").alias("a"), F.greatest("key", "pivot").alias("b"))
        stars = stars if left <= BROADCAST_ROWS else stars.distinct()
        near = _near(stars if n_stars else None, open_.where("small"), mine, sigs, percent, scratch)
        found = _links(docs, key, text, near, width, percent, scratch)
        if found is not None:
            stale = True
            edges = found if edges is None else scratch.put(edges.union(found), "all_links")
        if last or not n_large:
            break
        if found is not None:
            comps, stale = components(edges, scratch), False
        stay = open_.where("not small and not was").select("node", "key", "comp", F.lit(True).alias("starred"))
        onward = open_.where("not small and was").select("node", "key", "comp")
        token = lambda j: F.get("tokens", F.pmod(F.xxhash64("node", F.lit(j)), F.lit(TOKENS)).cast("int"))
        children = onward.join(mine.select("key", "tokens"), "key").select("key", "comp", F.explode(F.array(*[F.xxhash64("node", F.lit(j), token(j)) for j in range(BRANCH)])).alias("node"))
        following = stay.union(children.select("node", "key", "comp", F.lit(False).alias("starred")).distinct())
        if comps is not None:
            renamed = _few(comps, BROADCAST_ROWS).select(F.col("v").alias("key"), F.col("comp").alias("now"))
            following = following.join(renamed, "key", "left").select("node", "key", F.coalesce("now", "comp").alias("comp"), "starred")
        frontier = scratch.put(following, "frontier")
    rep = classes.select("h1", "h2", F.col("key").alias("rep"))
    out = sigs.select("key", "n", "h1", "h2").join(rep, ["h1", "h2"], "left").select("key", "n", F.when(F.expr("n > 0 and key is not null"), F.col("rep")).alias("rep"))
    if edges is not None:
        comps = components(edges, scratch) if stale else comps
        out = out.join(_few(comps, BROADCAST_ROWS).select(F.col("v").alias("rep"), "comp"), "rep", "left")
    else:
        out = out.withColumn("comp", F.lit(None).cast("long"))
    component = F.coalesce("comp", "rep", "key")
    out = out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))
    result = scratch.put(out, "result")
    scratch.close("result")
    return result
