"""Near duplicates by BagMinHash signatures, banding and exact verification of multiset overlap.

A document is the multiset of its runs of five words. BagMinHash (Ertl, 2018) draws, for every shingle, Poisson points on
the line of its weight: one process for each dyadic stretch (0, 1], (1, 2], (2, 4], ... of the discretised weight, whose
points are thinned down the halves of the stretch to the weight itself. Every point falls on one of m components; the
earliest point of a component is its value. Two documents agree in a component with the probability of their weighted
Jaccard similarity. Only points before a time at which all components are filled are ever drawn.
"""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.blocks import arrow_rows, chunks
from skein.llm.bpe_count import Memo
from skein.llm.common import WORD, bound_batches, materialize, text_key
from skein.llm.components import components

FIND = re.compile(WORD).findall
SHINGLE = 5
ROWS, BANDS = 4, 24
M = ROWS * BANDS
U = np.uint64
#: 64-bit numbers of words; bounded, and only a cache.
WORDS = Memo(lambda w: int.from_bytes(blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"), 300_000)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Document numbers and hashes of all shingles; a text of one to four words is one shingle, one without words none."""
    each = [np.fromiter(map(WORDS.__getitem__, ws), U, len(ws)) for ws in map(FIND, texts)]
    sizes = np.array([len(x) for x in each], dtype=np.int64)
    flat = np.concatenate(each) if each else np.zeros(0, U)
    runs = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, np.minimum(sizes, 1))
    doc = np.repeat(np.arange(len(texts)), runs)
    at = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
    out = np.zeros(len(at), U)
    short = sizes[doc] < SHINGLE
    for k in range(SHINGLE):
        inside = ~short | (k < sizes[doc])
        out = np.where(inside, mix(out * U(0x9E3779B97F4A7C15) + flat[np.minimum(at + k, max(0, len(flat) - 1))] + U(1)), out)
    return doc, out


def bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document numbers, distinct shingle hashes and their multiplicities."""
    doc, h = shingles(texts)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    first = np.flatnonzero(new)
    return doc[first], h[first], np.diff(np.append(first, len(h)))


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """n x m arrival times; rows of documents without shingles are infinite."""
    out = np.full((n, m), np.inf)
    total = np.bincount(doc, weight, n)
    horizon = np.divide(m * (np.log(m) + 3), total, out=np.zeros(n), where=total > 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        mine = np.zeros(n, dtype=bool)
        mine[todo] = True
        mine = mine[doc]
        d0, h0, w0 = doc[mine], h[mine], weight[mine]
        flat = out.ravel()
        # Stretch 0 is (0, 1], stretch j is (2**(j - 1), 2**j].
        top = np.ceil(np.log2(w0)).astype(np.int64)
        for j in range(int(top.max()) + 1):
            has = top >= j
            d, key, w = d0[has], mix(h0[has] + U((j * 0xD1342543DE82EF95) & 0xFFFFFFFFFFFFFFFF)), w0[has]
            low, width = (0, 1) if j == 0 else (2 ** (j - 1), 2 ** (j - 1))
            t, i = np.zeros(len(d)), 0
            while len(d):
                i += 1
                r = mix(key + U((i * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
                t = t - np.log1p(-((r >> U(11)).astype(np.float64) * 2.0**-53)) / width
                live = t <= horizon[d]
                d, key, w, t, r = d[live], key[live], w[live], t[live], r[live]
                spot = mix(r)
                # The halves that the point goes down to are the leading bits of its place in the stretch.
                place = ((spot & U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * width).astype(np.int64)
                good = low + place + 1 <= w
                slot = ((spot >> U(32)) * U(m) >> U(32)).astype(np.int64)
                np.minimum.at(flat, (d * m + slot)[good], t[good])
        todo = todo[np.isinf(out[todo]).any(axis=1)]
        horizon[todo] *= 2
    return out


def band_keys(texts: list[str]) -> list[np.ndarray | None]:
    """A 64-bit key for every band of every text; None for texts without words."""
    doc, h, weight = bags(texts)
    sig = signatures(doc, h, weight, len(texts)).view(U).reshape(len(texts), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U), (len(texts), BANDS))
    for r in range(ROWS):
        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, :, r])
    full = np.bincount(doc, minlength=len(texts)) > 0
    return [k if f else None for k, f in zip(key.view(np.int64), full, strict=True)]


def elements(texts: list[str]) -> list[np.ndarray]:
    """The multisets of the texts' shingles as sorted sets: one number for each shingle and repetition."""
    doc, h, weight = bags(texts)
    copy = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    owner = np.repeat(doc, weight)
    each = mix(np.repeat(h, weight) + mix(copy.astype(U)) * (copy > 0))
    each = each[np.lexsort((each, owner))]
    return np.split(each, np.cumsum(np.bincount(owner, minlength=len(texts)))[:-1])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two element sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common) if len(both) else 0.0


#: Documents of a block; two blocks and their sets are what a task holds.
BLOCK = 256
#: Agreeing components, of 96, from which a pair is compared exactly; a pair at 0.8 falls below with probability 3.0e-6.
AGREE = 58


def _bands_udf():
    @F.pandas_udf(T.ArrayType(T.LongType()))
    def bands(texts: pd.Series) -> pd.Series:
        texts = list(texts)
        return pd.Series([k for lo in range(0, len(texts), 250) for k in band_keys(texts[lo : lo + 250])], dtype=object)

    return bands


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of equal components of all rows of a with all rows of b."""
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for i in range(a.shape[1]):
        out += a[:, i, None] == b[None, :, i]
    return out


def link_labels(nodes: np.ndarray, pairs: np.ndarray, sets: list[np.ndarray], threshold: float) -> dict[int, int]:
    """Root of each position that verified pairs connect, by union and find; a pair already connected is not compared."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        if x != y and similarity(sets[i], sets[j]) >= threshold:
            x, y = (x, y) if nodes[x] <= nodes[y] else (y, x)
            root[y] = x
    return {x: r for x in list(root) if (r := find(x)) != x}


class _Block:
    """Documents of one block: nodes, clusters, signatures, element sets; packed for the comparison with other blocks."""

    def __init__(self, frame: pd.DataFrame):
        texts = list(frame["text"])
        self.nodes, self.clusters = frame["node"].to_numpy(np.int64), frame["cluster"].to_numpy(np.int64)
        doc, h, weight = bags(texts)
        self.sig = (mix(signatures(doc, h, weight, len(texts)).view(U)) >> U(32)).astype(np.uint32)
        self.sets = elements(texts)

    def links(self, threshold: float) -> tuple[pd.DataFrame, np.ndarray]:
        """Links of the block's own pairs, and for every position the root of what they connect."""
        close = np.triu((agreeing(self.sig, self.sig) >= AGREE) & (self.clusters[:, None] == self.clusters[None, :]), 1)
        found, roots = link_labels(self.nodes, np.argwhere(close), self.sets, threshold), np.arange(len(self.nodes))
        roots[list(found)] = list(found.values())
        return pd.DataFrame({"a": self.nodes[list(found)], "b": self.nodes[list(found.values())]}), roots

    def packed(self, at: np.ndarray) -> dict:
        """Documents of the block, by position, as bytes."""
        sizes = np.array([len(self.sets[i]) for i in at], dtype=np.int64)
        return {"nodes": self.nodes[at].tobytes(), "sig": self.sig[at].tobytes(), "sizes": sizes.tobytes(), "sets": b"".join(self.sets[i].tobytes() for i in at)}


class _Part:
    """Documents: nodes, signatures and element sets."""

    def __init__(self, nodes: np.ndarray, sig: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.sig, self.sets = nodes, sig, sets

    @classmethod
    def read(cls, nodes: bytes, sig: bytes, sizes: bytes, sets: bytes) -> "_Part":
        """What packed() has written."""
        ends = np.cumsum(np.frombuffer(sizes, np.int64))
        return cls(np.frombuffer(nodes, np.int64), np.frombuffer(sig, np.uint32).reshape(-1, M), np.split(np.frombuffer(sets, U), ends[:-1]))

    def links_to(self, other: "_Part", threshold: float) -> tuple[np.ndarray, pd.DataFrame]:
        """One's own documents that verified pairs connect with some of other's, by position, and a forest of the links."""
        close = np.argwhere(agreeing(self.sig, other.sig) >= AGREE) + [0, len(self.nodes)]
        nodes = np.concatenate([self.nodes, other.nodes])
        found = link_labels(nodes, close, self.sets + other.sets, threshold)
        at = np.array([*found, *found.values()], dtype=np.int64)
        return at[at < len(self.nodes)], pd.DataFrame({"a": nodes[list(found)], "b": nodes[list(found.values())]})


#: Documents of a cluster's first part that every other part is compared with first.
LEADERS = 16
#: Parts that meet one copy of their cluster's leaders.
TOGETHER = 64
PACKED = "nodes binary, sig binary, sizes binary, sets binary"
HELD = ("nodes", "sig", "sizes", "sets")
LEAD = tuple(f"lead_{c}" for c in HELD)


def _blocks_of(frames, size: int):
    """Frames of at most size rows, cut between clusters where that is possible; rows come sorted by cluster."""
    for frame in chunks(frames, 4 * size):
        starts = np.flatnonzero(np.diff(frame["cluster"].to_numpy(), prepend=-1, append=-1) != 0)
        lo = 0
        while lo < len(frame):
            fitting = starts[(starts > lo) & (starts <= lo + size)]
            hi = int(fitting[-1]) if len(fitting) else min(lo + size, len(frame))
            yield frame.iloc[lo:hi]
            lo = hi


def _largest(roots: np.ndarray) -> np.ndarray:
    """Positions of the most frequent root, the least of several."""
    values, counts = np.unique(roots, return_counts=True)
    return np.flatnonzero(roots == values[np.argmax(counts)])


def links_in_clusters(texts: DataFrame, threshold: float, size: int, together: int) -> DataFrame:
    """a, b: links of similarity >= threshold that connect what the pairs of a cluster connect; texts (node, cluster,
    size, text). A block returns a forest of its links, one row per document at most.

    Documents sorted by cluster are cut into blocks of `size`. A block compares its own pairs; the part of a cluster that reaches
    beyond it is written. Every part is then compared with some leaders, documents of the cluster's first part that are
    connected among themselves (up to `together` parts meet one copy of them); what links connect with a leader, in its part, is settled. Two settled documents need no
    comparison, so only the rest moves: it meets all parts of its cluster. A group of near copies leaves next to no rest,
    so what it moves grows with its size and not with the square.
    """
    spark = texts.sparkSession

    def inside(frames):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        for at, frame in enumerate(_blocks_of(frames, size)):
            block = _Block(frame)
            links, roots = block.links(threshold)
            yield links.assign(**dict.fromkeys(("cluster", "seq", "least", "places", "roots", "lead", *HELD, *LEAD)))
            whole = frame.groupby("cluster")["size"].agg(["first", "count"])
            for cluster in whole.index[whole["first"] > whole["count"]]:
                own = np.flatnonzero(block.clusters == cluster)
                kept, places = block.packed(own), 1 + int(whole["first"][cluster]) // (size * together)
                lead = _largest(roots[own])[:LEADERS]
                named = {"a": None, "b": None, "cluster": int(cluster), "seq": base + at, "least": int(block.nodes[own].min()), "places": places, "roots": roots[own].tobytes(), "lead": int(lead[0])}
                yield pd.DataFrame([named | kept | {f"lead_{k}": v for k, v in block.packed(own[lead]).items()}])

    ordered = texts.repartitionByRange("cluster", "node").sortWithinPartitions("cluster", "node").select("node", "cluster", "size", "text")
    out = materialize(ordered.mapInPandas(inside, f"a long, b long, cluster long, seq long, least long, places int, roots binary, lead int, {PACKED}, {', '.join(f'{c} binary' for c in LEAD)}"))
    written = out.where("seq is not null").drop("a", "b").withColumn("place", F.pmod(F.xxhash64("seq"), F.col("places")).cast("int"))
    # A cluster's leaders come from its part of least node; copies of them lie in as many places as its size asks for.
    parts = written.drop(*LEAD)
    firsts = written.groupBy("cluster").agg(F.min_by("seq", "least").alias("seq"))
    leaders = written.join(firsts, ["cluster", "seq"], "left_semi").select("cluster", F.col("seq").alias("of"), F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), *LEAD)

    def settle(frames):
        for frame in frames:
            for r in frame.itertuples():
                part, roots = _Part.read(r.nodes, r.sig, r.sizes, r.sets), np.frombuffer(r.roots, np.int64)
                if r.of == r.seq:
                    # The leaders' own component is settled in their part.
                    rest = np.flatnonzero(roots != roots[r.lead])
                else:
                    at, links = part.links_to(_Part.read(r.lead_nodes, r.lead_sig, r.lead_sizes, r.lead_sets), threshold)
                    rest = np.flatnonzero(~np.isin(roots, roots[at]))
                    yield links.assign(cluster=None, node=None, sig=None, held=None)
                yield pd.DataFrame({"a": None, "b": None, "cluster": r.cluster, "node": part.nodes[rest], "sig": [part.sig[i].tobytes() for i in rest], "held": [part.sets[i].tobytes() for i in rest]})

    with arrow_rows(spark, 8):
        settled = materialize(parts.join(leaders, ["cluster", "place"]).mapInPandas(settle, "a long, b long, cluster long, node long, sig binary, held binary"))
    rest = settled.where("node is not null")

    # The rest is dealt into blocks by number, whatever partitions it lies in, and each block goes to all places of its
    # cluster, a part to one of them; there are as many places as let one have some `together` pairs of block and part.
    names = parts.groupBy("cluster").agg(F.count("*").alias("many"))
    number = rest.groupBy("cluster").agg(F.ceil(F.count("*") / size).cast("int").alias("of")).join(names, "cluster")
    number = number.select("cluster", "of", F.least("many", 1 + F.floor(F.col("many") * F.col("of") / together)).cast("int").alias("spots"))
    dealt = rest.join(number, "cluster").withColumn("no", F.pmod(F.xxhash64("node"), F.col("of")))
    blocks = materialize(dealt.groupBy("cluster", "no", "spots").agg(F.collect_list(F.struct("node", "sig", "held")).alias("docs")))
    wide = blocks.select("cluster", "docs", F.explode(F.sequence(F.lit(0), F.col("spots") - 1)).alias("spot"))
    placed = parts.select("cluster", "seq").join(number, "cluster").select("cluster", "seq", F.pmod(F.xxhash64("seq"), F.col("spots")).cast("int").alias("spot"))
    pairs = parts.select("cluster", "seq", *HELD).join(placed, ["cluster", "seq"]).join(wide, ["cluster", "spot"]).select("docs", *HELD)

    def across(frames):
        for frame in frames:
            for r in frame.itertuples():
                nodes, sig = np.array([x["node"] for x in r.docs], dtype=np.int64), np.frombuffer(b"".join(x["sig"] for x in r.docs), np.uint32)
                own = _Part(nodes, sig.reshape(-1, M), [np.frombuffer(x["held"], U) for x in r.docs])
                links = own.links_to(_Part.read(r.nodes, r.sig, r.sizes, r.sets), threshold)[1]
                # A document of the rest is in its own part as well.
                yield links[links["a"] != links["b"]]

    with arrow_rows(spark, 8):
        more = materialize(pairs.mapInPandas(across, "a long, b long"))
    return out.where("a is not null").select("a", "b").unionByName(settled.where("a is not null").select("a", "b")).unionByName(more)


#: Nodes without an id of their own are numbered from here on by a hash of their text; ids lie below.
UNNAMED = 1 << 62


def near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """doc_id, class_id, n_copies, kept of every row: classes are what links of similarity >= threshold connect.

    Equal texts are one node, named by its least id. Nodes that share a band bucket, directly or through others, form a
    cluster; inside clusters every pair whose signatures agree in AGREE components is compared exactly, unless verified
    links connect it already. A pair at the threshold shares none of the 24 buckets with probability 3e-6. class_id is the
    least id of the class, n_copies the rows of the same text; kept holds for the class's first text under its least id.

    Texts without words (empty, null) have no shingle and are classes of their own, row by row, and kept. Rows of one id
    with different texts are nodes of their own: the text of least md5 has the id as its name, the others, and texts whose
    ids are all null, are named by a hash from UNNAMED on, which is the class_id of a class without an id of its
    own. with_key adds the text's key. Other columns are ignored.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(F.col(text_col)).alias("key"))
    hashed = materialize(base.select("doc_id", "key", _bands_udf()("text").alias("bands")))
    empty, full = hashed.where("bands is null"), hashed.where("bands is not null")
    number = F.lit(UNNAMED) + F.xxhash64("key").bitwiseAND(F.lit(UNNAMED - 1))
    nodes = materialize(full.groupBy("key").agg(F.min("doc_id").alias("own"), F.count("*").alias("n_copies"), F.first("bands").alias("bands")))
    shared = materialize(nodes.where("own is not null").groupBy(F.col("own").alias("id")).agg(F.min("key").alias("of"), F.count("*").alias("texts")).where("texts > 1").drop("texts"))
    one_each = shared.isEmpty()
    if one_each:
        nodes = nodes.withColumn("node", F.coalesce("own", number))
    else:
        of = nodes.join(shared, F.col("own") == F.col("id"), "left")
        nodes = materialize(of.withColumn("node", F.when(F.coalesce(F.col("of") == F.col("key"), F.lit(True)), F.coalesce("own", number)).otherwise(number)).drop("id", "of"))
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = rows.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("y")).where("b <> y").drop("y")
    clusters = components(rows.join(leaders, "bucket").select(F.col("node").alias("a"), "b"))
    sizes = clusters.groupBy("label").agg(F.count("*").alias("size"))
    wanted = clusters.join(sizes, "label").select("node", F.col("label").alias("cluster"), "size").join(nodes.select("node", "key"), "node")
    # A node's text comes from one of the rows that bear its name, so that copies of a hot text do not meet. Nodes without
    # a name of their own have null ids, or ids that several texts share; only such rows are searched for theirs.
    columns = ["node", "cluster", "size", "text"]
    own = base.select(F.col("doc_id").alias("node"), "key", "text").join(wanted.where(F.col("node") < UNNAMED), ["node", "key"]).select(*columns)
    unnamed = wanted.where(F.col("node") >= UNNAMED)
    once = lambda df: df.groupBy("key").agg(F.any_value("text").alias("text")).join(unnamed, "key").select(*columns)
    own = own.unionByName(once(base.where("doc_id is null")))
    if not one_each:
        own = own.unionByName(once(base.join(shared, F.col("doc_id") == F.col("id"), "left_semi")))
    links = links_in_clusters(own.dropDuplicates(["node"]), threshold, BLOCK, TOGETHER)
    labels = components(links)

    named = nodes.join(labels, "node", "left").select("key", "node", "own", "n_copies", F.coalesce("label", "node").alias("class_id"))
    kept = (F.col("node") == F.col("class_id")) & F.col("doc_id").eqNullSafe(F.col("own"))
    columns = ["doc_id", "class_id", "n_copies", "kept"] + ["key"] * with_key
    out = full.select("doc_id", "key").join(named, "key").withColumn("kept", kept).select(*columns)
    alone = empty.select("doc_id", "key", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(True).alias("kept")).select(*columns)
    return out.unionByName(alone)


#: near_duplicates() over documents in DuckDB, exactly: every pair that shares a shingle is compared.
ORACLE = """
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws, md5(coalesce(text, '')) as k from documents),
t as (select min(doc_id) as node, k, count(*) as n_copies, any_value(ws) as ws from w where len(ws) > 0 group by k),
g as (select node, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(list_slice(ws, i::bigint, i::bigint + 4), ' ') end as s
  from (select node, ws, unnest(range(1, greatest(2, len(ws) - 3))) as i from t)),
c as (select node, s, count(*) as n from g group by node, s),
z as (select node, sum(n) as n from c group by node),
o as (select a.node as a, b.node as b, sum(least(a.n, b.n)) as n from c a join c b on a.s = b.s and a.node < b.node group by a.node, b.node),
e as (select a, b from o join z x on x.node = a join z y on y.node = b where o.n >= 0.8 * (x.n + y.n - o.n)),
l as (select a, b from e union all select b, a from e),
r as (select node, node as other from t union select r.node, l.b from r join l on r.other = l.a),
m as (select node, min(other) as class_id from r group by node)
select w.doc_id, m.class_id, t.n_copies, w.doc_id = m.class_id as kept from w join t on w.k = t.k join m on m.node = t.node
union all select doc_id, doc_id, 1, true from w where len(ws) = 0
"""
