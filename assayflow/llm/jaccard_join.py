"""N-gram Jaccard join by PartEnum signatures, and the classes of near duplicates that its links make."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayflow.llm.common import small, stored
from assayflow.llm.hashing import U, mix, shingle_sets

#: Words of a shingle; two sets link when 100 * intersection >= SIMILARITY * union.
WORDS, SIMILARITY = 5, 80
#: Second-level parts of each first-level part, and how many of them a signature leaves out.
PARTS, OUT = 3, 1
SUBSETS = list(combinations(range(PARTS), PARTS - OUT))
#: Bands of set sizes: each ends at RATIO times its start. First-level parts, in multiples of the fewest that can work.
RATIO, SLACK = 1.6, 1.25
#: Elements that a subset has to hold to be signed, for the sets that have enough of those, and for the others.
HEAVY, ANY = 2, 1
#: Documents of which one is sampled for frequent signatures, how often the sample has one, and how many are kept at most.
#: A frequent signature is dealt to SPREAD tasks. All this decides where rows go, not which.
SAMPLED, FREQUENT, KNOWN, SPREAD = 16, 8, 10_000, 64
#: Ratio of the bands of sizes in which the rest meets by rare elements.
FINE = 1.05


def band_starts(largest: int = 1 << 40) -> list[int]:
    out = [1, 4]
    while out[-1] < largest:
        out.append(max(out[-1] + 1, int(out[-1] * RATIO)))
    return out


_STARTS = np.array(band_starts())
_SALTS = mix(np.arange(1, len(_STARTS) + 1, dtype=np.uint64))


def spoiled_by_part() -> np.ndarray:
    """For each choice of signed subsets of a first-level part (bit i: SUBSETS[i]): how many of them the first differing
    element can spoil at most, how many more the second, and so on, never rising."""
    out = []
    for chosen in range(1 << len(SUBSETS)):
        own = [set(s) for i, s in enumerate(SUBSETS) if chosen >> i & 1]
        upto = [max(sum(bool(s & set(hit)) for s in own) for hit in combinations(range(PARTS), n)) for n in range(OUT + 2)]
        steps, n = [], 0
        while n <= OUT:
            end = max(range(n + 1, OUT + 2), key=lambda m: ((upto[m] - upto[n]) / (m - n), m))
            steps += [-(-(upto[end] - upto[n]) // (end - n))] * (end - n)
            n = end
        out.append(steps)
    return np.array(out)


_SPOILED = spoiled_by_part()


def surely_shared(signed: np.ndarray, owner: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """For each set, how many of its signed subsets any partner shares at least.

    signed: first-level parts x subsets; owner: the set of each first-level part; differ: of each set, the
    elements at most in which a partner differs. The worst partner spends each where it spoils most.
    """
    n = len(differ)
    steps = _SPOILED[(signed << np.arange(len(SUBSETS))).sum(axis=1)]
    shared = np.bincount(owner, signed.sum(axis=1), n).astype(np.int64)
    left = differ.copy()
    for spoils in range(len(SUBSETS), 0, -1):
        here = np.minimum(left, np.bincount(owner, (steps == spoils).sum(axis=1), n).astype(np.int64))
        shared -= here * spoils
        left -= here
    return shared


def signatures(sets: list[np.ndarray]) -> list[np.ndarray]:
    """PartEnum signatures of sets of 64-bit hashes; sets that link share one at least.

    A partner differs from a set of s elements in s / 4 of either one's at most. A band of sizes has a partition
    of the domain into first-level parts, each of PARTS second-level parts; the signatures are the subsets that
    leave out OUT of a first-level part's PARTS, hashed with all that the set has in them. There are so
    many first-level parts that some one holds no more than OUT differing elements, so that a subset of it
    misses them. A set signs in its own band, and in the next one if a partner may be there.

    By its own subsets a set knows how many any partner shares. It signs its subsets of HEAVY elements or more and
    leaves out the lightest of them, in one order for all sets, as long as one shared is sure to stay. If these are too
    few to be sure of one, it signs all with an element as well, and if those are too few its elements, of
    which partners share four fifths. A partner that doesn't is safe by its own count.
    """
    n = np.array([len(s) for s in sets], np.int64)
    if not n.sum():
        return [np.empty(0, np.uint64) for _ in sets]
    band = np.searchsorted(_STARTS, n, "right") - 1
    both = (n > 0) & (n * 100 // SIMILARITY >= _STARTS[band + 1])
    who = np.repeat(np.arange(len(sets)), (n > 0).astype(int) + both)  # a row for each set and band
    band = band[who] + (np.diff(who, prepend=-1) == 0)
    size, differ, salt = n[who], n[who] * (100 - SIMILARITY) // SIMILARITY, _SALTS[band]
    largest = (_STARTS[band + 1] - 1) * (100 - SIMILARITY) // SIMILARITY
    firsts = np.maximum(1, np.ceil(SLACK * np.maximum(1, largest) / (OUT + 1)).astype(np.int64))
    begin = (np.cumsum(firsts) - firsts) * PARTS
    total = int(firsts.sum()) * PARTS
    with np.errstate(over="ignore"):
        element = np.concatenate([sets[i] for i in who])
        row = np.repeat(np.arange(len(who)), size)
        cell = begin[row] + (mix(element + salt[row]) % (firsts * PARTS).astype(np.uint64)[row]).astype(np.int64)
        content = mix(element ^ U(0x5851F42D4C957F2D))
        low, high = (np.bincount(cell, x.astype(np.float64), total).astype(np.uint64) for x in (content & U(0xFFFFFFFF), content >> U(32)))
        owner = np.repeat(np.arange(len(who)), firsts)
        place = np.arange(total, dtype=np.uint64) - np.repeat(begin.astype(np.uint64), firsts * PARTS)
        part = mix(low + (high << U(32)) + place * U(0xC2B2AE3D27D4EB4F) + np.repeat(salt, firsts * PARTS)).reshape(-1, PARTS)
        held = np.bincount(cell, minlength=total).reshape(-1, PARTS)
        held = np.stack([held[:, s].sum(axis=1) for s in map(list, SUBSETS)], axis=1)
        subset = np.stack([mix(part[:, s].sum(axis=1, dtype=np.uint64) + U(i)) for i, s in enumerate(map(list, SUBSETS))], axis=1)
        signs, of, unsure = [], [], np.ones(len(who), bool)
        for kind, least in enumerate((HEAVY, ANY)):
            signed = (held >= least) & unsure[owner][:, None]
            shared = surely_shared(signed, owner, differ)
            at = np.nonzero(signed)
            mine = owner[at[0]]
            order = np.lexsort((subset[at], held[at], mine))  # mine is ascending already
            rank = np.arange(len(mine)) - np.searchsorted(mine, mine)
            keep = order[rank >= np.maximum(0, shared - 1)[mine]]
            signs.append(mix(subset[at][keep] + U(kind)))
            of.append(mine[keep])
            unsure &= shared < 1
        by_itself = unsure[row]
        signs.append(mix(element[by_itself] + salt[row[by_itself]]))
        of.append(row[by_itself])
    of = who[np.concatenate(of)]
    order = np.argsort(of, kind="stable")
    return np.split(np.concatenate(signs)[order], np.cumsum(np.bincount(of, minlength=len(sets)))[:-1])


def shingled(docs: DataFrame, make, schema: str) -> DataFrame:
    """docs(node, text) -> the rows of schema that make(nodes, sets of shingles) gives for some documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield make(batch.column("node"), list(shingle_sets(batch.column("text").cast(pa.binary()).to_pylist(), WORDS)))

    return docs.select("node", "text").mapInArrow(run, schema)


def long_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def signed_sets(docs: DataFrame) -> DataFrame:
    """docs(node, text) -> node, size, signs."""

    def make(nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([nodes, pa.array([len(s) for s in sets], pa.int64()), long_lists(signatures(sets))], names=["node", "size", "signs"])

    return shingled(docs, make, "node long, size long, signs array<long>")


def element_sets(docs: DataFrame) -> DataFrame:
    """docs(node, text) -> node, elements."""

    def make(nodes: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([nodes, long_lists(sets)], names=["node", "elements"])

    return shingled(docs, make, "node long, elements array<long>")


def buckets(texts: DataFrame) -> DataFrame:
    """texts(node, text) -> node, size, sign, n: of each signature of several nodes its nodes, and one row without sign for each node.

    Rows of a signature that a sample of the nodes shows to be frequent are dealt to SPREAD tasks.
    """
    sample = signed_sets(texts.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0))
    often = sample.select(F.explode("signs").alias("sign")).groupBy("sign").agg(F.count(F.lit(1)).alias("often")).where(F.col("often") >= FREQUENT)
    often = stored(often.orderBy(F.desc("often"), "sign").limit(KNOWN), "jaccard-often")
    signs = signed_sets(texts).select("node", "size", F.explode(F.concat(F.array(F.lit(None).cast("long")), "signs")).alias("sign"))
    rows = signs.join(F.broadcast(often), "sign", "left").withColumn("task", F.when(F.col("often").isNotNull(), F.pmod(F.xxhash64("node"), F.lit(SPREAD))).otherwise(0).cast("int"))
    same = Window.partitionBy(F.coalesce("sign", "node"), "task")
    rows = rows.withColumns({"least": F.min("node").over(same), "most": F.max("node").over(same), "n": F.coalesce(F.col("often") * SAMPLED, F.count(F.lit(1)).over(same))})
    return rows.where(F.col("sign").isNull() | F.col("often").isNotNull() | (F.col("least") < F.col("most"))).select("node", "size", "sign", "n")


def linked(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose sets link, by the exact sizes of intersection and union."""
    left = elements.select(F.col("node").alias("a"), F.col("elements").alias("x"))
    right = elements.select(F.col("node").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").where(100 * both >= SIMILARITY * (F.size("x") + F.size("y") - both)).select("a", "b")


def star_pairs(met: DataFrame) -> DataFrame:
    """a, b: each node with the hub of each of its signatures, where their sizes allow a link.

    The hub is the node whose signatures are the most frequent ones: of near copies the one that the others were
    made from, as it lacks none of what they share.
    """
    weight = met.groupBy("node").agg(F.sum("n").alias("weight"))
    rows = met.join(weight, "node")
    hubs = stored(rows.groupBy("sign").agg(F.max(F.struct("weight", "node", "size")).alias("hub")), "jaccard-hubs")
    own = met.join(hubs, "sign").where(F.col("node") != F.col("hub.node"))
    own = own.where(100 * F.least("size", "hub.size") >= SIMILARITY * F.greatest("size", "hub.size"))
    return own.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def rest_pairs(met: DataFrame, comp: DataFrame, elements: DataFrame) -> DataFrame:
    """a, b: of the signatures whose nodes are still in several components, all pairs that can link, and few others.

    Exact, and not all pairs of a signature: sets that link have so many elements in common that, with each set's
    elements in order of frequency, the first common one stands early in both. For the smaller set that is its
    first ninth, for the larger one up to a fifth, the less the nearer their sizes. So each set is dealt by its early
    elements and the fine bands of sizes that these allow; elements of one component lead nowhere.

    Sets of one component that hold the same of what other components have differ to those in size only. If one of them links with
    a set elsewhere, the smallest does, and one link joins all of both components; so the smallest stands for all. Texts put together
    from passages that many share, each with words of its own, so meet once for each way of putting them together and not once each.
    """
    labelled = met.select("sign", "node", "size").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = labelled.groupBy("sign").agg(F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("least") < F.col("most"))
    rest = stored(labelled.join(stored(split.select("sign"), "jaccard-split"), "sign", "left_semi").select("node", "size", "component").distinct(), "jaccard-rest")
    rows = rest.join(elements, "node").select("node", "size", "component", F.explode("elements").alias("element"))
    often = rows.groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("n") > 1)
    often = stored(rows.join(stored(often, "jaccard-elements-often"), "element"), "jaccard-rest-elements")
    abroad = F.col("least") < F.col("most")  # elements that another component has too: only those can be common
    prints = [F.bit_xor(F.when(abroad, F.xxhash64("element", F.lit(k)))).alias(f"print{k}") for k in (0, 1)]
    alike = often.groupBy("component", "node", "size").agg(F.count_if(abroad).alias("abroad"), *prints).where(F.col("abroad") > 0)
    alike = stored(alike.groupBy("component", "abroad", "print0", "print1").agg(F.min(F.struct("size", "node")).alias("first")).select(F.col("first.node").alias("node")), "jaccard-alike")
    own = Window.partitionBy("node")
    # Elements of one set alone come first; they need no row.
    after = F.row_number().over(own.orderBy("n", "element")) + F.col("size") - F.count(F.lit(1)).over(own) - 1
    early = often.join(alike, "node", "left_semi").withColumn("left", F.col("size") - after).where(abroad)
    early = early.select("node", "size", "component", "element", "left")
    need = F.lit(SIMILARITY / (100 + SIMILARITY))  # of both sizes together, what the common elements are at least
    band = lambda size: F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / float(np.log(FINE))).cast("int")
    slack = 1e-6
    smaller = early.where(F.col("left") + slack >= need * 2 * F.col("size")).withColumns({"band": band(F.col("size")), "larger": F.lit(False)})
    least = F.ceil(F.col("size") * SIMILARITY / 100 - slack)
    most = F.least(F.col("size"), F.floor(F.col("left") / need - F.col("size") + slack))
    larger = early.where(least <= most).withColumns({"band": F.explode(F.sequence(band(least), band(most))), "larger": F.lit(True)})
    dealt = stored(smaller.unionByName(larger), "jaccard-dealt")
    place = dealt.groupBy("element", "band").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min("larger").alias("one"), F.max("larger").alias("two"))
    place = place.where((F.col("least") < F.col("most")) & (F.col("one") != F.col("two"))).select("element", "band")
    met_there = dealt.join(stored(place, "jaccard-places"), ["element", "band"])
    x, y = (met_there.where(F.col("larger") == is_larger).select("element", "band", F.col("node").alias(n), F.col("size").alias(f"{n}_size"), F.col("component").alias(f"{n}_in")) for is_larger, n in ((False, "x"), (True, "y")))
    found = x.join(y, ["element", "band"]).where((F.col("x_in") != F.col("y_in")) & (F.col("x_size") <= F.col("y_size")) & (100 * F.col("x_size") >= SIMILARITY * F.col("y_size")))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, component: the smallest node that the edges reach. Labels spread and then jump to their label's label."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "cc-edges")
    state = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "cc-state")
    while True:
        near = both.join(state.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        spread = state.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        spread = stored(spread, "cc-spread")
        up = spread.select(F.col("node").alias("component"), F.col("component").alias("jump"))
        jumped = spread.join(up, "component").select("node", "old", F.least("component", "jump").alias("component"))
        nxt = stored(jumped, "cc-state")
        state = nxt.select("node", "component")
        if nxt.where(F.col("component") != F.col("old")).isEmpty():
            return state


def node_of(text: Column) -> Column:
    """A text's node: 64 bits of its hash. Two different texts of N fall together with odds of N * N / 2^65 in all."""
    return F.xxhash64(text)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    Sums by a key that many rows have are stored before they are joined back, so that Spark can split the join.
    component_id is the smallest id that links reach. Equal texts are one node first. Nodes that share a
    signature are compared with the signature's hub; where a signature still has several components, those
    meet by rare elements (rest_pairs). So thousands of near copies cost a star and not all pairs, and no
    link between components is missed. Comparisons inside a component are left out, as they can add nothing. Null or
    empty texts have no shingles and are their own component. Rows without id take no part and have a null
    component. Rows that repeat an id are one document: with several texts it has the links of each.
    """
    every = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", node_of(F.col("text")))
    rows = every.where(F.col("doc_id").isNotNull())
    ids = stored(rows.select("doc_id", "node"), "jaccard-ids")
    first = stored(ids.groupBy("node").agg(F.min("doc_id").alias("first")), "jaccard-first")
    copies = stored(ids.join(first, "node").where(F.col("doc_id") != F.col("first")).select("doc_id", "node").distinct(), "jaccard-copies")
    texts = rows.join(small(copies, 1_000_000), ["doc_id", "node"], "left_anti")
    met = stored(buckets(texts), "jaccard-met")
    sizes = stored(met.where(F.col("sign").isNull()).select("node", "size").distinct(), "jaccard-sizes")
    members = stored(ids.join(sizes, "node"), "jaccard-members")
    met = met.where(F.col("sign").isNotNull())
    pairs = stored(star_pairs(met), "jaccard-stars")
    involved = small(stored(met.select("node").distinct(), "jaccard-involved"), 500_000)
    elements = stored(element_sets(texts.join(involved, "node", "left_semi")), "jaccard-elements")
    links = stored(linked(pairs, elements), "jaccard-links")
    more = linked(stored(rest_pairs(met, components(links), elements), "jaccard-last"), elements)
    several = members.where(F.col("size") > 0).groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where(F.col("a") < F.col("most"))
    same_id = members.where(F.col("size") > 0).join(several, "doc_id").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    comp = components(links.unionByName(more).unionByName(same_id))
    labelled = members.join(comp, "node", "left").select("doc_id", "size", F.coalesce("component", "node").alias("component"))
    least = stored(labelled.groupBy("component").agg(F.min("doc_id").alias("least")), "jaccard-least")
    out = labelled.join(least, "component").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
    unnamed = signed_sets(every.where(F.col("doc_id").isNull())).select(F.lit(None).cast("long").alias("doc_id"), F.col("size").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(unnamed)
