"""MinHash near-deduplication: banded candidates, odd sketches to weed them, full sets to confirm them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilog.llm.common import Tables, Words, beside, chunks, connected_components, cut, encoded, mix, place, shingles, whole_groups


@dataclass(frozen=True)
class Banding:
    """bands x rows MinHash samples make the band keys. Of two sets of similarity s a band collides with probability
    s ** rows, so at 0.75 the defaults miss (1 - 0.75 ** 5) ** 48 = 2 pairs in a million.

    The odd sketch folds MinHash samples of its own, the smallest hash in each of `bins` bins of the hash range, into
    sketch_bits bits: each sample toggles a bit. Candidates whose sketches differ in more bits than those of sets of
    their sizes do at `percent` are dropped (see most_apart): in more by `deviations` standard deviations of that number
    and `spare` bits, for sets so small that it isn't near a normal distribution. What passes is confirmed on the full sets.
    """

    bands: int = 48
    rows: int = 5
    bins: int = 2048
    sketch_bits: int = 4096
    percent: int = 75
    deviations: float = 6.0
    spare: float = 4.0

    @property
    def samples(self) -> int:
        return self.bands * self.rows


#: Members of a bucket on each side of a block of pairs that is compared in memory: a member goes to a block for each BLOCK of those that it meets.
BLOCK = 512
#: Members up to which buckets are compared many at a time, by lists of their pairs.
FEW = 32
#: Shingles up to which a block compares the sets themselves, so that it gives confirmed links and not candidates.
EXACT_SHINGLES = 512


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted; the texts are in lower case already."""
    words = Words(texts)
    return [np.unique(shingles(words.hash[a:b])) for a, b in zip(words.first[:-1], words.first[1:])]


def band_keys(flat: np.ndarray, first: np.ndarray, spec: Banding) -> np.ndarray:
    """Band keys (int64) of sets that aren't empty, given one after the other; elements may repeat."""
    low = np.empty((len(first), spec.samples), np.uint64)
    for k, (a, x) in enumerate(zip(_seeds(spec.samples, 1) | np.uint64(1), _seeds(spec.samples, 2))):
        low[:, k] = np.minimum.reduceat((flat ^ x) * a, first)
    keys = np.broadcast_to(_seeds(spec.bands, 3), (len(first), spec.bands)).copy()
    for r in range(spec.rows):
        keys = mix(keys ^ low[:, r :: spec.rows][:, : spec.bands])
    return keys.view(np.int64)


def signatures_of(hashes: list[np.ndarray], spec: Banding) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64) and odd sketches (int64 words) of sets that aren't empty."""
    return band_keys(np.concatenate(hashes), np.cumsum([0, *(len(h) for h in hashes[:-1])]), spec), odd_sketches(hashes, spec)[0]


def odd_sketches(hashes: list[np.ndarray], spec: Banding) -> tuple[np.ndarray, np.ndarray]:
    """Odd sketches (int64 words) of sets, and how many bins each fills."""
    flat = mix(np.concatenate(hashes) + np.uint64(0x9E3779B97F4A7C15))
    owner = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    low = np.full(len(hashes) * spec.bins, ~np.uint64(0))
    np.minimum.at(low, owner * spec.bins + (flat % np.uint64(spec.bins)).astype(np.int64), flat)
    at = np.flatnonzero(low != ~np.uint64(0))
    bit = (mix(low[at] ^ np.uint64(0x94D049BB133111EB)) % np.uint64(spec.sketch_bits)).astype(np.int64)
    odd = (np.bincount(at // spec.bins * spec.sketch_bits + bit, minlength=len(hashes) * spec.sketch_bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(hashes), -1), axis=1).view(np.int64), np.bincount(at // spec.bins, minlength=len(hashes))


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sign(docs: DataFrame, id_col: str, text_col: str, spec: Banding) -> DataFrame:
    """(id, text_hash, class, n, bands, sketch) per row: the class is the same for equal word sequences; n is the set's size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t.lower() for t in encoded(pdf["text"])]
            ids, hashes = pdf["id"].to_numpy(), pdf["text_hash"].to_numpy()
            for part in chunks(texts):
                sets = shingle_sets(texts[part])
                full = [s for s in sets if len(s)]
                bands, sketches = map(iter, signatures_of(full, spec) if full else ([], []))
                yield pd.DataFrame({
                    "id": ids[part], "text_hash": hashes[part], "class": [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in texts[part]], "n": [len(s) for s in sets],
                    "bands": [next(bands) if len(s) else None for s in sets], "sketch": [next(sketches) if len(s) else None for s in sets],
                })

    # ids travel as text: pandas makes integers beside a null floats
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), _text_hash(text_col).alias("text_hash"))
    signed = rows.mapInPandas(run, "id string, text_hash long, class binary, n long, bands array<long>, sketch array<long>")
    return signed.withColumn("id", F.col("id").cast("bigint"))


def _bits_apart(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def most_apart(n: Column | np.ndarray, spec: Banding, lib: ModuleType = np) -> Column | np.ndarray:
    """Bits in which the sketches of two sets, of n elements together, may differ; lib (numpy or Spark's functions) has exp and sqrt.

    At the least similarity a bin of the union has Poisson numbers of common elements and of those of either set
    alone. Mean and variance of the samples that differ follow, less what the sets' known sizes take from the
    variance. Sets of one size differ most. A sketch's odd bits are those of so many balls in sketch_bits boxes.
    """
    j, m = spec.percent / 100, spec.sketch_bits
    union = n / ((1 + j) * spec.bins)
    none, one = lib.exp(-union), lib.exp(-union * ((1 + j) / 2))
    g = (1 - none) / union
    alone, differ = 2 * (one - none), 1 - 2 * one + none - j * (1 - none)
    mean = alone + 2 * differ
    by_alone, by_common = one - 2 * j * (none - g), 2 * one - 2 * (g + j * (none - g))
    variance = spec.bins * (alone + 4 * differ - mean * mean - union * ((1 - j) * by_alone * by_alone + j * by_common * by_common))
    samples = spec.bins * mean
    left = lib.exp(-samples * (4 / m))
    # at these sizes rounding may leave less than nothing
    spread = lib.abs(left * variance) + lib.abs(m / 4 * (1 - left) - samples * left)
    return m / 2 * (1 - lib.exp(-samples * (2 / m))) + spec.deviations * lib.sqrt(spread) + spec.spare


def _near_enough(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be so similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _confirm(pairs: DataFrame, texts: DataFrame, spec: Banding) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    The partners of a meet it in SPREAD places: each has the text of a once, first (as a pair with itself), and then the texts of the partners.
    """
    kind = pairs.schema["a"].dataType.simpleString()
    dealt = pairs.withColumn("s", place("b"))
    named = lambda c: texts.select(F.col("node").alias(c), "text")
    first = dealt.select("a", "s").distinct().join(named("a"), "a").select("a", "s", F.col("a").alias("b"), "text")
    rest = beside(dealt, "b", "a", named("b")).select("a", place("b").alias("s"), "b", "text")
    met = first.union(rest).repartition("a", "s").sortWithinPartitions("a", "s", F.expr("a != b"), "b")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, one = None, np.zeros(0, np.uint64)
        for pdf in batches:
            texts = [t.lower() for t in encoded(pdf["text"])]
            good = np.zeros(len(pdf), bool)
            for part in chunks(texts):
                rows = zip(range(part.start, part.stop), pdf["a"].iloc[part], pdf["s"].iloc[part], (pdf["a"] == pdf["b"]).iloc[part], shingle_sets(texts[part]))
                for i, a, s, is_first, found in rows:
                    if is_first:
                        own, one = (a, s), found
                        continue
                    if own != (a, s) or not len(found):
                        continue
                    both = len(np.intersect1d(one, found, assume_unique=True))
                    good[i] = 100 * both >= spec.percent * (len(one) + len(found) - both)
            yield pdf.loc[good, ["a", "b"]]

    return met.mapInPandas(run, f"a {kind}, b {kind}")


def _weed(pairs: DataFrame, info: DataFrame, spec: Banding) -> DataFrame:
    """The pairs that set sizes and odd sketches leave."""
    a = info.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    b = info.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    left = beside(pairs.join(b, "b"), "a", "b", a).filter(_near_enough(F.col("na"), F.col("nb"), spec.percent))
    most = most_apart(F.col("na") + F.col("nb"), spec, F)
    return left.filter(_bits_apart("sa", "sb") <= most).select("a", "b")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Of links between places 0 to n - 1 those that join what was apart before."""
    root = list(range(n))
    kept_a, kept_b = [], []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = x, y
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        while root[q] != q:
            root[q] = root[root[q]]
            q = root[q]
        if p != q:
            root[max(p, q)] = min(p, q)
            kept_a.append(x)
            kept_b.append(y)
    return kept_a, kept_b


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, ok: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of ok (left x right) are similar enough by their full sets."""
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    size = np.array([len(s) for s in sets])
    at = np.cumsum(np.r_[0, size])
    of_right = np.concatenate([element[at[k] : at[k + 1]] for k in right])
    upto = np.cumsum(np.r_[0, size[right]])
    inside = np.zeros(int(element.max(initial=0)) + 1, np.int32)
    out = np.zeros_like(ok)
    for p in np.flatnonzero(ok.any(1)):
        own = element[at[left[p]] : at[left[p] + 1]]
        inside[own] = 1
        found = np.cumsum(np.r_[0, inside[of_right]])
        both = found[upto[1:]] - found[upto[:-1]]
        inside[own] = 0
        out[p] = ok[p] & (100 * both >= percent * (len(own) + size[right] - both))
    return out


def _across(members: DataFrame, labels: DataFrame, info: DataFrame, texts: DataFrame, spec: Banding, nearest_only: bool) -> DataFrame:
    """Pairs (a, b, sure) of one bucket and different components: links that join what is apart in a block, and candidates.

    Buckets whose members are one component already are left out. A larger bucket is dealt out to blocks of BLOCK x BLOCK
    pairs, which any tasks compare in memory: no task holds a bucket. Members of its largest component, who needn't be
    compared with each other, meet the others only: what is sent grows with the product of both numbers. Where sketches agree, pairs of sets
    of up to EXACT_SHINGLES are compared on the full sets at once, and of the links of a block only a spanning forest
    leaves it. Pairs with a larger set leave as candidates: with nearest_only, which comes first, the best of each node
    in each block; without it only they are compared, since the others have been.
    """
    placed = members.select("key", "node", "n").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("size"), F.max("n").alias("largest"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("size", "component")).alias("major"), F.sum("size").alias("m"), F.max("largest").alias("largest"), F.count("*").alias("parts"))
    mixed = mixed.filter("parts > 1").filter(F.lit(nearest_only) | (F.col("largest") > EXACT_SHINGLES))
    few = F.col("m") <= BLOCK
    minor_blocks = F.when(few, 1).otherwise(F.ceil((F.col("m") - F.col("major.size")) / BLOCK)).cast("bigint")
    major_blocks = F.when(few, 0).otherwise(F.ceil(F.col("major.size") / BLOCK)).cast("bigint")
    mixed = mixed.select("key", F.when(~few, F.col("major.component")).alias("major"), minor_blocks.alias("minor_blocks"), major_blocks.alias("major_blocks"))
    # blocks of the largest component's members are numbered after the others'
    of_major, hashed, first = F.col("component").eqNullSafe(F.col("major")), F.xxhash64("node", "key"), F.lit(0).cast("bigint")
    own = F.when(of_major, F.col("minor_blocks") + F.pmod(hashed, F.greatest("major_blocks", F.lit(1)))).otherwise(F.pmod(hashed, F.col("minor_blocks")))
    last = F.when(of_major, F.col("minor_blocks")).otherwise(F.col("minor_blocks") + F.col("major_blocks")) - 1
    to = F.transform(F.sequence(first, last), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    large = F.col("n") > EXACT_SHINGLES
    rows = beside(placed, "key", "node", mixed).join(info.drop("n"), "node").join(texts, "node")
    rows = rows.select(
        "key", "node", "component", "n", "sketch", F.when(large & F.lit(not nearest_only), F.col("bands")).alias("bands"),
        F.when(~large & F.lit(nearest_only), F.col("text")).alias("text"), own.alias("own"), F.explode(to).alias("to"),
    ).select("*", "to.i", "to.j").drop("to")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "node")

    def compare(pdf: pd.DataFrame) -> list[tuple]:
        """Pairs of one block: places of both, and whether they are sure."""
        key, i, j = (pdf[c].iloc[0] for c in ("key", "i", "j"))
        own_, comp, n = (pdf[c].to_numpy() for c in ("own", "component", "n"))
        left, right = np.flatnonzero(own_ == i), np.flatnonzero(own_ == j)
        if not len(left) or not len(right):
            return []
        sketch = np.stack(pdf["sketch"].to_numpy()).view(np.uint64)
        apart = np.zeros((len(left), len(right)), np.int32)
        for k in range(sketch.shape[1]):
            apart += np.bitwise_count(sketch[left, k][:, None] ^ sketch[right, k][None, :])
        nl, nr = n[left][:, None], n[right][None, :]
        ok = (apart <= most_apart(nl + nr, spec)) & (comp[left][:, None] != comp[right][None, :]) & (100 * np.minimum(nl, nr) >= spec.percent * np.maximum(nl, nr))
        if i == j:
            ok &= left[:, None] < right[None, :]
        exact = (nl <= EXACT_SHINGLES) & (nr <= EXACT_SHINGLES)
        found = []
        if nearest_only and (ok & exact).any():
            sets = shingle_sets([t.lower() for t in encoded(pdf["text"])])
            p, q = np.nonzero(_linked(sets, left, right, ok & exact, spec.percent))
            found += [(x, y, True) for x, y in zip(*_forest(left[p], right[q], len(pdf)))]
        ok &= ~exact
        if nearest_only:
            masked = np.where(ok, apart, 1 << 30)
            best = np.zeros_like(ok)
            best[np.arange(len(left)), masked.argmin(1)] = True
            best[masked.argmin(0), np.arange(len(right))] = True
            ok &= best
        p, q = np.nonzero(ok)
        bands = pdf["bands"].to_numpy()
        for x, y in zip(left[p].tolist(), right[q].tolist()):
            # two large sets are compared in the first band that they share, and not again in the others
            if bands[x] is None or bands[y] is None or bands[x][np.argmax(bands[x] == bands[y])] == key:
                found.append((x, y, False))
        return found

    def compare_few(pdf: pd.DataFrame, count: np.ndarray) -> list[tuple]:
        """compare() for blocks of few members each, one after the other; count is that of each row's block that follow it."""
        comp, n, bands, keys = (pdf[c].to_numpy() for c in ("component", "n", "bands", "key"))
        sketch = np.stack(pdf["sketch"].to_numpy()).view(np.uint64)
        p = np.repeat(np.arange(len(pdf)), count)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
        ok = (comp[p] != comp[q]) & (100 * np.minimum(n[p], n[q]) >= spec.percent * np.maximum(n[p], n[q]))
        p, q = p[ok], q[ok]
        apart = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(sketch[p[k : k + 4096]] ^ sketch[q[k : k + 4096]]).sum(1, dtype=np.int64) for k in range(0, len(p), 4096))])
        ok = apart <= most_apart(n[p] + n[q], spec)
        p, q, apart = p[ok], q[ok], apart[ok]
        exact = (n[p] <= EXACT_SHINGLES) & (n[q] <= EXACT_SHINGLES)
        found: list[tuple] = []
        if nearest_only and exact.any():
            rows = np.unique(np.r_[p[exact], q[exact]])
            sets = dict(zip(rows.tolist(), shingle_sets([t.lower() for t in encoded(pdf["text"].iloc[rows])])))
            for x, y in zip(p[exact].tolist(), q[exact].tolist()):
                a, b = sets[x], sets[y]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= spec.percent * (len(a) + len(b) - both):
                    found.append((x, y, True))
        p, q, apart = p[~exact], q[~exact], apart[~exact]
        if nearest_only and len(p):
            best = np.full(len(pdf), 1 << 30)
            np.minimum.at(best, p, apart)
            np.minimum.at(best, q, apart)
            ok = (apart == best[p]) | (apart == best[q])
            p, q = p[ok], q[ok]
        for x, y in zip(p.tolist(), q.tolist()):
            if bands[x] is None or bands[y] is None or bands[x][np.argmax(bands[x] == bands[y])] == keys[x]:
                found.append((x, y, False))
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in whole_groups(batches, ["key", "i", "j"]):
            key, i, j = (pdf[c].to_numpy() for c in ("key", "i", "j"))
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
            size = np.diff(np.r_[edge, len(pdf)])
            few = np.repeat((size <= FEW) & (i[edge] == j[edge]), size)
            follow = np.repeat(edge + size, size) - np.arange(len(pdf)) - 1
            node = pdf["node"].to_numpy()
            own = node[few]
            found = [(own[x], own[y], sure) for x, y, sure in compare_few(pdf[few], follow[few])] if few.any() else []
            for s, m in zip(edge, size):
                if not few[s]:
                    found += [(node[s + x], node[s + y], sure) for x, y, sure in compare(pdf.iloc[s : s + m])]
            yield pd.DataFrame([(min(a, b), max(a, b), sure) for a, b, sure in found], columns=["a", "b", "sure"]).drop_duplicates()

    kind = members.schema["node"].dataType.simpleString()
    return dealt.mapInPandas(run, f"a {kind}, b {kind}, sure boolean").distinct()


def _confirmed(found: DataFrame, texts: DataFrame, spec: Banding, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The links among pairs of _across."""
    found = keep(found)
    return found.filter("sure").select("a", "b").union(_confirm(found.filter("not sure").select("a", "b"), texts, spec))


def components_of(nodes: DataFrame, describe: Callable[[DataFrame], DataFrame], spec: Banding) -> DataFrame:
    """(node, component) of the nodes that have links.

    nodes has node, n (shingles, at most) and bands, and may repeat rows; describe gives node, n (size of the
    set), sketch and text of the nodes that are asked for, those that share a bucket. In each bucket of a band every
    node is first compared with the smallest node; nodes that this connects aren't compared again. What is in different
    components is compared in blocks, large sets first with the nearest only, then all that are still apart: so no link
    between components is lost and no pairs within a component are made.
    """
    tables = Tables(nodes.sparkSession, "candidates")
    keep = tables.keep
    buckets = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keep(buckets.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).filter("pivot < last").select("key", "pivot"))
    members = keep(buckets.join(shared, "key").select("key", "node", "n", "pivot").distinct())
    found = keep(members.select("node").distinct())
    bands = nodes.select("node", "bands").join(found, "node", "left_semi").dropDuplicates(["node"])
    facts = keep(describe(found).dropDuplicates(["node"]).join(bands, "node"))
    info, texts = facts.drop("text"), facts.select("node", "text")

    stars = members.filter("pivot < node").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = keep(_confirm(keep(_weed(stars, info, spec)), texts, spec))
    # what two hops along the links reach is in a node's component: that is enough to leave pairs out
    hop = keep(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("low")))
    near = hop.join(hop.select(F.col("node").alias("low"), F.col("low").alias("lowest")), "low", "left").select("node", F.coalesce("lowest", "low").alias("component"))
    links = keep(links.union(_confirmed(_across(members, keep(near), info, texts, spec, True), texts, spec, keep)))
    labels = keep(connected_components(links, keep))
    if not members.filter(F.col("n") > EXACT_SHINGLES).isEmpty():
        more = keep(_confirmed(_across(members, labels, info, texts, spec, False), texts, spec, keep))
        if not more.isEmpty():
            known = labels.filter("component < node").select(F.col("component").alias("a"), F.col("node").alias("b"))
            labels = connected_components(known.union(more), keep)
    labels = cut(labels)
    tables.drop()
    return labels


def _marked(docs: DataFrame, id_col: str, text_col: str, spec: Banding) -> DataFrame:
    """The rows of near_duplicates() with the hash of their texts."""
    signed = cut(sign(docs, id_col, text_col, spec))
    first = signed.filter("n > 0 and id is not null").groupBy("class").agg(F.min(F.struct("id", "text_hash")).alias("first")).select("class", "first.*")
    # a class is named by its smallest id; where several have the same, by a hash of the class
    taken = first.groupBy("id").agg(F.count("*").alias("classes")).filter("classes > 1")
    classes = cut(first.join(taken, "id", "left").withColumn("node", F.when(F.col("classes").isNull(), F.col("id")).otherwise(F.xxhash64("class"))).drop("classes"))
    nodes = signed.join(classes, ["class", "id", "text_hash"]).select("node", "n", "bands", "sketch")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), _text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def describe(found: DataFrame) -> DataFrame:
        named = classes.join(found, "node", "left_semi").select("node", "id", "text_hash")
        return nodes.drop("bands").join(found, "node", "left_semi").join(texts.join(named, ["id", "text_hash"]).select("node", "text"), "node")

    labels = components_of(nodes, describe, spec)
    of_class = cut(classes.join(labels, "node", "left").select("class", "id", "node", F.coalesce("component", "node").alias("component")))
    # only where a node isn't an id, the smallest node needn't be the smallest id
    hashed = of_class.filter("node != id").select("component").distinct()
    lowest = cut(of_class.join(hashed, "component", "left_semi").groupBy("component").agg(F.min("id").alias("low")))
    if not lowest.isEmpty():
        of_class = of_class.join(lowest, "component", "left").withColumn("component", F.coalesce("low", "component"))
    of_class = of_class.select("class", F.col("component").alias("component_id"))
    marked = signed.select("id", "text_hash", "class", "n").join(of_class, "class", "left")
    component = F.coalesce("component_id", F.col("id"))
    return marked.select("id", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Banding = Banding()) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id reachable over links), kept.

    A document's set is that of its distinct 5-word shingles, A-Z as lower case (fewer words: the whole
    sequence as one; none: the empty set, linked with nothing). Two are linked if 100 * intersection >=
    75 * union, confirmed on the full sets of 64-bit shingle hashes. Equal word sequences are one node,
    with the smallest id of them.

    Null texts are empty. Rows with a null id are linked with nothing of another word sequence, have the
    component of their word sequence, or null, and aren't kept. Rows that share an id but not the word sequence are
    nodes of their own, each with its links and its component; repeated rows repeat their result. Ids must be
    integers. An empty table
    gives an empty result; other columns of docs play no part.
    """
    return _marked(docs, id_col, text_col, spec).drop("text_hash").withColumnRenamed("id", id_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: Banding = Banding()) -> DataFrame:
    """The rows of docs without those that near_duplicates() doesn't keep; columns stay as they are, whatever their names.

    A row goes by its id and its text, so that a row which shares only the id with one that goes stays. Rows without words are
    linked with nothing and stay; so do rows without an id, which can't be named.
    """
    gone = _marked(docs, id_col, text_col, spec).filter("not kept and id is not null").select("id", "text_hash").distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("bigint").alias("id"), _text_hash(text_col).alias("text_hash"))
    return rows.join(gone, ["id", "text_hash"], "left_anti").select("row.*")
