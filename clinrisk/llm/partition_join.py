"""Jaccard join of shingle sets: a pigeonhole over parts of the token universe.

Two sets of r <= s shingles with 100 * intersection >= percent * union differ in at most H = (r + s)(100 - percent) / (100 + percent)
tokens. A hash deals all tokens into m segments; what each set has in a segment is one of m subsets. If segment i is asked to
agree up to v_i deletions (0: equal; 1: equal, or equal after one token is taken from either; -1: not asked), then a pair that
fails everywhere differs in at least the sum of v_i + 1 tokens. So sum(v_i + 1) = H + 1 finds every pair.

* Sizes are cut into bands such that partners are in one band or in neighbouring ones. A band's scheme has as many segments as
  its largest pair needs. A set is indexed in the scheme of its own band, and asks there for smaller or equal sets and in the
  scheme of the band below.
* Index: all m subsets, and the one-deletion neighbourhoods of the first segments, the reserve.
* Allocation, by cost: what a set needs less than its scheme has is spent on not asking its dearest segments. Dear are empty
  subsets, which many sets share, and subsets of nothing but frequent tokens. For every dear segment that is left, a
  segment of the reserve that holds rare tokens is asked with one deletion in its place. Costs steer work only; what is found is
  the same whatever they are.
* Keys that meet are buckets. Members are compared with one centre, what stays open inside tasks in blocks; token histograms,
  whose distance is never larger than that of the sets, leave pairs out, and full sets confirm.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clinrisk.llm.blocks import confirmed, exact_work, in_blocks, pairs
from clinrisk.llm.common import landed, mapped, mixed, pair_hash, released, slices, small_batches, text_bytes
from clinrisk.llm.components import components_of, connected
from clinrisk.llm.setsketch import shingle_sets

# Bins of a set's histogram; one in so many segments is of the reserve; a subset shared by so large a part of all sets is dear.
BINS, RESERVE, DEAR = 256, 16, 1 / 512
# The most frequent tokens that are told to the tasks; they are costs only.
FREQUENT = 1 << 16
# From so many equal keys in one batch on, only one of them meets those of other batches, and the others meet it.
LOCAL = 4
INDEX, PROBE, LEADER = 1, 2, 4
_SEGMENT, _CONTENT, _BIN = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


@lru_cache
def bands(percent: int) -> np.ndarray:
    """Largest set size of each band; the largest partner of a band's sets is in it or in the next."""
    out, low = [], 1
    while low < 1 << 40:
        out.append(100 * low // min(percent, 99))
        low = out[-1] + 1
    return np.array(out, np.int64)


def difference(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The largest number of tokens by which similar sets of sizes a and b can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


def segment_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values by segment, modulo 2**64; halves are added apart, where doubles are exact."""
    low = np.bincount(at, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(at, (values >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


def signatures(tokens: np.ndarray, sizes: np.ndarray, percent: int, frequent: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, role) of the sets, which stand one after another: what each is indexed under and what it asks for.

    ``frequent`` are sorted tokens that ``share`` of all sets hold.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    band = np.searchsorted(bands(percent), sizes)
    # How frequent a token is; 0 for those that are not.
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        often = np.where(frequent[at] == tokens, share[at], 0.0)
    else:
        often = np.zeros(len(tokens))
    below = (sizes > 0) & (band > 0)
    below[below] = 100 * bands(percent)[band[below] - 1] >= percent * sizes[below]
    parts = [_scheme(tokens, owner, often, sizes, band, sizes > 0, True, percent), _scheme(tokens, owner, often, sizes, band - 1, below, False, percent)]
    return tuple(np.concatenate(x) for x in zip(*parts))


def _scheme(tokens, owner, often, sizes, band, takes_part, own_band: bool, percent: int):
    chosen = np.flatnonzero(takes_part)
    if not len(chosen):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8)
    size, band = sizes[chosen], band[chosen]
    top = bands(percent)[band]
    many = difference(top, 100 * top // percent, percent) + 1
    need = difference(size, np.minimum(size, top), percent) + 1
    first = np.cumsum(many) - many
    local = np.full(len(sizes), -1)
    local[chosen] = np.arange(len(chosen))
    mine = local[owner]
    inside = mine >= 0
    tokens, often, mine = tokens[inside], often[inside], mine[inside]
    place = ((mixed(tokens ^ _SEGMENT) >> np.uint64(32)) * many[mine].astype(np.uint64)) >> np.uint64(32)
    at, n = first[mine] + place.astype(np.int64), int(many.sum())
    holder = np.repeat(np.arange(len(chosen)), many)
    number = np.arange(n) - first[holder]
    term = mixed(tokens * _CONTENT)
    content = segment_sums(at, term, n)
    held = np.bincount(at, minlength=n)
    rare = np.bincount(at, often == 0, n).astype(np.int64)
    least = np.full(n, 1.0)
    np.minimum.at(least, at[often > 0], often[often > 0])
    cost = np.where(rare > 0, 1e-6 / (1 + held), np.where(held > 0, least, np.exp(-size / many)[holder]))
    reserve = number < np.where(many > 1, np.maximum(many // RESERVE, 1), 0)[holder]

    # Rank segments of each set from dear to cheap: the first are not asked.
    order = np.lexsort((number, -cost, holder))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n) - first[holder[order]]
    spare = (many - need)[holder]
    dear = (cost >= DEAR) & (rank >= spare)
    able = reserve & (rank >= spare) & (cost < DEAR) & (rare >= 2)
    swaps = np.minimum(np.bincount(holder, dear, len(chosen)), np.bincount(holder, able, len(chosen))).astype(np.int64)
    asked = rank >= spare + swaps[holder]
    earlier = np.cumsum(able) - able
    deleting = able & (earlier - earlier[first][holder] < swaps[holder])

    salt = pair_hash(band[holder].astype(np.uint64), number.astype(np.uint64))
    role = np.where(asked, PROBE, 0) | (INDEX if own_band else 0)
    kept = role > 0
    # One-deletion neighbourhoods: indexed for the whole reserve, asked for where a deletion was allotted.
    near = (reserve if own_band else deleting)[at]
    role_near = np.where(deleting[at], PROBE, 0) | (INDEX if own_band else 0)
    key = np.concatenate([pair_hash(content[kept], salt[kept]), pair_hash(content[at[near]] - term[near], salt[at[near]])])
    return chosen[np.concatenate([holder[kept], holder[at[near]]])], key, np.concatenate([role[kept], role_near[near]]).astype(np.uint8)


def allotted(tokens: np.ndarray, sizes: np.ndarray, percent: int, frequent=np.empty(0, np.uint64), share=np.empty(0)) -> Iterator[set]:
    """For tests: the (key, role) set of each set."""
    owner, key, role = signatures(tokens, sizes, percent, frequent, share)
    for i in range(len(sizes)):
        yield set(zip(key[owner == i].tolist(), role[owner == i].tolist()))


def histograms(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Tokens of each set by bin (sets x BINS); counts over 255 stay 255, which makes no distance larger."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bins = (mixed(tokens ^ _BIN) % np.uint64(BINS)).astype(np.int64)
    return np.minimum(np.bincount(owner * BINS + bins, minlength=len(sizes) * BINS), 255).astype(np.uint8).reshape(len(sizes), BINS)


def fingerprints(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two sums over each set's hashes, as good as the set itself, and a node number made of them; 0 for empty sets."""
    a, b, some = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64), sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        a[some] = np.add.reduceat(mixed(tokens), starts)
        b[some] = np.bitwise_xor.reduceat(mixed(tokens + np.uint64(77)), starts)
    return a.view(np.int64), b.view(np.int64), pair_hash(pair_hash(a, b), sizes.astype(np.uint64)).view(np.int64)


def _sets(texts: list[bytes], size: int, piece: int = 1 << 19):
    for low, high in slices(texts, piece):
        yield low, high, *shingle_sets(texts[low:high], size)


def described(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, high, low, node and histogram (NULL for an empty set) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batch: pa.RecordBatch):
        for low, high, tokens, sizes in _sets(text_bytes(batch.column(1)), size):
            bins = histograms(tokens, sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(low, high - low), pa.array(sizes.astype(np.int64)), *(pa.array(x) for x in fingerprints(tokens, sizes)),
                 pa.array([x.tobytes() if n else None for x, n in zip(bins, sizes)], pa.binary())],
                ["doc_id", "n_shingles", "high", "low", "node", "bins"])

    return mapped(docs.select("doc_id", "text"), f"doc_id {kind}, n_shingles long, high long, low long, node long, bins binary", each)


def frequent_tokens(docs: DataFrame, size: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that at least DEAR of all rows hold, by counts that leave out what is rare in a stretch of text; sorted, with their shares."""
    def each(batch: pa.RecordBatch):
        for low, high, tokens, _ in _sets(text_bytes(batch.column(0)), size):
            token, count = np.unique(tokens, return_counts=True)
            often = count >= max(3, (high - low) * DEAR / 2)
            yield pa.RecordBatch.from_arrays([pa.array(token[often].view(np.int64)), pa.array(count[often])], ["token", "n"])

    counts = mapped(docs.select("text"), "token long, n long", each).groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= total * DEAR).orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    token = top.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return token[order], top.column("n").to_numpy()[order] / max(total, 1)


def keyed(docs: DataFrame, size: int, percent: int, frequent: np.ndarray, share: np.ndarray) -> DataFrame:
    """key, node and tag of what every set is indexed under and asks for; tag is 8 * salt + role.

    Equal keys of many sets of one stretch of text stay together under a salt, and only the first of them, a leader, goes
    among those of all others. So no key has more rows in one place than there are stretches.
    """
    def each(batch: pa.RecordBatch):
        for low, high, tokens, sizes in _sets(text_bytes(batch.column(0)), size):
            node = fingerprints(tokens, sizes)[2]
            owner, key, role = signatures(tokens, sizes, percent, frequent, share)
            node, role = node[owner], role.astype(np.int64)
            order = np.lexsort((node, key))
            key, node, role = key[order], node[order], role[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
            start = np.flatnonzero(new)
            if not len(start):
                continue
            key, node, role = key[start], node[start], np.bitwise_or.reduceat(role, start)
            border = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0)
            count = np.diff(np.append(border, len(key)))
            crowd = count >= LOCAL
            joint = np.bitwise_or.reduceat(role, border)
            inside = np.repeat(crowd, count)
            salt = (int(mixed(key[:1] ^ node[:1].view(np.uint64))[0]) >> 3) & 0xFFFFFFFF | 1
            tag = np.where(inside, role | (salt << 3), role)
            leaders = border[crowd]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([key, key[leaders]]).view(np.int64)), pa.array(np.concatenate([node, node[leaders]])), pa.array(np.concatenate([tag, joint[crowd] | LEADER]))],
                ["key", "node", "tag"])

    return mapped(docs.select("text"), "key long, node long, tag long", each)


def met(rows: DataFrame) -> DataFrame:
    """key, node and role where keys meet. Keys that bring the same sets together are one key, unless leaders are among them."""
    placed = rows.repartition("key").sortWithinPartitions("key", "tag", "node")

    def groups(key, node, tag):
        salt = tag >> 3
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
        border = np.flatnonzero(new)
        count = np.diff(np.append(border, len(key)))
        several = np.repeat(count > 1, count)
        if not several.any():
            return None
        group = np.repeat(np.arange(len(border)), count)[several]
        key, node, tag, salt = key[several], node[several], tag[several], salt[several]
        # A set can be in a group several times, with several roles.
        order = np.lexsort((node, group))
        group, key, node, tag, salt = group[order], key[order], node[order], tag[order], salt[order]
        new = np.ones(len(key), bool)
        new[1:] = (group[1:] != group[:-1]) | (node[1:] != node[:-1])
        start = np.flatnonzero(new)
        role = np.bitwise_or.reduceat(tag & 7, start)
        group, key, node, salt = group[start], key[start], node[start], salt[start]
        border = np.flatnonzero(np.diff(group, prepend=-1))
        count = np.diff(np.append(border, len(group)))
        every = np.repeat(np.bitwise_or.reduceat(role, border), count)
        alike = np.repeat(np.add.reduceat(mixed(node.view(np.uint64) * np.uint64(4) + (role & 3).astype(np.uint64)), border), count)
        shared = (salt != 0) | (every & LEADER > 0)
        # What meets under a salt may be asked for by sets elsewhere; all others are here.
        kept = np.repeat(count > 1, count) & (shared | (every & 3 == 3))
        key = np.where(shared, key, alike.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(node[kept]), pa.array((role & 3)[kept].astype(np.int32))], ["key", "node", "role"])

    def run(batches):
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            cut = int(np.flatnonzero((now[0] == now[0][-1]) & (now[2] >> 3 == now[2][-1] >> 3))[0])
            held = [x[cut:] for x in now]
            if cut and (out := groups(*(x[:cut] for x in now))):
                yield out
        if len(held[0]) and (out := groups(*held)):
            yield out

    found = small_batches(placed).mapInArrow(released(run), "key long, node long, role int")
    return found.groupBy("key", "node").agg(F.bit_or("role").alias("role"))


def near(bins: tuple[np.ndarray, np.ndarray], at: tuple[np.ndarray, np.ndarray], n_a: np.ndarray, n_b: np.ndarray, percent: int, piece: int = 20_000) -> np.ndarray:
    """Which pairs of histograms (rows ``at`` of ``bins``) may be similar: sizes allow it, and they differ by no more than similar sets can."""
    out = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    for low in range(0, len(out), piece):
        some = low + np.flatnonzero(out[low:low + piece])
        x, y = bins[0][at[0][some]], bins[1][at[1][some]]
        apart = (np.maximum(x, y) - np.minimum(x, y)).sum(axis=1, dtype=np.int64)
        out[some] = apart <= difference(n_a[some], n_b[some], percent)
    return out


def bins_of(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BINS)


def sets_of(docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """node and packed set of the classes (node, id), from the texts of their smallest doc_ids."""
    chosen = docs.select("doc_id", "text").join(classes.select("id").distinct(), F.col("doc_id").eqNullSafe(F.col("id"))).select("text")

    def each(batch: pa.RecordBatch):
        for _, _, tokens, sizes in _sets(text_bytes(batch.column(0)), size):
            ends, some = np.cumsum(sizes), np.flatnonzero(sizes)
            packed = [tokens[e - n:e].tobytes() for e, n in zip(ends[some], sizes[some])]
            yield pa.RecordBatch.from_arrays([pa.array(fingerprints(tokens, sizes)[2][some]), pa.array(packed, pa.binary())], ["node", "set"])

    return mapped(chosen, "node long, set binary", each).join(classes.select("node"), "node", "left_semi").dropDuplicates(["node"])


def links(docs: DataFrame, classes: DataFrame, size: int, percent: int, frequent: np.ndarray, share: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Labels (node, label) of the classes (node, id, n_shingles, bins) that the stars tie, and links (a, b) between labels that join up every component."""
    buckets = landed(met(keyed(docs, size, percent, frequent, share)), "met")
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"), F.bit_or("role").alias("roles")).where("size > 1 AND roles = 3").select("key", "size")
    banded = landed(buckets.join(sizes, "key"), "buckets")
    # The centre is the set that meets most others.
    company = banded.groupBy("node").agg(F.sum("size").alias("met"))
    centres = banded.join(company, "node").groupBy("key").agg(F.max(F.struct("met", "node"))["node"].alias("centre"))
    star = landed(banded.join(centres, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), "stars")
    brief = classes.select("node", "n_shingles", "bins")
    likely = landed(_likely(star, brief, percent), "likely")
    nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = landed(sets_of(docs, classes.join(nodes, "node"), size), "sets")
    stars = landed(confirmed(likely, sets, percent), "links")
    labels = landed(connected(stars), "labels")
    # Buckets that still hold several components, without the centre's pairs, which are settled.
    labelled = banded.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    rest = landed(labelled.join(open_keys, "key").join(centres, "key").withColumn("central", F.col("node") == F.col("centre"))
                  .select("key", "node", "label", "size", "central", "role"), "open")
    close = landed(in_blocks(rest.join(brief, "node"), _near_work(percent), "a long, b long"), "near")
    # A set has many keys, but is in one family of sets whose histograms are near: there its full set is compared, once per block.
    family = landed(connected(close).select("node", F.col("label").alias("key")), "families")
    counts = family.groupBy("key").agg(F.count("*").alias("size"))
    members = family.join(counts, "key").join(labels, "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    sets = landed(sets_of(docs, classes.join(family.select("node"), "node"), size), "sets")
    more = in_blocks(members.join(sets, "node"), exact_work(percent), "a long, b long", alone=False)
    return labels, landed(more, "links")


def _likely(star: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    sides = [brief.select(F.col("node").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("bins").alias(f"h_{s}")) for s in "ab"]
    joined = star.join(sides[0], "a").join(sides[1], "b").where(
        F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")).select("a", "b", "n_a", "n_b", "h_a", "h_b")

    def each(batch: pa.RecordBatch):
        row = np.arange(batch.num_rows)
        keep = near((bins_of(batch.column(4)), bins_of(batch.column(5))), (row, row), batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
        yield batch.select(["a", "b"]).filter(pa.array(keep))

    return mapped(joined, "a long, b long", each)


def _near_work(percent: int):
    """Links that join up sets of a block whose histograms are near, one fewer than there are sets at most."""
    def work(table: pa.Table):
        bins, n, role, node = bins_of(table.column("bins")), table.column("n_shingles").to_numpy(), table.column("role").to_numpy(), table.column("node").to_numpy()
        root = np.arange(table.num_rows)
        for a, b in pairs(table):
            asks = ((role[a] & PROBE > 0) & (role[b] & INDEX > 0)) | ((role[b] & PROBE > 0) & (role[a] & INDEX > 0))
            asks &= root[a] != root[b]
            a, b = a[asks], b[asks]
            found = near((bins, bins), (a, b), n[a], n[b], percent)
            root = joined_up(root, a[found], b[found])
        own = root != np.arange(table.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(node[root[own]])], ["a", "b"])
    return work


def joined_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is tied to, where ``root`` says so already and a and b are further ties."""
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        while (new != (further := new[new])).any():
            new = further
        if (new == root).all():
            return root
        root = new[root]


def similar_sets(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    A-Z is lower-cased; a set is a text's distinct ``size``-word shingles, of a shorter text its whole sequence. Sets are linked where
    100 * intersection >= ``percent`` * union, and component_id is the smallest doc_id reachable. A text without words (or NULL)
    is linked with nothing. Repeated rows are equal sets; a NULL doc_id is never the smallest of a component that has another.
    An empty table gives an empty result; other columns are not looked at.
    """
    rows = landed(described(docs, size), "sets")
    classes = landed(rows.where("n_shingles > 0").groupBy("n_shingles", "high", "low", "node")
                     .agg(F.min("doc_id").alias("id"), F.first("bins").alias("bins"), F.count("*").alias("copies")), "classes")
    frequent, share = frequent_tokens(docs, size, rows.count())
    out = components_of(rows.select("doc_id", "n_shingles", "high", "low"), classes, *links(docs, classes, size, percent, frequent, share))
    return out.select("doc_id", "n_shingles", "component_id")
