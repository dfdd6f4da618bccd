"""Filling fixed-capacity containers with documents: a grouping genetic algorithm on islands."""

from __future__ import annotations

import base64
import random
import re
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lineweave.plans.durable import durable
from lineweave.sources.tables import table

#: Items of a shard, islands a shard, epochs between migrations, individuals an island, offspring an epoch.
SHARD, ISLANDS, EPOCHS, POPULATION, OFFSPRING = 1000, 3, 3, 8, 40
#: Containers filled less than this share are emptied and packed again across shards.
WELL_FILLED = 0.97
_PIECE = re.compile(r" (?=\S)")
_CACHED = 500_000


@cache
def token_counter(vocabulary: str | None = None) -> Callable[[str], int]:
    """Counts the tokens of a text in a public byte-level BPE vocabulary (a file of ranks).

    A space before a non-space always begins a token, so texts are counted piece by piece between such spaces, and counts of pieces are remembered.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, int] = {}

    def count(text: str) -> int:
        pieces = _PIECE.split(text)
        total = len(encode(pieces[0]))
        for p in pieces[1:]:
            n = known.get(p)
            if n is None:
                if len(known) >= _CACHED:
                    known.clear()
                n = known[p] = len(encode(" " + p))
            total += n
        return total

    return count


def _sizes(vocabulary: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary)
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["doc_id", "tokens"])

    return run


def document_sizes(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, tokens`` of every row; null and empty texts have 0 tokens."""
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_sizes(vocabulary), "doc_id bigint, tokens int")


class _Packing:
    """Items in bins: loads and members by bin, and the free room of all bins in order."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.bins: dict[int, list[int]] = {}
        self.load: dict[int, int] = {}
        self.room: list[tuple[int, int]] = []
        self.next = 0

    def add_bin(self, items: list[int], load: int) -> None:
        b, self.next = self.next, self.next + 1
        self.bins[b], self.load[b] = items, load
        insort(self.room, (self.capacity - load, b))

    def best_fit(self, items: list[int]) -> None:
        """Each item, largest first, into the bin where it leaves least room."""
        sizes, room = self.sizes, self.room
        for i in sorted(items, key=sizes.__getitem__, reverse=True):
            s = sizes[i]
            k = bisect_left(room, (s, -1))
            if k == len(room):
                self.add_bin([i], s)
            else:
                r, b = room.pop(k)
                self.bins[b].append(i)
                self.load[b] += s
                insort(room, (r - s, b))

    def fitness(self) -> float:
        """Mean squared fill: of two packings with as many bins, the one with fuller and emptier bins is better, as it is easier to shorten."""
        if not self.load:
            return 1.0
        c = self.capacity
        return sum((x / c) ** 2 for x in self.load.values()) / len(self.load)

    def genes(self) -> list[int]:
        out = [0] * len(self.sizes)
        for n, items in enumerate(self.bins.values()):
            for i in items:
                out[i] = n
        return out


def _read(genes: list[int], sizes: list[int], capacity: int) -> _Packing:
    groups: dict[int, list[int]] = {}
    for i, b in enumerate(genes):
        groups.setdefault(b, []).append(i)
    p = _Packing(sizes, capacity)
    for items in groups.values():
        p.add_bin(items, sum(sizes[i] for i in items))
    return p


def _first(sizes: list[int], capacity: int, rng: random.Random, noise: float) -> _Packing:
    """Best fit by decreasing size, or by size blurred by ``noise``."""
    p = _Packing(sizes, capacity)
    if noise:
        for i in sorted(range(len(sizes)), key=lambda i: sizes[i] * rng.uniform(1 - noise, 1), reverse=True):
            p.best_fit([i])
    else:
        p.best_fit(list(range(len(sizes))))
    return p


def _cross(a: _Packing, b: _Packing, rng: random.Random) -> _Packing:
    """A copy of ``a`` with some of the best-filled bins of ``b`` put in whole: bins of ``a`` that hold one of their items are dissolved, and what was
    displaced is placed by best fit. The worst bin left is dissolved too, so that offspring differ even from like parents."""
    ranked = sorted(b.bins, key=b.load.__getitem__, reverse=True)
    top = ranked[: max(1, len(ranked) // 2)]
    taken = rng.sample(top, max(1, len(top) // 3))
    moved = {i for t in taken for i in b.bins[t]}
    child, loose = _Packing(a.sizes, a.capacity), []
    worst = min(a.load, key=a.load.__getitem__)
    for t in taken:
        child.add_bin(list(b.bins[t]), b.load[t])
    for x, items in a.bins.items():
        if x == worst or not moved.isdisjoint(items):
            loose += [i for i in items if i not in moved]
        else:
            child.add_bin(list(items), a.load[x])
    child.best_fit(_exchange(child, loose))
    return child


def _exchange(p: _Packing, loose: list[int]) -> list[int]:
    """Displaced items in place of one or two items of a bin, where they fill it better: what is displaced then is smaller and easier to place."""
    sizes, capacity = p.sizes, p.capacity
    loose = sorted(loose, key=sizes.__getitem__, reverse=True)
    for x in sorted(p.load, key=p.load.__getitem__):
        room = capacity - p.load[x]
        if not room or not loose:
            continue
        best = (0, None, None)
        items = p.bins[x]
        one = [(sizes[i], (i,)) for i in items]
        two = [(sizes[i] + sizes[j], (i, j)) for n, i in enumerate(items) for j in items[:n]]
        for gone, out in (*one, *two):
            for into in _best_entry(loose, sizes, gone + room):
                gain = sum(sizes[i] for i in into) - gone
                if best[0] < gain <= room and len(into) <= len(out):
                    best = (gain, out, into)
            if best[0] == room:
                break
        gain, out, into = best
        if out:
            p.bins[x] = [i for i in items if i not in out] + list(into)
            p.room.remove((room, x))
            p.load[x] += gain
            insort(p.room, (room - gain, x))
            loose = sorted([i for i in loose if i not in into] + list(out), key=sizes.__getitem__, reverse=True)
    return loose


def _best_entry(loose: list[int], sizes: list[int], room: int) -> Iterator[tuple[int, ...]]:
    """The one item, and the two items, of ``loose`` (largest first) that fill ``room`` best."""
    at = bisect_left(loose, -room, key=lambda i: -sizes[i])
    if at < len(loose):
        yield (loose[at],)
    best, lo, hi = None, 0, len(loose) - 1
    while lo < hi:
        total = sizes[loose[lo]] + sizes[loose[hi]]
        if total > room:
            lo += 1
        else:
            if best is None or total > best[0]:
                best = (total, (loose[lo], loose[hi]))
            hi -= 1
    if best:
        yield best[1]


def evolve(sizes: list[int], capacity: int, population: list[list[int]], seed: int, offspring: int = OFFSPRING) -> list[list[int]]:
    """One island's epoch: the population (filled up with new individuals) after ``offspring`` crossings, best first.

    Stops as soon as an individual needs no more bins than the total size must have.
    """
    rng = random.Random(seed)
    if not sizes:
        return [[]]
    least = -(-sum(sizes) // capacity)
    people = [_read(g, sizes, capacity) for g in population]
    while len(people) < POPULATION:
        people.append(_first(sizes, capacity, rng, 0.0 if not people and not population else rng.choice((0.1, 0.3, 0.6))))
        if len(people[-1].bins) <= least:
            break
    people.sort(key=_Packing.fitness, reverse=True)
    for _ in range(offspring):
        if len(people[0].bins) <= least or len(people) < 2:
            break
        a, b = rng.sample(people[: max(2, len(people) // 2 + 1)], 2)
        child = _cross(a, b, rng)
        people.append(child)
        people.sort(key=_Packing.fitness, reverse=True)
        people.pop()
    return [p.genes() for p in people]


_STATE = "shard bigint, island int, sizes array<int>, people array<array<int>>, fitness double"


def _epoch(capacity: int, number: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, island, sizes, people in zip(*(batch.column(i).to_pylist() for i in range(4))):
                after = evolve(sizes, capacity, people, hash((shard, island, number)) & 0xFFFFFFFF)
                fitness = _read(after[0], sizes, capacity).fitness()
                ints = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([island], pa.int32()), pa.array([sizes], ints), pa.array([after], pa.list_(ints)), pa.array([fitness])],
                    names=["shard", "island", "sizes", "people", "fitness"],
                )

    return run


_PLACED = "doc_id bigint, part int, token_start bigint, size int, bin bigint, load bigint"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item of a shard with its bin and the bin's load."""
    for batch in batches:
        for shard, items, genes in zip(*(batch.column(i).to_pylist() for i in range(3))):
            load: dict[int, int] = {}
            for x, g in zip(items, genes):
                load[g] = load.get(g, 0) + x["size"]
            columns = [[x[k] for x in items] for k in ("doc_id", "part", "token_start", "size")]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            rows = (*columns, [shard * 10_000_000 + g for g in genes], [load[g] for g in genes])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=[x.split()[0] for x in _PLACED.split(", ")])


def _pack_items(items: DataFrame, capacity: int, shard_items: int, tag: str) -> DataFrame:
    """Every row of ``items`` (doc_id, part, token_start, size up to the capacity) with its ``bin``, a number unique in all shards, and the bin's ``load``.

    The state of a shard (about ``shard_items`` items, whatever the data) moves through merge joins only, so nothing is broadcast.
    """
    n = items.count()
    shards = max(1, -(-n // shard_items))
    of = F.struct("doc_id", "part", "token_start", "size")
    items = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", F.col("uid")), F.lit(shards)))
    grouped = items.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("uid", of.alias("of")))).alias("x"))
    grouped = durable(grouped.select("shard", F.col("x.of").alias("items")), f"{tag}-shards")
    tasks = max(1, min(shards * ISLANDS, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    state = grouped.select("shard", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), F.col("items.size").alias("sizes"), F.array().cast("array<array<int>>").alias("people"))
    for e in range(EPOCHS):
        state = state.repartition(tasks, "shard", "island").mapInArrow(_epoch(capacity, e), _STATE)
        if e + 1 < EPOCHS:  # each island's best individual moves on to the next island of its shard, in place of the worst there
            state = durable(state, f"{tag}-epoch")
            elite = state.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), F.col("people")[0].alias("guest"))
            kept = F.slice("people", 1, F.greatest(F.size("people") - 1, F.lit(1)))
            state = state.join(elite.hint("merge"), ["shard", "island"]).select("shard", "island", "sizes", F.concat(kept, F.array("guest")).alias("people"))
    best = state.groupBy("shard").agg(F.max_by(F.col("people")[0], F.struct(F.col("fitness"), -F.col("island"))).alias("genes"))
    return grouped.join(best.hint("merge"), "shard").select("shard", "items", "genes").mapInArrow(_place, _PLACED)


def pack_documents(sizes: DataFrame, capacity: int, shard_items: int = SHARD) -> DataFrame:
    """Every row of ``sizes`` (doc_id, tokens) in containers of ``capacity`` tokens: ``doc_id, part, token_start, tokens, container_id``.

    A document over the capacity is cut into full containers and a rest (part 2, 3 ...; ``token_start`` tells where a part begins); any other stays
    whole. Rows are dealt by hash into shards of about ``shard_items``. Islands evolve each shard side by side: an individual is a whole packing,
    crossing puts well-filled containers of one into the other, removes what is then there twice and best-fits displaced documents; after each
    epoch the best individual migrates to the shard's next island. Containers under 97 % are emptied in the end and packed again together across
    shards the same way, so part-filled rests don't add up with the number of shards.

    Null or negative sizes count as 0. Empty documents fill no room and lie in containers like others. Repeated rows are packed each. An empty table
    needs no container. The number of rows of a task depends on ``shard_items`` alone, not on keys, so no data can be skewed.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    size = F.greatest(F.coalesce(F.col("tokens"), F.lit(0)), F.lit(0)).cast("bigint")
    parts = sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), size.alias("t"))
    count = F.greatest(F.ceil(F.col("t") / capacity), F.lit(1))
    parts = parts.select("doc_id", "t", F.explode(F.sequence(F.lit(1).cast("bigint"), count.cast("bigint"))).alias("part"))
    start = (F.col("part") - 1) * capacity
    parts = parts.select("doc_id", F.col("part").cast("int").alias("part"), start.alias("token_start"), F.least(F.col("t") - start, F.lit(capacity)).cast("int").alias("tokens"))
    parts = durable(parts.withColumn("uid", F.monotonically_increasing_id()), "containers-parts")
    rest = parts.filter(F.col("tokens") < capacity).select("uid", "doc_id", "part", "token_start", F.col("tokens").alias("size"))
    first = durable(_pack_items(rest, capacity, shard_items, "containers-1"), "containers-first")
    poor = first.filter(F.col("load") < WELL_FILLED * capacity).withColumn("uid", F.monotonically_increasing_id())
    again = _pack_items(durable(poor.select("uid", "doc_id", "part", "token_start", "size"), "containers-poor"), capacity, shard_items, "containers-2")
    out = ["doc_id", "part", "token_start", F.col("size").alias("tokens")]
    full = parts.filter(F.col("tokens") == capacity).select("doc_id", "part", "token_start", "tokens", (-F.col("uid") - 1).alias("container_id"))
    good = first.filter(F.col("load") >= WELL_FILLED * capacity).select(*out, F.col("bin").alias("container_id"))
    return full.unionByName(good).unionByName(again.select(*out, (F.col("bin") + (1 << 60)).alias("container_id")))


#: Tokens a container of the query holds.
CAPACITY = 2048


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(document_sizes(table(spark, sf_dir, "documents", "doc_id", "text")), CAPACITY)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many containers, how many would do at the very least, and how full they are."""
    load = p7_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("tokens").alias("load"))
    total = F.sum("load")
    return load.agg(F.count("*").alias("containers"), F.ceil(total / CAPACITY).alias("at_least"), F.round(total / (F.count("*") * CAPACITY), 6).alias("fill"), F.max("load").alias("fullest"))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
SQL: dict[str, str] = {}
