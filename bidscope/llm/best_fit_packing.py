"""Best-fit packing of token sequences by bin completion on the length histogram.

Only the number of pieces of each length matters to a packing, so the search runs on at most ``capacity`` counts, whatever
the number of documents. It completes one sequence at a time: the largest remaining length is placed, and the
undominated fillings of the gap around it (those that use larger lengths where shorter ones would also do), of any number of
pieces, are tried, least waste first. A first search tries a few fillings at a node, each as often as its lengths allow, a
second one all fillings and fewer times as well. Branches whose waste exceeds what the best packing so far leaves are pruned;
best-fit decreasing gives the first incumbent and completes every dive. The search ends at the lower bound or after a stated
number of nodes and steps; only then can a packing be above the fewest sequences.

The resulting patterns are dealt to the pieces by their rank among the pieces of their length; ranks come from
counts by bucket, so no length is gathered in one task.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, stored, tidy

#: Nodes of a search over all dives, fillings tried at a node of the narrow search, and steps that find the fillings of a search.
NODES = 5_000
BRANCHES = 4
STEPS = 500_000
_OTHER = re.compile("[^\x00-\u024f]")
# Fixed value: the split pattern of byte-level tokenizers that use their own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def latin_encoder(path: str):
    """``tiktoken``'s encoder of the file's vocabulary, or None where ids are not merge ranks or the split is another."""
    import tiktoken

    from .bpe_automaton import byte_symbols

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split, model = spec["pre_tokenizer"], spec["model"]
    vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"]
    if not plain or len(vocab) != 256 + len(merges) or any(vocab[a + b] != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding("latin", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class ByteBpe:
    """Ids of a byte-level BPE tokenizer file, those that the ``tokenizers`` library gives.

    Latin texts go to ``tiktoken`` with the same ranks where the file's ids are merge ranks: the same algorithm, several times
    as fast. Other texts, and texts with special tokens, go to the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self._latin = latin_encoder(path)

    def encode(self, text: str) -> bytes:
        if self._latin is None or _OTHER.search(text) or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self._latin.encode_ordinary(text)).tobytes()


_CODERS: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    if path not in _CODERS:
        _CODERS[path] = ByteBpe(path)
    return _CODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: one where they fit, else full pieces behind a first one of the rest."""
    first = n - (-(-n // capacity) - 1) * capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(id, piece, start, length, ids)`` per piece of each row's tokens and ``end_id``; ``ids`` is binary,
    little-endian unsigned 32-bit numbers. A null text counts as empty: one piece that holds ``end_id`` alone."""
    bound_batches(df.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        c = coder(path)
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = c.encode(text or "") + end
                out += [(doc, k, at, n, ids[4 * at:4 * (at + n)]) for k, (at, n) in enumerate(cut(len(ids) // 4, capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    names = [id_col, "piece", "start", "length", "ids"]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, (T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType()))])
    return df.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(tidy(run), schema)


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Fewest sequences that any packing needs: the best bound over all thresholds below which lengths are left out."""
    sizes = np.zeros(capacity + 1, dtype=np.int64)
    for n, k in counts.items():
        sizes[n] = k
    lengths = np.arange(capacity + 1)
    number, total = np.cumsum(sizes), np.cumsum(sizes * lengths)
    half, best = capacity // 2, -(-int(total[-1]) // capacity)
    for k in range(half + 1):
        alone = int(number[capacity] - number[capacity - k])
        wide = int(number[capacity - k] - number[half])
        room = capacity * wide - int(total[capacity - k] - total[half])
        rest = int(total[half] - (total[k - 1] if k else 0))
        best = max(best, alone + wide + max(0, -(-(rest - room) // capacity)))
    return best


def spread(bits: int, by: int) -> int:
    """Bits ``x`` such that one of ``x`` to ``x + by`` is set in ``bits``."""
    done = 0
    while done < by:
        step = min(done + 1, by - done)
        bits |= bits >> step
        done += step
    return bits


def fillings(counts: Counter, sizes: list[int], gap: int, steps: list[int]):
    """All undominated fillings of ``gap``, of any number of pieces: least waste first; of equal sums those of long pieces first.

    A filling is dominated if an unused piece fits into its waste, or fits in place of a shorter piece or of several pieces of
    it. Sums are walked only where the bounded subset sums (a bit for each sum) say that they can be made. ``steps[0]`` is
    lowered by one a step; at 0 the fillings end.
    """
    if gap <= 0 or not sizes or sizes[0] > gap:
        yield ()
        return
    fit = sizes[:bisect.bisect_right(sizes, gap)]  # ascending
    most = [min(counts[s], gap // s) for s in fit]
    every = (1 << gap + 1) - 1
    made = [1]  # made[j]: sums of the j shortest lengths
    for s, n in zip(fit, most):
        sums, k = made[-1], 1
        while n:
            k = min(k, n)
            sums |= sums << k * s & every
            n -= k
            k *= 2
        made.append(sums)
    free = sum(1 << s for s in fit)  # lengths of which a piece is unused

    def walk(j, rest, waste, taken, single, several, unused):
        """Fillings of ``rest`` by the ``j`` shortest lengths behind ``taken``; bits of its pieces and of its sums of several."""
        if not rest:
            if not unused & ((1 << waste + 1) - 1):
                yield taken
            return
        while j and made[j] >> rest & 1 and steps[0] > 0:
            j -= 1
            s = fit[j]
            for k in range(min(most[j], rest // s), 0, -1):
                if not made[j] >> rest - k * s & 1:
                    continue
                steps[0] -= 1
                one, more = single, several
                for _ in range(k):
                    one, more = one | 1 << s, more | (more | one) << s
                left = unused ^ 1 << s if k == counts[s] else unused
                if more & spread(left, waste) or waste and one & spread(left >> 1, waste - 1):
                    continue
                yield from walk(j, rest - k * s, waste, taken + (s,) * k, one, more, left)

    for waste in range(gap + 1):
        if made[-1] >> gap - waste & 1 and gap > waste and steps[0] > 0:
            yield from walk(len(fit), gap - waste, waste, (), 0, 0, free)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing with equal bins taken together: patterns (lengths, times)."""
    left = Counter({n: k for n, k in counts.items() if k})
    order = sorted(left)
    out = []
    while order:
        gap, fill = capacity, Counter()
        while order and gap >= order[0]:
            at = bisect.bisect_right(order, gap) - 1
            while at >= 0 and fill[order[at]] >= left[order[at]]:
                at -= 1
            if at < 0:
                break
            n = min(gap // order[at], left[order[at]] - fill[order[at]])
            fill[order[at]] += n
            gap -= n * order[at]
        times = min(left[s] // k for s, k in fill.items())
        out.append((tuple(sorted(fill.elements(), reverse=True)), times))
        for s, k in fill.items():
            left[s] -= k * times
            if not left[s]:
                order.remove(s)
    return out


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns ``(lengths, times)`` that hold each length as often as ``counts`` has it, in as few sequences as found."""
    if any(n < 1 or n > capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    counts = {n: k for n, k in counts.items() if k > 0}
    bound, best = lower_bound(counts, capacity), best_fit(counts, capacity)
    for narrow in (True, False):
        if sum(t for _, t in best) > bound:
            best = search(counts, capacity, bound, best, nodes, narrow)
    return best


def search(counts: dict[int, int], capacity: int, bound: int, best: list[tuple[tuple[int, ...], int]], nodes: int, narrow: bool) -> list[tuple[tuple[int, ...], int]]:
    """The better of ``best`` and what a search by depth finds in ``nodes`` nodes and ``STEPS`` steps of their fillings.

    A narrow search tries ``BRANCHES`` fillings at a node, each as often as lengths and waste allow; the other one all
    fillings, also fewer times, so that only the limits keep it from a best packing.
    """
    total, fewest = sum(n * k for n, k in counts.items()), sum(t for _, t in best)
    left, path = Counter(counts), []
    sizes = sorted(left)
    spent, steps = 0, [STEPS]
    waste = bins = 0

    def take(fill: tuple[int, ...], sign: int, times: int) -> None:
        for s in fill:
            before = left[s]
            left[s] -= sign * times
            if before and not left[s]:
                del sizes[bisect.bisect_left(sizes, s)]
            elif not before:
                bisect.insort(sizes, s)

    def some(start: int, n: int) -> list[tuple[int, ...]]:
        """Fillings ``start`` to ``start + n`` of the open node. Its subset sums are made anew, so that deep dives hold none."""
        top, rest, lengths = sizes[-1], Counter(left), list(sizes)
        rest[top] -= 1
        if not rest[top]:
            lengths.pop()
        return [(top, *f) for f in itertools.islice(fillings(rest, lengths, capacity - top, steps), start, start + n)]

    def options():
        """``(filling, times)`` of the open node, asked for one by one, with its lengths as they are then."""
        given, batch = 0, 1
        while batch:
            found = some(given, batch)
            for fill in found:
                loss, times = capacity - sum(fill), min(left[s] // k for s, k in Counter(fill).items())
                spare = (fewest - 1) * capacity - total - waste
                times = min(times, spare // loss) if loss else times
                if times < 1:  # later fillings waste as much or more
                    return
                while times:
                    yield fill, times
                    times = 0 if narrow else times // 2
            given += len(found)
            batch = 0 if len(found) < batch else min(given, BRANCHES - given) if narrow else given

    def finish() -> None:
        """The dive completed by best fit."""
        nonlocal best, fewest
        ends = best_fit(left, capacity)
        if bins + sum(t for _, t in ends) < fewest:
            best, fewest = [*path, *ends], bins + sum(t for _, t in ends)

    stack: list[list] = [[options(), None]]  # of each open node: its fillings still to try, what is applied now
    while stack and fewest > bound:
        todo, applied = stack[-1]
        if applied is not None:
            fill, times = applied
            take(fill, -1, times)
            path.pop()
            bins -= times
            waste -= times * (capacity - sum(fill))
            stack[-1][1] = None
        ahead = next(todo, None)
        if ahead is None:
            stack.pop()
            continue
        fill, times = ahead
        spent += 1
        take(fill, 1, times)
        path.append((fill, times))
        bins, waste = bins + times, waste + times * (capacity - sum(fill))
        stack[-1][1] = ahead
        ended = spent >= nodes or steps[0] <= 0
        if applied is not None or ended or not sizes:  # a new dive starts, or one ends
            finish()
        if ended:
            break
        if sizes:
            stack.append([options(), None])
    return best


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, per sequence, first sequence, offset), by length and rank: which pieces of a length go where."""
    rows, used, base = [], Counter(), 0
    for fill, times in patterns:
        at = 0
        for s, k in sorted(Counter(fill).items(), reverse=True):
            rows.append((s, used[s], k, base, at))
            used[s] += k * times
            at += s * k
        base += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(df: DataFrame, capacity: int = 2048, length_col: str = "length", order_by: tuple[str, ...] = ("doc_id", "piece"), nodes: int = NODES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (longs): rows of length 1 to ``capacity`` packed into few sequences without gaps.

    Rows of one length are alike to the packing; they are dealt in the order of ``order_by`` within hash buckets. Null
    lengths are an error, as are lengths out of range. Repeated rows are pieces of their own; an empty table stays
    empty; columns of the new names are replaced.
    """
    spark = df.sparkSession
    base = stored(df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in ("sequence_id", "offset"))), "pieces")
    counted = base.groupBy(length_col).count().limit(capacity + 2).collect()  # a row per length: at most the capacity
    counts = {r[0]: r[1] for r in counted}
    if any(n is None or not 1 <= n <= capacity for n in counts):
        raise ValueError(f"{length_col} must be from 1 to {capacity}")
    table = slots(complete(counts, capacity, nodes))
    places = spark.sparkContext.broadcast(table)  # at most the capacity squared over the shortest length, whatever the input
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = base.withColumn("__bucket", F.pmod(F.xxhash64(*order_by), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(length_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy(length_col, "__bucket").count().select(length_col, "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy(length_col, "__bucket").orderBy(*order_by)
    ranked = (keyed.withColumn("__at", F.row_number().over(within)).join(starts, [length_col, "__bucket"])
              .withColumn("__rank", F.col("__start") + F.col("__at") - 1).select(*base.columns, "__rank"))

    columns = base.columns

    def run(batches):
        t = places.value
        keys = (t[:, 0] << 44) + t[:, 1]
        for b in batches:
            n, rank = b.column(length_col).to_numpy().astype(np.int64), b.column("__rank").to_numpy()
            at = t[np.searchsorted(keys, (n << 44) + rank, side="right") - 1]
            k = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(at[:, 3] + k // at[:, 2]), pa.array(at[:, 4] + k % at[:, 2] * n)],
                                             names=[*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run), T.StructType([*base.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
