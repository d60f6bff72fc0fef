"""Substring dedup by recompression: repeated windows of words found through consistently named symbols.

Rounds of recompression rename the word sequence of every document: the first names runs of one word, and every round
names pairs of neighbours whose names' hash bits are 0 and 1. A name is a hash of what it stands for, so the names are
global without an exchange, and a symbol depends only on the words of a short context around it: equal passages get
equal symbols inside. Of the symbols whose context lies in a window, the one of the highest round and the smallest hash is
the window's symbol, so equal windows have equal symbols, and neighbouring windows mostly share one.

1. The symbols are counted by document; a fixed-size bitmap keeps where symbols of several documents are.
2. Groups of windows with a shared symbol come with a hash of all their words. An aggregate gives the smallest document
   of each group, which settles the copies of whole groups.
3. Symbols whose groups differ (a passage begins or ends there) are compared window by window: only the first
   document of each different group sends its windows.

All comparisons are by two independent 64-bit hashes of the words (of a symbol's context and of the group or window).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, bound_batches, discard, release, stored, tidy

ROUNDS = 2
#: Bits of the map of shared symbols (16 MB, whatever the input): it only spares rows from the exact joins that follow.
MAP_BITS = 27
#: Words that are looked at together; longer documents are taken in parts that overlap by a window less one word.
PART_WORDS = 1 << 16
FAR = 1 << 40
SEED = 42
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(30))
        x = x * _U(0xBF58476D1CE4E5B9)
        x = x ^ (x >> _U(27))
        x = x * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


class Spans:
    """Hashes of spans of a sequence: a polynomial modulo 2^64 in an odd base, mixed with the length."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, names: np.ndarray, base: int):
        power, self.inverse = self.powers(base, len(names) + 1)
        self.base = _U(base)
        self.sums = np.zeros(len(names) + 1, dtype=np.uint64)
        np.cumsum(mix(names ^ self.base) * power[:len(names)], out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(n, 1 << 16)
            have = cls._powers[base] = tuple(
                np.cumprod(np.append(_U(1), np.full(size - 1, b, dtype=np.uint64)), dtype=np.uint64)
                for b in (base, pow(base, -1, 1 << 64)))
        return have

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return mix((self.sums[last + 1] - self.sums[first]) * self.inverse[first] + (last - first).astype(np.uint64) * self.base)


BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)


def run_round(names: np.ndarray, part: np.ndarray) -> dict[str, np.ndarray]:
    """Name the maximal runs of equal words; a run's context is itself and one word on either side."""
    n = len(names)
    first = np.ones(n, dtype=bool)
    first[1:] = (names[1:] != names[:-1]) | (part[1:] != part[:-1])
    lo = np.flatnonzero(first)
    hi = np.append(lo[1:], n) - 1
    size = (hi - lo + 1).astype(np.uint64)
    name = np.where(size == 1, names[lo], mix(names[lo] + size * _U(BASES[2])))
    begins = np.ones(len(lo), dtype=bool)
    begins[1:] = part[lo[1:]] != part[lo[:-1]]
    ends = np.append(begins[1:], True)
    return {"name": name, "part": part[lo], "lo": np.where(begins, -FAR, lo - 1), "hi": np.where(ends, FAR, hi + 1)}


def pair_round(s: dict[str, np.ndarray], at: int) -> dict[str, np.ndarray]:
    """Name the pairs of neighbours with bits 0 and 1; a symbol left alone also depends on the neighbour that it missed."""
    name, part, lo, hi = s["name"], s["part"], s["lo"], s["hi"]
    n = len(name)
    if not n:
        return s
    bit = (mix(name + _U((at + 1) * BASES[0] % (1 << 64))) >> _U(63)).astype(bool)
    same = part[1:] == part[:-1]  # whether the next symbol is of the same part
    opens = np.zeros(n, dtype=bool)
    opens[:-1] = same & ~bit[:-1] & bit[1:]
    closes = np.zeros(n, dtype=bool)
    closes[1:] = opens[:-1]
    after, before = np.minimum(np.arange(n) + 1, n - 1), np.maximum(np.arange(n) - 1, 0)
    has_after, has_before = np.append(same, False), np.insert(same, 0, False)
    other = np.where(bit, before, after)
    missing = np.where(bit, ~has_before, ~has_after)
    new_lo = np.where(missing & bit, -FAR, np.minimum(lo, lo[other]))
    new_hi = np.where(missing & ~bit, FAR, np.maximum(hi, hi[other]))
    new_lo, new_hi = np.where(missing & ~bit, lo, new_lo), np.where(missing & bit, hi, new_hi)
    new = np.where(opens, mix(mix(name + _U(BASES[1])) + name[after] * _U(BASES[2])), name)
    keep = ~closes
    return {"name": new[keep], "part": part[keep], "lo": new_lo[keep], "hi": new_hi[keep]}


def window_groups(names: np.ndarray, starts: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with one symbol: ``key`` (hash of the symbol's context), ``hash`` (of all their
    words), ``first`` window and number ``n``. ``starts`` are the parts' first words, and the end."""
    size = np.diff(starts)
    part = np.repeat(np.arange(len(size)), size)
    begin, end = starts[:-1][part], starts[1:][part]
    pos = np.arange(len(names))
    valid = pos + window <= end
    levels = [run_round(names, part)]
    for at in range(ROUNDS):
        levels.append(pair_round(levels[-1], at))
    low, high = pos.copy(), pos + window - 1  # context of the window's symbol; without one the window itself
    pick = np.full(len(names), -1, dtype=np.int64)
    todo = valid.copy()
    for depth, s in reversed(list(enumerate(levels))):
        if not todo.any():
            break
        inside = np.flatnonzero(s["hi"] - s["lo"] < window)
        lo, hi = s["lo"][inside], s["hi"][inside]
        a, b = np.maximum(hi - window + 1, begin[lo]), np.minimum(lo, end[lo] - window)
        seen = np.concatenate([[0], np.cumsum(todo)])
        use = np.flatnonzero((b >= a) & (seen[np.maximum(b, a) + 1] > seen[a]))
        use = use[np.argsort(mix(s["name"][inside][use]), kind="stable")[::-1]]  # the smallest hash, and of equals the first, comes last
        count = b[use] - a[use] + 1
        which = np.repeat(use, count)
        w = a[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        found = np.full(len(names), -1, dtype=np.int64)
        found[w] = which  # the last one assigned stays
        set_now = todo & (found >= 0)
        low[set_now], high[set_now] = lo[found[set_now]], hi[found[set_now]]
        pick[set_now] = found[set_now] * (ROUNDS + 1) + depth
        todo &= ~set_now
    at = np.flatnonzero(valid)
    if not len(at):
        return {k: np.zeros(0, dtype=np.int64) for k in ("key", "hash", "first", "n")}
    alone = pick[at] < 0
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (pick[at][1:] != pick[at][:-1]) | alone[1:]
    first = at[new]
    n = np.diff(np.append(np.flatnonzero(new), len(at)))
    return {"key": Spans(names, BASES[0])(low[first], high[first]), "hash": Spans(names, BASES[1])(first, first + n + window - 2), "first": first, "n": n}


def word_names(text: str | None) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def text_hash(text: str) -> int:
    """Spark's xxhash64 of the text."""
    x = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), SEED)
    return x - (1 << 64) if x >> 63 else x


def pieces(batch: pa.RecordBatch, window: int):
    """Word sequences of about ``PART_WORDS`` words with their documents: (names, starts, document of each part, offset)."""
    hold: list[tuple[np.ndarray, int, int]] = []
    total = 0
    for i, (doc, text) in enumerate(zip(batch.column("id").to_pylist(), batch.column("text").to_pylist())):
        if doc is None or text is None:
            continue
        names = word_names(text)
        if len(names) < window:
            continue
        for at in range(0, len(names) - window + 1, PART_WORDS):
            hold.append((names[at:at + PART_WORDS + window - 1], i, at))
            total += len(hold[-1][0])
            if total >= PART_WORDS:
                yield joined(hold)
                hold, total = [], 0
    if hold:
        yield joined(hold)


def joined(hold):
    sizes = [len(x) for x, _, _ in hold]
    return np.concatenate([x for x, _, _ in hold]), np.concatenate([[0], np.cumsum(sizes)]), np.array([i for _, i, _ in hold]), np.array([a for _, _, a in hold])


def symbol_counts(docs: DataFrame, window: int) -> DataFrame:
    """Rows ``(key)`` of the symbols that windows of two documents or more have."""

    def run(batches):
        for b in batches:
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for names, starts, doc, _ in pieces(b, window):
                g = window_groups(names, starts, window)
                owner = doc[np.searchsorted(starts, g["first"], side="right") - 1]
                order = np.lexsort((owner, g["key"]))
                key, owner = g["key"][order], owner[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(ids[owner[new]].astype(np.int64))], names=["key", "id"])

    return docs.mapInArrow(tidy(run), "key long, id long").groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("key")


def shared_map(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``2 ** MAP_BITS`` places with the places of ``keys``, taken from their first bits."""
    place = F.shiftrightunsigned("key", 64 - MAP_BITS)
    cells = (keys.select(F.shiftright(place, 6).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, %d) & 63 as int))" % (64 - MAP_BITS)).alias("bit"))
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (MAP_BITS - 6), dtype=np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def shared_groups(docs: DataFrame, window: int, shared) -> DataFrame:
    """Groups whose symbol is in the map: ``(key, hash, id, text_hash, first, n, windows)``, ``windows`` the window hashes."""

    def run(batches):
        bits = shared.value
        for b in batches:
            ids, texts = b.column("id").to_numpy(zero_copy_only=False), b.column("text")
            for names, starts, doc, offset in pieces(b, window):
                g = window_groups(names, starts, window)
                place = g["key"] >> _U(64 - MAP_BITS)
                keep = np.flatnonzero((bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63))) & _U(1))
                first, n = g["first"][keep], g["n"][keep]
                part = np.searchsorted(starts, first, side="right") - 1
                owner = doc[part]
                hashes = {i: text_hash(texts[i].as_py()) for i in np.unique(owner).tolist()}
                w = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                data = Spans(names, BASES[2])(w, w + window - 1)
                ends = (np.concatenate([[0], np.cumsum(n)]) * 8).astype(np.int32)
                windows = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([
                    pa.array(g["key"][keep].view(np.int64)), pa.array(g["hash"][keep].view(np.int64)), pa.array(ids[owner].astype(np.int64)),
                    pa.array(np.array([hashes[i] for i in owner.tolist()], dtype=np.int64)), pa.array((first - starts[part] + offset[part]).astype(np.int64)),
                    pa.array(n.astype(np.int32)), windows], names=["key", "hash", "id", "text_hash", "first", "n", "windows"])

    return docs.mapInArrow(tidy(run), "key long, hash long, id long, text_hash long, first long, n int, windows binary")


def window_rows(groups: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            n = b.column("n").to_numpy()
            rep = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            data = np.frombuffer(b"".join(b.column("windows").to_pylist()), dtype="<i8")
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(rep)), pa.array(data), b.column("id").take(pa.array(rep)), b.column("text_hash").take(pa.array(rep)),
                                              pa.array(b.column("first").to_numpy()[rep] + step)], names=["key", "window", "id", "text_hash", "first"])

    return groups.select("key", "n", "windows", "id", "text_hash", "first").mapInArrow(tidy(run), "key long, window long, id long, text_hash long, first long")


def repeated_ranges(df: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Rows ``(id, text_hash, ranges)``: by turns a first word and a number of windows from there on that also start in a row
    with a smaller id."""
    spark = df.sparkSession
    bound_batches(spark)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    shared = spark.sparkContext.broadcast(shared_map(symbol_counts(docs, window)))
    release(spark)
    groups = stored(shared_groups(docs, window, shared), "groups")
    least = stored(groups.groupBy("key", "hash").agg(F.min("id").alias("least"), F.max("id").alias("most")), "least")
    release(spark)
    several = least.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("key", F.lit(True).alias("several"))
    told = least.join(several, "key", "left").where("several or least < most").select("key", "hash", "least", F.coalesce("several", F.lit(False)).alias("several"))
    judged = stored(groups.join(told, ["key", "hash"]).where("id > least or several")
                    .select("key", "id", "text_hash", "first", "n", F.when(F.col("id") == F.col("least"), F.col("windows")).alias("windows"), "least"), "judged")
    discard(groups, least)
    release(spark)
    whole = judged.where("id > least").select("id", "text_hash", "first", "n")
    windows = stored(window_rows(judged.where("id = least")), "windows")
    first = windows.groupBy("key", "window").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("key", "window", "least")
    single = windows.join(first, ["key", "window"]).where("id > least").select("id", "text_hash", "first", F.lit(1).alias("n"))
    ranges = whole.unionByName(single).groupBy("id", "text_hash").agg(F.flatten(F.collect_list(F.array("first", F.col("n").cast("long")))).alias("ranges"))
    ranges = stored(ranges, "ranges")
    discard(judged, windows)
    release(spark)
    return ranges


def keep_words(text: str | None, ranges: list[int] | None, window: int) -> tuple[int, int, str, str]:
    """Words, removed words, the kept words joined by one space, and the text without the removed passages.

    ``ranges`` holds first window and number of windows by turns. The text without passages keeps the white space inside
    kept stretches and joins the stretches by a line break; an untouched text stays as it is.
    """
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not ranges:
        return len(words), 0, b" ".join(words).decode("utf-8", "surrogatepass"), text or ""
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    r = np.array(ranges, dtype=np.int64).reshape(-1, 2)
    np.add.at(edge, r[:, 0], 1)
    np.add.at(edge, r[:, 0] + r[:, 1] + window - 1, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept = [w for w, g in zip(words, gone.tolist()) if not g]
    raw, at, stretches = (text or "").encode("utf-8", "surrogatepass"), 0, []
    cuts = [0, *(np.flatnonzero(np.diff(gone)) + 1).tolist(), len(words)]
    for a, b in zip(cuts, cuts[1:]):
        begin = None
        for w in words[a:b]:
            at = raw.index(w, at)
            begin = at if begin is None else begin
            at += len(w)
        if not gone[a]:
            stretches.append(raw[begin:at])
    return len(words), int(gone.sum()), b" ".join(kept).decode("utf-8", "surrogatepass"), b"\n".join(stretches).decode("utf-8", "surrogatepass")


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Add ``n_words``, ``n_removed`` (longs), ``kept_words`` and ``kept_text``: ``df`` without the words covered by a window of
    ``window`` consecutive words that also starts in a row with a smaller id.

    Words are runs without ASCII white space. Windows are judged on the input, not on what is left. Null texts count as
    empty; texts of fewer words than a window and rows with a null id stay whole (and take nothing from others). Rows that
    repeat an id do not take from each other. Existing columns with the new names are replaced; an empty table stays empty.
    """
    if window < 1:
        raise ValueError("window must be positive")
    ranges = repeated_ranges(df, id_col, text_col, window)
    by_doc = ranges.select(F.col("id").alias("__doc"), F.col("text_hash").alias("__text_hash"), F.col("ranges").alias("__ranges"))
    new = ("n_words", "n_removed", "kept_words", "kept_text")
    base = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in new))
    both = base.join(by_doc, (F.col(f"`{id_col}`") == F.col("__doc")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__text_hash")), "left").drop("__doc", "__text_hash")

    def make():
        def work(b):
            out = [keep_words(t, r, window) for t, r in zip(b.column(text_col).to_pylist(), b.column("__ranges").to_pylist())]
            return [pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))]

        return work

    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_words", T.StringType()), T.StructField("kept_text", T.StringType())]
    return add_columns(both, fields, make).drop("__ranges")
