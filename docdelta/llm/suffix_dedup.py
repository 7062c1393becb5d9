"""Removing repeated byte strings across documents by suffix sorting.

Sorting every suffix of a corpus against every other would move each text many times over. So
suffixes are first dealt by content: each string of `width` bytes (50) has an anchor, the 16-byte
string in it of least hash (the leftmost of equals). Equal strings have equal anchors at equal
places, so only anchors that two documents hold can matter, and around those only the bytes that
belong to the anchor's strings travel, to the task of that anchor.

There the different surroundings of an anchor are suffix-sorted, to the right of the anchor and,
reversed, to its left. The sort is deep-shallow: multikey quicksort down to a shallow depth, then a
blind trie for each group whose common prefix is longer. Neighbours' common prefixes give classes of
equal extension at every depth; a string is its class to the left and its class to the right, and the
least document of the pair of classes is the first to hold the string.

Documents whose whole text repeats an earlier document's need none of this and are settled by hash.

An anchor's rows come in ascending order of documents and go by in blocks; from one block to the next
a task keeps only the different surroundings, with the least document of each. Anchors that very many
documents hold are first grouped by their whole surroundings, so that their task gets each of these
once; if even those are more than a block, their strings are grouped one by one. Texts travel
compressed.

Null and empty texts, and those under `width` bytes, lose nothing. Strings never cross documents.
Rows with equal ids are separate rows that remove nothing from each other; a null id counts as an
id below all others. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docdelta.llm.common import NO_ID, by_batch, id_and_text, slices, stored, table

WIDTH, GRAM = 50, 16
#: Bits of a hash that tells whether two documents hold an anchor; anchors taken for others' only cost time.
KEY_BITS = 48
#: Bytes of a text handled at once; places within take 24 bits.
PIECE = 1 << 23
SYMBOL, SHALLOW = 4, 8
BLOCK = 50_000
#: An anchor is hot from so many documents on, and from a HOT_SHARE of all (document, anchor) rows: so at most 1 / HOT_SHARE are.
HOT, HOT_SHARE = 50_000, 1 / 20_000
_PLACES, _TRUE = np.arange(1 << 14, dtype=np.uint64), np.ones(1, bool)


# ---- anchors


def _mixed(w8: np.ndarray, n: int) -> np.ndarray:
    h, t = w8[:n] * np.uint64(0x9E3779B97F4A7C15), w8[GRAM - 8 : GRAM - 8 + n] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= t
    h ^= np.right_shift(h, np.uint64(32), out=t)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(29), out=t)
    return h


def anchors(data: bytes, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of the anchor, its hash, first start, last start + 1) for each run of strings with one anchor."""
    parts = [_anchors(np.frombuffer(data, np.uint8, min(PIECE + width - 1, len(data) - i), i), width, i) for i in range(0, max(len(data) - width + 1, 0), PIECE)]
    if not parts:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _anchors(b: np.ndarray, width: int, base: int) -> tuple[np.ndarray, ...]:
    span = width - GRAM + 1
    n = len(b) - GRAM + 1
    # Eight bytes from every place on, little-endian.
    h = _mixed(np.ndarray(len(b) - 7, "<u8", b, strides=(1,)).astype(np.uint64), n)
    least = h & ~np.uint64(0xFFFFFF)
    least |= _PLACES[:n] if n <= len(_PLACES) else np.arange(n, dtype=np.uint64)
    step = 1
    while 2 * step <= span:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < span:
        least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
    first = np.flatnonzero(np.concatenate([_TRUE, least[1:] != least[:-1]]))
    at = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
    return at + base, h[at], first + base, np.append(first[1:], len(least)) + base


# ---- deep-shallow suffix sorting


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    n = min(len(a), len(b))
    if a[start:n] == b[start:n]:
        return n
    low, high = start, n
    while high - low > 1:  # the first difference is at low or later and before high
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class BlindTrie:
    """A compacted trie whose inner nodes keep only the depth at which their children part.

    A string goes down by the bytes at those depths alone, unseen bytes in between, to any leaf;
    one comparison with that leaf's string gives the true depth at which it parts from the trie.
    """

    END = -1

    def __init__(self, text: bytes, number: int):
        self.root: list = [text, [number]]

    def add(self, text: bytes, number: int, known: int) -> None:
        path, node = [], self.root
        while isinstance(node[0], int):
            path.append(node)
            depth, children = node
            b = text[depth] if depth < len(text) else self.END
            node = children[b] if b in children else next(iter(children.values()))
        part = common_prefix(text, node[0], known)
        if part == len(text) == len(node[0]):
            node[1].append(number)
            return
        parent = None
        for above in path:
            if above[0] > part:
                break
            parent = above
        b = text[part] if part < len(text) else self.END
        if parent is not None and parent[0] == part:
            parent[1][b] = [text, [number]]
            return
        below = self.root if parent is None else parent[1][text[parent[0]] if parent[0] < len(text) else self.END]
        other = node[0][part] if part < len(node[0]) else self.END
        new = [part, {other: below, b: [text, [number]]}]
        if parent is None:
            self.root = new
        else:
            parent[1][text[parent[0]] if parent[0] < len(text) else self.END] = new

    def walk(self, before: int):
        """(number, common prefix with the one before) in order; `before` is for the first."""
        stack = [(self.root, before)]
        while stack:
            node, prefix = stack.pop()
            if isinstance(node[0], int):
                order = sorted(node[1])
                stack += [(node[1][b], prefix if i == 0 else node[0]) for i, b in reversed([*enumerate(order)])]
            else:
                for i, number in enumerate(node[1]):
                    yield number, prefix if i == 0 else len(node[0])


def deep_shallow_sort(texts: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of the texts, and the common prefix of each with the one before (-1 for the first).

    Multikey quicksort takes SYMBOL bytes at a time, down to `shallow` bytes.
    """
    if len(texts) == 2:  # as most groups are
        return [0, 1] if texts[0] <= texts[1] else [1, 0], [-1, common_prefix(*texts)]
    order: list[int] = []
    prefixes: list[int] = []
    stack = [([*range(len(texts))], 0)]
    while stack:
        group, depth = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            prefixes.append(common_prefix(texts[order[-2]], texts[group[0]]) if len(order) > 1 else -1)
        elif depth >= shallow:
            trie = BlindTrie(texts[group[0]], group[0])
            for i in group[1:]:
                trie.add(texts[i], i, 0)
            last = order[-1] if order else None
            for i, prefix in trie.walk(-1):
                order.append(i)
                prefixes.append(prefix if prefix >= 0 else -1 if last is None else common_prefix(texts[last], texts[i]))
        else:
            pivot = texts[group[len(group) // 2]][depth : depth + SYMBOL]
            less, same, more = [], [], []
            for i in group:
                symbol = texts[i][depth : depth + SYMBOL]
                (same if symbol == pivot else less if symbol < pivot else more).append(i)
            # A text that ends within the symbol is whole: it goes to a trie of its equals.
            stack += [(g, d) for g, d in ((more, depth), (same, depth + SYMBOL if len(pivot) == SYMBOL else shallow), (less, depth)) if g]
    return order, prefixes


def _classes(sides: list[bytes], groups: list[list[int]], n: int, depths: int) -> np.ndarray:
    """For each depth 0..depths: the class of every text by its first `depth` bytes, within its group."""
    order, prefixes = [], []
    for g in groups:
        o, p = deep_shallow_sort([sides[i] for i in g])
        order += [g[i] for i in o]
        prefixes += p
    order, prefixes = np.array(order, np.int64), np.array(prefixes, np.int64)
    out = np.empty((depths + 1, n), np.int32)
    for d in range(depths + 1):
        out[d, order] = np.maximum.accumulate(np.where(prefixes < d, np.arange(len(order)), 0))
    return out


def first_holders(keys: list[bytes], texts: list[bytes], offsets: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """docs' least, for each text (around an anchor at its offset) and each number of bytes before the anchor.

    Where the text has no string of that kind, the result is the text's own document.
    """
    depths, n = width - GRAM, len(texts)
    out = np.repeat(docs[:, None], depths + 1, axis=1)
    by_key: dict[bytes, list[int]] = {}
    for i, k in enumerate(keys):
        by_key.setdefault(k, []).append(i)
    groups = [g for g in by_key.values() if len(g) > 1]
    if not groups:
        return out
    some = np.array([i for g in groups for i in g], np.int64)
    right = _classes([t[o + GRAM :] for t, o in zip(texts, offsets.tolist(), strict=True)], groups, n, depths)
    left = _classes([t[:o][::-1] for t, o in zip(texts, offsets.tolist(), strict=True)], groups, n, depths)
    after = np.array([len(t) for t in texts]) - offsets - GRAM
    for r in range(depths + 1):
        who = some[(offsets[some] >= r) & (after[some] >= depths - r)]
        if len(who) < 2:
            continue
        code = left[r, who].astype(np.int64) * n + right[depths - r, who]
        o = np.lexsort((docs[who], code))
        start = np.concatenate([[True], code[o][1:] != code[o][:-1]])
        out[who[o], r] = docs[who][o][np.maximum.accumulate(np.where(start, np.arange(len(o)), 0))]
    return out


# ---- Spark

_PACKED = "doc bigint, tag bigint, packed binary"


def _packed(docs: DataFrame) -> DataFrame:
    """(doc, tag, packed): texts compressed before they are shuffled; tag tells rows of equal ids apart."""
    schema = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("packed", pa.binary())])

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        c = zstandard.ZstdCompressor(level=3)
        return {"doc": batch.column("doc"), "tag": batch.column("tag"), "packed": [c.compress((t or "").encode()) for t in batch.column("text").to_pylist()]}

    return docs.mapInArrow(by_batch(run, schema), _PACKED)


def _unpack(batch: pa.RecordBatch):
    d = zstandard.ZstdDecompressor()
    return (d.decompress(x) for x in batch.column("packed").to_pylist())


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - KEY_BITS)).view(np.int64)


def _keys(docs: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("key", pa.int64()), ("doc", pa.int64())])

    def run(batches):
        for batch in batches:
            for piece in slices(batch):
                found = [np.unique(_short(anchors((t or "").encode(), width)[1])) for t in piece.column("text").to_pylist()]
                n = [len(x) for x in found]
                if sum(n):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.repeat(piece.column("doc").to_numpy(), n))], schema=schema)

    return docs.mapInArrow(run, "key bigint, doc bigint")


PLACES = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("offset", pa.int32()), ("around", pa.binary())])
PLACES_DDL = "doc bigint, tag bigint, start bigint, offset int, around binary"


def _places(batch_width: int, hot, want_hot: bool):
    """The surroundings of the shared anchors that are hot, or of those that aren't. hot: broadcast, sorted."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        out: dict[str, list] = {f.name: [] for f in PLACES}
        for doc, tag, alone, keys, whole, data in zip(*(batch.column(c).to_pylist() for c in ("doc", "tag", "alone")), batch.column("keys"), batch.column("whole").to_pylist(), _unpack(batch), strict=True):
            if not keys.is_valid or (whole and tag in whole):
                continue
            at, h, i0, i1 = anchors(data, batch_width)
            h = _short(h)
            shared = np.sort(keys.values.to_numpy())
            here = shared.take(np.searchsorted(shared, h), mode="clip") == h
            some = np.flatnonzero(here & (np.isin(h, hot.value) == want_hot) if len(hot.value) else here)
            out["doc"] += [doc] * len(some)
            out["tag"] += [0 if alone else tag] * len(some)
            out["start"] += i0[some].tolist()
            out["offset"] += (at[some] - i0[some]).tolist()
            out["around"] += [data[a : b + batch_width - 1] for a, b in zip(i0[some].tolist(), i1[some].tolist(), strict=True)]
        return out

    return run


SPANS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _sort_block(rows: dict[str, list], width: int) -> tuple[pa.RecordBatch, dict[str, list]]:
    """The spans that the block's rows lose, and what the next block must know of the last key."""
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault(k, len(kinds)) for k in zip(rows["offset"], rows["around"], strict=True)], np.int64)
    doc = np.array(rows["doc"], np.int64)
    least = np.full(len(kinds), 2**63 - 1, np.int64)
    np.minimum.at(least, kind, doc)
    offsets, texts = ([k[i] for k in kinds] for i in range(2))
    keys = [t[o : o + GRAM] for o, t in zip(offsets, texts, strict=True)]
    offsets = np.array(offsets, np.int64)
    holders = first_holders(keys, texts, offsets, least, width)
    lengths = np.array([len(t) for t in texts], np.int64) - width + 1
    # Column j is the string that starts j bytes into the surroundings, offset - j bytes before the anchor.
    depths = width - GRAM
    j = np.arange(depths + 1)[None, :]
    r = np.clip(offsets[:, None] - j, 0, depths)
    first = np.take_along_axis(holders, r, axis=1)
    first[j >= lengths[:, None]] = 2**63 - 1
    lost = (first[kind] < doc[:, None]) & np.array([t is not None for t in rows["start"]])[:, None]
    edge = np.diff(np.pad(lost.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    start = np.array([s or 0 for s in rows["start"]], np.int64)
    tag = np.array(rows["tag"], np.int64)
    out = pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[row], tag[row], start[row] + a, start[row] + b - 1 + width)], schema=SPANS)
    last = keys[kind[-1]]
    keep = [i for i, k in enumerate(keys) if k == last]
    return out, {"doc": least[keep].tolist(), "tag": [0] * len(keep), "start": [None] * len(keep), "offset": offsets[keep].tolist(), "around": [texts[i] for i in keep]}


def _spans(width: int, block: int):
    def run(batches):
        rows: dict[str, list] = {f.name: [] for f in PLACES}
        for batch in batches:
            for name in rows:  # no value from Spark is null
                rows[name] += batch.column(name).to_numpy(zero_copy_only=False).tolist()
            if len(rows["doc"]) >= block:
                out, rows = _sort_block(rows, width)
                yield out
        if rows["doc"]:
            yield _sort_block(rows, width)[0]

    return run


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("kept", pa.binary())])


def _remove(batch: pa.RecordBatch) -> dict[str, list]:
    out: dict[str, list] = {f.name: [] for f in OUT}
    for doc, tag, spans, data in zip(batch.column("doc").to_pylist(), batch.column("tag").to_pylist(), batch.column("spans").to_pylist(), _unpack(batch), strict=True):
        merged: list[list[int]] = []
        for s in sorted((s["a"], s["b"]) for s in spans or [] if s["tag"] in (0, tag)):
            if merged and s[0] <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s[1])
            else:
                merged.append([*s])
        ends = [0, *(x for s in merged for x in s), len(data)]
        out["doc_id"].append(None if doc == NO_ID else doc)
        out["n_bytes"].append(len(data))
        out["spans"].append([{"a": a, "b": b} for a, b in merged])
        out["kept"].append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
    return out


def _anchor() -> Column:
    """The anchor is in its surroundings and needs no column."""
    return F.substring("around", F.col("offset") + 1, F.lit(GRAM))


def _hot_spans(places: DataFrame, width: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Spans that repeated surroundings of hot anchors lose, and the places that are left: a row of each kind of surroundings.

    A row whose surroundings an earlier document holds too loses them whole and holds nothing new.
    Where an anchor's different surroundings are more than a block, their strings are compared as they are.
    """
    places = stored(places, "hot-places")
    kind = ["offset", "around"]
    firsts = places.groupBy(*kind).agg(F.min("doc").alias("first"))
    judged = stored(places.join(firsts, kind), "hot-kinds")
    end = F.col("start") + F.length("around")
    whole = judged.where("doc > first").select("doc", "tag", F.col("start").alias("a"), end.alias("b"))
    left = judged.where("doc = first").drop("first").withColumn("anchor", _anchor())
    wide = left.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > block).select("anchor")
    strings = left.join(wide, "anchor").withColumn("j", F.explode(F.sequence(F.lit(0), F.length("around") - width)))
    strings = strings.select("doc", "tag", (F.col("start") + F.col("j")).alias("a"), F.substring("around", F.col("j") + 1, F.lit(width)).alias("string"))
    first = strings.groupBy("string").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    lost = strings.join(first, "string").where("doc > first").select("doc", "tag", "a", (F.col("a") + width).alias("b"))
    return whole.unionByName(lost), left.join(wide, "anchor", "left_anti").drop("anchor")


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, spans (maximal removed runs, half-open), kept (the other bytes)."""
    # The tag tells rows of equal ids apart; where an id has one row alone, 0 stands for it on the way.
    rows = id_and_text(docs, id_col, text_col).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("tag"), "text")
    alone = rows.groupBy("doc").agg((F.count("*") == 1).alias("alone"))
    one_key = Window.partitionBy("key")
    keys = stored(_keys(rows, width).withColumn("low", F.min("doc").over(one_key)).withColumn("high", F.max("doc").over(one_key)).withColumn("n", F.count("*").over(one_key)).where("low < high").select("key", "doc", "n"), "shared-anchors")
    # At most 1 / HOT_SHARE rows of one number.
    common = keys.where(F.col("n") >= max(HOT, keys.count() * HOT_SHARE)).select("key").distinct()
    # A copy of an earlier document's whole text loses all of it, and holds nothing that the earlier one doesn't.
    texts = rows.select("doc", "tag", F.md5(F.col("text").cast("binary")).alias("h"), F.octet_length("text").cast("long").alias("n")).where(F.col("n") >= width)
    firsts = texts.groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = texts.join(firsts, "h").where("doc > first").select("doc", "tag", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")).distinct()
    wanted = keys.groupBy("doc").agg(F.collect_set("key").alias("keys")).join(alone, "doc").join(copies.groupBy("doc").agg(F.collect_set("tag").alias("whole")), "doc", "left")
    # Both joins deal the texts out alike, so they are shuffled once.
    packed = _packed(rows)
    with_keys = packed.join(wanted, "doc", "left")
    hot_keys = np.sort(np.array([r.key for r in common.collect()], np.int64))
    hot = docs.sparkSession.sparkContext.broadcast(hot_keys)
    places = with_keys.mapInArrow(by_batch(_places(width, hot, False), PLACES), PLACES_DDL)
    if len(hot_keys):
        whole, left = _hot_spans(with_keys.mapInArrow(by_batch(_places(width, hot, True), PLACES), PLACES_DDL), width, BLOCK)
        copies, places = copies.unionByName(whole), places.unionByName(left)
    spans = places.repartition(_anchor()).sortWithinPartitions(_anchor(), "doc").mapInArrow(_spans(width, BLOCK), "doc bigint, tag bigint, a bigint, b bigint")
    spans = spans.unionByName(copies).groupBy("doc").agg(F.collect_list(F.struct("tag", "a", "b")).alias("spans"))
    return packed.join(spans, "doc", "left").mapInArrow(by_batch(_remove, OUT), "doc_id bigint, n_bytes bigint, spans array<struct<a: bigint, b: bigint>>, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = remove_repeats(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
with b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 100) as k from (select doc_id, h, unnest(generate_series(0, len(h) // 2 - 50)) as i from b where len(h) >= 100)),
f as (select k, min(doc_id) as m from w group by k having min(doc_id) < max(doc_id)),
s as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 50 then 0 else 1 end as new from w join f using (k) where m < doc_id),
g as (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from s),
r as (select doc_id, g, min(i) as a, max(i) + 50 as b from g group by doc_id, g),
x as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as p, row_number() over (partition by doc_id order by a desc) as last from r),
kept as (select x.doc_id, sum(x.b - x.a) as n_removed, count(*) as n_spans,
                string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' order by a) || max(case when last = 1 then substr(h, 2 * x.b + 1) end) as k
         from x join b using (doc_id) group by x.doc_id)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(k, h))) as kept_sha256
from b left join kept using (doc_id)
"""
